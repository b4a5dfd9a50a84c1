"""Civic-complaint analytics as pure DataFrame functions."""
