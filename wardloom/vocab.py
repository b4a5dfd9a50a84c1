"""Fixed vocabularies. All values here must equal those that data and results are exchanged with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Sectors, also the actionable categories of a complaint.
SECTORS = ("WATER", "ELECTRICITY", "ROAD", "SANITATION", "HEALTHCARE", "EDUCATION", "TRANSPORT", "DIGITAL_CONNECTIVITY", "HOUSING", "PUBLIC_SAFETY")
UNKNOWN = "UNKNOWN"

# People that one unit of an asset type serves.
CAPACITY = {
    "WATER_SUPPLY": 1500, "BOREWELL": 800, "ELECTRICITY_POLE": 250, "TRANSFORMER": 1200, "STREET_LIGHT": 400, "ROAD": 0, "DRAIN": 900,
    "SEWAGE_LINE": 2500, "WASTE_BIN": 300, "HEALTH_CLINIC": 5000, "SCHOOL": 1200, "BUS_STOP": 800, "PUBLIC_TOILET": 600, "WIFI_HOTSPOT": 700,
}

# Asset types that give each sector capacity.
SECTOR_ASSETS = {
    "WATER": ("WATER_SUPPLY", "BOREWELL"),
    "ELECTRICITY": ("TRANSFORMER", "ELECTRICITY_POLE"),
    "ROAD": ("ROAD",),
    "SANITATION": ("SEWAGE_LINE", "DRAIN", "WASTE_BIN", "PUBLIC_TOILET"),
    "HEALTHCARE": ("HEALTH_CLINIC",),
    "EDUCATION": ("SCHOOL",),
    "TRANSPORT": ("BUS_STOP",),
    "DIGITAL_CONNECTIVITY": ("WIFI_HOTSPOT",),
}

# Condition grades, status factors, statuses, refresh cadence in days.
CONDITION = {"GOOD": 0, "FAIR": 1, "POOR": 2, "CRITICAL": 3}
STATUS_FACTOR = {"FUNCTIONAL": 1.0, "PARTIAL": 0.5, "UNDER_REPAIR": 0.25, "BROKEN": 0.0, "NOT_STARTED": 0.0}
PROJECT_STATUSES = ("PLANNED", "IN_PROGRESS", "COMPLETED", "DELAYED", "CANCELLED")
ACTIVE_STATUSES = ("PLANNED", "IN_PROGRESS", "DELAYED")
CADENCE = {"CITIZEN": 7, "GIS": 90, "INFRASTRUCTURE": 30, "INVESTMENT": 60, "DEMOGRAPHICS": 365}
TIERS = ("CRITICAL", "HIGH", "MODERATE", "NORMAL")
DIRECTIONS = ("WORSENING", "IMPROVING", "STABLE", "UNKNOWN")
RISK_SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
RISK_TYPES = ("SPIKE", "NEW_CATEGORY", "DETERIORATING_WITH_SPEND", "STALLED_ABSORPTION", "CRITICAL_CONCENTRATION")
LANGUAGES = ("en", "ta", "hi", "te", "bn", "kn", "ml")
# Texts that stand for nothing.
NULL_TOKENS = ("", "null", "none", "nil", "n/a", "na", "na.", "nan", "undefined", "-", "--", "unknown", "not specified", "not available", "no data", "नहीं पता", "தெரியவில்லை")
# Codes and names of each language, and the languages that texts are normalised in and that detection may give.
LANGUAGE_NAMES = {
    "en": ("en", "eng", "english"), "ta": ("ta", "tam", "tamil", "தமிழ்"), "hi": ("hi", "hin", "hindi", "हिन्दी", "हिंदी"), "te": ("te", "tel", "telugu", "తెలుగు"),
    "bn": ("bn", "ben", "bengali", "bangla", "বাংলা"), "kn": ("kn", "kan", "kannada", "ಕನ್ನಡ"), "ml": ("ml", "mal", "malayalam", "മലയാളം"), "mr": ("mr", "mar", "marathi", "मराठी"),
    "pt": ("pt", "por", "portuguese"), "ru": ("ru", "rus", "russian"), "zh": ("zh", "zho", "chinese", "中文"),
}
ROMANISED_NAMES = ("romanised", "romanized", "transliterated")
SUPPORTED_LANGUAGES = ("en", "ta", "hi", "te", "bn", "kn", "ml")
DETECTED_LANGUAGES = ("en", "ta", "hi", "te", "bn", "kn", "ml", "mr", "romanised")


def sector_assets(spark: SparkSession) -> DataFrame:
    """(sector, asset_type, per_unit): at most as many rows as there are asset types."""
    return spark.createDataFrame([(s, a, CAPACITY[a]) for s, types in SECTOR_ASSETS.items() for a in types], "sector string, asset_type string, per_unit long")


def one_column(spark: SparkSession, name: str, values: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")
