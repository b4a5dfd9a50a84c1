"""Reads of the civic tables at one version, within districts, with what is not there named."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.sources.store import Snapshot

#: The tables of a mesh, the columns that are read, and the factors of a score that need them.
MESH = {
    "wards": ("ward_code", "name", "district", "state", "latitude", "longitude", "population"),
    "citizen_demand": ("ward_code", "sector", "category", "window_days", "complaint_count", "critical_count", "avg_severity"),
    "demand_windows": ("ward_code", "sector", "window_days", "bucket", "complaint_count", "critical_count", "avg_severity"),
    "gaps": ("ward_code", "sector", "gap_score", "severity"),
    "projects": ("project_code", "ward_code", "sector", "status", "title", "budget_lakhs", "spent_lakhs", "sanctioned_on", "planned_days", "delay_days"),
}
FACTORS = {"citizen_demand": ("demand", "severity"), "demand_windows": ("trend",), "gaps": ("coverage",), "projects": ("service_failure",)}


@dataclass(frozen=True)
class Mesh:
    version: int
    tables: dict[str, DataFrame]
    missing: tuple[str, ...]

    @property
    def degraded(self) -> tuple[str, ...]:
        """Factors that nothing is known of, since their table is missing."""
        return tuple(f for t in self.missing for f in FACTORS.get(t, ()))

    def counts(self) -> DataFrame:
        """(table, rows) of what is there, in one plan."""
        found = None
        for name, t in self.tables.items():
            n = t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
            found = n if found is None else found.unionByName(n)
        return found


def read_mesh(snapshot: Snapshot, districts: list[str] | None = None, wanted: dict[str, tuple[str, ...]] = MESH) -> Mesh:
    """The wanted tables of one snapshot with their own columns; further ones aren't read.

    ``districts`` keeps the wards of these, and of every other table the rows of these wards. Names that no ward has leave all tables empty, and so does a scope without a table of wards.
    No list, or an empty one, is no scope. Absent tables are ``missing``.
    """
    there = {n: snapshot.table(n).select(*columns) for n, columns in wanted.items() if n in snapshot}
    missing = tuple(n for n in wanted if n not in there)
    if districts:
        wards = there["wards"].where(F.col("district").isin(*districts)) if "wards" in there else None
        there = {n: wards if n == "wards" else t.join(wards.select("ward_code").distinct(), "ward_code", "left_semi") if wards is not None else t.where("false") for n, t in there.items()}
    return Mesh(snapshot.version, there, missing)


def profiles(mesh: Mesh) -> DataFrame:
    """One row for each ward in scope: complaints, worst gap, stalled and all projects; what a missing table would tell is null. One plan for all wards."""
    out = mesh.tables["wards"].select("ward_code", "district")
    sums = {
        "citizen_demand": [F.sum("complaint_count").alias("complaints")],
        "gaps": [F.max("gap_score").alias("worst_gap")],
        "projects": [F.count("*").alias("projects"), F.count_if(F.col("status").isin("DELAYED", "STALLED")).alias("stalled")],
    }
    names = {"citizen_demand": ("complaints",), "gaps": ("worst_gap",), "projects": ("projects", "stalled")}
    for t, aggregates in sums.items():
        if t in mesh.tables:
            out = out.join(mesh.tables[t].groupBy("ward_code").agg(*aggregates), "ward_code", "left")
            if t != "gaps":
                out = out.withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in names[t]})
        else:
            out = out.withColumns({n: F.lit(None).cast("double" if t == "gaps" else "long") for n in names[t]})
    return out
