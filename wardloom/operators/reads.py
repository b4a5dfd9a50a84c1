"""Reads with parameters: what is given filters, what is not given does not, and all of it reaches the scan as one conjunction.

Each read orders its rows in one total order. With a limit only the first rows are kept in each task and merged; without one the rows are sorted by ranges.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.operators import intel
from wardloom.vocab import DIRECTIONS, RISK_SEVERITIES, RISK_TYPES, SECTOR_ASSETS, SECTORS, TIERS

BANDS = ("HIGH", "MEDIUM", "LOW")
RISK_STATUSES = ("OPEN", "ACKNOWLEDGED", "DISMISSED", "RESOLVED")
#: The largest limit that a caller may ask for.
MOST = 500


@dataclass(frozen=True)
class Rule:
    """What one parameter asks of a row. Values outside ``values`` are refused; ``fold`` brings a value into the form that is compared."""

    test: Callable[[Any], Column]
    kinds: tuple[type, ...] = (str,)
    values: tuple[str, ...] | None = None
    fold: Callable[[Any], Any] = lambda v: v

    def of(self, name: str, value: Any) -> Column:
        if not isinstance(value, self.kinds) or isinstance(value, bool):
            raise TypeError(f"{name} must be {' or '.join(k.__name__ for k in self.kinds)}")
        value = self.fold(value)
        if self.values is not None and value not in self.values:
            raise ValueError(f"unknown {name}: {value}")
        return self.test(value)


def equal(column: str, values: tuple[str, ...] | None = None, kind: type = str, fold: Callable = lambda v: v) -> Rule:
    return Rule(lambda v: F.col(column) == v, (kind,), values, fold)


def at_least(column: str) -> Rule:
    return Rule(lambda v: F.col(column) >= v, (int, float))


def since(column: str) -> Rule:
    return Rule(lambda v: F.col(column) >= F.lit(v), (dt.datetime, dt.date))


def any_case(column: str) -> Rule:
    return Rule(lambda v: F.lower(column) == F.lower(F.lit(v)))


@dataclass(frozen=True)
class Read:
    """A read of one table. order: column names, the largest first after a minus, or functions that make an order; limit: how many rows where none is asked for."""

    rules: dict[str, Rule]
    order: tuple[str | Callable[[], Column], ...]
    limit: int | None = None
    always: Callable[[], Column] | None = None

    def __call__(self, rows: DataFrame, limit: int | None = None, offset: int = 0, **given: Any) -> DataFrame:
        """The rows that meet all given parameters, in order; None and "" are not given. Nulls meet no parameter."""
        unknown = sorted(set(given) - set(self.rules))
        if unknown:
            raise TypeError(f"no such parameter: {', '.join(unknown)}")
        limit = self.limit if limit is None else limit
        if limit is not None and not 1 <= limit <= MOST:
            raise ValueError(f"limit must be 1 to {MOST}")
        if offset < 0:
            raise ValueError("offset must not be negative")
        keep = self.always() if self.always else F.lit(True)
        for name, value in given.items():
            if value is not None and value != "":
                keep = keep & self.rules[name].of(name, value)
        out = rows.where(keep).orderBy(*[o() if callable(o) else F.desc(o[1:]) if o[0] == "-" else F.asc(o) for o in self.order])
        out = out.offset(offset) if offset else out
        return out if limit is None else out.limit(limit)


def _by_severity() -> Column:
    rank = F.lit(len(RISK_SEVERITIES))
    for i, s in enumerate(reversed(RISK_SEVERITIES)):
        rank = F.when(F.col("severity") == s, i).otherwise(rank)
    return rank


_SECTOR, _WARD, _DISTRICT, _DAYS = equal("sector", SECTORS), equal("ward_code"), equal("district"), equal("window_days", kind=int)
_ASSETS = Rule(lambda v: F.col("asset_type").isin(*SECTOR_ASSETS.get(v, ())) if v in SECTOR_ASSETS else F.lit(False), values=SECTORS)

understandings = Read({"category": equal("category"), "language": equal("language"), "status": equal("status"), "min_severity": at_least("severity"), "since": since("created_at")}, ("-created_at", "request_id"))
wards = Read({"district": _DISTRICT, "state": equal("state")}, ("ward_code",))
assets = Read({"ward_code": _WARD, "sector": _ASSETS, "status": equal("status")}, ("asset_code",))
projects = Read({"ward_code": _WARD, "sector": _SECTOR, "status": equal("status")}, ("project_code",))
demand = Read({"ward_code": _WARD, "sector": _SECTOR}, ("ward_code", "sector", "category"))
gaps = Read({"ward_code": _WARD, "sector": _SECTOR, "severity": equal("severity"), "min_score": at_least("gap_score")}, ("-gap_score", "ward_code", "sector"))
lineage = Read({"ward_code": _WARD, "sector": _SECTOR, "category": equal("category")}, ("-received_at", "request_id"), 100)
lineage_of_group = Read({"issue_group_id": equal("issue_group_id")}, ("received_at", "request_id"), 500)
lineage_of = Read({"request_id": equal("request_id"), "source_event_id": equal("source_event_id")}, ("request_id",), 1)
windows = Read({"ward_code": _WARD, "sector": _SECTOR, "window_days": _DAYS, "district": _DISTRICT}, ("bucket", "ward_code", "sector"))
hotspots = Read({"tier": equal("tier", TIERS), "district": _DISTRICT, "window_days": _DAYS}, ("-mean_intensity", "cluster"), 50)
trends = Read({"direction": equal("direction", DIRECTIONS), "ward_code": _WARD, "sector": _SECTOR, "window_days": _DAYS}, ("-pct_change", "ward_code", "sector", "window_days"), 50)
risks = Read({"risk_type": equal("risk_type", RISK_TYPES), "severity": equal("severity", RISK_SEVERITIES), "status": equal("status", RISK_STATUSES), "ward_code": _WARD, "district": _DISTRICT}, (_by_severity, "-confidence", "risk_code"), 50)
priorities = Read({"district": any_case("district"), "band": equal("band", BANDS, fold=str.upper)}, ("rank",))
runs = Read({}, ("-started_at", "-run_id"), 20)
pending_events = Read({}, ("created_at", "event_id"), 100, lambda: F.col("status").isin("PENDING", "FAILED"))


def latest_gaps(snapshots: DataFrame, ward_code: str | None = None) -> DataFrame:
    """The newest snapshot of each ward and sector, by snapshot_at; of equal times the least by all columns."""
    rows = snapshots if not ward_code else snapshots.where(F.col("ward_code") == ward_code)
    return intel.latest(rows, ["ward_code", "sector"], "snapshot_at", ties=False)


def latest_projects(snapshots: DataFrame, limit: int | None = None, **given: Any) -> DataFrame:
    """Projects by their newest state, which alone is filtered: a project that left a ward is not found there."""
    read = Read({"ward_code": _WARD, "sector": _SECTOR, "district": _DISTRICT}, ("project_code",))
    return read(intel.latest(snapshots, ["project_code"], "snapshot_at", ties=False), limit, **given)


def trend_summary(found: DataFrame, sector: str | None = None, window_days: int | None = None, limit: int = 10) -> dict[str, DataFrame]:
    """Counts by sector and direction with the sum of slopes, the counts and mean slope of all, and the fastest growing of all sectors."""
    rows = found
    for name, value, rule in (("sector", sector, _SECTOR), ("window_days", window_days, _DAYS)):
        rows = rows.where(rule.of(name, value)) if value else rows
    counts = [F.count_if(F.col("direction") == d).alias(d.lower()) for d in DIRECTIONS]
    return {
        "sectors": rows.groupBy("sector").agg(*counts),
        "directions": rows.agg(*counts, F.round(F.coalesce(F.avg("slope"), F.lit(0.0)), 6).alias("mean_slope")),
        "emerging": trends(found, limit, direction="WORSENING", window_days=window_days),
    }


def risk_summary(found: DataFrame) -> DataFrame:
    """One row: all risks, open ones, those of each type and severity, and those of wards and sectors that several rules point at."""
    counts = [F.count_if(F.col(c) == v).alias(v.lower()) for c, values in (("risk_type", RISK_TYPES), ("severity", RISK_SEVERITIES)) for v in values]
    kinds = found.groupBy("ward_code", "sector").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "OPEN").alias("open"), F.count_distinct("risk_type").alias("kinds"), *counts)
    names = [c for c in kinds.columns if c not in ("ward_code", "sector", "kinds")]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]
    return kinds.agg(*sums, F.coalesce(F.sum(F.when(F.col("kinds") > 1, F.col("total"))), F.lit(0)).alias("confirmatory"))


def ward_brief(all_wards: DataFrame, all_demand: DataFrame, ward_code: str) -> DataFrame:
    """A ward's place, complaints and sectors in one row; none where the ward is not known."""
    own = F.col("ward_code") == ward_code
    return intel.ward_signals(all_wards.where(own), all_demand.where(own)).withColumn("sectors", F.coalesce(F.array_join(F.array_sort("sectors"), ","), F.lit("")))


def gap_run_summary(found: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """(one row of counts by severity and distinct sectors, the ``top`` worst gaps)."""
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MODERATE", "LOW")]
    return found.agg(F.count("*").alias("total"), *counts, F.count_distinct("sector").alias("sectors")), gaps(found, top)
