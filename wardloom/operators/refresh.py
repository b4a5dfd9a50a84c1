"""Analysis done again after the tables changed: only wards whose rows changed, and clusters that they touch, are worked out anew.

Results lie in the keyed tables of a store. A ward's newest analysis has a number, and its results are those that bear it; so results that a later analysis does not find again
stop to stand without being deleted. Everything of one refresh is one commit.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.config import IntelConfig
from wardloom.functions.grid import within
from wardloom.functions.ordered import checkpoint_dir
from wardloom.operators import intel
from wardloom.operators.mesh import elapsed
from wardloom.sources.store import Snapshot, Store

#: The tables that are analysed, with the columns that count.
INPUTS = {
    "wards": "ward_code string, name string, district string, state string, latitude double, longitude double, population long",
    "citizen_demand": "ward_code string, sector string, category string, window_days int, complaint_count long, critical_count long, avg_severity double",
    "demand_windows": "ward_code string, sector string, window_days int, bucket int, complaint_count long, critical_count long, avg_severity double",
    "gaps": "ward_code string, sector string, gap_score double, severity string",
    "projects": "project_code string, ward_code string, sector string, status string, title string, budget_lakhs double, spent_lakhs double, sanctioned_on date, planned_days int, delay_days int",
}
WRITER = "refresh"
#: Up to so many changed wards are sent to all tasks; more are joined by a shuffle.
BROADCAST_WARDS = 200_000
RUN = "run_id long, status string, trigger string, started_at timestamp, finished_at timestamp, wards long, changed_wards long, changed_clusters long, error string"


def inputs(tables: dict[str, DataFrame], spark: SparkSession) -> dict[str, DataFrame]:
    """The tables with the columns that count. Absent tables are empty, rows without a ward are left out, and of several rows of one ward the least by all columns is the ward."""
    out = {}
    for name, schema in INPUTS.items():
        columns = [c.split()[0] for c in schema.split(", ")]
        out[name] = (tables[name].select(*columns) if name in tables else spark.createDataFrame([], schema)).where("ward_code is not null")
    rest = [c for c in out["wards"].columns if c != "ward_code"]
    out["wards"] = out["wards"].groupBy("ward_code").agg(F.min(F.struct(*rest)).alias("w")).select("ward_code", "w.*")
    return out


def digests(tables: dict[str, DataFrame], as_of: dt.date, config: IntelConfig) -> DataFrame:
    """(ward_code, digest): 128 bits of a ward's rows in all tables, in any order, and their number.

    The day counts only by the projects that it makes late, and every tunable counts. One shuffle of pre-aggregated rows.
    """
    parts = None
    for name, t in tables.items():
        late = [(elapsed(as_of, missing=0.0) >= config.stall_elapsed)] if name == "projects" else []
        fields = [x for c in (*t.columns, *late) for x in ((F.col(c) if isinstance(c, str) else c), (F.col(c) if isinstance(c, str) else c).isNull())]
        hashed = [F.xxhash64(F.lit(i), F.lit(name), F.lit(repr(config)), *fields).cast("decimal(20,0)").alias(f"h{i}") for i in (0, 1)]
        rows = t.select("ward_code", *hashed)
        parts = rows if parts is None else parts.unionByName(rows)
    sums = parts.groupBy("ward_code").agg(F.sum("h0").alias("a"), F.sum("h1").alias("b"), F.count("*").alias("n"))
    return sums.select("ward_code", F.concat_ws(":", "a", "b", "n").alias("digest"))


def standing(at: Snapshot, name: str) -> DataFrame:
    """The rows of ``signals``, ``trends`` or ``risks`` that the newest analysis of their ward found."""
    newest = at.table("ward_inputs").where("stands").select("ward_code", "run")
    return at.table(name).join(newest, ["ward_code", "run"], "left_semi").drop("run")


def hotspots(at: Snapshot) -> DataFrame:
    """The hotspots that stand, ranked against each other and all wards."""
    return intel.tiers(at.table("cluster_sums").where("stands").drop("stands"), standing(at, "signals"))


def members(at: Snapshot) -> DataFrame:
    """(cluster, ward_code) of all wards."""
    return at.table("clusters").where("stands").select("cluster", "ward_code")


def risks(at: Snapshot) -> DataFrame:
    """The risks that stand with the status that was set, OPEN where none was."""
    found = standing(at, "risks")
    if "risk_status" not in at:
        return found.withColumn("status", F.lit("OPEN"))
    return found.join(at.table("risk_status"), "risk_code", "left").withColumn("status", F.coalesce("status", F.lit("OPEN")))


def set_risk_status(store: Store, risk_code: str, status: str) -> bool:
    """Sets the status of a risk that stands, for as long as its code is found; tells whether there is one."""
    if status not in ("OPEN", "ACKNOWLEDGED", "DISMISSED", "RESOLVED"):
        raise ValueError(f"unknown status: {status}")
    at = store.snapshot()
    if "risks" not in at or standing(at, "risks").where(F.col("risk_code") == risk_code).isEmpty():
        return False
    row = store.spark.createDataFrame([(risk_code, status)], "risk_code string, status string")
    store.commit("risk_status", at.writers.get("risk_status", -1) + 1, {"risk_status": (row, ["risk_code"])}, at)
    return True


def refresh(store: Store, tables: dict[str, DataFrame], as_of: dt.date, config: IntelConfig = intel.CONFIG, trigger: str = "api") -> DataFrame:
    """Brings the results in the store up to the tables, and gives the row of this run.

    The result is that of an analysis of everything: trends and risks follow from a ward's own rows, clusters from places around those that moved, came or went, and ranks are
    taken over the clusters' sums each time they are read. Equal tables change nothing but the runs. A run that fails is kept with its error and changes no result; one that was
    killed is named FAILED by the next. Of two at the same time one ends in a ConflictError. Tables may be absent or empty.
    """
    before = store.snapshot()
    run = (before.writers.get(WRITER, -1) + 2) // 2
    started = dt.datetime.now(dt.timezone.utc)

    def row(status: str, counts: tuple = (None, None, None), error: str | None = None) -> DataFrame:
        finished = None if status == "RUNNING" else dt.datetime.now(dt.timezone.utc)
        return store.spark.createDataFrame([(run, status, trigger, started, finished, *counts, error)], RUN)

    opened = row("RUNNING")
    if "runs" in before:
        lost = before.table("runs").where("status = 'RUNNING'").withColumns({"status": F.lit("FAILED"), "error": F.lit("ended without a result")})
        opened = opened.unionByName(lost)
    base = store.commit(WRITER, 2 * run, {"runs": (opened, ["run_id"])}, before)
    try:
        changes, counts = _changes(base, inputs(tables, store.spark), as_of, config, run)
        made = store.commit(WRITER, 2 * run + 1, changes | {"runs": (row("OK", counts), ["run_id"])}, base)
    except Exception as e:
        store.commit(WRITER, 2 * run + 1, {"runs": (row("FAILED", error=f"{type(e).__name__}: {e}"[:2000]), ["run_id"])})
        raise
    return made.table("runs").where(F.col("run_id") == run)


def _changes(base: Snapshot, t: dict[str, DataFrame], as_of: dt.date, config: IntelConfig, run: int) -> tuple[dict, tuple[int, int, int]]:
    """The rows to be committed, and the numbers of wards, changed wards and changed clusters."""
    spark, known = base.spark, "ward_inputs" in base
    checkpoint_dir(spark)
    new = digests(t, as_of, config).checkpoint()
    old = base.table("ward_inputs").where("stands").select("ward_code", F.col("digest").alias("was")) if known else spark.createDataFrame([], "ward_code string, was string")
    changed = new.join(old, "ward_code", "full_outer").where(~F.col("digest").eqNullSafe(F.col("was"))).select("ward_code", "digest", F.col("digest").isNotNull().alias("stands")).checkpoint()
    n, total = changed.count(), new.count()
    if n == 0:
        return {}, (total, 0, 0)
    small = F.broadcast if n <= BROADCAST_WARDS else (lambda df: df)
    hit = changed.where("stands").select("ward_code")
    own = {name: rows.join(small(hit), "ward_code", "left_semi") for name, rows in t.items()}
    number = F.lit(run).cast("long").alias("run")
    signals = intel.ward_signals(own["wards"], own["citizen_demand"]).checkpoint()
    out = {
        "ward_inputs": (changed.select("ward_code", "digest", number, "stands"), ["ward_code"]),
        "signals": (signals.select("*", number), ["ward_code"]),
        "trends": (intel.trends(own["demand_windows"], config).select("*", number), ["ward_code", "sector", "window_days"]),
        "risks": (intel.risks(own["demand_windows"], own["projects"], own["gaps"], as_of, config).select("*", number), ["risk_code"]),
    }

    # clusters: those of wards that moved, came or went, and those that such wards are near to now, are formed again
    place = ("latitude", "longitude")
    had = base.table("clusters").where("stands").drop("stands") if known else spark.createDataFrame([], "ward_code string, cluster string, latitude double, longitude double")
    now = own["wards"].select("ward_code", *[F.col(c).alias(f"to_{c}") for c in place], F.lit(True).alias("here"))
    at = changed.select("ward_code").join(had.withColumn("was_here", F.lit(True)), "ward_code", "left").join(now, "ward_code", "left")
    stays = F.col("here").eqNullSafe(F.col("was_here"))
    for c in place:
        stays = stays & F.col(c).eqNullSafe(F.col(f"to_{c}"))
    moved = at.where(~stays).select("ward_code", "cluster", "here", *[f"to_{c}" for c in place]).checkpoint()
    if moved.isEmpty():
        torn, whole = moved.select("cluster"), had.select("ward_code", "cluster")
    else:
        put = moved.where("here").select(F.col("ward_code").alias("moved"), *[f"to_{c}" for c in place])
        near = within(put.drop("moved").distinct(), had.select("cluster", *place).distinct(), ("to_latitude", "to_longitude"), place, config.radius_m).select("cluster")
        torn = near.unionByName(moved.where("cluster is not null").select("cluster")).distinct()
        rest = had.join(torn, "cluster", "left_semi").join(moved.select("ward_code"), "ward_code", "left_anti").select("ward_code", *place)
        region = rest.unionByName(put.select(F.col("moved").alias("ward_code"), *[F.col(f"to_{c}").alias(c) for c in place])).checkpoint()
        again = region.join(intel.near_clusters(region, config.radius_m), "ward_code").select("ward_code", "cluster", *place)
        gone = moved.where("here is null and cluster is not null").select("ward_code", "cluster", *[F.lit(None).cast("double").alias(c) for c in place], F.lit(False).alias("stands"))
        delta = again.withColumn("stands", F.lit(True)).unionByName(gone)
        torn = torn.unionByName(again.select("cluster"))
        whole = had.join(delta.select("ward_code"), "ward_code", "left_anti").select("ward_code", "cluster").unionByName(again.select("ward_code", "cluster"))
        out["clusters"] = (delta, ["ward_code"])
    own_clusters = whole.join(small(changed.select("ward_code")), "ward_code", "left_semi").select("cluster")
    touched = torn.unionByName(own_clusters).distinct().checkpoint()
    kept = standing(base, "signals").join(small(changed.select("ward_code")), "ward_code", "left_anti") if known else signals.where("false")
    rows = kept.unionByName(signals).join(whole.join(touched, "cluster", "left_semi"), "ward_code")
    sums = intel.cluster_sums(rows)
    names = [c for c in sums.columns if c != "cluster"]
    buried = touched.join(whole.select("cluster"), "cluster", "left_anti").select("cluster", *[F.lit(None).cast(sums.schema[c].dataType).alias(c) for c in names], F.lit(False).alias("stands"))
    out["cluster_sums"] = (sums.withColumn("stands", F.lit(True)).unionByName(buried), ["cluster"])
    return out, (total, n, touched.count())
