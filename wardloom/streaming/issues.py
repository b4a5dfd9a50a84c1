"""Issue groups of a stream: the state is three tables that each batch merges into."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.config import DedupConfig
from wardloom.operators.issues import STATE, group_issues, updated_states
from wardloom.sources.store import Store

REPORTS, ASSIGNED, GROUPS = "issue_reports", "issue_assigned", "issue_groups"


class IssueStream:
    """Takes batches of reports in any order of arrival and groups them in their order of time.

    A report waits until ``delay_hours`` after it have been seen, then meets the groups as its order of time has left them; so the result is that of ``group_issues`` over all reports, if none comes
    later than that. One that does is grouped with what stands when it comes. Replays of a report, and of a batch, change nothing. Groups that were not joined within the horizon are read no more.
    Use ``merge`` as the function of foreachBatch; the tables, not Spark's state, carry what is known, so a query can start anew from its checkpoint or without one.
    """

    def __init__(self, store: Store, delay_hours: float = 24.0, config: DedupConfig = DedupConfig()):
        self.store, self.delay_hours, self.config = store, delay_hours, config

    def merge(self, batch: DataFrame, number: int) -> None:
        self.store.merge(REPORTS, batch, ["report_id"], "issue_intake", number, "skip", ["at"])
        self._group(number, self.delay_hours)

    def finish(self) -> None:
        """Groups what still waits, at the end of a stream that has one."""
        self._group(self.store.snapshot().writers.get("issue_grouping", -1) + 1, 0.0)

    def _group(self, number: int, delay_hours: float) -> None:
        at = self.store.snapshot()
        if at.writers.get("issue_grouping", -1) >= number or REPORTS not in at:
            return
        reports = at.table(REPORTS)
        seen = reports.agg(F.max("at").alias("seen"))
        due = reports.join(F.broadcast(seen)).where(F.col("at") <= F.col("seen") - F.make_dt_interval(hours=F.lit(0), secs=F.lit(delay_hours * 3600).cast("decimal(18,6)"))).drop("seen")
        if ASSIGNED in at:
            due = due.join(at.table(ASSIGNED).select("report_id"), "report_id", "left_anti")
        due = due.checkpoint()
        groups = None
        if GROUPS in at:
            oldest = due.agg((F.min("at") - F.make_dt_interval(secs=F.lit(self.config.horizon_hours * 3600).cast("decimal(18,6)"))).alias("oldest"))
            groups = at.table(GROUPS).join(F.broadcast(oldest)).where(F.col("last") >= F.col("oldest")).drop("oldest").checkpoint()
        found = group_issues(due, self.config, groups).checkpoint()
        empty = due.sparkSession.createDataFrame([], "group_id string, category string, sub_category string, lat double, lon double, district string, state string, text string, last timestamp")
        now = updated_states(empty if groups is None else groups, found).select(*STATE)
        self.store.commit("issue_grouping", number, {ASSIGNED: (found.select("report_id", "group_id", "score"), ["report_id"]), GROUPS: (now, ["group_id"])}, at)
