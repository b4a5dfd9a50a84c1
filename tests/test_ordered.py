"""Running totals over ranges against totals worked out in order."""

import random

from pyspark.sql import functions as F

from wardloom.functions.ordered import running
from wardloom.operators import intel
from wardloom.sources.io import request_ids


def test_totals_over_several_ranges(spark):
    values = random.Random(3).sample(range(10_000), 500)
    rows = spark.createDataFrame([(k, k % 7) for k in values], "k long, v long").repartition(6)
    out = running(rows, [F.desc("k")], no=F.lit(1), total=F.col("v"))
    assert out.columns == ["k", "v", "no", "total"]
    total = 0
    for i, (row, k) in enumerate(zip(out.orderBy("no").collect(), sorted(values, reverse=True), strict=True)):
        total += k % 7
        assert (row["k"], row["no"], row["total"]) == (k, i + 1, total)


def test_ties_and_nulls_are_each_numbered(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")] * 5, "k long, v string")
    assert sorted(r["no"] for r in running(rows, ["k"], no=F.lit(1)).collect()) == list(range(1, 21))


def test_no_rows(spark):
    rows = spark.createDataFrame([], "k long")
    assert running(rows, ["k"], no=F.lit(1)).count() == 0


def test_request_ids_follow_the_order(spark):
    rows = spark.range(100).select((F.col("id") * 37 % 101).alias("at")).repartition(5)
    got = request_ids(rows, "at", 2026).orderBy("at").collect()
    assert [r["request_no"] for r in got] == [f"REQ-2026-{i:06d}" for i in range(1, 101)]


def test_ranks_of_hotspots_count_ties(spark):
    wards = spark.createDataFrame([(f"W{i}", "n", f"D{i}", "S", 10.0 + i, 78.0, 1000) for i in range(4)], "ward_code string, name string, district string, state string, latitude double, longitude double, population long")
    demand = spark.createDataFrame([(f"W{i}", "WATER", n, 3.0, 0) for i, n in enumerate((5, 5, 9, 2))], "ward_code string, sector string, complaint_count long, avg_severity double, critical_count long")
    got = {r["cluster"]: r["rank_fraction"] for r in intel.hotspots(wards, demand).collect()}
    assert got == {"W0": 0.75, "W1": 0.75, "W2": 1.0, "W3": 0.25}
