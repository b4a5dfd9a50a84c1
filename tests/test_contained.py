"""Stages that fail by row, and a stream that no line ends."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardloom.operators import intake, vocabulary
from wardloom.operators.contained import Stage, by_row, failure_counts, observed, run, unreadable
from wardloom.sources.store import Store
from wardloom.streaming.contained import ingest, keep_running, take_batch


def number():
    said = F.col("payload")["value"]
    return Stage("number", {"number": said.try_cast("double")}, unreadable(said, said.try_cast("double"), "no number"), {"number": -1.0})


def test_a_failed_stage_is_a_warning_and_later_ones_see_the_fallback(spark):
    safe = by_row(lambda x: 10 // x, T.LongType())
    stages = lambda: [
        Stage("parse", {"n": F.col("t").try_cast("long")}, unreadable("t", F.col("t").try_cast("long"), "no number"), {"n": 0}),
        Stage("divide", {"d": F.col("__d.value")}, F.col("__d.error"), {"d": -1}),
        Stage("double", {"twice": F.col("d") * 2}, F.lit(None), {}, ("parse",)),
    ]
    rows = spark.createDataFrame([(1, "5"), (2, "x"), (3, None), (4, "0"), (5, ""), (5, "")], "k int, t string").withColumn("__d", safe(F.coalesce(F.col("t").try_cast("long"), F.lit(1))))
    got = [(r["k"], r["n"], r["d"], r["twice"], [w["stage"] for w in r["warnings"]]) for r in run(rows, stages()).orderBy("k").collect()]
    assert got == [(1, 5, 2, 4, []), (2, 0, 10, None, ["parse", "double"]), (3, None, 10, 20, []), (4, 0, -1, -2, ["divide"]), (5, None, 10, 20, []), (5, None, 10, 20, [])]
    assert {r["stage"]: (r["failed"], r["message"]) for r in failure_counts(run(rows, stages())).collect()} == {"parse": (1, "no number: x"), "divide": (1, "ZeroDivisionError: integer division or modulo by zero"), "double": (1, "a stage before it failed")}
    kept, seen = observed(run(rows, stages()), stages())
    kept.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 6, "clean": 4, "parse": 1, "divide": 1, "double": 1}
    assert run(rows.where("false"), stages()).count() == 0
    with pytest.raises(ValueError):
        run(rows, stages()[2:])


def test_no_text_ends_a_job(spark):
    """Any characters in every field of an intake, under ANSI."""
    rng = random.Random(3)
    alphabet = "0159.,-+:/TZ {}[]\"'\\$%_aé\u0000\n\u200d\u0660😀नே"
    odd = ["", " ", "NaN", "Infinity", "-inf", "1e999", "9" * 400, "2024-02-30", "24:61", '{"latitude": {"a": 1}}', '{"latitude": 1e400}', "null", "[]", "99999-01-01T00:00:00Z", "-9223372036854775809", "1" * 13]
    any_text = lambda: rng.choice((None, rng.choice(odd), "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 12)))))
    names = ["request_id", "language", "category", "sub_category", "severity", "created_at", "latitude", "longitude", "location", "place", "description"]
    rows = spark.createDataFrame([(i, *(any_text() for _ in names)) for i in range(3000)], "row_key long, " + ", ".join(f"{n} string" for n in names))
    cleaned = intake.clean(rows, F.to_timestamp(F.lit("2024-06-01")), "row_key")
    assert vocabulary.normalize(cleaned).select(F.xxhash64("*").alias("h")).where("h is not null").count() == 3000


LINES = ['{"event_id":"1","request_id":"a","event_type":"t","payload":{"value":"1.5"}}', '{"event_id":"2","request_id":"a","event_type":"t","payload":{"value":"2"}}', '{"event_id":"3","correlation_id":"b","event_type":"t","payload":{"value":"x"}}',
         '{"event_id":"4","request_id":"c","event_type":"other"}', '{"event_id":"5","event_type":"t"}', '{"event_id": "6", "requ', "", "[1]", '{"event_id":"7","payload":{"request_id":" d "},"event_type":"t"}']


def counters(store):
    return [tuple(r)[1:] for r in store.snapshot().table("records_counters").orderBy("batch").collect()]


def test_lines_of_a_stream_are_all_accounted_for(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for i, part in enumerate((LINES, LINES[:3])):
        spark.createDataFrame([(x,) for x in part], "value string").coalesce(1).write.mode("append").text(str(tmp_path / "lines"))
        ingest(spark.readStream.text(str(tmp_path / "lines")), store, [number()], str(tmp_path / "check"), ("t",)).awaitTermination()
    assert counters(store) == [(9, 3, 1, 1, 4, 1, "no object"), (3, 0, 3, 0, 0, 0, None)]
    got = {r["request_key"]: (r["number"], len(r["warnings"])) for r in store.snapshot().table("records").collect()}
    assert got == {"a": (1.5, 0), "b": (-1.0, 1), "d": (None, 0)}
    assert sorted(r["reason"] for r in store.snapshot().table("records_errors").collect()) == ["empty line", "no key", "no object", "no object"]


def test_a_driver_lost_between_commits_goes_on(spark, tmp_path):
    """Each further commit of a batch is reached only after the ones before it; the query is started again."""
    home = str(tmp_path / "store")
    spark.createDataFrame([(x,) for x in LINES], "value string").write.text(str(tmp_path / "lines"))
    left = [0, 1, 1]  # commits that succeed before each failure

    class Failing(Store):
        def commit(self, *args, **kwargs):
            if self.most == 0:
                raise OSError("lost")
            self.most -= 1
            return super().commit(*args, **kwargs)

    def start():
        store = Failing(spark, home)
        store.most = left.pop(0) if left else 99
        return ingest(spark.readStream.text(str(tmp_path / "lines")), store, [number()], str(tmp_path / "check"), ("t",))

    assert keep_running(start, 0.1) == 3
    store = Store(spark, home)
    assert counters(store) == [(9, 3, 1, 1, 4, 1, "no object")]
    assert store.snapshot().table("records").count() == 3 and store.snapshot().table("records_errors").count() == 4
    take_batch(spark.createDataFrame([(x,) for x in LINES], "value string"), 0, store, [number()], wanted=("t",))
    assert counters(store) == [(9, 3, 1, 1, 4, 1, "no object")]


def test_a_failure_that_stays_is_raised(spark, tmp_path):
    spark.createDataFrame([("x",)], "value string").write.text(str(tmp_path / "lines"))

    def start():
        def fail(batch, n):
            raise OSError("down")

        return spark.readStream.text(str(tmp_path / "lines")).writeStream.foreachBatch(fail).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()

    with pytest.raises(StreamingQueryException):
        keep_running(start, 0.0, 1)
