import datetime as dt
import random

from pyspark.sql import functions as F

from lociforge.operators import orphans


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


PARENTS = "seq_id string, received_at timestamp, removed_at timestamp, word int, bits int"
REFS = "row_no long, a string, b string, t timestamp, seq_id int"


def dangling(spark, refs, parents, **options):
    own = orphans.references(spark.createDataFrame(refs, REFS), "t", "row_no", ["a", "b"], "t")
    found = orphans.orphans(own, spark.createDataFrame(parents, PARENTS), **options)
    return {(r["row_no"], r["seq_id"]) for r in found.collect()}


def test_times(spark):
    parents = [("A", day(1), day(5), 0, 0), ("A", day(10), None, 0, 0), (" b-1", day(2), None, 0, 0), ("C", None, None, 0, 0), (None, day(1), None, 0, 0)]
    refs = [
        (1, "a", None, day(0), 0), (2, "A ", "A", day(1), 0), (3, "A", "", day(5), 0), (4, "A", None, day(11), 0), (5, "B_1", "Z", day(3), 0), (6, "A", "Z", None, 0), (7, "C", None, day(3), 0), (8, "C", None, None, 0), (9, None, "\t ", day(1), 0),
    ]
    want = {(1, "A"), (3, "A"), (5, "Z"), (6, "Z"), (7, "C")}
    assert dangling(spark, refs, parents) == want
    assert dangling(spark, refs + refs, parents + parents, max_broadcast=0) == want  # a filter spread over the cluster


def test_against_brute_force_with_a_hot_id(spark):
    rng = random.Random(3)
    ids = [f"S{i}" for i in range(60)] + ["HOT"] * 30
    parents = [(rng.choice(ids), day(rng.randrange(40)), rng.choice([None, day(rng.randrange(20, 80))]), 0, 0) for _ in range(150)]
    refs = [(i, rng.choice(ids), rng.choice([*ids, None]), rng.choice([None, day(rng.randrange(90))]), 0) for i in range(400)]
    want = set()
    for no, a, b, t, _ in refs:
        for x in {a, b} - {None}:
            if not any(p == x and (t is None or (f <= t and (to is None or to > t))) for p, f, to, _, _ in parents):
                want.add((no, x))
    assert dangling(spark, refs, parents) == want


def test_what_the_filter_proves_does_not_fall_with_the_keys(spark):
    for n in (200, 2000):
        parents = spark.range(n).select(F.format_string("S%d", "id").alias("seq_id"), F.lit(day(1)).alias("received_at"), F.lit(None).cast("timestamp").alias("removed_at"))
        refs = spark.range(1000).select(F.lit("t").alias("ref_table"), F.col("id").alias("row_no"), F.format_string("X%d", "id").alias("seq_id"), F.lit(day(2)).cast("timestamp_ntz").alias("at"))
        for max_broadcast in (0, 1 << 20):
            found = orphans.orphans(refs, parents, max_broadcast)
            assert found.count() == 1000 and found.filter("definite").count() >= 970


def test_empty_and_report(spark):
    assert dangling(spark, [], []) == set()
    assert dangling(spark, [(1, "A", None, day(1), 0)], []) == {(1, "A")}
    own = orphans.references(spark.createDataFrame([(1, "A", "B", day(1), 0), (2, "A", None, None, 0)], REFS), "t", "row_no", ["a", "b"], "t")
    report = orphans.orphan_report(orphans.orphans(own, spark.createDataFrame([], PARENTS)))
    assert {tuple(r) for r in report.collect()} == {("t", "2024-01", 2, 2, 2), ("t", "unknown", 1, 1, 1)}
