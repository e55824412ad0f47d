import random

import pytest
from pyspark.sql import functions as F

from tripwise.operators import sequence, stretches


def events(spark, rows):
    return spark.createDataFrame([(1, t, p) for t, p in rows], "detection_id long, t_ms long, plate string")


def times(df):
    return [r["t_ms"] for r in df.orderBy("t_ms").collect()]


def fold(spark, rows, f):
    keyed = sequence.sorted_events(events(spark, rows), "detection_id")
    return sequence.exploded(keyed.withColumn("events", f(F.col("events"))), "detection_id")


def test_suppression_and_merge_differ(spark):
    rows = [(0, None), (2400, None), (2600, None)]
    assert times(fold(spark, rows, lambda e: sequence.suppressed(e, 700))) == [0, 2400]
    assert times(fold(spark, rows, lambda e: sequence.merged(sequence.suppressed(e, 700), 2500))) == [0]
    assert times(fold(spark, rows, lambda e: sequence.merged(e, 2500))) == [0, 2600]


def test_suppression_is_anchored(spark):
    rows = [(t, None) for t in (0, 500, 900, 1200, 1700, 3000)]
    assert times(fold(spark, rows, lambda e: sequence.suppressed(e, 700))) == [0, 900, 1700, 3000]
    assert times(fold(spark, [(0, None), (700, None), (701, None)], lambda e: sequence.suppressed(e, 700))) == [0, 701]


def test_merge_fills_the_head(spark):
    rows = [(0, None), (1000, " "), (2000, "P1"), (2400, "P2")]
    got = fold(spark, rows, lambda e: sequence.merged(e, 2500)).collect()
    assert [(r.t_ms, r.plate) for r in got] == [(0, "P1")]


TRIPS = [
    ([], []),
    ([(1000, "ABC123"), (20000, "ABC123"), (40000, "ABC123")], [("ABC123", 0, 2, 1000, 40000, 3)]),
    ([(1000, "A111AA"), (10000, "A111AA"), (210000, "A111AA"), (215000, "A111AA")], [("A111AA", 0, 1, 1000, 10000, 2), ("A111AA", 2, 3, 210000, 215000, 2)]),
    ([(1000, "A111AA"), (2000, "B222BB"), (3000, "C333CC")], [(None, 0, 2, 1000, 3000, 3)]),
    ([(1000, "A111AA"), (2000, "B222BB"), (3000, "A111AA")], [("A111AA", 0, 2, 1000, 3000, 3)]),
    ([(1000, "null"), (2000, " "), (3000, "A111AA"), (4000, "A111AA")], [("A111AA", 0, 3, 1000, 4000, 4)]),
    ([(1000, None), (2000, None), (3000, None)], [(None, 0, 2, 1000, 3000, 3)]),
    ([(0, "B"), (1, "B"), (2, "A"), (3, "A")], [("A", 0, 3, 0, 3, 4)]),
    ([(0, None), (60000, None)], [(None, 0, 1, 0, 60000, 2)]),
    ([(0, None), (60001, None)], [(None, 0, 0, 0, 0, 1), (None, 1, 1, 60001, 60001, 1)]),
]


@pytest.mark.parametrize(("rows", "want"), TRIPS)
def test_trips(spark, rows, want):
    got = sequence.trips(events(spark, rows), "detection_id").orderBy("trip").collect()
    assert [(r.plate, r.from_index, r.to_index, r.t_start_ms, r.t_end_ms, r.events_count) for r in got] == want


def test_parallel_lists_must_agree(spark):
    df = spark.createDataFrame([([1000, 2000, 3000], ["A111AA"])], "t array<long>, p array<string>")
    with pytest.raises(Exception, match="differ in length"):
        df.select(sequence.zipped(F.col("t"), F.col("p"))).collect()
    df = spark.createDataFrame([([1000, 2000], None)], "t array<long>, p array<string>")
    assert [tuple(e) for e in df.select(sequence.zipped(F.col("t"), F.col("p"))).first()[0]] == [(1000, None), (2000, None)]


def test_folds_against_loops(spark):
    rng = random.Random(5)
    rows = [(t, rng.choice([None, " ", "P1", "P2"])) for t in sorted(rng.sample(range(60_000), 80))]
    kept = []
    for t, p in rows:
        if not kept or t - kept[-1][0] > 1500:
            kept.append([t, p])
        elif not (kept[-1][1] or "").strip() and (p or "").strip():
            kept[-1][1] = p
    got = fold(spark, rows, lambda e: sequence.merged(e, 1500)).orderBy("t_ms").collect()
    assert [[r.t_ms, r.plate] for r in got] == kept


def plain_anchored(rows, window):
    kept, last = [], None
    for t, p in rows:
        if last is None or t - last > window:
            kept.append((t, p))
            last = t
    return kept


def plain_merged(rows, window):
    heads = []
    for t, p in rows:
        if not heads or t - heads[-1][0] > window:
            heads.append([t, p])
        elif not (heads[-1][1] or "").strip() and (p or "").strip():
            heads[-1][1] = p
    return [tuple(h) for h in heads]


@pytest.mark.parametrize(("size", "window"), [(33, 0), (4, 5), (7, 60)])
def test_keys_in_stretches_give_the_same_rows(spark, monkeypatch, size, window):
    rng = random.Random(size * 100 + window)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.randrange(900), rng.choice([None, " ", "A", "B"])) for _ in range(700)] + [(3, 5, "A")]
    df = spark.createDataFrame(rows, "detection_id long, t_ms long, plate string")
    by = {}
    for k, t, p in sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or "")):
        by.setdefault(k, []).append((t, p))
    kept = sorted(((k, *e) for k, es in by.items() for e in plain_anchored(es, window)), key=str)
    merged = sorted(((k, *e) for k, es in by.items() for e in plain_merged(plain_anchored(es, window), 3 * window)), key=str)
    monkeypatch.setattr(stretches, "SIZE", size)
    for listed in (50, 10**6):
        monkeypatch.setattr(sequence, "LISTED", listed)
        assert sorted([tuple(r) for r in sequence.suppress(df, "detection_id", window).collect()], key=str) == kept
        assert sorted([tuple(r) for r in sequence.merge(df, "detection_id", window, 3 * window).collect()], key=str) == merged


def test_a_key_of_a_million_events(spark):
    """One key far beyond a list: every seventh time is kept, the first plate of each group fills its head."""
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("detection_id"), F.col("id").alias("t_ms"), F.when(F.col("id") % 49 == 14, F.lit("P")).alias("plate"))
    kept = sequence.suppress(df, "detection_id", 6)
    assert kept.agg(F.count(F.lit(1)), F.max(F.col("t_ms") % 7), F.countDistinct("t_ms")).first()[:] == ((n + 6) // 7, 0, (n + 6) // 7)
    heads = sequence.merge(df, "detection_id", 6, 42)
    assert heads.agg(F.count(F.lit(1)), F.max(F.col("t_ms") % 49), F.count_if(F.col("plate") == "P")).first()[:2] == ((n + 48) // 49, 0)
    assert heads.filter("plate IS NULL").count() <= 1


def test_folds_name_their_input_once(spark):
    """Merging over suppression grows with the list, not with its square."""
    import time

    def took(n):
        df = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 10).alias("t_ms"), F.lit(None).cast("string").alias("plate"))
        keyed = sequence.sorted_events(df, "k")
        began = time.time()
        assert sequence.exploded(keyed.withColumn("events", sequence.merged(sequence.suppressed(F.col("events"), 15), 25)), "k").count() > 0
        return time.time() - began

    took(1000)
    assert took(32_000) < 5 * took(8000) + 1
