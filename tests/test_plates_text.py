import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripwise.functions import plates, text

NORMALIZED = [
    ("AB1234CD", "AB1234CD"),
    ("A81234CD", "AB1234CD"),
    ("ABI2S4CD", "AB1254CD"),
    ("AB1034CD", "AB1034CD"),
    ("A1C", None),
    ("###***", None),
    ("о793рр", "O793PP"),
    ("О793РР123", "O793PP"),
    ("BE 8624", "BE8624"),
    ("A123BC", "A123BC"),
    ("", None),
    (None, None),
    ("Р138ЕН58", "P138EH"),
]


def test_plate_normalize(spark):
    df = spark.createDataFrame(NORMALIZED, "raw string, want string")
    bad = df.withColumn("got", plates.normalize(F.col("raw"))).filter("NOT got <=> want").collect()
    assert bad == []


@pytest.mark.parametrize(("raw", "want"), [("О793РР123", "O793PP123"), ("О793РР12", "O793PP12"), ("О793РР1", "O793PP")])
def test_plate_region(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(plates.normalize(F.col("raw"), include_region=True)).first()[0] == want


def by_slots(raw: str) -> str | None:
    """The three shapes tried slot by slot at every place."""
    t = raw.upper().translate(str.maketrans(plates.CYRILLIC, plates.LATIN))
    t = "".join(c for c in t if c.isalnum())
    head = dict(zip("015248", "OISZAB", strict=True))
    digit = {**{c: c for c in "0123456789"}, **dict(zip("OISZBEA", "0152864", strict=True))}
    ru_digit = digit | {"A": "1"}
    az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    letter = lambda fix, keep: {**{c: c for c in keep}, **fix}
    twelve = plates.LATIN
    shapes = [
        [letter(head, az)] * 2 + [digit] * 4 + [letter(head | {"8": "A"}, az), letter(head | {"8": "O"}, az)],
        [letter({"0": "O", "8": "B"}, twelve)] + [ru_digit] * 3 + [letter({"0": "O", "8": "B"}, twelve)] * 2,
        [letter({"0": "O", "4": "A", "8": "B"}, twelve)] * 2 + [digit] * 4,
    ]
    for slots in shapes:
        for i in range(len(t) - len(slots) + 1):
            got = [s.get(c) for s, c in zip(slots, t[i:], strict=False)]
            if all(got):
                return "".join(got)
    return None


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("ABEKXOISZ0123456789 -ов", max_size=12), min_size=20, max_size=60))
def test_plate_normalize_against_slots(spark, raws):
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    for raw, got in df.select("raw", plates.normalize(F.col("raw"))).collect():
        assert got == by_slots(raw), raw


def test_loose_equal(spark):
    rows = [("AB1234OH", "AB1234HO", True), ("AB12", "AB12", True), ("AB1H", "AB1O", False), ("AB1234OH", "XB1234OH", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.filter(plates.loose_equal(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_clock_mask_and_ids(spark):
    clocks = [(0, "00:00:00.000"), (999, "00:00:00.999"), (3_600_000, "01:00:00.000"), (360_000_000, "100:00:00.000")]
    df = spark.createDataFrame(clocks, "ms long, want string")
    assert df.filter(text.fmt_ms(F.col("ms")) != F.col("want")).count() == 0
    urls = [("rtsp://u:p@h/x", "rtsp://*****@h/x"), ("rtsp://u@h/x", "rtsp://u@h/x"), ("http://h/x", "http://h/x"), ("a@b://x", "a@b://x"), (None, "")]
    df = spark.createDataFrame(urls, "url string, want string")
    assert df.filter(text.mask_url(F.col("url")) != F.col("want")).count() == 0
    rows = [None, "", "no hash here", "## two hashes", "# not-a-number | x", "#123", "prefix #123", "#42 | 3 ev", "#-7 x"]
    df = spark.createDataFrame([(r,) for r in rows], "r string")
    assert [x[0] for x in df.select(text.parse_detection_id(F.col("r"))).collect()] == [None] * 7 + [42, -7]


def test_detection_row(spark):
    df = spark.sql("SELECT 42 id, 3 n, 5000 m, timestamp'2025-01-02 03:04:05' ts, timestamp'2025-01-02 03:04:00' t0, '/v.mp4' p")
    c = lambda x: F.col(x).cast("string")
    row = lambda ts: text.detection_row(c("id"), c("n"), c("m"), F.col(ts), F.col("p"))
    got = df.select(row("ts"), row("t0"), text.parse_detection_id(row("ts"))).first()
    assert got[0] == "#42 | 3 ev | merge=5000 | 2025-01-02 03:04:05 | /v.mp4"
    assert got[1] == "#42 | 3 ev | merge=5000 | 2025-01-02 03:04 | /v.mp4"
    assert got[2] == 42


def test_backoff_lists_and_paths(spark):
    df = spark.createDataFrame([(n,) for n in range(1, 6)], "n int")
    assert [r[0] for r in df.select(text.backoff_ms(F.col("n"))).collect()] == [500, 1000, 2000, None, None]
    one = spark.range(1).select(
        text.int_list(F.lit("0, -4,x,4")), text.base_name(F.lit("/a/b.c.mp4")), text.plate_label(F.lit(" ")), text.fold_lines(F.lit("a\nb\r")), text.quoted(F.lit('a"b'))
    )
    assert list(one.first()) == [[0, -4, 4], "b.c", "undefined", "a b", '"a""b"']


def test_clean_token(spark):
    rows = [("ab-12", "AB12"), ("12", None), ("abc", None), ("Ж1Д2", "Ж1Д2"), ("zz9", "ZZ9"), (None, None)]
    df = spark.createDataFrame(rows, "raw string, want string")
    assert df.filter(~plates.clean_token(F.col("raw")).eqNullSafe(F.col("want"))).count() == 0
    assert re.match("^A", plates.LATIN)
