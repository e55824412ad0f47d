import random

import pytest
from pyspark.sql import functions as F

from tripwise.config import OcrParams
from tripwise.operators import ocr


def counting(folder):
    """A backend that reads a picture's bytes as text and leaves a file in a folder for each call."""
    at = str(folder)

    class Counting:
        def words(self, png):
            import uuid

            with open(f"{at}/{uuid.uuid4().hex}", "w") as f:
                f.write("1")
            return [(png.decode(), 90.0)]

    return Counting()


@pytest.mark.parametrize(("seed", "budget", "first"), [(1, 1000, 1), (2, 9, 2)])
def test_rounds_find_the_same_plates_with_fewer_calls(spark, tmp_path, seed, budget, first):
    rng = random.Random(seed)
    rows = []
    for event in range(25):
        texts = ["A123BC", "A123BC77", "B777OO", "junk", "", "  "] if event % 3 else ["junk", ""]
        for offset in range(rng.randrange(1, 4)):
            rows += [(event, offset, roi, rng.choice(texts).encode()) for roi in range(rng.randrange(0, 14))]
    regions = spark.createDataFrame(rows, "event long, offset_ord int, roi_idx int, png binary")
    p = OcrParams(max_calls=budget, max_roi=12, stop_votes_min_len=6)
    found, tokens = ocr.read_in_rounds(regions, counting(tmp_path), p, first)
    got = {r.event: (r.plate, r.calls) for r in found.collect()}
    assert len(list(tmp_path.iterdir())) == sum(n for _, n in got.values()) == tokens.count()  # no region is read twice
    every = ocr.within_budget(regions.filter("roi_idx < 12"), "event", p).withColumn("raw", F.decode("png", "UTF-8"))
    best = ocr.best_plates(every.withColumn("at", F.struct("event", "offset_ord")), "at", p).select("at.*", "plate")
    want = {r.event: r.plate for r in ocr.first_offset_plates(best, "event").collect()}
    assert {e: plate for e, (plate, _) in got.items()} == want
    full = {r.event: r["count"] for r in every.groupBy("event").count().collect()}
    assert all(n <= full[e] for e, (_, n) in got.items()) and max(n for _, n in got.values()) <= budget
    assert all(got[e][1] == full[e] for e in got if want[e] is None)  # undecided events are read to their end
    assert sum(n for e, (_, n) in got.items() if want[e]) < 0.8 * sum(full[e] for e in got if want[e])


def test_nothing_to_read(spark, tmp_path):
    none = spark.createDataFrame([], "event long, offset_ord int, roi_idx int, png binary")
    assert ocr.read_in_rounds(none, counting(tmp_path), OcrParams())[0].count() == 0
