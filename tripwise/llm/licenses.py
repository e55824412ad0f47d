"""License scanning: MinHash bands over overlapping text windows, then exact containment.

Templates and texts are sequences of word shingles of K words (five, or all words of a
shorter template). Windows of V shingles are cut from texts at half their length and from
templates at every place, so a verbatim copy always has a text window that equals a template
window; such a pair shares all BANDS one-row bands. A window that still has a share J of its
shingles in common shares a band with probability 1 - (1 - J) ** BANDS: 0.998 at 0.8. A band
keeps the place of its least shingle, so a hit says where in the text the template begins. Hits
are counted for each such place before anything else is done with them; then the share of
the template's shingles that the text really has there is computed exactly, once for each place.

Only texts that hold the longest three neighbouring words of some template shingle are looked at: no
other text can share a shingle. Everything is a column expression; the driver gets MOST_PHRASES of
those phrases at most, and where there are more they stay a table: templates may be as many and as
long as a table holds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty
from .license_texts import LICENSES

SHINGLE = 5
PHRASE = 3
TASK_WORDS = 100_000
#: Up to so many phrases are looked for by one regular expression while texts are read; more by a semi-join of hashes. The rows are the same.
MOST_PHRASES = 5_000
BANDS = 4
CONTAINMENT = 0.8
#: Window lengths, the longest first; a template takes the first of which any verbatim copy holds a window.
LENGTHS = (8, 4, 2, 1)


def notices(spark: SparkSession) -> DataFrame:
    """The templates (license, text) of license_texts."""
    return spark.createDataFrame(LICENSES, "license string, text string")


def templates_below(spark: SparkSession, folder: str) -> DataFrame:
    """A template for each text file below a folder, named by its file."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    return files.select(F.regexp_extract(F.input_file_name(), "([^/]+?)([.]txt)?$", 1).alias("license"), F.col("value").alias("text"))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _each(n: Column, f) -> Column:
    """A list of f(i) for i from 1 to n; empty where n is below 1."""
    return F.transform(F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.expr("cast(array() as array<int>)")), f)


def shingles(words: Column, k: Column) -> Column:
    return _each(F.size(words) - (k - 1), lambda i: F.xxhash64(F.slice(words, i, k)))


def hashed(shingled: Column) -> Column:
    """The shingles' hashes, a list for each band."""

    def band(b: int) -> Column:
        return F.transform(shingled, lambda s: F.xxhash64(s, F.lit(b)))

    return F.array(*map(band, range(BANDS)))


def bands(hashes: Column, v: Column, step: Column) -> Column:
    """(band, code, pos) of the windows of v shingles at every step-th place: the least shingle's hash and its place (from 1)."""
    last = F.size(hashes[0]) - (v - 1)

    def least(i: Column, b: int) -> Column:
        part = F.slice(hashes[b], i, v)
        # A one-element list names the least hash, so that it is worked out once.
        return F.transform(
            F.array(F.array_min(part)),
            lambda low: F.struct(F.lit(b).alias("band"), low.alias("code"), (i + F.array_position(part, low) - 1).cast("int").alias("pos")),
        )

    places = F.when(last >= 1, F.sequence(F.lit(1), last, step)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.flatten(F.transform(places, lambda i: F.concat(*[least(i, b) for b in range(BANDS)])))


def hitting_phrases(known: DataFrame) -> DataFrame:
    """(x): the longest PHRASE neighbouring words of each shingle of each template (w), as lists: every shared shingle brings one."""
    k = F.least(F.lit(SHINGLE), F.size("w"))
    m = F.least(F.lit(PHRASE), k)

    def phrase(i: Column) -> Column:
        return F.struct(F.length(F.array_join(F.slice("w", i, m), "")).alias("n"), F.slice("w", i, m).alias("x"))

    longest = _each(F.size("w") - (k - 1), lambda i: F.array_max(F.transform(F.sequence(i, i + k - m), phrase))["x"])
    return known.select(F.explode(longest).alias("x")).distinct()


def holding(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """(row): the rows (row, w) that hold one of any number of phrases, by hash: a semi-join of their distinct word runs.

    Spark broadcasts the hashes where they are small and shuffles both sides where they are not. Equal hashes
    of different words let a row through that the exact check then judges; no row is lost.
    """

    def runs_of(m: int) -> Column:
        return _each(F.size("w") - (m - 1), lambda i: F.xxhash64(F.slice("w", i, m)))

    runs = F.array_distinct(F.concat(*[runs_of(m) for m in range(1, PHRASE + 1)]))
    coded = phrases.select(F.xxhash64("x").alias("code")).distinct()
    return rows.select("row", F.explode(runs).alias("code")).join(coded, "code", "left_semi").select("row").distinct()


def pattern_of(phrases: list[str]) -> str:
    """A regular expression for any of the phrases, told apart by their first character, then by their first word."""
    gap = r"[^\p{L}\p{N}]+"
    heads: dict[str, dict[str, list[str]]] = {}
    for p in phrases:
        first, *rest = p.split(" ")
        heads.setdefault(first[0], {}).setdefault(re.escape(first[1:]), []).append(gap.join(["", *map(re.escape, rest)]))
    words_of = lambda by_word: "|".join(f"{w}(?:{'|'.join(rest)})" for w, rest in sorted(by_word.items()))
    any_of = "|".join(f"{re.escape(c)}(?:{words_of(by_word)})" for c, by_word in sorted(heads.items()))
    return rf"(?<![\p{{L}}\p{{N}}])(?:{any_of})(?![\p{{L}}\p{{N}}])"


def _places(texts: DataFrame, known: DataFrame, kinds: list, containment: float) -> DataFrame:
    """Matches (row, license, word, share) of known templates (tid, license, w, k, v) in texts (row, w).

    kinds are the pairs (k, v) that templates have: words of a shingle and shingles of a window.
    """
    table = known.select("tid", "license", "k", "v", shingles(F.col("w"), F.col("k")).alias("t")).withColumn("n", F.size("t"))
    coded = table.select("tid", "n", "k", "v", hashed(F.col("t")).alias("h"))
    coded = coded.select("tid", "n", "k", "v", F.explode(bands(F.col("h"), F.col("v"), F.lit(1))).alias("x"))
    coded = coded.select("tid", "n", "k", "v", "x.band", "x.code", F.col("x.pos").alias("t_pos")).distinct()
    # Hashes are worked out once for each length of shingle, then cut into windows of each length.
    sizes = sorted({k for k, _ in kinds})
    lengths = F.element_at(F.create_map(*[x for k in sizes for x in (F.lit(k), F.array(*[F.lit(v) for j, v in kinds if j == k]))]), F.col("k"))
    shingled = texts.select("row", "w", F.explode(F.array(*map(F.lit, sizes))).alias("k")).select("row", "k", shingles(F.col("w"), F.col("k")).alias("s"))
    cut = shingled.select("row", "k", hashed(F.col("s")).alias("h")).select("row", "k", "h", F.explode(lengths).alias("v"))
    step = F.greatest(F.lit(1), F.expr("v div 2").cast("int"))
    seen = cut.select("row", "k", "v", F.explode(bands(F.col("h"), F.col("v"), step)).alias("x")).select("row", "k", "v", "x.band", "x.code", "x.pos")
    # Votes for each beginning, then the best beginning of each eighth of a template's length.
    hits = seen.join(coded, ["k", "v", "band", "code"]).groupBy("row", "tid", "k", "n", (F.col("pos") - F.col("t_pos")).alias("start")).agg(
        F.count(F.lit(1)).alias("votes")
    )
    eighth = F.greatest(F.lit(1), F.expr("n div 8"))
    best = hits.groupBy("row", "tid", "k", "n", F.floor(F.col("start") / eighth).alias("bin")).agg(
        F.max_by("start", F.struct("votes", -F.col("start"))).alias("start"), F.sum("votes").alias("votes")
    )
    lists = best.groupBy("row", "k").agg(F.collect_list(F.struct("tid", "n", "start", "votes")).alias("places"))
    # A row for each place before anything is cut out of the text: a long text with many places is never held many times over.
    each = texts.join(lists, "row").select("row", "places", shingles(F.col("w"), F.col("k")).alias("s")).select("row", "s", F.explode("places").alias("p"))
    slack = F.floor(F.col("p.n") / 4).cast("int")
    first = F.greatest(F.lit(0), F.col("p.start") - slack).cast("int")
    here = F.slice("s", first + 1, F.greatest(F.lit(0), F.col("p.start") + F.col("p.n") + slack - first).cast("int"))
    read = each.select("row", F.struct("p.tid", "p.start", "p.votes", here.alias("here")).alias("p"))
    share = F.size(F.array_intersect("t", "here")) / F.size(F.array_distinct("t"))
    checked = read.select("row", "p.*").join(table, "tid").select("row", "license", "n", "start", "votes", share.alias("share"))
    checked = checked.filter(F.col("share") >= containment)
    in_order = Window.partitionBy("row", "license").orderBy("start")
    apart = F.col("start") - F.lag("start").over(in_order) >= F.greatest(F.lit(1), F.expr("n div 2"))
    placed = checked.withColumn("place", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("place", F.sum("place").over(in_order))
    return placed.groupBy("row", "license", "place").agg(
        F.greatest(F.lit(0), F.max_by("start", F.struct("share", "votes", -F.col("start")))).cast("int").alias("word"), F.max("share").alias("share")
    ).drop("place")


def _scanned(docs: DataFrame, templates: DataFrame, containment: float) -> tuple[DataFrame, DataFrame]:
    """All rows of docs as (row, doc_id), numbered, and the matches by row."""
    known = templates.select(F.col("license").cast("string").alias("license"), words(text_or_empty()).alias("w")).filter(F.size("w") > 0)
    known = known.groupBy("license", "w").agg(F.first(F.least(F.lit(SHINGLE), F.size("w"))).alias("k"))
    n = F.size("w") - F.col("k") + 1
    v = F.coalesce(*[F.when(n >= x + max(1, x // 2) - 1, F.lit(x)) for x in LENGTHS])
    known = materialize(known.select(F.monotonically_increasing_id().alias("tid"), "license", "w", "k", v.alias("v")), "license-words")
    phrases = materialize(hitting_phrases(known), "license-phrases")
    found = sorted(" ".join(r["x"]) for r in phrases.limit(MOST_PHRASES + 1).collect())
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_or_empty().alias("text"))
    if len(found) > MOST_PHRASES:
        rows = materialize(numbered.select("row", "doc_id", words(F.col("text")).alias("w")), "license-rows")
        held = materialize(holding(rows.select("row", "w"), phrases), "license-held")
        rows = rows.join(held.withColumn("held", F.lit(True)), "row", "left").select("row", "doc_id", F.when(F.col("held"), F.col("w")).alias("w"))
    else:
        w = F.when(F.lower("text").rlike(pattern_of(found)), words(F.col("text"))) if found else F.lit(None).cast("array<string>")
        rows = materialize(numbered.select("row", "doc_id", w.alias("w")), "license-rows")
    # At most one pair for each shorter shingle and one for each window length.
    kinds = [(r["k"], r["v"]) for r in known.select("k", "v").distinct().orderBy("k", "v").collect()]
    if not kinds:
        return rows.select("row", "doc_id"), docs.sparkSession.createDataFrame([], "row long, license string, word int, share double")
    texts = rows.filter("w IS NOT NULL").select("row", "w")
    # The few texts left are dealt anew, so that tasks get about as many words each however the rows were read.
    tasks = 1 + (texts.agg(F.sum(F.size("w"))).first()[0] or 0) // TASK_WORDS
    places = _places(texts.repartition(int(tasks), "row"), known, kinds, containment)
    return rows.select("row", "doc_id"), places


def find_licenses(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """Matches (doc_id, license, word, share): the first word's place (from 0) and the template's share found there.

    A match needs `containment` of the template's distinct shingles within the place that the
    retrieved windows give it, with a quarter of its length to spare on both sides; of places of
    a license less than half a template apart the best is returned. Templates (license, text) of
    one name are alternatives; those without words match nothing, and templates of equal words share
    their matches. Null texts are empty. Rows that repeat an id, or have none, are texts of their own.
    """
    rows, places = _scanned(docs, templates, containment)
    return places.join(rows, "row").select("doc_id", "license", "word", "share")


def license_report(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_matches, licenses (sorted, comma-joined), share (of the best match, 0 without).

    Each row is judged by its own text, whatever its id; null and empty texts have no match; an
    empty table gives no rows; columns other than doc_id and text are not looked at.
    """
    rows, places = _scanned(docs, templates, CONTAINMENT)
    by_row = places.groupBy("row").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("names"), F.max("share").alias("best")
    )
    return rows.join(by_row, "row", "left").select(
        "doc_id",
        F.coalesce("n", F.lit(0)).alias("n_matches"),
        F.coalesce("names", F.lit("")).alias("licenses"),
        F.coalesce("best", F.lit(0.0)).alias("share"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Every place that shares a shingle with a template, tested exactly.
ORACLE = rf"""
WITH t0 AS (SELECT license, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w
  FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(x)})" for n, x in LICENSES)}) v(license, text)),
t1 AS (SELECT license, w, least(5, len(w)) AS k, len(w) - least(5, len(w)) + 1 AS n FROM t0),
t AS (SELECT license, k, n, j, array_to_string(w[j : j + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM t1)),
d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT row, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM t1))),
m AS (SELECT s.row, t.license, t.n, s.i, t.j, s.g FROM s JOIN t ON s.k = t.k AND s.g = t.g),
z AS (SELECT license, count(DISTINCT g) AS size FROM t GROUP BY license),
a AS (SELECT DISTINCT row, license, n, i - j AS start FROM m),
h AS (SELECT a.row, a.license, a.n, a.start, count(DISTINCT m.g) / CAST(any_value(z.size) AS DOUBLE) AS share
  FROM a JOIN m ON m.row = a.row AND m.license = a.license AND m.i > a.start - a.n // 4 AND m.i <= a.start + a.n + a.n // 4
  JOIN z ON z.license = a.license GROUP BY ALL HAVING share >= 0.8),
c AS (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY row, license ORDER BY start) < greatest(1, n // 2) THEN 0 ELSE 1 END AS fresh FROM h),
r AS (SELECT row, sum(fresh) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names, max(share) AS best FROM c GROUP BY row)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, coalesce(names, '') AS licenses, coalesce(best, CAST(0 AS DOUBLE)) AS share
FROM d LEFT JOIN r ON r.row = d.row
"""
