"""Secret scanning: three fixed patterns plus character Markov models.

The models are two first-order character chains, one for random strings and one for
ordinary identifiers, fitted on labelled samples: what the fixed patterns found and strings
drawn at random against other long tokens and identifiers made of the corpus's words. A run of
token characters is reported when the log-likelihood ratio of the two chains exceeds a
threshold. Everything is a column expression: texts are read once, for the spans of patterns and
long tokens; samples and scores come from those.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, running, text_or_empty

# The kinds in order, their patterns, the group measured and its least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"

TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1  # 0 stands for the ends of a token
THRESHOLD = 12.0  # nats
#: Bounds of the samples: corpus values of each label, and strings drawn at random.
SAMPLE, DRAWN = 20_000, 5_000

SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string>>"


def spans_of(text: Column, pattern: str, kind: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs (start, rank, kind, end, value); code points, end exclusive."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    ends = running(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, hit: F.length(gap) + F.length(hit)))
    located = F.zip_with(
        F.arrays_zip(ends.alias("end"), found.alias("found")),
        values,
        lambda at, value: F.struct(
            (at["end"] - F.length(at["found"])).cast("bigint").alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            at["end"].cast("bigint").alias("end"),
            value.alias("value"),
        ),
    )
    kept = F.filter(located, lambda s: F.length(s["value"]) >= least) if least else located
    # Most texts hold no match at all: one scan decides before positions are worked out.
    return F.when(text.rlike(pattern), kept.cast(SPANS)).otherwise(F.expr(f"cast(array() as {SPANS})"))


def base_spans(text: Column) -> Column:
    return F.array_sort(
        F.concat(
            spans_of(text, ASSIGN, "assign", 0, group=2, least=12),
            spans_of(text, ACCESS, "access", 1),
            spans_of(text, HEX, "hex", 2),
        )
    )


def located(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, base (spans of the patterns), tokens (long runs of token characters that
    touch none of them), and `name`, three neighbouring words of the text joined into an identifier or path ("" or "/" if it has none).

    Written to the shared folder, so texts are read once.
    """
    text = F.col("text")
    three = F.split(F.regexp_extract(text, "(?<![A-Za-z])[A-Za-z]{4,} [A-Za-z]{4,} [A-Za-z]{4,}", 0), " ")
    style = F.pmod(F.xxhash64("doc_id"), F.lit(6))
    name = (
        F.when(style == 0, F.array_join(three, "_"))
        .when(style == 1, F.upper(F.array_join(three, "_")))
        .when(style == 2, F.upper(F.array_join(three, "")))
        .when(style == 3, F.array_join(three, "-"))
        .when(style == 4, F.concat_ws("/", F.lit(""), F.array_join(three, "/")))
        .otherwise(F.array_join(F.transform(three, F.initcap), ""))
    )
    found = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", "text", base_spans(text).alias("base"), name.alias("name"))
    free = F.filter(spans_of(text, TOKEN, "model", 3), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return materialize(found.select("doc_id", "base", free.alias("tokens"), "name"), "secret-spans")


def drawn(spark: SparkSession, n: int = DRAWN) -> DataFrame:
    """n strings (value) of 20 to 43 characters at random: base64, hexadecimal, or capitals and digits; the same each time."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    coded = F.base64(F.unhex(digest))
    kind = F.col("id") % 3
    value = F.when(kind == 0, coded).when(kind == 1, digest).otherwise(F.upper(F.regexp_replace(coded, "[+/=]", "")))
    return spark.range(n).select(F.substring(value, F.lit(1), (20 + F.col("id") % 24).cast("int")).alias("value"))


def labelled_samples(spans: DataFrame, limit: int = SAMPLE, n_drawn: int = DRAWN) -> DataFrame:
    """(value, random, sure) from `located` spans: pattern hits and drawn strings against identifiers made of
    words, and other long tokens, which are not sure to be ordinary.

    Of the corpus at most `limit` distinct values of each of these kinds, the first in the order of their
    hash, so the sample is a uniform and reproducible one of all documents.
    """
    sample = lambda v, random, sure: F.struct(v.alias("value"), F.lit(random).alias("random"), F.lit(sure).alias("sure"))
    hits = F.transform("base", lambda s: sample(s["value"], True, True))
    rest = F.transform("tokens", lambda s: sample(s["value"], False, False))
    names = F.transform(F.filter(F.array("name"), lambda v: F.length(v) > 1), lambda v: sample(v, False, True))
    values = spans.select(F.explode(F.concat(hits, rest, names)).alias("s")).select("s.*").withColumn("order", F.xxhash64("value"))
    kinds = [(True, True), (False, True), (False, False)]
    found = drawn(spans.sparkSession, n_drawn).select("value", F.lit(True).alias("random"), F.lit(True).alias("sure"))
    for random, sure in kinds:
        kind = values.filter((F.col("random") == random) & (F.col("sure") == sure)).distinct()
        found = found.unionByName(kind.orderBy("order", "value").limit(limit).drop("order"))
    return found


def fitted(samples: DataFrame) -> list[float]:
    """The ratios learned from samples: first from the sure ones, then also from the tokens that those call ordinary.

    A token that looks random to them may be a secret that no pattern knows, so it teaches nothing.
    """
    first = train(samples.filter("sure"))
    return train(samples.filter(F.col("sure") | (ratio(F.col("value"), first) <= 0)))


def _states(token: Column) -> Column:
    inner = F.transform(F.split(token, "(?!^)"), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.concat(F.array(F.lit(0)), inner, F.array(F.lit(0)))


def train(samples: DataFrame, prior: float = 5.0, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of each pair of states, row by row.

    A transition is smoothed with the model's own frequency of the second state, which counts
    like `prior` observations. The transition counts reaching the driver are bounded by the
    alphabet.
    """
    states = samples.select("random", _states(F.col("value")).alias("s"))
    pairs = states.select(
        "random",
        F.explode(
            F.zip_with(
                F.slice("s", F.lit(1), F.size("s") - 1),
                F.slice("s", F.lit(2), F.size("s") - 1),
                lambda a, b: a * STATES + b,
            )
        ).alias("pair"),
    )
    counts = {True: [0] * STATES**2, False: [0] * STATES**2}
    for row in pairs.groupBy("random", "pair").count().collect():
        counts[row["random"]][row["pair"]] = row["count"]

    def logs(n: list[int]) -> list[float]:
        total = sum(n) + smoothing * STATES
        share = [(sum(n[b::STATES]) + smoothing) / total for b in range(STATES)]
        seen = [sum(n[a * STATES : (a + 1) * STATES]) for a in range(STATES)]
        return [math.log((x + prior * share[i % STATES]) / (seen[i // STATES] + prior)) for i, x in enumerate(n)]

    return [x - y for x, y in zip(logs(counts[True]), logs(counts[False]), strict=True)]


def ratio(token: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a token, in nats."""
    literal = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    states = _states(token)
    steps = F.zip_with(
        F.slice(states, F.lit(1), F.size(states) - 1),
        F.slice(states, F.lit(2), F.size(states) - 1),
        lambda a, b: F.get(literal, (a * STATES + b).cast("int")),
    )
    return F.aggregate(steps, F.lit(0.0), lambda total, x: total + x)


def scored(spans: DataFrame, table: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base and spans of `located` spans: the model's are the tokens whose ratio exceeds the threshold."""
    suspects = F.filter("tokens", lambda s: ratio(s["value"], table) > threshold)
    return spans.select("doc_id", "base", F.array_sort(F.concat("base", suspects)).alias("spans"))


def scan(docs: DataFrame, table: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base (spans of the patterns) and spans (those and the model's, by start and rank).

    A model span is a run of at least 16 token characters whose ratio exceeds `threshold`
    and that touches no base span. Null text counts as empty and has no spans; one row is
    returned for each input row, whatever its id; other columns are not looked at.
    """
    return scored(located(docs), table, threshold)


def held_out(spans: DataFrame, threshold: float = THRESHOLD) -> tuple[float, float]:
    """(precision, recall) of the ratio on a fifth of the sure samples, by their hash, learned from the other four."""
    samples = materialize(labelled_samples(spans).withColumn("fold", F.pmod(F.xxhash64("value", F.lit(5)), F.lit(5))), "secret-samples")
    table = fitted(samples.filter("fold > 0"))
    said = samples.filter("fold = 0 AND sure").select("random", (ratio(F.col("value"), table) > threshold).alias("said"))
    n = {(r["random"], r["said"]): r["count"] for r in said.groupBy("random", "said").count().collect()}
    right = n.get((True, True), 0)
    return right / max(1, right + n.get((False, True), 0)), right / max(1, right + n.get((True, False), 0))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets_report(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    The models learn from these documents' own samples. Null and empty texts have no spans; rows
    that repeat an id, or have none, are texts of their own; an empty table gives no rows.
    """
    spans = located(docs)
    found = scored(spans, fitted(materialize(labelled_samples(spans), "secret-samples")))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(digest(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
    )
