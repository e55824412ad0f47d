"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts, up to ORDER bytes long, with the counts of the bytes
that follow. A byte is coded in the longest context that training saw; where it never followed
there, an escape is coded and the next shorter context is asked, with the bytes that the longer
one had already offered left out (exclusion); below the empty context all bytes not seen are
equally likely. Escapes take the number of different followers as their count. Statistics are
frozen, so the cost of a byte depends on the ORDER bytes before it and itself only: texts are cut
into such grams, equal grams of a text are counted, and each is looked up once for all languages.

The trees are learned from a bounded sample of labelled rows (see `sampled`), so that they fit
a broadcast whatever the table's size; every text is scored, in whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_bucket, materialize
from .words import LOWER, PIECE, text_bytes

ORDER = 3
#: Bounds of the sample: bytes of text of one language, of all languages, and languages (those with most text).
LANGUAGE_BYTES, ALL_BYTES, MOST_LANGUAGES = 2_000_000, 16_000_000, 64
UNKNOWN = "und"
#: What stands before a text's first byte.
BEFORE = 0x20


def grams(raw: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte a number made of the `order` bytes before it (in its own text, else BEFORE) and itself, in lower case."""
    low = LOWER[raw].astype(np.uint64)
    out = low.copy()
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order + 1):
        earlier = np.full(len(raw), BEFORE, np.uint64)
        earlier[k:] = low[: len(raw) - k] if k < len(raw) else low[:0]
        out |= np.where(place >= k, earlier, np.uint64(BEFORE)) << np.uint64(8 * k)
    return out


def pieces(raw: np.ndarray, offsets: np.ndarray, order: int, most: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, gram) of all bytes, in pieces of `most` bytes; a text longer than that goes on in the next piece."""
    owner_ends = offsets[1:]
    for start in range(0, len(raw), most):
        stop = min(len(raw), start + most)
        begin = max(0, start - order)
        inside = offsets[(offsets > begin) & (offsets < stop)]
        at = np.unique(np.concatenate([[begin], inside, [stop]])) - begin
        found = grams(raw[begin:stop], at, order)[start - begin :]
        yield np.searchsorted(owner_ends, np.arange(start, stop), "right"), found


def counted(texts: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n) of texts (lang, text): tasks count what they read, Spark adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("lang").dictionary_encode()
            codes, values = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), names.dictionary.to_pylist()
            for text, gram in pieces(*text_bytes(batch.column("text")), order):
                lang = codes[text]
                for code in np.unique(lang):
                    key, n = np.unique(gram[lang == code], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([values[code]] * len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"]
                    )

    return texts.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def sampled(docs: DataFrame, language_bytes: int = LANGUAGE_BYTES, all_bytes: int = ALL_BYTES, most: int = MOST_LANGUAGES) -> DataFrame | None:
    """(lang, text): of each language the rows first by hash until `language_bytes` of text are reached, None without text.

    All languages together get `all_bytes` at most, in equal shares; beyond `most` languages those with least text
    are not learned. Texts longer than a share come last: a language of such texts only learns from one.
    """
    known = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id")
    known = known.filter(F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    totals = known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")).orderBy(F.desc("bytes"), "lang").limit(most).collect()
    if not totals:
        return None
    share = min(language_bytes, all_bytes // len(totals))
    # Rows above the threshold cannot be reached in practice: it lets through twice the share. Where all rows are below, all are ordered.
    least = {r["lang"]: min(1.0, 2 * share / r["bytes"]) for r in totals}
    spark = docs.sparkSession
    limits = spark.createDataFrame(list(least.items()), "lang string, least double")
    order = F.xxhash64("doc_id", "text")
    big = F.octet_length("text") > share
    near = known.join(F.broadcast(limits), "lang").filter(big | (F.shiftrightunsigned(order, 11) / 2.0**53 < F.col("least")))  # at most `most` rows are broadcast
    # Of texts beyond the share only the first by hash can be taken: one row a language.
    first_big = near.filter(big).groupBy("lang").agg(F.min_by("text", order).alias("text"), F.min(order).alias("place"))
    small = near.filter(~big).select("lang", "text", order.alias("place"), F.octet_length("text").alias("size"))
    small = materialize(small, "language-sample")
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("place", "text").rowsBetween(Window.unboundedPreceding, -1))
    taken = small.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < share).select("lang", "text")
    return taken.unionByName(first_big.join(small.select("lang").distinct(), "lang", "left_anti").select("lang", "text"))


class Trees:
    """The context trees of all languages as sorted grams; rows are grams or contexts, columns languages.

    For each length k: `keys[k]` are the grams of k context bytes and one more, `counts[k]` their counts,
    `nodes[k]` the contexts, `total[k]` and `kinds[k]` their followers and different followers, and for an
    escape from a context of k bytes: `rest[k]` and `free[k]`, what the next shorter one holds of counts
    and of different followers beyond those offered already.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int):
        self.langs, self.order = langs, order
        self.keys, self.counts, self.nodes, self.total, self.kinds, self.rest, self.free = [], [], [], [], [], [], []
        for k in range(order + 1):
            keys, at = np.unique(gram & np.uint64(256 ** (k + 1) - 1), return_inverse=True)
            counts = np.zeros((len(keys), len(langs)))
            np.add.at(counts, (at, lang), n)
            nodes, owner = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(nodes), len(langs))), np.zeros((len(nodes), len(langs)))
            np.add.at(total, owner, counts)
            np.add.at(kinds, owner, counts > 0)
            if k:
                shorter = np.searchsorted(self.keys[k - 1], keys & np.uint64(256**k - 1))
                offered = np.zeros_like(total)
                np.add.at(offered, owner, np.where(counts > 0, self.counts[k - 1][shorter], 0))
                up = np.searchsorted(self.nodes[k - 1], nodes & np.uint64(256 ** (k - 1) - 1))
                self.rest.append(self.total[k - 1][up] - offered)
                self.free.append(self.kinds[k - 1][up] - kinds)
            else:
                self.rest.append(np.zeros_like(total))
                self.free.append(256 - kinds)
            self.keys.append(keys), self.counts.append(counts), self.nodes.append(nodes), self.total.append(total), self.kinds.append(kinds)
        # Counts are below 2 ** 24, as many bytes as a sample has at most, so four bytes hold them exactly.
        for held in (self.counts, self.total, self.kinds, self.rest, self.free):
            held[:] = [v.astype(np.float32) for v in held]

    def costs(self, gram: np.ndarray) -> np.ndarray:
        """Bits that each language takes for the last byte of each gram."""

        def found(sorted_keys: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
            return np.where((sorted_keys[at] == wanted)[:, None], values[at].astype(float), 0.0)

        log = lambda v: np.log2(np.maximum(v, 1))
        shape = (len(gram), len(self.langs))
        bits, done, entered = np.zeros(shape), np.zeros(shape, bool), np.zeros(shape, bool)
        rest, free = np.zeros(shape), np.zeros(shape)
        for k in range(self.order, -1, -1):
            context = (gram & np.uint64(256 ** (k + 1) - 1)) >> np.uint64(8)
            total, kinds = found(self.nodes[k], context, self.total[k]), found(self.nodes[k], context, self.kinds[k])
            n = found(self.keys[k], gram & np.uint64(256 ** (k + 1) - 1), self.counts[k])
            here = (total > 0) & ~done
            # What is left to choose from: all followers in the first context, those not offered yet after an escape.
            left, others = np.where(entered, rest, total), np.where(entered, free, kinds)
            bits += np.where(here & (left + others > 0), log(left + others) - log(np.where(n > 0, n, others)), 0.0)
            done |= here & (n > 0)
            entered |= here
            rest, free = (np.where(here, found(self.nodes[k], context, v), w) for v, w in ((self.rest[k], rest), (self.free[k], free)))
        return bits + np.where(done, 0.0, np.log2(np.where(entered, np.maximum(free, 1), 256)))


def learned(docs: DataFrame, order: int = ORDER, **bounds: int) -> Trees | None:
    """The trees of the languages of docs (doc_id, lang, text); None where no labelled row has text."""
    sample = sampled(docs, **bounds)
    if sample is None:
        return None
    rows = counted(sample, order).toArrow()  # no more rows than the sample has bytes
    names = np.array(rows["lang"].to_pylist(), object)
    langs = sorted(set(names))
    code = {name: i for i, name in enumerate(langs)}
    return Trees(langs, np.array([code[x] for x in names]), rows["gram"].to_numpy().astype(np.uint64), rows["n"].to_numpy().astype(float), order)


def code_lengths(trees: Trees, texts: pa.Array) -> np.ndarray:
    """Bits that each language takes for each text."""
    raw, offsets = text_bytes(texts)
    out = np.zeros((len(offsets) - 1, len(trees.langs)))
    for text, gram in pieces(raw, offsets, trees.order):
        first = text[0]
        both, n = np.unique((text - first).astype(np.uint64) << np.uint64(8 * (trees.order + 1)) | gram, return_counts=True)
        owner = (both >> np.uint64(8 * (trees.order + 1))).astype(np.int64)
        kinds, at = np.unique(both & np.uint64(256 ** (trees.order + 1) - 1), return_inverse=True)
        bits = trees.costs(kinds)
        for lang in range(out.shape[1]):
            found = np.bincount(owner, bits[at, lang] * n)
            out[first : first + len(found), lang] += found
    return out


def predicted(trees: Trees, text: Column) -> Column:
    """struct(lang_pred, score, bits): the language with the shortest code, its share if all were as likely before, the code's length."""
    shared = trees

    @F.arrow_udf("struct<lang_pred:string,score:double,bits:double>")
    def run(texts: pa.Array) -> pa.Array:
        bits = code_lengths(shared, texts)
        best = bits.argmin(1) if len(bits) else np.zeros(0, np.int64)
        least = bits[np.arange(len(bits)), best]
        share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        return pa.StructArray.from_arrays([pa.array(np.array(shared.langs, object)[best], pa.string()), pa.array(share), pa.array(least)], ["lang_pred", "score", "bits"])

    return run(F.coalesce(text.cast("string"), F.lit("")))


def identify(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """doc_id, lang_pred, score and bits of each row of docs (doc_id, text and more)."""
    text = F.col("text").cast("string")
    readable = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    if trees is None:
        return docs.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"))
    found = docs.withColumn("__found", predicted(trees, text)).withColumn("__readable", readable)
    return found.select(
        *docs.columns,
        F.when(F.col("__readable"), F.col("__found.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("__readable"), F.col("__found.score")).otherwise(0.0).alias("score"),
        F.when(F.col("__readable"), F.col("__found.bits")).alias("bits"),
    )


def language_report(docs: DataFrame, order: int = ORDER, **bounds: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits: one row for each row of docs.

    Learned from text and lang of the rows whose id is not held out (crc32 of the id modulo 4 is 2), rows with
    null lang or no text passed over; other columns are not looked at. Texts that are null or hold no letter, and
    all where nothing was learned, are `und` with score 0. Of languages with equally short codes the first by
    name is taken. Rows that repeat an id are texts of their own; a null id counts as the empty text in the
    split; an empty table gives no rows.
    """
    trees = learned(docs.filter(doc_bucket(4) != 2), order, **bounds)
    rows = docs.select("doc_id", (doc_bucket(4) == 2).alias("held_out"), "text")
    return identify(rows, trees).drop("text")
