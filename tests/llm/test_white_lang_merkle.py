import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripwise.llm import language_id, merkle, whitening

VECTORS = "vec_id long, embedding array<float>, x int, at string, n long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", 2) for i, v in rows], VECTORS)


def test_whitening_equals_a_dense_decomposition(spark):
    rng = np.random.default_rng(1)
    data = (rng.standard_normal((300, 12)) * np.geomspace(3, 0.1, 12)).astype(np.float32).tolist()
    rows = [*enumerate(data), (5, data[7]), (None, data[8])]
    bad = [(900, None), (901, []), (902, [None] * 12), (903, [math.nan] + data[0][1:]), (904, data[0][:-1]), (905, [math.inf] + data[0][1:]), (906, [1e20] + data[0][1:])]
    got = whitening.whitening_report(vectors(spark, rows + bad), components=7, block=3).toPandas()
    x = np.floor(64 * np.array([v for _, v in rows], float)).astype(np.int64) + 1_000_000
    n = len(x)
    gaps = n * x - x.sum(0)
    cov = (gaps / n).T @ (gaps / n) / n
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1][:7], vecs[:, ::-1][:, :7]
    want = gaps / n @ vecs / np.sqrt(values)
    assert len(got) == n * 7 and set(got.n) == {n} and got.identity_error.max() < 1e-10
    for k in range(7):
        part = got[got.component == k + 1]
        assert abs(part.explained.iloc[0] - values[k] / np.trace(cov)) < 1e-12
        known = {float(d): w for d, w in zip((gaps**2).sum(1), want[:, k])}
        sign = np.sign(part.whitened.iloc[0] * known[float(part.deviation.iloc[0])])
        assert all(abs(known[float(d)] * sign - w) < 1e-8 for d, w in zip(part.deviation, part.whitened))
    assert sorted(got[got.component == 1].deviation) == sorted((gaps**2).sum(1))


def test_whitening_without_variance(spark):
    assert whitening.whitening_report(vectors(spark, [])).count() == 0
    assert whitening.whitening_report(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whitening_report(vectors(spark, [(1, [1.0, 2.0])] * 5)).count() == 0
    line = whitening.whitening_report(vectors(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(6)])).collect()
    assert {r.component for r in line} == {1} and abs(sum(r.whitened**2 for r in line) / 6 - 1) < 1e-12 and abs(line[0].explained - 1) < 1e-12


@pytest.mark.parametrize(("d", "many", "block"), [(200, 20, 4), (60, 60, 8), (150, 1, 16), (5, 2, 16), (90, 40, 1)])
def test_lanczos_finds_all_copies_of_an_eigenvalue(d, many, block):
    rng = np.random.default_rng(d)
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    spectrum = np.sort(np.concatenate([np.full(many, 5.0), np.geomspace(4, 1e-6, d - many)]))[::-1]
    dense = turn @ np.diag(spectrum) @ turn.T
    values, basis, passes = whitening.lanczos(lambda q: dense @ q, d, min(32, d), block)
    assert np.abs(values - spectrum[:32]).max() < 1e-11
    assert np.abs(basis.T @ basis - np.eye(len(values))).max() < 1e-12
    assert np.abs(dense @ basis - basis * values).max() < 1e-11
    assert passes <= math.ceil(d / block)


def test_lanczos_goes_on_after_breakdown():
    """An operator of rank 3 breaks down in the first block; all directions are still returned, orthonormal."""
    a = np.zeros((40, 40))
    a[0, 0], a[1, 1], a[2, 2] = 3, 2, 1
    values, basis, _ = whitening.lanczos(lambda q: a @ q, 40, 10, 4)
    assert np.abs(values - [3, 2, 1, 0, 0, 0, 0, 0, 0, 0]).max() < 1e-13
    assert np.abs(basis.T @ basis - np.eye(10)).max() < 1e-12


# Language identification


def ppm_bits(counts, text, order):
    """Plain PPM with exclusion: counts[context][byte]."""
    low = text.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    padded, bits = b" " * order + low, 0.0
    for i, byte in enumerate(low):
        context, excluded, done = padded[i : i + order], set(), False
        for k in range(order + 1):
            seen = counts.get(context[k:], {})
            if not seen:
                continue
            left = {b: n for b, n in seen.items() if b not in excluded}
            size = sum(left.values()) + len(left)
            if not size:
                continue
            if byte in left:
                bits -= math.log2(left[byte] / size)
                done = True
                break
            bits -= math.log2(len(left) / size)
            excluded |= set(left)
        if not done:
            bits += math.log2(max(1, 256 - len(excluded)))
    return bits


def counts_of(texts, order):
    counts = collections.defaultdict(collections.Counter)
    for text in texts:
        low = text.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
        padded = b" " * order + low
        for i, byte in enumerate(low):
            for k in range(order + 1):
                counts[padded[i + k : i + order]][byte] += 1
    return counts


EN = ["the cat sat on the mat", "a dog and The cat", "where is the other one", "THE END of the day"]
DE = ["der Hund und die Katze", "das ist ein schöner Tag", "wo ist der andere", "über die Brücke"]


@pytest.mark.parametrize("order", [0, 1, 3, 4])
def test_code_lengths_equal_plain_ppm(spark, order):
    rows = [("en", t) for t in EN] + [("de", t) for t in DE]
    docs = spark.createDataFrame([(k, lang, t) for k, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string")
    trees = language_id.learned(docs, order)
    plain = {lang: counts_of([t for x, t in rows if x == lang], order) for lang in ("de", "en")}
    import pyarrow as pa

    texts = ["the dog", "", "schön", "12 % ¿x?", "a", None, "die die the the " * 40]
    got = language_id.code_lengths(trees, pa.array(texts))
    for t, row in zip(texts, got):
        assert np.allclose(row, [ppm_bits(plain[x], t or "", order) for x in ("de", "en")], atol=1e-9)
    old, language_id.PIECE = language_id.PIECE, 7
    try:
        parts = [np.concatenate(x) for x in zip(*language_id.pieces(*language_id.text_bytes(pa.array(texts)), order, 7))]
        whole = [np.concatenate(x) for x in zip(*language_id.pieces(*language_id.text_bytes(pa.array(texts)), order))]
        assert all((a == b).all() for a, b in zip(parts, whole))
    finally:
        language_id.PIECE = old


def test_language_report(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, bits int, score string"
    rows = [(k, t, lang, "s", 1, 1, "x") for k, (lang, t) in enumerate([("en", t) for t in EN * 12] + [("de", t) for t in DE * 12])]
    held = [k for k in range(1000, 1100) if zlib.crc32(str(k).encode()) % 4 == 2]
    odd = [(held[0], "the other cat", None, "s", 1, 1, "x"), (held[1], "die andere Katze", "en", "s", 1, 1, "x"), (held[2], None, "en", "s", 1, 1, "x"), (held[3], "", "en", "s", 1, 1, "x"),
           (held[4], "12 + 30", "en", "s", 1, 1, "x"), (None, "the cat", None, "s", 1, 1, "x"), (held[5], "the cat " * 300_000, "zz", "s", 1, 1, "x"), (held[0], "der Hund", None, "s", 1, 1, "x")]
    got = language_id.language_report(spark.createDataFrame(rows + odd, schema)).collect()
    assert len(got) == len(rows) + len(odd)
    by = collections.defaultdict(list)
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2)
        by[r.doc_id].append(r.lang_pred)
    assert sorted(by[held[0]]) == ["de", "en"] and by[held[1]] == ["de"] and by[None] == ["en"] and by[held[5]] == ["en"]
    assert by[held[2]] == by[held[3]] == by[held[4]] == ["und"]
    empty = spark.createDataFrame([], schema)
    assert language_id.language_report(empty).count() == 0
    unlabelled = language_id.language_report(spark.createDataFrame([(1, "abc", None, "s", 1, 1, "x")], schema)).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]


def test_language_sample_is_bounded_by_its_parameters(spark):
    schema = "doc_id long, text string, lang string"
    rows = [(k, "abcdefghij" * 10, f"l{k % 5}") for k in range(500)] + [(9000 + k, "big text " * 1000, "l7") for k in range(3)]
    docs = spark.createDataFrame(rows, schema)
    sizes = {r.lang: r.n for r in language_id.sampled(docs, 1000, 4200, 6).groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert sizes == {f"l{k}": 700 for k in range(5)} | {"l7": 9000}
    assert {r.lang for r in language_id.sampled(docs, 1000, 10_000, 2).select("lang").distinct().collect()} == {"l0", "l7"}


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    """All levels from the nodes to one."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((level[i ^ 1] if i % 2 else "", level[i ^ 1] if i % 2 == 0 and i ^ 1 < len(level) else ""))
        i //= 2
    return out


def plain_manifest(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        sorted_rows = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = sorted_rows, climb([leaf(*r) for r in sorted_rows])
    top = climb([trees[x][1][-1][0] for x in order])
    out = []
    for g, lang in enumerate(order):
        for i, r in enumerate(trees[lang][0]):
            steps = path(trees[lang][1], i) + path(top, g)
            n = r[3] if r[3] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 else r[3] + 1
            h = leaf(r[0], r[1], r[2], n, r[4])
            for a, b in steps:
                h = sha(a, h, b)
            root = top[-1][0]
            out.append((r[0], leaf(*r), trees[lang][1][-1][0], root, sha(*[a + b for a, b in steps]), h, h == root))
    return sorted(out, key=str)


MERKLE = "doc_id long, source string, lang string, n_chars long, text string, grp int, h string, idx int, n int, block int"


@pytest.mark.parametrize("stride", [1, 2, 6])
def test_manifest_equals_plain_trees(spark, stride):
    rows = [(k, f"s{k % 3}", "en", k * 3, f"text {k}") for k in range(141)]
    rows += [(k, None, "dé", None if k % 2 else 5, "ü" * k) for k in range(200, 217)]
    rows += [(300, "s", None, 1, None), (301, "s", None, 1, ""), (None, "s", None, 1, "x"), (None, "s", None, 2, "y"), (400, "s", "", 1, "z"), (500, "s", "zz", 9, "long " * 300_000)]
    rows += [(7, "s", "en", 1, "again"), (8, "s2", "en", 24, "text 8"), (8, "s2", "en", 24, "text 8")]
    docs = spark.createDataFrame([(*r, 1, "h", 2, 3, 4) for r in rows], MERKLE).repartition(5)
    got = merkle.manifest_report(docs, stride).collect()
    assert got[0].__fields__ == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted([tuple(r) for r in got], key=str) == plain_manifest(rows)
    assert sum(not r.verified for r in got) == sum(1 for r in rows if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_manifest_of_few_rows(spark, n):
    rows = [(k, "s", "en", 1, "t") for k in range(n)]
    docs = spark.createDataFrame([(*r, 1, "h", 2, 3, 4) for r in rows], MERKLE)
    assert sorted([tuple(r) for r in merkle.manifest_report(docs).collect()], key=str) == plain_manifest(rows)


def test_a_proof_fails_for_any_other_leaf(spark):
    docs = spark.createDataFrame([(k, "s", f"l{k % 4}", 1, f"t{k}", 1, "h", 2, 3, 4) for k in range(40)], MERKLE)
    proofs = merkle.manifest(docs, 2)
    other = F.when(F.col("doc_id") % 2 == 0, F.col("leaf")).otherwise(F.sha2(F.col("leaf"), 256))
    judged = proofs.select("doc_id", merkle.verified(other, F.col("proof"), F.col("root")).alias("ok")).collect()
    assert {(r.doc_id % 2 == 0) == r.ok for r in judged} == {True}
