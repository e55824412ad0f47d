import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tripwise.llm import ctw, minhash_forest, quality, suffix_dedup, words
from tripwise.llm.common import doc_bucket

VOCABULARY = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "la", "mu", "nu", "xi", "omi", "pi"]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY, n)) + "."


def near_rows(seed=0):
    rng = np.random.default_rng(seed)
    rows = [(100 + i, prose(rng, int(rng.integers(3, 200)))) for i in range(40)]
    for g in range(6):
        words = prose(rng, 150).split()
        for k in range(int(rng.integers(2, 6))):
            copy = list(words)
            for at in rng.integers(0, 150, k):
                copy[at] = "changed"
            rows.append((10 * g + k, " ".join(copy)))
    rows += [(900, rows[0][1]), (901, rows[0][1].upper()), (902, ""), (903, None), (904, "one"), (905, "one"), (906, "one two"), (None, rows[0][1]), (907, "w " * 30_000), (904, "one")]
    return rows


def brute_classes(rows, threshold=0.8):
    sets, first = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = tuple(re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
        first.setdefault(w, i)
        sets[first[w]] = {w[k : k + 5] for k in range(len(w) - 4)} if len(w) >= 5 else ({w} if w else set())
    parent, degree = {i: i for i in sets}, collections.Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                degree[a] += 1
                degree[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    out = {}
    for i, t in rows:
        if i is not None:
            w = tuple(re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
            out[i] = (find(first[w]), first[w], degree[first[w]])
    return out


def test_near_classes(spark, make_docs):
    rows = near_rows()
    df = make_docs(rows)
    got = minhash_forest.near_classes(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in got if r.doc_id is not None} == brute_classes(rows)
    assert [(r.class_id, r.n_links) for r in got if r.doc_id is None] == [(None, 0)]
    kept = minhash_forest.drop_near_copies(df)
    want = {i for i, v in brute_classes(rows).items() if v[0] == i}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == want and kept.columns == df.columns
    assert minhash_forest.near_classes(make_docs([])).count() == 0
    assert minhash_forest.near_classes(make_docs([(1, None), (2, "")])).filter("n_links > 0").count() == 0


def test_crowded_groups_lose_no_link(spark, make_docs, monkeypatch):
    monkeypatch.setattr(minhash_forest, "CHUNK_DOCS", 4)
    monkeypatch.setattr(minhash_forest, "BLOCK_DOCS", 9)
    rng = np.random.default_rng(11)
    rows = []
    for g, changes in enumerate((1, 3, 9)):
        words = [f"{w}{i % 7}" for i, w in enumerate(prose(rng, 160).split())]
        for k in range(30):
            copy = list(words)
            for at in rng.integers(0, 160, changes):
                copy[at] = f"changed{rng.integers(0, 3)}"
            rows.append((1000 * g + k, " ".join(copy)))
    want = brute_classes(rows)
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in minhash_forest.near_classes(make_docs(rows)).collect()}
    assert max(v[2] for v in want.values()) > 20
    assert got == want


def test_common_counts_every_shared_code():
    rng = np.random.default_rng(5)
    draw = lambda: np.unique(np.concatenate([rng.integers(0, 40, 20), rng.integers(0, 3000, 30)]).astype(np.uint64))
    for m, n in ((300, 170), (1, 4), (0, 3)):
        a, b = [draw() for _ in range(m)], [draw() for _ in range(n)]
        want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
        assert minhash_forest.common(a, b).tolist() == want


def test_crowded_groups_lose_no_class(spark, make_docs, monkeypatch):
    monkeypatch.setattr(minhash_forest, "CHUNK_DOCS", 4)
    rng = np.random.default_rng(3)
    words = prose(rng, 120).split()
    rows = []
    for k in range(40):  # a chain that drifts away from its first text
        words[(k * 3) % 120] = f"new{k}"
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.class_id for r in minhash_forest.near_classes(make_docs(rows)).collect()}
    assert got == {i: v[0] for i, v in brute_classes(rows).items()}


def test_prefix_depth_reaches_recall():
    d = minhash_forest.prefix_depth(0.8, 0.9995)
    assert 1 - (1 - 0.8**d) ** minhash_forest.TREES >= 0.9995 > 1 - (1 - 0.8 ** (d + 1)) ** minhash_forest.TREES


def test_similar_sets():
    sets = [np.array(s, np.uint64) for s in ([1, 2, 3, 4, 5], [1, 2, 3, 4], [9], [], [1, 2, 3])]
    hit = minhash_forest.similarity(sets) >= 0.8
    assert sorted(map(tuple, np.argwhere(hit))) == [(0, 1), (1, 0)]


def test_trie_nodes_branch_once(spark):
    bits, n = minhash_forest.LABEL_BITS, minhash_forest.LABELS
    label = lambda *parts: sum(p << (bits * (n - 1 - k)) for k, p in enumerate((*parts, *[0] * (n - len(parts)))))
    strings = spark.createDataFrame(
        [(1, 9, 0, label(1, 2, 3, 4, 5, 6)), (2, 9, 0, label(1, 2, 3, 4, 5, 6)), (3, 9, 0, label(1, 2, 3, 4, 9)), (4, 9, 0, label(7)), (4, 9, 1, label(1)), (1, 9, 1, label(1, 0, 0, 0, 0, 1))],
        "copy_id long, n_words long, tree int, labels long",
    )
    at = lambda d: sorted((r.hub, r.doc_id) for r in minhash_forest.branching(strings, d).collect())
    assert at(6) == [(1, 1), (1, 2)]
    assert at(5) == [(1, 1), (1, 4)]  # in tree 0 nothing branches at 5 labels
    assert at(4) == [(1, 1), (1, 2), (1, 3)]


def similar_rows(rng, groups, changes, start=0):
    rows = []
    for g in range(groups):
        words = [f"{w}{g}x{i}" for i, w in enumerate(prose(rng, 150).split())]
        for k in range(2):
            copy = list(words)
            for at in rng.choice(150, changes if k else 0, replace=False):
                copy[at] = f"changed{g}"
            rows.append((start + 2 * g + k, " ".join(copy)))
    return rows


def test_prefixes_are_shortened_until_the_recall_is_reached(spark, make_docs, monkeypatch):
    depths, work = [], minhash_forest._in_chunks
    monkeypatch.setattr(minhash_forest, "_in_chunks", lambda held, depth, *a: (depths.append(depth), work(held, depth, *a))[1])
    rng = np.random.default_rng(21)
    close = similar_rows(rng, 300, 1)  # similarity 0.93: the longest prefixes find them all
    got = {r.doc_id: r.class_id for r in minhash_forest.near_classes(make_docs(close)).collect()}
    assert depths == [6] and sum(c == i - i % 2 for i, c in got.items()) >= 0.999 * len(got)
    depths.clear()
    rows = close + similar_rows(rng, 60, 3, start=10_000)  # some at 0.82
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in minhash_forest.near_classes(make_docs(rows)).collect()}
    assert depths[0] == 6 and len(depths) > 1
    assert sum(got[i] == v for i, v in brute_classes(rows).items()) >= 0.999 * len(got)
    depths.clear()
    minhash_forest.near_classes(make_docs(close[:4])).count()  # few links prove nothing
    assert depths == [6, 5, 4]


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k + 1, k) for k in range(400, 440)]
    parent = {}
    find = lambda x: x if parent.get(x, x) == x else find(parent[x])
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.id: r.root for r in minhash_forest.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == find(i) for i in got) and {i for p in pairs for i in p if find(i) != i} <= set(got)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize(("piece", "block_bytes", "share"), [(ctw.PIECE, 8_000_000, ctw.SHARE), (700, 2_000, 0.02), (700, 2_000, 2)])
def test_context_tree(spark, make_docs, monkeypatch, piece, block_bytes, share):
    """Also with texts longer than a piece, texts dealt over several blocks, and subtrees cut off at depths 2 to 5 or all at 2."""
    score = ctw.score_documents
    monkeypatch.setattr(ctw, "score_documents", lambda docs, training: score(docs, training, block_bytes, piece, share))
    rng = np.random.default_rng(2)
    rows = [(i, prose(rng, int(rng.integers(0, 40)))) for i in range(30)] + [(30, None), (31, ""), (32, "ÄÖ\x00 \n\n THE the"), (33, "a" * 5000), (None, "eta")]
    got = {r.doc_id: r for r in ctw.language_model_report(make_docs(rows)).collect()}
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    tokens = lambda t: [*re.findall("[^\x20\x09-\x0d]+", low(t)), None]
    c = collections.Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    depth, count, kids = ctw.DEPTH, collections.Counter(), collections.defaultdict(set)

    def steps(t):
        b = low(t).encode() + b"\xff"
        p = b"\0" * depth + b
        for k in range(len(b)):
            for bit in range(8):
                yield p[k : k + depth], (1 << bit) | (b[k] >> (8 - bit)), (b[k] >> (7 - bit)) & 1

    for t in train:
        for x, m, bit in steps(t):
            for d in range(depth + 1):
                count[x[depth - d :], m, bit] += 1
                if d:
                    kids[x[depth - d + 1 :], m].add(x[depth - d :])
    kt = lambda x, m: math.lgamma(count[x, m, 0] + 0.5) + math.lgamma(count[x, m, 1] + 0.5) - math.lgamma(count[x, m, 0] + count[x, m, 1] + 1) - math.log(math.pi)
    memo = {}

    def weighted(x, m):
        if (x, m) not in memo:
            memo[x, m] = kt(x, m) if len(x) == depth else math.log(0.5) + np.logaddexp(kt(x, m), sum(weighted(y, m) for y in kids[x, m]))
        return memo[x, m]

    def chance(x, m, bit, d=0):
        own = x[depth - d :]
        local = (count[own, m, bit] + 0.5) / (count[own, m, 0] + count[own, m, 1] + 1)
        if d == depth or not count[x[depth - d - 1 :], m, 0] + count[x[depth - d - 1 :], m, 1]:
            return local
        w = math.exp(math.log(0.5) + kt(own, m) - weighted(own, m))
        return w * local + (1 - w) * chance(x, m, bit, d + 1)

    for i, t in rows:
        r = got[i]
        assert r.held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) < 1e-6
        want = sum(math.log10(chance(x, m, bit)) for x, m, bit in steps(t))
        assert abs(r.score - want) < 1e-4 * max(1, abs(want))
        assert abs(r.bits_per_byte + r.score / math.log10(2) / (len((t or "").encode()) + 1)) < 1e-9
    assert ctw.score_documents(make_docs([]), lambda i: i > 0).count() == 0
    assert ctw.score_documents(make_docs([(1, "abc")]), lambda i: i > 5).first().train_tokens == 0


def test_no_bucket_owns_a_frequent_context():
    """A context with a third of all grams is cut into subtrees of at most the share; named contexts have half of it or more."""
    rng, share = np.random.default_rng(5), 0.01
    keys = rng.integers(0, 1 << 48, 60_000, dtype=np.uint64)
    keys[:20_000] = (keys[:20_000] & ~np.uint64(0xFFFF00)) | np.uint64(0x206500)
    keys[:4_000] = (keys[:4_000] & ~np.uint64(0xFF000000)) | np.uint64(0x74000000)
    keys = np.unique(keys)
    frequent = {d: np.sort(c) for d, c, _ in ctw.frequent_in(keys, len(keys) * share) if len(c)}
    assert list(frequent) == [2, 3] and frequent[2].tolist() == [0x2065] and frequent[3].tolist() == [0x742065]
    cuts = ctw.depths_of_cuts(keys, frequent)
    assert np.bincount(cuts)[2:].tolist() == [int((((keys >> np.uint64(8)) & np.uint64(0xFFFF)) != 0x2065).sum()), int((cuts == 3).sum()), int((((keys >> np.uint64(8)) & np.uint64(0xFFFFFF)) == 0x742065).sum())]
    assert np.bincount(ctw.gram_bucket(keys, cuts, 50)).max() < 0.03 * len(keys)


def brute_removed(rows, n=50):
    out, seen = {}, {}
    texts = sorted(((math.inf if i is None else i, (t or "").encode()) for i, t in rows), key=lambda r: r[0])
    for i, b in texts:
        for k in range(len(b) - n + 1):
            seen.setdefault(b[k : k + n], i)
    for i, b in texts:
        gone = [False] * len(b)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] < i:
                gone[k : k + n] = [True] * n
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def repeat_rows():
    rng = np.random.default_rng(4)
    shared = [prose(rng, 30) for _ in range(5)]
    rows = []
    for i in range(40):
        parts = [prose(rng, int(rng.integers(1, 25))) for _ in range(4)]
        for k in rng.integers(0, 5, int(rng.integers(0, 3))):
            parts.insert(int(rng.integers(0, len(parts))), shared[k][int(rng.integers(0, 40)) :])
        rows.append((i, " ".join(parts)))
    rows += [(50, rows[3][1]), (51, rows[3][1] + "!"), (52, "the the " * 60), (53, "the the " * 40), (54, None), (55, ""), (56, "x" * 49), (57, "x" * 49), (58, "é" * 25), (59, "é" * 25)]
    return [*rows, (60, "y" * 50), (61, "y" * 51), (60, "y" * 50), (None, rows[5][1])]


def test_repeats(spark, make_docs):
    rows = repeat_rows()
    want = brute_removed(rows)
    for more in ({}, {"block_bytes": 3000}, {"block_bytes": 2000, "hot_blocks": 1}):
        got = suffix_dedup.remove_repeats(make_docs(rows).repartition(3), texts=False, **more).collect()
        assert len(got) == len(rows)
        for r in got:
            i = math.inf if r.doc_id is None else r.doc_id
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept.hex()) == want[i], (r.doc_id, more)
    assert suffix_dedup.repeats_report(make_docs([])).count() == 0
    assert sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.repeats_report(make_docs([(1, "short"), (2, "short"), (3, None)])).collect()) == [(0, 0), (5, 0), (5, 0)]


def test_repeat_groups_have_all_occurrences(spark, make_docs):
    """Passages of 60 to 900 bytes in two to five documents, each a group of its own with every place."""
    rng = np.random.default_rng(31)
    fresh = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    passages = [fresh(int(n)) for n in (60, 90, 200, 900)]
    rows, want = [], {k: set() for k in range(4)}
    for i in range(12):
        text = fresh(int(rng.integers(5, 60)))
        for k in rng.permutation(4)[: int(rng.integers(0, 4))]:
            edge = chr(48 + i)  # no passage goes on alike in two documents
            want[k].add((i, len(text) + 1))
            text += edge + passages[k] + edge + fresh(int(rng.integers(5, 60)))
        rows.append((i, text))
    rows.append((40, rows[0][1]))  # a copy is listed with its first document only
    got = {}
    for r in suffix_dedup.repeat_groups(make_docs(rows), block_bytes=700).collect():
        got.setdefault((r.repeat, r.length), set()).add((r.doc_id, r.start))
    assert sorted((n, sorted(at)) for (_, n), at in got.items()) == sorted((len(passages[k]), sorted(at)) for k, at in want.items() if len(at) > 1)


def test_long_texts_are_worked_on_in_pieces(monkeypatch):
    """Words, features and anchors don't depend on where pieces are cut."""
    rng = np.random.default_rng(15)
    texts = ["x" * 300, prose(rng, 400), "", "Über " * 90, " ", prose(rng, 3), "tail"]
    raw, offsets = words.text_bytes(pa.array(texts))
    whole = [words.words_of(raw, offsets, words.NOT_SPACE), suffix_dedup.anchors(raw, offsets)]
    described = quality.features(pa.array(texts))
    for size in (60, 97, 1000):
        monkeypatch.setattr(words, "PIECE", size)
        monkeypatch.setattr(suffix_dedup, "PIECE", size)
        got = [words.words_of(raw, offsets, words.NOT_SPACE), suffix_dedup.anchors(raw, offsets)]
        for a, b in zip(whole, got, strict=True):
            assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))
        assert np.allclose(quality.features(pa.array(texts)), described)


def test_buckets_of_anchors_are_even():
    rng = np.random.default_rng(16)
    raw = rng.integers(97, 123, 400_000).astype(np.uint8)
    _, codes = suffix_dedup.anchors(raw, np.array([0, len(raw)]))
    n = np.bincount(suffix_dedup._hash_bucket(codes, 12), minlength=12)
    assert n.max() < 1.2 * n.mean()


def test_maximal_repeats_have_all_members():
    text = lambda s: np.frombuffer(s.encode().ljust(suffix_dedup.WIDTH, b"~")[: suffix_dedup.WIDTH], np.uint8)
    body = "".join(chr(97 + k % 23) for k in range(70))
    rows = np.stack([text(body + "111111"), text(body + "222222"), text(body[:66] + "3333333333"), text("Q" + body[1:] + "444444")])
    full = np.full(4, suffix_dedup.LEFT), np.full(4, suffix_dedup.RIGHT)
    order, _ = suffix_dedup.sort_contexts(rows, *full)
    found = {(s, n, tuple(sorted(order[m]))) for s, n, m in suffix_dedup.maximal_repeats(rows[order], *full)}
    assert found == {(0, 70, (0, 1)), (0, 66, (0, 1, 2)), (1, 69, (0, 1, 3)), (1, 65, (0, 1, 2, 3))}


def test_quality(spark, make_docs):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        t = prose(rng, int(rng.integers(20, 80)))
        rows.append((i, t if good else (t.upper().replace(" ", "!! ") if i % 8 else "buy " * 50)))
        labels.append((i, int(good), 0))
    rows += [(1000, None), (1001, ""), (None, "some text"), (5, rows[5][1])]
    labels += [(None, 1, 0), (7, None, 0), (5000, 0, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.quality_report(make_docs(rows), lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 60 and np.mean([r.predicted == (r.doc_id % 4 != 0) for r in held]) > 0.97
    kept = quality.drop_low_quality(make_docs(rows), lab)
    assert kept.columns == make_docs(rows).columns
    assert quality.quality_report(make_docs([]), lab).count() == 0
    assert quality.quality_report(make_docs(rows[:3]), lab.limit(0)).count() == 3


def test_scores_worked_out_again(spark, make_docs):
    """Features of characters, pairs, weights, quantile and scores, by plain loops and descent."""
    rng = np.random.default_rng(23)
    rows, labels = [], []
    for i in range(160):
        good = i % 3 != 0
        t = prose(rng, int(rng.integers(5, 40)))
        noisy = "".join(rng.choice(list("!?|#9Z\n")) if rng.random() < (0.04 if good else 0.12) else c for c in t)
        rows.append((i, noisy))
        labels.append((i, int(good), 0))
    rows += [(900, None), (901, "")]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").filter(doc_bucket(4) != 2)
    docs = make_docs(rows)
    x, y = [], []
    learned = sorted(i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2)

    def described(t):
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        n, size = len(w), len(t.encode())
        count = lambda chars: sum(c in chars for c in t)
        letters = sum(c.isalpha() or ord(c) > 127 for c in t)
        root = lambda a, b: math.sqrt(a / max(b, 1))
        again = sum(a.lower() == b.lower() for a, b in zip(w[:-1], w[1:], strict=True)) if w else 0
        return [
            root(count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), letters), root(count("0123456789"), size), root(count("#&%$*^@~=+_"), size), root(count("|<>{}[]\\"), n),
            root(count("!?"), n), root(again, n), 1 / (1 + n), min((size - n) / max(n, 1), 40) / 10, math.log1p(n) / 10, root(count("\n"), n), root(count(".,;:"), n),
        ]

    plain = len(quality.FEATURES) - quality.GROUPS
    full = quality.features(pa.array([t for _, t in rows]))
    assert np.allclose(full[:, :plain], [described(t) for _, t in rows])
    assert np.allclose((full[:, plain:] ** 2).sum(1), [1 if (t or "").split() else 0 for _, t in rows])
    order = {r.id: k for k, r in enumerate(spark.createDataFrame([(i,) for i in learned], "id long").orderBy(F.xxhash64("id")).collect())}
    learned.sort(key=order.get)
    at = {i: k for k, (i, _) in enumerate(rows)}
    x, y = full[[at[i] for i in learned]], np.array([labels[i][1] for i in learned])
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - centre) / scale, -8, 8)
    good, bad = z[y == 1], z[y == 0]
    pick = np.random.default_rng(7)
    d = good[pick.integers(0, len(good), len(bad) * 40)] - np.repeat(bad, 40, axis=0)
    w = np.zeros(z.shape[1])
    for _ in range(20_000):  # descent with a fixed step instead of Newton's method
        w -= 0.3 * (-(d / (1 + np.exp(d @ w))[:, None]).mean(0) + 1e-3 * w)
    share = 1 - y.mean()
    weight = np.where(y == 1, (1 - share) / (y == 1).sum(), share / (y == 0).sum())
    raw = z @ w
    ranked = np.argsort(raw)
    upto = np.cumsum(weight[ranked]) - weight[ranked] / 2
    cut = np.mean([np.interp(share * m, upto, raw[ranked]) for m in (0.97, 1.03)])
    want = 1 / (1 + np.exp(-(math.log(0.7 / 0.3) + np.clip((full - centre) / scale, -8, 8) @ w - cut)))
    got = {r.doc_id: r for r in quality.quality_report(docs, lab).collect()}
    assert np.allclose([got[i].score for i, _ in rows], want, atol=2e-3)
    assert all(got[i].predicted == int(got[i].score >= 0.7) for i, _ in rows)


def test_bradley_terry_learns_the_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = (x @ [2.0, -1.0, 0.0] > 0).astype(int)
    w = quality.fit_weights(x, y)
    assert w[0] > 0 > w[1] and abs(w[2]) < 0.5 * w[0]
    assert quality.features(pa.array([None, "", "A b"])).shape == (3, len(quality.FEATURES))


def test_pipeline(spark, make_docs, tmp_path):
    rng = np.random.default_rng(8)
    leak = prose(rng, 25)
    rows = [(i, prose(rng, 60) if i % 5 else prose(rng, 60).upper().replace(" ", "!! ")) for i in range(120)]
    near = rows[1][1].split()
    near[30] = "other"
    rows += [(200, rows[1][1]), (201, " ".join(near)), (202, prose(rng, 20) + " " + leak), (203, None), (204, "")]
    docs = make_docs(rows, source=["s", "t", None][:1] * len(rows)).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b", leak), ("n", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held, left = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, str(tmp_path))
        left[name] = {r.doc_id for r in held.collect()}
        assert name == "mix" or held.columns == docs.columns
    clean = {i for i in range(120) if i % 5}
    assert clean <= left["quality"] and not {i for i in range(120) if i % 5 == 0} & left["quality"]
    assert left["exact"] == left["quality"] - {200} - ({204} if 203 in left["quality"] else set())
    assert left["near"] == left["exact"] - {201}
    assert left["benchmark"] == left["near"] - {202}
    assert left["mix"] <= left["benchmark"] and len(left["mix"]) >= 0.9 * len(left["benchmark"]) - 2
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == left["mix"]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0
