import collections
import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from tripwise.llm import chat, exact_dedup, mixing

NORM = re.compile("[\x20\x09-\x0d]+")


def test_exact_groups(spark, make_docs):
    rows = [(5, "a  b"), (3, "a\t\nb"), (9, "a b"), (1, None), (2, ""), (4, "x" * 200_000), (6, "x" * 200_000), (7, "A b"), (7, "A b"), (None, "a b"), (None, "only")]
    got = {}
    for r in exact_dedup.exact_groups(make_docs(rows), capacity=2).collect():
        got.setdefault((r.doc_id, r.text_sha256), []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(NORM.sub(" ", t or ""), []).append(i)
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            for r in got[i, hashlib.sha256(norm.encode()).hexdigest()]:
                assert r.keep_id == (min(known) if known else None) and r.group_size == len(ids)
                assert r.kept == (r.doc_id == r.keep_id)
    left = exact_dedup.drop_exact_copies(make_docs(rows))
    assert left.columns == make_docs(rows).columns
    assert sorted(r.doc_id for r in left.filter("doc_id IS NOT NULL").collect()) == [1, 3, 4, 7, 7]
    assert exact_dedup.exact_groups(make_docs([])).count() == 0


@pytest.mark.parametrize(("capacity", "n"), [(1, 400), (20, 500), (7, 60), (5, 1), (5, 0)])
def test_directory_doubles_until_buckets_fit(spark, make_docs, capacity, n):
    index = exact_dedup.build_index(make_docs([(i, f"text {i}") for i in range(n)]), capacity)
    rows = index.buckets.collect()
    assert len(rows) == n and {r.chain for r in rows} <= {1}
    sizes = collections.Counter(r.bucket for r in rows)
    assert max(sizes.values(), default=0) <= capacity
    cells = {r.cell: r for r in index.cells.collect()}
    for r in rows:  # each key's cell leads to its bucket, whose bits the key begins with
        unsigned = r.key % 2**64
        cell = cells[unsigned >> (64 - index.depth) if index.depth else 0]
        assert cell.bucket == r.bucket
        assert unsigned >> (64 - cell.local_depth) == r.bucket % 2**64 >> (64 - cell.local_depth)
    for bucket, r in {r.bucket: r for r in cells.values()}.items():  # no split without need
        pair = [s for b, s in sizes.items() if (b % 2**64) >> (65 - r.local_depth) == (bucket % 2**64) >> (65 - r.local_depth)]
        assert sum(pair) > capacity or r.local_depth <= max(0, math.floor(math.log2(max(1, n / capacity))) - 1)


@pytest.mark.parametrize("bits", [1, 3])
def test_colliding_keys_form_chains(spark, make_docs, bits):
    rows = [(i, f"text {i % 40}") for i in range(100)] + [(200, None), (201, ""), (None, "text 3")]
    docs = make_docs(rows)
    index = exact_dedup.build_index(docs, capacity=1, key_bits=bits)
    kept = index.buckets.collect()
    assert len(kept) == 41 and max(r.chain for r in kept) > 4 and all(r.norm is not None for r in kept if r.chained > 1)
    assert max(collections.Counter({(r.bucket, r.key) for r in kept}).values()) == 1 and len({r.bucket for r in kept}) == len({r.key for r in kept})
    plain = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert plain(exact_dedup.exact_groups(docs, 1, bits)) == plain(exact_dedup.exact_groups(docs))


def test_result_comes_through_the_index(spark, make_docs, monkeypatch):
    build = exact_dedup.build_index

    def emptied(*args):
        index = build(*args)
        index.buckets = index.buckets.limit(0)
        return index

    monkeypatch.setattr(exact_dedup, "build_index", emptied)
    assert exact_dedup.exact_groups(make_docs([(1, "a"), (2, "a")])).count() == 0


def test_mix(spark, make_docs):
    rows = [(i, "w " * n) for i, n in enumerate([3, 0, 5, 1, 40, 2, 7, 7, 1, 9])]
    sources = ["a", "a", "b", "b", "c", "c", None, None, "tiny", "b"]
    docs = make_docs(rows, source=sources)
    got = {r.doc_id: r for r in mixing.mix(docs, rows_per_bin=2).collect()}
    assert len(got) == 10
    total = sum(r.size for r in got.values())
    size, weight = {}, {}
    for (i, _), s in zip(rows, sources, strict=True):
        size[s] = size.get(s, 0) + got[i].size
    for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or ""))):
        weight[s] = k % 3 + 1
    target, open_, left = {}, set(size), float(total)
    while True:  # water-filling by rounds
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= over
    taken = {}
    for (i, _), s in zip(rows, sources, strict=True):
        assert got[i].source_size == size[s] and abs(got[i].target - target[s]) < 1e-9
        assert 0 <= got[i].taken <= 3 * got[i].size
        assert got[i].size == 0 or got[i].taken % got[i].size == 0
        taken[s] = taken.get(s, 0) + got[i].taken
    assert sum(taken.values()) <= total
    assert {r.doc_id: r.taken for r in mixing.mix(docs.repartition(3), rows_per_bin=5).collect()} == {i: r.taken for i, r in got.items()}
    assert mixing.mix(make_docs([])).count() == 0
    assert mixing.mix(make_docs([(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0
    mixed = mixing.mixed_documents(docs)
    assert {r.doc_id: r.copies * r.n_words for r in mixed.collect()} == {i: r.taken for i, r in got.items() if r.taken}


def test_fold(spark):
    rows = [
        (1, 1, 1, "message", "user", "hi <|im_end|> \\ there"),
        (1, 2, 2, "message", "assistant", ""),
        (1, 3, 2, "delta", "assistant", "Hel"),
        (1, 4, 2, "delta", None, "lo"),
        (1, 5, 3, "message", "user", "more"),
        (1, 6, 3, "edit", "user", "edited"),
        (1, 7, 2, "regenerate", "assistant", "Hey"),
        (1, 8, 2, "delta", "assistant", "!"),
        (1, 9, 4, "message", "user", "gone"),
        (1, 10, 4, "delete", None, None),
        (2, 1, 1, "delta", None, "stray"),
    ]
    log = spark.createDataFrame(rows, "conv_id long, seq long, message_id long, op string, role string, text string")
    out = {r.conv_id: r for r in chat.render(chat.fold_log(log)).select("conv_id", "formatted", "loss", chat.parse(F.col("formatted")).alias("t")).collect()}
    assert [(t.role, t.text) for t in out[1].t] == [("user", "hi <|im_end|> \\ there"), ("assistant", "Hey!"), ("user", "edited")]
    (span,) = out[1].loss
    assert out[1].formatted[span.start : span.start + span.length] == "Hey!"
    assert [(t.role, t.text) for t in out[2].t] == [("", "stray")] and out[2].loss == []


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<|im_start|>user\n", "a\\", "\\<|", "<\\|", "<", "|", "é😀\n\n", "", None, "<|im_end|>\n" * 3, "x" * 100_000]
    rows = [(1, k, ["user", "assistant", "system", None, "odd\nrole<|"][k % 5], t) for k, t in enumerate(texts)] + [(2, 0, "user", "a"), (2, 0, "user", "a"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(3))
    got = {r.conv_id: r for r in chat.chat_report(df).collect()}
    said = "".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in rows if c == 1)
    learned = "".join(t or "" for c, _, r, t in rows if c == 1 and r == "assistant")
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest() and got[1].loss_chars == len(learned)
    assert got[1].n_turns == len(texts) and got[2].n_turns == 2 and got[None].n_turns == 1
    assert chat.chat_report(df.limit(0)).count() == 0


def test_long_conversations_grow_with_their_turns(spark):
    """32,000 turns take no more than a few times as long as 8,000, and the mask holds every assistant text."""
    import time

    def took(n):
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.concat(F.lit("<|ü "), F.col("id")).alias("text"))
        began = time.time()
        (got,) = chat.chat_report(rows).collect()
        learned = "".join(f"<|ü {i}" for i in range(1, n, 2))
        assert got.n_turns == n and got.loss_chars == len(learned) and got.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        return time.time() - began

    took(1000)
    assert took(32_000) < 5 * took(8000) + 1
