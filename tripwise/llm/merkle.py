"""Merkle manifest of a dataset: built bottom-up, proofs pushed top-down.

Rows are leaves; each language has a tree over its leaves in the order of doc_id, and one tree
over the languages' roots ends in the dataset's root. Levels are written as they are built,
STRIDE of them a table: a row holds the up to 2 ** STRIDE neighbouring nodes below one node, and
the levels between. On the way down each table is joined to the one above it: a child puts its
siblings before the proof that its parent hands down. A proof is a list of steps, the digests to
the left and to the right of the node at each level, so it both names the siblings and folds.

Only digests and ids are shuffled, never texts. Leaves are numbered by a range sort and the
ranges' counts, so a language may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Levels that one table holds: a row has at most 2 ** STRIDE leaves.
STRIDE = 6
STEPS = "array<struct<left:string,right:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(inputs: Column) -> Column:
    return F.sha2(inputs.cast("binary"), 256)


def field(value: Column) -> Column:
    """A field as the leaf takes it: `-` for null, else its length in bytes, a colon, and it."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(n_chars: Column) -> Column:
    return digest(F.concat(*[field(n_chars if c == "n_chars" else F.col(c)) for c in FIELDS]))


def group_key(lang: Column) -> Column:
    """A key that is never null and keeps the order: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows (grp and more) with idx, from 0 along `order` in each group, and n, the group's size.

    A range sort over all groups gives each task a stretch; a row's number is its place in the
    stretch's part of the group and what the stretches before hold of the group.
    """
    placed = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    placed = materialize(placed.withColumn("stretch", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), name)
    parts = placed.groupBy("grp", "stretch").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("held"))
    # A group has at most as many rows here as there are stretches.
    along = Window.partitionBy("grp").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "grp", "stretch", "first", F.coalesce(F.sum("held").over(along), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy("grp")).alias("n")
    )
    found = placed.join(starts, ["grp", "stretch"])
    return found.withColumn("idx", F.col("before") + F.col("place") - F.col("first")).drop("stretch", "place", "first", "before")


def _levels(nodes: Column, height: Column) -> Column:
    """`height` + 1 lists of digests, from the nodes up: each two neighbours, or the last alone, become one."""

    def above(below: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / 2).cast("int"))
        return F.transform(pairs, lambda i: digest(F.concat(F.get(below, 2 * i), F.coalesce(F.get(below, 2 * i + 1), F.lit("")))))

    ladder = F.filter(F.sequence(F.lit(0), height), lambda i: i > 0)
    return F.aggregate(ladder, F.array(nodes), lambda done, _: F.concat(done, F.array(above(F.element_at(done, -1)))))


def _height(n: Column, stride: int) -> Column:
    """Levels to build on a group of n nodes: as many as leave one, `stride` at most."""
    return F.least(F.lit(stride), F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)).cast("int")


def build(nodes: DataFrame, name: str, stride: int = STRIDE) -> list[DataFrame]:
    """The written tables of the trees over nodes (grp, idx, n, h and more), lowest first.

    Rows: grp, block, n, levels (lists of digests, the nodes' own first), members (the nodes' other columns, in order).
    """
    held = [c for c in nodes.columns if c not in ("grp", "idx", "n", "h")]
    member = F.struct("idx", "h", *held)
    tables = []
    while True:
        block = F.shiftright(F.col("idx"), stride).alias("block")
        rows = nodes.groupBy("grp", block).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(member)).alias("members"))
        levels = _levels(F.transform("members", lambda m: m["h"]), _height(F.col("n"), stride))
        tables.append(materialize(rows.select("grp", "block", "n", levels.alias("levels"), "members"), f"{name}-{len(tables)}"))
        if (tables[-1].agg(F.max("n")).first()[0] or 0) <= 2**stride:
            return tables
        above = F.expr(f"(n + {2**stride - 1}) div {2**stride}")
        nodes = tables[-1].select("grp", F.col("block").alias("idx"), above.alias("n"), F.element_at("levels", -1)[0].alias("h"))
        member = F.struct("idx", "h")


def tops(tables: list[DataFrame]) -> DataFrame:
    """(grp, h): the digest that each group ends in."""
    return tables[-1].select("grp", F.element_at("levels", -1)[0].alias("h"))


def steps_of(levels: Column, at: Column) -> Column:
    """The steps from node `at` of the lowest level to the highest one held."""
    none = F.lit("")

    def step(k: Column) -> Column:
        place = F.call_function("shiftright", at, k)
        sibling = F.coalesce(F.get(F.get(levels, k), place.bitwiseXOR(F.lit(1))), none)
        odd = place % 2 == 1
        return F.struct(F.when(odd, sibling).otherwise(none).alias("left"), F.when(odd, none).otherwise(sibling).alias("right"))

    return F.transform(F.filter(F.sequence(F.lit(0), F.size(levels) - 1), lambda k: k < F.size(levels) - 1), step)


def pushed(tables: list[DataFrame], inherited: DataFrame) -> DataFrame:
    """(grp, member, proof and more) of the lowest nodes; `inherited` (grp, proof and more) is what each group's top is handed."""
    passed = [c for c in inherited.columns if c not in ("grp", "proof")]
    rows = tables[-1].drop("n").join(inherited, "grp")
    for below in [*tables[-2::-1], None]:
        each = rows.select("grp", "levels", "proof", *passed, F.posexplode("members").alias("at", "member"))
        each = each.select("grp", "member", *passed, F.concat(steps_of(F.col("levels"), F.col("at")), "proof").alias("proof"))
        if below is None:
            return each
        rows = below.drop("n").join(each.select("grp", F.col("member.idx").alias("block"), "proof", *passed), ["grp", "block"])


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def proof_digest(proof: Column) -> Column:
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(docs: DataFrame, stride: int = STRIDE, altered: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, lang, leaf, subroot, root, proof (its steps), and altered, a second leaf.

    docs needs doc_id, source, lang, n_chars and text; other columns are not looked at. `altered` is a leaf
    that is carried along (null by default), to be checked against the proof. Null fields count as such: a
    null lang is a group of its own and comes first, null ids come first in theirs; empty texts are texts.
    Rows that repeat a doc_id are leaves of their own, in the order of their digests; whole rows that are
    equal have neighbouring places. A table without rows gives none.
    """
    other = F.lit(None).cast("string") if altered is None else altered
    leaves = docs.select(group_key(F.col("lang")).alias("grp"), F.col("doc_id"), F.col("lang").cast("string").alias("lang"), leaf_of(F.col("n_chars")).alias("h"), other.alias("altered"))
    low = build(numbered(leaves, ["doc_id", "h"], "merkle-leaves"), "merkle", stride)
    subroots = materialize(tops(low).select(F.lit("").alias("grp"), F.col("grp").alias("of"), "h"), "merkle-subroots")
    high = build(numbered(subroots, ["of"], "merkle-top"), "merkle-top", stride)
    nothing = F.expr(f"cast(array() as {STEPS})")
    handed = pushed(high, tops(high).select("grp", nothing.alias("proof")))
    rows = pushed(low, handed.select(F.col("member.of").alias("grp"), F.col("member.h").alias("subroot"), "proof"))
    root = tops(high).first()
    return rows.select(
        "member.doc_id", "member.lang", F.col("member.h").alias("leaf"), "subroot", F.lit(root["h"] if root else None).cast("string").alias("root"), "proof", "member.altered"
    )


def verified(leaf: Column, proof: Column, root: Column) -> Column:
    """Whether a leaf's proof leads to the root."""
    return folded(leaf, proof) == root


def manifest_report(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row, some of them tampered with.

    Where 7 divides the crc32 of the decimal doc_id, n_chars is one more in the leaf that is folded (a null one
    stays); a null doc_id has no decimal form and is not tampered with. See `manifest` for the other cases.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    rows = manifest(docs, stride, F.when(hit, leaf_of(F.col("n_chars") + 1)))
    found = rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("proof")).alias("proof_sha256"),
        folded(F.coalesce("altered", "leaf"), F.col("proof")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT *, coalesce('=' || lang, '') AS grp FROM documents
), f AS (
  SELECT doc_id, grp, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
         coalesce(strlen(text) || ':' || text, '-') AS z
  FROM d
), crcs AS (
  SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v
  FROM (SELECT unnest(range(0, 256)) AS i)
), crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM crcs
), leaves AS (
  SELECT doc_id, grp,
         sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS h,
         CASE WHEN xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
                                   lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 7 = 0 AND n_chars IS NOT NULL
              THEN sha256(a || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || z) END AS altered
  FROM f, crc_table
), low AS (
  SELECT grp, 0 AS lv, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n, h, doc_id, altered FROM leaves
), tree AS (
  SELECT grp, lv, idx, n, h FROM low
  UNION ALL
  SELECT grp, lv + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY grp, lv, idx // 2, n
), subs AS (
  SELECT grp, h AS subroot, lv AS height, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS lv, idx, n, subroot AS h FROM subs
  UNION ALL
  SELECT lv + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lv, idx // 2, n
), root AS (
  SELECT h AS root, lv AS height FROM top WHERE n = 1
), paths AS (
  SELECT low.grp, low.idx, tree.lv, (low.idx >> tree.lv) % 2 = 1 AS odd, coalesce(s.h, '') AS sib
  FROM low JOIN tree ON tree.grp = low.grp AND tree.idx = low.idx >> tree.lv AND tree.n > 1
       LEFT JOIN tree s ON s.grp = low.grp AND s.lv = tree.lv AND s.idx = xor(low.idx >> tree.lv, 1)
  UNION ALL
  SELECT low.grp, low.idx, subs.height + top.lv, (subs.idx >> top.lv) % 2 = 1, coalesce(s.h, '')
  FROM low JOIN subs USING (grp) JOIN top ON top.idx = subs.idx >> top.lv AND top.n > 1
       LEFT JOIN top s ON s.lv = top.lv AND s.idx = xor(subs.idx >> top.lv, 1)
), proofs AS (
  SELECT grp, idx, sha256(string_agg(sib, '' ORDER BY lv)) AS proof_sha256 FROM paths GROUP BY grp, idx
), fold AS (
  SELECT grp, idx, 0 AS lv, coalesce(altered, h) AS h FROM low
  UNION ALL
  SELECT grp, idx, fold.lv + 1, sha256(CASE WHEN odd THEN sib || h ELSE h || sib END) FROM fold JOIN paths USING (grp, idx, lv)
), ends AS (
  SELECT grp, idx, arg_max(h, lv) AS folded_root FROM fold GROUP BY grp, idx
)
SELECT doc_id, low.h AS leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM low JOIN subs USING (grp) JOIN root ON true LEFT JOIN proofs ON proofs.grp = low.grp AND proofs.idx = low.idx
     JOIN ends ON ends.grp = low.grp AND ends.idx = low.idx
"""
