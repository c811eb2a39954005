"""Merkle manifest of a dataset: a tree of digests per group, a root over the groups, proofs per row.

Leaves are made in the scan; from there on only digests move. Leaves take their places by a
range sort on (group, identifier, digest), numbered per partition and shifted by the counts
of the partitions before, so no group is sorted in one task. A tree is named by the number of
its first row, which follows the order of the groups.

Every level is a table of nodes (tree, place, digest). Sibling-shift self-joins equijoin it
with itself: the node at slot s of a run joins the slot-zero node at its place less s, so
all joins of a level share the key (tree, place of slot zero), every node is shuffled once,
and no key has more than one row a side. Slot-zero rows then hold the whole run and emit the
parent. Trees whose level is a single node leave with it as their subroot; the subroots
are leaves of one more tree, built the same way.

Proofs come from the top down: a run's siblings join those above its parent. Levels are
tables in the shared folder; only the number of levels is known to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewatch.llm import common
from casewatch.session import materialize

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def framed(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(framed, values)), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``tree`` (same for a group, ascending with it, nulls first), ``place`` in it from 0, and ``left``, its size.

    A partition of the range sort is numbered by itself; what stands before it is known
    from the counts per partition and group, the only rows that windows see.
    """
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "_tie")]
    made = materialize(spread.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()).drop("_tie"))
    part = F.shiftright("_row", 33)
    counts = materialize(made.groupBy(part.alias("_part"), F.col(group).alias("_group")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n")))
    whole = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(counts.select(
        "_part", "_group", "_first", before.alias("_before"), F.min("_first").over(whole).alias("tree"), F.sum("_n").over(whole).alias("left")))
    placed = made.join(starts, (part == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return materialize(placed.withColumn("place", F.col("_row") - F.col("_first") + F.col("_before")).drop("_row", "_part", "_group", "_first", "_before"))


def parent(digests: Column) -> Column:
    return F.sha2(F.concat_ws("", digests), 256)


def runs_of(nodes: DataFrame, fan: int) -> DataFrame:
    """Slot-zero rows with the nodes of their run in order: tree, place and left of the parent, its digest, members.

    ``nodes`` has tree, place, left, digest and any others, which members keep.
    """
    own = F.struct(*[c for c in nodes.columns if c not in ("tree", "place", "left")])
    slot = F.pmod("place", F.lit(fan))
    run = nodes.filter(slot == 0).select("tree", "left", F.col("place").alias("base"), own.alias("m0"))
    for s in range(1, fan):
        sibling = nodes.filter(slot == s).select("tree", (F.col("place") - s).alias("base"), own.alias(f"m{s}"))
        run = run.join(sibling, ["tree", "base"], "left")
    members = F.array_compact(F.array(*[f"m{s}" for s in range(fan)])).alias("members")
    held = run.select("tree", F.expr(f"base div {fan}").alias("place"), F.expr(f"(left + {fan - 1}) div {fan}").alias("left"), members)
    return held.withColumn("digest", parent(F.col("members.digest")))


def grow(leaves: DataFrame, fan: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels of all trees, bottom up, as tables of runs; and the last node of each tree (tree, digest)."""
    levels, tops, nodes = [], [], leaves
    size = leaves.agg(F.max("left")).first()[0] or 0
    while True:
        tops.append(nodes.filter("left = 1").select("tree", "digest"))
        if size <= 1:
            return levels, materialize(common.union_all(tops))
        levels.append(materialize(runs_of(nodes.filter("left > 1"), fan)))
        nodes = levels[-1].select("tree", "place", "left", "digest")
        size = -(-size // fan)


def depth_of(size: Column, levels: int, fan: int) -> Column:
    """Levels of a tree of ``size`` leaves, of at most ``levels``."""
    depth = F.lit(0)
    for level in range(levels):
        depth = depth + (size > fan**level).cast("int")
    return depth


def stepped(runs: DataFrame, above: DataFrame, fan: int) -> DataFrame:
    """Nodes of the level of ``runs`` with their steps: tree, place, member, and the columns of ``above``.

    A step is the slot of a node in its run and the digests of the run's others; the first
    step is the node's own, those of ``above`` (tree, place, steps, others) follow.
    """
    held = runs.select("tree", "place", "members").join(above, ["tree", "place"])
    own = held.select("*", F.posexplode("members").alias("slot", "member"))
    others = F.expr("concat(slice(members.digest, 1, slot), slice(members.digest, slot + 2, size(members)))")
    steps = F.concat(F.array(F.struct("slot", others.alias("siblings"))), "steps")
    place = (F.col("place") * fan + F.col("slot")).alias("place")
    return own.select("tree", place, "member", steps.alias("steps"), *[c for c in above.columns if c not in ("tree", "place", "steps")])


def descend(levels: list[DataFrame], above: DataFrame, fan: int) -> DataFrame:
    """Steps above the lowest runs: from the tops in ``above`` (tree, place 0, steps, depth, others) down to level 1."""
    have = above
    for at in range(len(levels) - 1, 0, -1):
        # A tree that ends below this level waits with its top.
        below = stepped(levels[at], have.filter(F.col("depth") > at), fan).select(*have.columns)
        have = materialize(below.unionByName(have.filter(F.col("depth") <= at)))
    return have


def folded(leaf: Column, steps: Column) -> Column:
    """Root that a leaf and its steps give."""
    def up(digest: Column, step: Column) -> Column:
        slot, others = step["slot"], step["siblings"]
        return parent(F.concat(F.slice(others, F.lit(1), slot), F.array(digest), F.slice(others, slot + 1, F.size(others) + 1)))

    return F.aggregate(steps, leaf, up)


def proofs(leaves: DataFrame, levels: list[DataFrame], above: DataFrame, fan: int) -> DataFrame:
    """Every leaf (``member``) with its steps up to where ``above`` ends, and the other columns of ``above``."""
    others = [c for c in above.columns if c not in ("tree", "place")]
    own = F.struct(*[c for c in leaves.columns if c not in ("tree", "place", "left")]).alias("member")
    lone = leaves.filter("left = 1").select("tree", own).join(above.drop("place"), "tree").select("member", *others)
    if not levels:
        return lone
    deep = stepped(levels[0], descend(levels, above, fan).filter("depth > 0"), fan)
    return deep.select("member", *others).unionByName(lone)


STEPS = "array<struct<slot: int, siblings: array<string>>>"


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", fan: int = FAN, carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: leaf, subroot, root and steps (slot and siblings per level), and ``carry``.

    A leaf is the digest of the framed ``fields``. The rows of a group (null is a group,
    before all others) are in order of ``order``, null first, ties by leaf; rows that repeat
    a row are leaves of their own, next to each other. ``fan`` successive nodes at a time
    become their parent until one is left, a lone leaf itself; groups in byte order become
    the root in the same way. An empty table gives no rows. Texts of any length are digested
    in the scan and never shuffled; other columns are not read unless ``carry`` (columns
    computed in the scan) names them.
    """
    if fan < 2:
        raise ValueError("a parent has two children or more")
    carried = carry or {}
    rows = common.only(docs, grp=F.col(group), ord=F.col(order), digest=leaf_digest([F.col(c) for c in fields]), **{f"c_{n}": c for n, c in carried.items()})
    leaves = numbered(rows, "grp", ["ord", "digest"]).drop("grp", "ord")
    levels, tops = grow(leaves, fan)
    # The last nodes of the groups are the leaves of one more tree.
    crowns = numbered(tops.select(F.col("tree").alias("of"), "digest", F.lit(0).alias("one")), "one", ["of"]).drop("one")
    crown_levels, summit = grow(crowns, fan)
    root = summit.first()
    start = summit.select("tree", F.lit(0).cast("long").alias("place"), F.lit(len(crown_levels)).alias("depth"), F.expr(f"CAST(array() AS {STEPS})").alias("steps"))
    crowned = proofs(crowns, crown_levels, start, fan)
    sizes = leaves.filter("place = 0").select("tree", depth_of(F.col("left"), len(levels), fan).alias("depth"))
    above = crowned.select(F.col("member.of").alias("tree"), F.lit(0).cast("long").alias("place"), "steps", F.col("member.digest").alias("subroot"))
    proved = proofs(leaves, levels, materialize(above.join(sizes, "tree")), fan)
    return proved.select(
        *[F.col(f"member.c_{n}").alias(n) for n in carried], F.col("member.digest").alias("leaf"), "subroot",
        F.lit(root["digest"] if root else None).cast("string").alias("root"), "steps")


def verified(rows: DataFrame, leaf: str | Column = "leaf") -> DataFrame:
    """``rows`` of a manifest with ``folded_root``, recomputed from ``leaf`` and the steps, and whether it equals the root."""
    done = rows.withColumn("folded_root", folded(F.col(leaf) if isinstance(leaf, str) else leaf, F.col("steps")))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.read(spark, folder, "documents")
    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    other = leaf_digest([F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS])
    rows = manifest(docs, carry={"doc_id": F.col("doc_id"), "tampered": F.when(marked, other)})
    proof = F.sha2(F.concat_ws("", F.flatten("steps.siblings")), 256)
    return verified(rows, F.coalesce("tampered", "leaf")).select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


SQL = {"op11_manifest": r"""
WITH RECURSIVE
framed AS (
  SELECT doc_id, lang, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    -- Bytes of the decimal number; after each byte, eight steps of the reflected polynomial.
    list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295::BIGINT) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' ||
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered
  FROM framed),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves),
up AS (
  SELECT tree, 0 AS level, place, leaf AS h, n FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 8, sha256(string_agg(h, '' ORDER BY place)), (any_value(n) + 7) // 8
  FROM up WHERE n > 1 GROUP BY tree, level, place // 8),
tops AS (SELECT tree, h, tree - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1),
up2 AS (
  SELECT 0 AS level, place, h, n FROM tops
  UNION ALL
  SELECT level + 1, place // 8, sha256(string_agg(h, '' ORDER BY place)), (any_value(n) + 7) // 8
  FROM up2 WHERE n > 1 GROUP BY level, place // 8),
fold AS (
  SELECT tree, place AS id, 0 AS level, place, n, coalesce(tampered, leaf) AS h, '' AS proof FROM placed
  UNION ALL
  SELECT f.tree, f.id, f.level + 1, f.place // 8, (any_value(f.n) + 7) // 8,
    sha256(string_agg(CASE WHEN u.place = f.place THEN f.h ELSE u.h END, '' ORDER BY u.place)),
    any_value(f.proof) || coalesce(string_agg(u.h, '' ORDER BY u.place) FILTER (WHERE u.place <> f.place), '')
  FROM fold f JOIN up u ON u.tree = f.tree AND u.level = f.level AND u.place // 8 = f.place // 8
  WHERE f.n > 1 GROUP BY f.tree, f.id, f.level, f.place // 8),
fold2 AS (
  SELECT f.tree, f.id, 0 AS level, t.place, t.n, f.h, f.proof FROM fold f JOIN tops t ON t.tree = f.tree WHERE f.n = 1
  UNION ALL
  SELECT f.tree, f.id, f.level + 1, f.place // 8, (any_value(f.n) + 7) // 8,
    sha256(string_agg(CASE WHEN u.place = f.place THEN f.h ELSE u.h END, '' ORDER BY u.place)),
    any_value(f.proof) || coalesce(string_agg(u.h, '' ORDER BY u.place) FILTER (WHERE u.place <> f.place), '')
  FROM fold2 f JOIN up2 u ON u.level = f.level AND u.place // 8 = f.place // 8
  WHERE f.n > 1 GROUP BY f.tree, f.id, f.level, f.place // 8)
SELECT p.doc_id, p.leaf, t.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM placed p JOIN tops t ON t.tree = p.tree JOIN fold2 f ON f.tree = p.tree AND f.id = p.place AND f.n = 1,
  (SELECT h FROM up2 WHERE n = 1) r
"""}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_manifest": op11_manifest}
