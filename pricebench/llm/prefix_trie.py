"""Trie of conversation prefixes with totals of every subtree.

Nodes are distinct sequences of turns, named by hashes that run along a
conversation.  Subtree totals come from a contraction of the tree in rounds of
joins: rake adds all leaves to their parents, compress takes out whole chains of
nodes with a single child by pointer jumping, until nothing is left; then the
contracted chains are put back in reverse order, each node taking the total of
the node below its chain.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pricebench.llm.common import cut_lineage, cut_sized
from pricebench.operators.ordering import stored_order

#: Conversations of one family start with turns of its first conversation, at most MOST_SHARED of them.
FAMILY, MOST_SHARED = 100, 5
_IDS = 4096  # ids written together before they are hashed
_IN_PARTITION = (1 << 33) - 1


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """(node, n_children, *values): each of ``values`` summed over the subtree of each node, its top included.

    ``tree``: node, parent (null for roots) and ``values``, long; one row per node.  Parents that are no
    node, and circles, are errors.  No nodes give no rows.
    """
    tree = tree.select("node", "parent", *values)
    kids = tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("k"))
    # above_v: what was taken out between a node and its present parent.
    zeros = [F.lit(0).cast("long").alias(f"above_{v}") for v in values]
    active = cut_lineage(tree.join(kids, "node", "left").select("node", "parent", F.coalesce("k", F.lit(0)).alias("k"), *values, *zeros))
    children = active.select("node", F.col("k").alias("n_children"))
    left = active.count()
    raked, chains = [], []
    while left:
        # Rake: leaves are done, and their parents take their totals and what lies between.
        leaf = F.col("k") == 0
        raked.append(active.where(leaf).select("node", *values))
        below = active.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
            F.count_if(leaf).alias("gone"), F.min(F.when(~leaf, F.col("node"))).alias("below"),
            *[F.sum(F.when(leaf, F.col(v) + F.col(f"above_{v}")).otherwise(0)).alias(f"from_{v}") for v in values],
            *[F.sum(F.when(~leaf, F.col(f"above_{v}")).otherwise(0)).alias(f"between_{v}") for v in values])
        inner = active.where(~leaf).join(below, "node", "left").select(
            "node", "parent", (F.col("k") - F.col("gone")).alias("k"), "below", *[(F.col(v) + F.col(f"from_{v}")).alias(v) for v in values],
            *[f"above_{v}" for v in values], *[f"between_{v}" for v in values])
        inner = cut_sized(inner, left)
        now = inner.count()
        if now == left or inner.where("k IS NULL").limit(1).count():
            raise ValueError("not a forest: a circle, or a parent that is no node")
        # Compress: each node with one child jumps to the first node below that has not, and takes what lies between.
        chain = inner.where("k = 1").select("node", "parent", "below", F.lit(1).cast("long").alias("hops"), *[f"above_{v}" for v in values],
                                            *[(F.col(v) + F.col(f"between_{v}")).alias(v) for v in values])
        n_chain = chain.count()
        moved = n_chain
        while moved:
            ahead = chain.select(F.col("node").alias("below"), F.col("below").alias("next"), F.col("hops").alias("next_hops"), *[F.col(v).alias(f"next_{v}") for v in values])
            jumped = chain.join(ahead, "below", "left").select(
                "node", "parent", F.coalesce("next", "below").alias("below"), (F.col("hops") + F.coalesce("next_hops", F.lit(0))).alias("hops"), *[f"above_{v}" for v in values],
                *[(F.col(v) + F.coalesce(f"next_{v}", F.lit(0))).alias(v) for v in values], F.col("next").isNotNull().alias("moved"))
            chain = cut_sized(jumped, n_chain)
            moved = chain.where("moved").count()
            chain = chain.drop("moved")
        active, left = inner.select("node", "parent", "k", *values, *[f"above_{v}" for v in values]), now - n_chain
        if n_chain:
            chains.append(chain)
            # The node below a chain hangs from the parent of the chain's top; the chain lies between.
            top = chain.groupBy(F.col("below").alias("node")).agg(F.max_by(F.struct("parent", *[(F.col(v) + F.col(f"above_{v}")).alias(v) for v in values]), "hops").alias("top"))
            taken = F.col("top").isNotNull()
            active = cut_sized(active.where("k <> 1").join(top, "node", "left").select(
                "node", F.when(taken, F.col("top.parent")).otherwise(F.col("parent")).alias("parent"), "k", *values,
                *[F.when(taken, F.col(f"top.{v}")).otherwise(F.col(f"above_{v}")).alias(f"above_{v}") for v in values]), now)
    # Re-expand: what was contracted last is put back first.
    totals = functools.reduce(DataFrame.union, raked) if raked else tree.select("node", *values)
    for chain in reversed(chains):
        end = totals.select(F.col("node").alias("below"), *[F.col(v).alias(f"below_{v}") for v in values])
        back = chain.join(end, "below").select("node", *[(F.col(v) + F.col(f"below_{v}")).alias(v) for v in values])
        totals = cut_lineage(totals.union(back))
    return children.join(totals, "node")


def _mixed(place, *columns) -> list:
    return [F.xxhash64(F.lit(seed), place, *columns) for seed in (11, 47)]


def _xor(names: tuple[str, str], window: Window) -> list:
    return [F.bit_xor(n).over(window) for n in names]


def prefixes(messages: DataFrame, family: int = FAMILY, most_shared: int = MOST_SHARED) -> DataFrame:
    """One row per rebuilt conversation and depth: conv_id, depth, n1, n2 (the prefix), p1, p2 (the prefix before it), chars, is_end.

    A rebuilt conversation c is the first h turns of conversation c - c % family
    and then its own turns after its first h; h = crc32(c) % (most_shared + 1).
    """
    order = ["conv_id", "turn", "role", "text"]
    rows = messages.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # A conversation may hold a third of all turns: it is cut at the borders of sorted partitions.
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)).alias("at"),
        F.xxhash64(F.lit(3), "role", "text").alias("t1"), F.xxhash64(F.lit(5), "role", "text").alias("t2"), F.length("text").cast("long").alias("chars"))
    placed = cut_lineage(placed)
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    slices = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    slices = slices.withColumns({"before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "size": F.sum("n").over(Window.partitionBy("conv_id"))})
    slices = cut_lineage(slices)

    own_start = F.col("conv_id") % family == 0
    convs = slices.where("before = 0").select("conv_id", "size", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), F.when(own_start, 0).otherwise(
        F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most_shared + 1))).cast("long").alias("h"))
    lent = F.least("h", F.coalesce("base_size", F.lit(0).cast("long")))
    convs = convs.join(convs.where(own_start).select("base", F.col("size").alias("base_size")), "base", "left").select("conv_id", "base", "h", lent.alias("lent"), "size")
    convs = cut_lineage(convs.withColumn("length", F.col("lent") + F.greatest(F.col("size") - F.col("h"), F.lit(0))))

    in_slice = Window.partitionBy("conv_id", "part")
    running = in_slice.orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shifts = slices.select("conv_id", "part", "before", "first").join(convs.select("conv_id", "h", "lent", "length"), "conv_id")
    own = placed.join(shifts, ["conv_id", "part"]).withColumn("nth", F.col("before") + F.col("at") - F.col("first") + 1).where("nth > h")
    own = own.withColumn("depth", F.col("nth") - F.col("h") + F.col("lent"))
    m1, m2 = _mixed(F.col("depth"), "t1", "t2")
    own = own.select("conv_id", "part", "depth", "length", "chars", m1.alias("m1"), m2.alias("m2"))
    r1, r2 = _xor(("m1", "m2"), running)
    own = cut_lineage(own.withColumns({"r1": r1, "r2": r2}))

    # What the slices before it, and the turns that are lent, add to the hashes of a slice.
    sums = own.groupBy("conv_id", "part").agg(F.bit_xor("m1").alias("s1"), F.bit_xor("m2").alias("s2"))
    c1, c2 = _xor(("s1", "s2"), earlier)
    carried = cut_lineage(sums.select("conv_id", "part", F.coalesce(c1, F.lit(0)).alias("c1"), F.coalesce(c2, F.lit(0)).alias("c2")))
    whole = [F.col("r1").bitwiseXOR(F.col("c1")).alias("n1"), F.col("r2").bitwiseXOR(F.col("c2")).alias("n2")]
    starts = own.where(own_start & (F.col("depth") <= most_shared)).join(carried, ["conv_id", "part"]).select(F.col("conv_id").alias("base"), "depth", "chars", "m1", "m2", *whole)
    starts = cut_lineage(starts)
    borrowed = convs.where("lent > 0").select("conv_id", "base", "lent", "length").join(starts, "base").where(F.col("depth") <= F.col("lent"))
    borrowed = cut_lineage(borrowed.select("conv_id", "depth", "length", "chars", "m1", "m2", "n1", "n2", (F.col("depth") == F.col("lent")).alias("last")))
    begun = carried.join(borrowed.where("last").select("conv_id", F.col("n1").alias("b1"), F.col("n2").alias("b2")), "conv_id", "left").select(
        "conv_id", "part", F.col("c1").bitwiseXOR(F.coalesce("b1", F.lit(0))).alias("c1"), F.col("c2").bitwiseXOR(F.coalesce("b2", F.lit(0))).alias("c2"))
    out = ["conv_id", "depth", "n1", "n2", F.col("n1").bitwiseXOR(F.col("m1")).alias("p1"), F.col("n2").bitwiseXOR(F.col("m2")).alias("p2"), "chars", (F.col("depth") == F.col("length")).alias("is_end")]
    own = own.join(begun, ["conv_id", "part"]).select("conv_id", "depth", "length", "chars", "m1", "m2", *whole).select(*out)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("n1"), zero.alias("n2"), none.alias("p1"), none.alias("p2"), zero.alias("chars"), (F.col("length") == 0).alias("is_end"))
    return own.union(borrowed.select(*out)).union(roots)


def _written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of ids of one node (sorted by node and id) as texts of at most _IDS ids."""
    for rows in batches:
        of_node = rows.groupby(["n1", "n2"], sort=False)["conv_id"]
        yield pd.DataFrame([(*node, int(ids[i]), ",".join(map(str, ids[i : i + _IDS])))
                            for node, group in of_node for ids in [group.tolist()] for i in range(0, len(ids), _IDS)], columns=["n1", "n2", "first", "ids"])


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hash of each node's ids, whose texts come in order."""
    node, sha = None, None
    for rows in batches:
        done = []
        for n1, n2, ids in zip(rows["n1"], rows["n2"], rows["ids"]):
            if node == (n1, n2):
                sha.update(b"," + ids.encode())
                continue
            if node:
                done.append((*node, sha.hexdigest()))
            node, sha = (n1, n2), hashlib.sha256(ids.encode())
        yield pd.DataFrame(done, columns=["n1", "n2", "ends_sha256"])
    if node:
        yield pd.DataFrame([(*node, sha.hexdigest())], columns=["n1", "n2", "ends_sha256"])


def end_hashes(rows: DataFrame) -> DataFrame:
    """(n1, n2, ends_sha256) of the conversations that end at each node; a node may have any number of them."""
    ends = rows.where("is_end").select("n1", "n2", "conv_id")
    texts = ends.repartitionByRange("n1", "n2", "conv_id").sortWithinPartitions("n1", "n2", "conv_id").mapInPandas(_written, "n1 long, n2 long, first long, ids string")
    return texts.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "first").mapInPandas(_hashed, "n1 long, n2 long, ends_sha256 string")


def prefix_trie(messages: DataFrame, family: int = FAMILY, most_shared: int = MOST_SHARED) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``messages``: conv_id, turn, role, text.  A node is named by its smallest
    member.  Turns are ordered by turn (null first), then by role and text, so
    ties have one order; repeated rows are turns of their own.  A null role or
    text is an empty one.  Rows with null conv_id belong to no conversation and
    take no part.  An empty table gives no rows; other columns are not read.
    """
    rows = cut_lineage(prefixes(messages, family, most_shared))
    nodes = rows.groupBy("depth", "n1", "n2").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("chars").alias("chars"))
    nodes = stored_order(nodes, "conv_id", "depth", out="node")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    tree = cut_lineage(nodes.join(parents, ["depth", "p1", "p2"], "left").select(
        "node", "parent", "conv_id", "depth", "n1", "n2", "parent_conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")))
    inside = tree.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct().withColumn("leaf", F.lit(0).cast("long"))
    leaves = tree.select("node", "parent", "saved_tokens").join(inside, "node", "left").withColumn("n_leaves", F.coalesce("leaf", F.lit(1)))
    totals = subtree_totals(leaves, ["n_leaves", "saved_tokens"])
    return tree.drop("saved_tokens").join(totals, "node").join(end_hashes(rows), ["n1", "n2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text"))


ORACLE = """
WITH z(crc, i) AS (SELECT i, i FROM range(256) u(i)),
t8(crc, i, k) AS (SELECT * FROM (WITH RECURSIVE s(c, i, k) AS (SELECT i::BIGINT, i, 0 FROM range(256) u(i) UNION ALL
  SELECT CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, i, k + 1 FROM s WHERE k < 8) SELECT c, i, k FROM s WHERE k = 8)),
c AS (SELECT DISTINCT conv_id, conv_id::VARCHAR s FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT * FROM (WITH RECURSIVE r(conv_id, s, k, crc) AS (SELECT conv_id, s, 0, 4294967295::BIGINT FROM c UNION ALL
  SELECT r.conv_id, s, r.k + 1, xor(t8.crc, r.crc >> 8) FROM r JOIN t8 ON t8.i = xor(r.crc, ascii(substr(s, r.k + 1, 1))::BIGINT) & 255 WHERE r.k < length(s))
  SELECT conv_id, (xor(crc, 4294967295::BIGINT) % 6)::BIGINT h FROM r WHERE k = length(s))),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) i, coalesce(role, '') role, coalesce(text, '') AS txt
  FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT h.conv_id, o.i, role, txt, 0 part FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 100 WHERE o.i <= h UNION ALL
  SELECT h.conv_id, o.i, role, txt, 1 FROM h JOIN o USING (conv_id) WHERE o.i > h),
q AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) d, role, txt FROM b),
l AS (SELECT conv_id, list({'r': role, 't': txt} ORDER BY d) turns FROM q GROUP BY 1),
a AS (SELECT c.conv_id, coalesce(turns, []) turns FROM c LEFT JOIN l USING (conv_id)),
p AS (SELECT conv_id, d::BIGINT d, turns[1:d] pre, turns[1:d - 1] above, length(turns[d].t) chars, d = len(turns) is_end FROM a, unnest(range(0, len(turns) + 1)) u(d)),
n AS (SELECT pre, d depth, min(conv_id) conv_id, count(*) n_convs, any_value(above) above, (count(*) - 1) * coalesce(any_value(chars), 0) saved,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) ends_sha256 FROM p GROUP BY 1, 2),
e AS (SELECT n.*, m.conv_id parent_conv_id FROM n LEFT JOIN n m ON n.depth = m.depth + 1 AND n.above = m.pre),
k AS (SELECT parent_conv_id conv_id, depth - 1 depth, count(*) n_children FROM e WHERE parent_conv_id IS NOT NULL GROUP BY 1, 2),
f AS (SELECT e.*, coalesce(n_children, 0) n_children FROM e LEFT JOIN k USING (conv_id, depth)),
x AS (SELECT DISTINCT u.conv_id, u.depth, v.conv_id vc, v.depth vd, v.saved, v.n_children = 0 leaf
  FROM f u JOIN p pu ON pu.pre = u.pre AND pu.d = u.depth JOIN p pv ON pv.conv_id = pu.conv_id AND pv.d >= u.depth JOIN f v ON v.pre = pv.pre AND v.depth = pv.d),
s AS (SELECT conv_id, depth, count(*) FILTER (leaf) n_leaves, sum(saved)::BIGINT saved_tokens FROM x GROUP BY 1, 2)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM f JOIN s USING (conv_id, depth)
"""
