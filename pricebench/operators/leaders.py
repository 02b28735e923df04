"""Leader grouping (C3, C5) as a distributed job.

The rule: going through the vertices in ``ord`` order, a vertex that may merge
with an earlier leader follows the earliest such leader; any other vertex leads.
That is the lexicographically first maximal independent set of the match graph,
and not its connected components.

The order is worked off in slices that grow fourfold.  A slice is first matched
against the leaders found so far, which are few and mutually unlike, so a dense
group is absorbed by its leader and its quadratic number of inner pairs never
comes into being.  Only what is left over is matched within itself.  A word that very many
names of a block share is spread over tasks by cells (``blocking.CELL_ROWS``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pricebench.config import MatchConfig
from pricebench.operators.blocking import CELL_ROWS, candidate_bound, matches, with_match_sets
from pricebench.session import cut_lineage

FIRST_SLICE = 16_384
GROWTH = 4
# A slice whose inner join would look at more pairs than this is split.
PAIR_BUDGET = 2_000_000_000


def followers_of(edges: DataFrame) -> DataFrame | None:
    """Vertices that are not leaders in a graph of edges (``hi``, ``lo``), ``lo`` earlier.

    Each round settles the vertices without an undecided earlier neighbour (they
    lead) and everything next to them (it follows), so the rounds end by themselves.
    """
    found, rest = None, edges
    while not rest.isEmpty():
        roots = rest.select("lo").distinct().join(
            rest.select(F.col("hi").alias("lo")).distinct(), "lo", "left_anti"
        )
        new = cut_lineage(rest.join(roots, "lo", "left_semi").select("hi").distinct())
        gone = new.withColumnRenamed("hi", "lo")
        rest = cut_lineage(rest.join(new, "hi", "left_anti").join(gone, "lo", "left_anti"))
        found = new if found is None else found.unionByName(new)
    return found


def _slices(vertices: DataFrame, total: int, first: int) -> list[tuple]:
    """Consecutive half-open ranges of ``ord`` that grow by ``GROWTH``."""
    if total <= first:
        return [(None, None)]
    shares, size = [], first
    while size < total:
        shares.append(size / total)
        size *= GROWTH
    cuts = vertices.agg(F.percentile_approx("ord", F.array(*[F.lit(s) for s in shares]), 10_000).alias("c")).first().c
    edges = [None, *sorted(set(cuts)), None]
    return list(zip(edges, edges[1:]))


def _within(vertices: DataFrame, low, high) -> DataFrame:
    kind = vertices.schema["ord"].dataType
    if low is not None:
        vertices = vertices.where(F.col("ord") >= F.lit(low).cast(kind))
    if high is not None:
        vertices = vertices.where(F.col("ord") < F.lit(high).cast(kind))
    return vertices


def group_by_leader(
    vertices: DataFrame, cfg: MatchConfig, first_slice: int = FIRST_SLICE, pair_budget: int = PAIR_BUDGET, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """``ord`` → ``owner`` for every vertex; a leader owns itself.

    ``vertices``: unique ``ord``, ``block`` (what must be equal), ``grade``, ``pos``, ``nn`` and ``tk``.
    """
    vertices = cut_lineage(with_match_sets(vertices, cfg)[0])
    total = vertices.count()
    cell = cell_rows if total > first_slice else None  # the pairs of one slice are few enough for any task
    pending = _slices(vertices, total, first_slice)[::-1]
    leaders: DataFrame | None = None
    owners: DataFrame | None = None

    while pending:
        low, high = pending.pop()
        part = _within(vertices, low, high)
        absorbed = None
        if leaders is not None:
            absorbed = cut_lineage(matches(part, leaders, cfg, cell).groupBy("hi").agg(F.min("lo").alias("owner")))
            part = cut_lineage(part.join(absorbed.select(F.col("hi").alias("ord")), "ord", "left_anti"))
            if (part.count() > first_slice) and candidate_bound(part, cfg) > pair_budget:
                middle = part.agg(F.percentile_approx("ord", 0.5).alias("m"), F.min("ord").alias("l")).first()
                if middle.m > middle.l:
                    pending += [(middle.m, high), (low, middle.m)]
                    continue
        edges = cut_lineage(matches(part, part, cfg, cell))
        lost = followers_of(edges)
        if lost is not None:
            inner = edges.join(lost, "hi", "left_semi").join(
                lost.withColumnRenamed("hi", "lo"), "lo", "left_anti"
            ).groupBy("hi").agg(F.min("lo").alias("owner"))
            absorbed = inner if absorbed is None else absorbed.unionByName(inner)
            part = part.join(lost.withColumnRenamed("hi", "ord"), "ord", "left_anti")
        if absorbed is not None:
            absorbed = cut_lineage(absorbed)
            owners = absorbed if owners is None else owners.unionByName(absorbed)
        if pending:
            part = cut_lineage(part)
            leaders = part if leaders is None else leaders.unionByName(part)

    everyone = vertices.select("ord")
    if owners is None:
        return everyone.withColumn("owner", F.col("ord"))
    followers = owners.withColumnRenamed("hi", "ord")
    return everyone.join(followers, "ord", "left").withColumn("owner", F.coalesce("owner", "ord"))
