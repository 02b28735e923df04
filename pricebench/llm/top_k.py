"""Exact top-k inner products for a stated set of queries against all vectors.

Vectors are dealt into ranges of descending length and packed into blocks; a
block of queries meets a block of vectors as one row, and numpy scores them in
the task.  Nothing is listed per pair: a task returns its k best per query.

Pruning keeps results exact.  The length of query times vector bounds a score,
so a query stops at the first vector too short for its k-th best score.  Vectors
are rotated to the singular directions of all vectors, which moves most of their
length into the first components: the partial sum over those plus the product of
the residual lengths (Cauchy-Schwarz) bounds the score, and only pairs whose
bound reaches the k-th best so far are scored, in whole numbers.  A first round
against the longest vectors gives every query its starting k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pricebench.llm.common import cut_lineage

VECTOR_BLOCK, QUERY_BLOCK = 2048, 256
#: Vectors of one range; a range is what a group of joined block pairs is formed from.
RANGE_ROWS = 16_384
#: Longest vectors that the first round looks at.
HEAD_ROWS = 2048
_STEP = 512


def whole_vectors(vectors: DataFrame, id_col: str, vector: str, scale: int = 256) -> DataFrame:
    """(id, v, dim, norm): components times ``scale``, rounded down.  Without rows that hold a null or a non-finite component, or no id."""
    x = F.col(vector).cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), x.alias("x"))
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    rows = rows.select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v")).distinct()
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    return rows.select("id", "v", F.size("v").alias("dim"), norm.alias("norm"))


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), dim)


def _gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[int, np.ndarray] = {}
    for rows in batches:
        for dim, group in rows.groupby("dim"):
            m = _matrix(group["v"], dim).astype(float)
            sums[dim] = sums.get(dim, 0.0) + m.T @ m
    for dim, g in sums.items():
        i, j = np.indices((dim, dim)).reshape(2, -1)
        yield pd.DataFrame({"dim": dim, "i": i, "j": j, "g": g.reshape(-1)})


def rotations(whole: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the singular directions of all its vectors, strongest first.

    Only a dim x dim table per dimension reaches the driver.
    """
    parts = whole.where("dim > 0").select("dim", "v").mapInPandas(_gram, "dim int, i int, j int, g double")
    cells = parts.groupBy("dim", "i", "j").agg(F.sum("g").alias("g")).toPandas()
    out = {}
    for dim, c in cells.groupby("dim"):
        g = np.zeros((dim, dim))
        g[c["i"], c["j"]] = c["g"]
        values, directions = np.linalg.eigh((g + g.T) / 2)
        out[int(dim)] = directions[:, np.argsort(-values)]
    return out


def _packed(rows_per_block: int):
    """Packs the rows of a partition, longest first, into blocks of one dimension."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True).sort_values(["norm", "id"], ascending=[False, True])
        for dim, group in rows.groupby("dim"):
            for i in range(0, len(group), rows_per_block):
                g = group.iloc[i : i + rows_per_block]
                yield pd.DataFrame({"dim": [dim], "part": [TaskContext.get().partitionId()], "ids": [g["id"].to_numpy(np.int64).tobytes()],
                                    "whole": [_matrix(g["v"], dim).tobytes()]})

    return run


def best(q_ids, q, v_ids, v, rotation, floor, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (query index, id, score): the k best of each query among these vectors that can reach its ``floor``.

    ``v`` comes by descending length.
    """
    n, dim = q.shape
    lead = max(1, dim // 4)
    fq, fv = q.astype(float) @ rotation, v.astype(float) @ rotation
    q_len, v_len = np.linalg.norm(fq, axis=1), np.linalg.norm(fv, axis=1)
    q_rest, v_rest = np.linalg.norm(fq[:, lead:], axis=1), np.linalg.norm(fv[:, lead:], axis=1)
    # Whole numbers are exact in doubles up to 2 ** 53; beyond, integer arithmetic is used.
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(dim, 1) < 2.0**53
    slack = 1e-9 * (q_len.max(initial=0) * v_len.max(initial=0) + 1)
    floor = floor.astype(float).copy()
    kept = (np.zeros(0, np.int64),) * 3  # query, id, score
    live = np.arange(n)
    for i in range(0, len(v), _STEP):
        j = slice(i, i + _STEP)
        live = live[q_len[live] * v_len[i] >= floor[live] - slack]
        if not len(live):
            break
        bound = fq[live, :lead] @ fv[j, :lead].T + np.outer(q_rest[live], v_rest[j])
        a, b = np.nonzero(bound >= (floor[live] - slack)[:, None])
        if not len(a):
            continue
        if exact and len(a) > bound.size // 8:
            s = (q[live].astype(float) @ v[j].astype(float).T)[a, b].astype(np.int64)
        else:
            s = np.einsum("ij,ij->i", q[live[a]], v[j][b])
        a, ids = live[a], v_ids[j][b]
        use = (s >= floor[a]) & (ids != q_ids[a])
        q_all, id_all, s_all = map(np.concatenate, zip(kept, (a[use], ids[use], s[use])))
        order = np.lexsort((id_all, -s_all, q_all))
        q_all, id_all, s_all = q_all[order], id_all[order], s_all[order]
        place = np.arange(len(q_all)) - np.searchsorted(q_all, q_all)
        top = place < k
        kept = q_all[top], id_all[top], s_all[top]
        last = place == k - 1
        floor[q_all[last]] = np.maximum(floor[q_all[last]], s_all[last])
    return kept


def _scores(rotated, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rotation = rotated.value
        for rows in batches:
            for r in rows.itertuples():
                dim = r.dim
                q_ids, v_ids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                q, v = np.frombuffer(r.q_whole, np.int64).reshape(len(q_ids), dim), np.frombuffer(r.whole, np.int64).reshape(len(v_ids), dim)
                floor = np.full(len(q_ids), -np.inf) if r.floor is None else np.frombuffer(r.floor, np.float64)
                at, ids, score = best(q_ids, q, v_ids, v, rotation.get(dim, np.zeros((dim, dim))), floor, k)
                yield pd.DataFrame({"query_id": q_ids[at], "vec_id": ids, "score": score})

    return run


def _top(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products of each query.

    ``is_query``: a condition on ``id_col``.  Ties go to the smaller id; a query
    with fewer candidates returns all of them.  Rows without an id, without a
    vector or with a null, NaN or infinite component take no part; vectors are
    scored against those of their own dimension, and empty ones score 0.
    Repeated rows count once; candidates are the rows with another id.  No rows
    give no rows, further columns are not read.
    """
    spark = vectors.sparkSession
    whole = cut_lineage(whole_vectors(vectors.select(id_col, vector), id_col, vector))
    n = whole.count()
    rotated = spark.sparkContext.broadcast(rotations(whole))
    ranges = max(1, -(-n // RANGE_ROWS))
    schema = "dim int, part int, ids binary, whole binary"
    blocks = cut_lineage(whole.repartitionByRange(ranges, F.desc("norm"), "id").mapInPandas(_packed(VECTOR_BLOCK), schema))
    asked = whole.where(is_query(F.col("id")))
    # Queries in any order; their blocks are of about equal size.
    asked = asked.repartition(max(1, -(-n // (QUERY_BLOCK * 200))), "id")
    questions = cut_lineage(asked.mapInPandas(_packed(QUERY_BLOCK), schema)).select(
        "dim", F.monotonically_increasing_id().alias("q"), F.col("ids").alias("q_ids"), F.col("whole").alias("q_whole"))
    questions = cut_lineage(questions)

    # First round: the longest vectors, at most HEAD_ROWS, give each query a floor for the second.
    head = whole.orderBy(F.desc("norm"), "id").limit(HEAD_ROWS).coalesce(1).mapInPandas(_packed(HEAD_ROWS), schema)
    low = questions.join(F.broadcast(head), "dim").withColumn("floor", F.lit(None).cast("binary"))
    low = low.mapInPandas(_floors(rotated, k), "q long, floor binary")
    asked_with = cut_lineage(questions.join(low, "q", "left"))
    spread = asked_with.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))
    pairs = spread.join(blocks.withColumn("part", F.col("part") % ranges), ["dim", "part"])
    scores = pairs.select("dim", "q_ids", "q_whole", "floor", "ids", "whole").mapInPandas(_scores(rotated, k), "query_id long, vec_id long, score long")
    return _top(scores, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _floors(rotated, k: int):
    """Each query's k-th best score among the longest vectors, or minus infinity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                q_ids, v_ids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                q, v = np.frombuffer(r.q_whole, np.int64).reshape(-1, r.dim), np.frombuffer(r.whole, np.int64).reshape(-1, r.dim)
                floor = np.full(len(q_ids), -np.inf)
                if r.dim:
                    at, _, score = best(q_ids, q, v_ids, v, rotated.value[r.dim], floor, k)
                    place = np.arange(len(at)) - np.searchsorted(at, at)
                    floor[at[place == k - 1]] = score[place == k - 1]
                yield pd.DataFrame({"q": [r.q], "floor": [floor.tobytes()]})

    return run


def op2_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{folder}/embeddings.parquet"), lambda i: i % 50 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s) WHERE rank <= 5
"""
