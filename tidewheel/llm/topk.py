"""Exact top-k by inner product, block at a time with bounds from block maxima."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.session import settle

BLOCK_ROWS = 1024  # vectors of one forward index
RANGE_ROWS = 16384  # vectors that one scoring task takes
QUERY_ROWS = 1024  # queries that one scoring task takes
_EXACT = 2**53


def whole(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))


def usable(vector: Column) -> Column:
    """Neither NULL nor empty, and every component a finite number."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(F.forall(vector, finite), F.lit(False))


def forward_blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """(id, v, floor) in id order -> (part, block, dim, ids, floors, matrix, high, low): forward indexes of up
    to `rows` vectors of one length, with each component's maximum and minimum."""

    def pack(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, floors = (batch.column(c).to_numpy(zero_copy_only=False).astype("<i8") for c in ("id", "floor"))
            arrays = batch.column("v")
            lengths = arrays.value_lengths().to_numpy(zero_copy_only=False)
            values, starts = arrays.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
            for dim in np.unique(lengths):
                held = np.flatnonzero(lengths == dim)
                for at in range(0, len(held), rows):
                    some = held[at:at + rows]
                    m = values[starts[some][:, None] + np.arange(dim)].astype("<i8")
                    cells = [part, number, int(dim), ids[some].tobytes(), floors[some].tobytes(), m.tobytes(),
                             m.max(0).tobytes(), m.min(0).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)
                    number += 1

    schema = pa.schema([(c, pa.int32()) for c in ("part", "block", "dim")]
                       + [(c, pa.binary()) for c in ("ids", "floors", "matrix", "high", "low")])
    return vectors.mapInArrow(pack, "part int, block int, dim int, ids binary, floors binary, matrix binary, high binary, low binary")


def _ints(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(-1, dim)


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Summed best products of every query with every block: no member can score more."""
    return _dot(np.maximum(q, 0), high) + _dot(np.minimum(q, 0), low)


def _dot(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """q times m transposed, exactly: in doubles where every partial sum stays below 2**53."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * q.shape[1]
    if most < _EXACT:
        return (q.astype(np.float64) @ m.T.astype(np.float64)).astype(np.int64)
    return q @ m.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, by score and then by smaller id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _search(q: np.ndarray, qid: np.ndarray, floor: np.ndarray, members: list, bound: np.ndarray, k: int):
    """Each query visits the blocks by falling bound, and stops at a bound below its kth best score so far.

    `floor` is a kth best score that is known to be reached; a bound equal to the kth score is still opened.
    """
    top_s, top_i = np.full((len(q), k), _NONE), np.full((len(q), k), _LAST)
    visit = np.argsort(-bound, axis=1, kind="stable")
    for at in visit.T:
        live = bound[np.arange(len(q)), at] >= np.maximum(top_s[:, -1], floor)
        if not live.any():
            break
        for b in np.unique(at[live]):
            ids, m = members[b]
            rows = np.flatnonzero(live & (at == b))
            s = _dot(q[rows], m)
            s[qid[rows][:, None] == ids] = _NONE
            if s.shape[1] > 4 * k:  # only scores that reach a row's own kth can enter
                kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                cols = np.flatnonzero((s >= kth[:, None]).any(0))
                s, ids = s[:, cols], ids[cols]
            top_s[rows], top_i[rows] = _best(np.hstack([top_s[rows], s]),
                                             np.hstack([top_i[rows], np.broadcast_to(ids, s.shape)]), k)
    return top_s, top_i


_NONE, _LAST = -(2**62), 2**63 - 1  # no score yet (its negative is a number, too); no id yet


def _score(k: int):
    def run(blocks: pd.DataFrame, batches: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros((3, 0), dtype=np.int64)]
        for dim, same in blocks.groupby("dim"):
            high, low = (np.concatenate([_ints(x, dim) for x in same[c]]) for c in ("high", "low"))
            members = [(np.frombuffer(i, "<i8"), _ints(m, dim)) for i, m in zip(same["ids"], same["matrix"], strict=True)]
            mine = batches[batches["dim"] == dim]
            if len(mine):
                qid, floor = (np.frombuffer(b"".join(mine[c]), "<i8") for c in ("ids", "floors"))
                q = _ints(b"".join(mine["matrix"]), dim)
                top_s, top_i = _search(q, qid, floor, members, _bounds(q, high, low), k)
                row, col = np.nonzero(top_s != _NONE)
                found.append(np.stack([qid[row], top_i[row, col], top_s[row, col]]))
        return pd.DataFrame(np.concatenate(found, axis=1).T, columns=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 1024) -> DataFrame:
    """Each query's k best rows by the inner product of floor(scale * x): query_id, rank, vec_id, score.

    Queries are the rows where `is_query` holds; candidates are all rows but those of the query's own
    id. Ties go to the smaller id. Rows without an id, and vectors that are NULL, empty or hold NULL,
    NaN or infinite components take no part, nor do vectors of another length than the query's. A
    repeated id is asked once, with the vector that sorts first; repeated candidates each count. Other
    columns are ignored; an empty table gives an empty result. Components must fit a long after scaling.

    Vectors are cut by id range into forward indexes with component-wise maxima and minima. The
    queries, in batches, meet every index in bounded tasks; the first share of the indexes is scored
    before the rest, so that its kth scores prune the rest.
    """
    v = F.col(vector_col)
    rows = vectors.where(F.col(id_col).isNotNull() & usable(v)).select(
        F.col(id_col).cast("bigint").alias("id"), whole(v, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("_q"))
    none = F.lit(_NONE).alias("floor")
    indexes = settle(forward_blocks(rows.select("id", "v", none).repartitionByRange("id").sortWithinPartitions("id"), BLOCK_ROWS))
    queries = settle(rows.where("_q").groupBy("id").agg(F.min("v").alias("v")))
    shares = max(1, -(-indexes.count() * BLOCK_ROWS // RANGE_ROWS))
    chunks = max(1, -(-queries.count() // QUERY_ROWS))
    blocks = (indexes.withColumn("share", F.pmod(F.xxhash64("part", "block"), F.lit(shares)).cast("int"))
              .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))))

    def scored(asked: DataFrame, first: int, last: int) -> DataFrame:
        packed = forward_blocks(asked.repartitionByRange(chunks, "id").sortWithinPartitions("id"), QUERY_ROWS)
        batches = (packed.withColumn("chunk", F.pmod(F.xxhash64("part", "block"), F.lit(chunks)).cast("int"))
                   .withColumn("share", F.explode(F.sequence(F.lit(first), F.lit(last)))))
        mine = blocks.where(F.col("share").between(first, last))
        return mine.groupBy("share", "chunk").cogroup(batches.groupBy("share", "chunk")).applyInPandas(
            _score(k), "query_id long, vec_id long, score long")

    found = settle(scored(queries.select("id", "v", none), 0, 0))
    if shares > 1:
        kth = found.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("score").alias("_kth"))
        known = queries.join(kth, F.col("id") == F.col("query_id"), "left").select(
            "id", "v", F.when(F.col("_n") == k, F.col("_kth")).otherwise(F.lit(_NONE)).alias("floor"))
        found = found.unionByName(scored(known, 1, shares - 1))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
