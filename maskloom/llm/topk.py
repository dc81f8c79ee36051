"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.operators.ordering import top_k

# Candidates of a block share one set of sorted lists; queries of a block meet it in one row.
CANDIDATES, QUERIES = 16_384, 512
# Depths at which lists are read; each costs sorted access to that many more entries per dimension.
DEPTHS = (8, 32, 128, 512, 2048)


class SortedLists:
    """The vectors of a block with every dimension's order, least first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)

    def best(self, query: np.ndarray, own: int, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of at least the ``k`` best candidates that reach ``bound``, ties included.

        Lists are read from the end that a dimension's weight favours.  Vectors met are scored in
        full; no unseen one can beat the sum of the lists' current entries times the weights, so
        reading ends when that bound is below the kth score, or all lists are at their end.
        """
        count = len(self.ids)
        used = np.flatnonzero(query)
        weights = query[used]
        seen = np.zeros(count, bool)
        scores = np.full(count, -np.inf)
        done = 0
        for depth in (*DEPTHS, count):
            depth = min(depth, count)
            if 64 * depth * 2 >= count or depth == count:
                # The lists together name nearly everything: read them to the end.
                fresh, depth = np.flatnonzero(~seen), count
            else:
                up, down = used[weights > 0], used[weights < 0]
                met = np.concatenate([
                    self.order[count - depth:count - done, up].ravel(), self.order[done:depth, down].ravel()
                ])
                fresh = np.unique(met[~seen[met]])
            seen[fresh] = True
            scores[fresh] = self.vectors[fresh] @ query
            done = depth
            if depth == count:
                break
            others = scores[self.ids != own] if own is not None else scores
            kth = np.partition(others, len(others) - k)[len(others) - k] if len(others) >= k else -np.inf
            edge = np.where(weights > 0, self.sorted[count - depth, used], self.sorted[depth - 1, used])
            if float(weights @ edge) < max(kth, bound):
                break
        good = np.flatnonzero(seen & (self.ids != own) & (scores >= bound))
        if len(good) > k:
            kth = np.partition(scores[good], len(good) - k)[len(good) - k]
            good = good[scores[good] >= kth]
        return self.ids[good], scores[good]


def whole_numbers(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component, null if any component is null or not finite."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(numbers, lambda x: F.floor(x * scale)))


def packed(vectors: DataFrame, rows: int, prefix: str) -> DataFrame:
    """Blocks of about ``rows`` vectors of one width: ``kind, width, block, ids, data`` with a prefix.

    Rows are dealt by a hash of the id, so a block's size does not depend on the data's order.
    """
    count = vectors.count()
    blocks = max(1, -(-count // rows))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        data = np.array(frame["numbers"].tolist(), dtype=np.int64)
        kind = "i2" if np.abs(data).max() < 32768 else "i8"
        return pd.DataFrame({
            "kind": [kind],
            "width": [frame["width"].iloc[0]], "block": [frame["block"].iloc[0]],
            "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()], "data": [data.astype(kind).tobytes()],
        })

    packed_up = dealt.groupBy("width", "block").applyInPandas(
        pack, "kind string, width int, block int, ids binary, data binary"
    )
    return packed_up.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("kind", "width", "block", "ids", "data")])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest integer inner products.

    Components become ``floor(scale * x)``.  Queries are the rows where ``is_query`` holds, candidates
    all rows but those with the query's id; ties go to the smaller id.  Rows that are null, hold null
    or non-finite components, or have a null id take no part; equal rows count once, and vectors of
    another width or of width zero are no candidates.  Every query block meets every candidate block,
    so work is queries times rows and no table is ever broadcast.
    """
    numbers = vectors.select("vec_id", whole_numbers(F.col("embedding"), scale).alias("numbers")).where(
        "vec_id IS NOT NULL AND numbers IS NOT NULL AND size(numbers) > 0"
    ).distinct().withColumn("width", F.size("numbers"))
    candidates = packed(numbers, CANDIDATES, "c")
    queries = packed(numbers.where(is_query), QUERIES, "q")
    found = queries.join(candidates, F.col("q_width") == F.col("c_width"))
    spread = found.repartition(F.col("q_block"), F.col("c_block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["c_ids"], np.int64)
                query_ids = np.frombuffer(row["q_ids"], np.int64)
                data = np.frombuffer(row["c_data"], row["c_kind"]).astype(np.int64).reshape(len(ids), -1)
                wanted = np.frombuffer(row["q_data"], row["q_kind"]).astype(np.int64).reshape(len(query_ids), -1)
                # Doubles hold these products exactly, or whole numbers are used.
                largest = float(np.abs(data).max(initial=0)) * float(np.abs(wanted).max(initial=0)) * data.shape[1]
                if largest < 2**53:
                    data, wanted = data.astype(np.float64), wanted.astype(np.float64)
                lists = SortedLists(ids, data)
                for own, query in zip(query_ids.tolist(), wanted):
                    got, scores = lists.best(query, own, k, -np.inf)
                    order = np.lexsort((got, -scores))[:k]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(order), own)), pa.array(got[order]), pa.array(scores[order].astype(np.int64))],
                        names=["query_id", "vec_id", "score"],
                    )

    scored = spread.select("q_ids", "q_kind", "q_data", "c_ids", "c_kind", "c_data").mapInArrow(
        run, "query_id bigint, vec_id bigint, score bigint"
    ).distinct()
    ranked = top_k(scored, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH numbers AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM numbers q JOIN numbers c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scores QUALIFY rank <= 20
"""
