"""Ranked lexical search: items against all documents by blocked dense multiplication.

The terms of a group of items are its compact vocabulary.  A tile of documents times a tile of that
vocabulary holds term impacts, a tile of the vocabulary times the items holds term weights; their product
is a matrix multiplication in float64.  Every partial sum of a tile is an integer under 2^53, so the
floating product is exact in whatever order it is summed, and tiles are added as 64-bit integers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.common import id_and_text

# Fixed value: what is no part of a term.
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GROUP_BYTES = 1 << 20
DOCUMENT_TILE, TERM_TILE, ITEM_TILE = 512, 2_048, 1_024
IMPACT = 10 ** 9
EXACT = 1 << 53


def terms_of(text: str) -> list[str]:
    return TERM.findall(text.encode().lower().decode())  # bytes know no other capitals than A-Z


def item_groups(items: DataFrame, group_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Groups of (item_id, text), about ``group_bytes`` each; one group at a time is on the driver."""
    texts = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    marked = texts.withColumn("_group", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)))
    for number in range(groups):
        rows = [tuple(r) for r in marked.where(F.col("_group") == number).select("item_id", "text").toLocalIterator()]
        if rows:
            yield rows


class ItemGroup:
    """Items of a group, their distinct terms, and the items of every term."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.items = [item for item, _ in rows]
        held = [sorted(set(terms_of(text))) for _, text in rows]
        self.number = {term: at for at, term in enumerate(sorted({t for terms in held for t in terms}))}
        self.terms = [np.array([self.number[t] for t in terms], np.int64) for terms in held]


def statistics(docs: DataFrame, group: ItemGroup) -> tuple[int, int, np.ndarray]:
    """N, L and, for every term of the group, the number of documents that hold it."""
    shared = docs.sparkSession.sparkContext.broadcast(group.number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        held, total, found = 0, 0, Counter()
        for batch in batches:
            for text in batch.column("text"):
                terms = terms_of(text.as_py())
                held += bool(terms)
                total += len(terms)
                found.update(number.keys() & terms)
        # Two further rows: the documents with a term, and all terms with their repeats.
        rows = [(-2, held), (-1, total), *((number[t], n) for t, n in found.items())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["term", "n"]
        )

    counted = id_and_text(docs).select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    df, sums = np.zeros(len(group.number), np.int64), {-2: 0, -1: 0}
    for term, n in counted.collect():  # as many rows as the group has terms
        if term < 0:
            sums[term] = n
        else:
            df[term] = n
    return sums[-2], sums[-1], df


def term_weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Tiles:
    """Scores of blocks of documents for all items of a group, and the best so far of each item."""

    def __init__(self, group: ItemGroup, df: np.ndarray, n: int, length: int, k: int):
        self.group, self.n, self.length, self.k = group, n, length, k
        self.weights = term_weights(df, n)
        # A partial sum has at most one product a term, each under the largest weight times the largest impact.
        most = max(int(self.weights.max(initial=1)), 1) * (IMPACT // 1000)
        self.width = max(1, min(TERM_TILE, (EXACT - 1) // most))
        self.best = {at: [] for at in range(len(group.items))}
        self.weight_tiles: dict[tuple[int, int], np.ndarray] = {}

    def weight_tile(self, start: int, first: int) -> np.ndarray:
        """Weights of the terms from ``start`` on for the items from ``first`` on."""
        key = start, first
        if key not in self.weight_tiles:
            if len(self.weight_tiles) * self.width * ITEM_TILE * 8 > 256 << 20:
                self.weight_tiles.clear()
            items = self.group.terms[first:first + ITEM_TILE]
            tile = np.zeros((min(self.width, len(self.weights) - start), len(items)))
            for at, terms in enumerate(items):
                own = terms[np.searchsorted(terms, start):np.searchsorted(terms, start + self.width)]
                tile[own - start, at] = self.weights[own]
            self.weight_tiles[key] = tile
        return self.weight_tiles[key]

    def add(self, ids: list, found: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
        """A block of documents: the id of each, its terms of the group in ascending order, their counts, all its terms."""
        lengths = np.array([len(f[0]) for f in found])
        rows = np.repeat(np.arange(len(ids)), lengths)
        terms = np.concatenate([f[0] for f in found])
        tf = np.concatenate([f[1] for f in found])
        m = np.array([50 + 50 * f[2] * self.n // self.length for f in found], np.int64)[rows]
        impacts = IMPACT * tf // (1000 * tf + 20 * m)
        order = np.argsort(terms, kind="stable")
        rows, terms, impacts = rows[order], terms[order], impacts[order]
        for first in range(0, len(self.group.items), ITEM_TILE):
            count = min(ITEM_TILE, len(self.group.items) - first)
            scores = np.zeros((len(ids), count), np.int64)
            for start in range(0, len(self.weights), self.width):
                a, b = np.searchsorted(terms, [start, start + self.width])
                if a == b:
                    continue
                tile = np.zeros((len(ids), min(self.width, len(self.weights) - start)))
                tile[rows[a:b], terms[a:b] - start] = impacts[a:b]
                scores += (tile @ self.weight_tile(start, first)).astype(np.int64)
            self.keep(ids, scores, first)

    def keep(self, ids: list, scores: np.ndarray, first: int) -> None:
        """The block's best of each item join the best so far; all that tie with the last place are looked at."""
        take = min(self.k, len(ids))
        # The k-th score of the block: nothing under it can be among the best.
        floors = np.partition(scores, len(ids) - take, axis=0)[len(ids) - take]
        for at in range(scores.shape[1]):
            held = self.best[first + at]
            least = max(int(floors[at]), 1, -held[-1][0] if len(held) == self.k else 1)
            near = np.flatnonzero(scores[:, at] >= least)
            if len(near):
                held += [(-int(scores[d, at]), ids[d] is None, ids[d] or 0) for d in near]
                held.sort()
                del held[self.k:]

    def rows(self) -> Iterator[tuple]:
        for at, held in self.best.items():
            for score, unnamed, doc in held:
                yield self.group.items[at], at, None if unnamed else doc, -score


def _scored(docs: DataFrame, group: ItemGroup, k: int) -> DataFrame:
    n, length, df = statistics(docs, group)
    shared = docs.sparkSession.sparkContext.broadcast((group, df, n, length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts, documents, terms = shared.value
        tiles = Tiles(own, counts, documents, terms, k)
        number, ids, found = own.number, [], []
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = terms_of(text.as_py())
                tf = Counter(words)
                here = sorted((number[t], tf[t]) for t in number.keys() & tf.keys())
                if here:
                    pair = np.array(here, np.int64)
                    ids.append(doc)
                    found.append((pair[:, 0], pair[:, 1], len(words)))
                if len(ids) == DOCUMENT_TILE:
                    tiles.add(ids, found)
                    ids, found = [], []
        if ids:
            tiles.add(ids, found)
        rows = list(tiles.rows())
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["item_id", "_item", "doc_id", "score"]
        )

    return id_and_text(docs).mapInArrow(run, "item_id bigint, _item bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 50, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item with a score above 0.

    Equal scores go by ascending ``doc_id`` (null last).  Null or empty texts hold no term: as documents they
    count nowhere, as items they find nothing.  Equal rows of documents are documents of their own; equal
    rows of items are one item, rows of one ``item_id`` with different texts are ranked apart.  Empty tables give
    no rows; other columns are not read; long texts are read whole.

    Documents are scanned twice for each group of items of about ``group_bytes``: for the counts, and for the
    scores.  The vocabulary that is broadcast is that of one group, so its size is bounded however many items
    there are.  A task sends on its own best ``k`` of every item, so nothing else is shuffled.
    """
    spark = docs.sparkSession
    best = None
    for number, rows in enumerate(item_groups(items, group_bytes)):
        scored = _scored(docs, ItemGroup(rows), k).withColumn("_group", F.lit(number))
        best = scored if best is None else best.unionByName(scored)
    if best is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    # In two steps, so that the lists of very many tasks do not all meet in one.
    parts = best.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    first = parts.withColumn("_row", F.row_number().over(Window.partitionBy("_group", "_item", "_part").orderBy(*order)))
    short = first.where(F.col("_row") <= k)
    rank = F.row_number().over(Window.partitionBy("_group", "_item").orderBy(*order))
    return short.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = f"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM_SQL}')) AS term FROM documents
), counts AS (
    SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), lengths AS (
    SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY ALL
), totals AS (
    SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths
), wanted AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM_SQL}')) AS term FROM benchmark
), weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM counts, totals GROUP BY term
), scores AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM wanted JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id), totals
    GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 50
"""
