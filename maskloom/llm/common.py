"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone (null text is empty), so clashing extra columns never travel."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


class RecentCache(dict):
    """Results of ``compute`` by key, in two generations of bounded size.

    When the young generation is full it becomes the old one; keys still in use move over, rare keys
    are dropped.  Keys longer than ``longest`` are not kept, so memory stays bounded on odd texts.
    """

    def __init__(self, compute: Callable, limit: int = 200_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most_bytes`` in ``column`` each (one long row stays whole)."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        start, held = 0, 0
        for at, n in enumerate(lengths):
            if held and held + (n or 0) > most_bytes:
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)
