"""Best-fit packing of token pieces into sequences under several capacities at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.bpe import encode_packed
from maskloom.llm.common import id_and_text
from maskloom.session import cut

# Rows that one packing task takes on average; at most one poorly filled bin in thousands is due to it.
PIECES_A_PART = 60_000


class VectorBestFit:
    """Open bins with residual tokens, documents and attention cost (the sum of squared lengths).

    A piece takes its need off all three.  Of the bins that hold it under every constraint it goes
    where the weighted norm of the residual left over is least, each capacity scaled to one.  Bins are
    kept by residual tokens: the token term alone bounds the norm from below, so the search ends at
    the first residual that cannot beat the best bin seen.
    """

    def __init__(self, tokens: int, documents: int, cost: int, weights=(1.0, 0.001, 0.001)):
        self.full = (tokens, documents, cost)
        self.scale = [w / c for w, c in zip(weights, self.full)]
        self.open = [{} for _ in range(tokens + 1)]  # residual tokens -> {(documents, cost): [(bin, used)]}
        self.filled = 0  # bit r: some open bin has r tokens left
        self.bins = 0

    def norm(self, residual) -> float:
        return sum((s * r) ** 2 for s, r in zip(self.scale, residual))

    def place(self, length: int) -> tuple[int, int]:
        """The bin and offset of a piece of ``length`` tokens."""
        need = (length, 1, length * length)
        best, best_norm = None, None
        left = self.filled >> length
        tokens = length
        while left:
            skip = (left & -left).bit_length() - 1
            tokens += skip
            left >>= skip
            if best is not None and (self.scale[0] * (tokens - length)) ** 2 > best_norm:
                break
            for documents, cost in self.open[tokens]:
                if documents >= 1 and cost >= need[2]:
                    after = (tokens - length, documents - 1, cost - need[2])
                    norm = self.norm(after)
                    if best is None or norm < best_norm:
                        best, best_norm = ((tokens, documents, cost), after), norm
            tokens += 1
            left >>= 1
        if best is None:
            number, used = self.bins, 0
            self.bins += 1
            after = tuple(f - n for f, n in zip(self.full, need))
            if min(after) < 0:
                raise ValueError("a piece is larger than an empty sequence")
        else:
            (tokens, *rest), after = best
            group = self.open[tokens]
            number, used = group[tuple(rest)].pop()
            if not group[tuple(rest)]:
                del group[tuple(rest)]
                if not group:
                    self.filled &= ~(1 << tokens)
        if after[0] and after[1] and after[2]:
            self.open[after[0]].setdefault(after[1:], []).append((number, used + length))
            self.filled |= 1 << after[0]
        return number, used


def pieces(docs: DataFrame, path: str, tokens: int, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: every document's ids and an end id, cut where too long.

    Null and empty texts are one piece with the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encode_packed(path)
        end = int(end_id).to_bytes(4, "little")
        step = 4 * tokens
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode(text.as_py()) + end
                for number, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    rows.append((doc, number, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return id_and_text(docs).mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def pack(
    cut_up: DataFrame, tokens: int, documents: int | None = None, cost: int | None = None,
    pieces_a_part: int = PIECES_A_PART,
) -> DataFrame:
    """``cut_up`` with ``sequence_id`` and ``offset``.

    Pieces are dealt by a hash to parts of about ``pieces_a_part`` rows, longest first within a part,
    and each part packs its own sequences; whole sequences need no company and stay out of the search.
    Without ``documents`` or ``cost`` those capacities are as large as ``tokens`` allows.
    """
    documents = documents or tokens
    cost = cost or tokens * tokens
    rows = cut_up.count()
    parts = max(1, -(-rows // pieces_a_part))
    names = cut_up.columns
    dealt = cut_up.withColumn("_part", F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int"))
    order = ["_part", F.desc("length"), *[n for n in names if n != "length"]]
    sorted_ = dealt.repartition(parts, "_part").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, fit = None, None
        for batch in batches:
            numbers = np.empty(batch.num_rows, dtype=np.int64)
            offsets = np.empty(batch.num_rows, dtype=np.int64)
            for at, (own, length) in enumerate(zip(batch.column("_part").to_pylist(), batch.column("length").to_pylist())):
                if own != part:
                    part, fit = own, VectorBestFit(tokens, documents, cost)
                number, offsets[at] = fit.place(length)
                numbers[at] = own << 40 | number
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(numbers), pa.array(offsets)],
                names=[*names, "sequence_id", "offset"],
            )

    fields = ", ".join(f"`{n}` {t}" for n, t in cut_up.dtypes)
    return sorted_.mapInArrow(run, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, tokens: int = 2048) -> DataFrame:
    """Every piece of every document with its sequence and place.

    The pieces, a few numbers each, are written once: they are counted and then packed.  An empty
    table packs to nothing; repeated rows and null ids are packed like any other.
    """
    return pack(cut(pieces(docs, path, tokens)), tokens)
