"""Byte-level byte-pair encoding and decoding by ranks, in overlapping chunks.

A text longer than a chunk is cut into chunks that overlap.  Each is pre-tokenised by itself, from an
arbitrary place, so its first pre-tokens may be wrong; where two neighbours end a pre-token at one place in
their overlap they agree from there on, and the text is stitched there.  What a chunk holds from its own
seam to the next one is encoded; the ids of a text follow in chunk order.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import RecentCache, id_and_text

CHUNK = 32_768
OVERLAP = 1_024
# A pre-token is decided by at most two characters behind its end (a contraction, a look ahead).
LOOK_AHEAD = 4
SHORT = 64
NO_MERGE = 1 << 40
RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


@functools.lru_cache(maxsize=8)
def class_members(kind: str) -> tuple[int, ...]:
    """Code points of a character class such as ``\\p{L}`` as the encoding library's own Unicode tables have it."""
    letters = {bytes([b]): b for b in range(256)}
    probe = tiktoken.Encoding(f"class {kind}", pat_str=kind, mergeable_ranks=letters, special_tokens={})
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    return tuple(map(ord, bytes(probe.encode_ordinary(every)).decode()))


def class_ranges(kind: str, last: int) -> str:
    """The class as the inside of a bracket expression of ``re``, up to a code point."""
    parts, start, before = [], None, None
    for point in [*(p for p in class_members(kind) if p <= last), None]:
        if before is None or point != before + 1:
            if before is not None:
                parts.append(rf"\U{start:08x}-\U{before:08x}")
            start = point
        before = point
    return "".join(parts)


@functools.lru_cache(maxsize=8)
def compiled(pattern: str, last: int) -> re.Pattern:
    """The pattern with its classes spelled out, for texts without code points above ``last``.

    ``re`` looks classes of 16-bit characters up in a table, which makes it several times as fast as a search
    by properties, and the tables are those of the encoding library.
    """
    def inside(text: str) -> str:
        return re.sub(r"\\p\{\w+\}|\\s", lambda m: class_ranges(m[0], last), text)

    def spelled(match: re.Match) -> str:
        if match[0].startswith("["):
            return inside(match[0])
        return f"[^{class_ranges(match[0].lower(), last)}]" if match[0] == r"\S" else f"[{inside(match[0])}]"

    return re.compile(re.sub(r"\[[^\]]*\]|\\p\{\w+\}|\\[sS]", spelled, pattern))


class ByteRanks:
    """A rank file (base64 bytes and rank a line) with the pattern that splits texts into pre-tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = pattern
        # After these a pre-token ends whatever came before: no pre-token goes on from a letter or number to
        # another kind, or from anything else into white space.
        self.certain = r"[\p{L}\p{N}](?=[^\p{L}\p{N}])|\S(?=\s)"
        self.packed = RecentCache(lambda piece: array("I", self.encode_piece(piece.encode())).tobytes(), 500_000)

    def encode_piece(self, raw: bytes) -> list[int]:
        """Ids of one pre-token: the pair of least rank merges first, the leftmost of equal ones."""
        ranks = self.ranks
        if raw in ranks:
            return [ranks[raw]]
        if len(raw) <= SHORT:
            return self.encode_short(raw)
        parts = [raw[i:i + 1] for i in range(len(raw))]
        count = len(parts)
        rank_of, push, pop = ranks.get, heapq.heappush, heapq.heappop
        pair_rank = [rank_of(parts[i] + parts[i + 1], -1) for i in range(count - 1)] + [-1]
        heap = [rank << 40 | at for at, rank in enumerate(pair_rank) if rank >= 0]
        heapq.heapify(heap)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        while heap:
            entry = pop(heap)
            at = entry & 0xFFFFFFFFFF
            if pair_rank[at] != entry >> 40:
                continue  # stale: one of the two was merged since
            gone = after[at]
            parts[at] += parts[gone]
            parts[gone] = None
            pair_rank[gone] = -1
            after[at] = beyond = after[gone]
            pair_rank[at] = -1
            if beyond < count:
                before[beyond] = at
                pair_rank[at] = rank = rank_of(parts[at] + parts[beyond], -1)
                if rank >= 0:
                    push(heap, rank << 40 | at)
            previous = before[at]
            if previous >= 0:
                pair_rank[previous] = rank = rank_of(parts[previous] + parts[at], -1)
                if rank >= 0:
                    push(heap, rank << 40 | previous)
        return [ranks[part] for part in parts if part is not None]

    def encode_short(self, raw: bytes) -> list[int]:
        """The same merges by looking over the few pairs each time."""
        rank_of = self.ranks.get
        parts = [raw[i:i + 1] for i in range(len(raw))]
        pairs = [rank_of(raw[i:i + 2], NO_MERGE) for i in range(len(raw) - 1)]
        while pairs:
            least = min(pairs)
            if least == NO_MERGE:
                break
            at = pairs.index(least)
            del pairs[at]
            parts[at] += parts.pop(at + 1)
            if at < len(pairs):
                pairs[at] = rank_of(parts[at] + parts[at + 1], NO_MERGE)
            if at:
                pairs[at - 1] = rank_of(parts[at - 1] + parts[at], NO_MERGE)
        return [self.ranks[part] for part in parts]

    def splitter(self, text: str, pattern: str | None = None) -> re.Pattern:
        narrow = text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text)
        return compiled(pattern or self.pattern, 0xFFFF if narrow else 0x10FFFF)

    def pretokens(self, text: str, start: int = 0, stop: int | None = None) -> list[str]:
        """Pre-tokens from one known boundary of the text to another, decided by all that follows them."""
        find = self.splitter(text)
        if stop is None or stop >= len(text):
            return find.findall(text, start)
        found = find.findall(text, start, stop + LOOK_AHEAD)
        held = sum(map(len, found))
        while held > stop - start:
            held -= len(found.pop())
        if held != stop - start:
            raise ValueError("the stop is no pre-token boundary")
        return found

    def encode_packed(self, pieces: list[str]) -> bytes:
        """Ids of the pre-tokens as little-endian unsigned 32-bit integers."""
        packed = self.packed
        return b"".join([packed[piece] for piece in pieces])

    def encode(self, text: str) -> list[int]:
        return list(array("I", self.encode_packed(self.pretokens(text))))

    def decode_bytes(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", packed)))

    def chunks(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
        """``number, step, body``: the next chunk starts ``step`` characters into the body (0: there is none).

        A body reaches ``overlap`` characters into the next chunk and on to the first place where any
        pre-tokenisation has a boundary, so that neighbours always meet.  When that place is far (a
        pre-token of a million letters), the next chunk starts near it instead.
        """
        certain = self.splitter(text, self.certain)
        number, start = 0, 0
        while len(text) - start > size:
            seam = certain.search(text, start + size + overlap)
            reach = seam.end() if seam else len(text)
            step = max(size, reach - start - size - overlap)
            yield number, step, text[start:reach + 2 * LOOK_AHEAD]
            number, start = number + 1, start + step
        yield number, 0, text[start:]

    def seam(self, body: str, step: int, start: int = 0) -> int:
        """The first place from ``step`` on where the pre-tokens of the body and of the next chunk both end.

        Counted from the start of the body.  Places at the very end of the body count only if they do
        not depend on the text beyond, which the reach of :meth:`chunks` allows for.
        """
        find = self.splitter(body)
        own = {m.end() for m in find.finditer(body, start) if m.end() >= step}
        if step in own:
            return step
        for match in find.finditer(body[step:]):
            if step + match.end() in own:
                return step + match.end()
        raise ValueError("neighbouring chunks do not meet")


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteRanks:
    """One copy a Python worker, kept between tasks."""
    return ByteRanks(path, pattern)


def digests(ranks: ByteRanks, packed: bytes) -> tuple[int, str, str]:
    return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(ranks.decode_bytes(packed)).hexdigest()


def stitched(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``key, doc_id, number, ids``: the ids of every stretch between two seams of the texts longer than a chunk.

    ``key`` names id and text; equal rows share it, and each keeps its own copies of the stretches.  The
    chunks are dealt once by key and number, so a very long text is spread over tasks; seams travel as
    numbers.
    """

    def chop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load(path, pattern)
        for batch in batches:
            for at, text in enumerate(batch.column("text")):
                rows = list(ranks.chunks(text.as_py(), chunk, overlap))
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([batch.column(n)[at].as_py()] * len(rows), batch.column(n).type) for n in ("key", "doc_id")],
                     pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([r[2] for r in rows], pa.string())],
                    names=["key", "doc_id", "number", "step", "body"],
                )

    def seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load(path, pattern)
        for batch in batches:
            rows = [(r["key"], r["number"] + 1, ranks.seam(r["body"], r["step"]) - r["step"])
                    for r in batch.select(["key", "number", "step", "body"]).to_pylist() if r["step"]]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("key", "number", "seam"), row)) for row in rows],
                pa.schema([("key", pa.string()), ("number", pa.int64()), ("seam", pa.int64())]),
            )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load(path, pattern)
        for batch in batches:
            ids = []
            for step, body, own in zip(*[batch.column(n).to_pylist() for n in ("step", "body", "seam")]):
                stop = ranks.seam(body, step) if step else None
                ids.append(ranks.encode_packed(ranks.pretokens(body, own, stop)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("key", "doc_id", "number")] + [pa.array(ids, pa.binary())],
                names=["key", "doc_id", "number", "ids"],
            )

    long = id_and_text(docs).where(F.length("text") > chunk).withColumn(
        "key", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), "text"), 256)
    )
    dealt = long.mapInArrow(chop, "key string, doc_id bigint, number bigint, step bigint, body string").repartition("key", "number")
    found = dealt.mapInArrow(seams, "key string, number bigint, seam bigint").distinct()
    met = dealt.join(found, ["key", "number"], "left").withColumn("seam", F.coalesce("seam", F.lit(0).cast("bigint")))
    return met.mapInArrow(encode, "key string, doc_id bigint, number bigint, ids binary")


def round_trip(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Encode every text and decode the ids: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    One row per row of ``docs``, equal rows and null ids included; null and empty texts have no tokens and
    the digests of the empty string; an empty table gives an empty one; other columns are not read.
    Special tokens are plain text.  A text of one chunk is one stretch and is not shuffled; of longer
    texts the chunks and then the ids are.  Digests need the ids of a text in order, so one task
    streams over them; no task holds more than a chunk and a row.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load(path, pattern)
        for batch in batches:
            rows = [digests(ranks, ranks.encode_packed(ranks.pretokens(t.as_py()))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()),
                 *[pa.array([r[i] for r in rows], pa.string()) for i in (1, 2)]],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load(path, pattern)
        key = doc = number = ids_sha = text_sha = None
        copies = tokens = 0

        def ended():
            return [(doc, tokens, ids_sha.hexdigest(), text_sha.hexdigest())] * copies

        for batch in batches:
            out = []
            for own, own_doc, own_number, ids in zip(
                *[batch.column(n).to_pylist() for n in ("key", "doc_id", "number")], batch.column("ids")
            ):
                if own != key:
                    out += ended() if copies else []
                    key, doc, number, copies, tokens = own, own_doc, -1, 0, 0
                    ids_sha, text_sha = hashlib.sha256(), hashlib.sha256()
                copies += own_number == 0
                if own_number == number:
                    continue  # the same stretch of an equal row
                number = own_number
                packed = ids.as_py()
                tokens += len(packed) // 4
                ids_sha.update(packed)
                text_sha.update(ranks.decode_bytes(packed))
            yield rows_of(out)
        yield rows_of(ended() if copies else [])

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        )

    short = id_and_text(docs).where(F.length("text") <= chunk).mapInArrow(whole, RESULT)
    ordered = stitched(docs, path, pattern, chunk, overlap).repartition("key").sortWithinPartitions("key", "number")
    return short.unionByName(ordered.mapInArrow(join, RESULT))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` (array of int) of every text; an empty array for null or empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load(path, pattern)
        for batch in batches:
            ids = [ranks.encode(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    short = id_and_text(docs).where(F.length("text") <= CHUNK).mapInArrow(run, "doc_id bigint, ids array<int>")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [list(array("I", packed.as_py())) for packed in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("key", "doc_id", "number")] + [pa.array(ids, pa.list_(pa.int32()))],
                names=["key", "doc_id", "number", "ids"],
            )

    parts = stitched(docs, path, pattern).mapInArrow(unpack, "key string, doc_id bigint, number bigint, ids array<int>")
    joined = parts.groupBy("key", "doc_id", "number").agg(F.count("*").alias("copies"), F.first("ids").alias("ids"))
    whole = joined.groupBy("key", "doc_id").agg(
        F.max("copies").alias("copies"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("number", "ids"))), lambda s: s["ids"])).alias("ids"),
    )
    copies = whole.select("doc_id", "ids", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
    return short.unionByName(copies.select("doc_id", "ids"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, decoded`` (binary) of ``doc_id, ids``; null ids decode to nothing, unknown ids raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load(path, pattern).tokens
        for batch in batches:
            texts = [b"".join([tokens[i] for i in ids or ()]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "decoded"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded binary")
