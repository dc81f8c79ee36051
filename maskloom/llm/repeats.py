"""Byte strings that occur more than once, found with enhanced suffix arrays and removed.

Every window of ``length`` bytes is filed under the least hash of its grams, so equal windows meet
under one key and a key's windows are consecutive bytes, a *piece*.  Keys that occur once hold nothing
that repeats.  The pieces of a repeated key, equal ones counted as one, are sorted as suffixes; a
stack scan over neighbours' common prefixes lists the tree's intervals, and an interval whose
occurrences have different bytes on their left is a maximal repeat group with all its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from maskloom.llm.common import id_and_text, small_batches
from maskloom.session import cut

U = np.uint64
GRAM = 48
BATCH_BYTES = 1 << 20
# Windows of a piece, so that one endlessly repeated byte makes many equal pieces.
PIECE_WINDOWS = 512
# Suffix arrays are built over so many bytes of pieces at once, whole keys together.
ARRAY_BYTES = 1 << 20
# Keys with more distinct pieces are filed again under whole windows.
KEY_PIECES = 2000


def _byte_codes() -> np.ndarray:
    """A fixed odd-looking 64-bit code per byte."""
    x = (np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) ^ U(0x632BE59BD9B4E019)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


CODES = _byte_codes()
BASE = U(0x5851F42D4C957F2D)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all grams of 48 bytes, by doubling."""
    with np.errstate(over="ignore"):
        codes, power, by_length = CODES[data], BASE, {}
        for step in (1, 2, 4, 8, 16):
            if step == 16:
                by_length[16] = (codes, power)
            codes = codes[:-step] * power + codes[step:]
            power = power * power
        short, factor = by_length[16]
        joined = codes[:-16] * factor + short[32:]
        joined = (joined ^ (joined >> U(31))) * U(0xD6E8FEB86659FD93)
        return joined ^ (joined >> U(32))


def window_keys(hashes: np.ndarray, length: int) -> np.ndarray:
    """The least gram hash of every window."""
    least = hashes
    grams, step = length - GRAM + 1, 1
    while 2 * step <= grams:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    rest = grams - step
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


def own_repeats(hashes: np.ndarray, keys: np.ndarray, starts: np.ndarray, grams: int) -> np.ndarray:
    """Indices of the pieces whose key is the hash of several of their grams: a window may repeat inside."""
    small = np.flatnonzero(hashes <= keys.max())
    piece = np.searchsorted(starts, np.maximum(small - grams + 1, 0), side="right") - 1
    last = np.searchsorted(starts, np.minimum(small, len(keys) - 1), side="right") - 1
    times = np.zeros(len(starts), np.int64)
    while len(small):
        np.add.at(times, piece[hashes[small] == keys[starts[piece]]], 1)
        more = piece < last
        small, piece, last = small[more], piece[more] + 1, last[more]
    return np.flatnonzero(times > 1)


def pieces_of(text: bytes, length: int, doubled: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, starts and window counts of a text's pieces; ``doubled`` adds the keys that count twice."""
    hashes = gram_hashes(np.frombuffer(text, np.uint8))
    keys = window_keys(hashes, length)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    runs = np.diff(np.append(starts, len(keys)))
    if runs.max() > PIECE_WINDOWS:
        cuts = [np.arange(s, s + n, PIECE_WINDOWS) for s, n in zip(starts, runs)]
        starts = np.concatenate(cuts)
        runs = np.diff(np.append(starts, len(keys)))
    own = keys[starts]
    if doubled:
        own = np.concatenate([own, own[own_repeats(hashes, keys, starts, length - GRAM + 1)]])
    return own.view(np.int64), starts, runs


def piece_keys(docs: DataFrame, length: int) -> DataFrame:
    """``key`` of every piece, twice if the piece may repeat a part of itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            keys = [np.empty(0, np.int64)]
            for text in batch.column("text").cast(pa.binary()):
                raw = text.as_py()
                if len(raw) >= length:
                    keys.append(pieces_of(raw, length, doubled=True)[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys))], names=["key"])

    return docs.select("text").mapInArrow(run, "key bigint")


def piece_rows(docs: DataFrame, length: int) -> DataFrame:
    """``key, body`` (a hash of its bytes), ``doc_id, tag, start, windows`` of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            keys, bodies, starts, windows, rows = [np.empty(0, np.int64)], [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
            for row, text in enumerate(batch.column("text").cast(pa.binary())):
                raw = text.as_py()
                if len(raw) < length:
                    continue
                key, start, count = pieces_of(raw, length)
                keys.append(key)
                starts.append(start)
                windows.append(count)
                rows.append(np.full(len(key), row))
                ends = start + count + (length - 1)
                bodies += [xxh3_64_intdigest(raw[s:e]) for s, e in zip(start.tolist(), ends.tolist())]
            at = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.array(bodies, U).view(np.int64)),
                 batch.column("doc_id").take(at), batch.column("tag").take(at),
                 pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(windows).astype(np.int32))],
                names=["key", "body", "doc_id", "tag", "start", "windows"],
            )

    return docs.mapInArrow(run, "key bigint, body bigint, doc_id bigint, tag int, start int, windows int")


def common_prefixes(sums: np.ndarray, inverse: np.ndarray, left, right, most, least: int) -> np.ndarray:
    """Lengths of the common prefixes of suffix pairs, by bisection over hashes of substrings."""
    low, high = np.zeros(len(left), np.int64), most.copy()
    fits = lambda n: (sums[left + n] - sums[left]) * inverse[left] == (sums[right + n] - sums[right]) * inverse[right]
    with np.errstate(over="ignore"):
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = fits(middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def maximal_repeats(pieces: list[bytes], keys: list[int], length: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeat groups of at least ``length`` bytes among pieces of one key: ``(size, [(piece, offset)])``.

    All occurrences of a group are listed, overlapping ones and ones in the same piece too.  A piece's
    first byte has no left neighbour and counts as differing from any other.
    """
    text = b"".join(pieces)
    data = np.frombuffer(text, np.uint8)
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    # Suffixes long enough to hold a window.
    starts = np.concatenate([np.arange(b, e - length + 1) for b, e in zip(begins, ends)])
    owner = np.repeat(np.arange(len(pieces)), sizes - length + 1)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(data) + 1, BASE))
        inverse = np.cumprod(np.full(len(data) + 1, U(pow(int(BASE), -1, 1 << 64))))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(CODES[data] * powers[:-1])])
        window = (sums[starts + length] - sums[starts]) * inverse[starts]
        window ^= np.array(keys, np.int64).view(U)[owner] * U(0x9E3779B97F4A7C15)
    # Only suffixes whose first window has a fellow can be in an interval.
    order = np.argsort(window, kind="stable")
    fellow = window[order][1:] == window[order][:-1]
    shared = np.zeros(len(order), bool)
    shared[order[1:]] |= fellow
    shared[order[:-1]] |= fellow
    starts, owner = starts[shared], owner[shared]
    if not len(starts):
        return
    limits = ends[owner]
    tails = [text[s:e] for s, e in zip(starts.tolist(), limits.tolist())]
    of_key = [keys[o] for o in owner.tolist()]
    rank = sorted(range(len(tails)), key=lambda i: (of_key[i], tails[i]))
    starts, owner, limits = starts[rank], owner[rank], limits[rank]
    prefix = common_prefixes(
        sums, inverse, starts[:-1], starts[1:], np.minimum(limits[:-1] - starts[:-1], limits[1:] - starts[1:]), length
    )
    key_of = np.array(keys, np.int64)[owner]
    prefix[key_of[:-1] != key_of[1:]] = 0
    before = np.where(starts > begins[owner], data[np.maximum(starts - 1, 0)].astype(np.int64), -1 - np.arange(len(starts)))
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    offsets = (starts - begins[owner]).tolist()
    owner = owner.tolist()
    stack = []  # (common prefix, first suffix)
    heights = prefix.tolist()
    for at in range(len(owner)):
        height = heights[at] if at < len(heights) else 0
        first = at
        while stack and stack[-1][0] > height:
            size, first = stack.pop()
            if size >= length and changes[at] > changes[first]:
                yield size, [(owner[i], offsets[i]) for i in range(first, at + 1)]
        if height >= length and (not stack or stack[-1][0] < height):
            stack.append((height, first))


def _covered(pieces: list[bytes], keys: list[int], counts: list[int], length: int) -> list[list[int]]:
    """Per piece, the covered stretches as a flat list ``start, end, start, end ...``."""
    reach = [dict() for _ in pieces]  # offset -> furthest end of a repeat that starts there
    for size, places in maximal_repeats(pieces, keys, length):
        for piece, offset in places:
            if reach[piece].get(offset, 0) < offset + size:
                reach[piece][offset] = offset + size
    out = []
    for piece, count, own in zip(pieces, counts, reach):
        if count > 1:  # equal pieces are one interval, the piece as a whole
            out.append([0, len(piece)])
            continue
        flat = []
        for start in sorted(own):
            if flat and start <= flat[-1]:
                flat[-1] = max(flat[-1], own[start])
            else:
                flat += [start, own[start]]
        out.append(flat)
    return out


def class_stretches(texts: DataFrame, length: int) -> DataFrame:
    """``key, body, stretches`` of pieces ``key, body, n, piece`` that hold something repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows):
            # A class comes once for every row that its first document repeats.
            keys, bodies, counts, pieces = zip(*{(r[0], r[1]): r for r in rows}.values())
            got = [(k, b, s) for k, b, s in zip(keys, bodies, _covered(pieces, keys, counts, length)) if s]
            columns = list(zip(*got)) if got else [[]] * 3
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.list_(pa.int32()))], names=["key", "body", "stretches"],
            )

        held, size = [], 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("key", "body", "n", "piece")]):
                if size >= ARRAY_BYTES and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield flush(held)

    by_key = texts.select("key", "body", "n", "piece").repartition("key").sortWithinPartitions("key")
    return by_key.mapInArrow(run, "key bigint, body bigint, stretches array<int>")


def window_stretches(texts: DataFrame, length: int) -> DataFrame:
    """``key, body, stretches`` where a key has too many pieces for one task: a passage of very many texts.

    Each window becomes a piece of its own, filed under the hash of all its bytes, so what meets under
    a key is equal and only has to be counted, ahead of the exchange.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "piece", BATCH_BYTES):
            for row in zip(*[batch.column(c).to_pylist() for c in ("key", "body", "n", "piece")]):
                piece = row[3]
                count = len(piece) - length + 1
                hashes = [xxh3_64_intdigest(piece[at:at + length]) for at in range(count)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(hashes, U).view(np.int64)), pa.array(np.full(count, row[0])),
                     pa.array(np.full(count, row[1])), pa.array(np.full(count, row[2])), pa.array(np.arange(count, dtype=np.int32))],
                    names=["window", "key", "body", "n", "at"],
                )

    windows = texts.mapInArrow(run, "window bigint, key bigint, body bigint, n bigint, at int")
    twice = windows.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window")
    return windows.join(twice, "window", "left_semi").groupBy("key", "body").agg(
        F.flatten(F.collect_list(F.array(F.col("at"), F.col("at") + length))).alias("stretches")
    )


def class_texts(docs: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """``key, body, n, piece``: the bytes of one piece per class, cut from the text of its first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            rows = []
            for text, wanted in zip(batch.column("text").cast(pa.binary()), batch.column("wanted").to_pylist()):
                raw = text.as_py()
                for w in wanted:
                    rows.append((w["key"], w["body"], w["n"], raw[w["start"]:w["start"] + w["windows"] + length - 1]))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.binary())],
                names=["key", "body", "n", "piece"],
            )

    wanted = classes.groupBy(F.col("rep.doc_id").alias("_doc"), F.col("rep.tag").alias("_tag")).agg(
        F.collect_list(F.struct("key", "body", "n", F.col("rep.start").alias("start"), "windows")).alias("wanted")
    )
    met = _with(docs, wanted, "inner").select("text", "wanted")
    return met.mapInArrow(run, "key bigint, body bigint, n bigint, piece binary")


def _with(docs: DataFrame, other: DataFrame, how: str) -> DataFrame:
    same = docs["doc_id"].eqNullSafe(other["_doc"]) & (docs["tag"] == other["_tag"])
    return docs.hint("merge").join(other, same, how)


def repeated_stretches(docs: DataFrame, length: int) -> DataFrame:
    """``doc_id, tag, stretches``: per text the covered stretches, unsorted and overlapping."""
    found = piece_keys(docs, length).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    rows = cut(piece_rows(docs, length).hint("merge").join(found.hint("merge"), "key", "left_semi"))
    classes = cut(rows.groupBy("key", "body").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "tag", "start")).alias("rep"), F.min("windows").alias("windows")
    ))
    wide = classes.groupBy("key").agg(F.count("*").alias("bodies")).where(F.col("bodies") > KEY_PIECES).select("key")
    narrow = class_texts(docs, classes.join(wide, "key", "left_anti"), length)
    broad = class_texts(docs, classes.join(wide, "key", "left_semi"), length)
    stretches = class_stretches(narrow, length).unionByName(window_stretches(broad, length))
    placed = rows.select("key", "body", "doc_id", "tag", "start").join(stretches, ["key", "body"]).select(
        "doc_id", "tag", F.transform("stretches", lambda at: at + F.col("start")).alias("moved")
    )
    return placed.groupBy(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag")).agg(
        F.flatten(F.collect_list("moved")).alias("stretches")
    )


def tagged(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, text``: an id and a checksum of the text tell rows apart, repeated and null ids too."""
    return id_and_text(docs).withColumn("tag", F.hash("text"))


def merged(flat: list[int] | None) -> list[tuple[int, int]]:
    """Sorted, disjoint stretches; touching ones become one."""
    if not flat:
        return []
    out = []
    for start, end in sorted(zip(flat[::2], flat[1::2])):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and the ``spans`` removed, per row of ``docs``.

    A byte goes when a string of ``length`` bytes that covers it starts anywhere else, in the same
    text or another; strings are judged on the input.  Null texts are empty, and texts shorter than
    ``length`` keep all.  Repeated rows repeat each other's text.  ``length`` is at least 64.
    """
    texts = tagged(docs)
    stretches = repeated_stretches(texts, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, flat in zip(batch.column("text").cast(pa.binary()), batch.column("stretches").to_pylist()):
                raw, spans, kept, at = text.as_py(), merged(flat), hashlib.sha256(), 0
                for start, end in spans:
                    kept.update(raw[at:start])
                    at = end
                kept.update(raw[at:])
                gone = sum(e - s for s, e in spans)
                rows.append((len(raw), gone, len(spans), kept.hexdigest(), ",".join([f"{s}:{e}" for s, e in spans])))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]],
                 *[pa.array(c, pa.string()) for c in columns[3:]]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return _with(texts, stretches, "left").select("doc_id", "text", "stretches").mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans string"
    )
