"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids are linked.

Divide and conquer at shared cuts: an interval of tokens is divided at an end near its middle that both
tokenizers share, found by bisection, and both halves are divided again; an interval without such an end is a
group.  A text is first divided where a space or line feed follows a character that is no white space: there
both tokenizers always end a token, and nothing before such a place changes what comes after it.  These
parts repeat, so their groups are kept in a bounded cache.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskloom.llm.bpe import byte_letters
from maskloom.llm.common import RecentCache, id_and_text, small_batches
from maskloom.session import ensure_checkpoint_dir

BATCH_BYTES = 512 << 10
# Distinct id pairs of documents that share one answer in the second pass.
BLOCK_PAIRS = 1 << 19
MANY_LINKS = 64
# What either tokenizer might take for white space: no part is cut behind these.
WHITE = r"\s\x1c-\x1f\x85\xa0\u180e\u200b-\u200f\u2028\u2029\u202f\u205f-\u2064\u3000\ufeff"
ODD_CUT = re.compile(rf"\A[ \n]|[{WHITE}][ \n]")
IS_WHITE = re.compile(f"[{WHITE}]")
PART = re.compile(r"[ \n][^ \n]*")


def align(a_ends: list[int], b_ends: list[int]) -> list[tuple[int, int, int, int]]:
    """Groups ``(a from, a to, b from, b to)`` of tokens between the ends that both lists share, in order.

    Both lists ascend strictly and have one last end.  From the middle of an interval the search for a shared end
    goes outwards; what it walks over lies in one group, so all walks together stay linear.
    """
    groups, open_ = [], [(0, len(a_ends), 0, len(b_ends))] if a_ends else []
    while open_:
        a_from, a_to, b_from, b_to = open_.pop()
        # The last end of an interval is shared by itself and divides nothing.
        last = a_to - 1
        cut = None
        if last > a_from and b_to - b_from > 1:
            low = high = (a_from + last) // 2
            while low >= a_from or high < last:
                if low >= a_from:
                    other = bisect_left(b_ends, a_ends[low], b_from, b_to)
                    if b_ends[other] == a_ends[low]:
                        cut = low + 1, other + 1
                        break
                if low != high < last:
                    other = bisect_left(b_ends, a_ends[high], b_from, b_to)
                    if b_ends[other] == a_ends[high]:
                        cut = high + 1, other + 1
                        break
                low, high = low - 1, high + 1
        if cut:
            open_.append((cut[0], a_to, cut[1], b_to))
            open_.append((a_from, cut[0], b_from, cut[1]))
        else:
            groups.append((a_from, a_to, b_from, b_to))
    return groups


def parts_of(text: str) -> list[str]:
    """A space and the text, cut before each space or line feed that follows a character that is no white space."""
    parts = PART.findall(f" {text}")
    if not ODD_CUT.search(text):
        return parts
    joined, held = [], ""
    for part in parts:
        held += part
        if not IS_WHITE.match(held[-1]):
            joined.append(held)
            held = ""
    return [*joined, held] if held else joined


# Tokens and groups of a part: counts, the printed groups and its links, an id pair being ``a << 32 | b``.  Links name a
# pair once for each time it is linked; of groups with many links the last field holds the distinct pairs and their
# numbers.  Parts are plain tuples of plain values: the garbage collector does not visit them.
Part = tuple[int, int, int, str, bytes, tuple | None]


def make_part(a_ids: list[int], b_ids: list[int], groups: list[tuple[int, int, int, int]]) -> Part:
    printed, links, heavy = [], [], []
    for a_from, a_to, b_from, b_to in groups:
        if a_to - a_from == 1 and b_to - b_from == 1:
            a, b = a_ids[a_from], b_ids[b_from]
            printed.append(f"{a}|{b}")
            links.append(a << 32 | b)
            continue
        own, other = a_ids[a_from:a_to], b_ids[b_from:b_to]
        printed.append(f"{','.join(map(str, own))}|{','.join(map(str, other))}")
        if len(own) * len(other) <= MANY_LINKS:
            links += [a << 32 | b for a in own for b in other]
        else:
            others = Counter(other)
            heavy += [(a << 32 | b, n * m) for a, n in Counter(own).items() for b, m in others.items()]
    return len(a_ids), len(b_ids), len(groups), ";".join(printed), array("q", links).tobytes(), tuple(heavy) or None


class Aligner:
    """A byte-level tokenizers file (A) and a sentencepiece model that adds the leading space itself (B)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {letter: bytes([b]) for b, letter in enumerate(byte_letters())}
        self.a_bytes = {i: b"".join([byte_of.get(c, b"") for c in t]) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.space = self.b.piece_to_id("▁")
        if any("\n" in p or re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("B joins words or lines in one piece, so parts cannot be encoded apart")
        self.a_lengths = {i: len(raw) for i, raw in self.a_bytes.items()}
        self.b_lengths = [len(raw) for raw in self.b_bytes]
        self.cache = RecentCache(lambda part: self.compute([part])[0], 300_000)

    def compute(self, parts: list[str]) -> list[Part | None]:
        """What each part aligns to; None where the bytes of its tokens are not its own."""
        done = []
        a_bytes, a_length = self.a_bytes.__getitem__, self.a_lengths.__getitem__
        b_bytes, b_length = self.b_bytes.__getitem__, self.b_lengths.__getitem__
        a_all = self.a.encode_batch_fast(parts, add_special_tokens=False)
        # B adds the space that a part begins with, and one before a line feed, which stays a token of its own.
        b_all = self.b.encode([p.removeprefix(" ") for p in parts], num_threads=1)
        for part, a, b_ids in zip(parts, a_all, b_all):
            a_ids, raw = a.ids, part.encode()
            if part == " ":
                b_ids = [self.space]
            elif part[0] == "\n":
                del b_ids[0]
            if b"".join(map(a_bytes, a_ids)) == raw == b"".join(map(b_bytes, b_ids)):
                ends = list(accumulate(map(a_length, a_ids))), list(accumulate(map(b_length, b_ids)))
                done.append(make_part(a_ids, b_ids, align(*ends)))
            else:
                done.append(None)
        return done

    def look_up(self, parts: Iterable[str]) -> dict[str, Part | None]:
        """All parts of a batch at once: unknown ones are encoded together."""
        cache, known, unknown = self.cache, {}, []
        for part in parts:
            held = cache.get(part, 0)
            if held == 0:
                held = cache.old.get(part, 0)
            if held == 0:
                unknown.append(part)
            else:
                known[part] = held
        for part, made in zip(unknown, self.compute(unknown) if unknown else ()):
            known[part] = made
            if len(part) <= cache.longest:
                if len(cache) >= cache.limit:
                    cache.old = dict(cache)
                    cache.clear()
                cache[part] = made
        return known


@functools.lru_cache(maxsize=2)
def load(a_path: str, b_path: str) -> Aligner:
    """One copy a Python worker, kept between tasks."""
    return Aligner(a_path, b_path)


def pack(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending pairs and their numbers; differences are small, so they deflate well."""
    return zlib.compress(np.diff(pairs, prepend=0).tobytes() + times.astype(np.int64).tobytes(), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(packed), np.int64)
    return np.cumsum(both[:len(both) // 2]), both[len(both) // 2:]


def summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in ascending order with the sum of their numbers."""
    if not len(pairs):
        return pairs, times
    order = np.argsort(pairs, kind="stable")
    pairs, times = pairs[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    return pairs[first], np.add.reduceat(times, first)


def links_of(parts: list[Part]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join([p[4] for p in parts]), np.int64)
    times = np.ones(len(pairs), np.int64)
    heavy = [link for p in parts if p[5] for link in p[5]]
    if heavy:
        more = np.array(heavy, np.int64)
        pairs, times = np.concatenate([pairs, more[:, 0]]), np.concatenate([times, more[:, 1]])
    return summed(pairs, times)


ALIGNED = pa.schema([
    ("doc_id", pa.int64()), ("block", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary()), ("block_links", pa.binary()),
])
ALIGNED_SQL = (
    "doc_id bigint, block bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "links binary, block_links binary"
)


def align_texts(docs: DataFrame, a_path: str, b_path: str, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Per document its counts, digest and distinct links; per block of documents one row of ``block_links``.

    ``links`` holds id pairs with the number of times each is linked in the document, ``block_links`` those of the
    block with the number of its documents that hold each (see :func:`unpack`).  A block is what one task reads
    until its documents hold ``block_pairs`` pairs, so its size does not depend on the size of the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(a_path, b_path)
        task = TaskContext.get().partitionId() << 32
        block, held, waiting, rows = 0, [], 0, []

        def close():
            pairs, times = summed(np.concatenate(held), np.ones(sum(map(len, held)), np.int64))
            rows.append((None, task | block, 0, 0, 0, 0, None, None, pack(pairs, times)))

        for batch in small_batches(batches, "text", BATCH_BYTES):
            texts = [parts_of(t) if t else [] for t in batch.column("text").to_pylist()]
            known = aligner.look_up({p for parts in texts for p in parts})
            for doc, parts in zip(batch.column("doc_id").to_pylist(), texts):
                found = [known[p] for p in parts]
                if not found or None in found:
                    rows.append((doc, task | block, 0, 0, 0, 0, "", None, None))
                    continue
                pairs, times = links_of(found)
                digest = hashlib.sha256(";".join([p[3] for p in found]).encode()).hexdigest()
                rows.append((
                    doc, task | block, *[sum([p[i] for p in found]) for i in range(3)], int(times.sum()), digest, pack(pairs, times), None,
                ))
                held.append(pairs)
                waiting += len(pairs)
                if waiting >= block_pairs:
                    close()
                    block, held, waiting = block + 1, [], 0
            yield as_batch(rows)
            rows = []
        if held:
            close()
        yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * len(ALIGNED)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ALIGNED)], schema=ALIGNED)

    return id_and_text(docs).mapInArrow(run, ALIGNED_SQL)


def pair_counts(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``block, pair, n`` of every block, and ``pair, count, best``: the documents that hold a pair linked, and the most
    of any pair with its A id."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("block_links").to_pylist()):
                pairs, times = unpack(packed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pairs), block, np.int64)), pa.array(pairs), pa.array(times)], names=["block", "pair", "n"]
                )

    asked = aligned.where("block_links IS NOT NULL").select("block", "block_links").mapInArrow(
        spread, "block bigint, pair bigint, n bigint"
    )
    counts = asked.groupBy("pair").agg(F.sum("n").alias("count"))
    # At most as many rows an A id as B has ids.
    best = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))
    return asked, counts.withColumn("best", best)


RESULT = pa.schema([
    *[(n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string()),
])
RESULT_SQL = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
)


def _settle(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a block with the corpus-wide counts of its pairs."""
    pairs = answers.column("pair").to_numpy()
    order = np.argsort(pairs)
    pairs = pairs[order]
    count, best = answers.column("count").to_numpy()[order], answers.column("best").to_numpy()[order]
    n_best, count_sum = [], []
    for packed in docs.column("links").to_pylist():
        if packed is None:
            n_best.append(0)
            count_sum.append(0)
            continue
        own, times = unpack(packed)
        at = np.searchsorted(pairs, own)
        n_best.append(int(times[count[at] == best[at]].sum()))
        count_sum.append(int((times * count[at]).sum()))
    columns = {n: docs.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    columns |= {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
    return pa.table([columns[f.name] for f in RESULT], schema=RESULT)


def align_documents(docs: DataFrame, a_path: str, b_path: str, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs``.

    A encodes a space and the text, B the text, to which it adds the space; special tokens are plain text.  Null
    and empty texts, and those that either tokenizer does not give back byte by byte, have zeros and an empty
    digest.  Equal rows are documents of their own and count each; null ids stay; an empty table gives an empty one;
    other columns are not read; long texts are read whole.

    Documents are aligned once and written to the shared folder.  Counts are summed over blocks of documents, so a
    pair that every document holds comes once a block, and each block is sent the counts of its own pairs.
    """
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/aligned-{uuid.uuid4().hex}"
    align_texts(docs, a_path, b_path, block_pairs).write.parquet(path)
    aligned = spark.read.schema(ALIGNED_SQL).parquet(path)
    asked, counts = pair_counts(aligned)
    answers = asked.select("block", "pair").join(counts, "pair")
    rows = aligned.where("block_links IS NULL").drop("block_links")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_settle, RESULT_SQL)
