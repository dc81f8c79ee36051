"""Byte-pair encoding and decoding with a public vocabulary file.

Merges run over a doubly linked list of symbols with a heap of merge ranks; an entry whose pair has
changed since it was pushed is stale and skipped.  A white-space separated word is encoded once and
kept in a bounded cache, because tokens never cross white space.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from maskloom.llm.common import RecentCache, id_and_text

# Control characters that Python's split() takes for white space and the vocabulary's
# normaliser does not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
MARKS = frozenset(".,;:!?")
# Behind the rank of every merge.
NO_MERGE = 1 << 62
# Bytes of a piece whose merges are looked through one by one.
SHORT = 32
SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_letters() -> list[str]:
    """The printable letter of every byte: printable Latin-1 stands for itself, the rest follows from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class BytePairs:
    """A tokenizers file of kind BPE with word ends, read as plain JSON."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.strings = {i: s for s, i in vocab.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings.update({i: s for s, i in self.specials.items()})
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + suffix] for c in letters]
        # pair of symbol ids -> rank << 16 | merged id
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[left] << 16 | vocab[right]] = rank << 16 | vocab[left + right]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.piece_ids = RecentCache(lambda piece: tuple(self.encode_piece(piece)), 300_000)

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        raw, inner = piece.encode(), self.inner
        symbols = [inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        count = len(symbols)
        if count == 1:
            return symbols
        # An entry is rank, merged id and place in one number, so the least rank leads, leftmost first.
        shift = 24 if count < 1 << 24 else 40
        places = (1 << shift) - 1
        merge_of, push, pop = self.pairs.get, heapq.heappush, heapq.heappop
        heap = []
        for at, (left, right) in enumerate(zip(symbols, symbols[1:])):
            merge = merge_of(left << 16 | right)
            if merge is not None:
                heap.append(merge << shift | at)
        if not heap:
            return symbols
        heapq.heapify(heap)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        while heap:
            entry = pop(heap)
            at = entry & places
            left, right_at = symbols[at], after[at]
            if left < 0 or right_at >= count or merge_of(left << 16 | symbols[right_at]) != entry >> shift:
                continue  # stale: one of the two was merged away since
            symbols[at] = merged = (entry >> shift) & 0xFFFF
            symbols[right_at] = -1
            after[at] = beyond = after[right_at]
            if beyond < count:
                before[beyond] = at
                merge = merge_of(merged << 16 | symbols[beyond])
                if merge is not None:
                    push(heap, merge << shift | at)
            previous = before[at]
            if previous >= 0:
                merge = merge_of(symbols[previous] << 16 | merged)
                if merge is not None:
                    push(heap, merge << shift | previous)
        return [s for s in symbols if s >= 0]

    def encode_short(self, piece: str) -> list[int]:
        """The ids of :meth:`encode_piece`; the next merge of a short piece is found sooner by looking at all of them."""
        raw, inner, merge_of = piece.encode(), self.inner, self.pairs.get
        if len(raw) > SHORT:
            return self.encode_piece(piece)
        symbols = [inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        merges = [merge_of(left << 16 | right, NO_MERGE) for left, right in zip(symbols, symbols[1:])]
        while merges:
            merge = min(merges)
            if merge == NO_MERGE:
                break
            at = merges.index(merge)
            symbols[at] = merged = merge & 0xFFFF
            del symbols[at + 1], merges[at]
            if at < len(merges):
                merges[at] = merge_of(merged << 16 | symbols[at + 1], NO_MERGE)
            if at:
                merges[at - 1] = merge_of(symbols[at - 1] << 16 | merged, NO_MERGE)
        return symbols

    def encode_word(self, word: str) -> list[int]:
        """Ids of a text without white space."""
        # Most words are letters, perhaps with one mark behind them: these are the pieces.
        letters, mark = (word, "") if word.isalpha() else (word[:-1], word[-1])
        if (not mark or mark in MARKS and letters.isalpha()) and (letters.isascii() or self.plain(letters)):
            ids = self.piece_ids[letters.lower()] if len(letters) <= 64 else self.encode_piece(letters.lower())
            return [*ids, self.last[ord(mark)]] if mark else list(ids)
        ids = []
        for part in self.split_special.split(word) if "<|" in word else (word,):
            if part in self.specials:
                ids.append(self.specials[part])
                continue
            # Lower case letter by letter: no final-sigma rule.
            plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            for piece in self.pieces.findall(plain):
                ids += self.piece_ids[piece] if len(piece) <= 64 else self.encode_piece(piece)
        return ids

    @staticmethod
    def plain(letters: str) -> bool:
        """Whether lower case is all that normalising does to the letters."""
        return "Σ" not in letters and unicodedata.is_normalized("NFC", letters) and letters.lower().isalpha()

    @staticmethod
    def words(text: str) -> list[str]:
        if any(c in text for c in NOT_SPACE):
            return [w for w in SPACE.split(text) if w]
        return text.split()

    def decode(self, ids) -> str:
        """The vocabulary strings of the ids, one space between them: the file names no decoder."""
        strings = self.strings
        return " ".join([strings[i] for i in ids])


@functools.lru_cache(maxsize=2)
def load(path: str) -> BytePairs:
    """One copy a Python worker, kept between tasks."""
    return BytePairs(path)


@functools.lru_cache(maxsize=2)
def printed_words(path: str) -> RecentCache:
    pairs = load(path)

    def both(word):
        ids = pairs.encode_word(word)
        return " ".join(map(str, ids)), pairs.decode(ids)

    return RecentCache(both, 200_000)


@functools.lru_cache(maxsize=2)
def packed_words(path: str) -> RecentCache:
    # A copy of its own, which gives short pieces without the heap.
    pairs = BytePairs(path)
    pairs.piece_ids = RecentCache(lambda piece: tuple(pairs.encode_short(piece)), 300_000)
    return RecentCache(lambda word: array("I", pairs.encode_word(word)).tobytes(), 500_000)


def encode_packed(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian unsigned 32-bit integers."""
    cache, words = packed_words(path), BytePairs.words
    return lambda text: b"".join(map(cache.__getitem__, words(text)))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode every text and decode it again: ``doc_id, n_tokens, ids, decoded`` digests.

    One row per row of ``docs``; null and empty texts have no tokens and the digests of the empty
    string.  Repeated rows and null ids stay as they are.  Needs no shuffle; ids of one text are
    held as one string, so memory follows the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, words = printed_words(path), load(path).words
        look = cache.__getitem__
        for batch in batches:
            counts, ids_digests, text_digests = [], [], []
            for text in batch.column("text"):
                got = [look(w) for w in words(text.as_py())]
                ids = " ".join([g[0] for g in got])
                counts.append(ids.count(" ") + 1 if ids else 0)
                ids_digests.append(hashlib.sha256(ids.encode()).hexdigest())
                text_digests.append(hashlib.sha256(" ".join([g[1] for g in got]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()),
                 pa.array(text_digests, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_and_text(docs).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` (array of int) of every text; empty array for null or empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(path)
        for batch in batches:
            ids = [[i for w in pairs.words(t.as_py()) for i in pairs.encode_word(w)] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, decoded`` of ``doc_id, ids``; null ids decode to the empty string, unknown ids raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(path)
        for batch in batches:
            texts = [pairs.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded string")
