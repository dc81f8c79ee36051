"""Alignment, byte-level encoding and lexical search against the libraries and brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from maskloom.llm import aligned, bytebpe, lexical
from maskloom.llm.queries import BYTE_RANKS, BYTE_VOCABULARY, PIECES, QUERIES

SF = "/root/testdata/sf0.001"
PATTERN = public_tokenizers.PATTERN
LETTERS = [
    "a", "b", "the", "'", "s", "ll", "v", " ", " ", "  ", "\n", "\t", "1", "٣", "é", "中", "😀", "-", "…", "՘", "\U0001f300",
    "\x1c", "\x85", "　", "\x00", "<|endoftext|>", "<s>", "\r", " ", "​", "﻿", "᠎",
]
LONG = "word " * 4000 + "x" * 3000 + " end" * 9000


def sha(value):
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


def strings(seed, count, most=30, letters=LETTERS):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.randrange(most))) for _ in range(count)]


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " ", "a", "A tie", "a TIE", LONG, "x▁y", " \n\n  lead and trail \n", *strings(7, 40)]
    rows = [(i if i != 3 else None, t, i, "clash") for i, t in enumerate(texts)] + [(6, LONG, 0, "again")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, ids string").withColumn("key", F.lit(1))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=PATTERN, mergeable_ranks=bytebpe.load(BYTE_RANKS, PATTERN).ranks, special_tokens={}
    )


def id_and_texts(frame):
    return [(r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect()]


def encoded(library, rows):
    want = Counter()
    for doc, text in rows:
        ids = library.encode_ordinary(text)
        want[doc, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text)] += 1
    return want


def test_byte_pairs_match_library(library):
    ranks = bytebpe.load(BYTE_RANKS, PATTERN)
    for text in [*strings(1, 4000), "ab" * 5000, "é1" * 2000, "a" * 3000, "".join(map(chr, range(0x2FF)))]:
        assert ranks.encode(text) == library.encode_ordinary(text)


def test_classes_are_those_of_the_library(library):
    ranks = bytebpe.load(BYTE_RANKS, PATTERN)
    points = [*range(0x500, 0x600), *range(0x880, 0x8A0), *range(0x1C80, 0x1C90), *range(0xA7C0, 0xA7E0), *range(0x11DE0, 0x11DF0)]
    for point in points:
        text = f"a{chr(point)} {chr(point)}1 {chr(point)}"
        assert ranks.encode(text) == library.encode_ordinary(text), hex(point)


@pytest.mark.parametrize("size, overlap", [(8, 2), (16, 4), (40, 8)])
def test_chunks_meet(size, overlap):
    ranks = bytebpe.load(BYTE_RANKS, PATTERN)
    rng = random.Random(size)
    for text in ["".join(rng.choice(LETTERS) * rng.choice([1, 1, 2, 40]) for _ in range(rng.randrange(1, 80))) for _ in range(1500)]:
        got, own = [], 0
        for number, step, body in ranks.chunks(text, size, overlap):
            stop = ranks.seam(body, step) if step else None
            got += ranks.pretokens(body, own, stop)
            own = stop - step if step else 0
        assert got == ranks.pretokens(text)


def test_chunks_of_one_long_pretoken_stay_few():
    ranks = bytebpe.load(BYTE_RANKS, PATTERN)
    text = "a" * 100_000 + " b" * 50
    assert sum(len(body) for *_, body in ranks.chunks(text, 100, 10)) < 2 * len(text)


@pytest.mark.parametrize("chunk", [64, 5000, 1 << 20])
def test_byte_round_trip(spark, odd, library, chunk):
    got = bytebpe.round_trip(odd, BYTE_RANKS, PATTERN, chunk, 16).collect()
    assert Counter(map(tuple, got)) == encoded(library, id_and_texts(odd))


def test_byte_encode_decode(spark, odd, library):
    ids = bytebpe.encode(odd, BYTE_RANKS, PATTERN)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in ids.collect()) == Counter(
        (doc, tuple(library.encode_ordinary(text))) for doc, text in id_and_texts(odd)
    )
    back = bytebpe.decode(ids, BYTE_RANKS, PATTERN).collect()
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in back) == Counter((d, t.encode()) for d, t in id_and_texts(odd))


def test_byte_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op12_byte_bpe"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == encoded(library, id_and_texts(docs))


def brute_groups(text):
    """Token ids of the whole text by both libraries, grouped between ends in both sets."""
    both = aligned.load(BYTE_VOCABULARY, PIECES)
    raw = f" {text}".encode()
    a, b = both.a.encode(f" {text}", add_special_tokens=False).ids, both.b.encode(text)
    a_raw, b_raw = [both.a_bytes[i] for i in a], [both.b_bytes[i] for i in b]
    if not text or b"".join(a_raw) != raw or b"".join(b_raw) != raw:
        return None
    a_ends, b_ends = list(accumulate(map(len, a_raw))), list(accumulate(map(len, b_raw)))
    groups, i, j = [], 0, 0
    for cut in sorted(set(a_ends) & set(b_ends)):
        k, m = a_ends.index(cut) + 1, b_ends.index(cut) + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return groups


def brute_alignment(rows):
    groups = [brute_groups(text) for _, text in rows]
    links = [Counter((a, b) for own, other in g or () for a in own for b in other) for g in groups]
    count = Counter(pair for found in links for pair in found)
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    want = Counter()
    for (doc, _), found, g in zip(rows, links, groups):
        printed = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g or ())
        want[
            doc, sum(len(a) for a, _ in g or ()), sum(len(b) for _, b in g or ()), len(g or ()), sum(found.values()),
            sum(n for p, n in found.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in found.items()),
            sha(printed) if g else "",
        ] += 1
    return want


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_align_divides_at_every_shared_end():
    rng = random.Random(2)
    for _ in range(3000):
        size = rng.randrange(1, 60)
        a, b = [sorted({*rng.sample(range(1, size + 1), rng.randrange(size)), size}) for _ in range(2)]
        groups = aligned.align(a, b)
        assert [a[g[1] - 1] for g in groups] == [b[g[3] - 1] for g in groups] == sorted(set(a) & set(b))
        assert [g[0] for g in groups] == [0, *[g[1] for g in groups[:-1]]]
    assert aligned.align([], []) == []
    assert len(aligned.align(list(range(1, 200_001)), [1, 200_000])) == 2


def test_parts_do_not_change_the_tokens():
    both = aligned.load(BYTE_VOCABULARY, PIECES)
    for text in strings(3, 3000, 40, [*LETTERS, "▁"]):
        parts = aligned.parts_of(text) if text else []
        assert "".join(parts) == (f" {text}" if text else "")
        found = [both.look_up(set(parts))[p] for p in parts]
        want = brute_groups(text)
        if None in found or not found:
            assert want is None
        else:
            assert ";".join(p[3] for p in found) == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in want)


@pytest.mark.parametrize("block", [1, 500, 1 << 19])
def test_alignment_counts(spark, odd, block):
    got = aligned.align_documents(odd, BYTE_VOCABULARY, PIECES, block).select(*ALIGNED).collect()
    assert Counter(map(tuple, got)) == brute_alignment(id_and_texts(odd))


def test_alignment_query(spark):
    got = QUERIES["op11_alignment"](spark, SF).select(*ALIGNED).collect()
    assert Counter(map(tuple, got)) == brute_alignment(id_and_texts(spark.read.parquet(f"{SF}/documents.parquet")))


def brute_search(docs, items, k):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(doc, Counter(terms(text))) for doc, text in docs if terms(text)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    rows = Counter()
    for item, text in set(items):
        scores = []
        for doc, c in held:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m))
                for t in set(terms(text)) if t in c
            )
            if score > 0:
                scores.append((-score, doc is None, doc))
        rows.update((item, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1))
    return rows


@pytest.mark.parametrize("tile, width, group_bytes", [(512, 2048, 1 << 20), (3, 2, 40)])
def test_search(spark, odd, monkeypatch, tile, width, group_bytes):
    items = [(1, "the Tie"), (1, "the Tie"), (2, "word end x"), (2, "a"), (3, None), (4, ""), (None, "中 é b"), (5, "unheard"), (6, "A b V 1 s")]
    frame = spark.createDataFrame(items, "item_id bigint, text string").withColumn("score", F.lit(1))
    docs = id_and_texts(odd)
    n = lexical._scored

    def small(*args):
        lexical.DOCUMENT_TILE, lexical.TERM_TILE, lexical.ITEM_TILE = tile, width, width
        return n(*args)

    monkeypatch.setattr(lexical, "_scored", small)
    for k in (1, 4, 50):
        got = lexical.search(odd, frame, k, group_bytes).collect()
        assert Counter(map(tuple, got)) == brute_search(docs, [(i, t or "") for i, t in items], k)
    lexical.DOCUMENT_TILE, lexical.TERM_TILE, lexical.ITEM_TILE = 512, 2048, 1024


def test_tiles_do_not_depend_on_their_size(monkeypatch):
    group = lexical.ItemGroup([(i, " ".join(f"w{(i * j) % 37}" for j in range(9))) for i in range(30)])
    rng = np.random.default_rng(4)
    found = [(np.array(sorted(rng.choice(len(group.number), 6, replace=False)), np.int64), rng.integers(1, 9, 6), 60) for _ in range(50)]
    want = None
    for width, items in ((2048, 1024), (5, 7), (1, 1)):
        monkeypatch.setattr(lexical, "TERM_TILE", width)
        monkeypatch.setattr(lexical, "ITEM_TILE", items)
        tiles = lexical.Tiles(group, np.arange(len(group.number)), 50, 3000, 10)
        tiles.add(list(range(25)), found[:25])
        tiles.add(list(range(25, 50)), found[25:])
        want = want or list(tiles.rows())
        assert list(tiles.rows()) == want and tiles.width * int(tiles.weights.max()) * 10 ** 6 < 1 << 53


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert bytebpe.round_trip(docs, BYTE_RANKS, PATTERN).collect() == []
    assert aligned.align_documents(docs, BYTE_VOCABULARY, PIECES).collect() == []
    assert lexical.search(docs, items).collect() == []
    assert lexical.search(docs.unionByName(items.withColumnRenamed("item_id", "doc_id")), items.limit(0)).collect() == []
