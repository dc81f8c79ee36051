"""Each text operator against a brute-force version or another library, on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import check
from maskloom.llm import bpe, linededup, mainext, nearjoin, packing, pii, quality, repeats, topk, toxicity
from maskloom.llm.queries import QUERIES, SQL, VOCABULARY

SF = "/root/testdata/sf0.001"
LONG = "word " * 9000 + "x" * 4000
ODD_TEXTS = [
    None, "", " \n\t ", "Hello WÖRLD it's 42!", "ΑΣ İ é \x1cx <|endoftext|>y", "a@b.co 1.2.3.4 +1 (415) 555-0100", LONG, LONG,
    "same line\nother", "Same Line \n\nother", "4111 1111 1111 1111 and 999.1.1.1.2 x@y@z.io", "ab" * 300, "one two",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 4 else None, t, "en" if i % 2 else None, i) for i, t in enumerate(ODD_TEXTS)]
    rows += [(7, LONG, "en", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, key int").withColumn("source", F.lit("s"))


def pairs_of(frame):
    return [(r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect()]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twins(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert check.compare(got, check.duck(SF).execute(SQL[name]).fetchdf()) == ""


def test_bpe_matches_library_and_decodes(spark, odd):
    library = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for doc, text in pairs_of(odd):
        ids = library.encode(text, add_special_tokens=False).ids
        want[doc, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, bpe.round_trip(odd, VOCABULARY).collect())) == want
    decoded = bpe.decode(bpe.encode(odd, VOCABULARY), VOCABULARY).collect()
    assert Counter((r["doc_id"], sha(r["decoded"])) for r in decoded) == Counter((w[0], w[3]) for w in want.elements())


def test_bpe_long_word_merges_like_library():
    library, own = Tokenizer.from_file(VOCABULARY), bpe.load(VOCABULARY)
    rng = np.random.default_rng(3)
    for size in (1, 2, 30, 3000):
        word = "".join(rng.choice(list("abcéß1!"), size))
        assert own.encode_word(word) == library.encode(word, add_special_tokens=False).ids


def brute_pii(text):
    spans = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            spans.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append((m.start(), 3, m.end()))
    return [(pii.KINDS[k], s, e) for s, k, e in sorted(spans)]


def test_pii_base_spans(spark, odd):
    rng = np.random.default_rng(5)
    texts = [t for _, t in pairs_of(odd)] + ["".join(rng.choice(list("a1.@+- ()4%"), 60)) for _ in range(4000)]
    for text in texts:
        assert [s for s in pii.find(text) if s[0] in pii.BASE_KINDS] == brute_pii(text)
    assert pii.pii_spans(odd).count() == odd.count()
    assert pii.redact("mail a@b.co now") == "mail [email] now" and pii.redact("clean text") == "clean text"


def test_pii_further_kinds():
    kinds = lambda t: [s[0] for s in pii.find(t)]
    assert kinds("IBAN: GB82 WEST 1234 5698 7654 32") == ["iban"] and kinds("IBAN: GB83 WEST 1234 5698 7654 32") == []
    assert kinds("see https://example.org/page") == [] and "url" in kinds("https://bob:pw@example.org/x")
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds('token = "0123456789abcdef0123"') == ["secret"]


def test_pii_account_boundaries_and_cases():
    cut_out = lambda t: [(k, t[s:e]) for k, s, e in pii.find(t) if k in pii.MORE_KINDS]
    plain, spaced = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    for account in (plain, spaced):
        for after in (" BIC COBADEFFXXX", " BIC: X", " 2024-01-01", " 12 345 67", ".", "-A", "\n", "", " A" * 20):
            assert cut_out(f"IBAN: {account}{after}") == [("iban", account)]
    assert cut_out(f"IBAN {plain}A") == cut_out(f"IBAN {plain}9 X") == cut_out(f"IBAN {plain}a") == []
    assert cut_out(f"iBaN {plain} IBAN {spaced} BIC") == [("iban", plain), ("iban", spaced)]
    unlisted = next(f"XX{n:02} 2222 3333 4444 5555" for n in range(2, 99) if pii.iban_ok(f"XX{n:02}2222333344445555"))
    assert cut_out(f"IBAN {unlisted}") == cut_out(f"IBAN {unlisted}: BIC") == [("iban", unlisted)]
    secret = "0123456789abcdef0123"
    for cue in ("Api_Key", "API_Key", "ApiKey", "tOKEN", "PassWord"):
        assert cut_out(f"é İ {cue}: {secret}") == [("secret", secret)]
    assert cut_out("at HTTPS://bob:pw@example.org/x now") == [("url", "HTTPS://bob:pw@example.org/x")]
    assert cut_out("akia" + "A" * 16) == [] and cut_out("AKIA" + "A" * 16) == [("key", "AKIA" + "A" * 16)]


def test_line_dedup(spark, odd):
    rows = pairs_of(odd)
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    shared = Counter(k for _, t in rows for k in {key(x) for x in t.split("\n")})
    want = Counter()
    for doc, text in rows:
        lines = text.split("\n")
        kept = [x for x in lines if not key(x) or shared[key(x)] < 2]
        want[doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))] += 1
    assert Counter(map(tuple, linededup.line_dedup_digest(odd, min_docs=2).collect())) == want


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "one line\nanother line")] * 10 + [(i, f"shared\nown {i}") for i in range(2, 12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    dropped = {(r["doc_id"], r["n_dropped"]) for r in linededup.line_dedup_digest(docs).collect()}
    assert dropped == {(1, 0)} | {(i, 1) for i in range(2, 12)}
    rows += [(None, "a b c d e f")] * 3 + [(None, None)] * 2
    kept = nearjoin.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter(set(rows))


def test_quality_edges(spark, odd):
    got = quality.quality_verdicts(odd).collect()
    assert len(got) == odd.count() and not any(r["kept"] and r["base_failed"] for r in got)
    assert quality.quality_verdicts(odd.limit(0)).count() == 0
    assert set(quality.kept_documents(odd).columns) == set(odd.columns)


def brute_components(rows, size, percent):
    sets = []
    for _, text in rows:
        w = text.encode().lower().split()
        sets.append({tuple(w)} if 0 < len(w) < size else {tuple(w[i:i + size]) for i in range(len(w) - size + 1)})
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root[i]] = min(doc, least.get(root[i], doc))
    return Counter((doc, len(s), least.get(r) if s else doc) for (doc, _), s, r in zip(rows, sets, root))


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_jaccard_join(spark, odd, size, percent, monkeypatch):
    rng = np.random.default_rng(size)
    words = [f"w{i}" for i in range(400)]
    rows, doc = [], 100
    for length in (12, 40, 150, 150):
        base = list(rng.choice(words, length))
        for edits in range(14):
            copy = list(base)
            for at in rng.integers(0, length, rng.integers(0, 1 + edits // 2)):
                copy[at] = str(rng.integers(1000))
            rows.append((doc, " ".join(copy)))
            doc += 1
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(odd.select("doc_id", "text"))
    want = brute_components(pairs_of(docs), size, percent)
    for region in (65_536, 4):  # the second one needs many turns of pivots
        monkeypatch.setattr(nearjoin, "REGION", region)
        assert Counter(map(tuple, nearjoin.near_components(docs, size, percent).collect())) == want
    assert nearjoin.near_components(docs.limit(0), size, percent).count() == 0


def test_jaccard_join_of_two_groups_by_one_link(spark):
    """Copies of two originals that are no partners: one link joins the groups, and cells hold both."""
    rng = np.random.default_rng(17)
    rows, want, doc = [], Counter(), 0
    for seed in range(60):
        # Single words are the shingles: 40 common ones and extras, so that the sizes decide the distances.
        word = lambda i: f"s{seed}w{i}"  # noqa: B023, E731
        common = [word(i) for i in range(40)]
        left, right = common + [word(50), word(51)], common + [word(60), word(61)]  # 40 of 44
        group = [left, right]
        group += [left + [word(100 + i)] for i in range(3)] + [right + [word(200 + i)] for i in range(3)]
        ids = list(range(doc, doc + len(group)))
        doc += len(group)
        for own, text in zip(rng.permutation(ids), group):
            rows.append((int(own), " ".join(rng.permutation(text))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for first in range(0, doc, 8):
        want += brute_components([r for r in rows if first <= r[0] < first + 8], 1, 90)
    assert Counter(map(tuple, nearjoin.near_components(docs, 1, 90).collect())) == want


def test_jaccard_join_sends_no_large_unlike_sets(spark, monkeypatch):
    # Each word is in two of three texts that are alike by a third, so any may be a pivot; 512 bits rule none of these pairs out.
    blocks = [" ".join(f"{name}{i}" for i in range(2100)) for name in "abc"]
    texts = [f"{blocks[i]} {blocks[j]}" for i, j in ((0, 1), (1, 2), (0, 2))]
    texts.append(texts[0] + " e1 e2")
    sent, plain = [], nearjoin.compare
    monkeypatch.setattr(nearjoin, "compare", lambda pairs, sets: sent.extend(map(tuple, pairs.collect())) or plain(pairs, sets))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["component_id"] for r in nearjoin.near_components(docs, 1, 90).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 0}
    sets = {nearjoin.set_names(s)[0]: s for s in (nearjoin.shingle_set(t.encode(), 1) for t in texts)}
    assert sent and all(len(np.intersect1d(sets[u], sets[v])) > 4000 for u, v in sent)


def test_wide_sketches_bound_what_sets_differ_by(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 9000, dtype=np.uint64)
    assert nearjoin.wide_sketch(base[:nearjoin.WIDE]) is None
    cases = [(base[:4000], base[:4200]), (base[:4000], base[200:4200]), (base[:2200], base[2200:4400]), (base[:2100], base[:2200])]
    rows = [(len(a), len(b), nearjoin.wide_sketch(a), nearjoin.wide_sketch(b)) for a, b in cases]
    assert {len(w) for r in rows for w in r[2:]} == {16, 32}
    frame = spark.createDataFrame([*rows, (2100, 9000, rows[3][2], nearjoin.wide_sketch(base))], "n_u int, n_v int, wide_u array<bigint>, wide_v array<bigint>")
    assert [r[0] for r in frame.selectExpr(nearjoin.possible_wide("u", "v", 90)).collect()] == [True, True, False, True, True]


def test_repeats(spark, odd, monkeypatch):
    rng = np.random.default_rng(9)
    passage = "".join(rng.choice(list("abcdef ghij"), 260))
    extra = [(50 + i, "".join(rng.choice(list("klmno"), 90)) + passage[i:] + str(i) * 30) for i in range(8)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    raw = [(d, t.encode()) for d, t in pairs_of(docs)]
    times = Counter(t[i:i + 200] for _, t in raw for i in range(len(t) - 199))
    want = Counter()
    for doc, text in raw:
        gone = bytearray(len(text))
        for i in range(len(text) - 199):
            if times[text[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(text, gone) if not g)
        want[doc, len(text), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)] += 1
    for most in (2000, 1):  # the second one files keys again under whole windows
        monkeypatch.setattr(repeats, "KEY_PIECES", most)
        got = repeats.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert Counter(map(tuple, got.collect())) == want


def test_maximal_repeats_lists_all_occurrences():
    core = bytes(range(65, 125)) * 4
    pieces = [b"1" + core + b"x", b"2" + core + b"y", b"3" + core[20:] + b"z"]
    groups = {size: sorted(places) for size, places in repeats.maximal_repeats(pieces, [7, 7, 7], 200)}
    assert groups[240] == [(0, 1), (1, 1)] and (2, 1) in groups[220]


def test_top_k_ties_and_odd_rows(spark):
    nan = float("nan")
    rows = [(i, [float(i % 3), -1.5, 2.0]) for i in range(45)] + [(60, None), (80, [1.0, nan, 0.0]), (100, [1.0, None, 1.0])]
    frame = spark.createDataFrame(rows + [(5, [2.0, -1.5, 2.0])], "vec_id bigint, embedding array<double>").withColumn("n", F.lit(1))
    got = topk.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    vectors = {i: np.floor(64 * np.array(v)).astype(int) for i, v in rows if v and None not in v and nan not in v}
    for query in (0, 20, 40):
        want = sorted((-int(vectors[query] @ v), i) for i, v in vectors.items() if i != query and i < 45)[:20]
        assert [(-r["score"], r["vec_id"]) for r in got if r["query_id"] == query] == want


def test_top_k_stops_early_without_loss():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-50, 50, (20_000, 6)).astype(float)
    lists = topk.SortedLists(np.arange(20_000), vectors)
    for query in vectors[:20]:
        ids, scores = lists.best(query, -1, 20, -np.inf)
        assert sorted(scores)[-20:] == sorted(vectors @ query)[-20:]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    scored = toxicity.score_documents(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert (scored.predicted == scored.toxic).mean() > 0.95
    assert all(scored.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in scored.doc_id])
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "word")], "doc_id bigint, text string")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_documents(odd, model).collect())
    assert toxicity.fit([], []).score(0.0) == 0.5


def test_main_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = mainext.train(pages)
    for row in pages.collect():
        article = re.search(r"<article>(.*)</article>", row["html"], re.S)
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article[1]).replace("<br>", " "))
        lines = [" ".join(mainext.html.unescape(b).split()) for b in blocks]
        assert mainext.extract([row["html"]], model) == ["\n".join(x for x in lines if x)]
    odd = spark.createDataFrame(
        [(1, "u", None), (2, None, ""), (None, "u", "<p"), (4, "u", "<div>" * 3000 + "x"), (4, "u", "&am; <script>no")],
        "page_id bigint, url string, html string",
    )
    assert mainext.main_texts(odd, model).count() == 5
    assert mainext.extract(["<nav>m</nav><p>a  b&amp;c</p>"], None) == ["a b&c"]


def test_kept_nodes_have_kept_ancestors():
    rng = np.random.default_rng(2)
    parents = [-1] + [int(rng.integers(0, i)) for i in range(1, 300)]
    kept = mainext.choose(parents, rng.normal(0, 2, 300))
    assert all(kept[p] for i, p in enumerate(parents) if i and kept[i])


def test_packing(spark, odd):
    library = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for doc, text in pairs_of(odd):
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at:at + 2048], "<u4")
            want[doc, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    rows = packing.pack_documents(odd, VOCABULARY).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        ends = np.cumsum([0] + [n for _, n in sorted(spans)])
        assert ends[-1] <= 2048 and [o for o, _ in sorted(spans)] == ends[:-1].tolist()


def test_packing_keeps_every_capacity():
    rng = np.random.default_rng(4)
    fit, bins = packing.VectorBestFit(2048, 5, 1_500_000), {}
    for n in sorted(rng.integers(1, 1200, 3000), reverse=True):
        number, offset = fit.place(int(n))
        assert offset == sum(bins.setdefault(number, []))
        bins[number].append(int(n))
    assert all(sum(b) <= 2048 and len(b) <= 5 and sum(x * x for x in b) <= 1_500_000 for b in bins.values())


def test_short_pieces_need_no_heap():
    pairs, rng = bpe.BytePairs(VOCABULARY), random.Random(5)
    pieces = ["".join(rng.choice("abcdeeeinorstää1漢.") for _ in range(rng.choice([1, 2, 5, 9, 31, 32, 33, 90]))) for _ in range(2000)]
    assert [pairs.encode_short(p) for p in pieces] == [pairs.encode_piece(p) for p in pieces]
    text = "The cat sat. " + " ".join(pieces)
    ids = [i for w in pairs.words(text) for i in pairs.encode_word(w)]
    assert bpe.encode_packed(VOCABULARY)(text) == b"".join(i.to_bytes(4, "little") for i in ids)
