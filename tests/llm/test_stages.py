"""Stages of the pipeline on odd rows, against plain Python, and the further kinds of personal data."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from maskloom.llm import linededup, pii, quality

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _sum int, _dropped string, _first int, n_lines int, row int, c0 int"


def words(seed, count):
    return " ".join(f"w{(seed * 7919 + i * 104729) % 9973}" for i in range(count))


@pytest.fixture(scope="module")
def docs(spark):
    base = words(1, 60)
    texts = [
        base, base, base + " more", words(2, 60), words(3, 60), None, "", "few words", "same words " * 40,
        "Shared line\n" + words(4, 40), words(5, 40) + "\n shared LINE ", "mail me@site.org or call\n" + words(6, 40),
    ]
    rows = [(i, t, "en", "s", 7, i, "d", 1, 5, 2, 3) for i, t in enumerate(texts)]
    rows += [(0, base, "en", "s", 7, 0, "d", 1, 5, 2, 3), (None, words(8, 50), None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS)


def others(rows):
    return Counter(tuple(v for k, v in r.asDict().items() if k not in ("text", "n_chars")) for r in rows)


def test_stages_keep_clashing_columns(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    rows = docs.collect()
    long = [r for r in rows if r["text"] and len(r["text"].split()) >= 20 and not r["text"].startswith("same")]
    kept = stages["quality rules"](spark, docs, "").collect()
    assert Counter(kept) == Counter(long)
    alike = stages["n-gram Jaccard join"](spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in alike if r["doc_id"] is not None) == [0, 3, 4, 5, 6, 7, 8, 9, 10, 11] and None in [r["doc_id"] for r in alike]
    for name in ("quality rules", "line dedup", "n-gram Jaccard join", "personal data"):
        done = stages[name](spark, docs, "")
        assert done.columns == docs.columns and not others(done.collect()) - others(rows)
        assert stages[name](spark, docs.limit(0), "").collect() == []


def test_lines_go_and_columns_stay(spark, docs):
    done = linededup.without_shared_lines(docs, min_docs=2).collect()
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    rows = docs.collect()
    shared = Counter(k for doc, k in {(r["doc_id"], key(x)) for r in rows if r["doc_id"] is not None for x in (r["text"] or "").split("\n")})
    want = Counter(
        (r["doc_id"], "\n".join(x for x in (r["text"] or "").split("\n") if not key(x) or shared[key(x)] < 2)) for r in rows
    )
    assert Counter((r["doc_id"], r["text"]) for r in done) == want and others(done) == others(rows)


def test_equal_texts_of_two_sources_are_judged_apart(spark):
    rows = [(1, words(1, 30), "en", "a"), (1, words(1, 30), "en", "b")] + [(10 + i, words(i, 30), "en", "a") for i in range(200)]
    rows += [(300 + i, " ".join("x" * 30 + str(i + j) for j in range(30)), "en", "b") for i in range(210)]
    kept = quality.kept_documents(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))
    assert [r["source"] for r in kept.where("doc_id = 1").collect()] == ["a"]


@pytest.mark.parametrize("text, kind, value", [
    ("my SSN is 123-45-6789.", "ssn", "123-45-6789"), ("IBAN is DE89370400440532013000 ok", "iban", "DE89370400440532013000"),
    ("pay DE89 3704 0044 0532 0130 00 now", "iban", "DE89 3704 0044 0532 0130 00"), ("api key: 0123456789abcdef0123", "secret", "0123456789abcdef0123"),
    ("x ghp_" + "a1" * 18 + " y", "key", "ghp_" + "a1" * 18), ("sk-abcdefghij0123456789xyz", "key", "sk-abcdefghij0123456789xyz"),
    ("-----BEGIN RSA PRIVATE KEY-----", "key", "-----BEGIN RSA PRIVATE KEY-----"), ("call (415) 555-0100 today", "tel", "(415) 555-0100"),
    ("or 415-555-0100", "tel", "415-555-0100"),
])
def test_further_personal_data(text, kind, value):
    assert [(k, text[s:e]) for k, s, e in pii.find(text) if k in pii.MORE_KINDS] == [(kind, value)]


def test_numbers_that_are_no_personal_data():
    for text in ("1-415-555-0100-2", "on 2024-01-01", "AB12 3456 7890 1234 5678", "XDE89370400440532013000", "DE88370400440532013000", "v415.555-01001"):
        assert [s for s in pii.find(text) if s[0] in pii.MORE_KINDS] == []


def test_regions_part_at_sizes(spark):
    """Shared regions against plain Python: split by cell and size, single sets left out, equal rows once."""
    import random

    from maskloom.llm import nearjoin

    rng = random.Random(3)
    nodes = {i: rng.choice([3, 4, 9, 10, 11, 30]) for i in range(-20, 20)}
    rows = [(rng.randrange(12), nodes[n], n) for n in rng.choices(sorted(nodes), k=150)]
    got = {}
    for r in nearjoin.shared_cells(spark.createDataFrame(rows, "cell bigint, n bigint, node bigint"), 80).where("members = 0").collect():
        got.setdefault(r["cell"], []).append(r["node"])
    want = []
    for cell in range(12):
        group = []
        for n, node in sorted({(n, node) for c, n, node in rows if c == cell}) + [(10 ** 9, 0)]:
            if group and 100 * group[-1][0] < 80 * n:
                want += [sorted(x for _, x in group)] if len(group) > 1 else []
                group = []
            group.append((n, node))
    assert sorted(map(sorted, got.values())) == sorted(want)
