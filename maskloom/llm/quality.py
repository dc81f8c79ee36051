"""Quality rules with thresholds read off mergeable quantile sketches: DataFrame operations only.

A sketch is a histogram over rounded values: a whole number keeps its six leading bits, so any
quantile is within 1/32 of the exact one, sketches of parts add up by bucket, and the result does not
depend on the order of merging.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.session import cut

WORD_GAP = r"[\x20\x09-\x0D]+"
WINDOW = 8
# Measures that get thresholds, in millionths, with the least width of their fence.
MEASURES = {"symbol_share": 30_000, "dup_line_share": 400_000, "repeat_share": 300_000, "word_length": 1_500_000}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _pairwise(codes: Column, size: Column, step: int) -> Column:
    """Codes of windows twice as long: item ``i`` joins items ``i`` and ``i + step``."""
    length = F.greatest(size - step, F.lit(0))
    return F.zip_with(F.slice(codes, 1, length), F.slice(codes, step + 1, length), lambda a, b: F.xxhash64(a, b))


def text_counts(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text``, with the five counts and ``n_lines`` (lines with a word).

    Null text counts as empty.  Windows of eight words are compared as 64-bit hashes within one
    text, built by doubling; positions are only sorted where some window repeats.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rest = [c for c in docs.columns if c != "text"]
    words = docs.select(
        *rest,
        F.array_remove(F.split(text, WORD_GAP), "").alias("_words"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    counted = words.select(
        *rest, "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_codes"),
    )
    for step in (1, 2, 4):
        counted = counted.withColumn("_codes", _pairwise(F.col("_codes"), F.size("_codes"), step))
    repeated = counted.withColumn(
        "_places",
        F.when(
            F.size(F.array_distinct("_codes")) < F.size("_codes"),
            F.sort_array(F.transform("_codes", lambda code, at: F.struct(code.alias("code"), at.alias("at")))),
        ),
    )
    # Windows whose neighbour in code order has the same code, back in text order.
    code_at = lambda i: F.get("_places", i)["code"]
    starts = F.sort_array(F.transform(
        F.filter("_places", lambda p, i: (p["code"] == code_at(i - 1)).eqNullSafe(True)
                 | (p["code"] == code_at(i + 1)).eqNullSafe(True)),
        lambda p: p["at"],
    ))
    placed = repeated.withColumn("_starts", F.when(F.col("_places").isNotNull(), starts))
    # A start covers eight words, or as many as lie before the next one.
    covered = F.aggregate(
        F.transform("_starts", lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", i + 1) - at, F.lit(WINDOW)))),
        F.lit(0), lambda total, n: total + n,
    )
    return placed.select(
        *rest, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines",
    )


def _share(part: str, whole: str) -> Column:
    return F.expr(f"CASE WHEN {whole} > 0 THEN {part} * 1000000 DIV {whole} ELSE 0 END")


def measures(counts: DataFrame) -> DataFrame:
    return counts.withColumns({
        "symbol_share": _share("n_symbols", "word_chars"), "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"), "word_length": _share("word_chars", "n_words"),
    })


def bucket(value: Column) -> Column:
    """A whole number with all but its six leading bits set to zero."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketch(frame: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One sketch per key and measure: ``keys, measure, bucket, n``."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in names]))
    return frame.select(*keys, values.alias("_v")).groupBy(
        *keys, F.col("_v.measure").alias("measure"), F.col("_v.bucket").alias("bucket")
    ).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser keys."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: list[str], least_rows: int) -> DataFrame:
    """``keys, measure, low, high``: quartiles moved out by three times their distance and the least width.

    Keys with fewer than ``least_rows`` values get none.
    """
    ordered = Window.partitionBy(*keys, "measure").orderBy("bucket")
    whole = Window.partitionBy(*keys, "measure")
    ranked = sketches.withColumns({"upto": F.sum("n").over(ordered), "total": F.sum("n").over(whole)})
    quartiles = ranked.where(F.col("total") >= least_rows).groupBy(*keys, "measure").agg(
        F.min(F.expr("CASE WHEN upto * 4 >= total THEN bucket END")).alias("q1"),
        F.min(F.expr("CASE WHEN upto * 4 >= total * 3 THEN bucket END")).alias("q3"),
    )
    width = F.create_map(*[F.lit(x) for pair in MEASURES.items() for x in pair])[F.col("measure")]
    reach = 3 * (F.col("q3") - F.col("q1")) + width
    return quartiles.select(*keys, "measure", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def _wide(bounds: DataFrame, keys: list[str], level: str) -> DataFrame:
    picked = [
        F.max(F.when(F.col("measure") == m, F.struct("low", "high"))).alias(f"{level}_{m}") for m in MEASURES
    ]
    return bounds.groupBy(*[F.col(k).alias(f"_{level}_{k}") for k in keys]).agg(*picked)


def judge(
    docs: DataFrame, least_words: int = 20, most_repeats: int = 30, least_rows: int = 200
) -> DataFrame:
    """``docs`` without ``text``, with the counts, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than ``least_words`` words, or more than ``most_repeats`` per cent of them
    in repeated windows.  ``kept`` also wants every measure within the fences of the row's language
    and source; the sketches come from the rows that pass the base rules.  A (language, source) with
    fewer than ``least_rows`` such rows uses the merged sketch of its language, and where that is
    small too, of everything; with no sketch at all only the base rules hold.  Null language or
    source is a group of its own, null text is empty, repeated rows count as often as they occur.
    """
    columns = [c for c in docs.columns if c != "text"]
    # Counts are a few numbers per document; written once, read for the sketches and for the verdict.
    counted = cut(measures(text_counts(docs)).withColumn(
        "base_failed",
        (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words")),
    ))
    by_source = cut(sketch(counted.where(~F.col("base_failed")), ["lang", "source"], list(MEASURES)))
    by_lang = merge(by_source, ["lang"])
    levels = [
        (_wide(fences(by_source, ["lang", "source"], least_rows), ["lang", "source"], "s"), ["lang", "source"], "s"),
        (_wide(fences(by_lang, ["lang"], least_rows), ["lang"], "l"), ["lang"], "l"),
        (_wide(fences(merge(by_lang, []), [], 1), [], "a"), [], "a"),
    ]
    joined = counted
    for bounds, keys, level in levels:
        same = F.lit(True)
        for key in keys:
            same = same & joined[key].eqNullSafe(bounds[f"_{level}_{key}"])
        # The last level is one row.
        joined = joined.join(bounds, same, "left") if keys else joined.crossJoin(F.broadcast(bounds))
    inside = F.lit(True)
    for m in MEASURES:
        bound = F.coalesce(f"s_{m}", f"l_{m}", f"a_{m}")
        inside = inside & F.coalesce(F.col(m).between(bound["low"], bound["high"]), F.lit(True))
    return joined.select(*columns, *COUNTS, "base_failed", (~F.col("base_failed") & inside).alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``judge`` rejects, columns unchanged, whatever their names.

    A row is known by its id, language, source and a checksum of its text, so equal texts of different groups are
    judged each by its own.  Null ids, texts, languages and sources are values like others; equal rows stay or go
    together; an empty table stays empty.
    """
    keys = ["doc_id", "lang", "source", "sum"]
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(F.struct(*own).alias("row"), "doc_id", "lang", "source", F.hash("text").alias("sum"))
    summed = docs.select("doc_id", "lang", "source", "text", F.hash("text").alias("sum"))
    kept = judge(summed).where("kept").select(*[F.col(k).alias(f"kept_{k}") for k in keys])
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"kept_{key}"))
    return rows.join(kept, same, "left_semi").select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """``doc_id``, the five counts, ``base_failed`` and ``kept`` per document."""
    return judge(docs.select("doc_id", "lang", "source", "text")).select("doc_id", *COUNTS, "base_failed", "kept")


SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), split_up AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
), word_rows AS (
  SELECT r, generate_subscripts(words, 1) AS pos, unnest(words) AS w FROM split_up
), windows AS (
  SELECT r, pos, array_to_string(list(w) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), ' ') AS v,
    count(*) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS full8
  FROM word_rows
), starts AS (
  SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, v) AS times FROM windows WHERE full8 = 8) WHERE times > 1
), covered AS (
  SELECT r, sum(least(8, coalesce(nxt - pos, 8))) AS n FROM
    (SELECT r, pos, lead(pos) OVER (PARTITION BY r ORDER BY pos) AS nxt FROM starts) GROUP BY r
), counts AS (
  SELECT s.r, doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM split_up s LEFT JOIN covered c ON s.r = c.r
), measured AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN n_symbols * 1000000 // word_chars ELSE 0 END AS symbol_share,
    CASE WHEN n_lines > 0 THEN n_dup_lines * 1000000 // n_lines ELSE 0 END AS dup_line_share,
    CASE WHEN n_words > 0 THEN n_repeat_words * 1000000 // n_words ELSE 0 END AS repeat_share,
    CASE WHEN n_words > 0 THEN word_chars * 1000000 // n_words ELSE 0 END AS word_length
  FROM counts
), tall AS (
  UNPIVOT (SELECT r, lang, source, base_failed, symbol_share::BIGINT AS symbol_share, dup_line_share::BIGINT AS dup_line_share,
    repeat_share::BIGINT AS repeat_share, word_length::BIGINT AS word_length FROM measured)
  ON symbol_share, dup_line_share, repeat_share, word_length INTO NAME measure VALUE v
), rounded AS (
  SELECT *, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)::BIGINT) << (length(bin(v)) - 6)::BIGINT END AS b FROM tall
), keys AS (
  SELECT 's' AS level, lang, source, measure, b, 200 AS least FROM rounded WHERE NOT base_failed
  UNION ALL SELECT 'l', lang, NULL, measure, b, 200 FROM rounded WHERE NOT base_failed
  UNION ALL SELECT 'a', NULL, NULL, measure, b, 1 FROM rounded WHERE NOT base_failed
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY level, lang, source, measure ORDER BY b) AS upto,
    count(*) OVER (PARTITION BY level, lang, source, measure) AS total FROM keys
), quartiles AS (
  SELECT level, lang, source, measure, min(b) FILTER (upto * 4 >= total) AS q1, min(b) FILTER (upto * 4 >= total * 3) AS q3
  FROM ranked WHERE total >= least GROUP BY ALL
), bounds AS (
  SELECT level, lang, source, measure, q1 - reach AS low, q3 + reach AS high FROM (
    SELECT *, 3 * (q3 - q1) + CASE measure WHEN 'symbol_share' THEN 30000 WHEN 'word_length' THEN 1500000
      WHEN 'dup_line_share' THEN 400000 ELSE 300000 END
      AS reach FROM quartiles)
), inside AS (
  SELECT t.r, bool_and(CASE WHEN s.low IS NOT NULL THEN v BETWEEN s.low AND s.high
    WHEN l.low IS NOT NULL THEN v BETWEEN l.low AND l.high
    WHEN a.low IS NOT NULL THEN v BETWEEN a.low AND a.high ELSE true END) AS fine
  FROM tall t
  LEFT JOIN bounds s ON s.level = 's' AND s.lang IS NOT DISTINCT FROM t.lang
    AND s.source IS NOT DISTINCT FROM t.source AND s.measure = t.measure
  LEFT JOIN bounds l ON l.level = 'l' AND l.lang IS NOT DISTINCT FROM t.lang AND l.measure = t.measure
  LEFT JOIN bounds a ON a.level = 'a' AND a.measure = t.measure
  GROUP BY t.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fine AS kept
FROM measured JOIN inside USING (r)
"""
