"""Lines that many documents share, dropped everywhere: DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ASCII white space that a line's key loses at both ends.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the plain function does the same where all is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_keys(text: Column) -> Column:
    """The key of every line, in order: trimmed and with A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda line: F.btrim(line, F.lit(BLANKS)))


def key_hash(key: Column) -> list[Column]:
    """Two 64-bit hashes of a key under different seeds: 128 bits tell keys apart at any corpus size."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def shared_lines(docs: DataFrame, id_column: str, min_docs: int, min_chars: int) -> DataFrame:
    """Hashes ``h1, h2`` of the keys found in at least ``min_docs`` documents.

    A key counts once an id, however many rows carry it, and null ids do not count.  Pairs of id and
    key are made distinct first, so a line that every document holds is spread by the ids; their
    counts are combined before the second exchange, where it is one small row per task.
    """
    keys = docs.select(F.col(id_column).alias("_id"), F.explode(F.array_distinct(line_keys(F.col("text")))).alias("key"))
    return (
        keys.where((F.length("key") >= min_chars) & F.col("_id").isNotNull())
        .select("_id", *key_hash(F.col("key"))).distinct()
        .groupBy("h1", "h2").agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_docs).select("h1", "h2")
    )


# A shared line's rows are dealt to so many parts by their id, and the few shared keys go to each.
PARTS = 16


def dedup_lines(docs: DataFrame, id_column: str, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``text`` freed of shared lines, and ``n_lines``, ``n_dropped`` (in place of columns so named).

    Hashed lines with their positions meet the shared keys in ``PARTS`` parts by id, so a line that a third of all
    documents hold is no single task; the dropped positions of a row go back to its text, whose other lines
    are joined in order.  A row is known by its id and a checksum of its text, so repeated and null ids are
    told apart, and equal rows get equal results.  Null text is one empty line and returns as the empty string.
    Other columns pass through, whatever their names; an empty table stays empty.
    """
    carried = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)]
    rows = docs.select(
        F.struct(*own).alias("row"), F.col(id_column).alias("id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("sum", F.hash("text"))
    part = F.pmod(F.xxhash64("id", "sum"), F.lit(PARTS)).cast("int").alias("part")
    lines = rows.select("id", "sum", part, F.posexplode(line_keys(F.col("text"))).alias("at", "key"))
    hashed = lines.where(F.length("key") >= min_chars).select("id", "sum", "part", "at", *key_hash(F.col("key")))
    shared = shared_lines(rows.select("id", "text"), "id", min_docs, min_chars).select(
        "h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    )
    dropped = hashed.join(shared, ["h1", "h2", "part"], "left_semi").groupBy(
        F.col("id").alias("gone_id"), F.col("sum").alias("gone_sum")
    ).agg(F.collect_set("at").alias("gone"))
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("sum") == F.col("gone_sum"))
    split = rows.join(dropped, same, "left").withColumn("parts", F.split("text", "\n"))
    n_lines = F.size("parts")
    kept = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("gone"))
    cut = split.withColumn("kept", F.when(F.col("gone").isNotNull(), kept))
    text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform("kept", lambda i: F.get("parts", i)), "\n")
    )
    return cut.select(
        *[text.alias(c) if c == "text" else F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(carried)],
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col("kept").isNull(), F.lit(0)).otherwise(n_lines - F.size("kept")).cast("long").alias("n_dropped"),
    )


def without_shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``text`` freed of shared lines; columns unchanged, whatever their names."""
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    packed = docs.select("doc_id", "text", F.struct(*own).alias("whole"))
    done = dedup_lines(packed, "doc_id", min_docs, min_chars)
    return done.select(*[
        F.col("text") if c == "text" else F.col("whole")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)
    ])


def line_dedup_digest(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` per document."""
    done = dedup_lines(docs.select("doc_id", "text"), "doc_id", min_docs, min_chars)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, s.key IS NOT NULL AS gone FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
