"""Scalar functions over table columns (survey group I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.functions import color, hashing, numbers, strings, times, vectors
from maskloom.functions.numbers import half_even
from workload.registry import query


@query("fn_string", """
SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'model') AS slug,
  regexp_replace(trim(url), '[^\\p{L}\\p{N}_.\\-]', '_', 'g') AS sanitized, regexp_extract(url, '([^/]*)$', 1) AS base
FROM (SELECT page_id AS doc_id, url FROM pages) p
""")
def _string(t):
    url = F.col("url")
    return t.read("pages").select(
        F.col("page_id").alias("doc_id"), strings.slugify(url).alias("slug"),
        strings.sanitize_class_name(url).alias("sanitized"), strings.base_name(url).alias("base"),
    )


@query("fn_title", """
SELECT job_id, CASE kind WHEN 'click' THEN 'Click Event' WHEN 'view' THEN 'View Event' WHEN 'purchase' THEN 'Purchase Event'
  WHEN 'signup' THEN 'Signup Event' ELSE 'Error Event' END AS label, event_id FROM job_events
""", "job_events")
def _title(t):
    return t.job_events.select("event_id", "job_id", strings.title_label(F.concat("kind", F.lit("_event"))).alias("label"))


@query("fn_bool_num", """
SELECT event_id, event_type IN ('click', 'view') AS flag,
  CASE WHEN event_id % 4 = 0 THEN 0.2::DOUBLE ELSE greatest(least(value, 60), 5) END AS clamped,
  CAST(round_even(greatest(least(event_id % 140 - 20, 100), 0) / 100.0::DOUBLE * 255, 0) AS INTEGER) AS u8,
  CASE WHEN event_id % 9 = 3 THEN '3' WHEN event_id % 9 = 0 OR event_id % 9 > 8 THEN '3' ELSE (event_id % 9)::VARCHAR || ',3' END AS ints
FROM events
""".replace("CASE WHEN event_id % 4 = 0 THEN 0.2::DOUBLE ELSE greatest(least(value, 60), 5) END",
            "greatest(least(CASE WHEN event_id % 4 = 0 THEN 20.0::DOUBLE ELSE value END, 60), 5)"))
def _bool_num(t):
    e = t.read("events")
    word = F.expr("CASE event_type WHEN 'click' THEN ' YES' WHEN 'view' THEN 'on' WHEN 'error' THEN 'no' ELSE 'maybe' END")
    text = F.expr("IF(event_id % 4 = 0, 'n/a', cast(value AS string))")
    ints = F.concat((F.col("event_id") % 9).cast("string"), F.lit(", 3, x,3, 99"))
    return e.select(
        "event_id", numbers.truthy(word).alias("flag"), numbers.clamp_or_default(text, 5, 60, 20.0).alias("clamped"),
        numbers.percent_to_u8(F.col("event_id") % 140 - 20).alias("u8"),
        F.array_join(numbers.csv_numbers(ints, "int", 1, 8).cast("array<string>"), ",").alias("ints"),
    )


@query("fn_hash", """
SELECT o_orderkey, sha256(o_orderstatus || o_custkey) AS digest, substring(sha1('{"a":' || o_custkey || '}'), 1, 16) AS signature,
  sha256(sha256('l' || o_orderkey) || sha256('p' || o_orderkey)) AS combined,
  sha256('{"input_images":["img_' || least(o_custkey::VARCHAR, o_orderkey::VARCHAR) || '","img_' || greatest(o_custkey::VARCHAR, o_orderkey::VARCHAR)
    || '"],"kind":"analysis","model_id":' || o_custkey || ',"postprocess_config":{"enabled":false},"workspace_id":7}') AS dedupe
FROM orders
""")
def _hash(t):
    o = t.read("orders")
    names = F.array(F.concat(F.lit(" img_"), "o_orderkey"), F.lit("  "), F.concat(F.lit("img_"), "o_custkey", F.lit(" ")))
    return o.select(
        "o_orderkey", F.sha2(F.concat("o_orderstatus", "o_custkey"), 256).alias("digest"),
        hashing.signature16(F.concat(F.lit('{"a":'), "o_custkey", F.lit("}"))).alias("signature"),
        hashing.combined_checksum(
            F.sha2(F.concat(F.lit("l"), "o_orderkey"), 256), F.sha2(F.concat(F.lit("p"), "o_orderkey"), 256)
        ).alias("combined"),
        hashing.analysis_dedupe_key(
            F.lit(7), F.col("o_custkey"), names, F.lit(hashing.canonical_json({"enabled": False}))
        ).alias("dedupe"),
    )


@query("fn_datetime", """
SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso,
  CASE WHEN event_id % 7 = 0 THEN '-' WHEN event_id % 7 = 1 THEN 'not a date' ELSE strftime(ts, '%b %d, %Y %I:%M %p') || CASE WHEN event_id % 7 = 2 THEN ' UTC' ELSE '' END END AS human
FROM events
""")
def _datetime(t):
    ts = F.col("ts").cast("timestamp")
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    raw = (
        F.when(F.col("event_id") % 7 == 0, F.lit("  ")).when(F.col("event_id") % 7 == 1, F.lit("not a date"))
        .when(F.col("event_id") % 7 == 2, F.concat(text, F.lit("+00:00"))).otherwise(text)
    )
    return t.read("events").select(
        "event_id", times.iso_text(ts).alias("iso"), times.human_datetime(raw).alias("human")
    )


@query("fn_metric_format", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '-' WHEN o_totalprice / 8 = floor(o_totalprice / 8) THEN printf('%,d', CAST(o_totalprice / 8 AS BIGINT))
  ELSE rtrim(rtrim(printf('%.5f', o_totalprice / 8), '0'), '.') END AS shown FROM orders
""")
def _metric(t):
    value = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice") / 8)
    return t.read("orders").select("o_orderkey", strings.metric_text(value).alias("shown"))


COLOR_SQL = """
WITH u AS (SELECT image_id, "row", col, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM px),
h AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM u),
l AS (SELECT *, CASE WHEN r > 0.04045 THEN pow((r + 0.055) / 1.055, 2.4) ELSE r / 12.92 END AS lr,
  CASE WHEN g > 0.04045 THEN pow((g + 0.055) / 1.055, 2.4) ELSE g / 12.92 END AS lg,
  CASE WHEN b > 0.04045 THEN pow((b + 0.055) / 1.055, 2.4) ELSE b / 12.92 END AS lb FROM h),
x AS (SELECT *, (lr * 0.412453::DOUBLE + lg * 0.357580::DOUBLE + lb * 0.180423::DOUBLE) / 0.95047::DOUBLE AS x,
  (lr * 0.212671::DOUBLE + lg * 0.715160::DOUBLE + lb * 0.072169::DOUBLE) AS y, (lr * 0.019334::DOUBLE + lg * 0.119193::DOUBLE + lb * 0.950227::DOUBLE) / 1.08883::DOUBLE AS z FROM l),
f AS (SELECT *, CASE WHEN x > 0.008856 THEN cbrt(x) ELSE 7.787::DOUBLE * x + 16.0 / 116.0::DOUBLE END AS fx,
  CASE WHEN y > 0.008856 THEN cbrt(y) ELSE 7.787::DOUBLE * y + 16.0 / 116.0::DOUBLE END AS fy,
  CASE WHEN z > 0.008856 THEN cbrt(z) ELSE 7.787::DOUBLE * z + 16.0 / 116.0::DOUBLE END AS fz FROM x)
SELECT image_id, "row", col, round_even(r * 0.2125::DOUBLE + g * 0.7154::DOUBLE + b * 0.0721::DOUBLE, 6)::DOUBLE AS gray_unit,
  round_even(CASE WHEN d = 0 THEN 0 ELSE ((CASE WHEN b = v THEN 4 + (r - g) / d WHEN g = v THEN 2 + (b - r) / d ELSE (g - b) / d END / 6)
     - floor(CASE WHEN b = v THEN 4 + (r - g) / d WHEN g = v THEN 2 + (b - r) / d ELSE (g - b) / d END / 6)) END, 6)::DOUBLE AS hsv_h,
  round_even(CASE WHEN v = 0 THEN 0 ELSE d / v END, 6)::DOUBLE AS hsv_s, round_even(v, 6)::DOUBLE AS hsv_v,
  round_even(116 * fy - 16, 4)::DOUBLE AS lab_l, round_even(500 * (fx - fy), 4)::DOUBLE AS lab_a, round_even(200 * (fy - fz), 4)::DOUBLE AS lab_b FROM f
"""


def _color(t):
    rgb = (F.col("r"), F.col("g"), F.col("b"))
    h, s, v = color.hsv(*rgb)
    lab_l, lab_a, lab_b = color.lab(*rgb)
    return t.px.select(
        "image_id", "row", "col", half_even(color.gray(*rgb), 6).alias("gray_unit"),
        half_even(h, 6).alias("hsv_h"), half_even(s, 6).alias("hsv_s"), half_even(v, 6).alias("hsv_v"),
        *[(half_even(c, 4) + F.lit(0.0)).alias(n) for c, n in ((lab_l, "lab_l"), (lab_a, "lab_a"), (lab_b, "lab_b"))],
    )


query("fn_color", COLOR_SQL, "px")(_color)


@query("fn_vector", """
WITH p AS (SELECT a.seg_id, a.lab AS la, b.lab AS lb, a.hist AS ha, b.hist AS hb FROM seg_feat a
  JOIN (SELECT label, min(seg_id) AS seed FROM seg_feat GROUP BY label) s ON s.label = a.label JOIN seg_feat b ON b.seg_id = s.seed)
SELECT seg_id, round_even(sqrt(list_sum(list_transform(list_zip(la, lb), lambda x: (x[1] - x[2]) * (x[1] - x[2])))), 6)::DOUBLE AS l2,
  round_even(0.5 * list_sum(list_transform(list_zip(ha, hb), lambda x: (x[1] - x[2]) * (x[1] - x[2]) / (x[1] + x[2] + 1e-9))), 6)::DOUBLE AS chi2,
  round_even(exp(ha[1] - list_max(ha)) / list_sum(list_transform(ha, lambda x: exp(x - list_max(ha)))), 6)::DOUBLE AS soft_first,
  CAST(list_position(ha, list_max(ha)) - 1 AS INTEGER) AS top
FROM p
""", "seg_feat")
def _vector(t):
    from maskloom.operators.similarity import with_seed

    pairs = with_seed(t.seg_feat, "label")
    return pairs.select(
        "seg_id", half_even(vectors.l2_distance(F.col("lab"), F.col("seed_lab")), 6).alias("l2"),
        half_even(vectors.chi_square(F.col("hist"), F.col("seed_hist")), 6).alias("chi2"),
        half_even(F.get(vectors.softmax(F.col("hist")), F.lit(0)), 6).alias("soft_first"),
        vectors.argmax_index(F.col("hist")).alias("top"),
    )


@query("fn_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS compact FROM events")
def _json(t):
    v = F.parse_json("props")
    return t.read("events").select("event_id", F.variant_get(v, "$.k", "bigint").alias("k"), F.to_json(v).alias("compact"))
