"""Class lists and settings (survey group C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.operators import class_schema as cs
from maskloom.operators import configs as cf
from workload.registry import query

LIST_EXPR = """
SELECT o_custkey AS key, string_agg(CASE WHEN o_orderkey % 5 = 0 THEN ' ' WHEN o_orderkey % 2 = 0 THEN ' Class ' || o_orderkey % 9 ELSE 'class ' || o_orderkey % 9 END
  || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) ELSE ',' END, '' ORDER BY o_orderkey) AS names FROM orders GROUP BY o_custkey
"""


@query("class_names_parse", f"""
WITH l AS ({LIST_EXPR}), p AS (SELECT key, unnest(string_split(replace(names, ',', chr(10)), chr(10))) AS raw, unnest(range(len(string_split(replace(names, ',', chr(10)), chr(10))))) AS pos FROM l),
t AS (SELECT key, trim(raw) AS name, pos FROM p WHERE trim(raw) <> ''),
f AS (SELECT key, arg_min(name, pos) AS name, min(pos) AS pos FROM t GROUP BY key, lower(name))
SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS INTEGER) AS position, name FROM f
""")
def _parse(t):
    piece = F.expr(
        "concat(CASE WHEN o_orderkey % 5 = 0 THEN ' ' WHEN o_orderkey % 2 = 0 THEN concat(' Class ', o_orderkey % 9) "
        "ELSE concat('class ', o_orderkey % 9) END, IF(o_orderkey % 3 = 0, '\n', ','))"
    )
    lists = t.read("orders").groupBy(F.col("o_custkey").alias("key")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", piece.alias("p")))), lambda s: s["p"]), "").alias("names")
    )
    return cs.class_names(lists, "key", "names")


ENTRIES_SQL = """
SELECT o_custkey AS key, o_orderkey AS idx, CAST(o_orderkey % 8 - 1 AS INTEGER) AS class_id,
       CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE ' name ' || o_orderkey % 13 END AS name,
       CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 6 END AS class_order FROM orders
"""


def _entries(t):
    return t.read("orders").selectExpr(
        "o_custkey AS key", "o_orderkey AS idx", "cast(o_orderkey % 8 - 1 AS int) AS class_id",
        "IF(o_orderkey % 11 = 0, '  ', concat(' name ', o_orderkey % 13)) AS name",
        "IF(o_orderkey % 4 <> 0, o_orderkey % 6, NULL) AS class_order",
    )


NORMAL_SQL = f"""
SELECT key, class_id, name, CAST(row_number() OVER (PARTITION BY key ORDER BY co, class_id) - 1 AS INTEGER) AS class_order FROM (
  SELECT key, class_id, arg_min(trim(name), idx) AS name, arg_min(coalesce(class_order, idx), idx) AS co
  FROM ({ENTRIES_SQL}) e WHERE class_id > 0 AND trim(name) <> '' GROUP BY key, class_id) g
"""


@query("class_schema_normalize", NORMAL_SQL)
def _normalize(t):
    return cs.normalize_schema(_entries(t), "key")


@query("class_schema_next_id", f"""
SELECT g.key, greatest(coalesce(max(n.class_id) + 1, 1), g.given) AS next_class_id
FROM (SELECT o_custkey AS key, CAST(max(o_orderkey % 10) AS INTEGER) AS given FROM orders GROUP BY o_custkey) g
LEFT JOIN ({NORMAL_SQL}) n ON n.key = g.key GROUP BY g.key, g.given
""")
def _next_id(t):
    given = t.read("orders").groupBy(F.col("o_custkey").alias("key")).agg(
        F.max(F.expr("o_orderkey % 10")).cast("int").alias("next_class_id")
    )
    return cs.next_class_id(cs.normalize_schema(_entries(t), "key"), "key", given)


PROPOSED_SQL = """
SELECT key, name, CAST(row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS INTEGER) AS position FROM (
  SELECT o_custkey AS key, CASE WHEN min(o_orderkey) % 2 = 0 THEN 'Name ' ELSE 'name ' END || o_orderkey % 17 AS name, min(o_orderkey) AS pos
  FROM orders WHERE o_orderstatus <> 'O' GROUP BY o_custkey, o_orderkey % 17) a
"""

DIFF_SQL = f"""
WITH ex AS ({NORMAL_SQL}), pr AS ({PROPOSED_SQL}),
byn AS (SELECT key, lower(name) AS k, arg_max(class_id, class_order) AS class_id, arg_max(name, class_order) AS before FROM ex GROUP BY ALL),
pl AS (SELECT p.*, b.class_id, b.before FROM pr p LEFT JOIN byn b ON b.key = p.key AND b.k = lower(p.name)),
nn AS (SELECT key, position, name, row_number() OVER (PARTITION BY key ORDER BY position) AS n FROM pl WHERE class_id IS NULL),
sp AS (SELECT key, class_id, name AS before, row_number() OVER (PARTITION BY key ORDER BY class_order) AS n FROM ex
  WHERE NOT EXISTS (SELECT 1 FROM pl WHERE pl.key = ex.key AND pl.class_id = ex.class_id)),
tp AS (SELECT key, max(class_id) AS top FROM ex GROUP BY key), sc AS (SELECT key, count(*) AS c FROM sp GROUP BY key),
d AS (SELECT key, class_id, name, before, position, CASE WHEN before <> name THEN 'renamed' ELSE 'kept' END AS change FROM pl WHERE class_id IS NOT NULL
UNION ALL
SELECT coalesce(nn.key, sp.key), coalesce(sp.class_id, coalesce(tp.top, 0) + nn.n - coalesce(sc.c, 0)), nn.name, sp.before, nn.position,
  CASE WHEN nn.name IS NULL THEN 'removed' WHEN sp.class_id IS NULL THEN 'added' WHEN sp.before <> nn.name THEN 'renamed' ELSE 'kept' END
FROM nn FULL JOIN sp ON sp.key = nn.key AND sp.n = nn.n LEFT JOIN tp ON tp.key = coalesce(nn.key, sp.key) LEFT JOIN sc ON sc.key = coalesce(nn.key, sp.key))
"""


def _diff(t):
    existing = cs.normalize_schema(_entries(t), "key")
    firsts = t.read("orders").where("o_orderstatus <> 'O'").groupBy(
        F.col("o_custkey").alias("key"), F.expr("o_orderkey % 17").alias("m")
    ).agg(F.min("o_orderkey").alias("pos"))
    texts = firsts.selectExpr("key", "concat(IF(pos % 2 = 0, 'Name ', 'name '), m) AS names", "pos")
    joined = texts.groupBy("key").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "names"))), lambda s: s["names"]), ",").alias("names")
    )
    return cs.schema_diff(existing, cs.class_names(joined, "key", "names"), "key"), existing


@query("class_schema_diff", DIFF_SQL + """
SELECT key, CAST(class_id AS BIGINT) AS class_id, coalesce(name, '-') AS name, coalesce(before, '-') AS before, change FROM d
""")
def _schema_diff(t):
    diff, _ = _diff(t)
    return diff.select(
        "key", F.col("class_id").cast("bigint").alias("class_id"), F.coalesce("name", F.lit("-")).alias("name"),
        F.coalesce("before", F.lit("-")).alias("before"), "change",
    )


@query("class_schema_flags", DIFF_SQL + """,
m AS (SELECT d.key, bool_or(was < prev) AS reordered FROM (SELECT d.key, e.class_order AS was, lag(e.class_order) OVER (PARTITION BY d.key ORDER BY d.position) AS prev
  FROM d JOIN ex e ON e.key = d.key AND e.class_id = d.class_id WHERE d.change <> 'removed') d GROUP BY d.key)
SELECT d.key, sum((change = 'added')::INT)::BIGINT AS added, sum((change = 'removed')::INT)::BIGINT AS removed, sum((change = 'renamed')::INT)::BIGINT AS renamed,
  coalesce(bool_or(m.reordered), false) AS reordered, sum((change = 'removed')::INT) > 0 AS destructive
FROM d LEFT JOIN m ON m.key = d.key GROUP BY d.key
""")
def _schema_flags(t):
    return cs.diff_flags(*_diff(t), "key").drop("append_only")


@query("class_id_resolve", f"""
WITH s AS ({NORMAL_SQL}),
q AS (SELECT o_orderkey, o_custkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 9)::VARCHAR ELSE ' NAME ' || o_orderkey % 15 END AS value FROM orders)
SELECT q.o_orderkey, coalesce(max(s.class_id), min(n.class_id), -1) AS class_id FROM q
LEFT JOIN s ON s.key = q.key AND s.class_id = TRY_CAST(q.value AS INTEGER)
LEFT JOIN (SELECT key, lower(name) AS k, arg_min(class_id, class_order) AS class_id FROM s GROUP BY ALL) n ON n.key = q.key AND n.k = lower(trim(q.value))
GROUP BY q.o_orderkey
""")
def _resolve(t):
    asked = t.read("orders").selectExpr(
        "o_orderkey", "o_custkey AS key",
        "IF(o_orderkey % 2 = 0, cast(o_orderkey % 9 AS string), concat(' NAME ', o_orderkey % 15)) AS value",
    )
    schema = cs.normalize_schema(_entries(t), "key")
    return cs.resolve_class(asked, schema, "key", "value").select("o_orderkey", F.coalesce("class_id", F.lit(-1)).alias("class_id"))


@query("class_removal_cascade", """
SELECT path FROM masks WHERE (image_id, class_id) NOT IN (SELECT user_id, 1 + event_id % 3 FROM events WHERE event_type = 'signup' AND event_id % 5 = 0)
""", "masks")
def _cascade(t):
    removed = t.read("events").where("event_type = 'signup' AND event_id % 5 = 0").selectExpr(
        "user_id AS image_id", "cast(1 + event_id % 3 AS int) AS class_id"
    )
    return cs.drop_class_masks(t.masks, removed, ["image_id", "class_id"]).select("path")


@query("superpixel_effective_config", """
WITH i AS (SELECT DISTINCT o_custkey AS draft_id, o_orderkey % 40 AS image_id FROM orders),
o AS (SELECT o_custkey AS draft_id, o_orderkey % 40 AS image_id, max(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT i.draft_id, i.image_id, o.k IS NOT NULL AS overridden,
  CAST(greatest(least(coalesce(CASE WHEN o.k IS NOT NULL THEN CASE WHEN o.k % 3 <> 0 THEN o.k * 37 % 50000 END ELSE CASE WHEN c.c_custkey % 4 <> 0 THEN c.c_custkey * 91 % 60000 END END, 1200), 40000), 50) AS INTEGER) AS n_segments,
  greatest(least(coalesce(CASE WHEN o.k IS NOT NULL THEN o.k % 300 ELSE c.c_custkey % 250 END, 10), 200), 0.01)::DOUBLE AS compactness,
  greatest(least(coalesce(CASE WHEN o.k IS NULL THEN c.c_custkey % 14 END, 1.0), 10), 0)::DOUBLE AS sigma,
  CASE WHEN o.k IS NOT NULL AND o.k % 5 = 0 THEN 'slico' WHEN o.k IS NOT NULL AND o.k % 5 = 1 THEN 'slic' WHEN c.c_custkey % 3 = 0 THEN 'quickshift' ELSE 'slic' END AS algorithm,
  coalesce(CASE WHEN o.k % 2 = 0 THEN true END, c.c_custkey % 2 = 0) AND
  CASE WHEN o.k IS NOT NULL AND o.k % 5 <= 1 THEN true WHEN c.c_custkey % 3 = 0 THEN false ELSE true END AS texture_enabled
FROM i LEFT JOIN o ON o.draft_id = i.draft_id AND o.image_id = i.image_id LEFT JOIN customer c ON c.c_custkey = i.draft_id
""")
def _effective(t):
    orders = t.read("orders")
    images = orders.selectExpr("o_custkey AS draft_id", "o_orderkey % 40 AS image_id").distinct()
    overrides = orders.where("o_orderstatus = 'F'").groupBy(
        F.col("o_custkey").alias("draft_id"), F.expr("o_orderkey % 40").alias("image_id")
    ).agg(F.max("o_orderkey").alias("k")).selectExpr(
        "draft_id", "image_id", "IF(k % 3 <> 0, k * 37 % 50000, NULL) AS n_segments", "cast(k % 300 AS double) AS compactness",
        "cast(NULL AS double) AS sigma", "CASE k % 5 WHEN 0 THEN ' SLICO' WHEN 1 THEN 'weird' END AS algorithm",
        "IF(k % 2 = 0, true, NULL) AS texture_enabled",
    )
    defaults = t.read("customer").selectExpr(
        "c_custkey AS draft_id", "IF(c_custkey % 4 <> 0, c_custkey * 91 % 60000, NULL) AS n_segments",
        "cast(c_custkey % 250 AS double) AS compactness", "cast(c_custkey % 14 AS double) AS sigma",
        "IF(c_custkey % 3 = 0, 'quickshift', 'slic') AS algorithm", "c_custkey % 2 = 0 AS texture_enabled",
    )
    return cf.effective_superpixel_config(images, overrides, defaults)


@query("fn_settings_signature", """
SELECT p_partkey, 'a=' || CASE WHEN p_size % 2 = 0 THEN 'slic' ELSE 'slico' END || '|n=' || p_size * 50 || '|c=' || printf('%.6f', p_size / 4.0::DOUBLE)
  || '|s=' || printf('%.6f', (p_partkey % 8) / 2.0::DOUBLE) || '|cs=lab|tx={"enabled":false}' AS signature FROM part
""")
def _signature(t):
    rows = t.read("part").selectExpr(
        "p_partkey", "IF(p_size % 2 = 0, 'slic', 'slico') AS algorithm", "p_size * 50 AS n_segments",
        "p_size / 4D AS compactness", "(p_partkey % 8) / 2D AS sigma", "'LAB' AS colorspace",
    )
    return rows.select("p_partkey", cf.settings_signature(F.lit('{"enabled":false}')).alias("signature"))


@query("feature_names", """
WITH c AS (SELECT p_partkey AS key, p_size % 2 = 0 AS rgb, p_size % 3 = 0 AS lab, [1.0, p_size / 4.0, p_size % 5 + 0.125] AS sig,
  [CAST(1 + p_size % 3 AS INTEGER), 2] AS radii, [0.1, (p_size % 7 + 1) / 16.0] AS fr, [0.0, 45.0] AS th FROM part)
SELECT key, 0 AS "group", unnest(['rgb_r', 'rgb_g', 'rgb_b']) AS name FROM c WHERE rgb
UNION ALL SELECT key, 2, unnest(['lab_l', 'lab_a', 'lab_b']) FROM c WHERE lab
UNION ALL SELECT key, 3, 'gauss_' || rtrim(rtrim(printf('%.8f', CASE WHEN s < 1 THEN round_even(s * 1000, 0) / 1000 WHEN s < 10 THEN round_even(s * 100, 0) / 100 ELSE round_even(s * 10, 0) / 10 END::DOUBLE), '0'), '.') || k
  FROM (SELECT key, unnest(sig)::DOUBLE AS s FROM c) a CROSS JOIN (VALUES ('_r'), ('_g'), ('_b')) v(k)
UNION ALL SELECT key, 5, 'lbp_p8_r' || r FROM (SELECT key, unnest(list_distinct(radii)) AS r FROM c) b
UNION ALL SELECT key, 6, 'gabor_f' || rtrim(rtrim(printf('%.8f', CASE WHEN f < 0.1 THEN round_even(f * 10000, 0) / 10000 ELSE round_even(f * 1000, 0) / 1000 END::DOUBLE), '0'), '.') || '_t' || CASE WHEN t = 0 THEN '0' ELSE '45' END || '_mag'
  FROM (SELECT key, unnest(fr)::DOUBLE AS f, th FROM c) d, unnest(th) u(t)
UNION ALL SELECT key, 7, 'laws_' || p || '_w15' FROM c, (VALUES ('L5E5'), ('L5S5'), ('E5E5'), ('E5S5'), ('S5S5')) v(p)
""")
def _feature_names(t):
    configs = t.read("part").selectExpr(
        "p_partkey AS key", "p_size % 2 = 0 AS use_rgb", "false AS use_hsv", "p_size % 3 = 0 AS use_lab", "false AS use_sobel",
        "array(1D, p_size / 4D, p_size % 5 + 0.125D) AS gaussian_sigmas", "array(1 + p_size % 3, 2) AS lbp_radii", "8 AS lbp_points",
        "array(0.1D, (p_size % 7 + 1) / 16D) AS gabor_frequencies", "array(0D, 45D) AS gabor_thetas",
        "array('L5', 'E5', 'S5') AS laws_vectors", "15 AS laws_window", "false AS use_tensor",
        "cast(array() AS array<double>) AS local_stats_sigmas",
    )
    return cf.feature_name_rows(configs, "key").select("key", "group", "name")


@query("flatten_config", """
SELECT o_orderkey AS key, unnest(['a.b.depth', 'a.list', 'a.rate', 'name', 'on', 'none']) AS path,
  unnest([printf('%,d', o_orderkey * 1000), '[1,' || o_orderkey % 7 || ']', CASE WHEN o_orderkey % 8 = 0 THEN '0' ELSE rtrim(printf('%.5f', (o_orderkey % 8) / 8.0::DOUBLE), '0') END,
          'order ' || o_orderkey, 'true', '-']) AS value FROM orders
""")
def _flatten(t):
    docs = t.read("orders").selectExpr(
        "o_orderkey AS key",
        "parse_json(concat('{\"a\":{\"b\":{\"depth\":', o_orderkey * 1000, '},\"list\":[1,', o_orderkey % 7, '],\"rate\":', "
        "(o_orderkey % 8) / 8D, '},\"name\":\"order ', o_orderkey, '\",\"on\":true,\"none\":null}')) AS payload",
    )
    return cf.flatten_config(docs, "key", "payload")


@query("metric_rows", """
SELECT image_id, class_id, CASE WHEN iou IS NULL THEN 'incomplete' WHEN iou = 0 THEN 'zero' ELSE 'ok' END AS status,
  CASE WHEN iou IS NULL THEN '-' ELSE rtrim(rtrim(printf('%.5f', iou), '0'), '.') END AS display FROM (
  SELECT image_id, class_id, round_even(sum((true_class = class_id AND pred_raw = class_id)::INT)
    / nullif(sum((true_class = class_id OR pred_raw = class_id)::INT), 0)::DOUBLE, 5) AS iou FROM px CROSS JOIN classes GROUP BY ALL) a
""", "px classes")
def _metric_rows(t):
    from maskloom.operators.statistics import iou_accuracy
    from workload.tables import CLASS_IDS

    scored = iou_accuracy(t.px, "true_class", "pred_raw", CLASS_IDS, ["image_id"])
    return cf.iou_rows(scored).select("image_id", "class_id", "status", "display")


@query("metric_distribution", """
SELECT image_id, class_id, n, round_even(n / max(n) OVER (PARTITION BY image_id)::DOUBLE * 100, 4)::DOUBLE AS percent, printf('%,d', n * 10) AS display
FROM (SELECT image_id, pred_raw AS class_id, count(*) AS n FROM px GROUP BY ALL) c
""", "px")
def _distribution(t):
    counts = t.px.groupBy("image_id", F.col("pred_raw").alias("class_id")).agg(F.count("*").alias("n"))
    return cf.distribution_rows(counts, ["image_id"]).withColumn("display", F.format_number(F.col("n") * 10, 0))
