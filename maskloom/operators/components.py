"""4-connected components at any image size.

Images are cut into strips of raster lines.  Inside a strip runs of equal value that touch on neighbouring lines are
joined by union-find with numpy; pieces that meet across strips form a small graph, contracted by alternating
star rounds.  Labels are carried by runs, so nothing but the seams is listed pixel by pixel.
A component is named by its first pixel: ``row << 32 | col``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.session import cut

# Raster lines of a strip.
TILE = 16


def _roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index joined with each of ``count``: hook larger roots onto smaller ones, then shorten paths, until still."""
    label = np.arange(count)
    while True:
        la, lb = label[a], label[b]
        open_edges = la != lb
        if not open_edges.any():
            return label
        np.minimum.at(label, np.maximum(la, lb)[open_edges], np.minimum(la, lb)[open_edges])
        while not np.array_equal(label, label[label]):
            label = label[label]


def _label_strips(table: pa.Table, keys: list[str], value: str, schema: pa.Schema) -> pa.RecordBatch:
    """Runs with their piece, and pairs of pieces that touch, of whole strips in (keys, strip, row, col) order."""
    group = np.zeros(table.num_rows, bool)
    group[0] = True
    for name in [*keys, "_strip"]:
        column = table.column(name).combine_chunks()
        codes = pc.fill_null(column.dictionary_encode().indices, -1).to_numpy()
        group[1:] |= codes[1:] != codes[:-1]
    rows, cols = (table.column(n).to_numpy().astype(np.int64) for n in ("row", "col"))
    codes = pc.fill_null(table.column(value).combine_chunks().dictionary_encode().indices, -1).to_numpy()
    new_line = group.copy()
    new_line[1:] |= rows[1:] != rows[:-1]
    opened = new_line.copy()
    opened[1:] |= (cols[1:] != cols[:-1] + 1) | (codes[1:] != codes[:-1])
    first = np.flatnonzero(opened)
    lengths = np.diff(np.append(first, len(rows)))
    line = np.cumsum(new_line)[first]
    row, start, code = rows[first], cols[first], codes[first]
    # Lines that go on from the line before: the next row of the same strip.
    heads = np.flatnonzero(new_line)
    follows = np.concatenate([[False], (rows[heads[1:]] == rows[heads[:-1]] + 1) & ~group[heads[1:]], [False]])
    span = int(cols.max()) + 2
    begin, end = line * span + start, line * span + start + lengths
    # Runs of the next line that overlap a run are neighbours in order.
    low = np.searchsorted(end, begin + span, side="right")
    high = np.searchsorted(begin, end + span, side="left")
    counts = np.where(follows[line], np.maximum(high - low, 0), 0)
    above = np.repeat(np.arange(len(first)), counts)
    below = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    same = code[above] == code[below]
    root = _roots(len(first), above[same], below[same])
    piece = (row[root] << 32) | start[root]
    size = np.bincount(root, lengths, len(first)).astype(np.int64)[root]
    beside = np.flatnonzero((line[1:] == line[:-1]) & (end[:-1] == begin[1:]))
    one, other = root[np.concatenate([above[~same], beside])], root[np.concatenate([below[~same], beside + 1])]
    pairs = np.unique(np.minimum(one, other) * len(first) + np.maximum(one, other))
    one, other = pairs // len(first), pairs % len(first)
    at = pa.array(np.concatenate([first, first[one]]))
    none = np.zeros(len(one), np.int64)
    columns = {n: table.column(n).take(at) for n in [*keys, value]}
    columns |= {
        "row": np.concatenate([row, none - 1]), "col_start": np.concatenate([start, none]), "col_len": np.concatenate([lengths, none]),
        "comp": np.concatenate([piece, piece[one]]), "size": np.concatenate([size, none]),
        "other": np.concatenate([np.full(len(first), -1), piece[other]]),
    }
    out = pa.table({n: columns[n] for n in schema.names}).cast(schema).combine_chunks()
    return out.to_batches()[0] if out.num_rows else pa.RecordBatch.from_pylist([], schema)


def _strip_pieces(px: DataFrame, value: str, keys: list[str], tile: int) -> DataFrame:
    """Pieces inside strips: run rows, and rows of touching pieces (``comp, other``) with row -1."""
    kinds = dict(px.dtypes)
    fields = [*[(k, kinds[k]) for k in keys], ("row", "int"), ("col_start", "int"), ("col_len", "int"), (value, kinds[value]),
              ("comp", "bigint"), ("size", "bigint"), ("other", "bigint")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if schema is None:
                own = {n: table.schema.field(n).type for n in [*keys, value]}
                numbers = {"row": pa.int32(), "col_start": pa.int32(), "col_len": pa.int32(), "comp": pa.int64(), "size": pa.int64(), "other": pa.int64()}
                schema = pa.schema([(n, (own | numbers)[n]) for n, _ in fields])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            # The last strip may go on in the next batch.
            last = np.ones(table.num_rows, bool)
            for name in [*keys, "_strip"]:
                codes = pc.fill_null(table.column(name).combine_chunks().dictionary_encode().indices, -1).to_numpy()
                last &= codes == codes[-1]
            whole = table.num_rows - int(last.sum())
            if whole:
                yield _label_strips(table.slice(0, whole), keys, value, schema)
            held = table.slice(whole)
        if held is not None:
            yield _label_strips(held, keys, value, schema)

    tagged = px.select(*keys, F.expr(f"row DIV {tile}").alias("_strip"), "row", "col", value)
    order = [*keys, "_strip"]
    dealt = tagged.repartition(*order).sortWithinPartitions(*order, "row", "col")
    return dealt.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in fields))


def component_graph(
    px: DataFrame, value: str, keys: list[str] = ["image_id"], tile: int = TILE
) -> tuple[DataFrame, DataFrame]:
    """``(runs, sides)``: components of equal ``value`` by run, and pairs of components that touch.

    ``runs``: keys, row, col_start, col_len, value, comp, size, where size is the pixels of the component.
    ``sides``: keys, a, b with a < b, each pair once.  Absent pixels connect nothing and touch nothing.
    """
    local = cut(_strip_pieces(px, value, keys, tile))
    runs, touching = local.where("row >= 0").drop("other"), local.where("row < 0").select(*keys, F.col("comp").alias("a"), F.col("other").alias("b"))
    # Pixels on both sides of the seams: two lines of each strip.
    listed = F.explode(F.sequence("col_start", F.col("col_start") + F.col("col_len") - 1)).alias("col")
    lower = runs.where(f"row % {tile} = 0 AND row > 0").select(*keys, "row", listed, F.col(value).alias("_v"), F.col("comp").alias("_c"))
    upper = runs.where(f"row % {tile} = {tile - 1}").select(*keys, (F.col("row") + 1).alias("row"), listed, F.col(value).alias("_nv"), F.col("comp").alias("_nc"))
    met = cut(lower.join(upper.hint("merge"), [*keys, "row", "col"]).select(
        *keys, F.least("_c", "_nc").alias("a"), F.greatest("_c", "_nc").alias("b"), F.col("_v").eqNullSafe(F.col("_nv")).alias("_same")
    ).distinct())
    edges = met.where("_same").select(*keys, "a", "b")
    sides = touching.unionByName(met.where("NOT _same").select(*keys, "a", "b"))
    if edges.isEmpty():
        return runs, sides.distinct()
    roots = cut(resolve_components(edges, keys))
    members = roots.unionByName(roots.select(*keys, F.col("root").alias("node"), "root")).distinct()
    pieces = runs.groupBy(*keys, F.col("comp").alias("node")).agg(F.first("size").alias("_n"))
    sized = members.join(pieces, [*keys, "node"])
    totals = sized.groupBy(*keys, "root").agg(F.sum("_n").alias("_total"))
    joined = sized.drop("_n").join(totals, [*keys, "root"]).withColumnRenamed("node", "comp")
    named = runs.join(joined, [*keys, "comp"], "left").select(
        *keys, "row", "col_start", "col_len", value, F.coalesce("root", "comp").alias("comp"), F.coalesce("_total", "size").alias("size")
    )
    for end in ("a", "b"):
        at = roots.select(*keys, F.col("node").alias(end), F.col("root").alias("_root"))
        sides = sides.join(at, [*keys, end], "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    return named, sides.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def resolve_components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Undirected edges ``a, b`` within ``keys`` to ``keys, node, root`` (smallest node id).

    Alternates large-star and small-star rounds, which keep the edge count bounded and finish in a
    number of rounds logarithmic in component size.  Nodes that are their own root are left out.
    """
    work = edges.where("a <> b").select(
        *keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    work = cut(work)
    print_ = _fingerprint(work)
    if print_[0] == 0:
        return work.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = work.unionByName(work.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(lowest, [*keys, "u"]).select(
            *keys, F.col("v").alias("u"), F.col("m").alias("v")
        ).where("u <> v").distinct()
        lowest = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(lowest, [*keys, "u"])
        pairs = F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
        )
        work = cut(small.select(*keys, F.inline(pairs)).where("u <> v").distinct())
        now = _fingerprint(work)
        if now == print_:
            return work.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
        print_ = now


def _fingerprint(df: DataFrame) -> tuple:
    row = df.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def run_pixels(runs: DataFrame) -> DataFrame:
    """One row per pixel of runs; nothing is shuffled."""
    keep = [c for c in runs.columns if c not in ("col_start", "col_len")]
    return runs.select(*keep, F.explode(F.sequence("col_start", F.col("col_start") + F.col("col_len") - 1)).alias("col"))


def connected_components(
    px: DataFrame, value: str, keys: list[str] = ["image_id"], tile: int = TILE
) -> DataFrame:
    """Components of equal ``value``: adds ``comp`` and its pixel count ``size``.

    ``px`` holds ``keys, row, col, value`` (plus anything carried along); absent pixels connect
    nothing.  Images of every size take the same path.
    """
    named = run_pixels(component_graph(px, value, keys, tile)[0])
    carried = [c for c in px.columns if c not in (*keys, "row", "col", value)]
    if carried:
        named = px.join(named.drop(value).hint("merge"), [*keys, "row", "col"])
    return named.select(*px.columns, "comp", "size")
