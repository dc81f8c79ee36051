"""Masks as run tables: polygons, run-length forms, overlap, union and difference.

A *line run* is ``(keys, row, col_start, col_len)``: it never crosses a raster line, so windows
that build it are bounded by one line of one image.  A *flat run* is ``(keys, start, len)`` over a
linear pixel index and may cross lines.
"""

from __future__ import annotations

from itertools import zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: class indices are unsigned 16-bit.
CLASS_BITS = 16
# Raster lines of a strip: masks that travel whole are cut at strips, so none is larger than a strip of its image.
STRIP = 64
# Pixels of run-length records turned at once; a larger record is turned by itself, as a bitmap.
TURNED_AT_ONCE = 1 << 21


# --- polygons ---------------------------------------------------------------------------------

def polygon_runs(
    polygons: DataFrame, keys: list[str], flat: str = "polygon", height="height", width="width"
) -> DataFrame:
    """Scan-convert flat x, y outlines into line runs clipped to the image; outlines of equal keys are one mask.

    Rule: a pixel belongs to the polygon when its centre is inside by the even-odd test, with
    half-open rows (``y1 <= row < y2``).  Outlines travel whole, if their keys are not together already, and are
    converted where they lie; crossings are never rows.  Outlines below three points and odd-length lists give nothing.
    """
    h = F.col(height) if isinstance(height, str) else F.lit(height)
    w = F.col(width) if isinstance(width, str) else F.lit(width)
    drawn = polygons.where(_usable(F.col(flat))).select(
        *keys, w.cast("int").alias("_w"), F.struct(h.cast("int").alias("h"), F.col(flat).cast("array<double>").alias("xy")).alias("_o")
    )
    masks = drawn.groupBy(*keys, "_w").agg(F.collect_list("_o").alias("_o"))
    return _scan(masks, keys)


def outline_runs(
    masks: DataFrame, keys: list[str], outlines: str = "outlines", height="height", width="width", whole: bool = False
) -> DataFrame:
    """:func:`polygon_runs` for rows that are whole masks, each with the list of its outlines: nothing is shuffled.

    With ``whole`` the lines of a mask stay together by strip: ``keys, strip, lines`` (row, start, stop of every run in turn).
    """
    h = F.col(height) if isinstance(height, str) else F.lit(height)
    w = F.col(width) if isinstance(width, str) else F.lit(width)
    drawn = F.transform(
        F.filter(F.col(outlines).cast("array<array<double>>"), lambda o: F.coalesce(_usable(o), F.lit(False))),
        lambda o: F.struct(h.cast("int").alias("h"), o.alias("xy")),
    )
    held = masks.select(*keys, w.cast("int").alias("_w"), drawn.alias("_o"))
    if whole:
        return _in_strips(held, keys, F.arrow_udf(lambda o, w: _strips(*_run_lists(_scanned(o, w))), STRIPS)("_o", "_w"))
    return _scan(held.where(F.size("_o") > 0), keys)


STRIPS = "array<struct<strip:int,lines:array<int>>>"


def _in_strips(masks: DataFrame, keys: list[str], strips: Column) -> DataFrame:
    return masks.select(*keys, strips.alias("_strips")).select(*keys, F.explode("_strips").alias("s")).select(*keys, "s.strip", "s.lines")


def _run_lists(runs: pa.Array) -> tuple:
    """Offsets, rows, starts and stops of lists of runs."""
    flat = runs.flatten()
    return (runs.offsets.to_numpy().astype(np.int64), *[pc.struct_field(flat, n).to_numpy().astype(np.int64) for n in ("row", "a", "b")])


def _strips(offsets: np.ndarray, row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Runs of masks, by row within a mask, as one list of strips for each mask."""
    mask = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    strip = row // STRIP
    new = np.ones(len(row), bool)
    new[1:] = (mask[1:] != mask[:-1]) | (strip[1:] != strip[:-1])
    first = np.flatnonzero(new)
    lines = pa.ListArray.from_arrays(
        pa.array(np.append(first, len(row)).astype(np.int32) * 3), pa.array(np.stack([row, start, stop], 1).ravel().astype(np.int32))
    )
    held = np.append(0, np.cumsum(np.bincount(mask[first], minlength=len(offsets) - 1))).astype(np.int32)
    parts = pa.StructArray.from_arrays([pa.array(strip[first].astype(np.int32)), lines], names=["strip", "lines"])
    return pa.ListArray.from_arrays(pa.array(held), parts)


def record_runs(records: DataFrame, keys: list[str], counts: str = "counts", height: str = "height") -> DataFrame:
    """Column-major run counts, background first, as masks by strip like those of :func:`outline_runs`: nothing is shuffled."""
    strips = F.arrow_udf(_turned, STRIPS)(F.col(counts).cast("array<bigint>"), F.col(height).cast("bigint"))
    return _in_strips(records, keys, strips)


def _turned(records: pa.Array, heights: pa.Array) -> pa.Array:
    """Line runs of a batch of records, a bounded number of pixels at once."""
    sizes = np.diff(records.offsets.to_numpy()).astype(np.int64)
    counts = np.asarray(records.flatten().fill_null(0)).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(counts)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    before = np.append(0, np.cumsum(counts))[:-1]
    start = before - np.repeat(before[np.minimum(np.cumsum(sizes) - sizes, max(len(counts) - 1, 0))], sizes) if len(counts) else counts
    tall = np.asarray(heights.fill_null(0)).astype(np.int64)
    held = (at % 2 == 1) & (counts > 0) & (tall[owner] > 0)
    owner, start, length = owner[held], start[held], counts[held]
    pixels = np.bincount(owner, length, len(sizes)).astype(np.int64)
    parts, first, total = [], 0, 0
    runs_of = np.append(0, np.cumsum(np.bincount(owner, minlength=len(sizes))))
    for record in range(len(sizes) + 1):
        if record == len(sizes) or (total and total + pixels[record] > TURNED_AT_ONCE):
            own = slice(runs_of[first], runs_of[record])
            turn = _turned_bitmap if record == first + 1 and total > TURNED_AT_ONCE else _turned_pixels
            parts.append(turn(owner[own], start[own], length[own], tall))
            first, total = record, 0
        if record < len(sizes):
            total += pixels[record]
    mask, row, begin, stop = (np.concatenate(c) for c in zip(*parts))
    return _strips(np.append(0, np.cumsum(np.bincount(mask, minlength=len(sizes)))), row, begin, stop)


def _turned_pixels(owner: np.ndarray, start: np.ndarray, length: np.ndarray, tall: np.ndarray) -> tuple:
    """Record, row, start and stop of the line runs of small records, from their sorted pixels."""
    if not len(owner):
        return owner, owner, owner, owner
    index = np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())
    record = np.repeat(owner, length)
    col, row = np.divmod(index, tall[record])
    wide, high = int(col.max()) + 2, int(row.max()) + 1
    place = np.sort(((record - owner[0]) * high + row) * wide + col)
    # A line has a free place at its end, so runs of two lines never touch.
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1] + 1))
    stop = np.append(place[first[1:] - 1], place[-1])
    line = place[first] // wide
    return line // high + owner[0], line % high, place[first] % wide, stop % wide + 1


def _turned_bitmap(owner: np.ndarray, start: np.ndarray, length: np.ndarray, tall: np.ndarray) -> tuple:
    """The same for one large record, a byte for each pixel."""
    high = int(tall[owner[0]])
    wide = -(-int((start + length).max()) // high)
    edge = np.zeros(high * wide + 1, np.int8)
    edge[start] += 1
    edge[start + length] -= 1
    bitmap = np.zeros((high, wide + 2), np.int8)
    bitmap[:, 1:-1] = np.cumsum(edge[:-1], dtype=np.int8).reshape(wide, high).T
    row, begin = np.nonzero(np.diff(bitmap, axis=1) == 1)
    _, stop = np.nonzero(np.diff(bitmap, axis=1) == -1)
    return np.full(len(row), owner[0]), row, begin, stop


def _usable(flat: Column) -> Column:
    return ((F.size(flat) / 2).cast("int") >= 3) & (F.size(flat) % 2 == 0)


def _scan(masks: DataFrame, keys: list[str]) -> DataFrame:
    runs = F.arrow_udf(_scanned, "array<struct<row:int,a:int,b:int>>")("_o", "_w")
    return masks.select(*keys, runs.alias("_runs")).select(*keys, F.explode("_runs").alias("p")).select(
        *keys, F.col("p.row").alias("row"), F.col("p.a").alias("col_start"), (F.col("p.b") - F.col("p.a")).alias("col_len")
    )


def _above(values: np.ndarray) -> np.ndarray:
    """Whole numbers at or above the values, as Spark's ``ceil`` gives them."""
    return np.clip(np.nan_to_num(np.ceil(values), nan=0.0), -(2.0**31), 2.0**31 - 1).astype(np.int64)


def _scanned(outlines: pa.Array, widths: pa.Array) -> pa.Array:
    """Runs ``row, a, b`` (``b`` excluded) of a batch of masks, each a list of outlines with the height of its image."""
    parts = outlines.flatten()
    lists = pc.struct_field(parts, "xy")
    points = np.diff(lists.offsets.to_numpy()) // 2
    mask = np.repeat(np.repeat(np.arange(len(outlines)), np.diff(outlines.offsets.to_numpy())), points)
    tall = np.repeat(np.asarray(pc.struct_field(parts, "h").fill_null(2**31 - 1)).astype(np.int64), points)
    flat = lists.flatten()
    known, flat = np.asarray(flat.is_valid()), np.asarray(flat.fill_null(0.0))
    x1, y1, x_known, y_known = flat[0::2], flat[1::2], known[0::2], known[1::2]
    after = np.arange(1, len(x1) + 1)
    ends = np.cumsum(points)
    after[ends - 1] = ends - points
    x2, y2 = x1[after], y1[after]
    # Level edges cross no line, nor do edges without a known height.
    sloped = y_known & y_known[after] & (y1 != y2) & ~(np.isnan(y1) & np.isnan(y2))
    with np.errstate(all="ignore"):
        first = np.maximum(_above(np.fmin(y1, y2)), 0)
        last = np.minimum(_above(np.maximum(y1, y2)) - 1, tall - 1)
        spans = np.where(sloped, np.maximum(last - first + 1, 0), 0)
        edge = np.repeat(np.arange(len(x1)), spans)
        row = first[edge] + np.arange(len(edge)) - np.repeat(np.cumsum(spans) - spans, spans)
        x = x1[edge] + (row - y1[edge]) * (x2[edge] - x1[edge]) / (y2[edge] - y1[edge])
    given = (x_known & x_known[after])[edge]
    x[~given] = np.nan
    order = np.lexsort((x, row, mask[edge]))
    x, row, given, owner = x[order], row[order], given[order], mask[edge][order]
    new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (row[1:] != row[:-1]))) if len(x) else np.zeros(0, int)
    met = np.add.reduceat(given, new, dtype=np.int64) if len(new) else new
    # Crossings are paired in turn.  Where unknown places leave none or one, an open end is the border of the image.
    pairs = met // 2
    line = np.repeat(np.arange(len(new)), pairs)
    at = new[line] + 2 * (np.arange(len(line)) - np.repeat(np.cumsum(pairs) - pairs, pairs))
    wide = np.asarray(widths.fill_null(2**31 - 1)).astype(np.int64)
    bounded = np.asarray(widths.is_valid())
    start, stop, line_owner = np.maximum(_above(x[at]), 0), np.minimum(_above(x[at + 1]), wide[owner[new][line]]), owner[new]
    lone = np.flatnonzero((met < 2) & bounded[line_owner]) if len(new) else new
    if len(lone):
        open_start = np.where(met[lone] == 1, np.maximum(_above(x[new[lone]]), 0), 0)
        line = np.concatenate([line, lone, lone])
        start = np.concatenate([start, open_start, np.zeros(len(lone), np.int64)])
        stop = np.concatenate([stop, wide[line_owner[lone]], wide[line_owner[lone]]])
        turn = np.argsort(line, kind="stable")
        line, start, stop = line[turn], start[turn], stop[turn]
    some = np.flatnonzero(stop > start)
    line, start, stop = line[some], start[some], stop[some]
    offsets = np.append(0, np.cumsum(np.bincount(line_owner[line], minlength=len(outlines)))).astype(np.int32)
    fields = [pa.array(v.astype(np.int32)) for v in (row[new][line], start, stop)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names=["row", "a", "b"]))


def runs_to_pixels(runs: DataFrame) -> DataFrame:
    """Line runs to one row per pixel."""
    keep = [c for c in runs.columns if c not in ("col_start", "col_len")]
    return runs.select(
        *keep, F.explode(F.sequence("col_start", F.col("col_start") + F.col("col_len") - 1)).alias("col")
    )


# --- run-length forms -------------------------------------------------------------------------

def line_runs(mask_px: DataFrame, keys: list[str], across: str = "row", along: str = "col") -> DataFrame:
    """Pixels to runs inside each line (gaps and islands); columns ``across, start, len``."""
    line = Window.partitionBy(*keys, across).orderBy(along)
    island = mask_px.select(
        *keys, across, along, (F.col(along) - F.row_number().over(line)).alias("_island")
    )
    return island.groupBy(*keys, across, "_island").agg(
        F.min(along).alias("start"), F.count("*").cast("int").alias("len")
    ).drop("_island")


def flat_runs(mask_px: DataFrame, keys: list[str], extent, column_major: bool = False) -> DataFrame:
    """Pixels to runs over the whole-image index.

    ``extent`` is the line length: the width for row-major order, the height for column-major.
    Pixels are reduced to line runs first; only those are ordered per mask to join runs that
    continue on the next line.
    """
    across, along = ("col", "row") if column_major else ("row", "col")
    size = F.col(extent) if isinstance(extent, str) else F.lit(extent)
    carried = [*keys, extent] if isinstance(extent, str) else list(keys)
    lines = line_runs(mask_px, carried, across, along).select(
        *keys, (F.col(across).cast("long") * size + F.col("start")).alias("_s"), F.col("len").alias("_n")
    )
    order = Window.partitionBy(*keys).orderBy("_s")
    opened = lines.withColumn(
        "_new", (F.lag(F.col("_s") + F.col("_n")).over(order).eqNullSafe(F.col("_s")) == F.lit(False)).cast("int")
    ).withColumn("_island", F.sum("_new").over(order))
    return opened.groupBy(*keys, "_island").agg(
        F.min("_s").alias("start"), F.sum("_n").alias("len")
    ).drop("_island")


def rle_counts(flat: DataFrame, keys: list[str], total) -> DataFrame:
    """Flat runs to alternating counts, background first: one array per mask, the record itself."""
    size = F.col(total) if isinstance(total, str) else F.lit(total)
    gathered = flat.groupBy(*keys, *([total] if isinstance(total, str) else [])).agg(
        F.sort_array(F.collect_list(F.struct("start", "len"))).alias("_r")
    )

    def piece(run: Column, i: Column) -> Column:
        before = F.get("_r", i - 1)
        gap = run["start"] - F.when(i == 0, F.lit(0)).otherwise(before["start"] + before["len"])
        return F.array(gap, run["len"])

    last = F.element_at("_r", -1)
    tail = size.cast("long") - (last["start"] + last["len"])
    body = F.flatten(F.transform("_r", piece))
    return gathered.select(
        *keys, F.when(tail > 0, F.concat(body, F.array(tail))).otherwise(body).alias("counts")
    )


def compress_counts(counts: Column) -> Column:
    """Counts to the 6-bit text form: delta to the count two before (from the fourth on), then
    5-bit groups, low first, with a continuation bit, offset 48."""
    return F.arrow_udf(_encoded, "string")(counts.cast("array<bigint>"))


def _encoded(records: pa.Array) -> pa.Array:
    """Texts of a batch of records; absent counts, and those two after them, write nothing."""
    sizes = np.diff(records.offsets.to_numpy())
    known = np.array([v is not None for v in records.to_pylist()], bool) if records.null_count else np.ones(len(sizes), bool)
    sizes = np.where(known, sizes, 0)
    flat = records.flatten()
    given = np.asarray(flat.is_valid())
    value = np.asarray(flat.fill_null(0)).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(value)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    two = np.flatnonzero(at > 2)
    delta = value.copy()
    delta[two] -= value[two - 2]
    written = given.copy()
    written[two] &= given[two - 2]
    needed = np.full(len(delta), 13)
    for n in range(12, 0, -1):
        needed[(delta >= -(1 << (5 * n - 1))) & (delta < (1 << (5 * n - 1)))] = n
    needed[~written] = 0
    place = np.arange(needed.sum()) - np.repeat(np.cumsum(needed) - needed, needed)
    more = place < np.repeat(needed, needed) - 1
    chars = ((np.repeat(delta, needed) >> (5 * place)) & 31) + np.where(more, 32, 0) + 48
    lengths = np.bincount(owner, needed, len(sizes)).astype(np.int64)
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    made = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(chars.astype(np.uint8).tobytes()))
    return pc.if_else(pa.array(known), made, pa.scalar(None, pa.string()))


def decompress_counts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """6-bit text back to counts, one record per ``keys``; absent and empty texts give none.

    Records travel as texts and are decoded where they lie; characters are never rows."""
    texts = df.where(F.length(text) > 0).groupBy(*keys).agg(F.sort_array(F.collect_list(text)).alias("_texts"))
    return texts.select(*keys, F.arrow_udf(_decoded, "array<bigint>")("_texts").alias("counts"))


def _decoded(texts: pa.Array) -> pa.Array:
    """Counts of a batch of records.  Texts of one record are read character by character in turn."""
    sizes = np.diff(texts.offsets.to_numpy())
    flat = texts.flatten().to_pylist()
    ends = np.cumsum(sizes)
    joined = [
        flat[end - 1] if size == 1 else "".join("".join(c) for c in zip_longest(*flat[end - size:end], fillvalue=""))
        for size, end in zip(sizes, ends)
    ]
    code = np.frombuffer("".join(joined).encode("utf-32-le"), np.uint32).astype(np.int64) - 48
    record = np.repeat(np.arange(len(joined)), [len(t) for t in joined])
    # A value ends where no more bit is set, and at the end of its record.
    last = np.append(record[1:] != record[:-1], True) if len(record) else np.zeros(0, bool)
    stop = np.flatnonzero(((code & 32) == 0) | last)
    if not len(stop):
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(joined) + 1, np.int32)), pa.array([], pa.int64()))
    begin = np.append(0, stop[:-1] + 1)
    place = np.arange(len(code)) - np.repeat(begin, stop - begin + 1)
    digit = (code & 31) << (5 * place)
    signed = ((code & 32) == 0) & ((code & 16) > 0)
    digit -= np.where(signed, np.int64(32) << (5 * place), 0)
    value, owner = np.add.reduceat(digit, begin), record[stop]
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    counts = np.bincount(owner, minlength=len(joined))
    at = np.arange(len(value)) - np.repeat(first, np.diff(np.append(first, len(value))))
    # Undo the stride-2 deltas: the first count stands alone, then odd and even chains add up.
    for own in (at % 2 == 1, (at % 2 == 0) & (at > 0)):
        chain = np.cumsum(np.where(own, value, 0))
        before = np.repeat(np.append(0, chain)[first], np.diff(np.append(first, len(value))))
        value = np.where(own, chain - before, value)
    offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(value, pa.int64()))


def counts_to_flat_runs(df: DataFrame, keys: list[str], counts: str = "counts") -> DataFrame:
    """Alternating counts to foreground flat runs (odd positions)."""
    parts = df.select(*keys, F.posexplode(counts).alias("_i", "_n"))
    order = Window.partitionBy(*keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("start", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    return placed.where((F.col("_i") % 2 == 1) & (F.col("_n") > 0)).select(
        *keys, "start", F.col("_n").cast("long").alias("len")
    )


def flat_runs_to_pixels(flat: DataFrame, keys: list[str], extent, column_major: bool = False) -> DataFrame:
    size = F.col(extent) if isinstance(extent, str) else F.lit(extent)
    index = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("_idx")
    cells = flat.select(*keys, size.alias("_size"), index)
    across, along = F.floor(F.col("_idx") / F.col("_size")).cast("int"), (F.col("_idx") % F.col("_size")).cast("int")
    row, col = (along, across) if column_major else (across, along)
    return cells.select(*keys, row.alias("row"), col.alias("col"))


def split_rle(df: DataFrame, counts: str, height, width, use_rle: bool = True) -> tuple[DataFrame, DataFrame]:
    """Usable run-length records, and rejected ones with a reason.

    ``use_rle=False`` sets every record aside, as does a count list that does not fill the image.
    """
    h = F.col(height) if isinstance(height, str) else F.lit(height)
    w = F.col(width) if isinstance(width, str) else F.lit(width)
    filled = F.aggregate(F.col(counts).cast("array<bigint>"), F.lit(0).cast("long"), lambda a, v: a + v)
    reason = (
        F.when(~F.lit(use_rle), F.lit("run-length masks are switched off"))
        .when(F.col(counts).isNull(), F.lit("no counts"))
        .when(F.exists(counts, lambda v: v < 0), F.lit("negative count"))
        .when(filled != h.cast("long") * w, F.lit("counts do not fill the image"))
    )
    tagged = df.withColumn("reason", reason)
    return tagged.where("reason IS NULL").drop("reason"), tagged.where("reason IS NOT NULL")


def roi_runs(df: DataFrame, keys: list[str], runs: str, height: str, width: str) -> DataFrame:
    """Row-major flat ROI runs, clipped to the image; empty ones dropped."""
    total = F.col(height).cast("long") * F.col(width)
    spans = df.select(*keys, height, width, total.alias("_t"), F.explode(runs).alias("_r"))
    start = F.least(F.greatest(F.col("_r.start").cast("long"), F.lit(0)), F.col("_t"))
    end = F.least(start + F.col("_r.len"), F.col("_t"))
    return spans.where("_r.len > 0").select(
        *keys, width, start.alias("start"), (end - start).alias("len")
    ).where("len > 0")


# --- painting and set algebra -----------------------------------------------------------------

POLICIES = ("higher_area_wins", "last_annotation_wins")


def paint_order(ann: DataFrame, policy: str, order: list[str], area: str = "area", out: str = "paint_rank") -> DataFrame:
    """A painting rank that orders all annotations: later paints over earlier.

    The rank is what the annotations are ordered by, so it costs no sorting of all of them and nothing is stored.
    """
    if policy not in POLICIES:
        raise ValueError(f"unsupported overlap policy: {policy}")
    columns = [area, *order] if policy == "higher_area_wins" else list(order)
    return ann.withColumn(out, F.struct(*columns))


def overlap_resolve(cover: DataFrame, label: str = "class_id", rank: str = "paint_rank", image: str = "image_id") -> DataFrame:
    """The label map: per pixel the class painted last.

    Rank and 16-bit class are packed in one BIGINT, so a pixel under thousands of annotations is
    still one long maximum, combined map-side.
    """
    packed = F.shiftleft(F.col(rank).cast("long"), CLASS_BITS).bitwiseOR(F.col(label).cast("long"))
    top = cover.groupBy(image, "row", "col").agg(F.max(packed).alias("_top"))
    return top.select(
        image, "row", "col", F.col("_top").bitwiseAND((1 << CLASS_BITS) - 1).cast("int").alias(label)
    )


def mask_union(*masks: DataFrame) -> DataFrame:
    """Distinct pixels over all masks (same columns)."""
    merged = masks[0]
    for other in masks[1:]:
        merged = merged.unionByName(other)
    return merged.distinct()


def mask_difference(saved: DataFrame, frozen: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels of ``saved`` that are not frozen for the same keys."""
    on = [*keys, "row", "col"]
    return saved.join(frozen.select(*on).distinct(), on, "left_anti")


def touched_regions(mask_px: DataFrame, segments: DataFrame, keys: list[str], image: str = "image_id") -> DataFrame:
    """Distinct regions under each mask."""
    at = segments.select(image, "row", "col", "seg_id")
    return mask_px.join(at.hint("merge"), [image, "row", "col"]).select(*keys, "seg_id").distinct()


def class_runs(label_px: DataFrame, label: str, image: str = "image_id") -> DataFrame:
    """Label map split into per-class line runs, background left out: what mask files hold."""
    fg = label_px.where(F.col(label) > 0).withColumn("class_id", F.col(label))
    return line_runs(fg, [image, "class_id"]).select(
        image, "class_id", "row", F.col("start").alias("col_start"), F.col("len").alias("col_len")
    )
