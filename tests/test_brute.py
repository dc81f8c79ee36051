"""Distributed answers against plain loops on small random inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.operators import cleanup, datasets, features, masks, ordering, sampling, smoothing, superpixels
from maskloom.operators.components import connected_components

RNG = np.random.default_rng(5)


def blocky(height, width, classes, cell=1):
    coarse = RNG.integers(0, classes, ((height + cell - 1) // cell, (width + cell - 1) // cell))
    return np.kron(coarse, np.ones((cell, cell), dtype=int))[:height, :width]


def components(mask):
    out, n = np.zeros(mask.shape, dtype=int), 0
    for r, c in zip(*np.nonzero(mask)):
        if out[r, c]:
            continue
        n += 1
        stack = [(r, c)]
        out[r, c] = n
        while stack:
            y, x = stack.pop()
            for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
                i, k = y + dy, x + dx
                if 0 <= i < mask.shape[0] and 0 <= k < mask.shape[1] and mask[i, k] and not out[i, k]:
                    out[i, k] = n
                    stack.append((i, k))
    return out, n


@pytest.fixture(scope="module")
def maps():
    return {1: blocky(13, 17, 3), 2: blocky(16, 11, 4, 2), 3: np.ones((9, 14), dtype=int), 4: blocky(12, 12, 2)}


@pytest.fixture(scope="module")
def px(raster, maps):
    return raster({i: {"label": m.tolist()} for i, m in maps.items()})


def as_maps(df, maps, column="label"):
    out = {i: np.full(m.shape, -1) for i, m in maps.items()}
    for r in df.collect():
        out[r["image_id"]][r["row"], r["col"]] = r[column]
    return out


def test_components_across_tiles(px, maps):
    rows = connected_components(px, "label", tile=4).collect()
    for image, grid in maps.items():
        mine = {(r["row"], r["col"]): (r["comp"], r["size"]) for r in rows if r["image_id"] == image}
        assert len(mine) == grid.size
        for value in np.unique(grid):
            labels, n = components(grid == value)
            for k in range(1, n + 1):
                cells = list(zip(*np.nonzero(labels == k)))
                first = min(cells)
                assert {mine[tuple(map(int, c))] for c in cells} == {((int(first[0]) << 32) | int(first[1]), len(cells))}


@pytest.mark.parametrize("tile", [4, 64])
def test_blobs(px, maps, tile):
    got = as_maps(cleanup.remove_small_blobs(px, "label", 4, tile=tile), maps)
    for image, grid in maps.items():
        want = grid.copy()
        for value in np.unique(grid)[np.unique(grid) > 0]:
            labels, n = components(grid == value)
            for k in range(1, n + 1):
                if (labels == k).sum() < 4:
                    want[labels == k] = 0
        assert (got[image] == want).all()


@pytest.mark.parametrize("tile", [4, 64])
def test_holes(px, maps, tile):
    got = as_maps(cleanup.fill_small_holes(px, "label", 9, tile=tile), maps)
    for image, grid in maps.items():
        want = grid.copy()
        for value in np.unique(grid)[np.unique(grid) > 0]:
            labels, n = components(want != value)
            for k in range(1, n + 1):
                if (labels == k).sum() < 9:
                    want[(labels == k) & (want == 0)] = value
        assert (got[image] == want).all()


def test_band(px, maps):
    got = as_maps(cleanup.boundary_ignore_band(px, "label", 2), maps)
    for image, grid in maps.items():
        edge = np.zeros(grid.shape, dtype=bool)
        edge[:, 1:] |= grid[:, 1:] != grid[:, :-1]
        edge[:, :-1] |= grid[:, 1:] != grid[:, :-1]
        edge[1:] |= grid[1:] != grid[:-1]
        edge[:-1] |= grid[1:] != grid[:-1]
        want = grid.copy()
        for r in range(grid.shape[0]):
            for c in range(grid.shape[1]):
                if any((y - r) ** 2 + (x - c) ** 2 <= 4 for y, x in zip(*np.nonzero(edge))):
                    want[r, c] = 0
        assert (got[image] == want).all()


def test_tiny_regions_one_by_one(px, maps):
    got = as_maps(cleanup.cleanup_tiny_regions(px, "label", 4, [0, 1, 2, 3], tile=5), maps)
    for image, grid in maps.items():
        want = grid.copy()
        for value in np.unique(grid):
            labels, n = components(want == value)
            for k in range(1, n + 1):
                piece = labels == k
                if piece.sum() >= 4:
                    continue
                rim = np.zeros_like(piece)
                rim[1:] |= piece[:-1]
                rim[:-1] |= piece[1:]
                rim[:, 1:] |= piece[:, :-1]
                rim[:, :-1] |= piece[:, 1:]
                rim &= ~piece
                if rim.any():
                    seen, counts = np.unique(want[rim], return_counts=True)
                    want[piece] = seen[counts.argmax()]
        assert (got[image] == want).all()


# --- merging ----------------------------------------------------------------------------------

def one_by_one(cover, action, min_area):
    taken, verdicts = {}, {}
    for rank in sorted(cover):
        image, cells = cover[rank]
        used = taken.setdefault(image, set())
        free = cells - used
        if action == "skip" and len(free) < len(cells):
            verdicts[rank] = "dropped_overlap"
        elif action == "trim" and not free:
            verdicts[rank] = "dropped_overlap"
        elif len(free if action == "trim" else cells) < min_area:
            verdicts[rank] = "dropped_small"
        else:
            verdicts[rank] = "kept"
            used |= free if action == "trim" else cells
    return verdicts


@pytest.mark.parametrize("action,min_area", [("skip", 1), ("skip", 5), ("trim", 1), ("trim", 6), ("allow", 5)])
def test_merge_overlap(spark, action, min_area):
    rnd, cover = random.Random(3), {}
    for rank in range(1, 121):
        y, x, h, w = rnd.randrange(14), rnd.randrange(14), rnd.randrange(1, 6), rnd.randrange(1, 6)
        cover[rank] = (rnd.choice([1, 1, 1, 2]), {(r, c) for r in range(y, y + h) for c in range(x, x + w)})
    rows = [(i, rank, r, c) for rank, (i, cells) in cover.items() for r, c in cells]
    df = spark.createDataFrame(rows, "image_id bigint, rank bigint, row int, col int")
    owned, verdicts = datasets.merge_overlap(df, action, min_area)
    want = one_by_one(cover, action, min_area)
    assert {r["rank"]: r["verdict"] for r in verdicts.collect()} == want
    if action != "allow":
        final, seen = {}, set()
        for rank in sorted(cover):
            if want[rank] == "kept":
                image, cells = cover[rank]
                final |= {(image, *p): rank for p in cells if (image, *p) not in seen}
                seen |= {(image, *p) for p in cells}
        assert {(r["image_id"], r["row"], r["col"]): r["rank"] for r in owned.collect()} == final


# --- graph smoothing --------------------------------------------------------------------------

@pytest.fixture(scope="module")
def graph(spark):
    rows, edges = [], []
    for image in (1, 2):
        n = 9
        unary = RNG.random((n, 3)) * 2
        rows += [(image, i, unary[i].tolist()) for i in range(n)]
        pairs = {tuple(sorted(RNG.choice(n, 2, replace=False).tolist())) for _ in range(14)}
        edges += [(image, a, b, float(RNG.random())) for a, b in sorted(pairs)]
    return (
        rows, edges, spark.createDataFrame(rows, "image_id bigint, seg_id bigint, unary array<double>"),
        spark.createDataFrame(edges, "image_id bigint, src bigint, dst bigint, w double"),
    )


def sweep(rows, edges, smooth, sweeps):
    out = {}
    for image in {r[0] for r in rows}:
        unary = {s: u for i, s, u in rows if i == image}
        labels = {s: int(np.argmin(u)) for s, u in unary.items()}
        near = {s: [] for s in unary}
        for i, a, b, w in edges:
            if i == image:
                near[a].append((b, w))
                near[b].append((a, w))
        for _ in range(sweeps):
            before = dict(labels)
            for s in sorted(unary):
                cost = [u + smooth * sum(w for o, w in near[s] if labels[o] != k) for k, u in enumerate(unary[s])]
                labels[s] = int(np.argmin(cost))
            if labels == before:
                break
        out |= {(image, s): v for s, v in labels.items()}
    return out


@pytest.mark.parametrize("limit", [1000, 1])
def test_smoothing_in_order(graph, limit):
    rows, edges, v, e = graph
    got = smoothing.smooth_labels(v, e, 0.9, 2, group_limit=limit)
    assert {(r["image_id"], r["seg_id"]): r["label"] for r in got.collect()} == sweep(rows, edges, 0.9, 2)


def test_energy_never_rises(graph):
    _, _, v, e = graph
    trace = [smoothing.graph_energy(smoothing.initial_labels(v), e, 0.9)]
    for n in (1, 3):
        labels = smoothing.smooth_labels(v, e, 0.9, n)
        trace.append(smoothing.graph_energy(v.join(labels, ["image_id", "seg_id"]), e, 0.9))
    values = [{r["image_id"]: r["energy"] for r in t.collect()} for t in trace]
    for before, after in zip(values, values[1:]):
        assert all(after[i] <= before[i] + 1e-6 for i in before)


# --- filters ----------------------------------------------------------------------------------

def mirrored(a, pad):
    return np.pad(a, pad, mode="symmetric")


def test_gabor_and_tensor_against_direct_sums(raster):
    r, g, b = (RNG.integers(0, 256, (11, 14)) for _ in range(3))
    px = raster({1: {"r": r.tolist(), "g": g.tolist(), "b": b.tolist()}})
    off = dict(use_rgb=False, use_hsv=False, use_lab=False, gaussian_sigmas=(), use_sobel=False)
    config = features.FeatureConfig(
        **off, gabor_frequencies=(0.3,), gabor_thetas=(30.0,), gabor_parts=("real", "imag", "mag"),
        tensor=("eigenvalues", "coherence", "orientation"), tensor_sigma=0.7, tensor_rho=0.0,
    )
    rows = features.feature_stack(px, config).collect()
    gray = (r * 0.2125 + g * 0.7154 + b * 0.0721) / 255
    theta, f = math.radians(30), 0.3
    sigma = math.sqrt(math.log(2) / 2) / math.pi * 3 / f
    reach = math.ceil(max(abs(3 * sigma * math.cos(theta)), abs(3 * sigma * math.sin(theta)), 1))
    span = range(-reach, reach + 1)
    wide = mirrored(gray, reach)
    response = np.zeros(gray.shape, dtype=complex)
    for y in span:
        for x in span:
            weight = math.exp(-0.5 * (x * x + y * y) / sigma**2) / (2 * math.pi * sigma**2)
            wave = np.exp(2j * math.pi * f * (x * math.cos(theta) + y * math.sin(theta)))
            response += weight * wave * wide[reach - y: reach - y + 11, reach - x: reach - x + 14]
    near = mirrored(gray, 1)
    at = lambda dy, dx: near[1 + dy: 12 + dy, 1 + dx: 15 + dx]
    gy = sum(w * (at(1, d) - at(-1, d)) for d, w in ((-1, 1), (0, 2), (1, 1)))
    gx = sum(w * (at(d, 1) - at(d, -1)) for d, w in ((-1, 1), (0, 2), (1, 1)))
    radius = int(4 * 0.7 + 0.5)
    taps = np.array([math.exp(-0.5 * (k / 0.7) ** 2) for k in range(-radius, radius + 1)])
    taps /= taps.sum()

    def blur(a):
        p = mirrored(a, radius)
        p = sum(w * p[:, k: k + 14] for k, w in enumerate(taps))
        return sum(w * p[k: k + 11] for k, w in enumerate(taps))

    rr, rc, cc = blur(gy * gy), blur(gy * gx), blur(gx * gx)
    for row in rows:
        at_px = row["row"], row["col"]
        assert abs(row["gabor_f0.3_t30_real"] - response.real[at_px]) < 1e-6
        assert abs(row["gabor_f0.3_t30_imag"] - response.imag[at_px]) < 1e-6
        assert abs(row["gabor_f0.3_t30_mag"] - abs(response[at_px])) < 1e-6
        low, high = np.linalg.eigvalsh([[rr[at_px], rc[at_px]], [rc[at_px], cc[at_px]]])
        assert abs(row["structure_tensor_lambda1"] - high) < 1e-5 and abs(row["structure_tensor_lambda2"] - low) < 1e-5
        assert 0 <= row["structure_tensor_orientation"] <= 1


@pytest.mark.parametrize("method", ["uniform", "default", "ror"])
def test_lbp_constant_image_and_range(raster, method):
    px = raster({1: {"v": [[7] * 6] * 5}})
    codes = {(r["row"], r["col"]): r["lbp"] for r in features.lbp_codes(px, "v", 8, 1, method).collect()}
    assert codes[2, 3] == {"uniform": 8, "default": 255, "ror": 255}[method]
    assert len(codes) == 30


# --- runs -------------------------------------------------------------------------------------

def test_rle_round_trip(spark):
    rnd, cells = random.Random(9), []
    for mask in range(80):
        density = rnd.choice([0.05, 0.3, 0.5, 0.9, 1.0])
        cells += [(mask, i // 7, i % 7) for i in range(35) if rnd.random() < density or i == mask % 35]
    px = spark.createDataFrame(cells, "id int, row int, col int")
    counts = masks.rle_counts(masks.flat_runs(px, ["id"], 5, column_major=True), ["id"], 35)
    text = counts.select("id", masks.compress_counts(F.col("counts")).alias("text"))
    again = masks.decompress_counts(text, ["id"], "text")
    first = {r["id"]: r["counts"] for r in counts.collect()}
    assert {r["id"]: r["counts"] for r in again.collect()} == first
    assert all(sum(v) == 35 for v in first.values())
    back = masks.flat_runs_to_pixels(masks.counts_to_flat_runs(again, ["id"]), ["id"], 5, column_major=True)
    assert {(r["id"], r["row"], r["col"]) for r in back.collect()} == set(cells)


def test_compressed_text_of_large_counts(spark):
    values = [0, 1, 15, 16, 31, 32, 1000, 5, 70000, 3, 2**31]
    df = spark.createDataFrame([(1, values)], "id int, counts array<bigint>")
    text = df.select("id", masks.compress_counts(F.col("counts")).alias("text"))
    assert masks.decompress_counts(text, ["id"], "text").first()["counts"] == values


def test_known_compressed_text(spark):
    # Two-step deltas start at the fourth count; each 5-bit group is offset by 48.
    df = spark.createDataFrame([(1, [6, 1, 40, 4, 5, 4, 5, 4, 21])], "id int, counts array<bigint>")
    assert df.select(masks.compress_counts(F.col("counts")).alias("t")).first()["t"] == "61X13mN000`0"


# --- order, samples, segments -----------------------------------------------------------------

def test_order_helpers_with_a_hot_key(spark):
    rows = [(0 if i % 3 else i % 5, (i * 7919) % 1009, i % 4) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, o int, v int").withColumn("id", F.monotonically_increasing_id())
    got = ordering.ordered_index(df, ["o", "id"], "n", ["k"]).collect()
    summed = {r["id"]: r["s"] for r in ordering.running_total(df, ["o", "id"], "v", "s", ["k"]).collect()}
    for key in {r["k"] for r in got}:
        mine = sorted((r for r in got if r["k"] == key), key=lambda r: (r["o"], r["id"]))
        assert [r["n"] for r in mine] == list(range(1, len(mine) + 1))
        total = 0
        for r in mine:
            total += r["v"]
            assert summed[r["id"]] == total
    top = ordering.top_k(df, ["k"], ["o", "id"], 3).collect()
    for key in {r["k"] for r in got}:
        mine = sorted((r["o"], r["id"]) for r in got if r["k"] == key)[:3]
        assert sorted((r["o"], r["id"]) for r in top if r["k"] == key) == mine


def test_quota_fills_in_image_order(spark, raster):
    px = raster({i: {"label": [[1, 1, 2], [1, 0, 2]]} for i in range(1, 6)})
    subsets = spark.createDataFrame([(i, "train") for i in range(1, 6)], "image_id bigint, subset string")
    order = spark.createDataFrame([(i, 6 - i) for i in range(1, 6)], "image_id bigint, position int")
    taken = sampling.sample_per_class_quota(px, "label", subsets, 7, order, 1)
    counts = {(r["image_id"], r["class_id"]): r["n"] for r in taken.groupBy("image_id", "class_id").agg(F.count("*").alias("n")).collect()}
    assert {k: v for k, v in counts.items() if k[1] == 1} == {(5, 1): 3, (4, 1): 3, (3, 1): 1}
    assert sum(v for (_, c), v in counts.items() if c == 2) == 7 and sum(v for (_, c), v in counts.items() if c == 0) == 5
    again = sampling.sample_per_class_quota(px.repartition(7), "label", subsets, 7, order, 1)
    assert set(map(tuple, again.collect())) == set(map(tuple, taken.collect()))


@pytest.mark.parametrize("n,share,val", [(1, 0.5, 0), (10, 0.25, 2), (3, 0.1, 1), (4, 0.0, 0), (2, 1.0, 0)])
def test_split(spark, n, share, val):
    images = spark.range(n).withColumnRenamed("id", "image_id")
    out = sampling.split_train_val(images, share, 3).collect()
    assert sum(r["subset"] == "val" for r in out) == val and len(out) == n


def test_superpixels_cover_and_connect(spark, raster):
    grid = np.kron(RNG.integers(0, 256, (4, 5)), np.ones((6, 6), dtype=int))
    px = raster({1: {"v": grid.tolist()}})
    images = spark.createDataFrame([(1, *grid.shape)], "image_id bigint, height int, width int")
    segs = superpixels.superpixels(px, ["v"], images, wanted=100, rounds=2, tile=7)
    rows = segs.collect()
    assert len(rows) == grid.size == len({(r["row"], r["col"]) for r in rows})
    ids = np.zeros(grid.shape, dtype=np.int64)
    for r in rows:
        ids[r["row"], r["col"]] = r["seg_id"]
    for s in np.unique(ids):
        assert components(ids == s)[1] == 1
    again = superpixels.superpixels(px.repartition(5), ["v"], images, wanted=100, rounds=2, tile=7)
    assert set(map(tuple, again.collect())) == set(map(tuple, rows))


def test_lineage_raises_on_cycles(spark):
    from maskloom.operators.revisions import lineage

    rows = spark.createDataFrame([(1, None), (2, 1), (3, 4), (4, 3)], "revision_id bigint, parent_revision_id bigint")
    assert {r["revision_id"]: r["depth"] for r in lineage(rows.where("revision_id < 3")).collect()} == {1: 0, 2: 1}
    with pytest.raises(ValueError, match="own ancestors"):
        lineage(rows)


def test_superpixel_settings_are_read_per_image(spark, raster):
    grid = [[(r * 7 + c * 3) % 50 for c in range(40)] for r in range(40)]
    px = raster({1: {"v": grid}, 2: {"v": grid}, 3: {"v": grid}})
    images = spark.createDataFrame(
        [(1, 40, 40, 100, 1e9), (2, 40, 40, 400, 1e9), (3, 40, 40, None, None)],
        "image_id bigint, height int, width int, n_segments int, compactness double",
    )
    segs = superpixels.superpixels(px, ["v"], images, area=16, rounds=2)
    counts = {r[0]: r[1] for r in segs.select("image_id", "seg_id").distinct().groupBy("image_id").count().collect()}
    assert counts[1] == 100 and counts[2] == 400 and counts[3] <= 100


def test_loose_pieces_behind_loose_pieces_join(raster, grid_of):
    px = raster({1: {"seg_id": [[1, 1, 1, 2, 2, 2, 3, 3, 3, 1, 2, 1]]}})
    assert grid_of(superpixels.connect_segments(px), "seg_id") == [[1, 1, 1, 2, 2, 2, 3, 3, 3, 3, 3, 3]]


def test_superpixel_pixels_take_the_least_of_nine_seeds(spark):
    """One round by hand: equal costs go to the lowest id, a pixel without a value to the lowest around it."""
    side, rng = 40, random.Random(8)
    value = {(r, c): float(rng.choice([0, 0, 8, 9])) for r in range(side) for c in range(side)}
    value[5, 5] = None
    step = max((side * side / 100) ** 0.5, 1.0)
    across = -int(-side // step)
    cells = {}
    for r, c in value:
        cells.setdefault((int(r // step), int(c // step)), []).append((r, c))
    seeds = {}
    for (a, b), own in cells.items():
        known = [value[p] for p in own if value[p] is not None]
        seeds[a, b] = (sum(r for r, _ in own) / len(own), sum(c for _, c in own) / len(own), sum(known) / len(known))
    want = {}
    for (r, c), v in value.items():
        a, b = int(r // step), int(c // step)
        near = [(x, y) for x in (a - 1, a, a + 1) for y in (b - 1, b, b + 1) if (x, y) in seeds]
        want[r, c] = min(
            (0 if v is None else round((v - seeds[k][2]) ** 2 + ((r - seeds[k][0]) ** 2 + (c - seeds[k][1]) ** 2) * (10 / step) ** 2, 9),
             k[0] * across + k[1]) for k in near
        )[1]
    px = spark.createDataFrame([(1, r, c, v) for (r, c), v in value.items()], "image_id bigint, row int, col int, v double")
    images = spark.createDataFrame([(1, side, side)], "image_id bigint, height int, width int")
    got = superpixels.superpixels(px, ["v"], images, wanted=100, rounds=1, connect=False).collect()
    assert {(x["row"], x["col"]): x["seg_id"] for x in got} == want
    assert len(set(want.values())) > 50
