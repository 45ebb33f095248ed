import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import grid
from tileweave.operators import frames, pixels as pz, resample as rs, stats, tone

RED, GREEN, BLUE, YELLOW, BLACK = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (255, 255, 0, 255), (0, 0, 0, 255)
OPS = {"cw": pz.rotate90, "r180": pz.rotate180, "ccw": pz.rotate270, "fliph": pz.flip_h, "flipv": pz.flip_v}


def random_image(w, h, seed=1):
    rng = random.Random(seed)
    return [[tuple(rng.randrange(256) for _ in range(3)) + (rng.choice((0, 90, 255)),) for _ in range(w)] for _ in range(h)]


@pytest.mark.parametrize(
    "op, expected",
    [
        ("cw", [[RED], [GREEN]]), ("ccw", [[GREEN], [RED]]), ("r180", [[GREEN, RED]]),
        ("fliph", [[GREEN, RED]]), ("flipv", [[RED, GREEN]]),
    ],
)
def test_two_pixel_image(px, op, expected):
    assert grid(OPS[op](px({1: [[RED, GREEN]]})))[1] == expected


def test_flips_of_a_colour_row(px):
    image = [[RED, GREEN, BLUE, YELLOW], [BLACK] * 4]
    assert grid(pz.flip_h(px({1: image})))[1] == [[YELLOW, BLUE, GREEN, RED], [BLACK] * 4]
    assert grid(pz.flip_v(px({1: image})))[1] == [[BLACK] * 4, [RED, GREEN, BLUE, YELLOW]]


def test_geometry_against_numpy(px):
    image = random_image(5, 3)
    a = np.array(image)
    expected = {"cw": np.rot90(a, -1), "r180": np.rot90(a, 2), "ccw": np.rot90(a), "fliph": a[:, ::-1], "flipv": a[::-1]}
    for op, fn in OPS.items():
        out = fn(px({1: image}))
        assert np.array_equal(np.array(grid(out)[1]), expected[op]), op
        first = out.first()
        assert (first.height, first.width) == expected[op].shape[:2]


def test_exif_orientations(px):
    a = np.array(random_image(4, 3))
    want = {
        1: a, 2: a[:, ::-1], 3: np.rot90(a, 2), 4: a[::-1], 5: a.transpose(1, 0, 2), 6: np.rot90(a, -1),
        7: np.rot90(a, 2).transpose(1, 0, 2), 8: np.rot90(a), 9: a, 0: a,
    }
    table = px({o: a.tolist() for o in want})
    out = grid(pz.exif_orient(table, F.col("image_id")))
    for o, expected in want.items():
        assert np.array_equal(np.array(out[o]), expected), o


def test_edit_lists_equal_one_by_one_application(spark, px):
    rng = random.Random(7)
    image = random_image(4, 3)
    lists = {i: [rng.choice(list(OPS)) for _ in range(rng.randrange(0, 12))] for i in range(1, 9)}
    edits = spark.createDataFrame(
        [(i, s, op) for i, ops in lists.items() for s, op in enumerate(ops)], "image_id bigint, seq bigint, op string"
    )
    table = px({i: image for i in lists})

    for block_size in (None, 1, 3):
        blocked = edits.withColumn("blk", F.floor(F.col("seq") / block_size).cast("bigint")) if block_size else edits
        out = grid(frames.apply_edits(table, blocked, block="blk" if block_size else None))
        for i, ops in lists.items():
            a = np.array(image)
            for op in ops:
                a = {"cw": lambda m: np.rot90(m, -1), "r180": lambda m: np.rot90(m, 2), "ccw": np.rot90,
                     "fliph": lambda m: m[:, ::-1], "flipv": lambda m: m[::-1]}[op](a)
            assert np.array_equal(np.array(out[i]), a), (block_size, ops)


def test_crop_keeps_the_rectangle(px):
    image = random_image(6, 5)
    out = pz.crop(px({1: image}), 2, 1, 3, 2)
    assert grid(out)[1] == [line[2:5] for line in image[1:3]]
    assert (out.first().width, out.first().height) == (3, 2)


def test_raster_round_trip(px):
    image = random_image(3, 4)
    rasters = pz.from_pixels(px({1: image, 2: [[RED]]}))
    assert rasters.filter("image_id = 1").first().data == bytes(v for line in image for r, g, b, a in line for v in (b, g, r, a))
    assert grid(pz.to_pixels(rasters)) == {1: image, 2: [[RED]]}
    assert grid(pz.to_pixels(rasters, spread_lines=True)) == {1: image, 2: [[RED]]}
    opaque = grid(pz.to_pixels(pz.from_pixels(px({1: image}), alpha=False)))[1]
    assert opaque == [[(*p[:3], 255) for p in line] for line in image]


def test_gray_raster(spark):
    rasters = spark.createDataFrame([(1, 2, 1, 1, bytearray([0, 200]))], "image_id int, width int, height int, nChannels int, data binary")
    assert grid(pz.to_pixels(rasters))[1] == [[(0, 0, 0, 255), (200, 200, 200, 255)]]


def test_overlay_clears_colour_under_zero_alpha(px):
    out = grid(pz.overlay_on_canvas(px({1: [[(9, 8, 7, 0), RED]]}), 4, 3, 1, 1))[1]
    empty = (0, 0, 0, 0)
    assert out == [[empty] * 4, [empty, empty, RED, empty], [empty] * 4]


def test_overlay_cuts_what_overhangs(px):
    assert grid(pz.overlay_on_canvas(px({1: [[RED, GREEN, BLUE]]}), 2, 1, -1, 0))[1] == [[GREEN, BLUE]]


def test_histogram_ignores_alpha(px):
    table = px({1: [[RED, (0, 255, 0, 0), BLUE]]})
    got = {(r.channel, r.bin): r.cnt for r in stats.histogram(table).collect()}
    assert got == {("R", 255): 1, ("R", 0): 2, ("G", 255): 1, ("G", 0): 2, ("B", 255): 1, ("B", 0): 2}
    dense = stats.histogram_dense(table)
    assert dense.count() == 768
    assert dense.agg(F.sum("cnt")).first()[0] == 9


def test_rebin_heights(px):
    rows = stats.histogram_rebin(stats.histogram(px({1: [[RED, RED, BLUE]]})), 10).collect()
    got = {(r.channel, r.col): (r.cnt, r.height) for r in rows}
    assert got[("R", 9)] == (2, 1.0) and got[("R", 0)] == (1, 0.5)


def test_full_desaturation_is_gray(px):
    for line in grid(tone.saturation(px({1: random_image(5, 5)}), -100.0))[1]:
        for r, g, b, _ in line:
            assert r == g == b


def test_tone_by_hand(px):
    table = px({1: [[(10, 128, 250, 77)]]})
    assert grid(tone.brightness(table, 20))[1][0][0] == (30, 148, 255, 77)
    assert grid(tone.brightness(table, -20))[1][0][0] == (0, 108, 230, 77)
    assert grid(tone.contrast(table, -100.0))[1][0][0] == (127, 127, 127, 77)
    assert grid(tone.gamma(table, 1.0))[1][0][0] == (10, 128, 250, 77)
    assert grid(tone.adjust(table))[1][0][0] == (10, 128, 250, 77)


def test_gamma_direction_and_equivalence_of_both_forms(px):
    table = px({1: random_image(6, 6)})
    assert tone.gamma_lut(0.5)[64] > 64 > tone.gamma_lut(2.0)[64]
    assert grid(tone.gamma(table, 2.2)) == grid(tone.gamma(table, F.lit(2.2)))


def test_saturation_doubles_distance_from_luma(px):
    r, g, b, _ = grid(tone.saturation(px({1: [[(100, 110, 120, 255)]]}), 100.0))[1][0][0]
    luma = 0.299 * 100 + 0.587 * 110 + 0.114 * 120
    assert (r, g, b) == tuple(round(luma + (v - luma) * 2) for v in (100, 110, 120))


def test_masks_truncate(spark):
    df = spark.createDataFrame([(v,) for v in (-0.5, 0.0, 0.5, 0.999, 1.0, 7.0)], "m double")
    assert [r[0] for r in df.select(tone.mask_to_alpha("m")).collect()] == [0, 0, 127, 254, 255, 255]


def pull_resample(a, w, h, kernel):
    """Brute force: every target pixel gathers its taps."""
    radius, k = kernel

    def axis(m, n_out):
        n = m.shape[0]
        if n == n_out:
            return m
        step = n / n_out
        f = max(step, 1.0)
        out = np.zeros((n_out,) + m.shape[1:])
        for t in range(n_out):
            weights = np.array([k((s + 0.5 - (t + 0.5) * step) / f) for s in range(n)])
            out[t] = np.tensordot(weights / weights.sum(), m, axes=(0, 0))
        return out

    full = axis(axis(a.astype(float).transpose(1, 0, 2), w).transpose(1, 0, 2), h)
    return np.clip(np.floor(np.round(full, 6) + 0.5), 0, 255).astype(int)


KERNELS = {
    "bilinear": (1, lambda d: max(1 - abs(d), 0)),
    "lanczos3": (3, lambda d: np.sinc(d) * np.sinc(d / 3) if abs(d) < 3 else 0.0),
    "catmullrom": (2, lambda d: (1.5 * abs(d) ** 3 - 2.5 * d * d + 1) if abs(d) < 1 else (-0.5 * abs(d) ** 3 + 2.5 * d * d - 4 * abs(d) + 2) if abs(d) < 2 else 0.0),
    "mitchell": (2, lambda d: (7 / 6 * abs(d) ** 3 - 2 * d * d + 8 / 9) if abs(d) < 1 else (-7 / 18 * abs(d) ** 3 + 2 * d * d - 10 / 3 * abs(d) + 16 / 9) if abs(d) < 2 else 0.0),
}


@pytest.mark.parametrize("name", KERNELS)
@pytest.mark.parametrize("size", [(3, 2), (11, 9), (7, 3)])
def test_resample_against_brute_force(px, name, size):
    a = np.array(random_image(7, 5, seed=3))
    got = np.array(grid(rs.resample(px({1: a.tolist()}), *size, filter_=name))[1])
    assert np.array_equal(got, pull_resample(a, *size, KERNELS[name]))


def test_resample_axis_order_and_mixed_sizes(px):
    table = px({1: random_image(7, 5), 2: random_image(4, 3)})
    one = grid(rs.resample(table, 4, 3))
    two = grid(rs.resample(table, 4, 3, rows_first=True))
    assert one == two
    assert one[2] == random_image(4, 3)  # already that size


@pytest.mark.parametrize("size", [(1, 1), (3, 2), (5, 4), (13, 11)])
def test_nearest_against_brute_force(px, size):
    w, h = size
    a = np.array(random_image(5, 4))
    want = [[tuple(a[int((y + 0.5) * 4 / h)][int((x + 0.5) * 5 / w)]) for x in range(w)] for y in range(h)]
    assert grid(rs.resample(px({1: a.tolist()}), w, h, "nearest"))[1] == [[tuple(int(v) for v in p) for p in line] for line in want]


def test_normalize_chw(px):
    rows = tone.normalize_chw(px({1: [[(255, 0, 128, 255)]]})).orderBy("c").collect()
    want = [(1 - 0.485) / 0.229, (0 - 0.456) / 0.224, (128 / 255 - 0.406) / 0.225]
    assert [r.c for r in rows] == [0, 1, 2]
    assert [r.v for r in rows] == pytest.approx(want)


def test_masking_a_collection(px):
    from tileweave.plans.masking import mask_images

    images = {1: random_image(7, 5), 2: random_image(4, 6, seed=2)}

    def predict(session, tensor):
        return tensor[0, 0] * session  # red channel, scaled past both ends of [0, 1]

    out = grid(mask_images(px(images), lambda: np.float32(0.4), predict, side=6))
    for i, image in images.items():
        a = np.array(image)
        small = pull_resample(a, 6, 6, KERNELS["lanczos3"])[:, :, :3].astype("float32")
        red = (small[:, :, 0] / np.float32(255) - np.float32(0.485)) / np.float32(0.229)
        mask = (np.clip(red * np.float32(0.4), 0, 1) * 255).astype("uint8").astype(int)
        alpha = pull_resample(mask[:, :, None], a.shape[1], a.shape[0], KERNELS["lanczos3"])[:, :, 0]
        got = np.array(out[i])
        assert np.array_equal(got[:, :, :3], a[:, :, :3])
        assert np.array_equal(got[:, :, 3], alpha)


def test_tasks_follow_the_number_of_pixels(spark, monkeypatch):
    from tileweave.operators import pixels

    monkeypatch.setattr(pixels, "PIXELS_PER_TASK", 400)
    # Adaptive execution merges partitions of few bytes; those of the last aggregation are not to be merged.
    sheet = spark.range(40).select(F.col("id").alias("image_id"), F.lit(0).alias("x"), F.lit(0).alias("y"), *[F.lit(200).alias(c) for c in "rgba"], F.lit(1).alias("width"), F.lit(1).alias("height"))
    out = pixels.overlay_on_canvas(sheet, 16, 16, 3, 5)
    per_task = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 40 * 256 and max(per_task) < 2000
    assert out.filter("a > 0").select("x", "y").distinct().collect() == [(3, 5)]
