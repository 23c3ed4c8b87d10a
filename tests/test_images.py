"""Corruptions by literal levels, the fan-out, and the scoring stage."""

from __future__ import annotations

import numpy as np
import pytest

from plumbline.functions import pixels
from plumbline.operators import images
from plumbline.plans import relation

SCHEMA = "sample_id string, height int, width int, pixels binary, true_label string"


def grey(*rows):
    return np.repeat(np.array(rows, np.uint8)[None, ..., None], 3, -1)


def test_brightness_and_contrast_drop_the_fraction():
    x = grey([100, 101, 250, 3])
    assert pixels.brightness(x, 1.2)[0, 0, :, 0].tolist() == [120, 121, 255, 3]
    assert pixels.brightness(x, 0.8)[0, 0, :, 0].tolist() == [80, 80, 200, 2]
    y = grey([100, 200, 100, 200])  # about the mean, 150
    assert pixels.contrast(y, 1.15)[0, 0, :, 0].tolist() == [92, 207, 92, 207]
    assert pixels.contrast(y, 0.85)[0, 0, :, 0].tolist() == [107, 192, 107, 192]


def test_noise_is_alike_for_every_image():
    x = np.full((3, 5, 4, 3), 128, np.uint8)
    made = pixels.noise(x, 8)
    want = np.clip(128 + np.random.default_rng(42).normal(0, 8, (5, 4, 3)).astype(np.float32), 0, 255).astype(np.uint8)
    assert (made == want).all() and not (pixels.noise(x, 8, 7) == want).all()


def test_blurs_of_a_point():
    x = np.zeros((1, 11, 11, 3), np.uint8)
    x[0, 5, 5] = 255
    assert pixels.blur(x, 5)[0, 5, 3:8, 0].tolist() == [6, 24, 36, 24, 6]  # 255 x 6/16 x (1, 4, 6, 4, 1)/16
    assert (pixels.blur(x, 4) == pixels.blur(x, 5)).all() and (pixels.blur(x, 1) == x).all()
    disc = pixels.defocus(x, 7)[0, :, :, 1]
    assert (disc > 0).sum() == 29 and set(disc[disc > 0]) == {9} and disc[5, 2] == 9 and disc[3, 3] == 9 and disc[2, 3] == 0
    edge = grey([10, 20, 30, 40, 50])  # mirrored about the outermost: 30 20 10 20 30
    assert pixels.blur(np.repeat(edge, 5, 1), 5)[0, 2, 0, 0] == round((30 + 80 + 60 + 80 + 30) / 16)
    with pytest.raises(ValueError):
        pixels.blur(x, 0)


def test_hue():
    x = np.array([[[[255, 0, 0], [0, 255, 0], [0, 0, 255], [80, 80, 80], [0, 0, 0]]]], np.uint8)
    assert [c[0, 0].tolist() for c in pixels.hue_of(x)] == [[0, 60, 120, 0, 0], [255, 255, 255, 0, 0], [255, 255, 255, 80, 0]]
    made = pixels.stain(x, 12)[0, 0]
    assert made.tolist() == [[255, 102, 0], [0, 255, 102], [102, 0, 255], [80, 80, 80], [0, 0, 0]]
    rng = np.random.default_rng(1)
    y = rng.integers(0, 256, (2, 9, 7, 3)).astype(np.uint8)
    back = pixels.rgb_of(*pixels.hue_of(y)).astype(int)
    assert np.abs(back - y).max() <= 4 and np.abs(back - y).mean() < 1  # hue has 180 steps
    assert (pixels.stain(pixels.stain(x, 12), 168)[0, 0] == x[0, 0]).all()


def test_jpeg():
    flat = np.full((1, 10, 13, 3), 77, np.uint8)
    assert np.abs(pixels.jpeg(flat, 45).astype(int) - 77).max() <= 1
    slope = grey(*[[8 * i + 4 * j for j in range(16)] for i in range(16)])
    made = pixels.jpeg(slope, 45)
    assert made.shape == slope.shape and np.abs(made.astype(int) - slope).mean() < 4
    noisy = np.random.default_rng(3).integers(0, 256, (1, 16, 16, 3)).astype(np.uint8)
    error = [np.abs(pixels.jpeg(noisy, q).astype(int) - noisy).mean() for q in (95, 45, 5)]
    assert error[0] < error[1] < error[2]
    # One cosine of the luminance: its coefficient, 8 x 30.25 / 2 at (0, 1), goes to the nearest multiple of (11 x 111 + 50) // 100 = 12.
    wave = np.rint(128 + 30 * np.cos((2 * np.arange(8) + 1) * np.pi / 16))
    plane = np.repeat(wave[None, None], 8, 1)
    step, k = 12, np.arange(8)
    dct = lambda p: (p - 128).sum() * np.sqrt(1 / 8) * 0 + (np.sqrt(8) * 0.5 * ((p[0] - 128) * np.cos((2 * k + 1) * np.pi / 16)).sum())
    kept = dct(pixels._quantised(plane, pixels.LUMINANCE, 45)[0])
    assert abs(kept - step * round(dct(plane[0]) / step)) < 3


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(n=6, shape=(8, 8)):
    rng = np.random.default_rng(n)
    return [(f"s{i}", *shape, bytearray(rng.integers(0, 256, (*shape, 3)).astype(np.uint8).tobytes()), f"c{i % 4}") for i in range(n)]


def test_fan_out(spark):
    odd = [("none", 8, 8, None, "c0"), ("short", 8, 8, bytearray(b"abc"), "c1"), ("size", None, 8, bytearray(b"abc"), None)]
    found = images.fan_out(table(spark, rows_of() + rows_of(2, (3, 5)) + odd)).collect()
    assert len(found) == 8 * 10 + 3
    assert sorted(r["sample_id"] for r in found if r["error"]) == ["none", "short", "size"]
    one = {r["perturbation"]: r for r in found if r["sample_id"] == "s3"}
    assert [one[v[0]]["variant_id"] for v in pixels.VARIANTS] == ["original", "brightness_increase_1.2", "brightness_decrease_0.8", "contrast_increase_1.15", "contrast_decrease_0.85", "gaussian_noise_sigma_8", "gaussian_blur_kernel_5", "stain_hue_shift_12", "defocus_blur_kernel_7", "jpeg_quality_45"]
    x = np.frombuffer(one["original"]["pixels"], np.uint8).reshape(1, 8, 8, 3)
    assert bytes(one["defocus_blur"]["pixels"]) == pixels.defocus(x, 7).tobytes()
    assert {r["perturbation"] for r in images.fan_out(table(spark, rows_of(1)), ("dark",)).collect()} == {"original", "dark"}
    assert images.fan_out(table(spark, rows_of(1)).limit(0)).count() == 0


def test_memory_is_bounded_whatever_the_batch():
    import tracemalloc

    import pyarrow as pa

    def peak(n):
        x = np.random.default_rng(n).integers(0, 256, (n, 8, 8, 3)).astype(np.uint8)
        names = [str(i) for i in range(n)]
        batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array(names), pa.array([8] * n, pa.int32()), pa.array([8] * n, pa.int32()), pa.array([v.tobytes() for v in x], pa.binary())], ["sample_id", "true_label", "height", "width", "pixels"])
        sizes = [len(rows) * 192 for rows, _ in images.stacks(batch)]
        assert sum(sizes) == x.size and max(sizes) <= images.LEVELS
        tracemalloc.start()
        assert sum(b.num_rows for b in images._variants_of()(iter([batch]))) == 10 * n
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top

    few, many = peak(1000), peak(8000)
    assert many < 1.5 * few


def test_variants_are_scored_in_one_pass(spark):
    df, scorers = table(spark, rows_of(20) + rows_of(3, (3, 5)) + [("bad", 8, 8, None, "c0")]), [images.linear("linear", 0, 0.5)]
    one = images.score_images(df, scorers)
    assert one._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    near = lambda x: round(x, 9) if isinstance(x, float) else [round(v, 9) for v in x] if isinstance(x, list) else x  # noqa: E731  a product of matrices sums by size
    text = lambda d: sorted(str([near(v) for v in r]) for r in d.collect())
    assert text(one) == text(images.score(images.fan_out(df), scorers)) and one.count() == 23 * 10 + 1


def test_scorers_and_their_failures(spark):
    def picky(weights):
        def predict(x):
            if (x.mean((1, 2, 3)) < 110).any():
                raise RuntimeError("too dark")
            return np.stack([x.mean((1, 2, 3)) - 128, np.zeros(len(x)), np.full(len(x), float(weights.decode()))], 1)

        return predict

    def broken(_):
        raise OSError("no weights")

    variants = images.fan_out(table(spark, rows_of() + [("bad", 8, 8, None, "c0")]), ("bright", "dark"))
    scorers = [images.Scorer("picky", picky, ("a", "b"), [2.0, 1.0, 0.5], b"1.5"), images.Scorer("broken", broken), images.linear("linear", 0, 0.5)]
    found = images.score(variants, scorers).collect()
    assert len(found) == 3 * (6 * 3 + 1)
    by = {m: [r for r in found if r["model_name"] == m] for m in ("picky", "broken", "linear")}
    assert {r["error"] for r in by["broken"]} == {"OSError: no weights", "no image of this height and width"}
    dark = [r for r in by["picky"] if r["error"] == "RuntimeError: too dark"]
    assert {r["perturbation"] for r in dark} == {"dark"} and len(dark) == 6
    for r in by["picky"]:
        if not r["error"]:
            assert r["predicted_class"] == ["a", "b", "class_2"][r["predicted_idx"]] and r["confidence"] == max(r["probabilities"]) and sum(r["probabilities"]) == pytest.approx(1)
    z = np.array([[2.0, 0.0, 1.0]])
    p, k, raw = images.judged(z, [1.0, 1.0, 0.25])
    assert k.tolist() == [2] and raw[0] == pytest.approx(np.exp(1) / (np.exp(2) + 1 + np.exp(1))) and p[0, 2] == pytest.approx(np.exp(4) / (np.exp(2) + 1 + np.exp(4)))
    log = images.log_of(images.score(variants, scorers))
    assert {r["model_name"] for r in relation("c4_robustness", log=log).collect()} == {"picky", "linear"}
    j2 = relation("j2_against_clean", log=log).filter("model_name = 'linear'").collect()
    assert len(j2) == 12 and all(r["clean_class"] for r in j2)
    with pytest.raises(ValueError, match="weights"):
        images.score(variants, [images.Scorer("large", broken, weights=bytes(images.LIMIT + 1))])
    with pytest.raises(ValueError, match="above 0"):
        images.judged(z, 0.0)
