import numpy as np
from pyspark.sql import functions as F

from lumenroute.operators import hashing, image


def canvas(h, w, value=255):
    return np.full((h, w, 3), value, np.uint8)


def test_trim_keeps_a_near_white_border():
    px = canvas(300, 200)
    px[30:271, 40:161] = 250
    px[40:261, 50:151] = 120
    assert image.trim(px, 244, 0) == (40, 30, 160, 270)


def test_trim_of_white_is_everything():
    assert image.trim(canvas(120, 80), 244, 0) == (0, 0, 79, 119)


def test_trim_keeps_the_main_region_at_the_border():
    px = canvas(300, 200)
    px[:, 20:181] = 246
    px[30:271, 30:171] = 120
    px[120:130, 185:195] = 100
    assert image.trim(px, 244, 0) == (20, 0, 180, 299)


def test_trim_margins():
    px = canvas(100, 100)
    px[20:80, 20:80] = 0
    assert image.trim_margins(px, padding=0).shape == (60, 60, 3)
    assert image.trim_margins(canvas(30, 30)).shape == (30, 30, 3)


def test_hashes_are_stable_and_tell_images_apart(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 255, (80, 60, 3)).astype(np.uint8)
    b = rng.integers(0, 255, (80, 60, 3)).astype(np.uint8)
    noisy = np.clip(a.astype(int) + rng.integers(-4, 5, a.shape), 0, 255).astype(np.uint8)
    rows = spark.createDataFrame([(k, bytearray(x.tobytes()), 80, 60) for k, x in enumerate((a, noisy, b))] + [(9, None, 1, 1)], "id int, data binary, h int, w int")
    h = {r.id: r.p for r in rows.select("id", hashing.pixel_hashes("data", "h", "w").alias("p")).collect()}
    bits = lambda x, y: bin(int(x, 16) ^ int(y, 16)).count("1")
    assert len(h[0].r_phash) == 64 and h[9].r_phash is None and h[0].grayscale_phash is not None
    assert bits(h[0].r_phash, h[1].r_phash) < 40 < bits(h[0].r_phash, h[2].r_phash)
    assert rows.select(image.trim_rect("data", "h", "w").alias("r")).where("r IS NULL").count() == 1


def test_colours_and_strip():
    hsv = np.zeros((4, 4, 3), np.uint8)
    hsv[:2] = (60, 200, 200)
    shares = image.colour_shares(hsv)
    assert shares["G"] == 0.5 and shares["B"] == 0.5 and shares["R"] == 0
    assert image.strip_feature(np.ones((100, 64))).shape == (256,)


def test_largest_component_against_flooding():
    rng = np.random.default_rng(4)
    for density in (0.2, 0.4, 0.5, 0.7):
        mask = rng.random((40, 30)) < density
        label, best = np.zeros(mask.shape, int), (0, 0, None)
        for y0, x0 in zip(*np.nonzero(mask), strict=True):
            if label[y0, x0]:
                continue
            n, todo, seen = label.max() + 1, [(y0, x0)], []
            label[y0, x0] = n
            while todo:
                y, x = todo.pop()
                seen.append((y, x))
                for b in range(max(y - 1, 0), min(y + 2, 40)):
                    for a in range(max(x - 1, 0), min(x + 2, 30)):
                        if mask[b, a] and not label[b, a]:
                            label[b, a] = n
                            todo.append((b, a))
            if len(seen) > best[0]:
                ys, xs = zip(*seen, strict=True)
                best = len(seen), n, (min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1)
        region, area, box = image.largest_component(mask)
        assert area == best[0] and box == best[2] and (region == (label == best[1])).all()
    assert image.largest_component(np.zeros((3, 3), bool)) == (None, 0, (0, 0, 0, 0))


def test_frames_and_plug_ins():
    assert image.brightness_factor(100, None) == (1.28, 100) and image.brightness_factor(200, 100)[1] == 110 and image.brightness_factor(0, 0)[0] == 1.0
    assert image.scaled(np.array([100, 250], np.uint8), 1.28).tolist() == [128, 255]
    assert image.smoothed(None, np.array([4]), 0.5).tolist() == [4] and image.smoothed(np.array([10]), np.array([20]), 0.5).tolist() == [15]
    px = canvas(2000, 1000)
    assert image.warped(px, lambda p: p[:1500]).shape == (1043, 745, 3) and image.warped(px, lambda p: None) is px and image.warped(px, None) is px
    assert image.text_hints(px, lambda p: {"name": "a", "set": "x"}, lambda p: {"set": "y"}) == {"name": "a", "set": "y"}
    assert [image.circle_cost(px, lambda p, n=n: n) for n in (0, 3, 12, 13)] == [None, 3, 12, None]


def test_rules_texts_have_a_least_length_and_a_cap(spark):
    rows = spark.createDataFrame([(" " + "a" * 39 + " ",), ("b" * 2000,), (None,)], "t string").select(image.whole_text(F.col("t")).alias("t")).collect()
    assert [r.t and len(r.t) for r in rows] == [None, 1800, None]
