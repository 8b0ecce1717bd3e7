"""Perceptual hashes and the Hamming-threshold similarity join.

A hash channel of up to 256 bits is an array of 32-bit words in bigints, so
that distances are sums of ``bit_count`` of ``^`` inside code generation. The
join takes the probes as the broadcast side only while they are few
(``BROADCAST_PROBES``). For small thresholds the banded join is an equi-join:
hashes within d bits agree on at least one of d + 1 disjoint bands.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks

SENTINEL = 999
BITS = 256
BROADCAST_PROBES = 20_000
#: items of some 250 bytes
BROADCAST_ITEMS = 200_000
#: rows of one side in a cell of the grid
CELL_ROWS = 20_000


def normalised_hex(h: Column) -> Column:
    """A written hash in lower case, without prefix, 64 digits long."""
    return F.rpad(F.regexp_replace(F.lower(h), "^0x", ""), 64, "0")


def hash_words(h: Column) -> Column:
    """Eight words of a hex hash aligned to the right; null for one that is empty, too long or not hexadecimal."""
    digits = F.regexp_replace(F.lower(F.trim(h)), "^0x", "")
    full = F.lpad(digits, 64, "0")
    words = F.array(*(F.conv(F.substring(full, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(8)))
    return F.when(digits.rlike("^[0-9a-f]{1,64}$"), words)


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two arrays of words differ; the sentinel if either is null."""
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    return F.coalesce(bits, F.lit(SENTINEL))


def longs(words: Column, name: str) -> list[Column]:
    """An array of eight words as four 64-bit columns, name0 to name3: distances of plain columns are generated code, those of arrays aren't."""
    return [F.shiftleft(words[2 * k], 32).bitwiseOR(words[2 * k + 1]).alias(f"{name}{k}") for k in range(4)]


def long_hamming(a: str, b: str) -> Column:
    """Bits in which two hashes, as the columns of ``longs``, differ; the sentinel if either is null."""
    bits = [F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(4)]
    return F.coalesce(bits[0] + bits[1] + bits[2] + bits[3], F.lit(SENTINEL))


def word_hamming(a: Column, b: Column) -> Column:
    """Bits in which two integers differ."""
    return F.bit_count(a.bitwiseXOR(b))


def confidence(mean_distance: Column, bits: int = BITS) -> Column:
    return F.greatest(F.lit(0.0), 100.0 - mean_distance / float(bits) * 100.0)


def sign_bits(vector: Column, first: int, bits: int) -> Column:
    """The signs of ``bits`` components from number ``first`` on as one integer."""
    return F.aggregate(F.slice(vector, first, bits), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 1) + F.when(x > 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))


def few(probes: DataFrame, most: int = BROADCAST_PROBES) -> bool:
    """Whether a table is small enough to be broadcast; reads at most ``most`` + 1 rows."""
    return probes.limit(most + 1).count() <= most


def threshold_join(probes: DataFrame, items: DataFrame, distance: Column, most: float, first: Column | None = None, broadcast_probes: int = BROADCAST_PROBES, broadcast_items: int = BROADCAST_ITEMS, cell: int = CELL_ROWS) -> DataFrame:
    """Probes and items at a total distance of at most ``most``; the columns of the two must differ.

    ``first`` is a part of the distance that is cheaper to compute and tested
    first. The probes are broadcast if they are few, else the items if those
    are; the other side isn't shuffled then. Where both are many, they are spread
    over a grid of cells of about ``cell`` rows of each side, and a row meets
    each piece of the other side once, in a shuffled equi-join.
    """
    near = distance <= most if first is None else (first <= most) & (distance <= most)
    if few(probes, broadcast_probes):
        return items.join(F.broadcast(probes), near, "inner")
    if few(items, broadcast_items):
        return probes.join(F.broadcast(items), near, "inner").select(*items.columns, *probes.columns)
    rows, columns = (max(1, -(-side.count() // cell)) for side in (probes, items))
    number = lambda side, n: F.pmod(F.xxhash64(*side.columns), F.lit(n)).cast("int")
    left = probes.withColumn("_y", number(probes, rows)).withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    right = items.withColumn("_x", number(items, columns)).withColumn("_y", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    return right.join(left, ["_x", "_y"]).where(near).select(*items.columns, *probes.columns)


def banded_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_hash: str, right_hash: str, bits: int, most: int) -> DataFrame:
    """(left_key, right_key, total) of hashes, integers of ``bits`` bits, that differ in at most ``most`` bits."""
    bands = most + 1
    if bands > bits:
        raise ValueError("more bands than bits: use threshold_join")
    edges = [k * bits // bands for k in range(bands + 1)]

    def cut(h: str) -> Column:
        return F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(F.col(h), a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("v")) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))))

    a = left.select(F.col(left_key).alias("_l"), F.col(left_hash).alias("_lh"), cut(left_hash).alias("_b")).select("_l", "_lh", "_b.k", "_b.v")
    b = right.select(F.col(right_key).alias("_r"), F.col(right_hash).alias("_rh"), cut(right_hash).alias("_b")).select("_r", "_rh", "_b.k", "_b.v")
    total = word_hamming(F.col("_lh"), F.col("_rh"))
    return a.join(b, ["k", "v"]).where(total <= most).select(F.col("_l").alias(left_key), F.col("_r").alias(right_key), total.alias("total")).distinct()


def nearest(probes: DataFrame, items: DataFrame, probe: str, item: str, a: str, b: str) -> DataFrame:
    """(probe, item, l2): each probe's nearest item by Euclidean distance, itself excluded; ties go to the lower item.

    ``a`` is the items' vector, ``b`` the probes'; ids are integers. Components that are null
    on either side don't count; a distance of none is null, and comes after all numbers, as in SQL.
    """
    id_and = lambda side, key, vector: side.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("_id"), F.col(vector).alias("_v"))
    best = blocks.compared(id_and(probes, probe, b), id_and(items, item, a), blocks.Vectors, blocks.Vectors, blocks.nearer, blocks.nearest_of, "_probe bigint, _class int, _d double, _item bigint")
    least = best.groupBy("_probe").agg(F.min(F.struct("_class", "_d", "_item")).alias("m"))
    return least.select(F.col("_probe").cast(probes.schema[probe].dataType).alias(probe), F.col("m._item").cast(items.schema[item].dataType).alias(item), F.sqrt("m._d").alias("l2"))


def first_matches(probes: DataFrame, items: DataFrame, k: int, most: int, score: Column | None = None, group: str | None = None) -> DataFrame:
    """(probe_id, item_id, total, score, label): matches within ``most`` bits, of which each probe, and group, has its first k by score, distance and id.

    probes: probe_id, w; items: item_id, w; ids and hashes are bigints, equal ids are no
    match. There are more matches than the first k, a few for each part of the items: rank them.
    """
    kind = items.schema[group].dataType if group else T.IntegerType()
    left = probes.select("probe_id", "w").where("probe_id IS NOT NULL AND w IS NOT NULL")
    right = items.where("item_id IS NOT NULL AND w IS NOT NULL").select("item_id", "w", (F.lit(0) if score is None else score).cast("bigint").alias("_score"), (F.col(group) if group else F.lit(0)).alias("_group"))
    compare, result = blocks.first_few(k, most)
    return blocks.compared(left, right, blocks.Words, blocks.Words, compare, result, f"probe_id bigint, item_id bigint, total bigint, score bigint, label {kind.simpleString()}")


def with_names(distances: DataFrame, catalogue: DataFrame, probe: str = "probe_id", most: int = 10) -> DataFrame:
    """Each probe's ``most`` nearest items with their names, null where the catalogue lacks them."""
    nearest_few = top_k(distances, probe, [F.col("distance").asc(), F.col("product_id").asc()], most)
    return nearest_few.join(catalogue.select("product_id", "name").dropDuplicates(["product_id"]), "product_id", "left")


def top_k(matches: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank."""
    return matches.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def _dct(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))


def _area(channel: np.ndarray, size: int) -> np.ndarray:
    """A channel averaged down, or repeated up, to size x size."""
    def weights(n: int) -> np.ndarray:
        edges = np.linspace(0, n, size + 1)
        low = np.maximum(edges[:-1, None], np.arange(n)[None, :])
        high = np.minimum(edges[1:, None], np.arange(1, n + 1)[None, :])
        w = np.maximum(high - low, 0)
        return w / w.sum(1, keepdims=True)

    return weights(channel.shape[0]) @ channel @ weights(channel.shape[1]).T


def dct_hash(channel: np.ndarray, hash_size: int = 16, factor: int = 4) -> str:
    """Perceptual hash of one channel: low DCT frequencies against their median, as hex digits."""
    n = hash_size * factor
    m = _dct(n)
    low = (m @ _area(channel.astype(np.float64), n) @ m.T)[:hash_size, :hash_size]
    bits = (low > np.median(low)).ravel()
    return np.packbits(bits).tobytes().hex()


def image_hashes(pixels: np.ndarray) -> tuple[str, str, str, str]:
    """Hashes of red, green, blue and grey: portrait, fitted into a square on white."""
    if pixels.ndim == 2:
        pixels = np.repeat(pixels[:, :, None], 3, 2)
    if pixels.shape[1] > pixels.shape[0]:
        pixels = np.rot90(pixels)
    side = max(pixels.shape[:2])
    square = np.full((side, side, 3), 255, np.uint8)
    y, x = (side - pixels.shape[0]) // 2, (side - pixels.shape[1]) // 2
    square[y : y + pixels.shape[0], x : x + pixels.shape[1]] = pixels[:, :, :3]
    grey = square @ np.array([0.299, 0.587, 0.114])
    return *(dct_hash(square[:, :, c]) for c in range(3)), dct_hash(grey)


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("r_phash", "g_phash", "b_phash", "grayscale_phash")]))
def pixel_hashes(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    """Hashes of images given as RGB bytes row by row; null where the bytes don't fit the size."""
    out = []
    for raw, h, w in zip(data, height, width, strict=True):
        fits = raw is not None and h > 0 and w > 0 and len(raw) == h * w * 3
        out.append(image_hashes(np.frombuffer(raw, np.uint8).reshape(int(h), int(w), 3)) if fits else (None,) * 4)
    return pd.DataFrame(out, columns=["r_phash", "g_phash", "b_phash", "grayscale_phash"])
