"""Lenient casts, prices, colours and other normalisations of catalogue values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COLOUR_WORDS = {"WHITE": "W", "BLUE": "U", "BLACK": "B", "RED": "R", "GREEN": "G", "COLORLESS": "COLORLESS", "MULTI": "MULTI", "MULTICOLOR": "MULTI"}


def truthy(value: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(value, F.lit(""))


def first_truthy(*values: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*(truthy(v) for v in values))


def as_int(value: Column) -> Column:
    """Numbers and numeric texts cut to an integer; anything else, NaN and infinity included, is null."""
    number = value.cast("string").try_cast("double")
    return number.try_cast("int")


def as_price(value: Column) -> Column:
    """A price from a number or a text with or without a currency sign."""
    return F.trim(F.regexp_replace(value.cast("string"), r"\$", "")).try_cast("double")


def picked_price(market: Column, low: Column) -> Column:
    """The market price if it is positive, else the low price if that is; null if the market price can't be read."""
    m, second = market.cast("string").try_cast("double"), low.cast("string").try_cast("double")
    unread = market.isNotNull() & (market.cast("string") != "") & m.isNull()
    return F.when(~unread & (m > 0), m).when(~unread & (second > 0), second)


def colour_set(value: Column) -> Column:
    """Sorted distinct colours of a text such as ``W``, ``B,G``, ``WU`` or ``white/blue``; unknown parts are left out."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(F.upper(value), r"[/|;]", ","), ","), F.trim), lambda p: p != "")
    words = F.create_map(*(F.lit(x) for pair in COLOUR_WORDS.items() for x in pair))

    def letters(p: Column) -> Column:
        packed = F.filter(F.split(p, ""), lambda c: c != "")
        return F.when(F.try_element_at(words, p).isNotNull(), F.array(F.try_element_at(words, p))).when(p.rlike("^[WUBRG]+$"), packed).otherwise(F.array().cast("array<string>"))

    return F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform(parts, letters)))), F.array().cast("array<string>"))


def clamped(value: Column, low: float, high: float) -> Column:
    """(value - low) / (high - low) within 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - F.lit(low)) / F.lit(high - low)))


def region_quality(count: Column, area_share: Column) -> Column:
    """Quality of detected text regions from their number and their share of the area."""
    return 0.7 * clamped(count, 120.0, 1200.0) + 0.3 * clamped(area_share, 0.008, 0.18)


def safe_file_name(name: Column) -> Column:
    """A name without characters that file systems refuse."""
    return F.coalesce(truthy(F.trim(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"))), F.lit("unnamed_file"))


def folder_id(url: Column) -> Column:
    """The id in a folder address, or the text itself if it already looks like one."""
    return F.when(url.rlike(r"^[A-Za-z0-9_-]{33}$"), url).otherwise(truthy(F.regexp_extract(url, r"/folders/([A-Za-z0-9_-]+)", 1)))


def hms(seconds: Column) -> Column:
    """Elapsed seconds as h:mm:ss."""
    s = seconds.cast("bigint")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), F.lpad(F.floor(s % 3600 / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def smoothed(values: Column, alpha: float) -> Column:
    """Exponential moving average of an array of numbers, cut to an integer at each step; it begins at the first value."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.try_element_at(values, F.lit(1)).cast("double"), lambda a, x: F.floor(F.lit(alpha) * x + F.lit(1 - alpha) * a).cast("double"))


def telemetry(frame: Column) -> Column:
    """Readings of a ``<Name,key=value,...>`` frame as a map."""
    body = F.regexp_extract(frame, r"<[^,>]*,?([^>]*)>", 1)
    return F.map_filter(F.str_to_map(body, F.lit(","), F.lit("=")), lambda k, v: v.isNotNull())


def aspect_crop(width: Column, height: Column, x1: Column, y1: Column, x2: Column, y2: Column, pad: int) -> Column:
    """The padded crop rectangle within an image, with its share of the area and its aspect ratio."""
    a, b = F.greatest(x1 - pad, F.lit(0)), F.greatest(y1 - pad, F.lit(0))
    c, d = F.least(x2 + pad, width - 1), F.least(y2 + pad, height - 1)
    w, h = c - a + 1, d - b + 1
    return F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"), (w * h / (width * height)).alias("kept"), (w / h).alias("aspect"))
