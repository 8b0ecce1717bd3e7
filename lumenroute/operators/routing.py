"""Routing of items to bins, and allocation of trays.

Each router is a column expression over a catalogue row. Where the usual rule
has an oddity, such as "uncommon" landing in Common because it contains
"common", that is the default, and ``fixed`` gives the sensible rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import as_int, as_price, colour_set, truthy

REJECT = "RejectCard"
BASICS = "plains island swamp mountain forest wastes".split()
TYPES = "creature artifact enchantment instant sorcery battle planeswalker land token".split()
RARITIES = "common uncommon rare mythic special bonus promo token".split()
PRICE_TRAYS = tuple(zip((0.02, 0.05, 0.10, 0.25, 0.50, 1, 2, 4, 8, 16, 32, 64, 128), (1, 7, 14, 18, 21, 24, 25, 26, 27, 28, 29, 30, 31), strict=True))
TOP_TRAY = 32
TRAY_HOLDS = 376
TRAYS = 34


def by_colour(types: Column, name: Column, colour: Column, fixed: bool = False) -> Column:
    """Lands apart, several colours as Multicolor. A text of several colours is one colour by itself unless ``fixed``."""
    land = F.when(F.lower(name).isin(*BASICS), "Basic land").otherwise("Nonbasic land")
    text = truthy(colour)
    if fixed:
        found = F.filter(colour_set(colour), lambda c: c.isin(*"WUBRG"))
        rest = F.when(F.size(found) > 1, "Multicolor").when(F.size(found) == 1, found[0]).otherwise("Colorless")
    else:
        rest = F.coalesce(text, F.lit("Colorless"))
    return F.when(F.coalesce(F.lower(types).contains("land"), F.lit(False)), land).otherwise(rest)


def by_mana(cmc: Column) -> Column:
    n = F.coalesce(as_int(cmc), F.lit(0))
    return F.when(n <= 1, "One").when(n <= 8, n.cast("string")).otherwise(REJECT)


def by_set(types: Column, set_code: Column) -> Column:
    return F.when(F.coalesce(F.lower(types).contains("token"), F.lit(False)), "token").otherwise(F.coalesce(truthy(F.lower(set_code)), F.lit(REJECT)))


def by_price(price: Column, threshold: float | None = None) -> Column:
    """The tray whose upper bound is the first at or over the price; none for a price of 0, unreadable or over the threshold."""
    p = as_price(price)
    out = F.when(p.isNull() | (p == 0), REJECT)
    if threshold is not None:
        out = out.when(p > threshold, REJECT)
    for bound, tray in PRICE_TRAYS:
        out = out.when(p <= bound, f"tray{tray}")
    return out.otherwise(f"tray{TOP_TRAY}")


def by_type(types: Column) -> Column:
    low = F.lower(types)
    return F.coalesce(*(F.when(low.contains(t), t) for t in TYPES), F.lit(REJECT))


def by_letter(name: Column) -> Column:
    first = F.upper(F.substring(F.trim(name), 1, 1))
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", REJECT).when(first.rlike(r"^\p{L}"), first).otherwise("0-9")


def by_rarity(rarity: Column, fixed: bool = False) -> Column:
    low = F.lower(rarity)
    order = sorted(RARITIES, key=lambda r: -len(r)) if fixed else RARITIES
    if fixed:
        order = ["mythic", *[r for r in order if r != "mythic"]]
    return F.coalesce(*(F.when(low.contains(r), r.capitalize()) for r in order), F.lit(REJECT))


def by_finish(finishes: Column, foil: Column, fixed: bool = False) -> Column:
    """From an array of finishes, else from a flag. "nonfoil" contains "foil", so it alone reads as both unless ``fixed``."""
    low = F.transform(finishes, F.lower)
    has = F.exists(low, lambda f: f.contains("foil") & (~f.contains("nonfoil") if fixed else F.lit(True)))
    plain = F.exists(low, lambda f: f.contains("nonfoil") | f.contains("normal"))
    flag = F.when(F.coalesce(F.lower(foil.cast("string")).isin("true", "yes", "foil"), F.lit(False)), "Foil").otherwise("Nonfoil")
    return F.when(has & plain, "Both").when(has, "Foil").when(plain, "Nonfoil").otherwise(flag)


def route(mode: str, threshold: float = 1_000_000.0, fixed: bool = False) -> Column:
    """The bin of a catalogue row (type, name, color, cmc, set_code, price, rarity, finishes, foil) in a mode; unknown modes reject."""
    c = F.col
    if mode == "color":
        return by_colour(c("type"), c("name"), c("color"), fixed)
    if mode == "mana_value":
        return by_mana(c("cmc"))
    if mode == "set":
        return by_set(c("type"), c("set_code"))
    if mode == "price":
        return by_price(c("price"))
    if mode == "buy":
        return by_price(c("price"), threshold)
    if mode == "type":
        return by_type(c("type"))
    if mode == "alpha":
        return by_letter(c("name"))
    if mode == "rarity":
        return by_rarity(c("rarity"), fixed)
    if mode == "finish":
        return by_finish(c("finishes"), c("foil"), fixed)
    return F.lit(REJECT)


def allocate(items: DataFrame, label: str, order: list[str], ranges: dict[str, tuple[int, int]], holds: int = TRAY_HOLDS) -> DataFrame:
    """items with ``tray``: each label fills its own range of trays in order; null where the range is full or unknown."""
    first = F.coalesce(*(F.when(F.col(label) == k, F.lit(a)) for k, (a, _) in ranges.items()))
    last = F.coalesce(*(F.when(F.col(label) == k, F.lit(b)) for k, (_, b) in ranges.items()))
    n = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    tray = first + F.floor((n - 1) / holds)
    return items.withColumn("tray", F.when(tray <= last, tray).cast("int"))


def allocate_dynamic(items: DataFrame, label: str, order: list[str], trays: int = TRAYS, holds: int = TRAY_HOLDS) -> DataFrame:
    """First fit: a label takes the first tray that is free or already its own and not full, over all labels in order.

    A label claims a further tray with every ``holds`` items, and claims take
    trays in the order of their first items; only claims are put into one
    order, one row for every ``holds`` items of a label.
    """
    n = F.row_number().over(Window.partitionBy(label).orderBy(*order)) - 1
    placed = items.withColumns({"_part": F.floor(n / holds).cast("long"), "_lead": F.struct(*order)})
    claims = placed.groupBy(label, "_part").agg(F.min("_lead").alias("_lead"))

    ranked = claims.withColumn("_rank", F.row_number().over(Window.orderBy("_lead")))
    trays_of = ranked.select(label, "_part", F.when(F.col("_rank") <= trays, F.col("_rank")).cast("int").alias("tray"))
    return placed.join(trays_of, [label, "_part"], "left").drop("_part", "_lead")


def guarded(commands: DataFrame, order: list[Column], machine: str = "machine", column: str = "command") -> DataFrame:
    """commands with ``outcome``: trays sort only while the machine is started, manual controls work only while it is stopped.

    The machine is stopped at first; its state is the last start or stop command before, in the given order.
    """
    manual = F.col(column).isin("CalibrateX1", "CalibrateX2", "CalibrateY1", "CalibrateY2", "HomeButton")
    switch = F.when(F.col(column) == "StartMachine", True).when(F.col(column) == "StopMachine", False)
    before = F.coalesce(F.last(switch, ignorenulls=True).over(Window.partitionBy(machine).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return commands.withColumn("_on", before).withColumn(
        "outcome", F.when(switch.isNotNull(), "switched").when(manual & F.col("_on"), "refused: started").when(~manual & ~F.col("_on"), "refused: stopped").otherwise("done")
    ).drop("_on")
