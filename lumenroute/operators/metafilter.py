"""Metadata-first filter: cumulative predicates with weights.

Filters run in a fixed order and each narrows what the ones before left. A
row's score is the weight of every filter it was still alive after; rows that
a later filter drops keep what they had. One projection computes all of it;
only the question whether any name matched exactly needs a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import grams, seq_ratio, within
from ..functions.values import as_int, colour_set, truthy

WEIGHTS = {"name": 100, "color_identity": 30, "cmc": 70, "set": 80, "collector_number": 90, "type": 15, "subtype": 10}
EXACT_BONUS = 30
FUZZY_RATIO = 0.82


def _names(name: Column, hint: Column, fuzzy_ratio: bool) -> tuple[Column, Column]:
    a, b = F.lower(F.trim(hint)), F.lower(F.trim(name))
    most = F.greatest(F.lit(2), F.least(F.lit(4), F.floor(F.length(a) / 6))).cast("int")
    near = within(a, b, most)
    if fuzzy_ratio:
        near = near | (seq_ratio(a, b) >= FUZZY_RATIO)
    return a == b, near


def cost_fits(cmc: Column, hint: Column, narrow: Column) -> Column:
    """Whether a cost is the hint's, or next to it unless set or number narrow the search too."""
    return F.abs(as_int(cmc) - as_int(hint)) <= F.when(narrow, 0).otherwise(1)


def _colours(hint: Column, color: Column) -> Column:
    want, have = colour_set(hint), F.filter(colour_set(color), lambda c: c.isin(*"WUBRG"))
    return F.when(want == F.array(F.lit("MULTI")), F.size(have) > 1).when(want == F.array(F.lit("COLORLESS")), F.size(have) == 0).when(F.size(want) == 0, True).otherwise(have == want)


def apply(pairs: DataFrame, enabled: dict[str, bool] | None = None, group: tuple[str, ...] = ("probe_id",), fuzzy_ratio: bool = True) -> DataFrame:
    """pairs with ``score``, ``alive`` and ``filters`` (the applied ones).

    pairs has the catalogue's columns name, color, cmc, set_code, number, type
    and subTypeName, and the hints hint_name, hint_color, hint_cmc, hint_set,
    hint_number, hint_type and hint_subtype, null where there is none.
    ``fuzzy_ratio`` adds the similarity ratio to the edit distance for names.
    """
    on = {k: True for k in WEIGHTS} | (enabled or {})
    hinted = {
        "name": truthy(F.trim("hint_name")).isNotNull(), "color_identity": truthy(F.trim(F.col("hint_color").cast("string"))).isNotNull(), "cmc": as_int(F.col("hint_cmc")).isNotNull(),
        "set": truthy(F.trim("hint_set")).isNotNull(), "collector_number": truthy(F.trim(F.col("hint_number").cast("string"))).isNotNull(),
        "type": truthy(F.trim("hint_type")).isNotNull(), "subtype": truthy(F.trim("hint_subtype")).isNotNull(),
    }
    exact, near = _names(F.col("name"), F.col("hint_name"), fuzzy_ratio)
    df = pairs.withColumns({"_exact": F.coalesce(exact, F.lit(False)), "_near": F.coalesce(near, F.lit(False))})
    df = df.withColumn("_any", F.max("_exact").over(Window.partitionBy(*group)))
    narrow = hinted["set"] | hinted["collector_number"]
    tests = {
        "name": F.when(F.col("_any"), F.col("_exact")).otherwise(F.col("_near")),
        "color_identity": _colours(F.col("hint_color").cast("string"), F.coalesce(F.col("color").cast("string"), F.lit(""))),
        "cmc": cost_fits(F.col("cmc"), F.col("hint_cmc"), narrow),
        "set": F.upper(F.trim("set_code")) == F.upper(F.trim("hint_set")),
        "collector_number": F.lower(F.trim(F.col("number").cast("string"))) == F.lower(F.trim(F.col("hint_number").cast("string"))),
        "type": F.lower("type").contains(F.lower(F.trim("hint_type"))),
        "subtype": F.lower("subTypeName").contains(F.lower(F.trim("hint_subtype"))),
    }
    alive, score, used = F.lit(True), F.lit(0), []
    for name, test in tests.items():
        if not on[name]:
            continue
        alive = alive & (~hinted[name] | F.coalesce(test, F.lit(False)))
        weight = F.lit(WEIGHTS[name]) + (F.when(F.col("_any"), EXACT_BONUS).otherwise(0) if name == "name" else F.lit(0))
        score = score + F.when(hinted[name] & alive, weight).otherwise(0)
        used.append(F.when(hinted[name], F.lit(name)))
    filters = F.array_compact(F.array(*used)) if used else F.array().cast("array<string>")
    return df.withColumns({"score": score.cast("int"), "alive": alive, "filters": filters}).drop("_exact", "_near", "_any")


def usable_hints(enabled: dict[str, bool] | None = None) -> dict[str, Column]:
    """For each enabled filter, whether a row of hints has something for it."""
    on = {k: True for k in WEIGHTS} | (enabled or {})
    columns = {"name": "hint_name", "color_identity": "hint_color", "set": "hint_set", "collector_number": "hint_number", "type": "hint_type", "subtype": "hint_subtype"}
    tests = {k: truthy(F.trim(F.col(c).cast("string"))).isNotNull() for k, c in columns.items()} | {"cmc": as_int(F.col("hint_cmc")).isNotNull()}
    return {k: t for k, t in tests.items() if on[k]}


def hinted(enabled: dict[str, bool] | None = None) -> Column:
    """Whether a row of hints has one that an enabled filter can use."""
    tests = list(usable_hints(enabled).values())
    return F.exists(F.array(*tests), lambda t: t) if tests else F.lit(False)


def candidates(hints: DataFrame, catalogue: DataFrame, enabled: dict[str, bool] | None = None, probe: str = "probe_id") -> DataFrame:
    """Pairs of hints and catalogue rows that hold every pair which ``apply`` leaves alive, for hints with anything to filter by.

    Each probe is blocked by one of its hints, the first of name, number, set,
    cost, subtype, type and colour that it has and that is enabled: an equi-join on the value, or, for a
    name, on the distinct names that ``similar_names`` finds, and for types and
    colours on the distinct values that pass.
    """
    text = lambda c: F.trim(F.col(c).cast("string"))
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # of each filter: what is made of the hint and of the row, as texts; they are to be equal, or for the last three to pass
    keys = {
        "name": (F.lower(text("hint_name")), F.lower(F.trim("name"))), "collector_number": (F.lower(text("hint_number")), F.lower(text("number"))), "set": (F.upper(text("hint_set")), F.upper(F.trim("set_code"))),
        "cmc": (as_int(F.col("hint_cmc")).cast("string"), as_int(F.col("cmc")).cast("string")), "subtype": (F.col("hint_subtype").cast("string"), whole("subTypeName")), "type": (F.col("hint_type").cast("string"), whole("type")),
        "color_identity": (F.col("hint_color").cast("string"), whole("color")),
    }
    usable = usable_hints(enabled)
    used = [k for k in keys if k in usable]
    if not used:
        return hints.where(F.lit(False)).crossJoin(catalogue.limit(0))
    block = F.coalesce(*(F.when(usable[k], F.struct(F.lit(k).alias("k"), keys[k][0].alias("h"))) for k in used))
    asked = hints.select(probe, block.alias("b")).where("b IS NOT NULL").select(probe, "b.k", "b.h")
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), keys[k][1].alias("v")) for k in used)))
    rows = catalogue.select(F.struct(*catalogue.columns).alias("_item"), values.alias("e")).select("_item", "e.k", "e.v").where("v IS NOT NULL")
    # few distinct values of types and colours on both sides meet by the filter
    passes = F.when(F.col("k") == "color_identity", _colours(F.col("h"), F.col("v"))).otherwise(F.lower("v").contains(F.lower(F.trim("h"))))
    loose = F.col("k").isin("subtype", "type", "color_identity")
    fits = asked.where(loose).select("k", "h").distinct().join(rows.where(loose).select("k", "v").distinct(), "k").where(passes)
    cost = F.col("h").cast("bigint")
    same = F.when(F.col("k") == "cmc", F.transform(F.array(cost - 1, cost, cost + 1), lambda n: n.cast("string"))).otherwise(F.array("h"))
    keyed = asked.where(loose).join(fits, ["k", "h"]).select(probe, "k", "v").unionAll(asked.where(~loose & (F.col("k") != "name")).select(probe, "k", F.explode(same).alias("v")))
    if "name" in used:
        said = asked.where(F.col("k") == "name")
        near = similar_names(said.select(F.col("h").alias("_h")).distinct(), rows.where(F.col("k") == "name").select(F.col("v").alias("_v")).distinct())
        keyed = keyed.unionAll(said.join(near, F.col("h") == F.col("_h")).select(probe, "k", F.col("_v").alias("v")))
    return hints.join(keyed.join(rows, ["k", "v"]).select(probe, "_item"), probe).select(*hints.columns, "_item.*")


def similar_names(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(_h, _v): of distinct names in lower case, the pairs that may pass the name filter.

    Names within the allowed edits, or over the similarity ratio, share a
    padded 3-gram, since what they differ in is too little to break all of
    their runs; only names under five letters need not, and these meet all of
    about their length.
    """
    most = F.greatest(F.lit(2), F.least(F.lit(4), F.floor(F.length("_h") / 6))).cast("int")
    a, b = F.length("_h"), F.length("_v")
    near = within(F.col("_h"), F.col("_v"), most) | (2 * F.least(a, b) >= FUZZY_RATIO * (a + b))
    asked = asked.where(truthy(F.col("_h")).isNotNull())
    shared = asked.select("_h", F.explode(grams(F.col("_h"))).alias("_g")).join(names.select("_v", F.explode(grams(F.col("_v"))).alias("_g")), "_g").select("_h", "_v").distinct()
    short = asked.where(a < 5).select("_h", F.explode(F.sequence(F.greatest(a - 2, F.lit(0)), a + 2)).alias("_l")).join(names.select("_v", b.alias("_l")), "_l").select("_h", "_v")
    return shared.unionAll(short).where(near).distinct()


def diagnostics(applied: DataFrame, group: tuple[str, ...] = ("probe_id",)) -> DataFrame:
    """For each probe: filters used, rows in and rows out."""
    return applied.groupBy(*group).agg(F.max(F.size("filters")).alias("filters_used"), F.max("filters").alias("applied_filters"), F.count("*").alias("input_count"), F.count_if("alive").alias("output_count"))


def prefilter(hashes: DataFrame, applied: DataFrame, group: tuple[str, ...] = ("probe_id",)) -> DataFrame:
    """Hash rows of the survivors; where filters ran and nothing survived there is nothing, and no full scan."""
    return hashes.join(applied.where("alive").select(*group, "product_id").distinct(), "product_id")
