import random

from pyspark.sql import functions as F

from lumenroute.operators import metafilter

CARDS = [
    ("1", "Lightning Bolt", "R", 1, "M10", "146", "Instant", "Normal"),
    ("2", "Counterspell", "U", 2, "7ED", "67", "Instant", "Normal"),
    ("3", "Sol Ring", "Colorless", 1, "CMM", "409", "Artifact", "Normal"),
    ("4", "Assassin's Trophy", "B,G", 2, "GRN", "152", "Instant", "Normal"),
]


def run(spark, enabled=None, **hints):
    cards = spark.createDataFrame(CARDS, "product_id string, name string, color string, cmc int, set_code string, number string, type string, subTypeName string")
    columns = {f"hint_{k}": F.lit(hints.get(k)).cast("int" if k == "cmc" else "string") for k in ("name", "color", "cmc", "set", "number", "type", "subtype")}
    out = metafilter.apply(cards.withColumn("probe_id", F.lit(1)).withColumns(columns), enabled)
    return {r.product_id: r for r in out.collect()}


def alive(rows):
    return sorted(k for k, r in rows.items() if r.alive)


def test_exact_name(spark):
    rows = run(spark, name="Lightning Bolt")
    assert alive(rows) == ["1"] and rows["1"].score == 130 and rows["1"].filters == ["name"]


def test_fuzzy_name(spark):
    rows = run(spark, name="Lightnng Bolt")
    assert alive(rows) == ["1"] and rows["1"].score == 100


def test_colours(spark):
    assert alive(run(spark, color="multi")) == ["4"]
    assert alive(run(spark, color="colorless")) == ["3"]
    assert alive(run(spark, color="G,B")) == ["4"]


def test_cost_has_a_tolerance_without_set_or_number(spark):
    rows = run(spark, cmc=2)
    assert alive(rows) == ["1", "2", "3", "4"] and rows["1"].filters == ["cmc"]
    assert alive(run(spark, cmc=2, set="7ED")) == ["2"]


def test_set_and_number(spark):
    rows = run(spark, set="M10", number="146")
    assert alive(rows) == ["1"] and rows["1"].filters == ["set", "collector_number"] and rows["1"].score == 170


def test_scores_outlive_elimination(spark):
    rows = run(spark, name="Lightning Bolt", set="XXX")
    assert alive(rows) == [] and rows["1"].score == 130


def test_toggle(spark):
    assert alive(run(spark, {"color_identity": False}, color="U")) == ["1", "2", "3", "4"]


def test_no_match(spark):
    rows = run(spark, name="Definitely Not A Card")
    assert alive(rows) == [] and all(len(r.filters) >= 1 for r in rows.values())


def test_blocked_pairs_leave_what_all_pairs_leave(spark):
    """Random hints of every kind, names with edits included, against the cross join."""
    rng = random.Random(5)
    names = ["Bolt", "Lightning Bolt", "Lightning Blot", "Sol Ring", "Counterspell", "Ring", "Soul Ring of Sols", "Ab", "abc", "Assassin's Trophy", None, ""]
    cards = [(str(k), rng.choice(names), rng.choice(["W", "U,B", None, "", "Colorless"]), rng.choice(["1", "2", "x", None]), rng.choice(["M10", "7ed", None]), rng.choice(["1", "1A", None]), rng.choice(["Instant", "Basic Land", None]), rng.choice(["Foil", "Normal", None])) for k in range(60)]
    df = spark.createDataFrame(cards, "product_id string, name string, color string, cmc string, set_code string, number string, type string, subTypeName string")

    def edited(n):
        if n and rng.random() < 0.6:
            k = rng.randrange(len(n))
            n = n[:k] + rng.choice(["", "z", n[k] + "y"]) + n[k + 1 :]
        return n

    some = lambda v, p=0.3: v if rng.random() < p else None
    hints = [(k, some(edited(rng.choice(names)), 0.5), some(rng.choice(["W", "multi", "colorless", "??", " "])), some(rng.randrange(4)), some(rng.choice(["m10", "7ED", "no"])), some(rng.choice(["1", "1a"])), some(rng.choice(["land", "INST", ""])), some("foil")) for k in range(80)]
    asked = spark.createDataFrame(hints, "probe_id int, hint_name string, hint_color string, hint_cmc int, hint_set string, hint_number string, hint_type string, hint_subtype string")
    for enabled in (None, {"name": False, "cmc": False}):
        usable = asked.where(metafilter.hinted(enabled))
        pick = lambda pairs: {(r.probe_id, r.product_id, r.score, tuple(r.filters)) for r in metafilter.apply(pairs, enabled).where("alive").collect()}  # noqa: B023, E731
        assert pick(metafilter.candidates(usable, df, enabled)) == pick(usable.crossJoin(df))
    assert metafilter.candidates(asked, df, dict.fromkeys(metafilter.WEIGHTS, False)).count() == 0
