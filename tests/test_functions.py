import pytest
from pyspark.sql import functions as F

from lumenroute.functions import similarity, text, values
from lumenroute.operators import ledger, ranking, resolve, routing
from lumenroute.sources import catalogue, plugins, sinks


def col(spark, items, kind="string"):
    return spark.createDataFrame([(x,) for x in items], f"s {kind}")


def values_of(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_lenient_casts(spark):
    df = col(spark, ["3.7", "-1", "x", "", None, "NaN", "Infinity"])
    assert values_of(df, values.as_int(F.col("s"))) == [3, -1, None, None, None, None, None]
    assert values_of(col(spark, ["$1.23", " 2 ", "null", None]), values.as_price(F.col("s"))) == [1.23, 2.0, None, None]


def test_slips_resolve_names(spark):
    names = spark.createDataFrame([("Power Sink",), ("Seeker of Skybreak",), ("Sea Drake",), (None,)], "name string")
    said = spark.createDataFrame([(1, "Dower Sink"), (2, "Dee sey"), (3, "zzzz qqqq"), (4, "x"), (5, None)], "k int, said string")
    got = {r.k: r.resolved for r in resolve.resolve_names(said, names, "k", "said").collect()}
    assert "Power Sink" == got[1] and 3 not in got and 4 not in got
    fixed = values_of(said.where("k = 2"), text.slips_fixed(F.col("said")))
    assert fixed == ["seeker"]


def test_ratio_is_asymmetric_and_cached(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, "x"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(similarity.seq_ratio("a", "b")).collect()] == [0.75, 0.0, 1.0]
    assert similarity.fuzzy_overlap(["bolt", "of", "fire"], ["bolts", "fires", "x"]) == 2


def test_moving_average(spark):
    df = spark.createDataFrame([([100, 200, 0],), ([],), ([5],)], "v array<int>")
    assert values_of(df, values.smoothed(F.transform("v", lambda x: x.cast("double")), 0.1)) == [99.0, None, 5.0]


def test_narrow_rows_route_as_documented(spark):
    row = spark.createDataFrame([("Bolt", None, None, None)], "name string, type string, cmc string, foil string").withColumn("finishes", F.lit(None).cast("array<string>"))
    assert row.select(routing.route("type"), routing.route("mana_value"), routing.route("finish"), routing.route("nothing")).first()[:] == ("RejectCard", "One", "Nonfoil", "RejectCard")


def test_foil_oddity(spark):
    df = spark.createDataFrame([(["nonfoil"],)], "f array<string>").withColumn("b", F.lit(None).cast("string"))
    assert df.select(routing.by_finish(F.col("f"), F.col("b")), routing.by_finish(F.col("f"), F.col("b"), fixed=True)).first()[:] == ("Both", "Nonfoil")


def test_exact_distance_beats_a_null_one(spark):
    df = spark.createDataFrame([(1, "original", 80.0, 0.0, False), (1, "other", 80.0, None, False)], "p int, source string, confidence double, distance double, manual_review_required boolean")
    assert ranking.best_source(df, "p", "source").first().source == "original"


def test_adaptive_stops_at_an_exact_match(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 6.0), (2, 6.5), (2, 6.9), (2, 6.9), (2, 6.9), (3, 50.0)], "p int, d double")
    assert {r.p: (r.threshold, r.matches) for r in ranking.adaptive(df, "p", "d").collect()} == {1: (5, 1), 2: (7, 5), 3: (19, 0)}


def test_grades(spark):
    df = spark.createDataFrame([("PSA 10",), ("BGS 9.5",), ("PSA",), ("Mint",), (None,), ("?",)], "c string")
    assert values_of(df, ledger.sku(F.lit("7"), F.col("c"), F.lit("EN"), F.lit(True))) == ["7_10_EN_F", "7_9_EN_F", "7_10_EN_F", "7_M_EN_F", "7_NM_EN_F", "7_NM_EN_F"]


def test_exports(spark, tmp_path):
    rows = [("a: b", 2, "1_NM_EN_N", 'The "X"', "S", False, "Near Mint", "EN"), ("", 1, "s", "n", "S", True, "Mint", "KO"), (None, 1, "s", "n", "S", True, "Mint", "??")]
    df = spark.createDataFrame(rows, "game string, quantity int, sku string, name string, set_code string, is_foil boolean, condition string, language string")
    sinks.append(df, str(tmp_path / "ledger"))
    sinks.append(df, str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 6
    assert len(sinks.export(df, str(tmp_path / "x"))) == 2
    back = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "x" / "players"))
    assert {r.Language for r in back.collect()} == {"English", "Korean", "??"} and 'The "X"' in {r.Name for r in back.collect()}
    sinks.export(df, str(tmp_path / "y"), "quantities", by_game=True)
    assert [p.name for p in (tmp_path / "y" / "quantities").glob("folder=*")] == ["folder=a_b"]
    assert not sinks.review_report(df.limit(0), str(tmp_path / "r")) and sinks.review_report(df, str(tmp_path / "r"))
    sinks.results_csv(df.withColumn("n", F.struct("game")), str(tmp_path / "c"))
    sinks.results_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_index_append(spark):
    index = spark.createDataFrame([("1", "a")], "product_id string, h string")
    new = spark.createDataFrame([("1", "b"), ("2", "c"), ("2", "c")], "product_id string, h string")
    assert sorted(sinks.appended(index, new).collect()) == [("1", "a"), ("2", "c")]


def test_sources(spark, tmp_path):
    (tmp_path / "a.JPG").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"y")
    assert catalogue.images(spark, str(tmp_path)).count() == 1
    (tmp_path / "o.json").write_text('[{"product_id": 1, "game_id": 7}, {"product_id": 2, "game_name": "x"}]')
    assert catalogue.overlay(spark, str(tmp_path / "o.json")).count() == 2
    assert catalogue.collection(spark, str(tmp_path / "none"), "a int").count() == 0
    g = spark.createDataFrame([(1, "a", None, 1), (2, "b", "Bee", 0)], "id int, name string, display_name string, load int")
    assert [r.display_name for r in catalogue.games(g, loaded_only=True).collect()] == ["a"]
    with pytest.raises(ValueError):
        catalogue.games(g, pattern="zzz")
    mapping = spark.createDataFrame([("b", "t_b")], "game_name string, table_name string")
    assert [(r.name, r.table_name) for r in catalogue.with_tables(g, mapping).collect()] == [("b", "t_b")]
    both = spark.createDataFrame([("", "Z")], "set_code string, setCode string")
    assert catalogue.conform(both, by_value=False).first().set_code == "" and catalogue.conform(both).first().set_code == "Z"


def test_plugins(spark):
    with pytest.raises(plugins.MissingPlugin, match="no ocr plug-in 'x'"):
        plugins.get("ocr", "x")
    with pytest.raises(ValueError):
        plugins.register("nonsense", "x", print)
    sent = []
    plugins.register("device", "list", sent.append)
    df = spark.createDataFrame([(2, "tray2"), (1, "tray1")], "n int, bin string")
    assert plugins.send_bins(df, "list", ["n"]) == 2 and sent == ["tray1", "tray2"]


def test_rules(spark):
    strong, asked = text.rules_query("Counter target spell. Search its controller's library and remove all cards from the game")
    assert strong == ["library", "remove", "spell", "counter"] and asked == [*strong, "controller"]
    described = spark.createDataFrame([("1", "counter target spell search its controllers library for cards of the same name and remove them from the game"), ("2", "draw three cards and gain some life for each of them you own"), ("3", None)], "product_id string, description string")
    said = spark.createDataFrame([(1, "Counter target spell, search its controllers library for cards of the same name. Remove them from the game"), (2, "short")], "k int, said string")
    assert [(r.k, r.product_id) for r in resolve.resolve_rules(said, described, "k", "said").collect()] == [(1, "1")]


def test_titles(spark):
    df = col(spark, ["..Urza's Saga X", "see Ancestor's Gift now", "12", None])
    assert values_of(df, text.possessive_title(F.col("s"))) == ["Urza's Saga X", "Ancestor's Gift now", None, None]
    assert values_of(col(spark, ["-- of the Lightning Bolt a"]), text.stripped_noise(F.col("s"))) == ["the Lightning Bolt"]


def test_metadata_among_many_copies_of_one_name(spark):
    """Costs that are unknown meet all; 20,000 hints and 60,000 items of one name are compared by distinct facts, not as 1.2 billion pairs."""
    import time

    items = [("1", "Oak", None, "a", 1), ("2", "oak", None, "b", 2), ("3", "oak", "7", "b", None), ("4", "OAK", None, "c", None), ("5", "oak", None, "b", 2), ("5", "oak", None, "d", 2)]
    catalogue = spark.createDataFrame(items, "product_id string, name string, number string, set_code string, cmc int")
    hints = spark.createDataFrame([(1, "oak", "oak", "", "A", 1), (2, "oak", "oak", "7", "b", 2), (3, "oak", "oak", "", "B", 2), (4, "oak", "oak", "", "c", None), (5, "oak", "oak", None, "d", 2), (6, "ash", "ash", None, "d", 2)], "k int, resolved string, raw_name string, hint_number string, hint_set string, hint_cmc int")
    got = {r.k: (r.product_id, r.score) for r in resolve.resolve_metadata(hints, catalogue, "k").collect()}
    assert got == {1: ("1", 355), 2: ("3", 375), 4: ("4", 285), 5: ("5", 355)}
    many = catalogue.unionAll(spark.range(60_000).selectExpr("string(id + 100)", "'oak'", "string(null)", "'z'", "5"))
    asked = spark.range(20_000).selectExpr("id AS k", "'oak' AS resolved", "'oak' AS raw_name", "'' AS hint_number", "IF(id % 2 = 0, 'z', 'a') AS hint_set", "5 AS hint_cmc")
    began = time.time()
    assert {r.product_id for r in resolve.resolve_metadata(asked, many, "k").collect()} == set()
    assert time.time() - began < 60


def test_rules_bonus_of_phrases(spark):
    some = ["remove it from the game", "an instant or sorcery of the same name", "instant", "sorcery game", "shuffles the game and removes an instant sorcery", "none", "remove"]
    pairs = spark.createDataFrame([(a, b) for a in some for b in some], "a string, b string")
    has = lambda t: frozenset(w for w in text.RULES_PHRASES if w in t)
    assert all(r.n == text.rules_bonus_of(has(r.a), has(r.b)) for r in pairs.select("a", "b", text.rules_bonus(F.col("a"), F.col("b")).alias("n")).collect())


def test_rules_score_only_what_can_decide(spark, monkeypatch):
    """The result is that of all pairs' scores, copies and texts under 0.5 included; few of the pairs are scored."""
    import random

    import pyarrow as pa

    from lumenroute.operators import rules

    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["remove", "instant", "sorcery", "game"]
    described = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 30))) for _ in range(150)]
    described += [described[3], described[4] + " more", described[5].replace("a", "e")]
    said = [(k, described[k][: 60 + k]) for k in range(40)] + [(100 + k, " ".join(rng.choice(vocabulary) for _ in range(12))) for k in range(10)]
    catalogue = spark.createDataFrame([(str(k), d) for k, d in enumerate(described)], "product_id string, description string")
    strong = lambda q: sorted({w for w in q.split(" ") if len(w) >= 4} - set(text.COMMON_RULES), key=lambda w: (-len(w), w))[:6]
    has = lambda t: frozenset(w for w in text.RULES_PHRASES if w in t)
    want, pairs = {}, 0
    said = [(k, q.strip()) for k, q in said]
    for k, q in said:
        scores = sorted(((similarity.ratio(q, d) + text.rules_bonus_of(has(q), has(d)), -j) for j, d in enumerate(described) if set(strong(q)) & set(d.split(" "))), reverse=True)
        pairs += len(scores)
        second = scores[1][0] if len(scores) > 1 else 0.0
        if len(q) >= 40 and scores and scores[0][0] >= 0.5 and (second <= 0 or scores[0][0] - second >= 0.05):
            want[k] = (str(-scores[0][1]), scores[0][0])
    got = {r.k: (r.product_id, r.score) for r in resolve.resolve_rules(spark.createDataFrame(said, "k int, said string"), catalogue, "k", "said").collect()}
    assert got == want and 3 not in got and len(got) > 20
    calls = []
    matcher = rules.SequenceMatcher
    monkeypatch.setattr(rules, "SequenceMatcher", lambda *x: calls.append(x) or matcher(*x))
    rules.compare(rules.Asked(pa.table({"k": [k for k, _ in said], "q": [q for _, q in said], "t": [strong(q) for _, q in said]})), rules.Described(pa.table({"p": [str(k) for k in range(len(described))], "d": described})))
    assert len(calls) < pairs / 3
