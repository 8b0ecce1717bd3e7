from pyspark.sql import functions as F

from lumenroute.plans.identify import Options, identify
from lumenroute.sources.catalogue import conform

A, B, C = "0" * 64, "f" * 8 + "0" * 56, "f" * 64


def setup(spark, probes):
    raw = spark.createDataFrame(
        [("1", "Lightning Bolt", "R", 1, "M10", "146", "Instant", "Normal", "2.5"), ("2", "Counterspell", "U", 2, "7ED", "67", "Instant", "Foil", "0"), ("3", "Sol Ring", None, 1, "CMM", "409", "Artifact", "Normal", "x"), ("4", "Sol Ring", None, 1, "C21", "263", "Artifact", None, None)],
        "product_id string, name string, color string, cmc int, set_code string, number string, type string, subTypeName string, market_price string",
    ).withColumn("low_price", F.lit("0.5"))
    index = spark.createDataFrame([("1", "g", A), ("2", "g", B), ("3", "g", C), ("4", "g", None)], "product_id string, game string, r_phash string").withColumns({"g_phash": F.col("r_phash"), "b_phash": F.col("r_phash")})
    p = spark.createDataFrame(probes, "probe_id int, r_phash string, hint_name string, hint_set string, hint_cmc int").withColumns({"g_phash": F.col("r_phash"), "b_phash": F.col("r_phash"), "mser_score": F.lit(1.0)})
    return p, conform(raw), index


def test_branches(spark):
    probes = [
        (1, A, None, None, None),  # a hash match, the second within the threshold too
        (2, "f" * 28 + "0" * 36, None, None, None),  # only within the relaxed threshold
        (3, None, "Sol Rinq", None, None),  # two of this name: the name alone
        (4, None, "lightning bolt", None, None),  # a unique name
        (5, None, None, None, None),  # nothing
        (6, A, "Nothing Like It", None, None),  # the filter leaves nothing, and the name is no item's
        (7, C, "x1 ##", None, None),  # no name either
    ]
    got = {}
    for r in identify(*setup(spark, probes)).orderBy("probe_id", "rank").collect():
        got.setdefault(r.probe_id, []).append(r)
    assert [r.product_id for r in got[1]] == ["1", "2"]
    assert got[1][0].distance == 0 and got[1][0].confidence == 100 and got[1][0].confidence_level == "high" and not got[1][0].manual_review_required
    assert got[1][0].market_price == 2.5 and got[1][1].market_price == 0.5
    assert {r.fallback_reason for r in got[2]} == {"no_match_at_strict_threshold"} and all(r.manual_review_required and r.confidence_level == "low" for r in got[2])
    assert got[3][0].fallback_reason == "ocr_name_only" and got[3][0].confidence == 55 and got[3][0].manual_review_required
    assert got[4][0].fallback_reason == "ocr_metadata_unique" and got[4][0].distance == 998 and got[4][0].confidence == 97
    assert 5 not in got
    assert [(r.product_id, r.name, r.fallback_reason) for r in got[6]] == [(None, "Nothing Like It", "ocr_name_only")]
    assert [(r.product_id, r.name, r.fallback_reason, r.confidence) for r in got[7]] == [(None, "x1 ##", "ocr_name_only_noisy", 45)]
    assert got[3][0].product_id is None and got[3][0].name == "Sol Ring"


def test_filters_pass_unknown_values(spark):
    p, catalogue, index = setup(spark, [(1, A, None, None, None)])
    assert [r.product_id for r in identify(p, catalogue, index, Options(sets=("7ed",))).collect()] == ["2"]
    assert [r.product_id for r in identify(p, catalogue, index, Options(finishes=("Normal",), top_n=1)).collect()] == ["1"]


def test_hints_narrow_the_hashes(spark):
    p, catalogue, index = setup(spark, [(1, B, None, "M10", None)])
    rows = identify(p, catalogue, index).collect()
    assert [(r.product_id, r.metadata_match_score) for r in rows] == [("1", 80)]


def test_ways_in(spark):
    probes = [(1, A, "lightning bolt", None, None), (2, A, "Sol Rinq", None, None), (3, A, None, None, None)]
    p, catalogue, index = setup(spark, probes)
    reasons = lambda rows: {r.probe_id: r.fallback_reason for r in rows.where("rank = 1").collect()}
    assert reasons(identify(p, catalogue, index, Options(mode="live"))) == {1: "ocr_fast_path_live", 2: "ocr_name_primary_live", 3: None}
    two = catalogue.withColumn("game", F.col("product_id"))
    said = "Whenever this creature deals combat damage draw a card then discard a card"
    told = p.withColumn("rules_text", F.when(F.col("probe_id") == 3, said))
    described = two.withColumn("description", F.when(F.col("product_id") == "2", said + ".").otherwise("Something else altogether that shares nothing much with the other"))
    assert reasons(identify(told, described, index, Options(mode="live"))) == {1: "ocr_fast_path_live", 2: "ocr_name_only_live", 3: "ocr_rules_text_live"}


def test_a_close_name_or_a_hint_gives_the_item(spark):
    p, catalogue, index = setup(spark, [(1, None, "Sol Ring", None, None), (2, None, "Sol Rinq", None, 1), (3, None, "Sol Ring", "CMM", None)])
    got = {r.probe_id: (r.fallback_reason, r.product_id, r.confidence) for r in identify(p, catalogue, index, Options(mode="file")).collect()}
    assert got == {1: ("metadata_name_only", "3", 60), 2: ("metadata_name_only", "3", 60), 3: ("ocr_fast_path", "3", 98)}


def test_grey_mode_and_fetched_hashes(spark):
    p, catalogue, index = setup(spark, [(1, A, None, None, None)])
    grey = index.withColumn("grayscale_phash", F.when(F.col("product_id") == "2", A))
    assert [r.product_id for r in identify(p, catalogue, grey, Options(grayscale=True)).collect()] == ["2"]
    p, catalogue, index = setup(spark, [(1, A, "Sol Rinq", None, None)])
    pictured = catalogue.withColumn("image_url", F.concat(F.lit("u"), "product_id"))
    assert sorted(r.product_id for r in identify(p, pictured, index.limit(0), Options(fetch="plugins_for_tests:hashes_of")).collect()) == ["3", "4"]


def test_a_lost_first_letter_is_found(spark):
    from lumenroute.operators.resolve import resolve_names

    catalogue = spark.createDataFrame([("Thunderbolt",), ("Counterspell",)], "name string")
    said = spark.createDataFrame([(1, "hunderbolt"), (2, "thunderbol"), (3, "ounterspell"), (4, "zzz yyy")], "k int, said string")
    assert {r.k: r.resolved for r in resolve_names(said, catalogue, "k", "said").collect()} == {1: "Thunderbolt", 2: "Thunderbolt", 3: "Counterspell"}
