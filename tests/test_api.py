from pyspark.sql import functions as F
from test_identify import A, C, setup

from lumenroute.api import Identifier


def test_batch_review_and_routes(spark):
    probes, catalogue, index = setup(spark, [(1, A, None, None, None), (2, C, None, None, None), (3, None, None, None, None)])
    engine = Identifier(catalogue, index).with_options(relaxed=40.0)
    files = probes.withColumns({
        "source_file": F.concat(F.lit("f"), "probe_id"), "ocr_top_name": F.when(F.col("probe_id") == 2, "Zzz"), "ocr_resolved_name": F.when(F.col("probe_id") == 2, "Counterspell"),
        "error": F.when(F.col("probe_id") == 3, "unreadable"),
    })
    results = {r.probe_id: r for r in engine.batch(files).collect()}
    assert results[1].card_name == "Lightning Bolt" and results[1].status == "success" and len(results[1].all_matches) == 2
    assert results[3].status == "error" and not results[3].match_found
    review = engine.review(engine.batch(files)).collect()
    assert [(r.probe_id, r.review_reasons) for r in review] == [(2, "scanner_ocr_disagreement")]
    bins = {r.probe_id: r.bin for r in engine.routed(engine.identify(probes), "type").collect()}
    assert bins == {1: "instant", 2: "artifact"}


def test_adaptive_and_refined(spark):
    probes, catalogue, index = setup(spark, [(1, A, None, None, None)])
    engine = Identifier(catalogue, index)
    assert [r.product_id for r in engine.adaptive(probes).collect()] == ["1"]
    assert engine.refined(probes).count() == 2
