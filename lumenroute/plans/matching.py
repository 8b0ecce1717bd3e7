"""Queries on similarity, ranking and confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hashing, ranking
from .registry import CHANNEL, HASHES, PAIRS, first_matches, hashes, matches, query, read

R6 = "round({}, 6)"


@query("hamming_threshold_join", f"WITH {PAIRS} SELECT probe_id, item_id, dist_r, dist_g, dist_b, total, round(distance, 6) AS distance, round(greatest(0, 100 - distance / 21 * 100), 6) AS confidence FROM m WHERE total <= 24")
def hamming_threshold_join(spark, d):
    out = matches(spark, d, 24)
    return out.select("probe_id", "item_id", "dist_r", "dist_g", "dist_b", "total", F.round("distance", 6).alias("distance"), F.round(hashing.confidence(F.col("distance"), CHANNEL), 6).alias("confidence"))


@query("hamming_topk", f"WITH {PAIRS} SELECT probe_id, item_id, total, rank FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY total, item_id)::BIGINT AS rank FROM m) WHERE rank <= 5")
def hamming_topk(spark, d):
    return hashing.top_k(first_matches(spark, d, 5, 63), "probe_id", [F.col("total"), F.col("item_id")], 5).select("probe_id", "item_id", "total", F.col("rank").cast("bigint").alias("rank"))


@query("hamming_banded_join", f"WITH {HASHES}, w AS (SELECT vec_id, (r << 42) + (g << 21) + b AS w FROM h) SELECT a.vec_id AS a_id, b.vec_id AS b_id, bit_count(xor(a.w, b.w))::BIGINT AS total FROM w a JOIN w b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.w, b.w)) <= 15")
def hamming_banded_join(spark, d):
    w = hashes(spark, d).select("vec_id", (F.shiftleft("r", 42) + F.shiftleft("g", 21) + F.col("b")).alias("w"))
    out = hashing.banded_join(w.withColumnRenamed("vec_id", "a_id"), w.select(F.col("vec_id").alias("b_id"), "w"), "a_id", "b_id", "w", "w", 63, 15)
    return out.where("a_id < b_id").select("a_id", "b_id", F.col("total").cast("bigint").alias("total"))


@query("threshold_sweep", f"WITH {PAIRS} SELECT t::BIGINT AS threshold, count(CASE WHEN distance <= t THEN 1 END)::BIGINT AS n FROM m, (SELECT unnest([5, 6, 7, 8, 9, 10, 12, 15]) AS t) GROUP BY t")
def threshold_sweep(spark, d):
    steps = (5, 6, 7, 8, 9, 10, 12, 15)
    wide = matches(spark, d, 63).agg(*(F.count_if(F.col("distance") <= t).alias(str(t)) for t in steps))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(t).cast("bigint").alias("threshold"), F.col(str(t)).alias("n")) for t in steps))).alias("x")).select("x.threshold", "x.n")


@query("hash_confidence", f"WITH {PAIRS} SELECT probe_id, item_id, round(greatest(0, 100 - distance / 21 * 100), 6) AS confidence FROM m WHERE item_id < 100")
def hash_confidence(spark, d):
    return matches(spark, d, 63).where("item_id < 100").select("probe_id", "item_id", F.round(hashing.confidence(F.col("distance"), CHANNEL), 6).alias("confidence"))


@query("dedupe_min_distance", f"WITH {PAIRS} SELECT probe_id, label, item_id, total FROM (SELECT *, row_number() OVER (PARTITION BY probe_id, label ORDER BY total, item_id) AS n FROM m WHERE total <= 28) WHERE n = 1")
def dedupe_min_distance(spark, d):
    return ranking.dedupe(first_matches(spark, d, 1, 28, group="label"), ["probe_id", "label"], "total", "item_id").select("probe_id", "label", "item_id", "total")


@query("rank_topn", f"WITH {PAIRS} SELECT probe_id, item_id, score, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, distance, item_id)::BIGINT AS rank FROM (SELECT *, (item_id % 3 * 30)::BIGINT AS score FROM m WHERE total <= 28)) WHERE rank <= 10")
def rank_topn(spark, d):
    scored = first_matches(spark, d, 10, 28, score=F.expr("item_id % 3 * 30"))
    return ranking.ranked(scored, "probe_id", "score", "distance", "item_id", 10).select("probe_id", "item_id", "score", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query("adaptive_threshold", f"""WITH {PAIRS}, s AS (SELECT probe_id, t, count(CASE WHEN distance <= t THEN 1 END) AS n, min(distance) AS least FROM m, (SELECT unnest([5, 7, 9, 11, 13, 15, 17, 19]) AS t) GROUP BY probe_id, t)
SELECT probe_id, t::BIGINT AS threshold, n::BIGINT AS matches FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY t) AS k FROM s WHERE n >= 5 OR (least = 0 AND n > 0) OR t = 19) WHERE k = 1""")
def adaptive_threshold(spark, d):
    return ranking.adaptive(matches(spark, d, 63), "probe_id", "distance").select("probe_id", F.col("threshold").cast("bigint").alias("threshold"), F.col("matches").cast("bigint").alias("matches"))


@query("relaxed_fallback", f"""WITH {PAIRS}, s AS (SELECT *, max(CASE WHEN distance <= 7 THEN 1 ELSE 0 END) OVER (PARTITION BY probe_id) AS strict FROM m WHERE distance <= 9)
SELECT probe_id, item_id, total, CASE WHEN strict = 0 THEN 'no_match_at_strict_threshold' END AS fallback_reason, strict = 0 AS manual_review_required FROM s WHERE strict = 0 OR distance <= 7""")
def relaxed_fallback(spark, d):
    return ranking.relaxed(matches(spark, d, 63), "probe_id", "distance", 7, 9).select("probe_id", "item_id", "total", "fallback_reason", "manual_review_required")


@query("nn_l2", """WITH p AS (SELECT a.vec_id AS probe_id, b.vec_id AS item_id, list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) AS d
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT probe_id, item_id, round(sqrt(d), 6) AS l2 FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY d, item_id) AS n FROM p) WHERE n = 1""")
def nn_l2(spark, d):
    e = read(spark, d, "embeddings")
    out = hashing.nearest(e.select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("pe")), e.select(F.col("vec_id").alias("item_id"), "embedding"), "probe_id", "item_id", "embedding", "pe")
    return out.select("probe_id", "item_id", F.round("l2", 6).alias("l2"))


@query("confidence_blend", "SELECT event_id, round(least(value, 100) * 0.85 + coalesce(CASE WHEN user_id % 4 = 0 THEN NULL ELSE (user_id % 10) / 10.0::DOUBLE END, 0) * 15, 6) AS confidence FROM events")
def confidence_blend(spark, d):
    e = read(spark, d, "events")
    mser = F.when(F.col("user_id") % 4 != 0, F.col("user_id") % 10 / F.lit(10.0))
    return e.select("event_id", F.round(ranking.blended(F.least("value", F.lit(100.0)), mser), 6).alias("confidence"))


@query("confidence_level", "SELECT event_id, CASE WHEN value >= 90 THEN 'high' WHEN value >= 75 THEN 'medium' ELSE 'low' END AS level, value < 70 AS manual_review_required FROM events")
def confidence_level(spark, d):
    return read(spark, d, "events").select("event_id", ranking.level(F.col("value")).alias("level"), ranking.needs_review(F.col("value")).alias("manual_review_required"))


@query("fallback_outcomes", """WITH o(reason, distance, confidence, score, level, review) AS (VALUES ('ocr_fast_path', 998.0, 98.0, 1000, 'high', false), ('ocr_metadata_unique', 998.0, 97.0, 999, 'high', false),
('metadata_name_only', 999.0, 60.0, 1, 'low', true), ('ocr_name_only', 999.0, 55.0, 1, 'low', true), ('ocr_name_only_noisy', 999.0, 45.0, 0, 'low', true)),
e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'ocr_fast_path' WHEN 'click' THEN 'ocr_metadata_unique' WHEN 'signup' THEN 'metadata_name_only' WHEN 'error' THEN 'ocr_name_only_noisy' ELSE 'ocr_name_only' END AS reason FROM events)
SELECT event_id, reason AS fallback_reason, distance::DOUBLE AS distance, confidence::DOUBLE AS confidence, score::BIGINT AS metadata_match_score, level AS confidence_level, review AS manual_review_required FROM e JOIN o USING (reason)""")
def fallback_outcomes(spark, d):
    t = F.col("event_type")
    reason = F.when(t == "view", "ocr_fast_path").when(t == "click", "ocr_metadata_unique").when(t == "signup", "metadata_name_only").when(t == "error", "ocr_name_only_noisy").otherwise("ocr_name_only")
    out = ranking.with_outcome(read(spark, d, "events").select("event_id", "event_type"), reason).drop("event_type")
    return out.withColumn("metadata_match_score", F.col("metadata_match_score").cast("bigint"))


@query("best_candidate_source", """WITH c AS (SELECT user_id AS probe_id, event_type, CASE event_type WHEN 'view' THEN 'original' WHEN 'click' THEN 'manual_crop' WHEN 'signup' THEN 'contour_crop' ELSE 'other_' || event_type END AS source, value AS confidence,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 50)::DOUBLE END AS distance, value < 70 AS review, event_id FROM events)
SELECT probe_id, source, confidence, distance FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY (NOT review)::INT DESC, (source IN ('manual_crop', 'contour_crop'))::INT DESC, confidence DESC, -coalesce(distance, 9999) DESC, source DESC) AS n FROM c) WHERE n = 1""")
def best_candidate_source(spark, d):
    t = F.col("event_type")
    source = F.when(t == "view", "original").when(t == "click", "manual_crop").when(t == "signup", "contour_crop").otherwise(F.concat(F.lit("other_"), t))
    c = read(spark, d, "events").select(F.col("user_id").alias("probe_id"), source.alias("source"), F.col("value").alias("confidence"), F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 50).cast("double")).alias("distance"), (F.col("value") < 70).alias("manual_review_required"))
    return ranking.best_source(c, "probe_id", "source")


@query("top2_margin", """WITH s AS (SELECT user_id AS grp, event_id AS item, value / 500 AS score FROM events), r AS (SELECT *, row_number() OVER w AS n, coalesce(lead(score) OVER w, 0) AS second FROM s WINDOW w AS (PARTITION BY grp ORDER BY score DESC, item))
SELECT grp, item, round(score, 6) AS score FROM r WHERE n = 1 AND score >= 0.2 AND (second <= 0 OR score - second >= 0.02)""")
def top2_margin(spark, d):
    s = read(spark, d, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("item"), (F.col("value") / 500).alias("score"))
    return ranking.accepted_by_margin(s, "grp", "score", "item", 0.2, 0.02).select("grp", "item", F.round("score", 6).alias("score"))


@query("unique_top_score", """WITH s AS (SELECT user_id AS grp, event_type AS item, (CASE WHEN value > 100 THEN 120 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 80 ELSE 0 END + CASE WHEN event_id % 50 = 0 THEN 90 ELSE 0 END)::BIGINT AS score FROM events),
b AS (SELECT grp, item, max(score) AS score FROM s GROUP BY ALL), t AS (SELECT *, max(score) OVER (PARTITION BY grp) AS top FROM b)
SELECT grp, min(item) AS item, min(score) AS score FROM t WHERE score = top GROUP BY grp HAVING count(*) = 1 AND min(score) >= 190""")
def unique_top_score(spark, d):
    score = F.when(F.col("value") > 100, 120).otherwise(0) + F.when(F.col("event_id") % 3 == 0, 80).otherwise(0) + F.when(F.col("event_id") % 50 == 0, 90).otherwise(0)
    s = read(spark, d, "events").select(F.col("user_id").alias("grp"), F.col("event_type").alias("item"), score.cast("bigint").alias("score"))
    return ranking.unique_top(s, "grp", "item", "score", F.lit(190))
