"""Queries on whole identification, blocked filters, diagnostics and upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hashing, image, ledger, metafilter, ranking, resolve, routing
from ..sources import catalogue as source
from ..sources import sinks
from .identify import Options, candidates, identify
from .registry import CARDS, cards, inline, query, read

_HASH = "sha256('{c}' || p_partkey)"


def _catalogue(spark, d):
    c = cards(spark, d)
    colour = F.when(F.col("p_partkey") % 4 == 0, "W").when(F.col("p_partkey") % 4 == 1, "U,B").when(F.col("p_partkey") % 4 == 2, "red")
    extra = {"color": colour, "number": F.col("product_id"), "subTypeName": F.when(F.col("p_partkey") % 3 == 0, "Foil").when(F.col("p_partkey") % 3 == 1, "Normal"), "market_price": F.col("price").cast("string"), "low_price": F.lit("1"), "set_name": F.col("set_code"), "game": F.lit("g")}
    return c.withColumns(extra).withColumn("cmc", F.col("cmc").cast("string"))


_ITEMS = f"""{CARDS}, k AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'W' WHEN 1 THEN 'BU' WHEN 2 THEN 'R' ELSE '' END AS colour, CASE p_partkey % 3 WHEN 0 THEN 'Foil' WHEN 1 THEN 'Normal' END AS sub FROM c)"""


def _index(spark, d):
    hashes = [F.sha2(F.concat(F.lit(c), F.col("product_id")).cast("binary"), 256).alias(f"{c}_phash") for c in "rgb"]
    return cards(spark, d).where("p_partkey <= 300").select("product_id", F.lit("g").alias("game"), *hashes)


def _words(h: str) -> str:
    return f"list_transform(range(8), lambda i: ('0x' || substr({h}, 1 + 8 * i, 8))::BIGINT)"


_END = f"""WITH {CARDS}, i AS (SELECT product_id, cmc, set_code, p_partkey, {", ".join(f"{_words(_HASH.format(c=c))} AS {c}" for c in "rgb")} FROM c WHERE p_partkey <= 300),
q AS (SELECT p_partkey AS probe_id, CASE WHEN p_partkey % 20 = 0 THEN cmc END AS hc, CASE WHEN p_partkey % 30 = 0 THEN set_code END AS hs,
  {", ".join(f"list_transform(range(8), lambda i: CASE WHEN i = {k} THEN 0::BIGINT ELSE {c}[i + 1] END) AS {c}" for k, c in enumerate("rgb"))} FROM i WHERE p_partkey % 10 = 0),
p AS (SELECT probe_id, product_id, hc, hs, abs(i.cmc - hc) AS apart, upper(i.set_code) = upper(hs) AS same, {", ".join(f"list_sum(list_transform(range(1, 9), lambda k: bit_count(xor(i.{c}[k], q.{c}[k]))))::BIGINT AS d{c}" for c in "rgb")} FROM i, q),
m AS (SELECT *, (dr + dg + db) / 3.0::DOUBLE AS distance, CASE WHEN hc IS NOT NULL THEN 70 ELSE 0 END + CASE WHEN hs IS NOT NULL THEN 80 ELSE 0 END AS score FROM p
  WHERE dr + dg + db <= 120 AND (hc IS NULL OR apart <= CASE WHEN hs IS NULL THEN 1 ELSE 0 END) AND (hs IS NULL OR same)),
b AS (SELECT *, greatest(0, 100 - distance / 256 * 100) * 0.85 + 7.5 AS confidence FROM m)
SELECT probe_id::BIGINT AS probe_id, product_id, round(distance, 6) AS distance, score::BIGINT AS score, round(confidence, 6) AS confidence, CASE WHEN confidence >= 90 THEN 'high' WHEN confidence >= 75 THEN 'medium' ELSE 'low' END AS level,
  confidence < 70 AS review, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, distance, product_id)::BIGINT AS rank FROM b"""


@query("identify_end_to_end", _END)
def identify_end_to_end(spark, d):
    """Probes whose hashes lost one word in each channel, some with a cost or a set as hints, through the whole of identification."""
    zero = lambda c, k: F.concat(F.substring(c, 1, 8 * k), F.lit("0" * 8), F.substring(c, 9 + 8 * k, 64))
    c = _catalogue(spark, d)
    given = c.where("p_partkey % 10 = 0").select("product_id", F.col("p_partkey").alias("probe_id"), F.when(F.col("p_partkey") % 20 == 0, F.col("cmc").cast("int")).alias("hint_cmc"), F.when(F.col("p_partkey") % 30 == 0, F.col("set_code")).alias("hint_set"))
    probes = _index(spark, d).join(given, "product_id").select("probe_id", "hint_cmc", "hint_set", F.lit(0.5).alias("mser_score"), *(zero(f"{c}_phash", k).alias(f"{c}_phash") for k, c in enumerate("rgb")))
    out = identify(probes, c, _index(spark, d), Options(relaxed=40.0, top_n=1_000_000))
    return out.select(
        "probe_id", "product_id", F.round("distance", 6).alias("distance"), F.col("metadata_match_score").cast("bigint").alias("score"), F.round("confidence", 6).alias("confidence"),
        F.col("confidence_level").alias("level"), F.col("manual_review_required").alias("review"), F.col("rank").cast("bigint").alias("rank"),
    )


_HINT_ROWS = "(1, 'W', NULL, NULL, NULL, NULL, NULL), (2, 'multi', NULL, NULL, NULL, 'PROMO', NULL), (3, 'colorless', 9, NULL, NULL, NULL, 'foil'), (4, NULL, NULL, 'Brand#3', NULL, NULL, 'NORMAL'), (5, 'R', NULL, NULL, '22', NULL, NULL), (6, NULL, 7, 'brand#2', NULL, NULL, NULL), (7, NULL, NULL, NULL, NULL, 'econ', 'x'), (8, 'purple', NULL, NULL, NULL, NULL, NULL)"


@query("cf_blocked", f"""WITH {_ITEMS}, q(probe_id, hc, hm, hs, hn, ht, hb) AS (VALUES {_HINT_ROWS})
SELECT probe_id::BIGINT AS probe_id, product_id, (CASE WHEN hc IS NULL THEN 0 ELSE 30 END + CASE WHEN hm IS NULL THEN 0 ELSE 70 END + CASE WHEN hs IS NULL THEN 0 ELSE 80 END + CASE WHEN hn IS NULL THEN 0 ELSE 90 END + CASE WHEN ht IS NULL THEN 0 ELSE 15 END + CASE WHEN hb IS NULL THEN 0 ELSE 10 END)::BIGINT AS score FROM k, q
WHERE (hc IS NULL OR CASE lower(hc) WHEN 'multi' THEN length(colour) > 1 WHEN 'colorless' THEN colour = '' WHEN 'purple' THEN true ELSE colour = hc END) AND (hm IS NULL OR abs(cmc - hm) <= CASE WHEN hs IS NULL AND hn IS NULL THEN 1 ELSE 0 END)
  AND (hs IS NULL OR upper(set_code) = upper(hs)) AND (hn IS NULL OR product_id = hn) AND (ht IS NULL OR contains(lower(type), lower(ht))) AND (hb IS NULL OR coalesce(contains(lower(sub), lower(hb)), false))""")
def cf_blocked(spark, d):
    """Hints of every kind but names, blocked by one of them each, so that no hint meets the whole catalogue."""
    hints = inline(spark, _HINT_ROWS, "probe_id, hint_color, hint_cmc, hint_set, hint_number, hint_type, hint_subtype")
    hints = hints.select(F.col("probe_id").cast("bigint").alias("probe_id"), F.lit(None).cast("string").alias("hint_name"), *(F.col(f"hint_{c}") for c in ("color", "cmc", "set", "number", "type", "subtype")))
    return candidates(hints, _catalogue(spark, d), Options())[1].select("probe_id", "product_id", F.col("metadata_match_score").cast("bigint").alias("score"))


@query("cf_names_blocked", f"""WITH {CARDS}, q AS (SELECT p_partkey AS probe_id, CASE WHEN p_partkey % 2 = 0 THEN upper(name) ELSE substr(name, 2) || 'x' END AS said FROM c WHERE p_partkey <= 60),
x AS (SELECT probe_id, product_id, lower(said) = lower(name) AS e, levenshtein(lower(said), lower(name)) <= greatest(2, least(4, length(said) // 6)) AS f FROM q, c), y AS (SELECT *, bool_or(e) OVER (PARTITION BY probe_id) AS any_e FROM x)
SELECT probe_id::BIGINT AS probe_id, product_id, any_e AS exact FROM y WHERE CASE WHEN any_e THEN e ELSE f END""")
def cf_names_blocked(spark, d):
    """Name hints, right or with an edit at both ends: what the name filter leaves by edit distance, from blocked pairs."""
    c = _catalogue(spark, d)
    said = F.when(F.col("p_partkey") % 2 == 0, F.upper("name")).otherwise(F.concat(F.expr("substring(name, 2)"), F.lit("x")))
    none = [F.lit(None).cast("string").alias(f"hint_{x}") for x in ("color", "cmc", "set", "number", "type", "subtype")]
    hints = c.where("p_partkey <= 60").select(F.col("p_partkey").alias("probe_id"), said.alias("hint_name"), *none)
    out = metafilter.apply(metafilter.candidates(hints, c), fuzzy_ratio=False)
    return out.where("alive").select("probe_id", "product_id", (F.col("score") > 100).alias("exact"))


@query("named_distances", f"""WITH {CARDS}, e AS (SELECT a.vec_id AS probe_id, b.vec_id::VARCHAR AS product_id, abs(a.label - b.label)::DOUBLE AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND b.vec_id % 7 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY distance, product_id)::BIGINT AS rank FROM e) SELECT r.probe_id, r.product_id, r.rank, c.name FROM r LEFT JOIN c ON c.product_id = r.product_id AND c.p_partkey % 2 = 0 WHERE rank <= 10""")
def named_distances(spark, d):
    e = read(spark, d, "embeddings")
    a = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("probe_id"), F.col("label").alias("la"))
    pairs = e.where("vec_id % 7 = 0").select(F.col("vec_id").cast("string").alias("product_id"), "label").crossJoin(a).select("probe_id", "product_id", F.abs(F.col("la") - F.col("label")).cast("double").alias("distance"))
    return hashing.with_names(pairs, cards(spark, d).where("p_partkey % 2 = 0")).select("probe_id", "product_id", F.col("rank").cast("bigint").alias("rank"), "name")


@query("counts_like", f"WITH {CARDS} SELECT 'cards_' || (p_partkey % 3) AS table_name, count(CASE WHEN contains(lower(name), 'red') THEN 1 END)::BIGINT AS n FROM c GROUP BY 1")
def counts_like(spark, d):
    c = cards(spark, d)
    return source.counts_like({f"cards_{k}": c.where(F.col("p_partkey") % 3 == k) for k in range(3)}, "RED")


@query("sampled_mapping", f"WITH {CARDS} SELECT 'cards_' || (p_partkey % 3) AS table_name, 'Game ' || (p_partkey % 3) AS game FROM c GROUP BY ALL")
def sampled_mapping(spark, d):
    c = cards(spark, d)
    return source.sampled_mapping({f"cards_{k}": c.where(F.col("p_partkey") % 3 == k).withColumn("Game", F.concat(F.lit("Game "), F.lit(k))) for k in range(3)})


@query("set_codes", "SELECT code FROM (VALUES ('AFRICA'), ('AMERICA'), ('2XM'), ('ZEN')) AS v(code)")
def set_codes(spark, d):
    sets = read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("code"))
    return resolve.set_codes(inline(spark, "('0'), (' 1 '), ('2xm'), ('zen'), ('2XM'), ('99'), (''), (NULL)", "chosen"), sets)


@query("scan_stats", "SELECT count(*)::BIGINT AS scans, round(sum(value) / count(*), 6) AS average_time, round(sum(user_id) / count(*), 6) AS average_cards_checked, round(100.0::DOUBLE * count(CASE WHEN event_type = 'view' THEN 1 END) / count(*), 6) AS cache_hit_rate FROM events")
def scan_stats(spark, d):
    e = read(spark, d, "events").select(F.col("value").alias("seconds"), F.col("user_id").alias("cards_checked"), (F.col("event_type") == "view").alias("cache_hit"))
    return ledger.scan_stats(e).select("scans", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("average_time", "average_cards_checked", "cache_hit_rate")))


@query("crop_stats", "SELECT count(*)::BIGINT AS total, count(CASE WHEN event_id % 4 < 2 THEN 1 END)::BIGINT AS cropped, count(CASE WHEN event_id % 4 = 2 THEN 1 END)::BIGINT AS skipped, count(CASE WHEN event_id % 4 = 3 THEN 1 END)::BIGINT AS failed FROM events")
def crop_stats(spark, d):
    k = F.col("event_id") % 4
    return sinks.crop_stats(read(spark, d, "events").select(F.when(k < 2, "cropped").when(k == 2, "skipped").otherwise("failed").alias("status")))


@query("reference_crop", "SELECT doc_id, 100 + doc_id % 50 AS crop_w, doc_id % 7 AS left_margin, 200 + doc_id % 900 - 1 - (doc_id % 7 + 99 + doc_id % 50) AS right_margin, round((100 + doc_id % 50) / 140.0::DOUBLE, 6) AS aspect FROM documents")
def reference_crop(spark, d):
    x = (F.col("doc_id") % 7).cast("int")
    rect = F.array(x, F.lit(3), (x + 99 + F.col("doc_id") % 50).cast("int"), F.lit(142))
    out = image.reference_crop(rect, (F.col("doc_id") % 900 + 200).cast("int"), F.lit(400))
    return read(spark, d, "documents").select("doc_id", out.alias("r")).select("doc_id", *(F.col(f"r.{a}").cast("bigint").alias(b) for a, b in (("crop_w", "crop_w"), ("left", "left_margin"), ("right", "right_margin"))), F.round("r.aspect", 6).alias("aspect"))


_COMMANDS = "(1, 'TrayA'), (2, 'HomeButton'), (3, 'StartMachine'), (4, 'TrayA'), (5, 'CalibrateX1'), (6, 'StopMachine'), (7, 'CalibrateY2'), (8, 'TrayB'), (9, 'StartMachine'), (10, 'TrayB')"


@query("machine_guard", "SELECT id::BIGINT AS id, outcome FROM (VALUES (1, 'refused: stopped'), (2, 'done'), (3, 'switched'), (4, 'done'), (5, 'refused: started'), (6, 'switched'), (7, 'done'), (8, 'refused: stopped'), (9, 'switched'), (10, 'done')) AS v(id, outcome)")
def machine_guard(spark, d):
    rows = inline(spark, _COMMANDS, "id, command").select(F.col("id").cast("bigint").alias("id"), "command", F.lit("m").alias("machine"))
    return routing.guarded(rows, [F.col("id")]).select("id", "outcome")


@query("dedupe_without_ids", """WITH r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 20)::VARCHAR END AS pid, event_type AS name, user_id % 5 AS number, value FROM events WHERE event_id < 500),
n AS (SELECT *, row_number() OVER (PARTITION BY coalesce('i' || pid, 'r' || name || '/' || number) ORDER BY value, event_id) AS k FROM r) SELECT event_id FROM n WHERE k = 1""")
def dedupe_without_ids(spark, d):
    pid = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 20).cast("string"))
    rows = read(spark, d, "events").where("event_id < 500").withColumn("key", ranking.identity(pid, F.lit("g"), F.col("event_type"), F.col("user_id") % 5, F.lit(None)))
    return ranking.dedupe(rows, ["key"], "value", "event_id").select("event_id")


@query("finish_and_rarity_filter", f"WITH {_ITEMS} SELECT product_id FROM k WHERE coalesce(sub, '') IN ('', 'Foil') AND upper(rarity) IN ('PROMO', 'ECONOMY', 'LARGE')")
def finish_and_rarity_filter(spark, d):
    """Finishes are compared as they are written, rarities in any case; an unknown finish passes."""
    keep = resolve.permissive(F.col("subTypeName"), ["Foil", "normal"], ignore_case=False) & resolve.permissive(F.col("rarity"), ["promo", "Economy", "LARGE"])
    return _catalogue(spark, d).where(keep).select("product_id")


_READ = "(1, NULL, NULL, NULL, NULL, NULL, 'bolt', 'Brand#2', '7', 'R', 3), (2, 'given', 'SET', '9', 'U', 1, 'bolt', 'Brand#2', '7', 'R', 3), (3, NULL, NULL, NULL, NULL, NULL, '', 'Brand#2', '', NULL, 4), (4, NULL, NULL, NULL, NULL, NULL, NULL, 'nope', NULL, NULL, 4), (5, '', '', NULL, '', NULL, '', 'nope', '12', 'W', NULL)"


@query("hints_from_text", """SELECT id::BIGINT AS id, name, code, number, color, cmc::BIGINT AS cmc FROM (VALUES (1, 'bolt', 'B#2', '7', 'R', 3), (2, 'given', 'SET', '9', 'U', 1), (3, NULL, NULL, NULL, NULL, 4), (4, NULL, NULL, NULL, NULL, NULL), (5, NULL, NULL, '12', 'W', NULL)) AS v(id, name, code, number, color, cmc)""")
def hints_from_text(spark, d):
    short = cards(spark, d).withColumn("set_code", F.concat(F.lit("b"), F.substring("set_code", 6, 2)))
    columns = "id, hint_name, hint_set, hint_number, hint_color, hint_cmc, read_name, read_set, read_number, read_color, read_cmc"
    found = inline(spark, _READ.replace("Brand#2", "B#2"), columns)
    out = resolve.hints_from_text(found, short.withColumn("set_code", F.lit("b#2")))
    return out.select(F.col("id").cast("bigint").alias("id"), F.col("hint_name").alias("name"), F.col("hint_set").alias("code"), F.col("hint_number").alias("number"), F.col("hint_color").alias("color"), F.col("hint_cmc").cast("bigint").alias("cmc"))


@query("index_preload", f"WITH {CARDS} SELECT product_id FROM c WHERE p_partkey % 2 = 1")
def index_preload(spark, d):
    rows = cards(spark, d).select(F.col("product_id").alias("UniqueID"), F.when(F.col("p_partkey") % 2 == 1, F.lit("00")).alias("r_phash"))
    return source.index_rows(rows).where(F.col("r_phash").isNotNull()).select("product_id")


@query("metadata_rows", f"WITH {CARDS} SELECT product_id, name FROM c WHERE p_partkey % 5 <> 0 UNION ALL SELECT 'own-1', 'Own card'")
def metadata_rows(spark, d):
    c = cards(spark, d).withColumn("product_id", F.when(F.col("p_partkey") % 5 != 0, F.col("product_id")))
    own = spark.createDataFrame([("own-1", "Own card", "7"), (None, "No id", "7"), ("own-2", "Other game", "8")], "product_id string, name string, game_id string")
    return source.metadata(c.drop("price"), own, 7, "Game").select("product_id", "name")
