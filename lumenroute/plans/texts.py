"""Queries on recognised texts and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, values
from ..functions.similarity import seq_ratio, within
from ..operators import metafilter, resolve
from .registry import CARDS, cards, inline, query, read

_OCR = """(1, 'Dower Sink'), (2, 'Dee sey'), (3, '  the DEE  river '), (4, 'Urza’s   Tower'), (5, '123'), (6, ''), (7, 'Bolt of Fire 045/280 M'), (8, 'M10 R 146 EN'), (9, 'tcg FOIL 2XM 12a'), (10, '{2}{W/U}{G}'), (11, '{X}{R}{R}'), (12, '3WU'), (13, 'a b'), (14, '##$$ %%')"""


@query("name_exact_ci", f"WITH {CARDS} SELECT product_id, name FROM c WHERE lower(name) = lower('RED Widget')")
def name_exact_ci(spark, d):
    return resolve.exact_names(cards(spark, d), "RED Widget").select("product_id", "name")


@query("name_token_candidates", f"WITH {CARDS} SELECT DISTINCT name FROM c WHERE lower(name) LIKE '%bolt%' ORDER BY name LIMIT 80")
def name_token_candidates(spark, d):
    return resolve.names_with(cards(spark, d), "bolt", 80)


@query("token_block_join", f"""WITH {CARDS}, n AS (SELECT DISTINCT name FROM c), t AS (SELECT name, unnest(string_split(name, ' ')) AS tok FROM n), q AS (SELECT p_partkey, unnest(string_split(name, ' ')) AS tok FROM c WHERE p_partkey % 100 = 0)
SELECT p_partkey, name, count(DISTINCT q.tok)::BIGINT AS shared FROM q JOIN t USING (tok) GROUP BY ALL""")
def token_block_join(spark, d):
    c = cards(spark, d)
    return resolve.shared_words(c.where("p_partkey % 100 = 0").select("p_partkey", F.col("name").alias("said")), c, "p_partkey", "said")


@query("top_tokens", f"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z'']{{4,}}'))) AS w FROM documents WHERE lang = 'en'), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, w) AS n FROM w)
SELECT doc_id, string_agg(w, ' ' ORDER BY n) AS tokens FROM r WHERE n <= 6 GROUP BY doc_id""")
def top_tokens(spark, d):
    out = read(spark, d, "documents").where("lang = 'en'").select("doc_id", F.array_join(text.strongest_tokens(F.col("text"), 4, 6), " ").alias("tokens"))
    return out.where("tokens <> ''")


@query("token_overlap", f"WITH {CARDS} SELECT product_id, len(list_intersect(string_split(name, ' '), ['red', 'bolt', 'small']))::BIGINT AS overlap FROM c")
def token_overlap(spark, d):
    return cards(spark, d).select("product_id", F.size(F.array_intersect(F.split("name", " "), F.array(F.lit("red"), F.lit("bolt"), F.lit("small")))).cast("bigint").alias("overlap"))


@query("rules_text_and", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%tion%' AND lower(text) LIKE '%ing%' AND lower(text) LIKE '%the%'")
def rules_text_and(spark, d):
    return read(spark, d, "documents").where(text.rules_predicate(F.col("text"), ["tion", "ing", "the"], [])).select("doc_id")


@query("rules_text_or", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%idiot%' OR lower(text) LIKE '%license%'")
def rules_text_or(spark, d):
    return read(spark, d, "documents").where(text.rules_predicate(F.col("text"), ["idiot"], ["idiot", "license"])).select("doc_id")


@query("title_signal", f"SELECT id::BIGINT AS id, (length(regexp_replace(s, '[^A-Za-z]', '', 'g')) / greatest(length(s), 1) >= 0.55) OR regexp_matches(s, '[A-Za-z]{{3,}}\\s+[A-Za-z]{{3,}}') AS signal FROM (VALUES {_OCR}) AS t(id, s)")
def title_signal(spark, d):
    return inline(spark, _OCR, "id, s").select(F.col("id").cast("bigint").alias("id"), text.title_signal(F.col("s")).alias("signal"))


@query("ocr_fixes", f"""SELECT id::BIGINT AS id, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(replace(lower(s), '’', ''''), '\\s+', ' ', 'g')), '\\bdower\\b', 'power', 'g'), '\\bdee\\s+sey\\b', 'seeker', 'g'), '\\bdee\\b', 'see', 'g') AS fixed FROM (VALUES {_OCR}) AS t(id, s)""")
def ocr_fixes(spark, d):
    return inline(spark, _OCR, "id, s").select(F.col("id").cast("bigint").alias("id"), text.slips_fixed(F.col("s")).alias("fixed"))


@query("collector_number", f"SELECT id::BIGINT AS id, nullif(lower(regexp_extract(s, '\\b(\\d{{2,4}}[A-Za-z]?)\\s*(?:/\\s*\\d{{2,4}})?\\b', 1)), '') AS number FROM (VALUES {_OCR}) AS t(id, s)")
def collector_number(spark, d):
    return inline(spark, _OCR, "id, s").select(F.col("id").cast("bigint").alias("id"), text.collector_number(F.col("s")).alias("number"))


@query("set_code_extract", f"SELECT id::BIGINT AS id, list_filter(regexp_extract_all(upper(s), '\\b[A-Z0-9]{{3,5}}\\b'), lambda x: length(regexp_replace(x, '[^A-Z]', '', 'g')) >= 2 AND x NOT IN ('TM', 'TCG', 'EN', 'JP', 'FOIL'))[1] AS code FROM (VALUES {_OCR}) AS t(id, s)")
def set_code_extract(spark, d):
    return inline(spark, _OCR, "id, s").select(F.col("id").cast("bigint").alias("id"), text.set_code(F.col("s")).alias("code"))


@query("mana_to_cmc", f"""WITH t AS (SELECT id, s, regexp_extract_all(upper(s), '\\{{([^}}]*)\\}}', 1) AS b FROM (VALUES {_OCR}) AS t(id, s))
SELECT id::BIGINT AS id, nullif(CASE WHEN len(b) > 0 THEN coalesce(list_sum(list_transform(b, lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN x::BIGINT WHEN contains(x, '/') THEN 1 WHEN regexp_full_match(x, '[WUBRGXC]') THEN 1 ELSE 0 END)), 0)
ELSE coalesce(list_sum(list_transform(regexp_extract_all(s, '[0-9]'), lambda x: x::BIGINT)), 0) + length(regexp_replace(upper(s), '[^WUBRG]', '', 'g')) END, 0)::DOUBLE AS cmc FROM t""")
def mana_to_cmc(spark, d):
    return inline(spark, _OCR, "id, s").select(F.col("id").cast("bigint").alias("id"), text.mana_cost(F.col("s")).cast("double").alias("cmc"))


@query("ocr_candidate_pick", """WITH t AS (SELECT doc_id % 50 AS grp, doc_id, left(text, 40) AS s FROM documents), u AS (SELECT grp, doc_id, length(regexp_replace(s, '[^A-Za-z]', '', 'g')) AS l, length(regexp_replace(s, '[^A-Za-z]', '', 'g')) / greatest(length(s), 1) AS r FROM t)
SELECT grp, doc_id, l::BIGINT AS letters FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY r DESC, l DESC, doc_id) AS n FROM u WHERE l >= 4 AND r >= 0.4) WHERE n = 1""")
def ocr_candidate_pick(spark, d):
    t = read(spark, d, "documents").select((F.col("doc_id") % 50).alias("grp"), "doc_id", F.substring("text", 1, 40).alias("s"))
    return resolve.best_readings(t, "grp", "s", "doc_id").select("grp", "doc_id", "letters")


@query("sanitize_filename", """SELECT id::BIGINT AS id, coalesce(nullif(trim(regexp_replace(s, '[<>:"/\\\\|?*]', '_', 'g')), ''), 'unnamed_file') AS file FROM (VALUES (1, 'a<b>:c'), (2, ''), (3, '  '), (4, 'x/y|z?*.jpg'), (5, 'plain.png')) AS t(id, s)""")
def sanitize_filename(spark, d):
    return inline(spark, "(1, 'a<b>:c'), (2, ''), (3, '  '), (4, 'x/y|z?*.jpg'), (5, 'plain.png')", "id, s").select(F.col("id").cast("bigint").alias("id"), values.safe_file_name(F.col("s")).alias("file"))


_URLS = "(1, 'https://h.example/drive/folders/1AbC-_9?x=1'), (2, 'abcdefghijklmnopqrstuvwxyz0123456'), (3, 'https://h.example/none'), (4, '')"


@query("folder_id_extract", f"SELECT id::BIGINT AS id, CASE WHEN regexp_full_match(s, '[A-Za-z0-9_-]{{33}}') THEN s ELSE nullif(regexp_extract(s, '/folders/([A-Za-z0-9_-]+)', 1), '') END AS folder FROM (VALUES {_URLS}) AS t(id, s)")
def folder_id_extract(spark, d):
    return inline(spark, _URLS, "id, s").select(F.col("id").cast("bigint").alias("id"), values.folder_id(F.col("s")).alias("folder"))


@query("url_parts", "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")
def url_parts(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"))


_COLOURS = "(1, 'W'), (2, 'B,G'), (3, 'WU'), (4, 'white/blue'), (5, 'Colorless'), (6, 'multi'), (7, ''), (8, 'purple'), (9, 'r|g;r'), (10, 'GX')"


@query("color_normalize", f"""WITH p AS (SELECT id, trim(unnest(string_split(regexp_replace(upper(s), '[/|;]', ',', 'g'), ','))) AS t FROM (VALUES {_COLOURS}) AS v(id, s)),
m AS (SELECT id, unnest(CASE WHEN t IN ('WHITE', 'BLUE', 'BLACK', 'RED', 'GREEN', 'COLORLESS', 'MULTI', 'MULTICOLOR') THEN [map {{'WHITE': 'W', 'BLUE': 'U', 'BLACK': 'B', 'RED': 'R', 'GREEN': 'G', 'COLORLESS': 'COLORLESS', 'MULTI': 'MULTI', 'MULTICOLOR': 'MULTI'}}[t]]
  WHEN regexp_full_match(t, '[WUBRG]+') THEN string_split(t, '') ELSE [] END) AS c FROM p)
SELECT v.id::BIGINT AS id, coalesce((SELECT string_agg(DISTINCT c, ',' ORDER BY c) FROM m WHERE m.id = v.id), '') AS colors FROM (VALUES {_COLOURS}) AS v(id, s)""")
def color_normalize(spark, d):
    return inline(spark, _COLOURS, "id, s").select(F.col("id").cast("bigint").alias("id"), F.array_join(values.colour_set(F.col("s")), ",").alias("colors"))


@query("cf_name_fuzzy", f"WITH {CARDS}, q AS (SELECT DISTINCT name AS said FROM c WHERE p_partkey < 40) SELECT DISTINCT said, name FROM q, c WHERE levenshtein(lower(said), lower(name)) <= greatest(2, least(4, length(said) // 6))")
def cf_name_fuzzy(spark, d):
    c = cards(spark, d)
    said = c.where("p_partkey < 40").select(F.lower("name").alias("_h")).distinct()
    most = F.greatest(F.lit(2), F.least(F.lit(4), F.floor(F.length("_h") / 6))).cast("int")
    pairs = metafilter.similar_names(said, c.select(F.lower("name").alias("_v")).distinct())
    return pairs.where(within(F.col("_h"), F.col("_v"), most)).select(F.col("_h").alias("said"), F.col("_v").alias("name"))


def _hinted(spark, d):
    c = cards(spark, d).withColumnsRenamed({"type": "type"}).withColumns({"color": F.lit(None).cast("string"), "number": F.col("product_id"), "subTypeName": F.col("type")})
    none = F.lit(None).cast("string")
    hints = spark.createDataFrame([(1, "small ring", None, None, None), (2, "smal rinq", 7, None, "STANDARD"), (3, None, 11, "Brand#2", None), (4, "no such thing", None, None, None), (5, None, 3, None, None)], "probe_id long, hint_name string, hint_cmc int, hint_set string, hint_type string")
    return c.crossJoin(F.broadcast(hints.withColumns({"hint_color": none, "hint_number": none, "hint_subtype": none})))


_CF = f"""WITH {CARDS}, q(probe_id, hn, hc, hs, ht) AS (VALUES (1, 'small ring', NULL, NULL, NULL), (2, 'smal rinq', 7, NULL, 'STANDARD'), (3, NULL, 11, 'Brand#2', NULL), (4, 'no such thing', NULL, NULL, NULL), (5, NULL, 3, NULL, NULL)),
x AS (SELECT *, coalesce(lower(name) = lower(hn), false) AS e, coalesce(levenshtein(lower(hn), lower(name)) <= greatest(2, least(4, length(hn) // 6)), false) AS f FROM c, q),
y AS (SELECT *, max(e::INT) OVER (PARTITION BY probe_id) = 1 AS any_e FROM x),
z AS (SELECT *, hn IS NULL OR (CASE WHEN any_e THEN e ELSE f END) AS a1, hc IS NULL OR abs(cmc - hc) <= CASE WHEN hs IS NOT NULL THEN 0 ELSE 1 END AS a2, hs IS NULL OR upper(set_code) = upper(hs) AS a3, ht IS NULL OR contains(lower(type), lower(ht)) AS a4 FROM y),
s AS (SELECT *, (CASE WHEN hn IS NOT NULL AND a1 THEN CASE WHEN any_e THEN 130 ELSE 100 END ELSE 0 END + CASE WHEN hc IS NOT NULL AND a1 AND a2 THEN 70 ELSE 0 END + CASE WHEN hs IS NOT NULL AND a1 AND a2 AND a3 THEN 80 ELSE 0 END
  + CASE WHEN ht IS NOT NULL AND a1 AND a2 AND a3 AND a4 THEN 15 ELSE 0 END)::BIGINT AS score, a1 AND a2 AND a3 AND a4 AS alive FROM z)"""


@query("cf_score_rollup", f"{_CF} SELECT probe_id::BIGINT AS probe_id, product_id, score, alive FROM s WHERE score > 0 OR alive")
def cf_score_rollup(spark, d):
    return metafilter.apply(_hinted(spark, d), fuzzy_ratio=False).where("score > 0 OR alive").select("probe_id", "product_id", F.col("score").cast("bigint").alias("score"), "alive")


@query("cf_diagnostics", f"{_CF} SELECT probe_id::BIGINT AS probe_id, ((any_value(hn) IS NOT NULL)::INT + (any_value(hc) IS NOT NULL)::INT + (any_value(hs) IS NOT NULL)::INT + (any_value(ht) IS NOT NULL)::INT)::BIGINT AS filters_used, count(*)::BIGINT AS input_count, count(CASE WHEN alive THEN 1 END)::BIGINT AS output_count FROM s GROUP BY probe_id")
def cf_diagnostics(spark, d):
    out = metafilter.diagnostics(metafilter.apply(_hinted(spark, d), fuzzy_ratio=False))
    return out.select("probe_id", F.col("filters_used").cast("bigint").alias("filters_used"), "input_count", "output_count")


@query("cf_cmc_tolerance", f"WITH {CARDS} SELECT product_id, abs(cmc - 7) <= 1 AS loose, cmc = 7 AS strict FROM c WHERE abs(cmc - 7) <= 3")
def cf_cmc_tolerance(spark, d):
    fits = lambda narrow: metafilter.cost_fits(F.col("cmc"), F.lit(7), F.lit(narrow))
    return cards(spark, d).where("abs(cmc - 7) <= 3").select("product_id", fits(False).alias("loose"), fits(True).alias("strict"))


_CODES = "('B#11'), (' b#2 '), ('B#3'), ('B#13'), ('B#1234'), ('B#12345'), ('BRAND'), ('B'), ('')"


@query("known_set_codes", f"WITH {CARDS} SELECT code FROM (VALUES {_CODES}) AS v(code) WHERE length(trim(code)) BETWEEN 2 AND 6 AND upper(trim(code)) IN (SELECT upper('b' || substr(set_code, 6)) FROM c)")
def known_set_codes(spark, d):
    c = cards(spark, d).withColumn("set_code", F.concat(F.lit(" b"), F.substring("set_code", 6, 10)))
    return resolve.known_codes(inline(spark, _CODES, "code"), c)


@query("stage1_semi", f"WITH {CARDS} SELECT vec_id, label FROM embeddings WHERE vec_id::VARCHAR IN (SELECT product_id FROM c WHERE type = 'PROMO')")
def stage1_semi(spark, d):
    applied = cards(spark, d).select(F.lit(1).alias("probe_id"), "product_id", (F.col("type") == "PROMO").alias("alive"))
    e = read(spark, d, "embeddings").select("vec_id", "label").withColumn("product_id", F.col("vec_id").cast("string"))
    return metafilter.prefilter(e, applied).select("vec_id", "label")


@query("enrich_left", f"""WITH {CARDS}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey DESC) AS n FROM c), m AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'red bolt' WHEN event_id % 3 = 1 THEN 'no part' ELSE 'small ring' END AS nm, 'old' AS set_code FROM events WHERE event_id < 300)
SELECT event_id, nm AS product_id, coalesce(r.set_code, m.set_code) AS set_code, r.cmc::DOUBLE AS cmc FROM m LEFT JOIN r ON r.name = m.nm AND r.n = 1""")
def enrich_left(spark, d):
    nm = F.when(F.col("event_id") % 3 == 0, "red bolt").when(F.col("event_id") % 3 == 1, "no part").otherwise("small ring")
    m = read(spark, d, "events").where("event_id < 300").select("event_id", nm.alias("product_id"), F.lit("old").alias("set_code"))
    c = cards(spark, d).select(F.col("name").alias("product_id"), "set_code", F.col("cmc").cast("double").alias("cmc"), "p_partkey")
    return resolve.enriched(m, c, ["set_code", "cmc"], "p_partkey").select("event_id", "product_id", "set_code", "cmc")


@query("post_filter_null_permissive", f"WITH {CARDS}, x AS (SELECT product_id, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN '' ELSE set_code END AS set_code FROM c) SELECT product_id FROM x WHERE coalesce(set_code, '') = '' OR upper(set_code) IN ('BRAND#1', 'BRAND#2')")
def post_filter_null_permissive(spark, d):
    code = F.when(F.col("p_partkey") % 5 == 0, None).when(F.col("p_partkey") % 5 == 1, "").otherwise(F.col("set_code"))
    return cards(spark, d).where(resolve.permissive(code, ["brand#1", "Brand#2"])).select("product_id")


_HINTS = "(1, 'given', 'found', true), (2, '', 'found', true), (3, NULL, 'found', false), (4, NULL, NULL, true), (5, '', '', true)"


@query("hint_merge", f"SELECT id::BIGINT AS id, coalesce(nullif(g, ''), nullif(CASE WHEN t THEN f END, '')) AS hint FROM (VALUES {_HINTS}) AS v(id, g, f, t)")
def hint_merge(spark, d):
    return inline(spark, _HINTS, "id, g, f, t").select(F.col("id").cast("bigint").alias("id"), resolve.merged_hint(F.col("g"), F.col("f"), F.col("t")).alias("hint"))


@query("resolve_names")
def resolve_names(spark, d):
    """Names with two letters swapped or one lost, resolved against the catalogue (rows only: the ratio isn't in SQL)."""
    c = cards(spark, d)
    said = c.where("p_partkey % 40 = 0").select("p_partkey", F.concat(F.substring("name", 1, 2), F.substring("name", 4, 100)).alias("said"))
    return resolve.resolve_names(said, c, "p_partkey", "said")


@query("resolve_names_exact", f"WITH {CARDS} SELECT p_partkey, name AS resolved FROM c WHERE p_partkey % 40 = 0 AND p_partkey % 80 <> 0")
def resolve_names_exact(spark, d):
    """Names in capitals, resolved; nonsense isn't."""
    c = cards(spark, d)
    said = F.when(F.col("p_partkey") % 80 == 0, "qqqq zzzz").otherwise(F.upper("name"))
    return resolve.resolve_names(c.where("p_partkey % 40 = 0").select("p_partkey", said.alias("said")), c, "p_partkey", "said")


@query("similar_words", f"""WITH {CARDS}, w AS (SELECT DISTINCT unnest(string_split(name, ' ')) AS w FROM c), t AS (SELECT DISTINCT substr(w, 2) AS t FROM w UNION SELECT w || 's' FROM w)
SELECT t AS token, w AS word FROM t, w WHERE length(t) >= 3 AND length(w) >= 3 AND (contains(w, t) OR contains(t, w) OR levenshtein(t, w) <= 2)
  AND len(list_intersect(list_transform(range(1, length(t) - 1), lambda k: substr(t, k, 3)), list_transform(range(1, length(w) - 1), lambda k: substr(w, k, 3)))) > 0""")
def similar_words(spark, d):
    """Words that lost their first letter or gained one, with the catalogue's words they may stand for."""
    words = cards(spark, d).select(F.explode(F.split("name", " ")).alias("_w")).distinct().where("length(_w) >= 3")
    every = cards(spark, d).select(F.explode(F.split("name", " ")).alias("_w")).distinct()
    tokens = every.select(F.expr("substring(_w, 2)").alias("_t")).union(every.select(F.concat("_w", F.lit("s")))).distinct().where("length(_t) >= 3")
    return resolve.similar_words(tokens, words).select(F.col("_t").alias("token"), F.col("_w").alias("word"))


@query("resolve_metadata", f"""WITH {CARDS}, q AS (SELECT p_partkey AS k, name AS resolved, set_code AS hs, cmc AS hc FROM c WHERE p_partkey % 20 = 0),
s AS (SELECT k, product_id, max(200 + CASE WHEN lower(c.set_code) = lower(hs) THEN 85 ELSE 0 END + CASE WHEN cmc = hc THEN 70 ELSE 0 END)::BIGINT AS score FROM q JOIN c ON lower(resolved) = lower(name) WHERE cmc = hc GROUP BY ALL), t AS (SELECT *, max(score) OVER (PARTITION BY k) AS top FROM s)
SELECT k, min(product_id) AS product_id, min(score) AS score FROM t WHERE score = top GROUP BY k HAVING count(*) = 1 AND min(score) >= 190""")
def resolve_metadata(spark, d):
    c = cards(spark, d).withColumn("number", F.lit(None).cast("string"))
    hints = c.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("k"), F.col("name").alias("resolved"), F.col("name").alias("raw_name"), F.lit("").alias("hint_number"), F.col("set_code").alias("hint_set"), F.col("cmc").alias("hint_cmc"))
    return resolve.resolve_metadata(hints, c, "k").select("k", "product_id", F.col("score").cast("bigint").alias("score"))


@query("resolve_rules")
def resolve_rules(spark, d):
    """Beginnings of documents resolved against whole short documents as descriptions (rows only)."""
    docs = read(spark, d, "documents").where("lang = 'en' AND n_chars BETWEEN 60 AND 400")
    catalogue = docs.select(F.col("doc_id").cast("string").alias("product_id"), F.col("text").alias("description"))
    return resolve.resolve_rules(docs.where("doc_id % 10 = 0").select("doc_id", F.expr("substring(text, 1, 200)").alias("said")), catalogue, "doc_id", "said")


@query("seq_ratio")
def seq_ratio_names(spark, d):
    """Similarity ratios of the catalogue's names with each other (rows only)."""
    names = cards(spark, d).select("name").distinct()
    return names.alias("a").crossJoin(names.alias("b")).select(F.col("a.name").alias("a"), F.col("b.name").alias("b")).withColumn("ratio", F.round(seq_ratio("a", "b"), 6))
