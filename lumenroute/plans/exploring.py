"""Queries on facets, samples and index upkeep."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranking
from ..sources import catalogue as source
from ..sources import sinks
from .registry import CARDS, cards, query, read


@query("facet_rarity", f"WITH {CARDS} SELECT rarity, count(*)::BIGINT AS n FROM c GROUP BY rarity")
def facet_rarity(spark, d):
    return cards(spark, d).groupBy("rarity").agg(F.count("*").alias("n")).orderBy("rarity")


@query("facet_foil", "SELECT DISTINCT event_type AS finish FROM events WHERE event_type IS NOT NULL")
def facet_foil(spark, d):
    return read(spark, d, "events").where("event_type IS NOT NULL").select(F.col("event_type").alias("finish")).distinct().orderBy("finish")


@query("facet_set_labels", "SELECT n_regionkey AS game_id, n_nationkey || ' - ' || n_name AS label FROM nation")
def facet_set_labels(spark, d):
    n = read(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name").distinct()
    return n.select(F.col("n_regionkey").alias("game_id"), F.concat(F.col("n_nationkey").cast("string"), F.lit(" - "), F.col("n_name")).alias("label")).orderBy("label")


@query("catalog_counts", "SELECT r_name AS game, count(*)::BIGINT AS cards FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def catalog_counts(spark, d):
    dims = read(spark, d, "nation").join(F.broadcast(read(spark, d, "region")), F.expr("r_regionkey = n_regionkey")).select("n_nationkey", "r_name")
    return read(spark, d, "customer").join(F.broadcast(dims), F.expr("n_nationkey = c_nationkey")).groupBy(F.col("r_name").alias("game")).agg(F.count("*").alias("cards"))


@query("games_with_tables", "SELECT r_regionkey::BIGINT AS id, r_name AS name, r_name AS display_name, 'cards_' || r_regionkey AS table_name FROM region WHERE lower(r_name) LIKE '%a%'")
def games_with_tables(spark, d):
    g = read(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name"))
    return source.with_tables(source.games(g, pattern="A")).select("id", "name", "display_name", "table_name")


@query("games_indexed", "SELECT r_regionkey::BIGINT AS id, r_name AS name FROM region WHERE r_regionkey IN (1, 3)")
def games_indexed(spark, d):
    g = read(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name"))
    files = spark.createDataFrame([("x/index_1.db",), ("x/index_3",), ("x/other_2.db",), ("x/index_99.db",)], "path string")
    return source.indexed_games(g, files)


@query("conform_catalogue", "SELECT p_partkey::VARCHAR AS product_id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'alt' END AS set_code, p_size::VARCHAR AS cmc, p_type AS type, p_retailprice::DOUBLE AS price FROM part")
def conform_catalogue(spark, d):
    raw = read(spark, d, "part").select(
        F.col("p_partkey").alias("UniqueID"), F.col("p_name").alias("card_name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("").alias("set_code"), F.lit("alt").alias("setCode"),
        F.col("p_size").alias("mana_value"), F.array("p_type").alias("types"), F.lit(0).alias("market_price"), F.col("p_retailprice").alias("Price"),
    )
    return source.priced(source.conform(raw)).select("product_id", "name", "set_code", "cmc", "type", "price")


@query("overlay_union", f"WITH {CARDS} SELECT product_id, name FROM c WHERE p_partkey < 10 UNION ALL VALUES ('x1', 'custom one'), ('x3', 'custom three')")
def overlay_union(spark, d):
    custom = spark.createDataFrame([("x1", "custom one", 7, None), ("x2", "custom two", 8, "other"), ("x3", "custom three", None, "MY game")], "product_id string, name string, game_id int, game_name string")
    base = source.conform(cards(spark, d).where("p_partkey < 10").drop("price"))
    return source.with_overlay(base, custom, 7, "My Game").select("product_id", "name")


@query("priority_sample", f"WITH {CARDS} SELECT product_id, name FROM c WHERE lower(name) LIKE '%bolt%' OR lower(name) LIKE '%ring%' ORDER BY CASE WHEN lower(name) LIKE '%bolt%' THEN 0 ELSE 1 END, name, p_partkey LIMIT 100")
def priority_sample(spark, d):
    bolt = F.lower("name").contains("bolt")
    return ranking.priority_first(cards(spark, d), bolt, F.lower("name").contains("ring"), "product_id", ["name", "p_partkey"], 100).select("product_id", "name")


@query("hash_sample", "SELECT p_partkey FROM part ORDER BY md5(p_partkey::VARCHAR), p_partkey LIMIT 50")
def hash_sample(spark, d):
    return read(spark, d, "part").orderBy(F.md5(F.col("p_partkey").cast("string").cast("binary")), "p_partkey").limit(50).select("p_partkey")


@query("index_incremental_anti", f"WITH {CARDS} SELECT product_id FROM c WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings)")
def index_incremental_anti(spark, d):
    index = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("product_id"))
    return source.new_only(cards(spark, d).withColumn("image_url", F.lit("u")), index).select("product_id")


@query("index_upsert", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label + 100 FROM embeddings WHERE vec_id % 50 = 0")
def index_upsert(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label")
    changed = e.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).cast("int").alias("label"), F.lit(2).alias("v"))
    stale = changed.select("vec_id", F.lit(-1).alias("label"), F.lit(1).alias("v"))
    added = e.where("vec_id % 50 = 0").select((F.col("vec_id") + 1_000_000).alias("vec_id"), (F.col("label") + 100).cast("int").alias("label"), F.lit(1).alias("v"))
    return sinks.upserted(e.withColumn("v", F.lit(0)), changed.unionAll(stale).unionAll(added), "vec_id", "v").select("vec_id", "label")


@query("fetch_list", "SELECT event_id::VARCHAR AS file_id FROM events WHERE event_id < 200 AND event_id % 4 <> 0")
def fetch_list(spark, d):
    e = read(spark, d, "events").where("event_id < 200")
    remote = e.select(F.col("event_id").cast("string").alias("file_id"), F.lit("a:b.jpg").alias("name"), F.when(F.col("event_id") % 8 != 0, F.col("event_id")).alias("length"))
    local = e.where("event_id % 4 = 0").select(F.concat(F.col("event_id").cast("string"), F.lit("_a_b.jpg")).alias("name"), F.col("event_id").alias("length"))
    return source.to_fetch(remote, local).select("file_id")


@query("results_flat", "SELECT event_id, event_type AS status, '{\"k\":' || (props::JSON ->> 'k') || '}' AS zz FROM events")
def results_flat(spark, d):
    e = read(spark, d, "events").select(F.from_json("props", "k int").alias("zz"), "event_id", F.col("event_type").alias("status"))
    return sinks.flat(e)


@query("recent_scans", "SELECT event_id AS scan_id, left('a very long name of twenty-six letters ' || event_id, 25) AS name, left(event_type || '-and-more', 12) AS set_name, '12345678' AS number, '' AS bin FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_scans(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("scan_id"), "ts", F.concat(F.lit("a very long name of twenty-six letters "), F.col("event_id").cast("string")).alias("name"), F.concat("event_type", F.lit("-and-more")).alias("set_name"), F.lit("123456789").alias("number"), F.lit(None).cast("string").alias("bin"))
    return sinks.recent(e).drop("ts")


@query("games_per_brand_rank", f"WITH {CARDS} SELECT set_code, product_id, n FROM (SELECT *, row_number() OVER (PARTITION BY set_code ORDER BY price DESC, p_partkey)::BIGINT AS n FROM c) WHERE n <= 3")
def games_per_brand_rank(spark, d):
    n = F.row_number().over(Window.partitionBy("set_code").orderBy(F.desc("price"), "p_partkey")).cast("bigint")
    return cards(spark, d).withColumn("n", n).where("n <= 3").select("set_code", "product_id", "n")
