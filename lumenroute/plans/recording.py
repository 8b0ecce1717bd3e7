"""Queries on the ledger, batch results, review, stability and telemetry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values
from ..operators import ledger
from ..streaming import gate
from .registry import inline, query, read

_LEDGER = """l AS (SELECT l_orderkey, l_linenumber, l_partkey::VARCHAR AS product_id, l_quantity::BIGINT AS quantity, p_name AS name, p_brand AS set_code, r_name AS game,
  CASE l_linenumber % 4 WHEN 0 THEN 'Near Mint' WHEN 1 THEN 'PSA 9.5' WHEN 2 THEN 'Damaged' ELSE 'odd' END AS condition, CASE l_returnflag WHEN 'A' THEN 'EN' WHEN 'N' THEN 'DE' ELSE 'XX' END AS language, l_linestatus = 'F' AS is_foil
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE l_orderkey < 2000),
k AS (SELECT *, product_id || '_' || CASE condition WHEN 'Near Mint' THEN 'NM' WHEN 'PSA 9.5' THEN '9' WHEN 'Damaged' THEN 'DMG' ELSE 'NM' END || '_' || language || '_' || CASE WHEN is_foil THEN 'F' ELSE 'N' END AS sku FROM l)"""


def entries(spark, d):
    """Line items as ledger entries."""
    n = F.col("l_linenumber") % 4
    dims = read(spark, d, "supplier").join(F.broadcast(read(spark, d, "nation")), F.expr("n_nationkey = s_nationkey")).join(F.broadcast(read(spark, d, "region")), F.expr("r_regionkey = n_regionkey")).select("s_suppkey", "r_name")
    rows = read(spark, d, "lineitem").where("l_orderkey < 2000").join(read(spark, d, "part"), F.expr("p_partkey = l_partkey")).join(dims, F.expr("s_suppkey = l_suppkey"))
    out = rows.select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("product_id"), F.col("l_quantity").cast("bigint").alias("quantity"), F.col("p_name").alias("name"), F.col("p_brand").alias("set_code"), F.col("r_name").alias("game"),
        F.when(n == 0, "Near Mint").when(n == 1, "PSA 9.5").when(n == 2, "Damaged").otherwise("odd").alias("condition"),
        F.when(F.col("l_returnflag") == "A", "EN").when(F.col("l_returnflag") == "N", "DE").otherwise("XX").alias("language"), (F.col("l_linestatus") == "F").alias("is_foil"),
    )
    return out.withColumn("sku", ledger.sku(F.col("product_id"), F.col("condition"), F.col("language"), F.col("is_foil")))


@query("sku_build", f"WITH {_LEDGER} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, sku FROM k")
def sku_build(spark, d):
    return entries(spark, d).select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "sku")


@query("export_sku", f"""WITH {_LEDGER} SELECT quantity AS "Quantity", sku AS "SKU" FROM k WHERE game = 'ASIA'""")
def export_sku(spark, d):
    return ledger.export_quantities(entries(spark, d).where("game = 'ASIA'"))


@query("export_player", f"""WITH {_LEDGER} SELECT quantity AS "Quantity", name AS "Name", set_code AS "Set Code", CASE WHEN is_foil THEN 'Foil' ELSE 'Normal' END AS "Printing", condition AS "Condition", CASE language WHEN 'EN' THEN 'English' WHEN 'DE' THEN 'German' ELSE language END AS "Language" FROM k""")
def export_player(spark, d):
    return ledger.export_players(entries(spark, d))


@query("ledger_by_game", f"WITH {_LEDGER} SELECT game, count(*)::BIGINT AS cards FROM k GROUP BY game")
def ledger_by_game(spark, d):
    return ledger.by_game(entries(spark, d))


@query("unique_sku", f"WITH {_LEDGER} SELECT count(DISTINCT nullif(sku, ''))::BIGINT AS skus FROM k")
def unique_sku(spark, d):
    return entries(spark, d).agg(F.countDistinct(values.truthy(F.col("sku"))).alias("skus"))


@query("batch_stats", "SELECT count(*)::BIGINT AS total_files, count(CASE WHEN event_type <> 'error' THEN 1 END)::BIGINT AS successful_scans, count(CASE WHEN event_type = 'purchase' THEN 1 END)::BIGINT AS matches_found, count(CASE WHEN event_type = 'error' THEN 1 END)::BIGINT AS failed_scans, count(CASE WHEN user_id % 2 = 0 THEN 1 END)::BIGINT AS reused_local_files, round(avg(value), 6) AS avg_time_per_scan FROM events")
def batch_stats(spark, d):
    e = read(spark, d, "events").select(F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"), (F.col("event_type") == "purchase").alias("match_found"), (F.col("user_id") % 2 == 0).alias("reused"), F.col("value").alias("seconds"))
    return ledger.batch_stats(e).withColumn("avg_time_per_scan", F.round("avg_time_per_scan", 6))


@query("review_queue", """WITH x AS (SELECT event_id, value AS confidence, CASE WHEN event_type = 'click' THEN 'ocr_resolved_x' ELSE 'scanner_match' END AS src, CASE WHEN event_id % 9 = 0 THEN NULL ELSE (event_id % 10) / 10.0::DOUBLE END AS agreement FROM events),
y AS (SELECT event_id, list_filter([CASE WHEN confidence < 75 THEN 'low_confidence' END, CASE WHEN starts_with(src, 'ocr_') THEN 'ocr_override_applied' END, CASE WHEN agreement < 0.6::DOUBLE THEN 'scanner_ocr_disagreement' END], lambda r: r IS NOT NULL) AS r FROM x)
SELECT event_id, array_to_string(r, ';') AS review_reasons FROM y WHERE len(r) > 0""")
def review_queue(spark, d):
    source = F.when(F.col("event_type") == "click", "ocr_resolved_x").otherwise("scanner_match")
    agreement = F.when(F.col("event_id") % 9 != 0, F.col("event_id") % 10 / F.lit(10.0))
    return read(spark, d, "events").select("event_id", ledger.review_reasons(F.col("value"), source, agreement).alias("review_reasons")).where("review_reasons IS NOT NULL")


_RECON = "(1, 'Bolt', 'Bo1t', 'Bolt', 60.0, 0.9), (2, NULL, 'x', 'Ring', 0.0, NULL), (3, '', 'x', NULL, NULL, NULL), (4, 'Bolt', 'Sea', 'Seeker', 60.0, 0.2), (5, 'Bolt', 'Sea', NULL, 60.0, 0.2), (6, 'Bolt', NULL, NULL, 10.0, NULL), (7, 'Bolt', 'Sea', 'Seeker', 80.0, 0.2)"


@query("name_reconcile", f"""WITH v AS (SELECT id, nullif(m, '') AS m, t, r, coalesce(c, 0) AS c, a FROM (VALUES {_RECON}) AS v(id, m, t, r, c, a))
SELECT id::BIGINT AS id, CASE WHEN t IS NULL THEN m WHEN m IS NULL THEN coalesce(r, t) WHEN c < 75 AND a < 0.55 AND r IS NOT NULL THEN r ELSE m END AS card_name,
CASE WHEN t IS NULL THEN 'scanner_match' WHEN m IS NULL AND r IS NOT NULL THEN 'ocr_resolved_no_match_name' WHEN m IS NULL THEN 'ocr_top_band_no_match_name' WHEN c < 75 AND a < 0.55 AND r IS NOT NULL THEN 'ocr_resolved_override_low_confidence' ELSE 'scanner_match' END AS name_source FROM v""")
def name_reconcile(spark, d):
    name, source = ledger.reconciled(F.col("m"), F.col("t"), F.col("r"), F.col("c").cast("double"), F.col("a").cast("double"))
    return inline(spark, _RECON, "id, m, t, r, c, a").select(F.col("id").cast("bigint").alias("id"), name.alias("card_name"), source.alias("name_source"))


@query("first_seen", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def first_seen(spark, d):
    return ledger.first_seen(read(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("inventory_anti", "SELECT event_id FROM events e WHERE event_id >= 300 AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_id < 300 AND o.user_id = e.user_id AND o.event_type = e.event_type)")
def inventory_anti(spark, d):
    e = read(spark, d, "events")
    return ledger.unseen(e.where("event_id >= 300"), e.where("event_id < 300"), ["user_id", "event_type"]).select("event_id")


@query("running_avg", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9) AS mean FROM events")
def running_avg(spark, d):
    return gate.running_mean(read(spark, d, "events"), "user_id", "value", ["ts", "event_id"]).select("event_id", F.round("mean", 9).alias("mean"))


@query("state_change", "SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def state_change(spark, d):
    return gate.state_changes(read(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "event_type")


_FRAMES = "(1, '<Sensors,xmin=1,xmax=0,home=1>'), (2, '<OK>'), (3, 'noise'), (4, '<Params,speed=250,accel=90>')"


@query("telemetry_parse", """SELECT id::BIGINT AS id, k, v FROM (VALUES (1, 'xmin', '1'), (1, 'xmax', '0'), (1, 'home', '1'), (4, 'speed', '250'), (4, 'accel', '90')) AS t(id, k, v)""")
def telemetry_parse(spark, d):
    return inline(spark, _FRAMES, "id, frame").select(F.col("id").cast("bigint").alias("id"), F.explode(values.telemetry(F.col("frame"))).alias("k", "v"))


@query("json_props", "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def json_props(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("session_hms", "SELECT event_id, (s // 3600)::VARCHAR || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS elapsed FROM (SELECT event_id, floor(value * 60)::BIGINT AS s FROM events)")
def session_hms(spark, d):
    return read(spark, d, "events").select("event_id", values.hms(F.floor(F.col("value") * 60)).alias("elapsed"))


_KEYS = "(1, '12', 'Bolt', 'M10', '1'), (2, '', ' Bolt ', 'M10', NULL), (3, NULL, '', 'x', '1'), (4, NULL, NULL, NULL, NULL), (5, ' 7 ', NULL, NULL, NULL)"


@query("stability_key", f"SELECT id::BIGINT AS id, CASE WHEN trim(coalesce(p, '')) <> '' THEN 'pid:' || trim(p) WHEN trim(coalesce(n, '')) <> '' THEN 'name:' || lower(trim(n)) || '|set:' || lower(trim(coalesce(s, ''))) || '|num:' || lower(trim(coalesce(x, ''))) END AS key FROM (VALUES {_KEYS}) AS v(id, p, n, s, x)")
def stability_key(spark, d):
    return inline(spark, _KEYS, "id, p, n, s, x").select(F.col("id").cast("bigint").alias("id"), gate.stability_key(F.col("p"), F.col("n"), F.col("s"), F.col("x")).alias("key"))


@query("stability_runs", """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR lag(event_type) OVER w <> event_type OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 172800000000 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id)::BIGINT AS run_position, CASE WHEN event_type = 'error' OR value < 70 THEN 3 ELSE 2 END::BIGINT AS required FROM r""")
def stability_runs(spark, d):
    out = gate.runs(read(spark, d, "events"), "user_id", "event_type", "ts", "event_id", 172_800.0)
    required = gate.required_confirmations(F.when(F.col("event_type") == "error", "no_match_at_strict_threshold"), F.col("value") < 70)
    return out.select("event_id", F.col("run_position").cast("bigint").alias("run_position"), required.cast("bigint").alias("required"))


_ACCEPT = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, epoch_us(ts) / 1000000.0::DOUBLE AS now, CASE WHEN event_type = 'error' OR value < 70 THEN 3 ELSE 2 END AS required FROM events WHERE user_id < 40),
f AS (SELECT user_id, n, event_id, event_type, now, 1 AS count, NULL::VARCHAR AS akey, -1e18::DOUBLE AS since, false AS accepted FROM e WHERE n = 1
UNION ALL SELECT user_id, n, event_id, event_type, now, count, CASE WHEN ok THEN event_type ELSE akey END, CASE WHEN ok THEN now ELSE since END, ok FROM (
  SELECT *, NOT coalesce(event_type = akey AND now - since < 259200, false) AND count >= required AS ok FROM (
    SELECT e.user_id, e.n, e.event_id, e.event_type, e.now, e.required, f.akey, f.since, CASE WHEN e.event_type = f.event_type AND e.now - f.now <= 172800 THEN f.count + 1 ELSE 1 END AS count FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)))
SELECT event_id, count::BIGINT AS count, accepted FROM f"""


@query("stability_accept", _ACCEPT)
def stability_accept(spark, d):
    required = gate.required_confirmations(F.when(F.col("event_type") == "error", "no_match_at_strict_threshold"), F.col("value") < 70)
    obs = read(spark, d, "events").where("user_id < 40").select(F.col("event_id").alias("obs_id"), F.col("user_id").cast("string").alias("camera"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"), required.alias("required"), F.lit(False).alias("manual"))
    return gate.fold(obs, 172_800.0, 259_200.0).select(F.col("obs_id").alias("event_id"), F.col("count").cast("bigint").alias("count"), "accepted")
