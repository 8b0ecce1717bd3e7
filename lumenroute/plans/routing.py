"""Queries on bins and trays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import image, routing
from ..streaming import gate
from .registry import CARDS, cards, inline, query, read

_COLOUR = "(1, 'Creature', 'Elf', 'G'), (2, 'Basic Land', 'Forest', ''), (3, 'Land', 'Mutavault', NULL), (4, 'Instant', 'Trophy', 'B,G'), (5, NULL, 'Ring', NULL), (6, 'Artifact', 'Ring', ''), (7, 'Sorcery', 'X', 'WU')"


@query("bin_color", f"SELECT id::BIGINT AS id, CASE WHEN contains(lower(coalesce(ty, '')), 'land') THEN CASE WHEN lower(n) IN ('plains', 'island', 'swamp', 'mountain', 'forest', 'wastes') THEN 'Basic land' ELSE 'Nonbasic land' END ELSE coalesce(nullif(c, ''), 'Colorless') END AS bin FROM (VALUES {_COLOUR}) AS v(id, ty, n, c)")
def bin_color(spark, d):
    return inline(spark, _COLOUR, "id, type, name, color").select(F.col("id").cast("bigint").alias("id"), routing.route("color").alias("bin"))


@query("bin_color_fixed", f"SELECT id::BIGINT AS id, CASE WHEN contains(lower(coalesce(ty, '')), 'land') THEN CASE WHEN lower(n) = 'forest' THEN 'Basic land' ELSE 'Nonbasic land' END WHEN coalesce(c, '') = '' THEN 'Colorless' WHEN length(c) > 1 THEN 'Multicolor' ELSE c END AS bin FROM (VALUES {_COLOUR}) AS v(id, ty, n, c)")
def bin_color_fixed(spark, d):
    return inline(spark, _COLOUR, "id, type, name, color").select(F.col("id").cast("bigint").alias("id"), routing.route("color", fixed=True).alias("bin"))


@query("bin_mana", f"WITH {CARDS} SELECT product_id, CASE WHEN cmc <= 1 THEN 'One' WHEN cmc <= 8 THEN cmc::VARCHAR ELSE 'RejectCard' END AS bin FROM c")
def bin_mana(spark, d):
    return cards(spark, d).select("product_id", routing.route("mana_value").alias("bin"))


@query("bin_set", f"WITH {CARDS} SELECT product_id, CASE WHEN contains(lower(type), 'token') THEN 'token' ELSE lower(set_code) END AS bin FROM c")
def bin_set(spark, d):
    return cards(spark, d).select("product_id", routing.route("set").alias("bin"))


_TRAY = "CASE WHEN v IS NULL OR v = 0 THEN 'RejectCard' {extra} " + " ".join(f"WHEN v <= {b} THEN 'tray{t}'" for b, t in routing.PRICE_TRAYS) + " ELSE 'tray32' END"


@query("bin_price", f"SELECT event_id, {_TRAY.format(extra='')} AS bin FROM (SELECT event_id, value AS v FROM events)")
def bin_price(spark, d):
    return read(spark, d, "events").select("event_id", F.col("value").alias("price")).select("event_id", routing.route("price").alias("bin"))


@query("bin_buy", f"SELECT event_id, {_TRAY.format(extra='WHEN v > 10 THEN ' + chr(39) + 'RejectCard' + chr(39))} AS bin FROM (SELECT event_id, value AS v FROM events)")
def bin_buy(spark, d):
    return read(spark, d, "events").select("event_id", F.col("value").alias("price")).select("event_id", routing.route("buy", 10.0).alias("bin"))


_TYPES = "(1, 'Artifact Creature - Golem'), (2, 'Legendary Planeswalker'), (3, 'Basic Land'), (4, ''), (5, NULL), (6, 'Token Artifact'), (7, 'Battle - Siege'), (8, 'Scheme')"


@query("bin_type", f"SELECT id::BIGINT AS id, CASE {' '.join(f'WHEN contains(lower(s), {chr(39)}{t}{chr(39)}) THEN {chr(39)}{t}{chr(39)}' for t in routing.TYPES)} ELSE 'RejectCard' END AS bin FROM (VALUES {_TYPES}) AS v(id, s)")
def bin_type(spark, d):
    return inline(spark, _TYPES, "id, type").select(F.col("id").cast("bigint").alias("id"), routing.route("type").alias("bin"))


_NAMES = "(1, 'Lightning'), (2, '  bolt'), (3, '7th'), (4, ''), (5, '   '), (6, NULL), (7, '+2 Mace'), (8, 'élan')"


@query("bin_alpha", f"SELECT id::BIGINT AS id, CASE WHEN trim(coalesce(s, '')) = '' THEN 'RejectCard' WHEN regexp_matches(upper(left(trim(s), 1)), '\\p{{L}}') THEN upper(left(trim(s), 1)) ELSE '0-9' END AS bin FROM (VALUES {_NAMES}) AS v(id, s)")
def bin_alpha(spark, d):
    return inline(spark, _NAMES, "id, name").select(F.col("id").cast("bigint").alias("id"), routing.route("alpha").alias("bin"))


_RARITY = "(1, 'common'), (2, 'Uncommon'), (3, 'rare'), (4, 'Mythic Rare'), (5, 'mythic'), (6, 'M'), (7, NULL), (8, 'Promo'), (9, 'special'), (10, '')"


@query("bin_rarity", f"SELECT id::BIGINT AS id, CASE {' '.join(f'WHEN contains(lower(s), {chr(39)}{r}{chr(39)}) THEN {chr(39)}{r.capitalize()}{chr(39)}' for r in routing.RARITIES)} ELSE 'RejectCard' END AS bin FROM (VALUES {_RARITY}) AS v(id, s)")
def bin_rarity(spark, d):
    return inline(spark, _RARITY, "id, rarity").select(F.col("id").cast("bigint").alias("id"), routing.route("rarity").alias("bin"))


@query("bin_rarity_fixed", f"SELECT id::BIGINT AS id, CASE WHEN contains(lower(s), 'mythic') THEN 'Mythic' WHEN contains(lower(s), 'uncommon') THEN 'Uncommon' {' '.join(f'WHEN contains(lower(s), {chr(39)}{r}{chr(39)}) THEN {chr(39)}{r.capitalize()}{chr(39)}' for r in routing.RARITIES)} ELSE 'RejectCard' END AS bin FROM (VALUES {_RARITY}) AS v(id, s)")
def bin_rarity_fixed(spark, d):
    return inline(spark, _RARITY, "id, rarity").select(F.col("id").cast("bigint").alias("id"), routing.route("rarity", fixed=True).alias("bin"))


_FINISH = "(1, 'nonfoil', NULL), (2, 'foil', NULL), (3, 'normal,foil', NULL), (4, 'normal', NULL), (5, '', 'true'), (6, NULL, 'no'), (7, NULL, NULL), (8, 'etched', 'Foil')"


@query("bin_finish", f"""SELECT id::BIGINT AS id, CASE WHEN contains(coalesce(f, ''), 'foil') AND (contains(f, 'nonfoil') OR contains(f, 'normal')) THEN 'Both' WHEN contains(coalesce(f, ''), 'foil') THEN 'Foil'
WHEN contains(coalesce(f, ''), 'normal') THEN 'Nonfoil' WHEN lower(b) IN ('true', 'yes', 'foil') THEN 'Foil' ELSE 'Nonfoil' END AS bin FROM (VALUES {_FINISH}) AS v(id, f, b)""")
def bin_finish(spark, d):
    return inline(spark, _FINISH, "id, f, foil").withColumn("finishes", F.split("f", ",")).select(F.col("id").cast("bigint").alias("id"), routing.route("finish").alias("bin"))


_PRICES = "(1, '1.5', '1'), (2, '0', '0.7'), (3, NULL, '2'), (4, 'abc', '3'), (5, '-1', '-2'), (6, '', '4'), (7, '0', NULL)"


@query("price_pick", f"SELECT id::BIGINT AS id, CASE WHEN m IS NOT NULL AND m <> '' AND try_cast(m AS DOUBLE) IS NULL THEN NULL WHEN try_cast(m AS DOUBLE) > 0 THEN try_cast(m AS DOUBLE) WHEN try_cast(l AS DOUBLE) > 0 THEN try_cast(l AS DOUBLE) END AS price FROM (VALUES {_PRICES}) AS v(id, m, l)")
def price_pick(spark, d):
    return inline(spark, _PRICES, "id, m, l").select(F.col("id").cast("bigint").alias("id"), values.picked_price(F.col("m"), F.col("l")).alias("price"))


_RANGES = {"click": (1, 6), "view": (7, 13), "purchase": (14, 14), "signup": (15, 20)}
_FIRST = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {a}" for k, (a, _) in _RANGES.items()) + " END"
_LAST = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {b}" for k, (_, b) in _RANGES.items()) + " END"


@query("tray_alloc", f"""WITH r AS (SELECT event_id, event_type, {_FIRST} + (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 376 AS t, {_LAST} AS z FROM events)
SELECT event_id, event_type, CASE WHEN t <= z THEN t END::DOUBLE AS tray FROM r""")
def tray_alloc(spark, d):
    return routing.allocate(read(spark, d, "events"), "event_type", ["ts", "event_id"], _RANGES).select("event_id", "event_type", F.col("tray").cast("double").alias("tray"))


@query("tray_first_fit", """WITH p AS (SELECT event_id, event_type, ts, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 376 AS part FROM events),
q AS (SELECT event_type, part, row_number() OVER (ORDER BY min(ts), min(event_id)) AS tray FROM p GROUP BY event_type, part)
SELECT event_id, event_type, CASE WHEN tray <= 34 THEN tray END::DOUBLE AS tray FROM p JOIN q USING (event_type, part)""")
def tray_first_fit(spark, d):
    return routing.allocate_dynamic(read(spark, d, "events"), "event_type", ["ts", "event_id"]).select("event_id", "event_type", F.col("tray").cast("double").alias("tray"))


@query("every_nth", "SELECT user_id, event_id, n AS up_count FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS n FROM events) WHERE n % 10 = 0")
def every_nth(spark, d):
    return gate.every_nth(read(spark, d, "events"), "user_id", ["ts", "event_id"], 10).select("user_id", "event_id", "up_count")


@query("preset_crop", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN round_even((100 + doc_id % 900) * 0.08::DOUBLE, 0)::BIGINT ELSE -1 END AS x1, CASE WHEN doc_id % 5 = 0 THEN round_even((100 + doc_id % 900) * 0.92::DOUBLE, 0)::BIGINT ELSE -1 END AS x2 FROM documents""")
def preset_crop(spark, d):
    file = F.when(F.col("doc_id") % 5 == 0, "Tilted_Scan.jpg").otherwise("other.jpg")
    width = (F.col("doc_id") % 900 + 100).cast("int")
    rect = image.preset_crop(file, width, F.lit(1000))
    return read(spark, d, "documents").select("doc_id", F.coalesce(rect["x1"], F.lit(-1)).cast("bigint").alias("x1"), F.coalesce(rect["x2"], F.lit(-1)).cast("bigint").alias("x2"))


@query("crop_geometry", """WITH b AS (SELECT doc_id, 400 AS w, 600 AS h, doc_id % 90 AS x1, doc_id % 70 AS y1, 300 + doc_id % 100 AS x2, 500 + doc_id % 100 AS y2 FROM documents),
p AS (SELECT doc_id, w, h, greatest(x1 - 6, 0) AS x1, greatest(y1 - 6, 0) AS y1, least(x2 + 6, w - 1) AS x2, least(y2 + 6, h - 1) AS y2 FROM b)
SELECT doc_id, x1::BIGINT AS x1, y1::BIGINT AS y1, x2::BIGINT AS x2, y2::BIGINT AS y2, round((x2 - x1 + 1) * (y2 - y1 + 1) / (w * h)::DOUBLE, 9) AS kept, round((x2 - x1 + 1) / (y2 - y1 + 1)::DOUBLE, 6) AS aspect FROM p""")
def crop_geometry(spark, d):
    x = F.col("doc_id")
    rect = values.aspect_crop(F.lit(400), F.lit(600), x % 90, x % 70, x % 100 + 300, x % 100 + 500, 6)
    out = read(spark, d, "documents").select("doc_id", rect.alias("r"))
    return out.select("doc_id", *(F.col(f"r.{c}").cast("bigint").alias(c) for c in ("x1", "y1", "x2", "y2")), F.round("r.kept", 9).alias("kept"), F.round("r.aspect", 6).alias("aspect"))


@query("quality_norm", "SELECT event_id, round(0.7::DOUBLE * greatest(0, least(1, (event_id % 2000 - 120) / 1080.0::DOUBLE)) + 0.3::DOUBLE * greatest(0, least(1, (value / 1000 - 0.008::DOUBLE) / 0.172::DOUBLE)), 6) AS q FROM events")
def quality_norm(spark, d):
    return read(spark, d, "events").select("event_id", F.round(values.region_quality((F.col("event_id") % 2000).cast("double"), F.col("value") / 1000), 6).alias("q"))
