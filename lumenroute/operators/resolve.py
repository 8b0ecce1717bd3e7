"""Resolution of recognised names, metadata and rules texts against the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.similarity import grams, name_accepted, name_score, seq_ratio, within
from ..functions.values import as_int, first_truthy, truthy
from . import blocks, rules
from .ranking import accepted_by_margin, metadata_score


def resolve_names(raw: DataFrame, catalogue: DataFrame, key: str, said: str, name: str = "name") -> DataFrame:
    """(key, resolved): the catalogue name for each recognised text, or none.

    An exact name wins. Else names with a word that contains one of the text's
    four strongest words, or lies within two edits of it, are scored. Distinct
    words of both sides meet by an equi-join on their character 3-grams, then
    are verified; names follow by their words.
    """
    names = catalogue.select(F.col(name).alias("resolved")).where(truthy(F.trim("resolved")).isNotNull()).distinct()
    asked = raw.select(key, F.trim(said).alias("_raw")).where(F.length("_raw") >= 3).withColumn("_fixed", text.slips_fixed(F.col("_raw")))
    both = asked.select(key, "_raw", "_fixed", F.explode(F.array_distinct(F.array(F.lower("_raw"), F.lower("_fixed")))).alias("_v"))
    exact = both.join(names.withColumn("_v", F.lower("resolved")), "_v").groupBy(key).agg(F.min("resolved").alias("resolved"))
    left = asked.join(exact, key, "left_anti")
    tokens = left.withColumn("_t", F.explode(text.strongest_tokens(F.concat_ws(" ", "_raw", "_fixed"), 3, 4)))
    words = names.withColumn("_w", F.explode(text.strongest_tokens(F.col("resolved"), 3, 100)))
    alike = similar_words(tokens.select("_t").distinct(), words.select("_w").distinct())
    pairs = tokens.join(alike, "_t").join(words, "_w").select(key, "_raw", "_fixed", "resolved").distinct()
    scored = pairs.withColumn("_s", name_score("_raw", "_fixed", "resolved"))
    order = Window.partitionBy(key).orderBy(*(F.col(f"_s.{c}").desc() for c in ("ratio", "fuzzy", "overlap", "prefix", "gap")), "resolved")
    fuzzy = scored.withColumn("_n", F.row_number().over(order)).where((F.col("_n") == 1) & name_accepted(F.col("_s"))).select(key, "resolved")
    return exact.unionByName(fuzzy)


def exact_names(catalogue: DataFrame, said: str, name: str = "name") -> DataFrame:
    """The catalogue rows of a name, in any case."""
    return catalogue.where(F.lower(name) == said.strip().lower())


def names_with(catalogue: DataFrame, token: str, most: int = 80, name: str = "name") -> DataFrame:
    """The first ``most`` distinct names that contain a token."""
    return catalogue.where(F.lower(name).contains(token.lower())).select(name).distinct().orderBy(name).limit(most)


def shared_words(asked: DataFrame, catalogue: DataFrame, key: str, said: str, name: str = "name") -> DataFrame:
    """(key, name, shared): the distinct names that share words with a text, and how many."""
    words = lambda c: F.explode(F.array_distinct(F.split(F.lower(c), " "))).alias("_w")
    names = catalogue.select(name).distinct().select(F.col(name).alias("_name"), words(name))
    return asked.select(key, words(said)).join(names, "_w").groupBy(key, F.col("_name").alias(name)).agg(F.countDistinct("_w").alias("shared"))


def best_readings(readings: DataFrame, group: str, said: str, tie: str) -> DataFrame:
    """The best of several readings of a title, with its number of letters.

    Readings of under four letters, of fewer letters than two in five, or of
    over 160 characters don't count; the purest, then the longest is best.
    """
    letters = F.length(F.regexp_replace(said, "[^A-Za-z]", ""))
    rated = readings.withColumn("letters", letters.cast("bigint")).withColumn("_pure", letters / F.greatest(F.length(said), F.lit(1)))
    order = Window.partitionBy(group).orderBy(F.desc("_pure"), F.desc("letters"), tie)
    fair = rated.where((F.col("letters") >= 4) & (F.col("_pure") >= 0.4) & (F.length(said) <= 160))
    return fair.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_pure")


def similar_words(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(_t, _w): words that contain a token or lie in it, and those that share a 3-gram with it and lie within two edits."""
    a = tokens.select("_t", F.explode(grams(F.col("_t"), pad="")).alias("_g"))
    b = words.select("_w", F.explode(grams(F.col("_w"), pad="")).alias("_g"))
    verified = F.col("_w").contains(F.col("_t")) | F.col("_t").contains(F.col("_w")) | within(F.col("_w"), F.col("_t"), 2)
    return a.join(b, "_g").select("_t", "_w").distinct().where(verified)


def resolve_metadata(hints: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """(key, product_id, score): the one catalogue row on which the hints agree best, if it is strong and alone at the top.

    hints: key, resolved, raw_name, hint_number, hint_set, hint_cmc. An
    unequal cost drops a row; one that is unknown or no number doesn't.
    """
    # rows that no hint can tell apart are one, with the least and greatest id; a row meets the hints of its cost, of none and of an unknown one by keys
    alike = catalogue.where(F.col("product_id").isNotNull() & F.col("name").isNotNull()).groupBy(F.lower("name").alias("name"), F.lower("number").alias("number"), F.lower("set_code").alias("set_code"), "cmc").agg(F.min("product_id").alias("_low"), F.max("product_id").alias("_high"))
    theirs, ours = (F.coalesce(as_int(F.col(c)).cast("string"), F.lit("unknown")) for c in ("cmc", "hint_cmc"))
    left = hints.withColumn("_name", F.lower("resolved")).withColumn("_cost", F.explode(F.when(ours == "unknown", F.array(F.lit("any"))).otherwise(F.array(ours, F.lit("unknown")))))
    right = alike.withColumn("_name", F.col("name")).withColumn("_cost", F.explode(F.array(theirs, F.lit("any"))))
    rows = left.join(right, ["_name", "_cost"])
    score = metadata_score(F.col("name"), F.col("resolved"), F.col("raw_name"), F.col("number"), F.col("hint_number"), F.col("set_code"), F.col("hint_set"), F.col("cmc"), F.col("hint_cmc"))
    strict = F.when(truthy(F.col("hint_number")).isNotNull() & truthy(F.col("hint_set")).isNotNull(), 170).otherwise(190)
    scored = rows.select(key, score.alias("score"), strict.alias("_least"), "_low", "_high")
    best = scored.groupBy(key).agg(F.max(F.struct("score", "_high")).alias("_a"), F.min(F.struct((-F.col("score")).alias("score"), F.col("_low").alias("_low"))).alias("_b"), F.max("_least").alias("_least"))
    return best.where("_a._high = _b._low AND _a.score >= _least").select(key, F.col("_a._high").alias("product_id"), F.col("_a.score").alias("score"))


def resolve_rules(said: DataFrame, catalogue: DataFrame, key: str, column: str) -> DataFrame:
    """(key, product_id, score) by rules text; candidates share one of the text's six strongest words of four letters.

    A text of fewer than 40 letters and spaces gives none. Only the best score and
    one near it decide, so that pairs which can't reach these, by a bound, aren't scored.
    """
    asked = said.select(key, text.rules_normalised(F.col(column)).alias("_q")).where(F.length("_q") >= 40)
    rows = catalogue.where(F.col("description").isNotNull()).select("product_id", text.rules_normalised(F.col("description")).alias("_d"))
    rare = F.array_except(F.regexp_extract_all("_q", F.lit("([a-z]{4,})"), 1), F.array(*(F.lit(w) for w in sorted(text.COMMON_RULES))))
    strongest = F.slice(F.transform(F.array_sort(F.transform(F.array_distinct(rare), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda s: s["w"]), 1, 6)
    kind = {"_k": said.schema[key].dataType.simpleString(), "product_id": catalogue.schema["product_id"].dataType.simpleString()}
    asked = asked.select(F.col(key).alias("_k"), "_q", strongest.alias("_t")).where(F.size("_t") > 0).distinct()
    scored = blocks.compared(asked, rows, rules.Asked, rules.Described, rules.compare, rules.result, f"_k {kind['_k']}, product_id {kind['product_id']}, score double", alone=128)
    return accepted_by_margin(scored, "_k", "score", "product_id").select(F.col("_k").alias(key), "product_id", "score")


def merged_hint(given: Column, found: Column, trusted: Column | None = None) -> Column:
    """A caller's hint, else a recognised one, if it can be trusted."""
    return first_truthy(given, found if trusted is None else F.when(trusted, found))


def hints_from_text(found: DataFrame, catalogue: DataFrame, only_sets: tuple[str, ...] = ()) -> DataFrame:
    """found with the hints that a caller gave or that can be trusted.

    found: hint_name, hint_set, hint_number, hint_color and hint_cmc as given,
    and read_name, read_set, read_number, read_color and read_cmc as recognised.
    A caller's hint wins. A set that was read counts only if the catalogue has
    it and a name or number was read with it; where results may be of one set
    only, that is the hint. A cost that was read, from circles in the picture,
    counts only with other evidence.
    """
    known = catalogue.select(F.upper(F.trim("set_code")).alias("_code")).where(F.length("_code").between(2, 6)).distinct().withColumn("_known", F.lit(True))
    rows = found.withColumn("_code", F.upper(F.trim("read_set"))).join(known, "_code", "left")
    read = {c: truthy(F.trim(F.col(f"read_{c}").cast("string"))).isNotNull() for c in ("name", "number", "color")}
    set_hint = merged_hint(F.col("hint_set"), F.col("_code"), F.coalesce("_known", F.lit(False)) & (read["name"] | read["number"]))
    if len(only_sets) == 1:
        set_hint = F.coalesce(truthy(F.col("hint_set")), F.lit(only_sets[0]))
    evidence = read["name"] | read["number"] | F.coalesce(F.col("_known"), F.lit(False))
    return rows.withColumns({
        "hint_name": merged_hint(F.col("hint_name"), F.col("read_name")), "hint_set": set_hint, "hint_number": merged_hint(F.col("hint_number"), F.col("read_number")),
        "hint_color": merged_hint(F.col("hint_color"), F.col("read_color")), "hint_cmc": F.coalesce(F.col("hint_cmc"), F.when(evidence, F.col("read_cmc"))),
    }).drop("_code", "_known", *(f"read_{c}" for c in ("name", "set", "number", "color", "cmc")))


def set_codes(chosen: DataFrame, sets: DataFrame, column: str = "chosen") -> DataFrame:
    """(code): the codes of chosen sets, given by the id of the table of sets (id, code); what is no integer is a code already."""
    asked = chosen.select(F.trim(F.col(column).cast("string")).alias("_c")).where(truthy(F.col("_c")).isNotNull()).withColumn("_id", F.col("_c").try_cast("bigint"))
    by_id = asked.join(sets.select(F.col("id").alias("_id"), "code"), "_id").select(F.upper(F.trim("code")).alias("code"))
    return by_id.unionAll(asked.where("_id IS NULL").select(F.upper("_c").alias("code"))).where(F.length("code") > 0).distinct()


def known_codes(codes: DataFrame, catalogue: DataFrame, column: str = "code") -> DataFrame:
    """Codes of 2 to 6 characters that the catalogue has."""
    known = catalogue.select(F.upper(F.trim("set_code")).alias("_known")).distinct()
    return codes.where(F.length(F.trim(column)).between(2, 6)).join(known, F.upper(F.trim(column)) == F.col("_known"), "left_semi")


def enriched(matches: DataFrame, catalogue: DataFrame, columns: list[str], order: str) -> DataFrame:
    """matches with the catalogue's values where they are truthy; of repeated ids the last row by ``order`` counts."""
    w = Window.partitionBy("product_id").orderBy(F.col(order).desc_nulls_last())
    right = catalogue.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("product_id", *(F.col(c).alias(f"_{c}") for c in columns))
    joined = matches.join(right, "product_id", "left")
    for c in columns:
        theirs = truthy(F.col(f"_{c}")) if dict(catalogue.dtypes)[c] == "string" else F.nullif(F.col(f"_{c}"), F.lit(0))
        joined = joined.withColumn(c, F.coalesce(theirs, F.col(c)) if c in matches.columns else theirs)
    return joined.drop(*(f"_{c}" for c in columns))


def permissive(value: Column, allowed: list[str] | str | None, ignore_case: bool = True) -> Column:
    """Whether a value is allowed; without a list, and for null or empty values, it is."""
    if not allowed:
        return F.lit(True)
    allowed = [allowed] if isinstance(allowed, str) else list(allowed)
    test = F.upper(value).isin(*(a.upper() for a in allowed)) if ignore_case else value.isin(*allowed)
    return truthy(value).isNull() | test
