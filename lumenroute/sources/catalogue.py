"""Reading catalogues, overlays, indexes, images and telemetry into canonical tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import as_price

IMAGE_SUFFIXES = tuple(".jpg .jpeg .png .bmp .webp .tiff".split())


@dataclass(frozen=True)
class Spec:
    """A canonical column: its type, and the source columns it may come from, in order."""

    name: str
    kind: str
    sources: tuple[str, ...]


def spec(name: str, kind: str, *others: str) -> Spec:
    return Spec(name, kind, (name, *others))


CATALOGUE = (
    spec("product_id", "string", "UniqueID"), spec("name", "string", "card_name", "Name"), spec("color", "string", "colors", "color_identity"),
    spec("cmc", "string", "converted_cost", "mana_value", "convertedManaCost"), spec("set_code", "string", "set", "setCode"), spec("set_name", "string", "setName"),
    spec("number", "string", "collector_number", "cardNumber", "extNumber"), spec("type", "string", "card_type", "full_type", "types"), spec("subTypeName", "string", "subtype"),
    spec("rarity", "string", "Rarity", "extRarity"), spec("market_price", "string", "price", "Price"), spec("low_price", "string"), spec("description", "string"),
    spec("image_url", "string", "imageUrl", "image", "img_url"), spec("game", "string", "Game"), spec("game_id", "bigint"),
    spec("r_phash", "string"), spec("g_phash", "string"), spec("b_phash", "string"), spec("grayscale_phash", "string"),
)


def conform(df: DataFrame, columns: tuple[Spec, ...] = CATALOGUE, by_value: bool = True) -> DataFrame:
    """The canonical columns: the first source that is there, null where none is.

    With ``by_value``, the first source that isn't empty, row by row; else the
    first that exists decides for all rows.
    """
    have = {c.lower(): c for c in reversed(df.columns)}
    kinds = dict(df.dtypes)

    def one(s: Spec) -> Column:
        found = [have[c.lower()] for c in dict.fromkeys(x for x in s.sources) if c.lower() in have]
        texts = [(F.array_join(F.col(f"`{c}`"), ",") if kinds[c].startswith("array") else F.col(f"`{c}`").cast("string")) for c in dict.fromkeys(found)]
        if not texts:
            value = F.lit(None)
        elif not by_value:
            value = texts[0]
        else:
            empty = ("", "0", "0.0") if s.name.endswith("price") else ("",)
            value = F.coalesce(*(F.when(~t.isin(*empty), t) for t in texts))
        return value.try_cast(s.kind).alias(s.name)

    return df.select(*(one(s) for s in columns))


def games(rows: DataFrame, loaded_only: bool = False, pattern: str | None = None) -> DataFrame:
    """The games with a display name; those to load, or whose name holds a pattern, on request."""
    out = rows.withColumn("display_name", F.coalesce("display_name", "name") if "display_name" in rows.columns else F.col("name"))
    if loaded_only and "load" in rows.columns:
        out = out.where("load = 1")
    if pattern is not None:
        out = out.where(F.lower("name").contains(pattern.lower()) | F.lower("display_name").contains(pattern.lower()))
        if out.isEmpty():
            raise ValueError(f"no game matches {pattern!r}")
    return out


def with_tables(game_rows: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """The table of each game by the mapping, which drops games it lacks; without one, by the id."""
    if mapping is None:
        return game_rows.withColumn("table_name", F.concat(F.lit("cards_"), F.col("id").cast("string")))
    return game_rows.join(mapping.select(F.col("game_name").alias("name"), "table_name"), "name")


def indexed_games(game_rows: DataFrame, files: DataFrame, pattern: str = r"index_(\d+)") -> DataFrame:
    """Games that have an index file, by the number in its name."""
    ids = files.select(F.regexp_extract("path", pattern, 1).try_cast("bigint").alias("id")).where("id IS NOT NULL").distinct()
    return game_rows.join(ids, "id", "left_semi")


def index_files(spark: SparkSession, folder: str, pattern: str = "index_*") -> DataFrame:
    """(path) of the index files or folders in a folder, by a glob pattern."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return spark.createDataFrame([(x.getPath().toString(),) for x in found], "path string")


def metadata(catalogue: DataFrame, custom: DataFrame | None = None, game_id: int = 0, game: str = "") -> DataFrame:
    """The columns that hints are matched with, of rows that have a product id, with the overlay's items; to be persisted by a caller who reuses it."""
    rows = conform(catalogue)
    rows = rows if custom is None else with_overlay(rows, custom, game_id, game)
    return rows.where(F.col("product_id").isNotNull()).select("product_id", "name", "color", "cmc", "set_code", "number", "type", "subTypeName")


def preloaded(index: DataFrame) -> DataFrame:
    """The index rows that have hashes, kept in the executors' memory and disk for repeated scans."""
    return index.where(F.col("r_phash").isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)


def index_rows(index: DataFrame) -> DataFrame:
    """The columns of an index, in the canonical names, that are there; only those are read."""
    wanted = [x for x in CATALOGUE if x.name in ("product_id", "name", "number", "set_code", "rarity", "subTypeName", "market_price", "low_price", "game") or x.name.endswith("_phash")]
    return conform(index, tuple(wanted))


def sampled_mapping(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, game) by one row of each table, the first by its product id."""
    firsts = [conform(t).select(F.lit(name).alias("table_name"), "game", "product_id").orderBy("product_id").limit(1).select("table_name", "game") for name, t in sorted(tables.items())]
    return reduce(DataFrame.unionAll, firsts)


def counts_like(tables: dict[str, DataFrame], pattern: str) -> DataFrame:
    """(table_name, n): the rows of each table whose name holds a pattern, in any case; 0 where none does."""
    held = [conform(t).select(F.lit(name).alias("table_name"), F.coalesce(F.lower("name").contains(pattern.lower()), F.lit(False)).alias("hit")) for name, t in sorted(tables.items())]
    return reduce(DataFrame.unionAll, held).groupBy("table_name").agg(F.count_if("hit").alias("n"))


def overlay(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of custom items; a file whose top level is no list has none."""
    whole = spark.read.text(path, wholetext=True).where(F.col("value").rlike(r"^\s*\["))
    if whole.isEmpty():
        return spark.createDataFrame([], "product_id string, name string, game_id string, game string")
    return spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def with_overlay(catalogue: DataFrame, custom: DataFrame, game_id: int, game: str) -> DataFrame:
    """The catalogue of a game and the overlay's items of it, by id, or by name in any case."""
    have = set(custom.columns)
    mine = F.lit(False)
    if "game_id" in have:
        mine = mine | F.coalesce(F.col("game_id").cast("string") == str(game_id), F.lit(False))
    for column in ("game_name", "game"):
        if column in have:
            mine = mine | F.coalesce(F.lower(column) == game.lower(), F.lit(False))
    return catalogue.unionByName(conform(custom.where(mine)), allowMissingColumns=True)


def images(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, length, modificationTime, content) of image files by suffix, sorted by name; a missing folder is an error."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return read.load(folder).where(F.regexp_extract(F.lower("path"), r"(\.[a-z]+)$", 1).isin(*IMAGE_SUFFIXES)).orderBy("path")


def to_fetch(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote files (file_id, name, length) that no local file has by name and size; an unknown size fits any."""
    known = local.select(F.col("name").alias("_n"), F.col("length").alias("_l")).distinct()
    wanted = F.concat_ws("_", "file_id", F.regexp_replace("name", r'[<>:"/\\|?*]', "_"))
    asked = remote.select("file_id", "name", "length", F.explode(F.array(wanted, F.col("name"))).alias("_n"))
    there = asked.join(known, "_n").where(F.col("length").isNull() | (F.col("length") == F.col("_l"))).select("file_id", F.col("name").alias("_name")).distinct()
    return remote.join(there, (remote["file_id"] == there["file_id"]) & remote["name"].eqNullSafe(there["_name"]), "left_anti")


def collection(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored collection; a missing one is empty, and of a corrupt one the rows that can't be read are left out."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def priced(df: DataFrame) -> DataFrame:
    return df.withColumn("price", as_price(F.col("market_price")))


def new_only(cards: DataFrame, index: DataFrame) -> DataFrame:
    """Cards with an image that the index lacks."""
    return cards.where(F.col("image_url").isNotNull() & (F.col("image_url") != "")).join(index.select("product_id").distinct(), "product_id", "left_anti")
