"""Groups of near duplicates: connected components of the pairs of the n-gram join, and every document's group and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .ngram_join import Sizes, ngram_jaccard_join, ngram_links


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge list; a component is named by its least node.

    Alternates large-star and small-star steps, which end after a number of
    rounds about logarithmic in the number of nodes; each round is checkpointed.
    Nulls and loops are left out.
    """
    edges = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct().checkpoint()
    now = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        lower = large.select(F.col("v").alias("n"), F.col("u").alias("to"))
        roots = lower.groupBy("n").agg(F.min("to").alias("m"))
        edges = lower.join(roots, "n").select(F.col("m").alias("u"), F.explode(F.array("n", "to")).alias("v")).where("u < v").distinct().checkpoint()
        before, now = now, edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionAll(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def similarity_classes(docs: DataFrame, n: int = 3, threshold: float = 0.6, cut: Sizes = Sizes()) -> DataFrame:
    """(doc_id, class_id, links) of every document: its group, and in how many pairs of the n-gram join it is.

    A group is what those pairs connect, named by its lowest id. Documents in no
    pair, as those of null or empty text, are a class of their own with no links.
    Repeated ids have one row; rows with a null id are left out, as by the join.
    """
    edges, links = ngram_links(docs, n, threshold, cut)
    groups = components(edges, "doc_a", "doc_b").withColumnRenamed("node", "doc_id")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    found = ids.join(groups, "doc_id", "left").join(links, "doc_id", "left")
    return found.select("doc_id", F.coalesce("component", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def drop_near_duplicates(docs: DataFrame, n: int = 3, threshold: float = 0.6) -> DataFrame:
    """docs without the documents whose group holds a lower id.

    Of repeated rows, the same id and text, one stays, the first by its other
    columns as JSON; rows of one id with different texts stay or go together.
    Rows with a null id all stay, and empty texts and nulls, which have no
    n-gram, are no one's copies. Long texts are compared whole. Other columns
    pass through, whatever their names; an empty table stays empty. Only rows
    that may be concerned are shuffled.
    """
    key = F.col("doc_id").cast("long")
    groups = components(ngram_jaccard_join(docs, n, threshold, forest=True), "doc_a", "doc_b")
    dropped = groups.where("node <> component").select(F.col("node").alias("id")).distinct().checkpoint()
    repeated = docs.select(key.alias("id")).where("id IS NOT NULL").groupBy("id").count().where("count > 1").select("id").checkpoint()
    names = docs.columns
    maybe = kernel.may_be_in(dropped.unionAll(repeated), key)
    kept = docs.where(maybe).select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), key.alias("id")).join(dropped, "id", "left_anti")
    if not repeated.isEmpty():
        order = Window.partitionBy("id", "row.text").orderBy(F.to_json("row"))
        once = kept.join(repeated, "id", "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
        kept = kept.join(repeated, "id", "left_anti").unionAll(once)
    return docs.where(~maybe).unionAll(kept.select("row.*"))
