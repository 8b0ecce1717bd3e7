"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import canonical_turns, heterogeneous
from .cluster import table
from .components import similarity_classes
from .decontamination import contamination
from .langid import identify
from .quality import quality_rules
from .sentencepiece_codec import round_trip
from .sharding import shard
from .token_counts import token_counts
from .toxicity import toxicity
from .warc import audit, faulty

_WORD = r"[\p{L}\p{N}\p{M}]+"
_GAP = r"[^\p{L}\p{N}\p{M}]*"


def _words(text: str) -> str:
    """The words of a text in normal form. DuckDB has no NFKC, so compatibility characters are only tested against brute force."""
    joined = rf"nfc_normalize(regexp_replace({text}, '[\x{{AD}}\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}]', '', 'g'))"
    return rf"regexp_extract_all(regexp_replace(lower({joined}), '([\p{{Han}}\p{{Hiragana}}\p{{Katakana}}])', ' \1 ', 'g'), '{_WORD}')"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by character models of all documents; und and keep false where rejected."""
    return identify(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class and links, by all pairs of documents whose word bigram sets have Jaccard similarity of 0.7 or more."""
    return similarity_classes(table(spark, sf_dir, "documents"), n=2, threshold=0.7)


_OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_words('text')} AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
        ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS gram FROM w),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS c
      FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
p AS (SELECT doc_a, doc_b, c / (sa.n + sb.n - c) AS jaccard
      FROM i JOIN s sa ON sa.doc_id = doc_a JOIN s sb ON sb.doc_id = doc_b
      WHERE c / (sa.n + sb.n - c) >= 0.7 - 1e-12),
l AS (SELECT doc_a AS doc_id, doc_b AS other FROM p UNION ALL SELECT doc_b, doc_a FROM p),
k AS (SELECT doc_id, count(*) AS links FROM l GROUP BY doc_id),
r AS (SELECT DISTINCT doc_id, doc_id AS other FROM documents WHERE doc_id IS NOT NULL
      UNION SELECT r.doc_id, l.other FROM r JOIN l ON l.doc_id = r.other)
SELECT r.doc_id, min(r.other) AS class_id, coalesce(any_value(k.links), 0) AS links
FROM r LEFT JOIN k ON k.doc_id = r.doc_id GROUP BY r.doc_id
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, range-partitioned by source into shards of about 16 MB of text."""
    return shard(table(spark, sf_dir, "documents"), key="source", within="doc_id", target_bytes=16 << 20)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its probability of being toxic; keep is false from 0.5."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of byte-level BPE tokens."""
    return token_counts(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical turns of all conversations, each read from a JSON record in one of six layouts.

    Turns with a null conv_id belong to no conversation and are left out, as in the SQL.
    """
    records = heterogeneous(table(spark, sf_dir, "conversations"))
    return canonical_turns(records, "conv_id").select("conv_id", "layout", "turn", "role", "content")


_OP6 = """
WITH c AS (SELECT conv_id, role, coalesce(text, '') AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS turn,
  string_agg(role, ',' ORDER BY turn, role, text) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS roles
  FROM conversations WHERE conv_id IS NOT NULL)
SELECT conv_id, CASE WHEN conv_id % 5 = 1 THEN 'conversations' WHEN conv_id % 5 = 2 THEN 'nested' WHEN conv_id % 5 = 3 THEN 'dialogue'
  WHEN conv_id % 5 = 4 AND roles = 'user,assistant' THEN 'prompt' WHEN conv_id % 5 = 4 AND roles = 'system,user,assistant' THEN 'instruction' ELSE 'messages' END AS layout,
  turn, role, content FROM c
"""


def op7_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the pages as WARC against a replica of them; the replica has faults at fixed ids, as the tables hold no second copy."""
    pages = table(spark, sf_dir, "pages")
    return audit(pages, faulty(pages))


def _op7_level(level: int, side: str) -> str:
    return f"""{side}{level} AS (SELECT file, node // 16 AS node, min("begin") AS "begin", max("end") AS "end",
      sha256(string_agg(node || ':' || ("begin" - b) || '-' || ("end" - b) || ':' || hash, '|' ORDER BY node)) AS hash
      FROM (SELECT *, min("begin") OVER (PARTITION BY file, node // 16) AS b FROM {side}{level - 1}) GROUP BY file, node // 16)"""


def _op7_side(side: str, source: str) -> str:
    return rf"""{side}r AS (SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
      || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10)
      || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM {source}),
    {side}h AS (SELECT page_id // 4096 AS file, page_id, strlen(record) AS bytes, sha256(record) AS hash FROM {side}r),
    {side}o AS (SELECT *, sum(bytes) OVER (PARTITION BY file ORDER BY page_id, hash ROWS UNBOUNDED PRECEDING)::BIGINT AS "end" FROM {side}h),
    {side}0 AS (SELECT file, page_id AS node, min("end" - bytes) AS "begin", max("end") AS "end", string_agg(hash, '+' ORDER BY hash) AS hash FROM {side}o GROUP BY file, page_id),
    {", ".join(_op7_level(k, side) for k in (1, 2, 3))}"""


# for up to 4096 page ids, whose tree has three levels above the records; these lie end to end, so none is only shifted
_OP7 = f"""
WITH f AS (SELECT page_id, url, CASE WHEN page_id % 997 = 5 THEN '#' || substring(html, 2) ELSE html END AS html FROM pages WHERE page_id % 1499 <> 7
  UNION ALL SELECT page_id + 2, url, html FROM pages WHERE page_id % 1999 = 11),
{_op7_side("a", "pages")}, {_op7_side("b", "f")}
{" UNION ALL ".join(f"""
SELECT {k} AS level, coalesce(a.file, b.file) AS file, coalesce(a.node, b.node) AS node, coalesce(a."begin", -1) AS "begin", coalesce(a."end", -1) AS "end", a.hash,
  coalesce(b."begin", -1) AS replica_begin, coalesce(b."end", -1) AS replica_end, b.hash AS replica_hash,
  CASE WHEN b.hash IS NULL THEN 'missing' WHEN a.hash IS NULL THEN 'extra' ELSE 'damaged' END AS state
FROM a{k} a FULL JOIN b{k} b ON a.node = b.node WHERE a.hash IS DISTINCT FROM b.hash""" for k in (3, 2, 1, 0))}
"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its benchmark 8-gram hits, what is done about them, and the cleaned text."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=8, drop_share=0.5)


_OP8 = rf"""
WITH b AS (SELECT DISTINCT {_words('text')} AS ws FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 8 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' ')) END) AS gram FROM b),
k AS (SELECT gram, len(string_split(gram, ' ')) AS size FROM g),
d AS (SELECT row_number() OVER () AS r, doc_id, text, {_words('text')} AS ws FROM documents),
z AS (SELECT DISTINCT size FROM k),
w AS (SELECT r, size, unnest(range(1, len(ws) - size + 2)) AS i, ws FROM d, z),
h AS (SELECT w.r, w.i, w.size FROM w JOIN k ON k.gram = array_to_string(w.ws[w.i:w.i + w.size - 1], ' ') AND k.size = w.size),
c AS (SELECT r, count(DISTINCT j) AS covered, list(DISTINCT j) AS gone
      FROM (SELECT r, unnest(range(i, i + size)) AS j FROM h) GROUP BY r),
n AS (SELECT r, count(*) AS hits FROM h GROUP BY r),
a AS (SELECT doc_id, text, len(ws) AS words, coalesce(hits, 0) AS hits, coalesce(covered, 0) AS covered, gone
      FROM d LEFT JOIN c USING (r) LEFT JOIN n USING (r)),
x AS (SELECT *, CASE WHEN covered > 0 AND covered >= 0.5 * words THEN 'drop' WHEN hits > 0 THEN 'cut' ELSE 'keep' END AS action FROM a)
SELECT doc_id, words, hits, covered, action, action <> 'drop' AS keep,
  CASE action WHEN 'drop' THEN NULL WHEN 'keep' THEN text
    ELSE regexp_extract(text, '^{_GAP}') || array_to_string(list_filter(
      regexp_extract_all(text, '{_WORD}{_GAP}'), lambda p, i: NOT list_contains(gone, i)), '') END AS text
FROM x
"""


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SentencePiece ids, and whether they decode to its text."""
    return round_trip(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its calibrated probability of good quality; keep is false under 0.5."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_sharding": op3_sharding,
        "op4_toxicity": op4_toxicity,
        "op5_token_counts": op5_token_counts,
        "op6_chat_formatting": op6_chat_formatting,
        "op7_warc_audit": op7_warc_audit,
        "op8_decontamination": op8_decontamination,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard_join": _OP2,
        "op6_chat_formatting": _OP6,
        "op7_warc_audit": _OP7,
        "op8_decontamination": _OP8,
    }
