"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenroute.llm import chat, components, decontamination, langid, ngram_join, quality, sentencepiece_codec, sharding, token_counts, toxicity, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(k, n=30):
    return " ".join(WORDS[(k * 7 + i * (k % 5 + 1)) % len(WORDS)] + str((k * i) % 11) for i in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Every awkward row, with columns named like the operators' own."""
    rows = [
        (1, text(1), "en", "a", 1), (1, text(1), "en", "a", 1),  # a repeated row
        (2, text(1), "en", "a", 1), (3, text(3), "en", None, 1),
        (4, None, "en", "b", None), (5, "", "en", "b", 0), (6, "!!! ??? \n\n", None, "b", 1),
        (7, "word", "de", "b", 1), (8, "word", "de", "b", 1), (None, text(9), "de", "b", 1),
        (10, text(10, 40_000), "de", "c", 1), (11, "x" * 120_000, "de", "c", 1), (12, "éß漢字 İK \U0001f600 " * 4, None, "c", 1),
    ]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("keep", "ids", "shard", "p_toxic", "a", "b", "c", "home", "id", "file", "node", "hash", "_dropped", "count", "_hits", "_row", "hits", "row", "p", "q", "size", "decoded", "i", "own", "s", "least", "n_ids", "exact", "place"):
        base = base.withColumn(name, F.lit("clash"))
    return base


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (3, 0, 1), (3, 0, 1), (7, 1, 0), (None, 1, 1), (9, None, None), (99, 0, 1), (10, 1, 0), (12, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, text(3, 12)), (2, None), (3, ""), (4, "two words"), (4, "two words")], "item_id long, text string")


def test_language_id(odd):
    got = {(r.doc_id, r.lang_id, r.keep) for r in langid.identify(odd).collect()}
    assert {(4, "und", False), (5, "und", False), (6, "und", False)} <= got
    assert langid.identify(odd).count() == odd.count()
    assert langid.identify(odd.limit(0)).count() == 0
    assert {r.lang_id for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    one = langid.identify(odd.where("lang = 'de'")).collect()
    assert all(r.margin is None for r in one)


def test_ngram_join(odd):
    got = sorted((r.doc_a, r.doc_b, r.jaccard) for r in ngram_join.ngram_jaccard_join(odd).collect())
    assert got == [(1, 2, 1.0), (7, 8, 1.0)]
    assert ngram_join.ngram_jaccard_join(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ngram_join.ngram_jaccard_join(odd, threshold=0)


def test_similarity_classes(odd):
    got = sorted(tuple(r) for r in components.similarity_classes(odd).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 1), (8, 7, 1), (10, 10, 0), (11, 11, 0), (12, 12, 0)]
    assert components.similarity_classes(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        components.similarity_classes(odd, threshold=0)


def test_near_duplicates(odd):
    left = components.drop_near_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in left.collect()) == [-1, 1, 3, 4, 5, 6, 7, 10, 11, 12]
    assert components.drop_near_duplicates(odd.limit(0)).count() == 0


def test_sharding(odd):
    got = sharding.shard(odd, target_bytes=1000)
    assert got.columns == odd.columns  # the shard column takes the place of the clashing one
    assert got.count() == odd.count()
    assert sharding.shard(odd.limit(0)).count() == 0
    assert sharding.shard(odd.where("text IS NULL")).select("shard").collect() == [(0,)]


@pytest.mark.parametrize(("module", "score", "stage"), [(toxicity, toxicity.toxicity, toxicity.keep_clean), (quality, quality.quality_rules, quality.keep_good)])
def test_classifiers(odd, labels, module, score, stage):
    assert score(odd, labels).count() == odd.count()
    assert stage(odd, labels).columns == odd.columns
    assert score(odd.limit(0), labels).count() == 0
    none = score(odd, labels.limit(0)).collect()
    assert all(r.keep for r in none) and len(none) == odd.count()
    assert stage(odd, labels.limit(0)).count() == odd.count()


def test_token_counts(odd):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in token_counts.token_counts(odd).collect() if r.n_tokens is not None)
    enc, _ = token_counts.encoding(token_counts.RANKS, token_counts.PATTERN)
    want = sorted((-1 if r.doc_id is None else r.doc_id, len(enc.encode_ordinary(r.text))) for r in odd.collect() if r.text is not None)
    assert got == want
    assert token_counts.token_counts(odd.limit(0)).count() == 0


def test_chat(spark):
    rows = [
        (1, '{"messages": [{"role": "Human", "content": "hi", "extra": 1}, {"role": null, "content": null}]}'),
        (1, '{"messages": [{"role": "Human", "content": "hi", "extra": 1}, {"role": null, "content": null}]}'),
        (2, None), (3, "{not json"), (4, "{}"), (5, "[1, 2]"), (6, '{"messages": []}'), (None, '{"prompt": "p", "completion": "c", "messages": 3}'),
        (7, '{"instruction": "do", "input": "", "output": "done", "system": "be"}'), (8, '{"a`b": {"x y": [1.5, {"z": true}]}}'),
        (9, '{"messages": [{"role": "user", "content": [{"type": "text", "text": "hi"}, {"type": "image", "url": "u"}, "there"]}, {"role": "bot", "content": "so"}]}'),
        (10, '{"messages": [{"role": "user", "content": [{"type": "text", "text": "alone"}]}]}'), (11, '{"messages": [{"role": "user", "content": ["a", "b"]}]}'),
        (12, '{"messages": [{"role": "user", "content": []}, {"role": "user", "content": "' + "long " * 50_000 + '"}, {"role": "user", "content": 5}]}'),
    ]
    records = spark.createDataFrame(rows, "key long, payload string").withColumn("layout", F.lit("clash")).withColumn("turn", F.lit(7))
    got = [(r.key, r.layout, r.turn, r.role, r.content) for r in chat.canonical_turns(records, "key").collect()]
    assert got.count((1, "messages", 0, "user", "hi")) == 2 and got.count((1, "messages", 1, "unknown", "")) == 2
    for key, layout in ((2, "invalid"), (3, "invalid"), (4, "unknown"), (5, "unknown"), (6, "unknown"), (8, "unknown")):
        assert (key, layout, -1, None, None) in got
    assert [x for x in got if x[0] == 7] == [(7, "instruction", 0, "system", "be"), (7, "instruction", 1, "user", "do"), (7, "instruction", 2, "assistant", "done")]
    assert [x[1:] for x in got if x[0] == 9] == [("messages", 0, "user", "hi\nthere"), ("messages", 1, "assistant", "so")]
    assert [x[4] for x in got if x[0] in (10, 11)] == ["alone", "a\nb"]
    assert [x[4] for x in got if x[0] == 12] == ["", "long " * 50_000, "5"]
    assert [x[3:] for x in got if x[0] is None] == [("user", "p"), ("assistant", "c")]
    assert chat.canonical_turns(records.limit(0), "key").count() == 0
    assert chat.rendered(chat.canonical_turns(records.where("key = 7"), "key"), "key").first().text == "<|system|>\nbe\n<|user|>\ndo\n<|assistant|>\ndone\n"


def test_warc(spark):
    pages = spark.createDataFrame([(1, "u", "h"), (1, "u", "h"), (1, None, "other"), (2, "u", None), (None, "u", "h"), (70_000, "u", "x" * 100_000)], "page_id long, url string, html string")
    pages = pages.withColumn("file", F.lit("clash")).withColumn("node", F.lit(1)).withColumn("hash", F.lit(""))
    assert warc.records(pages).count() == 5
    assert warc.audit(pages, pages).count() == 0
    assert warc.audit(pages.limit(0), pages.limit(0)).count() == 0
    lost = [(r.level, r.node, r.state) for r in warc.audit(pages, pages.where("page_id IS NULL OR page_id <> 70000")).collect()]
    assert (0, 70_000, "missing") in lost and all(s == "missing" for level, _, s in lost if level == 0)


def test_decontamination(odd, bench):
    got = {r.doc_id: r for r in decontamination.contamination(odd, bench).collect()}
    assert len(got) == odd.select("doc_id").distinct().count()
    assert got[4].text is None and got[4].action == "keep" and got[5].text == "" and got[3].hits > 0
    assert decontamination.decontaminate(odd, bench).columns == odd.columns
    same = [sorted(map(str, decontamination.decontaminate(odd, bench, broadcast_grams=bound).collect())) for bound in (1000, 0)]
    assert same[0] == same[1] and "clash" in same[0][0]
    assert decontamination.contamination(odd, bench.limit(0)).where("action <> 'keep'").count() == 0
    assert decontamination.contamination(odd.limit(0), bench).count() == 0
    joined = decontamination.contamination(odd, bench, broadcast_grams=0)  # beyond the broadcast bound
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, joined.collect()), key=key) == sorted(map(tuple, decontamination.contamination(odd, bench).collect()), key=key)


def test_sentencepiece(odd):
    got = {r.doc_id: r for r in sentencepiece_codec.round_trip(odd).collect()}
    assert all(r.exact for r in got.values())
    assert got[4].ids is None and got[5].ids == []
    assert sentencepiece_codec.round_trip(odd.limit(0)).count() == 0
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(odd))  # in place of columns of these names
    assert sorted(back.columns) == sorted(odd.columns)
    assert back.where("NOT (decoded <=> text)").count() == 0 and back.count() == odd.count()


def test_stages(spark, odd, labels, bench, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        full, none = stage(spark, odd, str(tmp_path)), stage(spark, odd.limit(0), str(tmp_path))
        assert none.count() == 0
        assert full.count() <= odd.count()
        assert full.columns == odd.columns or (k == len(corpus_pipeline.STAGES) - 1 and set(full.columns) == {*odd.columns, "n_ids", "ids", "exact"})
