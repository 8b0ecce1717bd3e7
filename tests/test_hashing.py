from pyspark.sql import functions as F

from lumenroute.operators import hashing


def test_distance_of_written_hashes(spark):
    rows = [("f" * 64, "0" * 63 + "1", 255), ("0x" + "0" * 64, "0" * 64, 0), ("FF", "0" * 62 + "ff", 0), (None, "0", 999), ("", "0", 999), ("zz", "0", 999), ("1zz", "0", 999), ("1" * 65, "0", 999)]
    df = spark.createDataFrame(rows, "a string, b string, want int")
    got = df.select("want", hashing.hamming(hashing.hash_words(F.col("a")), hashing.hash_words(F.col("b"))).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert df.select(hashing.normalised_hex(F.lit("0xAB")).alias("h")).first().h == "ab" + "0" * 62


def test_many_probes_take_the_grid(spark, monkeypatch):
    items = spark.range(200).select(F.col("id").alias("item"), F.xxhash64("id").alias("h"))
    probes = spark.range(50).select(F.col("id").alias("probe"), F.xxhash64("id").alias("q"))
    d = hashing.word_hamming(F.col("h"), F.col("q"))
    small = {(r.item, r.probe) for r in hashing.threshold_join(probes, items, d, 20).collect()}
    monkeypatch.setattr(hashing, "BROADCAST_PROBES", 10)
    monkeypatch.setattr(hashing, "few", lambda p, most=10: False)
    assert {(r.item, r.probe) for r in hashing.threshold_join(probes, items, d, 20).collect()} == small and len(small) >= 50


def test_banded_join_finds_what_the_theta_join_finds(spark):
    w = spark.range(300).select(F.col("id").alias("a"), F.xxhash64(F.col("id") % 40).bitwiseXOR(F.col("id") % 7).alias("h"))
    got = {(r.a, r.b) for r in hashing.banded_join(w, w.select(F.col("a").alias("b"), "h"), "a", "b", "h", "h", 64, 4).collect()}
    x = {r.a: r.h for r in w.collect()}
    want = {(a, b) for a in x for b in x if bin((x[a] ^ x[b]) & (2**64 - 1)).count("1") <= 4}
    assert got == want


def test_nearest_prefers_the_lower_item(spark):
    p = spark.createDataFrame([(1, [0.0, 0.0])], "probe int, pe array<float>")
    i = spark.createDataFrame([(3, [1.0, 0.0]), (2, [0.0, 1.0]), (4, [5.0, 5.0])], "item int, e array<float>")
    assert hashing.nearest(p, i, "probe", "item", "e", "pe").collect() == [(1, 2, 1.0)]


def test_all_ways_of_the_threshold_join_agree(spark):
    rng = spark.range(300)
    items = rng.select(F.col("id").alias("item"), F.xxhash64("id").alias("h"))
    probes = rng.where("id < 90").select(F.col("id").alias("probe"), F.xxhash64(F.col("id") + 7).alias("p"))
    d = hashing.word_hamming(F.col("h"), F.col("p"))
    got = [sorted(map(tuple, hashing.threshold_join(probes, items, d, 24, first=d, **ways).select("item", "probe").collect())) for ways in ({}, {"broadcast_probes": 5}, {"broadcast_probes": 5, "broadcast_items": 5, "cell": 20})]
    assert got[0] == got[1] == got[2] and len(got[0]) > 90


def test_nearest_over_blocks_equals_brute_force(spark, monkeypatch):
    """In many blocks, with copies, nulls, NaN, an infinity and a short vector, every row against every other; a fold of generated rows took minutes at 100,000."""
    import numpy as np

    from lumenroute.operators import blocks

    rng = np.random.default_rng(3)
    x = [[float(v) for v in row] for row in rng.integers(-3, 4, (300, 6)).astype("float32")]
    x += [x[5], x[5], x[7], [None] * 6, [float("nan")] + [0.0] * 5, [float("inf")] + [0.0] * 5, [1.0, None, 2.0, 0.0, 0.0, 1.0], [1.0, 2.0], None, [1e25] * 6]
    e = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "item int, e array<float>")

    def key(a, b):
        parts = [(p - q) * (p - q) for p, q in zip(a or [], b or [], strict=False) if p is not None and q is not None]
        d = sum(parts) if parts else None
        return (2, 0.0) if d is None else (1, 0.0) if d != d else (0, d)

    f = [None if v is None else [None if c is None else float(np.float32(c)) for c in v] for v in x]
    want = {k: min((*key(f[k], f[j]), j) for j in range(len(f)) if j != k) for k in range(len(f))}
    monkeypatch.setattr(blocks, "IN_TASK", 2)
    small = blocks.packed
    monkeypatch.setattr(blocks, "packed", lambda rows, name, size=0: small(rows, name, 40))
    got = {r.probe: r for r in hashing.nearest(e.select(F.col("item").alias("probe"), F.col("e").alias("pe")), e, "probe", "item", "e", "pe").collect()}
    assert {k: r.item for k, r in got.items()} == {k: m[2] for k, m in want.items()}
    assert all((r.l2 is None) == (want[k][0] == 2) and (want[k][0] or r.l2 == want[k][1] ** 0.5) for k, r in got.items())


def test_nn_l2_answers_for_every_row(spark):
    from lumenroute.plans import catalogue

    got = catalogue.queries()["nn_l2"](spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()


def first_of(spark, monkeypatch, k, most, score=None, group=None):
    """What ``first_matches`` has for 400 items (copies and nulls among them) in small blocks, and the matches of brute force."""
    from lumenroute.operators import blocks

    monkeypatch.setattr(blocks, "IN_TASK", 2)
    small = blocks.packed
    monkeypatch.setattr(blocks, "packed", lambda rows, name, size=0: small(rows, name, 30))
    items = spark.range(400).select(F.col("id").alias("item_id"), F.when(F.col("id") != 9, F.xxhash64(F.col("id") % 150)).alias("w"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("l"), F.col("id") % 4)).alias("label"))
    got = hashing.first_matches(items.where("item_id % 10 = 0").select(F.col("item_id").alias("probe_id"), "w"), items, k, most, score, group).collect()
    rows = [r for r in items.collect() if r.w is not None]
    pairs = [(p.item_id, r.item_id, (total := ((p.w ^ r.w) & (2**64 - 1)).bit_count()), r.label) for p in rows if p.item_id % 10 == 0 for r in rows if p.item_id != r.item_id]
    return got, [x for x in pairs if x[2] <= most]


def test_first_matches_by_distance(spark, monkeypatch):
    """Few rows of each part of the items reach the window; all pairs did, sorted."""
    got, pairs = first_of(spark, monkeypatch, 5, 64)
    for p in range(0, 400, 10):
        assert sorted((r.total, r.item_id) for r in got if r.probe_id == p)[:5] == sorted(x[2:0:-1] for x in pairs if x[0] == p)[:5]
    assert len(got) <= 40 * 5 * 7 < len(pairs)


def test_first_match_of_each_group(spark, monkeypatch):
    got, pairs = first_of(spark, monkeypatch, 1, 28, group="label")
    least = {}
    for r in got:
        least[r.probe_id, r.label] = min(least.get((r.probe_id, r.label), (99, 0)), (r.total, r.item_id))
    want = {}
    for p, i, total, label in pairs:
        want[p, label] = min(want.get((p, label), (99, 0)), (total, i))
    assert least == want and len({label for _, label in least}) == 4
    assert len(got) <= 40 * 4 * 7


def test_first_matches_by_score(spark, monkeypatch):
    got, pairs = first_of(spark, monkeypatch, 10, 28, score=F.expr("item_id % 3 * 30"))
    for p in range(0, 400, 10):
        assert sorted((-r.score, r.total, r.item_id) for r in got if r.probe_id == p)[:10] == sorted((-(i % 3 * 30), total, i) for q, i, total, _ in pairs if q == p)[:10]
    assert len(got) <= 40 * 10 * 7
