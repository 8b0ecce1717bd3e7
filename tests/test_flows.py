from pyspark.sql import functions as F

from lumenroute.streaming import flows


def test_observations_reach_the_ledger_once_confirmed(spark, tmp_path):
    rows = [(1, "x", 0, "p1"), (2, "x", 1, "p1"), (3, "x", 2, "p2"), (4, "y", 0, "p1"), (5, "x", 3, "p2")]
    df = spark.createDataFrame(rows, "obs_id long, camera string, s long, product_id string").withColumns({"ts": F.timestamp_seconds("s"), "name": F.lit("Bolt"), "color": F.lit("R"), "type": F.lit("Instant")}).drop("s")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        everything = spark.read.schema(flows.OBSERVATIONS).json(str(tmp_path / "in"))
        write = flows.recorder(lambda batch: batch.join(everything.drop("camera", "ts"), "obs_id"), str(tmp_path / "ledger"))
        flows.start(flows.accepted(flows.observations(spark, str(tmp_path / "in"))), write, str(tmp_path / "cp"), once=True).awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(str(tmp_path / "ledger"))
    assert sorted((r.obs_id, r.bin) for r in got.collect()) == [(2, "R"), (5, "R")]


def test_frames(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("noise<Sensors,home=1,x=2>..<OK>\n<Sensors,home=0>\n")
    q = flows.frames(spark, str(tmp_path / "in")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    assert sorted(sorted(r.readings.items()) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [[], [("home", "0")], [("home", "1"), ("x", "2")]]
