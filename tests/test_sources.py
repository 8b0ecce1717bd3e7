import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenroute.sources import catalogue, plugins, sinks, sqlite


def test_sqlite_tables_are_read_in_ranges(spark, tmp_path):
    path = str(tmp_path / "cards.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE cards_1 (product_id INTEGER, name TEXT, price REAL, extra)")
        c.executemany("INSERT INTO cards_1 VALUES (?, ?, ?, ?)", [(k, f"n{k}", "x" if k == 3 else k / 2, b"\xffz" if k == 4 else None) for k in range(25)])
        c.execute("DELETE FROM cards_1 WHERE product_id BETWEEN 10 AND 19")
        c.execute('CREATE TABLE "cards_odd name" (a TEXT)')
        c.execute("CREATE TABLE other (a TEXT)")
    assert sqlite.tables(path, "cards_%") == ["cards_1", "cards_odd name"]
    df = sqlite.table(spark, path, "cards_1", rows=6)
    assert df.dtypes == [("product_id", "bigint"), ("name", "string"), ("price", "double"), ("extra", "string")]
    rows = {r.product_id: r for r in df.collect()}
    assert sorted(rows) == [*range(10), *range(20, 25)] and rows[3].price is None and rows[4].price == 2.0 and rows[4].extra == "�z"
    assert df.rdd.getNumPartitions() == 5
    assert sqlite.table(spark, path, "cards_odd name").count() == 0
    with pytest.raises(Exception, match="no table"):
        sqlite.table(spark, path, "missing")


def test_listing_goes_one_level_deep(spark):
    got = sqlite.listing(spark, "plugins_for_tests:list_folder", "top", recursive=True, page=2).collect()
    assert sorted((r.file_id, r.depth) for r in got) == [*((f"f{k}", 0) for k in range(5)), ("g", 1)]
    assert sqlite.listing(spark, "plugins_for_tests:list_folder", "top", page=2).count() == 5


def test_camera_stream(spark, tmp_path):
    frames = sqlite.camera(spark, "plugins_for_tests:Frames", frames="3")
    query = frames.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for _ in range(60):
            query.processAllAvailable()
            done = spark.read.parquet(str(tmp_path / "out")).count() if (tmp_path / "out").exists() and list((tmp_path / "out").glob("*.parquet")) else 0
            if done >= 3:
                break
    finally:
        query.stop()
    assert sorted(r.frame for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_fetched_hashes_are_of_missing_cards_only(spark):
    cards = spark.createDataFrame([("1", "g", "u"), ("2", "g", "bad"), ("3", "g", ""), ("4", "g", "v")], "product_id string, game string, image_url string")
    index = spark.createDataFrame([("4",)], "product_id string")
    assert [(r.product_id, len(r.g_phash)) for r in plugins.fetched_hashes(cards, index, "plugins_for_tests:hashes_of").collect()] == [("1", 64)]


def test_overlays_that_are_no_list_are_ignored(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "x"}')
    (tmp_path / "b.json").write_text('\n[{"name": "x", "game_id": 7}, {"name": "y", "game": "G"}]')
    assert catalogue.overlay(spark, str(tmp_path / "a.json")).count() == 0
    assert sorted(r.name for r in catalogue.overlay(spark, str(tmp_path / "b.json")).collect()) == ["x", "y"]
    assert sorted(r.path[-6:] for r in catalogue.index_files(spark, str(tmp_path), "*.json").collect()) == ["a.json", "b.json"]


def test_a_table_is_swapped_whole(spark, tmp_path):
    path = str(tmp_path / "index")
    for n in (5, 7):
        sinks.swapped(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    kept = sinks.upserted(spark.read.parquet(path), spark.range(6, 9), "id")
    sinks.swapped(kept, path)  # reads the table that it takes the place of
    assert spark.read.parquet(path).count() == 9 and [p.name for p in tmp_path.iterdir()] == ["index"]


def test_crops_are_written_once_and_logged(spark, tmp_path):
    px = bytes(range(48))
    rows = [("a.png", px, 4, 4, (1, 1, 3, 4)), ("b.png", px[:3], 4, 4, (0, 0, 2, 2)), ("c.png", px, 4, 4, None)]
    images = spark.createDataFrame(rows, "file string, data binary, height int, width int, rect struct<x1:int,y1:int,x2:int,y2:int>")
    log = sinks.crops(images, str(tmp_path), "plugins_for_tests:raw_bytes")
    assert {r.file: (r.status, r.width, r.height) for r in log.collect()} == {"a.png": ("cropped", 2, 3), "b.png": ("failed", None, None), "c.png": ("failed", None, None)}
    assert (tmp_path / "a.png").read_bytes() == np.frombuffer(px, np.uint8).reshape(4, 4, 3)[1:4, 1:3].tobytes()
    assert sinks.crop_stats(sinks.crops(images, str(tmp_path), "plugins_for_tests:raw_bytes")).first().asDict() == {"total": 3, "cropped": 0, "skipped": 1, "failed": 2}


def test_batch_report_has_recomputed_statistics(spark, tmp_path):
    rows = spark.createDataFrame([("success", True, False, 1.0), ("error", False, True, 3.0)], "status string, match_found boolean, reused boolean, seconds double")
    sinks.batch_report(rows, str(tmp_path / "r"))
    got = spark.read.json(str(tmp_path / "r")).first()
    assert got.stats.total_files == 2 and got.stats.avg_time_per_scan == 2.0 and len(got.results) == 2 and "T" in got.timestamp


def test_remote_files_are_matched_by_either_name(spark):
    remote = spark.createDataFrame([("1", "a:b.jpg", 5), ("2", "a:b.jpg", 5), ("3", "c.jpg", None), ("4", "d.jpg", 6), ("5", None, 1)], "file_id string, name string, length long")
    local = spark.createDataFrame([("1_a_b.jpg", 5), ("c.jpg", 9), ("c.jpg", 9), ("d.jpg", 7)], "name string, length long")
    assert sorted(r.file_id for r in catalogue.to_fetch(remote, local).collect()) == ["2", "4", "5"]


def test_plugins_answer(spark):
    sent = []
    plugins.register("device", "d", lambda b: sent.append(b) or b != "bad")
    rows = spark.createDataFrame([(1, "x"), (2, "bad"), (3, "y")], "n int, bin string")
    with pytest.raises(RuntimeError, match="refused"):
        plugins.send_bins(rows, "d", ["n"])
    assert sent == ["x", "bad"] and plugins.send_bins(rows.where("n <> 2"), "d", ["n"]) == 2
    with pytest.raises(plugins.MissingPlugin):
        plugins.get("ocr", "none")
    assert plugins.or_built_in(F.lit(None), F.lit(1)) is not None
