import datetime as dt
import shutil

import pytest

from silbenwerk.streaming import live

T0 = dt.datetime(2024, 1, 1)


def run(rows, out, checkpoint):
    rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()


def test_lost_state_is_an_error(spark, tmp_path):
    src, cp = str(tmp_path / "src"), tmp_path / "cp"
    stream = spark.readStream.schema(live.REVISION)
    spark.createDataFrame([(1, 5, T0, "e")], live.REVISION).coalesce(1).write.parquet(src)
    run(live.latest_revisions(stream.parquet(src)), str(tmp_path / "out"), str(cp))
    shutil.move(str(cp / "state"), str(tmp_path / "gone"))
    spark.createDataFrame([(1, 3, T0, "c")], live.REVISION).coalesce(1).write.mode("append").parquet(src)
    with pytest.raises(Exception):
        run(live.latest_revisions(stream.parquet(src)), str(tmp_path / "out"), str(cp))
    assert [(r.doc_id, r.revision) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 5)]


def test_a_batch_costs_what_it_changes(spark, tmp_path):
    """State that a batch does not touch is neither read nor written: its changelog holds the batch's keys only."""
    src = str(tmp_path / "src")
    stream = spark.readStream.schema(live.REVISION)
    spark.range(5000).selectExpr("id as doc_id", "1 as revision", "timestamp '2024-01-01' as ts", "'x' as text").coalesce(1).write.parquet(src)
    run(live.latest_revisions(stream.parquet(src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    spark.createDataFrame([(7, 2, T0, "y")], live.REVISION).coalesce(1).write.mode("append").parquet(src)
    query = live.latest_revisions(stream.parquet(src)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsUpdated"] <= 1 and spark.read.parquet(str(tmp_path / "out")).count() == 5001


def test_latest_and_quiet_revisions(spark, tmp_path):
    src = str(tmp_path / "src")
    data = [(1, 1, T0, "a"), (1, 3, T0 + dt.timedelta(milliseconds=100), "c"), (1, 2, T0 + dt.timedelta(milliseconds=50), "b"), (2, 1, T0, "x")]
    spark.createDataFrame(data, live.REVISION).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(live.REVISION).parquet(src)
    out = str(tmp_path / "out")
    start = lambda: run(live.latest_revisions(stream), out, str(tmp_path / "cp"))
    got = lambda: sorted((r.doc_id, r.revision) for r in spark.read.schema(live.REVISION).parquet(out).collect())
    start()
    assert got() == [(1, 3), (2, 1)]
    # an older revision, the same one again, and a newer one, after a restart
    spark.createDataFrame([(1, 2, T0, "old"), (1, 3, T0, "again"), (2, 5, T0, "y"), (3, None, T0, "none")], live.REVISION).coalesce(1).write.mode("append").parquet(src)
    start()
    assert got() == [(1, 3), (2, 1), (2, 5)]
    # a batch that runs again hands on the same rows: its commit is taken away
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    start()
    assert got() == [(1, 3), (2, 1), (2, 5)]
    spark.createDataFrame([(9, 1, T0 + dt.timedelta(minutes=5), "late")], live.REVISION).coalesce(1).write.mode("append").parquet(src)
    q = live.quiet_revisions(stream).writeStream.format("memory").queryName("quiet").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.doc_id, r.text) for r in spark.table("quiet").where("doc_id = 1").collect()} == {(1, "c")}


def test_sentences_lists_and_checks(spark, tmp_path):
    src = str(tmp_path / "s")
    spark.createDataFrame([(1, T0, "Ein Satz."), (1, T0 + dt.timedelta(seconds=1), "Ein Satz."), (1, T0, "Neu.")], "doc_id long, ts timestamp, sentence string").write.parquet(src)
    stream = spark.readStream.schema("doc_id long, ts timestamp, sentence string").parquet(src)
    live.changed_sentences(stream).writeStream.format("memory").queryName("changed").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("changed").count() == 2
    changes = str(tmp_path / "c")
    spark.createDataFrame([(1, "add", "Ada Bob"), (2, "remove", "bob")], "seq long, action string, text string").write.parquet(changes)
    events = spark.readStream.schema("seq long, action string, text string").parquet(changes)
    run(live.list_changes(events), str(tmp_path / "lists"), str(tmp_path / "cp2"))
    lists = lambda: sorted((r.word, r.list_type) for r in live.current_lists(spark.read.schema(live.CHANGE).parquet(str(tmp_path / "lists"))).collect())
    assert lists() == [("Ada", "user")]
    spark.createDataFrame([(5, "add", "ADA"), (6, "ignore", "ada"), (4, "remove", "Ada"), (7, "add", "BOB, eve"), (0, "remove", "eve")], "seq long, action string, text string").coalesce(1).write.mode("append").parquet(changes)
    run(live.list_changes(events), str(tmp_path / "lists"), str(tmp_path / "cp2"))
    assert lists() == [("ADA", "user"), ("BOB", "user"), ("ada", "ignored"), ("eve", "user")]
    spark.createDataFrame([(3, "remove", "Ada"), (8, "unignore", "ada")], "seq long, action string, text string").coalesce(1).write.mode("append").parquet(changes)
    run(live.list_changes(events), str(tmp_path / "lists"), str(tmp_path / "cp2"))
    assert lists() == [("ADA", "user"), ("BOB", "user"), ("eve", "user")]  # a late change doesn't undo a later one
    docs = str(tmp_path / "d")
    spark.createDataFrame([(1, T0, "Das Huas steht")], "doc_id long, ts timestamp, text string").write.parquet(docs)
    lex = spark.createDataFrame([("das",), ("steht",)], "word string")
    texts = spark.readStream.schema("doc_id long, ts timestamp, text string").parquet(docs)
    live.check_stream(texts, lex).writeStream.format("memory").queryName("errs").trigger(availableNow=True).start().awaitTermination()
    assert [r.word for r in spark.table("errs").collect()] == ["Huas"]
