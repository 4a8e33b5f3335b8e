import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mendwell.sources import files
from mendwell.streaming import live


def test_catalog_in_both_shapes(spark, tmp_path):
    entries = [{"deeplink": "v://1", "description": "d", "originalType": "onURL", "validation": {"deeplink": "v://2", "key": "k"}}, {"description": "no link"}, {"deeplink": "v://3"}]
    for name, value in (("a.json", {"deeplinks": entries}), ("b.json", entries)):
        (tmp_path / name).write_text(json.dumps(value, indent=1))
        got = files.catalog(spark, str(tmp_path / name)).orderBy("link_id").collect()
        assert [(r.link_id, r.deeplink, r.validation_deeplink) for r in got] == [(1, "v://1", "v://2"), (3, "v://3", None)]


def test_articles_and_missing_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"responses": [{"id": "row_1", "original_query": "q", "siis_response": {"title": "t", "content": "c"}}, {"id": "row_2"}]}))
    assert [tuple(r) for r in files.articles(spark, str(tmp_path / "a.json")).orderBy("siis_id").collect()] == [(1, "row_1", "q", "t", "c"), (2, "row_2", None, None, None)]
    assert files.articles(spark, str(tmp_path / "none.json")).count() == 0
    assert files.records(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_complaint_lines_keep_their_place(spark, tmp_path):
    (tmp_path / "in.txt").write_text("1. first\n\n  2) second \r\nthird 3. x\n")
    assert [(r.ord, r.query) for r in files.complaints(spark, str(tmp_path)).orderBy("ord").collect()] == [(1, "first"), (3, "second"), (4, "third 3. x")]


def test_records_round_trip_and_bad_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "a", "response": {"contexts": []}}\nnot json\n{"id": "b"}\n')
    df = files.records(spark, str(tmp_path / "r.jsonl"))
    files.write_records(df, str(tmp_path / "out"))
    assert sorted(r.id for r in files.records(spark, str(tmp_path / "out")).collect()) == ["a", "b"]
    (tmp_path / "k.jsonl").write_text('{"key": "a", "response": {"contexts": []}}\n{"key": "", "response": {}}\n{"key": "c"}\n')
    assert [r.key for r in files.kept_plans(spark, str(tmp_path / "k.jsonl")).collect()] == ["a"]
    assert "| n | 2 |" in files.report(df.agg(F.count("*").alias("n")), "Runs")


def test_complaint_lines_of_many_splits(spark, tmp_path):
    want = set()
    for f in range(3):
        rows = [f"{i}. complaint {f} number {i} " + "x" * (i % 50) if i % 7 else "" for i in range(1, 2000 + f)]
        (tmp_path / f"in{f}.txt").write_text("\n".join(rows))
        want |= {(f"in{f}.txt", i, r.split(". ", 1)[1].strip()) for i, r in enumerate(rows, 1) if r}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = {tuple(r) for r in files.complaints(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


def test_snapshot_round_trip(spark, tmp_path):
    samples = spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(seconds=i), float(i)) for i in range(20)], "sample_id bigint, t timestamp, ms double")
    counters = samples.agg(F.count("*").alias("requests"))
    files.write_snapshot(samples, counters, str(tmp_path / "s"), 5)
    kept, counted = files.snapshot(spark, str(tmp_path / "s"), samples.schema, counters.schema)
    assert sorted(r.sample_id for r in kept.collect()) == [15, 16, 17, 18, 19] and counted.collect()[0].requests == 20
    assert [df.count() for df in files.snapshot(spark, str(tmp_path / "none"), samples.schema, counters.schema)] == [0, 0]


def drain(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_stream_of_samples_equals_the_batch(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    rows = [(i, "c", t0 + timedelta(minutes=7 * i), t0, float(i % 500), i % 3 == 0, i % 2, None) for i in range(200)]
    spark.createDataFrame(rows, live.SAMPLES).write.parquet(str(tmp_path / "in"))
    got = drain(spark, live.windowed(spark.readStream.schema(live.SAMPLES).parquet(str(tmp_path / "in"))), "windowed_samples")
    batch = {r.start: r.requests for r in live.windowed(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert got and all(batch[r.start] == r.requests for r in got)


def test_stream_of_plans_hits_within_the_lifetime(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    rows = [("a", 1, t0), ("a", 2, t0 + timedelta(minutes=30)), ("a", 3, t0 + timedelta(minutes=90)), ("b", 4, t0), ("", 5, t0), (None, 6, t0), ("b", 7, None)]
    schema = "key string, request_id bigint, at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    got = {r.request_id: r.match for r in drain(spark, live.serve(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "served_plans")}
    assert got == {1: "miss", 2: "exact", 3: "miss", 4: "miss"}


def test_only_admitted_plans_are_kept(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("a", 1, t, False), ("a", 2, t + timedelta(seconds=1), None), ("a", 3, t + timedelta(seconds=2), True), ("a", 4, t + timedelta(seconds=3), False), ("b", 5, t, False), ("", 6, t, True)]
    schema = "key string, request_id bigint, at timestamp, valid boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = {r.request_id: r.match for r in drain(spark, live.serve(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), admitted="valid"), "admitted_plans")}
    assert got == {1: "miss", 2: "miss", 3: "miss", 4: "exact", 5: "miss"}
