import datetime as dt

from pyspark.sql import types as T

from tideline.streaming import ingest

SCHEMA = "k string, date date, v int, ver int"
KEYS, VERSION = ["k", "date"], ["ver"]
D = dt.date(2024, 1, 2)


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, **kw):
    schema = spark.createDataFrame([], SCHEMA).schema
    out = ingest.ingest_available(
        spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "pos"), KEYS, VERSION, **kw
    )
    return sorted((r.k, r.v) for r in out.collect())


def test_batches_fold_to_newest_version(spark, tmp_path):
    inbox = str(tmp_path / "in")
    put(spark, inbox, [("a", D, 1, 1), ("a", D, 2, 2), ("b", D, 5, 1)])
    assert run(spark, tmp_path) == [("a", 2), ("b", 5)]
    # nothing new: no batch, same rows
    assert run(spark, tmp_path) == [("a", 2), ("b", 5)]
    # a late older version loses, a newer one wins, an equal one is replaced by the later batch
    put(spark, inbox, [("a", D, 0, 1), ("b", D, 6, 1), ("c", D, 7, 1)])
    assert run(spark, tmp_path) == [("a", 2), ("b", 6), ("c", 7)]
    assert len(list((tmp_path / "out").glob("batch_id=*"))) == 2


def test_replay_gives_equal_rows(spark, tmp_path):
    inbox = str(tmp_path / "in")
    for i in range(4):
        put(spark, inbox, [("a", D, i, i), (f"k{i}", D, i, i)])
    first = run(spark, tmp_path, files_per_batch=1)
    schema = spark.createDataFrame([], SCHEMA).schema
    # a lost position replays every file into the same target
    again = ingest.ingest_available(
        spark, inbox, schema, str(tmp_path / "out"), str(tmp_path / "pos2"), KEYS, VERSION, files_per_batch=1
    )
    assert sorted((r.k, r.v) for r in again.collect()) == first
    compacted = ingest.compact(spark, str(tmp_path / "out"), str(tmp_path / "compact"), schema, KEYS, VERSION)
    assert sorted((r.k, r.v) for r in compacted.collect()) == first


def test_late_rows_are_set_aside_and_nothing_is_lost(spark, tmp_path, plan):
    from tideline.streaming import late
    from tideline.streaming.ingest import file_stream

    schema = T.StructType.fromDDL("series string, date date, value double, version int")
    source, target, checkpoint = (str(tmp_path / p) for p in ("in", "out", "mark"))
    keys, version = ["series", "date"], ["version"]
    day = lambda m, d: dt.date(2024, m, d)

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        late.land_under_watermark(file_stream(spark, source, schema), target, checkpoint, keys, version, 10).awaitTermination()

    first = [("a", day(m, d), 1.0, 1) for m in (1, 2, 3) for d in (5, 15, 25)] + [("b", None, 9.0, 1)]
    run(first)
    assert late.watermark(spark, target, 1, 10) == day(3, 15)
    second = [
        ("a", day(3, 25), 1.0, 1),  # has landed
        ("a", day(3, 15), 2.0, 2),  # a newer version
        ("a", day(3, 26), 3.0, 1), ("a", day(3, 26), 4.0, 2),  # new, twice in the batch
        ("a", day(1, 5), 5.0, 3), ("c", day(2, 1), 6.0, 1), ("c", day(2, 9), 7.0, 1),  # late
    ]
    run(second)
    landed = {(r.series, r.date, r.value) for r in late.landed_rows(spark, target, schema).where("batch_id = 1").collect()}
    assert landed == {("a", day(3, 15), 2.0), ("a", day(3, 26), 4.0)}
    aside = late.late_rows(spark, target, schema)
    assert {(r.series, r.date, r.batch_id) for r in aside.collect()} == {
        ("b", None, 0), ("a", day(1, 5), 1), ("c", day(2, 1), 1), ("c", day(2, 9), 1)
    }
    assert {tuple(r) for r in late.late_windows(aside).collect()} == {("a", day(1, 5), day(1, 5), 1), ("c", day(2, 1), day(2, 9), 2)}
    newest = {}
    for s, d, v, n in first + second:
        newest[s, d] = max(newest.get((s, d), (0, 0.0)), (n, v))
    settled = late.settled_rows(spark, target, schema, keys, version).collect()
    assert {(r.series, r.date): (r.version, r.value) for r in settled} == newest and len(settled) == len(newest)
    state = plan(late.seen_since(late.landed_rows(spark, target, schema), day(3, 15), keys, version))
    assert "PartitionFilters: [isnotnull(month#" in state and ">= 202403)]" in state
    run([("a", day(3, 26), 4.0, 2)])  # a file that is landed again changes nothing
    assert late.settled_rows(spark, target, schema, keys, version).count() == len(newest)
