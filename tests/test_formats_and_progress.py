"""Shard files through Spark's write format, readers by byte ranges, and the progress of what runs."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.model import schema
from frameloom.plans import progress
from frameloom.plans.runner import ALL, main
from frameloom.sinks import files
from frameloom.sources import ranges, readers
from frameloom.sources.generate import register_sources


def frames(spark, tasks=("a", "b"), shards=3, samples=2, steps=2, width=4):
    rows = [(t, k, s, i, i, [s + i + c for c in range(width)], "x" if s else None) for t in tasks for k in range(shards) for s in range(samples) for i in range(steps)]
    return spark.createDataFrame(rows, schema("int"))


def there(folder):
    return {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in folder.iterdir() if p.is_file() and p.name[0] != "."}


@pytest.mark.parametrize("fmt", sorted(files.FORMATS))
def test_a_second_run_leaves_the_same_files(spark, tmp_path, fmt):
    for _ in range(2):
        told = files.write_shards(frames(spark), str(tmp_path / "o"), fmt, 7).collect()
        assert {r.filename: (r.bytes, r.sha256) for r in told} == there(tmp_path / "o") and len(told) == 6
        assert all(r.frames == 4 and r.samples == 2 and r.error is None for r in told)
    assert [p for p in (tmp_path / "o").iterdir() if p.is_dir()] == []


def test_shards_of_parquet_and_text_read_back(spark, tmp_path):
    files.write_shards(frames(spark), str(tmp_path / "p"), "Parquet")
    back = readers.read_tagged_parquet(spark, str(tmp_path / "p"), "int")
    assert back.count() == 24 and sorted({r.shard_id for r in back.collect()}) == [0, 1, 2]
    key = lambda df: sorted((r.shard_id, r.sample_id, r.step_index, list(r.state), r.label or "") for r in df.collect())
    assert key(back) == key(frames(spark))
    text = frames(spark).withColumn("state", F.transform("state", lambda v: v + 65))
    files.write_shards(text, str(tmp_path / "t"), "Text", options={"with_sample": True})
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect())
    assert lines == sorted(r.value for r in files.text_lines(text, True).collect())


@pytest.mark.parametrize("kind, cells", [("float", [-1.0, 66.9, 300.0, 0.0]), ("bool", [True, False]), ("int", [65, 0xD800, -5, 0x110000, 0x1F642])])
def test_text_shards_have_the_lines_of_the_expression(spark, tmp_path, kind, cells):
    one = spark.createDataFrame([("a", 0, 0, 0, 0, cells, "l")], schema(kind))
    files.write_shards(one, str(tmp_path / "t"), "Text")
    assert spark.read.text(str(tmp_path / "t")).collect() == files.text_lines(one).select("value").collect()


def test_write_format(spark, tmp_path):
    register_sources(spark)
    folder = tmp_path / "o"
    save = lambda df, mode, **o: files.by_shards(df).write.format("frameloom").mode(mode).options(**o).save(str(folder))
    for _ in range(2):
        save(frames(spark), "append", sink="Binary", seed="7")
        assert len(there(folder)) == 6 and not [p for p in folder.iterdir() if p.is_dir()]
    twin = files.write_shards(frames(spark), str(tmp_path / "s"), "Binary", 7).collect()
    assert {r.filename: (r.bytes, r.sha256) for r in twin} == there(folder)
    save(frames(spark, tasks=("a",), shards=2), "overwrite", sink="Binary", seed="7")
    assert sorted(n[:7] for n in there(folder)) == ["a_00000", "a_00001", "b_00000", "b_00001", "b_00002"]  # the other task's files stay


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    register_sources(spark)
    good, bad = frames(spark, tasks=("a",)), spark.createDataFrame([("b", 0, 0, 0, 0, [1], None), ("b", 0, 0, 1, 1, [1, 2], None)], schema("int"))
    with pytest.raises(Exception, match="1 shards failed"):
        files.by_shards(good.unionByName(bad)).write.format("frameloom").mode("append").option("sink", "Npy").save(str(tmp_path / "o"))
    broken = good.withColumn("state", F.when(F.col("shard_id") == 1, F.raise_error(F.lit("boom")).cast("array<bigint>")).otherwise(F.col("state")))
    with pytest.raises(Exception, match="boom"):
        files.by_shards(broken).write.format("frameloom").mode("append").option("sink", "Npy").save(str(tmp_path / "o"))
    assert not (tmp_path / "o").exists() or list((tmp_path / "o").iterdir()) == []
    with pytest.raises(Exception, match="sink"):
        files.by_shards(good).write.format("frameloom").mode("append").option("sink", "No").save(str(tmp_path / "o"))


def test_folders_by_task_are_replaced(spark, tmp_path):
    for _ in range(2):
        files.write_parquet(frames(spark), str(tmp_path / "p"))
        files.write_text(frames(spark), str(tmp_path / "t"))
    files.write_parquet(frames(spark, tasks=("b",), shards=1), str(tmp_path / "p"))
    assert {r.task: r["count"] for r in readers.read_frames(spark, str(tmp_path / "p")).groupBy("task").count().collect()} == {"a": 12, "b": 4}
    assert spark.read.text(str(tmp_path / "t")).count() == 24


@pytest.mark.parametrize("fmt", ["Parquet", "Text"])
def test_the_report_lists_files_with_sizes_and_digests(spark, tmp_path, fmt):
    path = tmp_path / "m.yaml"
    path.write_text(f"global: {{output_dir: '{tmp_path}/out', default_format: {fmt}}}\ntasks: [{{name: a, generator: ca, count: 5, seed: 3, shard_size: 2, params: {{seq_length: 3, extensions: {{ca: {{rule: 30, width: 8}}}}}}, pipeline: [token_mapper]}}]")
    for _ in range(2):
        assert main(["run", "-m", str(path)], spark) == ALL
        report = json.loads((tmp_path / "out/metadata.json").read_text())
        listed = {f["filename"]: (f["file_size"], f["sha256"]) for f in report["tasks"][0]["output_files"]}
        found = {n: v for n, v in there(tmp_path / "out").items() if n != "metadata.json"}
        assert listed == found and len(listed) == 3 and report["summary"]["total_bytes"] == sum(s for s, _ in listed.values())


# ---- byte ranges -------------------------------------------------------------------------------------------------------------
def test_arrays_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    made = {"a.npy": rng.integers(0, 99, (1000, 3, 2)), "b.npy": rng.random((10, 4)).astype("f4"), "c.npy": np.arange(7), "d.npy": np.zeros((0, 5)), "e.npy": np.array([[True], [False]])}
    for name, array in made.items():
        np.save(tmp_path / name, array)
    df = readers.read_npy(spark, str(tmp_path), partition_bytes=1000)
    assert df.rdd.getNumPartitions() > 40
    got = {}
    for r in df.collect():
        got.setdefault(r.filename, {})[r.row] = (list(r.shape), list(r["values"]))
    for name, array in made.items():
        assert got.get(name, {}) == {i: (list(array.shape[1:]), row.reshape(-1).astype(float).tolist()) for i, row in enumerate(array)}
    assert [(r.filename, r.row) for r in readers.read_npy(spark, str(tmp_path / "[ab].npy"), 1003).orderBy("filename", "row").collect()] == [("a.npy", i) for i in range(1000)] + [("b.npy", i) for i in range(3)]
    np.save(tmp_path / "z.npy", np.asfortranarray(np.zeros((3, 2))))
    with pytest.raises(Exception, match="column order"):
        readers.read_npy(spark, str(tmp_path / "z.npy")).collect()
    with pytest.raises(Exception, match="no file"):
        readers.read_npy(spark, str(tmp_path / "none.npy")).collect()


def test_a_cap_and_filters_end_the_plan_early(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan, StringContains

    for i in range(20):
        np.save(tmp_path / f"f{i:02d}.npy", np.arange(100))
    reader = ranges.ArrayReader({"path": str(tmp_path), "most": "10"})
    assert [(p.name, p.first, p.last) for p in reader.partitions()] == [("f00.npy", 0, 10)] and reader.opened == 1
    reader = ranges.ArrayReader({"path": str(tmp_path)})
    odd = StringContains(("filename",), "f")
    assert list(reader.pushFilters([EqualTo(("filename",), "f07.npy"), GreaterThanOrEqual(("row",), 20), LessThan(("row",), 25), odd])) == [odd]
    assert [(p.name, p.first, p.last) for p in reader.partitions()] == [("f07.npy", 20, 25)] and reader.opened == 1


def test_filters_reach_the_reader(spark, tmp_path):
    np.arange(10_000, dtype="<u2").tofile(tmp_path / "tokens_00000.bin")
    np.arange(500, dtype="<u2").tofile(tmp_path / "tokens_00001.bin")
    df = readers.read_token_words(spark, str(tmp_path / "*.bin"), partition_bytes=2000)
    assert df.rdd.getNumPartitions() == 11 and df.count() == 10_500
    some = df.where("filename = 'tokens_00000.bin' and pos >= 4000 and pos < 4010")
    assert some.rdd.getNumPartitions() == 1 and [r.token for r in some.orderBy("pos").collect()] == list(range(4000, 4010))
    assert readers.read_token_words(spark, str(tmp_path / "*.bin"), most=10_003).groupBy("filename").count().orderBy("filename").collect() == [("tokens_00000.bin", 10_000), ("tokens_00001.bin", 3)]
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number"):
        readers.read_token_words(spark, str(tmp_path / "odd.bin")).collect()


# ---- progress ----------------------------------------------------------------------------------------------------------------
def test_jobs_tell_how_far_they_are(spark):
    told = []
    with progress.watching(spark, lambda s: told.append((s.done, s.total, s.percent, s.line())), every=0.1):
        spark.range(0, 24, 1, 24).select(F.udf(lambda x: __import__("time").sleep(0.15) or x, "long")("id")).collect()
    assert any(0 < p < 100 for _, _, p, _ in told), told
    assert told[-1][0] == told[-1][1] == 24 and told[-1][2] == 100.0
    assert progress.State().left is None and progress.State().percent == 0.0


def test_what_is_written_counts_itself(spark, tmp_path):
    df, told = progress.observed(frames(spark), shards=F.max("shard_id"))
    files.write_parquet(df, str(tmp_path / "p"))
    assert told.get == {"frames": 24, "cells": 96, "shards": 2}


def test_streams_tell_rows_and_batches(spark, tmp_path):
    listener = progress.StreamProgress()
    spark.streams.addListener(listener)
    try:
        for i in range(3):
            spark.range(10).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        stream.writeStream.format("noop").queryName("told").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(50):
            if listener.queries.get("told") and listener.queries["told"].over:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert (listener.queries["told"].batches, listener.queries["told"].rows, listener.queries["told"].error) == (3, 30, None)
