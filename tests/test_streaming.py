import pytest
from pyspark.sql import functions as F

from frameloom.model import schema
from frameloom.operators.processors import chain
from frameloom.sources.generate import register_sources
from frameloom.streaming import stateful


def streamed(spark, tmp_path, rows, run, name):
    parts = [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema("int")).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(schema("int")).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = run(source).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sorted((r.sample_id, r.step_index, list(r.state)) for r in spark.table(name).collect())


@pytest.mark.parametrize(("name", "run", "steps"), [
    ("dedup", stateful.stream_dedup, [("dedup", {})]), ("diff", stateful.stream_diff, [("diff_encoder", {})]),
    ("stitch", lambda f: stateful.stream_stitch(f, 2), [("sequence_stitcher", {"frames_per_sequence": 2})]),
])
def test_streams_agree_with_batch(spark, tmp_path, name, run, steps):
    cells = [1, 1, 0, 2, 2, 3, 3, 1]
    rows = [("t", 0, s, i, i, [c + s * (c > 0), c], None) for i, c in enumerate(cells) for s in (0, 1)]
    batch = chain(spark.createDataFrame(rows, schema("int")), steps)
    expected = sorted((r.sample_id, r.step_index, list(r.state)) for r in batch.collect())
    assert streamed(spark, tmp_path, rows, run, f"out_{name}") == expected


def frames_of(spark, rows):
    return spark.createDataFrame(rows, schema("int"))


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = [("t", 0, s, i, i, [i // 3], None) for i in range(40) for s in (0, 1)]
    for i in range(4):
        part = frames_of(spark, rows[20 * i : 20 * i + 20])
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema("int")).parquet(str(tmp_path / "in"))
        stateful.run_through(stateful.stream_dedup(source, False), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r.sample_id, r.pos) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(s, i) for s in (0, 1) for i in range(0, 40, 3)]


def test_a_shorter_rest_goes_out_when_its_sample_is_idle(spark, tmp_path):
    frames_of(spark, [("t", 0, 0, i, i, [i], None) for i in range(5)]).coalesce(1).write.parquet(str(tmp_path / "in/0"))
    source = spark.readStream.schema(schema("int")).parquet(str(tmp_path / "in/*"))
    q = stateful.stream_stitch(source, 2, idle=500).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for i in range(1, 30):
            if spark.table("idle").count() >= 3:
                break
            q.awaitTermination(2)
            frames_of(spark, [("t", 0, 9, i, i, [0], None)]).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))  # a batch of another sample
    finally:
        q.stop()
    got = sorted((r.pos, list(r.state)) for r in spark.table("idle").where("sample_id = 0").collect())
    assert got == [(0, [0, 1]), (1, [2, 3]), (2, [4])]


@pytest.mark.parametrize("per_batch", [1, 7, 100])
def test_retained_frames_are_the_last_ones(spark, tmp_path, per_batch):
    rows = [("t", 0, i % 3 if i % 3 else None, i, i, [i], f"l{i}") for i in range(20)]
    frames = frames_of(spark, rows)
    stateful.replay_files(frames, "pos", per_batch, str(tmp_path / "in"))
    stateful.run_through(stateful.stream_last(stateful.replayed(spark, str(tmp_path / "in"), 2), 4), str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    told = spark.read.parquet(str(tmp_path / "out"))
    newest = {}
    for r in told.collect():
        newest.setdefault(r.sample_id, {}).setdefault(r._epoch, []).append(r)
    want = stateful.last_frames(frames, 4).collect()
    for sample, epochs in newest.items():
        got = sorted((r.place, r.pos, list(r.state), r.label) for r in epochs[max(epochs)])
        assert got == sorted((r.place, r.pos, list(r.state), r.label) for r in want if r.sample_id == sample)
        n = sum(r[2] == sample for r in rows)
        assert {r.base for r in epochs[max(epochs)]} == {max(0, n - 4)}


def test_replay_keeps_order_and_limits_batches(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") * 37 % 1009).alias("k"), F.col("id").alias("v"))
    stateful.replay_files(rows, "k", 9, str(tmp_path / "in"))
    seen = []
    stream = stateful.replayed(spark, str(tmp_path / "in"), 2)
    q = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, n: seen.append(sorted(r.k for r in df.collect()))).start()
    q.awaitTermination()
    assert [len(b) for b in seen] == [18] * 5 + [10] and sum(seen, []) == sorted(r.k for r in rows.collect())


def test_endless_source(spark, tmp_path):
    register_sources(spark)
    stream = spark.readStream.format("frameloom").options(generator="ca", config='{"width": 4}', count="2", seq_length="20", frames_per_batch="8").load()
    q = stream.writeStream.format("memory").queryName("endless").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(60):
            if spark.table("endless").count() >= 40:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    rows = spark.table("endless")
    assert rows.count() == rows.select("sample_id", "step_index").distinct().count() >= 16


def test_last_frames_and_windows(spark):
    rows = [("t", 0, 0, i, i, [i], None) for i in range(9)]
    kept = stateful.last_frames(spark.createDataFrame(rows, schema("int")), 3)
    assert [(r.pos, r.place) for r in kept.orderBy("pos").collect()] == [(6, 0), (7, 1), (8, 2)]
    events = spark.createDataFrame([(1, "a", 2.0), (2, "a", 3.0)], "s int, event_type string, value double").withColumn("ts", F.timestamp_seconds("s"))
    assert stateful.windowed_counts(events).first().n == 2


def test_endless_batches_go_on_where_they_were():
    from frameloom.sources import generate as G

    plan = {"generator": "ca", "config": {"width": 6}, "steps": 0, "seed": 3, "task": "t", "count": 2, "size": 0}
    reader, at, got = G.EndlessReader(plan, 4), {"step": 0}, []
    for _ in range(3):
        rows, at = reader.read(at)
        live = reader.live
        got += list(rows)
    assert reader.live is live and reader.at == 12  # no sample was run anew
    anew = list(G.EndlessReader(plan, 4).readBetweenOffsets({"step": 0}, {"step": 12}))
    assert sorted(got, key=lambda r: r[2:4]) == sorted(anew, key=lambda r: r[2:4])
    assert list(reader.readBetweenOffsets({"step": 4}, {"step": 8})) == [r for r in got if 4 <= r[3] < 8]


@pytest.mark.parametrize(("generator", "config"), [("lorenz", {}), ("lsystem", {}), ("ca", {"width": 8})])
def test_endless_samples_are_made_by_executors_and_go_on_after_a_restart(spark, tmp_path, generator, config):
    from frameloom.sources.generate import generate, generate_stream

    stream = lambda: generate_stream(spark, generator, config, count=7, frames_per_batch=3, seq_length=8, seed=5, shard_size=4, blocks=3)
    assert stream().isStreaming
    for _ in range(4):  # each run is a new query on the old checkpoint
        stateful.run_through(stream(), str(tmp_path / "out"), str(tmp_path / "cp"))
    key = ["task", "shard_id", "sample_id", "pos", "step_index", "state"]
    expected = generate(spark, generator, config, count=7, seq_length=8, seed=5, shard_size=4)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(key).collect())) == sorted(map(str, expected.select(key).collect()))


def test_a_block_of_samples_goes_on_or_runs_anew():
    import json

    from frameloom.sources import generate as G

    plan = {"generator": "logistic", "config": {}, "count": 5, "steps": 0, "seed": 9, "task": "t", "size": 5, "blocks": 2}
    made = lambda a, b: [r for x in G.endless_batches(json.dumps(plan), 1, a, b) for r in x.select(["sample_id", "pos", "state"]).to_pylist()]
    whole = made(0, 9)
    assert {r["sample_id"] for r in whole} == {2, 3, 4} and len(whole) == 27
    assert made(0, 4) + made(4, 9) == whole  # the second goes on
    assert made(4, 9) == whole[12:]  # nothing is kept for step 4 any more


def test_a_processor_is_called_for_a_lane_of_samples(spark, tmp_path):
    class Counted(stateful.FrameProcessor):
        def frames(self, made, spans, timers):
            return made.assign(label=[f"{len(spans)}"] * len(made)).iloc[[i for _, i, _ in spans]]

    n = 20_000
    spark.range(n).selectExpr("'t' AS task", "0 AS shard_id", "id AS sample_id", "0L AS pos", "0L AS step_index", "array(id) AS state", "CAST(NULL AS STRING) AS label").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema("int")).parquet(str(tmp_path / "in"))
    stateful.run_through(stateful._grouped(source, Counted("int")), str(tmp_path / "out"), str(tmp_path / "cp"))
    told = [int(r.label) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(told) == n and round(sum(1 / k for k in told)) <= stateful.LANES  # calls


def test_samples_without_a_part_of_their_name(spark, tmp_path):
    names = [("t", 0, None), (None, 0, 1), ("t", None, 1), ("t", 0, 1), (None, None, None)]
    rows = [(*name, i, i, [i // 3 + k], None) for k, name in enumerate(names) for i in range(12)]
    frames = frames_of(spark, rows)
    stateful.replay_files(frames.withColumn("order", F.col("pos") * 100 + F.xxhash64("task", "shard_id", "sample_id") % 50), "order", 20, str(tmp_path / "in"))
    source = stateful.replayed(spark, str(tmp_path / "in")).drop("order")
    stateful.run_through(stateful.stream_diff(source), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = [(r.task, r.shard_id, r.sample_id, r.pos, r.state[0]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    want = [(*name, i, k if i == 0 else int(i % 3 == 0)) for k, name in enumerate(names) for i in range(12)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
