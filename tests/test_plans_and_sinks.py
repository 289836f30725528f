import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.errors import ConfigError, DuplicateName, ManifestError, PipelineError, SerializationError, SinkError
from frameloom.model import schema
from frameloom.plans.manifest import load
from frameloom.operators.processors import chain
from frameloom.plans.runner import ALL, NONE, init_logging, main
from frameloom.sinks import files
from frameloom.sources import readers
from frameloom.sources.generate import generate

MANIFEST = """
global: {{output_dir: "{out}", default_format: {fmt}, num_threads: 2}}
tasks:
  - {{name: rows, generator: ca, count: 5, seed: 42, shard_size: 2, params: {{seq_length: 3, extensions: {{ca: {{rule: 30, width: 8}}}}}}, pipeline: [{pipeline}]}}
  - {{name: flow, generator: lorenz, count: 2, seed: 1, params: {{seq_length: 4}}, pipeline: [normalizer, dedup, diff_encoder, token_mapper]}}
"""


@pytest.mark.parametrize("fmt", sorted(files.FORMATS))
def test_manifest_runs(spark, tmp_path, fmt):
    path = tmp_path / "m.yaml"
    pipeline = "token_mapper" if fmt == "Text" else ""
    path.write_text(MANIFEST.format(out=tmp_path / "out", fmt=fmt, pipeline=pipeline))
    assert main(["run", "-m", str(path)], spark) == ALL
    report = json.loads((tmp_path / "out/metadata.json").read_text())
    assert report["summary"]["total_samples"] == 7 and report["summary"]["failed_shard_count"] == 0
    rows = report["tasks"][0]
    assert rows["shard_count"] == 3 and rows["total_frames"] == 15 and rows["avg_frames_per_sample"] == 3
    assert not list((tmp_path / "out").rglob("*.tmp"))


@pytest.mark.parametrize("text", [
    "", "tasks: [", "global: {output_dir: x}\ntasks: []", "global: {output_dir: ''}\ntasks: [{name: a, generator: ca, count: 1, seed: 0}]",
    "global: {output_dir: x}\ntasks: [{name: a, generator: ca, count: 0, seed: 0}]", "global: {output_dir: x}\ntasks: [{name: a, generator: no, count: 1, seed: 0}]",
    "global: {output_dir: x}\ntasks: [{name: a, generator: ca, count: 1, seed: 0, pipeline: [no]}]",
    "global: {output_dir: x}\ntasks: [{name: a, generator: ca, count: 1, seed: 0}, {name: a, generator: ca, count: 1, seed: 0}]",
])
def test_bad_manifests(text):
    with pytest.raises(ManifestError):
        load(text).validate()


def test_bad_task_is_reported(spark, tmp_path):
    path = tmp_path / "m.yaml"
    path.write_text(f"global: {{output_dir: '{tmp_path}/out'}}\ntasks: [{{name: a, generator: ca, count: 2, seed: 0, params: {{seq_length: 2, extensions: {{ca: {{rule: 999}}}}}}}}]")
    assert main(["run", "-m", str(path)], spark) == NONE
    report = json.loads((tmp_path / "out/metadata.json").read_text())
    assert report["summary"]["failed_shard_count"] == report["tasks"][0]["shard_count"] > 0
    assert main(["run", "-m", str(tmp_path / "none.yaml")], spark) == NONE


def test_pipeline_entries_with_config():
    task = load("global: {output_dir: x}\ntasks: [{name: a, generator: ca, count: 1, seed: 0, pipeline: [{name: token_mapper, config: {start_codepoint: 5}}]}]").validate().tasks[0]
    assert task.steps() == [("token_mapper", {"start_codepoint": 5})]


def test_binary_round_trip(spark, tmp_path):
    made = generate(spark, "lorenz", {}, count=3, seq_length=4, seed=5, shard_size=2)
    out = files.write_shards(made, str(tmp_path), "Binary", 5).orderBy("shard_id").collect()
    assert [(r.frames, r.samples, r.error) for r in out] == [(8, 2, None), (4, 1, None)]
    data = (tmp_path / out[0].filename).read_bytes()
    assert struct.unpack_from("<4sIQI", data) == (b"SGEN", 2, 8, 3) and len(data) == out[0].bytes == 20 + 8 * (9 + 8 + 27 + 4 - 0)
    back = readers.read_binary(spark, f"{tmp_path}/*.bin")
    assert sorted(map(str, back.select("sample_id", "step_index", "state").collect())) == sorted(map(str, made.select("sample_id", "step_index", "state").collect()))


def test_arrays_load(spark, tmp_path):
    made = generate(spark, "ca2d", {"rows": 2, "cols": 3}, count=4, seq_length=5, seed=5)
    name = files.write_shards(made, str(tmp_path / "a"), "Npy", 5).first().filename
    assert np.load(tmp_path / "a" / name).shape == (20, 6)
    name = files.write_shards(made, str(tmp_path / "b"), "NpyBatch", 5, {"num_frames": 5, "rows": 2, "cols": 3, "channels": 1}).first().filename
    array = np.load(tmp_path / "b" / name)
    assert array.shape == (4, 5, 2, 3, 1) and array.dtype == np.int32
    assert readers.read_npy(spark, f"{tmp_path}/b/*.npy").count() == 4 and readers.read_npy(spark, f"{tmp_path}/b/*.npy", 2).count() == 2
    wrong = files.write_shards(made, str(tmp_path / "c"), "NpyBatch", 5, {"num_frames": 7}).first()
    assert wrong.error and not list((tmp_path / "c").iterdir())


def test_uneven_frames_fail_their_shard_alone(spark, tmp_path):
    rows = [("t", 0, 0, 0, 0, [1], None), ("t", 0, 0, 1, 1, [1, 2], None), ("t", 1, 0, 0, 0, [3], None)]
    out = files.write_shards(spark.createDataFrame(rows, schema("int")), str(tmp_path), "Binary").orderBy("shard_id").collect()
    assert out[0].error and out[1].error is None and len(list(tmp_path.iterdir())) == 1


def test_compatible_parquet_and_text(spark, tmp_path):
    made = generate(spark, "lorenz", {}, count=2, seq_length=3, seed=5)
    files.write_compatible_parquet(made, str(tmp_path / "p"))
    back = readers.read_tagged_parquet(spark, str(tmp_path / "p"))
    assert sorted(map(str, back.select("sample_id", "step_index", "state").collect())) == sorted(map(str, made.select("sample_id", "step_index", "state").collect()))
    one = spark.createDataFrame([("t", 0, 7, 0, 0, [72, 105], "x")], schema("int"))
    assert files.text_lines(one, True).first().value == "7:Hi x"
    files.write_text(one, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first().value == "Hi x"
    files.write_parquet(made, str(tmp_path / "n"))
    assert readers.read_frames(spark, str(tmp_path / "n"), ["task"]).count() == 6


def test_names_digests_and_words(spark, tmp_path):
    assert files.file_name("rule30_ca", 1, 0x3039, "parquet") == "rule30_ca_00001_0000000000003039.parquet"
    tokens = spark.range(10).select(F.col("id").alias("pos"), (F.col("id") * 7).alias("token"))
    files.write_token_words(tokens, str(tmp_path / "w"), per_file=4)
    back = readers.read_token_words(spark, f"{tmp_path}/w/*.bin").orderBy("filename", "pos").collect()
    assert [r.token for r in back] == [7 * i for i in range(10)]
    assert files.file_digests(spark, f"{tmp_path}/w/*.bin").where(F.length("sha256") == 64).count() == 3
    with pytest.raises(SerializationError):
        files.cells_as(b"\x09" + b"\0" * 8, "int")
    readers.write_jsonl(spark.createDataFrame([(1, "a")], "idx int, s string"), str(tmp_path / "j"))
    assert readers.read_jsonl(spark, str(tmp_path / "j")).first().s == "a"
    (tmp_path / "d.txt").write_text("0 1 3 2\n\n")
    assert list(readers.read_brackets(spark, str(tmp_path / "d.txt")).first().state) == [0, 1, 3, 2]


def test_cells_keep_their_digits(spark, tmp_path):
    big = [2**53 + 1, -(2**63), 2**63 - 1, 0]
    data = files.encode_cells(np.array(big), "int") + files.encode_cells(np.array([2.0]), "float") + files.encode_cells(np.array([True]), "bool")
    assert files.cells_as(data, "int").to_pylist() == [*big, 2, 1]
    assert files.cells_as(data, "float").to_pylist() == [*map(float, big), 2.0, 1.0] and files.cells_as(data, "bool").to_pylist() == [True, True, True, False, True, True]
    with pytest.raises(SerializationError):
        files.cells_as(files.encode_cells(np.array([0.5]), "float"), "int")
    made = spark.createDataFrame([("t", 0, 1, i, i, big[: i + 1], None) for i in range(4)], schema("int"))
    files.write_compatible_parquet(made, str(tmp_path / "p"))
    back = readers.read_tagged_parquet(spark, str(tmp_path / "p"), "int").orderBy("step_index").collect()
    assert [list(r.state) for r in back] == [big[: i + 1] for i in range(4)]
    assert readers.read_tagged_parquet(spark, str(tmp_path / "p"), "int", readers.named("part-", ".parquet")).count() == 4


def test_failed_attempts_leave_nothing(spark, tmp_path):
    made = spark.createDataFrame([("t", s, 0, i, i, [i], None) for s in (0, 1) for i in range(3)], schema("int"))

    @files.register_sink("Once", "once")
    class Once(files.BinaryShard):
        def frame(self, sample, step, cells, label):
            import os

            flag = self.options["flag"]
            if step == 2 and not os.path.exists(flag):
                open(flag, "w").close()
                raise RuntimeError("the executor goes")  # the task fails, and a local session does not try again
            return super().frame(sample, step, cells, label)

    options = {"flag": str(tmp_path / "flag")}
    with pytest.raises(Exception, match="the executor goes"):
        files.write_shards(made, str(tmp_path / "out"), "Once", 3, options)
    assert not list((tmp_path / "out").iterdir())
    out = files.write_shards(made, str(tmp_path / "out"), "Once", 3, options).collect()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(r.filename for r in out) and {r.frames for r in out} == {3}
    with pytest.raises(DuplicateName):
        files.register_sink("Once", "x")(Once)


def test_token_words_by_shard(spark, tmp_path):
    tokens = spark.range(10).select(F.col("id").alias("pos"), F.col("id").alias("token"), F.when(F.col("id") < 7, 0).otherwise(1).alias("shard"))
    assert files.write_token_words(tokens, str(tmp_path / "w"), shard="shard") == 2
    back = readers.read_token_words(spark, f"{tmp_path}/w/*.bin").groupBy("filename").count().orderBy("filename").collect()
    assert [r["count"] for r in back] == [7, 3] and len(list((tmp_path / "w").iterdir())) == 2
    with pytest.raises(Exception, match="16 bits"):
        files.write_token_words(tokens.withColumn("token", F.lit(70_000)), str(tmp_path / "x"))
    assert not (tmp_path / "x").exists() or not list((tmp_path / "x").iterdir())


def test_logging_and_errors(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"global": {"output_dir": str(tmp_path / "out")}, "tasks": [{"name": "a", "generator": "ca", "count": 2, "seed": 0, "params": {"seq_length": 2}}]}))
    log = tmp_path / "logs/run.jsonl"
    assert main(["run", "-m", str(path), "--log-file", str(log), "--stream-write=false", "--no-progress"], spark) == ALL
    lines = [json.loads(line) for line in log.read_text().splitlines()]
    assert lines and {"timestamp", "level", "target", "message"} <= set(lines[0]) and any("task a" in x["message"] for x in lines)
    with pytest.raises(ConfigError):
        init_logging("loud")
    with pytest.raises(PipelineError):
        chain(spark.range(1), [])


def test_bracket_sequences(spark, tmp_path):
    for shuffled in (False, True):
        made = readers.brackets(spark, 30, 3, 20, 1, shuffled, min_depth=2, max_depth=4, early_end=True)
        seen = []
        for r in made.collect():
            s, depth = list(r.state), np.cumsum([1 if v < 3 else -1 for v in r.state])
            assert all(v < 3 for v in s[:2]) and depth.max() <= 4 and depth[-1] == 0 and (depth[:-1] > 0).all()
            seen.append(len(s))
        assert max(seen) <= 20 and min(seen) < 20
        from frameloom.functions import frames as X

        assert made.where(~(X.shuffle_dyck_valid(F.col("state"), 3) if shuffled else X.dyck_valid(F.col("state"), 3))).count() == 0
    readers.write_brackets(made, str(tmp_path / "d"))
    assert sorted(map(str, readers.read_brackets(spark, str(tmp_path / "d")).collect())) == sorted(map(str, made.select("state").collect()))
    with pytest.raises(ValueError, match="min_depth"):
        readers.brackets(spark, 1, 2, 4, 0, min_depth=3)
