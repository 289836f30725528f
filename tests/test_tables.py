import hashlib
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from frameloom.errors import InvalidParams, ManifestError
from frameloom.plans.manifest import load, parse
from frameloom.plans.runner import ALL, NONE, main, run
from frameloom.sources.tables import cells_of, shard_of, table_frames

TASK = {"name": "t", "generator": "table", "seed": 3, "output_format": "Text"}


def manifest(out, **config):
    return {"global": {"output_dir": str(out), "num_threads": 1}, "tasks": [TASK | {"params": {"extensions": {"table": config}}}]}


def written(spark, tmp_path, rows, columns, **config):
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "in"))
    return {"path": str(tmp_path / "in"), "sample": "k", "order": ["i"], "cells": ["x"], "shards": 3} | config


def test_every_row_is_a_frame_of_its_samples_shard(spark, tmp_path):
    rows = [(s if s < 9 else None, i, (65 + i) if i != 2 else None, "task", -i) for s in range(10) for i in (3, 1, 2, 0)]
    config = written(spark, tmp_path, rows, "k int, i int, x smallint, task string, pos long", label="task")  # columns with the names of a frame's
    out = table_frames(spark, config, "t", 3).orderBy("sample_id", "pos").collect()
    assert len(out) == len(rows) and {r.task for r in out} == {"t"} and {r.label for r in out} == {"task"}
    assert [(r.pos, list(r.state)) for r in out[:4]] == [(0, [65]), (1, [66]), (2, [0]), (3, [68])] and out[0].sample_id is None
    for r in out:
        assert r.shard_id == int(hashlib.md5(("" if r.sample_id is None else str(r.sample_id)).encode()).hexdigest()[:8], 16) % 3
    assert table_frames(spark, config | {"where": "i < 2 and k = 4"}, "t", 3).count() == 2


def test_a_manifest_over_a_table_is_reported_shard_by_shard(spark, tmp_path):
    rows = [(s, i, 65 + s) for s in range(10) for i in range(s + 1)]
    config = written(spark, tmp_path, rows, "k long, i long, x long", shards=40)
    path = tmp_path / "m.json"
    path.write_text(json.dumps(manifest(tmp_path / "out", **config)))
    assert main(["run", "-m", str(path), "--no-progress"], spark) == ALL
    first = json.loads((tmp_path / "out/metadata.json").read_text())
    told = first["tasks"][0]
    assert (told["shard_count"], told["sample_count"], told["total_frames"], told["avg_frames_per_sample"]) == (40, 10, 55, 5.5)
    for f in told["output_files"]:
        data = (tmp_path / "out" / f["filename"]).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest(), data.count(b"\n")) == (f["file_size"], f["sha256"], f["frames"])
    assert main(["run", "-m", str(path), "--no-progress"], spark) == ALL  # again: the same files in their places
    again = json.loads((tmp_path / "out/metadata.json").read_text())
    assert again["tasks"][0]["output_files"] == told["output_files"]
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")) == sorted(["metadata.json", *(f["filename"] for f in told["output_files"])])


def test_cells_of_columns_and_arrays(spark, tmp_path):
    rows = spark.createDataFrame([([1.5, None], True, 2, Decimal("0.5")), (None, None, None, None)], "a array<float>, b boolean, c int, d decimal(3, 1)")
    out = rows.select(cells_of(rows, ["a"]).alias("a"), cells_of(rows, ["b"]).alias("b"), cells_of(rows, ["c", "c"]).alias("c"), cells_of(rows, ["c", "d"]).alias("d")).collect()
    assert [list(v) for v in out[0]] == [[1.5, 0.0], [True], [2, 2], [2.0, 0.5]] and [list(v) for v in out[1]] == [[], [False], [0, 0], [0.0, 0.0]]
    for names in (["s"], ["b", "c"]):
        with pytest.raises(InvalidParams):
            cells_of(rows.withColumn("s", F.lit("x")), names)


def test_an_empty_table_writes_no_file(spark, tmp_path):
    config = written(spark, tmp_path, [], "k long, i long, x long")
    told = run(spark, parse(manifest(tmp_path / "out", **config)))
    assert told["summary"] | {"elapsed_ms": 0} == told["summary"] | {"total_files": 0, "total_frames": 0, "failed_shard_count": 0, "elapsed_ms": 0}


@pytest.mark.parametrize("wrong", [{"sample": "no"}, {"sample": "x"}, {"cells": ["s"]}, {"path": "/nowhere/at/all"}])
def test_a_table_that_cannot_be_read_fails_its_task(spark, tmp_path, wrong):
    config = written(spark, tmp_path, [(1, 1, 0.5, "a")], "k long, i long, x double, s string") | wrong
    path = tmp_path / "m.json"
    path.write_text(json.dumps(manifest(tmp_path / "out", **config)))
    assert main(["run", "-m", str(path), "--no-progress"], spark) == NONE
    assert json.loads((tmp_path / "out/metadata.json").read_text())["summary"]["failed_shard_count"] == 3


@pytest.mark.parametrize("config", [{}, {"path": "p", "sample": "k", "order": "i", "cells": ["x"]}, {"path": "p", "sample": "k", "order": ["i"], "cells": ["x"], "shards": 0}])
def test_what_a_table_needs(config):
    with pytest.raises(ManifestError, match="table"):
        parse(manifest("out", **config)).validate()


def test_a_generators_task_still_needs_its_count():
    with pytest.raises(ManifestError, match="count"):
        load(json.dumps({"tasks": [{"name": "a", "generator": "ca", "seed": 0}]}))


def test_samples_spread_over_shards(spark):
    sizes = [r["count"] for r in spark.range(3000).groupBy(shard_of(F.col("id"), 16)).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1.4 * min(sizes)
