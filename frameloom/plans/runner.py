"""Running a manifest: generate, process, write, report. A shard or a task that fails is a row of the report, not an exception."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import time
from collections.abc import Callable
from contextlib import nullcontext
from datetime import UTC, datetime
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession, functions as F

from frameloom.errors import ConfigError, FrameloomError
from frameloom.functions.seeds import shard_seed
from frameloom.lineage import checkpointed
from frameloom.operators.processors import chain
from frameloom.plans.manifest import Manifest, Task, load
from frameloom.plans.progress import State, watching
from frameloom.sinks import files
from frameloom.sources.generate import generate
from frameloom.sources.tables import TABLE, table_frames

LOG = logging.getLogger("frameloom")
#: Exit codes: all went well, some shards failed, all failed or nothing could run.
ALL, SOME, NONE = 0, 1, 2
LEVELS = {"trace": 5, "debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR}


def task_frames(spark: SparkSession, task: Task, threads: int) -> tuple[DataFrame, DataFrame]:
    """The processed frames of the shards that went well, and (task, shard_id, error) of the others. Generation runs once."""
    if task.generator == TABLE:
        none = spark.createDataFrame([], "task string, shard_id int, error string")
        return checkpointed(chain(table_frames(spark, task.generator_config(), task.name, task.shard_count(threads)), task.steps())), none
    made = checkpointed(generate(spark, task.generator, task.generator_config(), task.count, task.seq_length, task.seed, task.name, task.samples_per_shard(threads), isolate=True))
    failed = made.where("error is not null").groupBy("task", "shard_id").agg(F.min("error").alias("error"))
    good = made.where("error is null").drop("error").join(failed, ["task", "shard_id"], "left_anti")
    return chain(good, task.steps()), failed


def shard_rows(task: Task, results: DataFrame, failed: DataFrame, shards: int) -> DataFrame:
    """A row for each shard of a task, those without a file included: what was written, joined with what failed before."""
    known = results.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard_id"))
    why = failed.select("shard_id", F.col("error").alias("_why"))
    told = known.join(results.drop("task", "seed", "format"), "shard_id", "left").join(why, "shard_id", "left")
    numbers = [F.coalesce(n, F.lit(0)).alias(n) for n in ("frames", "bytes")]
    return told.select(F.lit(task.name).alias("task"), "shard_id", "samples", *numbers, "filename", "sha256", F.coalesce("_why", "error").alias("error")).orderBy("shard_id")


def run_task(spark: SparkSession, manifest: Manifest, task: Task, threads: int) -> list[dict]:
    """Rows of the report, one for each shard."""
    fmt = manifest.format_of(task)
    frames, failed = task_frames(spark, task, threads)
    results = files.write_shards(frames, manifest.output_dir, fmt, task.seed, task.extensions.get("sink_config"))
    rows = []
    for r in shard_rows(task, results, failed, task.shard_count(threads)).toLocalIterator():  # a row for each file
        row = r.asDict()
        if row["samples"] is None:
            row["samples"] = task.samples_of(r["shard_id"], threads)
        rows.append(row | {"seed": int(shard_seed(task.seed, r["shard_id"])), "format": fmt})
        LOG.debug("task %s shard %s: %s frames", task.name, r["shard_id"], row["frames"])
    LOG.info("task %s: %s of %s shards", task.name, sum(r["error"] is None for r in rows), len(rows))
    return rows


def run(spark: SparkSession, manifest: Manifest, tell: Callable[[str, State], None] | None = None) -> dict:
    """Run all tasks and write metadata.json; returns what it holds. tell gets a task's name and how far it is, while it runs."""
    manifest.validate()
    threads = manifest.num_threads or spark.sparkContext.defaultParallelism
    began, clock, tasks = datetime.now(UTC), time.monotonic(), []
    for task in manifest.tasks:
        start = time.monotonic()
        try:
            with watching(spark, lambda state, name=task.name: tell(name, state)) if tell else nullcontext():
                rows = run_task(spark, manifest, task, threads)
        except (FrameloomError, pyspark.errors.PySparkException, ValueError, OSError) as e:
            LOG.error("task %s failed: %s", task.name, e)
            rows = [{"task": task.name, "shard_id": s, "seed": int(shard_seed(task.seed, s)), "samples": 0, "frames": 0, "bytes": 0, "filename": None, "sha256": None, "format": manifest.format_of(task), "error": f"{type(e).__name__}: {str(e)[:500]}"} for s in range(task.shard_count(threads))]
        good = [r for r in rows if r["error"] is None]
        total = lambda k, rows=good: sum(r[k] or 0 for r in rows)
        tasks.append({
            "task_name": task.name, "generator": task.generator, "params_snapshot": {"seq_length": task.seq_length, "extensions": task.extensions}, "base_seed": task.seed, "sample_count": total("samples", rows) if task.generator == TABLE else task.count, "shard_count": len(rows),
            "total_frames": total("frames"), "total_bytes": total("bytes"), "avg_frames_per_sample": total("frames") / total("samples") if total("samples") else 0.0,
            "output_files": [{"filename": r["filename"], "format": r["format"], "shard_id": r["shard_id"], "seed": r["seed"], "frames": r["frames"], "file_size": r["bytes"], "sha256": r["sha256"]} for r in good if r["filename"]],
            "elapsed_ms": int(1000 * (time.monotonic() - start)), "failed_shards": [{"shard_id": r["shard_id"], "seed": r["seed"], "error_message": r["error"]} for r in rows if r["error"] is not None],
        })
    add = lambda k: sum(t[k] for t in tasks)
    report = {
        "software_version": "0.1.0", "dependency_versions": {"pyspark": pyspark.__version__, "python": sys.version.split()[0]}, "start_time": began.isoformat(), "end_time": datetime.now(UTC).isoformat(), "elapsed_ms": int(1000 * (time.monotonic() - clock)),
        "global_config": {"output_dir": manifest.output_dir, "default_format": manifest.default_format, "num_threads": manifest.num_threads, "log_level": manifest.log_level}, "tasks": tasks,
        "summary": {"total_tasks": len(tasks), "total_samples": add("sample_count"), "total_frames": add("total_frames"), "total_bytes": add("total_bytes"), "total_files": sum(len(t["output_files"]) for t in tasks), "failed_shard_count": sum(len(t["failed_shards"]) for t in tasks)},
    }
    save(spark, f"{manifest.output_dir}/metadata.json", json.dumps(report, indent=2))
    return report


def save(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file on any store that Spark knows."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def exit_code(report: dict) -> int:
    failed, shards = report["summary"]["failed_shard_count"], sum(t["shard_count"] for t in report["tasks"])
    return ALL if not failed else NONE if failed == shards else SOME


class JsonLines(logging.Formatter):
    """A record as one line of JSON."""

    def format(self, record: logging.LogRecord) -> str:
        line = {"timestamp": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "target": record.name, "message": record.getMessage()}
        return json.dumps(line | ({"exception": self.formatException(record.exc_info)} if record.exc_info else {}), ensure_ascii=False)


def init_logging(level: str, file: str | None = None) -> list[logging.Handler]:
    """Log to the console and, where a file is named, as lines of JSON to it. A file that cannot be made is a warning. Handlers of
    an earlier call go."""
    if level.lower() not in LEVELS:
        raise ConfigError(f"no log level {level!r}; there are {', '.join(LEVELS)}")
    for handler in list(LOG.handlers):
        LOG.removeHandler(handler)
        handler.close()
    console = logging.StreamHandler()
    console.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    handlers: list[logging.Handler] = [console]
    if file:
        try:
            Path(file).parent.mkdir(parents=True, exist_ok=True)
            handlers.append(logging.FileHandler(file, "w", encoding="utf-8"))
            handlers[-1].setFormatter(JsonLines())
        except OSError as e:
            print(f"warning: no log file {file}: {e}", file=sys.stderr)
    for handler in handlers:
        LOG.addHandler(handler)
    LOG.setLevel(LEVELS[level.lower()])
    LOG.propagate = False
    return handlers


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="frameloom")
    commands = parser.add_subparsers(dest="command", required=True)
    r = commands.add_parser("run", help="run a manifest")
    r.add_argument("-m", "--manifest", required=True)
    r.add_argument("-o", "--output-dir")
    r.add_argument("-f", "--format", choices=sorted(files.FORMATS))
    r.add_argument("-t", "--threads", type=int)
    r.add_argument("-l", "--log-level", default=None)
    r.add_argument("--log-file")
    r.add_argument("--stream-write", nargs="?", const=True, type=lambda x: {"true": True, "false": False}[x.lower()])
    r.add_argument("--no-progress", action="store_true")
    v = commands.add_parser("view", help="print frames of a generator")
    v.add_argument("-g", "--generator", required=True)
    v.add_argument("-c", "--config", default="{}")
    v.add_argument("-s", "--seed", type=int, default=0)
    v.add_argument("-n", "--steps", type=int, default=16)
    given = parser.parse_args(args)
    try:
        if given.command == "view":
            from frameloom.sources.kernels import GENERATORS, sample_frames

            for state in sample_frames(GENERATORS.get(given.generator)(json.loads(given.config)), given.seed, given.steps):
                print(" ".join(str(int(x) if isinstance(x, bool) else x) for x in state))
            return ALL
        manifest = load(Path(given.manifest).read_text(encoding="utf-8")).with_overrides(output_dir=given.output_dir, default_format=given.format, num_threads=given.threads, log_level=given.log_level, stream_write=given.stream_write)
        init_logging(manifest.log_level, given.log_file)
        manifest.validate()
        show = None if given.no_progress else lambda name, state: print(f"\r{name}: {state.line()}", end="", file=sys.stderr, flush=True)
        report = run(spark or SparkSession.builder.appName("frameloom").getOrCreate(), manifest, show)
        if show:
            print(file=sys.stderr)
    except (FrameloomError, OSError, json.JSONDecodeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return NONE
    s = report["summary"]
    print(f"{s['total_tasks']} tasks, {s['total_samples']} samples, {s['total_frames']} frames, {s['total_files']} files, {s['failed_shard_count']} failed shards")
    return exit_code(report)


if __name__ == "__main__":
    sys.exit(main())
