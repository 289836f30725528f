"""Manifests: tasks as data, checked before anything runs."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from frameloom.errors import ManifestError
from frameloom.operators.processors import PROCESSORS
from frameloom.sinks.files import FORMATS
from frameloom.sources.kernels import GENERATORS
from frameloom.sources.tables import TABLE, problems as table_problems

#: Shards for each worker thread where a task does not say.
SHARDS_PER_THREAD = 4


@dataclass(frozen=True)
class Task:
    name: str
    generator: str
    count: int
    seed: int
    seq_length: int = 0
    extensions: dict = field(default_factory=dict)
    pipeline: tuple[str, ...] = ()
    output_format: str | None = None
    shard_size: int | None = None

    def generator_config(self) -> dict:
        """The parameters under the generator's name or, where it has none there, the extensions themselves."""
        own = self.extensions.get(self.generator)
        return dict(own) if isinstance(own, dict) else {k: v for k, v in self.extensions.items() if k not in ("pipeline_config", "sink_config")}

    def steps(self) -> list[tuple[str, dict]]:
        configs = self.extensions.get("pipeline_config") or {}
        return [(name, dict(configs.get(name) or {})) for name in self.pipeline]

    def samples_per_shard(self, threads: int) -> int:
        return self.shard_size or max(1, -(-self.count // (SHARDS_PER_THREAD * max(1, threads))))

    def shard_count(self, threads: int) -> int:
        """A table's shards are told or follow from the threads; a generator's from the samples."""
        if self.generator == TABLE:
            return self.generator_config().get("shards", SHARDS_PER_THREAD * max(1, threads))
        return -(-self.count // self.samples_per_shard(threads))

    def samples_of(self, shard: int, threads: int) -> int:
        """How many samples a generator's shard has; a table's are known when it is read."""
        size = self.samples_per_shard(threads)
        return 0 if self.generator == TABLE else min(size, self.count - shard * size)


@dataclass(frozen=True)
class Manifest:
    output_dir: str
    tasks: tuple[Task, ...]
    default_format: str = "Parquet"
    num_threads: int | None = None
    log_level: str = "info"
    shard_max_sequences: int = 10_000
    stream_write: bool = True

    def format_of(self, task: Task) -> str:
        return task.output_format or self.default_format

    def with_overrides(self, **given) -> Manifest:
        return replace(self, **{k: v for k, v in given.items() if v is not None})

    def validate(self) -> Manifest:
        problems = []
        if not self.tasks:
            problems.append("there is no task")
        if not self.output_dir:
            problems.append("output_dir is empty")
        if self.num_threads is not None and self.num_threads <= 0:
            problems.append("num_threads must be positive")
        if self.shard_max_sequences <= 0:
            problems.append("shard_max_sequences must be positive")
        if self.default_format not in FORMATS:
            problems.append(f"no format {self.default_format!r}")
        names = [t.name for t in self.tasks]
        problems += [f"two tasks are named {n!r}" for n in sorted({n for n in names if names.count(n) > 1})]
        for t in self.tasks:
            if not t.name:
                problems.append("a task has no name")
            if t.generator == TABLE:
                problems += [f"{t.name}: {p}" for p in table_problems(t.generator_config())]
            elif t.count <= 0:
                problems.append(f"{t.name}: count must be positive")
            if t.shard_size is not None and t.shard_size <= 0:
                problems.append(f"{t.name}: shard_size must be positive")
            if t.generator != TABLE and t.generator not in GENERATORS:
                problems.append(f"{t.name}: no generator {t.generator!r}")
            if t.output_format is not None and t.output_format not in FORMATS:
                problems.append(f"{t.name}: no format {t.output_format!r}")
            problems += [f"{t.name}: no processor {p!r}" for p in t.pipeline if p not in PROCESSORS]
        if problems:
            raise ManifestError("; ".join(problems))
        return self


def _is(value, kind, what: str):
    if not isinstance(value, kind) or isinstance(value, bool) and kind is int:
        raise ManifestError(f"{what} must be {getattr(kind, '__name__', kind)}, not {value!r}")
    return value


def parse(data: dict) -> Manifest:
    """A manifest from its mapping; pipeline entries are names, or mappings with a name and a config."""
    made = []
    top = _is(_is(data, dict, "a manifest").get("global", {}), dict, "global")
    for i, t in enumerate(_is(data.get("tasks"), list, "tasks")):
        _is(t, dict, f"task {i}")
        missing = [k for k in ("name", "generator", "count", "seed") if k not in t and not (k == "count" and t.get("generator") == TABLE)]
        if missing:
            raise ManifestError(f"task {i} lacks {', '.join(missing)}")
        params = _is(t.get("params") or {}, dict, f"task {i}: params")
        extensions = dict(params.get("extensions") or {})
        configs, names = dict(extensions.get("pipeline_config") or {}), []
        for p in t.get("pipeline") or []:
            if isinstance(p, dict):
                names.append(_is(p.get("name"), str, f"task {i}: a pipeline entry's name"))
                configs[names[-1]] = p.get("config") or {}
            else:
                names.append(_is(p, str, f"task {i}: a pipeline entry"))
        if configs:
            extensions["pipeline_config"] = configs
        made.append(Task(_is(t["name"], str, "name"), _is(t["generator"], str, "generator"), _is(t.get("count", 0), int, "count"), _is(t["seed"], int, "seed"), _is(params.get("seq_length", 0), int, "seq_length"), extensions, tuple(names), t.get("output_format"), t.get("shard_size")))
    keys = ("default_format", "num_threads", "log_level", "shard_max_sequences", "stream_write")
    return Manifest(_is(top.get("output_dir", ""), str, "output_dir"), tuple(made), **{k: top[k] for k in keys if top.get(k) is not None})


def load(text: str) -> Manifest:
    """A manifest from YAML, or from JSON where the YAML library is absent."""
    try:
        import yaml
    except ImportError:
        import json

        try:
            return parse(json.loads(text))
        except json.JSONDecodeError as e:
            raise ManifestError(f"without a YAML library a manifest must be JSON: {e}") from e
    try:
        return parse(yaml.safe_load(text))
    except yaml.YAMLError as e:
        raise ManifestError(f"no YAML: {e}") from e
