"""Quality without labels: heuristic labellers that overlap, their accuracies by expectation-maximisation, and a linear scorer.

Each labeller says good, bad or nothing of a document. Documents with the same votes form a pattern; there are at most
3 ** len(LABELLERS) patterns, counted over the whole corpus, and expectation-maximisation over these counts estimates how often
each labeller is right on good and on bad documents. The posteriors of a bounded sample then train a linear scorer over hashed
features of whole texts, which scores every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from frameloom.llm._common import checkpointed, fresh, python_ready, table

#: Documents whose posteriors train the scorer at most, of each vote pattern at most, and hashed features.
SAMPLE, PER_PATTERN, FEATURES = 6000, 400, 4096
#: Scores below are rejected.
CUT = 0.25
ROUNDS, STEPS, RATE, DECAY = 100, 400, 1.0, 1e-4

#: 1 small letters and all bytes beyond ASCII, 2 capitals, 3 digits, 4 blanks, 5 marks of ordinary prose, 6 odd signs.
_KIND = np.full(256, 6, np.int64)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[ord(c) for c in " \t\n\r\v\f"]] = 4
_KIND[[ord(c) for c in ".,;:'\"()-?"]] = 5
_KIND[128:] = 1

FIELDS = ("words", "distinct", "repeated", "upper", "odd", "doubled", "bare", "plain", "digits", "marks", "word_length")


def shape(text: str | None) -> np.ndarray:
    """The numbers of FIELDS, on which the labellers and some features rest. Null counts as empty.

    odd, digits and marks are shares of what is not blank; doubled counts odd signs that follow themselves, by word; bare is
    the share of words without letter or digit, plain of those that are letters but for marks at their end.
    """
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kind = _KIND[data]
    low, up, digit, _, marks, odd = (int(k) for k in np.bincount(kind, minlength=7)[1:7])
    words = text.split()
    n, ends = max(1, len(words)), ".,;:!?"
    stems = [w.rstrip(ends) for w in words]
    plain = sum(map(str.isalpha, stems))
    bare = sum(not any(map(str.isalnum, w)) for w in stems if not w.isalpha())
    doubled = int(((data[1:] == data[:-1]) & (kind[1:] == 6)).sum())
    same = sum(map(str.__eq__, words, words[1:]))
    filled = max(1, low + up + digit + marks + odd)
    return np.array([len(words), len(set(words)) / n, same / max(1, n - 1), up / max(1, low + up), odd / filled, doubled / n, bare / n, plain / n, digit / filled, marks / filled, (low + up) / n])


def few_repeats(x: np.ndarray) -> bool:
    return x[0] > 0 and (x[2] < 0.03 or x[2] * x[0] < 1.6)


#: What each labeller says of the numbers of FIELDS: 1 good, -1 bad, 0 nothing. Each kind of junk meets more than one.
LABELLERS = {
    "repetition": lambda x: -1 if x[0] >= 8 and x[2] > 0.15 else (1 if few_repeats(x) else 0),
    "variety": lambda x: -1 if x[0] >= 20 and x[1] < 0.15 else 0,
    "runs": lambda x: -1 if x[0] >= 20 and x[2] > 0.3 else 0,
    "capitals": lambda x: -1 if x[0] >= 8 and x[3] > 0.4 else 0,
    "symbols": lambda x: -1 if x[0] >= 8 and x[4] > 0.04 else 0,
    "doubled": lambda x: -1 if x[0] >= 8 and x[5] > 0.15 else 0,
    "bare": lambda x: -1 if x[0] >= 8 and x[6] > 0.12 else 0,
    "plain": lambda x: -1 if x[0] == 0 or x[0] >= 8 and x[7] < 0.6 else (1 if x[7] > 0.85 and few_repeats(x) else 0),
    "shape": lambda x: -1 if x[0] == 0 or x[0] >= 8 and not 2.5 <= x[10] <= 25 else (1 if (x[3] < 0.15 or x[0] < 8) and few_repeats(x) and x[4] < 0.03 else 0),
    "figures": lambda x: -1 if x[0] >= 20 and x[8] > 0.3 else 0,
}


def votes(x: np.ndarray) -> list[int]:
    return [say(x) for say in LABELLERS.values()]


def feature_counts(text: str | None, x: np.ndarray, features: int = FEATURES) -> np.ndarray:
    """Hashed features of a whole text: pairs of bytes as shares, and each number of FIELDS in steps."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8).astype(np.uint32)
    half = features // 2
    out = np.zeros(features, np.float32)
    if len(data) > 1:
        pairs = ((data[:-1] * np.uint32(0x9E3779B1)) ^ (data[1:] * np.uint32(0x85EBCA77))) >> np.uint32(32 - half.bit_length() + 1)
        shares = np.sqrt(np.bincount(pairs, minlength=half)[:half])
        out[:half] = shares / np.linalg.norm(shares)
    steps = [min(12, int(math.log2(x[0] + 1))), *[min(15, int(v * 16)) for v in x[1:10]], min(15, int(x[10]))]
    for name, step in zip(FIELDS, steps, strict=True):
        out[half + xxhash.xxh32_intdigest(f"{name}={step}") % half] += 1.0
    return out


def estimate_accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS, share: float = 0.8) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1): the share of good documents, the chances of each vote
    (labeller, good or bad, vote + 1), and each pattern's posterior of good.

    It starts from labellers that are right more often than not, which settles which class is the good one.
    """
    chance = np.empty((patterns.shape[1], 2, 3))
    chance[:, 1] = (0.1, 0.3, 0.6)
    chance[:, 0] = (0.6, 0.3, 0.1)
    places = np.arange(patterns.shape[1])
    post = np.full(len(patterns), share)
    for _ in range(rounds):
        good = np.log(share) + np.log(chance[places, 1, patterns + 1]).sum(axis=1)
        bad = np.log(1 - share) + np.log(chance[places, 0, patterns + 1]).sum(axis=1)
        post = 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))
        for cls, weight in ((1, post * counts), (0, (1 - post) * counts)):
            for v in range(3):
                chance[:, cls, v] = ((patterns + 1 == v) * weight[:, None]).sum(axis=0) + (6.0 if v == 2 * cls else 1.0)
            chance[:, cls] /= chance[:, cls].sum(axis=1, keepdims=True)
        share = min(max((post * counts).sum() / max(counts.sum(), 1), 1e-3), 1 - 1e-3)
    return float(share), chance, post


def fit_linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on soft targets by gradient steps (Adagrad), from zero: the same rows give the same model.

    Products run in single precision, as the features are; sums and the model are kept in double.
    """
    w, b = np.zeros(x.shape[1]), 0.0
    seen, seen_b = np.full(x.shape[1], 1e-8), 1e-8
    x = np.ascontiguousarray(x, np.float32)
    for _ in range(steps if len(x) else 0):
        error = (1 / (1 + np.exp(-np.clip((x @ w.astype(np.float32)).astype(float) + b, -50, 50))) - target) * weight
        slope, slope_b = (error.astype(np.float32) @ x).astype(float) + decay * w, error.sum()
        seen, seen_b = seen + slope**2, seen_b + slope_b**2
        w, b = w - rate * 0.1 * slope / np.sqrt(seen), b - rate * 0.1 * slope_b / math.sqrt(seen_b)
    return w, float(b)


class QualityModel:
    """Posteriors by vote pattern, the labellers' chances, and the scorer's weights."""

    def __init__(self, posteriors: dict[str, float], chances: dict[str, tuple[float, float]], weights: np.ndarray, bias: float, features: int):
        self.posteriors, self.chances, self.weights, self.bias, self.features = posteriors, chances, weights.astype(np.float32), bias, features

    def score(self, text: str | None, x: np.ndarray) -> float:
        z = float(feature_counts(text, x, self.features) @ self.weights) + self.bias
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _pattern(x: np.ndarray) -> str:
    return "".join("-0+"[v + 1] for v in votes(x))


def smallest_hashes(texts: DataFrame, sizes: dict[str, int], take: int) -> list[int]:
    """The `take` smallest h of each pattern, or all where it has fewer; texts has distinct (pattern, h), sizes their count by pattern.

    They nearly always lie below a quantile of the hash range, so one small aggregate replaces sorting each pattern. A pattern
    with too few below it is asked again with a higher limit.
    """
    chosen, expected = [], take + 8 * math.isqrt(take) + 32
    while sizes:
        limits = texts.sparkSession.createDataFrame([(p, min(2**63 - 1, 2**63 * expected // n)) for p, n in sizes.items()], "p string, most bigint")
        near = texts.join(F.broadcast(limits), F.col("pattern") == F.col("p")).where("h <= most")
        found = {r["pattern"]: r["hs"] for r in near.groupBy("pattern").agg(F.slice(F.array_sort(F.collect_list("h")), 1, take).alias("hs")).collect()}
        enough = {p for p, n in sizes.items() if len(found.get(p, ())) >= min(take, n)}
        chosen += [h for p in enough for h in found[p]]
        sizes, expected = {p: n for p, n in sizes.items() if p not in enough}, expected * 4
    return chosen


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE, per_pattern: int = PER_PATTERN, features: int = FEATURES) -> QualityModel:
    """Count patterns over all documents, then train on at most `sample` texts, at most `per_pattern` of each pattern.

    The sample has the smallest hashes of each pattern's distinct texts, so copies and the order of rows do not matter, and a
    pattern with few texts has them all in it.
    """
    python_ready(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.shiftrightunsigned(F.xxhash64(body), 1).alias("h"), body.alias("t"))

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_pattern(shape(t)) for t in batch.column(1).to_pylist()], pa.string())], names=["h", "pattern"])

    seen = keyed.mapInArrow(voted, "h bigint, pattern string")
    texts = checkpointed(seen.groupBy("pattern", "h").agg(F.count(F.lit(1)).alias("copies")))
    counted = texts.groupBy("pattern").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("texts")).collect()  # at most 3 ** len(LABELLERS) rows
    if not counted:
        return QualityModel({}, {}, np.zeros(features), 4.0, features)
    patterns = np.array([["-0+".index(c) - 1 for c in r["pattern"]] for r in counted])
    share, chance, post = estimate_accuracies(patterns, np.array([float(r["n"]) for r in counted]))
    posteriors = {r["pattern"]: float(p) for r, p in zip(counted, post, strict=True)}
    take = max(1, min(per_pattern, sample // len(counted)))
    chosen = smallest_hashes(texts, {r["pattern"]: r["texts"] for r in counted}, take)
    wanted = docs.sparkSession.createDataFrame([(h,) for h in chosen], "h bigint")  # at most `sample` rows
    sample_texts = keyed.join(F.broadcast(wanted), "h", "left_semi").dropDuplicates(["h"])  # only these go to Python again

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = [(t, shape(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_pattern(x) for _, x in shapes], pa.string()), pa.array([feature_counts(t, x, features).tobytes() for t, x in shapes], pa.binary())], names=["h", "pattern", "x"])

    got = sample_texts.mapInArrow(featured, "h bigint, pattern string, x binary").collect()
    got.sort(key=lambda r: r["h"])
    x = np.array([np.frombuffer(r["x"], np.float32) for r in got]).reshape(len(got), features)
    target = np.array([posteriors[r["pattern"]] for r in got])
    weight = np.where(target >= 0.5, 0.5 / max(1e-9, (target >= 0.5).sum()), 0.5 / max(1e-9, (target < 0.5).sum()))
    w, b = fit_linear(x, target, weight)
    names = list(LABELLERS)
    chances = {names[i]: (float(chance[i, 1, 2]), float(chance[i, 0, 0])) for i in range(len(names))}
    return QualityModel(posteriors, chances | {"": (share, 1 - share)}, w, b, features)


def score_documents(docs: DataFrame, model: QualityModel | None = None, text: str = "text", cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, votes (a sign for each labeller), posterior, score, kept.

    Null and empty texts are scored like any other, by what the labellers say of a text without words; long texts count whole.
    Rows that repeat a text get the same score, whatever their ids; a null id is kept as null. Other columns are not read. An
    empty table gives no rows.
    """
    model = model or train(docs, text)
    python_ready(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            shapes = [shape(t) for t in texts]
            said = [_pattern(x) for x in shapes]
            scores = [model.score(t, x) for t, x in zip(texts, shapes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(said, pa.string()), pa.array([model.posteriors.get(p) for p in said], pa.float64()), pa.array(scores, pa.float64()), pa.array([s >= cut for s in scores], pa.bool_())], names=["doc_id", "votes", "posterior", "score", "kept"])

    return docs.select(F.col("doc_id").cast("bigint"), text).mapInArrow(scored, "doc_id bigint, votes string, posterior double, score double, kept boolean")


def keep_good(docs: DataFrame, model: QualityModel | None = None, text: str = "text", cut: float = CUT) -> DataFrame:
    """docs without the rows that the scorer rejects, with docs' columns, whatever their types and names.

    A null text is scored as the empty one, a long text whole; rows that repeat a text share its fate, whatever their ids, and null
    ids count like others. An empty table gives no rows.
    """
    model = model or train(docs, text)
    python_ready(docs.sparkSession)
    kept, = fresh(docs, "kept")

    @F.pandas_udf("boolean")
    def good(texts):
        return texts.map(lambda t: model.score(t, shape(t)) >= cut).astype(bool)

    return docs.withColumn(kept, good(F.coalesce(F.col(text), F.lit("")))).where(kept).drop(kept)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
