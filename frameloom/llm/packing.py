"""Packing token sequences by harmonic classes.

A document of n ids gives floor(n / capacity) full pieces; what remains is cut greedily at the class sizes
floor(capacity / k), so that a piece of class k fills exactly its share of a bin, until less than `smallest` ids remain; the
last piece falls in the class k with capacity / (k + 1) < length <= capacity / k. Each bin of class k takes k pieces: where a
piece goes follows from its number in its class alone, so workers fill bins independently. Numbers come from a count by
(class, shard) and a row number within each shard, without a global sort. The last, partly filled bin of each class (fewer
than k pieces, at most a few thousand pieces in all whatever the input) is packed once more, best fit decreasing.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from frameloom.llm._common import checkpointed, python_ready, table

CAPACITY, SMALLEST, END_ID = 2048, 32, 1
#: Tokens' ids are kept for so many strings between blanks in each Python worker; then the memory is emptied.
REMEMBERED = 150_000
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, class int"
#: How byte-level vocabularies of this kind split a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies spell the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class Encoder:
    """Ids of whole texts as little-endian 32-bit integers, remembered by the string between two single blanks.

    The byte-level splitter never joins what stands before a blank with the blank, so such strings can be encoded alone. It does
    join a blank with other white space beside it: texts that have any (next to a blank, an empty string or one that begins or
    ends with white space), and texts with the spelling of an added token, are encoded whole by the tokenizer. New strings go
    through the faster tiktoken over the same vocabulary, for which the ids must rise with the merges; for files of another
    kind everything is encoded whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        pre, vocab = spec.get("pre_tokenizer") or {}, spec["model"].get("vocab")
        odd = ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")
        self.alone = spec["model"]["type"] == "BPE" and not any(spec["model"].get(k) for k in odd) and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.first: dict[str, bytes | None] = {}
        self.known: dict[str, bytes | None] = {}  # None: next to a blank only the whole text will do
        if self.alone:
            letter = _letters()
            merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
            self.alone = merged == sorted(merged)
            ranks = {bytes(letter[c] for c in token): i for token, i in vocab.items() if token not in self.special}
            self.fast = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, text: str) -> bytes:
        ids = self.fast.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _after_blank(self, text: str) -> bytes | None:
        return self._word(" " + text) if text and text.strip() == text else None

    def __call__(self, text: str) -> bytes:
        if not self.alone or any(s in text for s in self.special):
            return self._whole(text)
        head, *rest = text.split(" ")
        if not rest:
            return self._whole(text)
        if head not in self.first:
            if len(self.first) >= REMEMBERED:
                self.first.clear()
            self.first[head] = self._word(head) if head.rstrip() == head else None
        known = self.known
        try:
            parts = [self.first[head], *map(known.__getitem__, rest)]
        except KeyError:
            if len(known) + len(rest) > REMEMBERED:
                known.clear()
            for x in set(rest).difference(known):
                known[x] = self._after_blank(x)
            parts = [self.first[head], *map(known.__getitem__, rest)]
        return self._whole(text) if None in parts else b"".join(parts)


def cuts(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[tuple[int, int, int]]:
    """(start, length, class) of the pieces of a document of n ids."""
    out, at = [], 0
    while n - at >= capacity:
        out.append((at, capacity, 1))
        at += capacity
    while n - at:
        rest = n - at
        k = capacity // rest
        if k * rest < capacity and rest >= smallest and capacity // (k + 1) >= smallest:
            k, rest = k + 1, capacity // (k + 1)
        out.append((at, rest, k))
        at += rest
    return out


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, smallest: int = SMALLEST, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """Rows of PIECES: where each document is cut, and a checksum of the ids of each piece. Texts become ids once."""
    python_ready(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encode = _encoders[path]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), map(encode, (t or "" for t in part.column(1).to_pylist())), strict=True):
                    ids += end
                    n = len(ids) // 4
                    rows += [(doc, s, m, zlib.crc32(ids[4 * s : 4 * (s + m)]), n, k) for s, m, k in cuts(n, capacity, smallest)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 5 else pa.int64()) for i, c in enumerate(cols)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"])

    return docs.select("doc_id", text).mapInArrow(run, PIECES)


def best_fit(capacity: int):
    """Packs the few left-over pieces: longest first, each where least room is left."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        room: list[list[int]] = [[] for _ in range(capacity + 1)]
        used, at, bins = [], [], 0
        for n in rows["length"]:
            left = next((r for r in range(n, capacity) if room[r]), None)
            if left is None:
                b, left, bins = bins, capacity, bins + 1
            else:
                b = room[left].pop()
            used.append(b)
            at.append(capacity - left)
            room[left - n].append(b)
        return rows.assign(bin=used, offset=at)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "offset"]]

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, smallest: int = SMALLEST, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    sequence_id counts from 0 without gaps within each class; classes follow each other, the left-over bins come last. A null or
    empty text is its end id alone; a long one is cut into as many pieces as it needs, and its ids are held once in a worker.
    Rows that repeat an id are documents of their own, in an order that their ids, lengths and checksums settle; a null id is kept
    as null. Other columns are not read. An empty table gives no rows.
    """
    cut = checkpointed(pieces(docs, tokenizer, capacity, smallest, end_id, text).withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(2048)).cast("int")))
    counts = checkpointed(cut.groupBy("class", "shard").count())  # classes x 2048 rows at most, whatever the input
    before = Window.partitionBy("class").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ends = counts.select("class", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    totals = counts.groupBy("class").agg(F.sum("count").alias("in_class"))
    full = F.floor(F.col("in_class") / F.col("class")).cast("bigint")
    earlier = Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)  # a row for each class
    bases = totals.select("class", full.alias("bins"), F.coalesce(F.sum(full).over(earlier), F.lit(0)).alias("base"))
    directory = checkpointed(ends.join(F.broadcast(bases), "class"))
    order = Window.partitionBy("class", "shard").orderBy("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    numbered = cut.withColumn("nth", F.row_number().over(order) - 1).join(F.broadcast(directory), ["class", "shard"])
    number = F.col("ahead") + F.col("nth")
    placed = checkpointed(numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "base", "bins", number.alias("number")))
    bin_of = F.floor(F.col("number") / F.col("class")).cast("bigint")
    inner = placed.where(bin_of < F.col("bins")).withColumn("sequence_id", F.col("base") + bin_of)
    filled = Window.partitionBy("sequence_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    inner = inner.withColumn("offset", F.coalesce(F.sum("length").over(filled), F.lit(0)))
    rest = placed.where(bin_of >= F.col("bins")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.lit(0).alias("one"))
    rest = rest.groupBy("one").applyInPandas(best_fit(capacity), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, bin bigint, offset bigint")
    after = totals.agg(F.coalesce(F.sum(full), F.lit(0)).alias("after"))
    rest = rest.crossJoin(F.broadcast(after)).withColumn("sequence_id", F.col("after") + F.col("bin"))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return inner.select(out).unionByName(rest.select(out))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
