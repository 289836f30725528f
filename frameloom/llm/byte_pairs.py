"""Byte-level BPE encoding and decoding.

A text is split by the vocabulary's pattern, and each piece is merged on its own. A segment tree over the piece's byte positions
holds for each live position the rank of the pair that starts there, and in its inner nodes the smallest rank with the leftmost
position; its root is the next merge. A merge changes the pairs of the merged part and of its live neighbours only, so it costs
three point updates of logarithmic length, and a piece of n bytes n log n steps: a text of one long piece is no worse than prose.
Trees of short pieces are the rows of an array and are updated side by side; a long piece has a tree of its own. Pieces that
repeat are remembered within bounds by each Python worker.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from frameloom.llm._common import python_ready, table

#: Pieces that a worker remembers, twice, and the longest of them in characters: some tens of MB each time.
REMEMBERED, LONGEST = 200_000, 64
#: Pieces of texts that are held at a time, and bytes of the longest piece whose tree is a row of an array.
SLICE, SHORT = 1 << 16, 64
_NONE, _PLACE = (1 << 62) - 1, 32
_coders: dict[tuple[str, str], Coder] = {}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the pair of smallest rank, the leftmost of equals, is merged until no pair has a rank."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    leaves = 1 << (n - 1).bit_length()
    tree = array("q", [_NONE]) * (2 * leaves)
    ends, before = array("q", range(1, n + 1)), array("q", range(-1, n))  # of the live part at each position

    def pair(i: int, to: int) -> int:
        rank = ranks.get(piece[i:to])
        return _NONE if rank is None else rank << _PLACE | i

    for i in range(n - 1):
        tree[leaves + i] = pair(i, i + 2)
    for node in range(leaves - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b

    def put(i: int, value: int) -> None:
        node = leaves + i
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            if other < value:
                value = other
            node >>= 1
            if tree[node] == value:
                return
            tree[node] = value

    while tree[1] != _NONE:
        i = tree[1] & ((1 << _PLACE) - 1)
        gone = ends[i]
        after = ends[i] = ends[gone]
        put(gone, _NONE)
        if after < n:
            before[after] = i
            put(i, pair(i, ends[after]))
        else:
            put(i, _NONE)
        if i:
            put(before[i], pair(before[i], after))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : ends[at]]])
        at = ends[at]
    return out


class PairRanks:
    """The rank of what two tokens make together, for many pairs at a time: a table of all splits of all tokens into two, by hash."""

    def __init__(self, ranks: dict[bytes, int]):
        splits = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, found = (np.array(c, np.int64) for c in (zip(*splits, strict=True) if splits else ((), ())))
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        at = self.slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several keys for a free slot the last one stays
            lost = self.keys[at] != keys
            self.ranks[at[~lost]] = found[~lost]
            keys, found, at = keys[lost], found[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, -1 for pairs that make no token."""
        keys = left.astype(np.int64) << 32 | right
        at, out = self.slot(keys), np.full(len(keys), -1, np.int64)
        left_ = np.arange(len(keys))
        while len(left_):
            there = self.keys[at]
            hit = there == keys
            out[left_[hit]] = self.ranks[at[hit]]
            on = ~hit & (there >= 0)
            left_, keys, at = left_[on], keys[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


def merged_together(pieces: list[bytes], singles: np.ndarray, pair_ranks: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces one after another, how many each has) of pieces of 1 to SHORT bytes: `merged` for many at once.

    singles has the ids of single bytes. Each row of `tree` is a piece's segment tree, its leaves the pairs that start at a position.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    width = 1 << int(sizes.max(initial=1) - 1).bit_length()
    places, rows = np.arange(width), np.arange(len(pieces))
    there = places < sizes[:, None]
    token = np.zeros((len(pieces), width), np.int64)
    token[there] = singles[np.frombuffer(b"".join(pieces), np.uint8)]
    after, before = np.repeat(places[None, :] + 1, len(pieces), axis=0), np.repeat(places[None, :] - 1, len(pieces), axis=0)
    tree = np.full((len(pieces), 2 * width), _NONE, np.int64)
    row, at = np.nonzero(places < sizes[:, None] - 1)
    rank = pair_ranks(token[row, at], token[row, at + 1])
    tree[row, width + at] = np.where(rank < 0, _NONE, rank << _PLACE | at)
    for node in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
    while len(rows := rows[tree[rows, 1] != _NONE]):
        first = tree[rows, 1]
        i = first & ((1 << _PLACE) - 1)
        gone = after[rows, i]
        last = after[rows, gone]
        made = first >> _PLACE
        token[rows, i], after[rows, i], there[rows, gone] = made, last, False
        follows = last < sizes[rows]
        before[rows[follows], last[follows]] = i[follows]
        leads = i > 0
        ahead = np.where(leads, before[rows, i], 0)
        ranks = pair_ranks(np.concatenate([made[follows], token[rows[leads], ahead[leads]]]), np.concatenate([token[rows[follows], last[follows]], made[leads]]))
        value = np.full((2, len(rows)), -1, np.int64)
        value[0, follows], value[1, leads] = ranks[: follows.sum()], ranks[follows.sum() :]
        tree[rows, width + gone] = _NONE
        tree[rows, width + i] = np.where(value[0] < 0, _NONE, value[0] << _PLACE | i)
        tree[rows[leads], width + ahead[leads]] = np.where(value[1] < 0, _NONE, value[1] << _PLACE | ahead)[leads]
        for node in (width + gone, width + i, width + np.where(leads, ahead, i)):
            while (node := node >> 1)[0]:
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
    return token[there], there.sum(axis=1)


class Coder:
    """Ids of texts as little-endian 32-bit integers, and bytes of ids."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.singles = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.pair_ranks = PairRanks(self.ranks)
        self.split = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids_of(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each piece with its ids; one that is a token stays one."""
        short: dict[int, list[tuple[str, bytes]]] = {}
        for text in pieces:
            raw = text.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                yield text, whole.to_bytes(4, "little")
            elif len(raw) <= SHORT:
                short.setdefault((len(raw) - 1).bit_length(), []).append((text, raw))
            else:
                yield text, array("I", merged(raw, self.ranks)).tobytes()
        for same in short.values():
            for lo in range(0, len(same), 4096):
                some = same[lo : lo + 4096]
                ids, counts = merged_together([raw for _, raw in some], self.singles, self.pair_ranks)
                data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                yield from zip([text for text, _ in some], [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True)

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """What is remembered, with the given pieces in it. Of what was remembered before it last grew too large, what is asked for stays."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        new = pieces.difference(self.known)
        again = new.intersection(self.older)
        self.known.update((x, self.older[x]) for x in again)
        made = dict(self.ids_of(list(new - again)))
        if any(len(x) > LONGEST for x in made):
            self.known.update((x, ids) for x, ids in made.items() if len(x) <= LONGEST)
            return self.known | made
        self.known.update(made)
        return self.known

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Pieces are found and learnt for all texts together; a longer one than SLICE goes piece by piece."""
        found = [self.split.findall(t) if len(t) <= SLICE else [] for t in texts]
        known = self.learn(set().union(*found))
        out = [b"".join(map(known.__getitem__, f)) for f in found]
        for i, t in enumerate(texts):
            if len(t) > SLICE:
                rest, parts = (m[0] for m in self.split.finditer(t)), []
                while some := list(islice(rest, SLICE)):
                    known = self.learn(set(some))
                    parts.append(b"".join(map(known.__getitem__, some)))
                out[i] = b"".join(parts)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode_texts(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of whole texts, a row for each row.

    path names the file of ranks, which every executor must have, pattern how texts are split. No special token is known: their
    spellings are ordinary text. A null or empty text has no ids; a long one is split by slices of pieces, and held once with its
    ids. Null and repeated ids stay as they are; other columns are not read. An empty table gives no rows.
    """
    python_ready(docs.sparkSession)
    files = defaults(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(*files).encode
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = encode([t or "" for t in part.column(1).to_pylist()])
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "ids"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id bigint, ids array<int>")


def _id_lists(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
    column = batch.column(1)
    for doc, ids in zip(batch.column(0).to_pylist(), column, strict=True):
        yield doc, np.empty(0, np.int32) if not ids.is_valid else ids.values.to_numpy(zero_copy_only=False)


def decode_ids(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, bytes) of rows (doc_id, ids); null ids are none. An id that the vocabulary lacks is an error."""
    python_ready(encoded.sparkSession)
    files = defaults(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = coder(*files).decode
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = [(doc, decode(ids.tolist())) for doc, ids in _id_lists(batch.slice(lo, 64))]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, bytes binary")


def digests(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of rows (doc_id, ids): of the ids, and of the bytes that they decode to."""
    python_ready(encoded.sparkSession)
    files = defaults(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = coder(*files).decode
        for batch in batches:
            rows = [(doc, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode(ids.tolist())).hexdigest()) for doc, ids in _id_lists(batch)]
            columns = zip(*rows, strict=True) if rows else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op11_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(encode_texts(table(spark, sf_dir, "documents")))
