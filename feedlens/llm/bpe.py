"""Byte-pair merging on length-bucketed padded numpy matrices, and the byte-level round trip built on it.

Every row of a matrix is one piece of text as symbol ids. A round looks up the rank of each adjacent pair, merges the
leftmost pair of minimum rank in every row, and closes the gap by a gather (compaction). Rows without a known pair
leave the matrix. Pairs are found in an open-addressing hash table held in two numpy arrays. Rows of the longest buckets
stand alone, and a round merges the leftmost minimum-rank pair together with its later copies, so the number of rounds follows
the number of different pairs and not the length.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.llm.common import by_rows

NONE = np.int32(2**31 - 1)
#: Rows of more symbols than this stand alone in their matrix.
LONG = 1024
#: Entries that a worker's word cache holds before it starts anew.
CACHE = 300_000


class Merges:
    """Hashed lookup: (left id, right id) -> rank and id of the merged symbol."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(left) * 3).bit_length())
        size = 1 << self.bits
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.rank = np.full(size, NONE, np.int32)
        self.merged = np.zeros(size, np.int32)
        slot, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            asks = todo[free]
            _, first = np.unique(slot[asks], return_index=True)
            got = asks[first]
            self.keys[slot[got]], self.rank[slot[got]], self.merged[slot[got]] = keys[got], rank[got], merged[got]
            todo = np.setdiff1d(todo, got, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        rank, merged = np.full(keys.shape, NONE, np.int32), np.zeros(keys.shape, np.int32)
        open_ = np.arange(keys.size)
        flat, keys, slot = rank.reshape(-1), keys.reshape(-1), slot.reshape(-1)
        out = merged.reshape(-1)
        for _ in range(self.probes):
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            got = open_[hit]
            flat[got], out[got] = self.rank[slot[got]], self.merged[slot[got]]
            open_ = open_[~hit & (there != np.uint64(2**64 - 1))]
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
        return rank, merged


def merge_matrix(ids: np.ndarray, table: Merges, emit) -> None:
    """ids: rows of one bucket, padded with -1 at the right. emit(row numbers, finished rows) gets every row once."""
    where = np.arange(len(ids))
    rank, merged = table.find(np.maximum(ids[:, :-1], 0), np.maximum(ids[:, 1:], 0))
    rank[ids[:, 1:] < 0] = NONE
    while rank.shape[1]:
        at = rank.argmin(axis=1)
        going = rank[np.arange(len(where)), at] != NONE
        if not going.all():
            emit(where[~going], ids[~going])
            ids, rank, merged, at, where = ids[going], rank[going], merged[going], at[going], where[going]
            if not len(where):
                return
        rows, width = np.arange(len(where)), ids.shape[1]
        ids[rows, at] = merged[rows, at]
        stays = np.ones(ids.shape, bool)
        stays[rows, at + 1] = False
        ids = ids[stays].reshape(-1, width - 1)
        stays = np.ones(rank.shape, bool)
        stays[rows, np.minimum(at + 1, width - 2)] = False
        rank, merged = rank[stays].reshape(len(where), width - 2), merged[stays].reshape(len(where), width - 2)
        # only the pairs at both sides of the merged symbol are new
        left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
        r, c = np.concatenate([left, right]), np.concatenate([at[left] - 1, at[right]])
        y = ids[r, c + 1]
        new, to = table.find(ids[r, c], np.maximum(y, 0))
        new[y < 0] = NONE
        rank[r, c], merged[r, c] = new, to
    emit(where, ids)


def _merge_at(x: np.ndarray, rank: np.ndarray, merged: np.ndarray, at: np.ndarray, table: Merges) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The row with the pairs at `at` (which do not overlap) merged, its pairs' ranks and symbols, and the ranks that are new."""
    y = x.copy()
    y[at] = merged[at]
    stays = np.ones(len(x), bool)
    stays[at + 1] = False
    old = np.flatnonzero(stays)
    y, rank, merged = y[old], rank[old[:-1]], merged[old[:-1]]
    place = at - np.arange(len(at))
    pairs = np.unique(np.concatenate([place[place > 0] - 1, place[place < len(y) - 1]]))
    rank[pairs], merged[pairs] = table.find(y[pairs], y[pairs + 1])
    return y, rank, merged, rank[pairs]


def merge_row(x: np.ndarray, table: Merges) -> np.ndarray:
    """One long row. Copies of the leftmost minimum-rank pair are merged with it, of overlapping ones every other, unless a pair
    of lower rank would arise on the way; then only the leftmost one is."""
    rank, merged = table.find(x[:-1], x[1:])
    while len(rank):
        low = rank.min()
        if low == NONE:
            break
        at = np.flatnonzero(rank == low)
        if len(at) > 1:
            k = np.arange(len(at))
            start = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, k, 0))
            at = at[(k - start) % 2 == 0]
        got = _merge_at(x, rank, merged, at, table)
        if len(at) > 1:
            # a pair with the next symbol as it stands before that one is merged itself
            inner = at[at + 2 < len(x)]
            between, _ = table.find(merged[inner], x[inner + 2])
            if (got[3] < low).any() or (between < low).any():
                got = _merge_at(x, rank, merged, at[:1], table)
        x, rank, merged, _ = got
    return x


def merge_all(pieces: list[bytes], first: np.ndarray, last: np.ndarray, table: Merges, rows: int = 16_384) -> list[bytes]:
    """The merged ids of every piece, as little-endian unsigned 32-bit integers.

    first maps a byte to its symbol, last does so for a piece's last byte. Buckets: each length up to 16, then doubling
    ranges of lengths.
    """
    out: list[bytes] = [b""] * len(pieces)
    buckets: dict[int, list[int]] = {}
    for k, p in enumerate(pieces):
        n = len(p)
        buckets.setdefault(n if n <= 16 else 1 << (n - 1).bit_length(), []).append(k)
    buckets.pop(0, None)
    for width, members in buckets.items():
        most = max(64, min(rows, 2**20 // width))
        for start in range(0, len(members), most):
            part = members[start : start + most]
            flat = np.frombuffer(b"".join([pieces[k] for k in part]), np.uint8)
            lens = np.array([len(pieces[k]) for k in part])
            ends = np.cumsum(lens)
            symbols = first[flat]
            symbols[ends - 1] = last[flat[ends - 1]]
            if width > LONG:
                for k, lo, hi in zip(part, (ends - lens).tolist(), ends.tolist(), strict=True):
                    out[k] = merge_row(symbols[lo:hi], table).astype("<u4").tobytes()
                continue
            if width <= 16:
                ids = symbols.reshape(len(part), width)
            else:
                ids = np.full((len(part), width), -1, np.int32)
                ids[np.arange(width)[None, :] < lens[:, None]] = symbols

            def emit(at: np.ndarray, done: np.ndarray, part: list[int] = part) -> None:
                real = done >= 0
                raw = done[real].astype("<u4").tobytes()
                stop = (4 * np.cumsum(real.sum(axis=1))).tolist()
                begin = 0
                for r, end in zip(at.tolist(), stop, strict=True):
                    out[part[r]] = raw[begin:end]
                    begin = end

            merge_matrix(ids, table, emit)
    return out


class ByteBpe:
    """Byte-level BPE from a rank file: encodes as the rank file's own library does, decodes by table."""

    def __init__(self, path: str, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb") if x.strip())}
        self.find = regex.compile(pattern).findall
        self.gap = re.compile(r"\s\s").search
        left, right, rank = [], [], []
        get = self.ranks.get
        for token, r in self.ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        rank_ = np.array(rank, np.int32)
        self.table = Merges(np.array(left), np.array(right), rank_, rank_)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        most = max(self.ranks.values()) + 1
        lens = np.zeros(most, np.int64)
        for token, r in self.ranks.items():
            lens[r] = len(token)
        self.lens, self.starts = lens, np.concatenate([[0], np.cumsum(lens)[:-1]])
        self.blob = np.zeros(int(lens.sum()), np.uint8)
        for token, r in self.ranks.items():
            self.blob[self.starts[r] : self.starts[r] + len(token)] = np.frombuffer(token, np.uint8)
        self.cache: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def learn(self, parts: set[str]) -> None:
        """Puts the ids of texts that no match crosses into the cache."""
        names = list(parts)
        cut = list(map(self.find, names))
        new = set()
        for ms in cut:
            new.update(ms)
        new = {x for x in new if x not in self.pieces}
        raw = [x.encode("utf-8") for x in new]
        self.pieces.update(zip(new, merge_all(raw, self.byte, self.byte, self.table), strict=True))
        for name, x in zip(new, raw, strict=True):
            if x in self.ranks:
                self.pieces[name] = self.ranks[x].to_bytes(4, "little")
        get, cache = self.pieces.__getitem__, self.cache
        for name, ms in zip(names, cut, strict=True):
            cache[name] = get(ms[0]) if len(ms) == 1 else b"".join(map(get, ms))

    def forget(self) -> None:
        """Frees what the task has cached; the worker may serve other stages next."""
        self.cache.clear()
        self.pieces.clear()

    def parts(self, text: str) -> list[str]:
        """Cuts a text where no match can cross: before a lone space between two other characters. Else whole."""
        if not text or text[0].isspace() or text[-1].isspace() or self.gap(text):
            return self.find(text)
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.parts(x) for x in texts]
        new = set().union(*cut)
        for kept in (self.cache, self.pieces):
            if len(kept) > CACHE:
                kept.clear()
        self.learn({x for x in new if x not in self.cache})
        get = self.cache.__getitem__
        return [b"".join(map(get, x)) for x in cut]

    def decode(self, ids: bytes) -> bytes:
        x = np.frombuffer(ids, "<u4").astype(np.int64)
        lens = self.lens[x]
        ends = np.cumsum(lens)
        if not len(x):
            return b""
        take = np.repeat(self.starts[x] - (ends - lens), lens) + np.arange(int(ends[-1]))
        return self.blob[take].tobytes()


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


ROUND_TRIP = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("decoded", T.BinaryType()),
    ]
)


def _round_trip(path: str, pattern: str, digests: bool):
    schema = [("doc_id", pa.int64()), ("n_tokens", pa.int64())]
    kind = pa.string() if digests else pa.binary()
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    out = pa.schema([*schema, (names[0], kind), (names[1], kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)

        def work(texts: list, part: pa.RecordBatch) -> pa.RecordBatch:
            ids = bpe.encode([x or "" for x in texts])
            back = [bpe.decode(x) for x in ids]
            if digests:
                pair = [[hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x).hexdigest() for x in back]]
            else:
                pair = [ids, back]
            return pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), *(pa.array(x, kind) for x in pair)],
                schema=out,
            )

        yield from by_rows(batches, "text", work, rows=512)
        bpe.forget()

    return run


def encode_and_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded bytes of every whole text; null counts as empty.

    One pass without a shuffle. A null id stays null, repeated rows give repeated rows, an empty table no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_round_trip(path, pattern, False), ROUND_TRIP)


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As encode_and_decode, with sha-256 digests in place of ids and bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        _round_trip(path, pattern, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
