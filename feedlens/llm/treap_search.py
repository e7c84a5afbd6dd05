"""Ranked lexical search on K2-treaps: quadtrees over the term-document grid whose cells hold impact maxima.

Rows of a grid are terms, columns are documents, and the value of a point is its impact (1e9 tf) div (1000 tf + 8 m), so a score is
the sum of weight times impact over the rows of an item. Each task of the build cuts its documents into shards of bounded size and
stores one treap a shard. A treap lists its cells breadth first; of a cell it keeps a nibble that tells which quarters hold points,
and the largest impact below. Children are found by counting bits, so no pointers are stored; a cell with one point ends its branch.
Shards are small and stored in a row group each, since executors hold both whole; what a task holds does not follow the table.

An item descends with all its rows at once, in all treaps of a grove. A state is a range of documents of one treap and, for each row,
the cell that covers row and range; weights times the cells' maxima bound every score in the range from above. The best states are
split first, and the descent ends when no bound reaches the k-th score found so far, in this grove or in those that the task has seen
before. Bounds of single documents are their scores, so the result is exact. Items are met in blocks of bounded size, each against
all shards.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from feedlens.llm.common import cut

#: Bytes to lower-case terms and blanks: letters, digits and all bytes of longer characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Bytes of a text that are cut into terms at a time.
STEP = 1 << 20
#: A shard is closed at so many documents or points, whichever comes first.
SHARD_DOCS, SHARD_POINTS = 8192, 1 << 17
#: How shards are stored: each in a row group of its own, as a writer and a reader hold a whole one. (A limit in bytes counts them compressed.)
ROW_GROUPS = {"parquet.block.row.count.limit": "1", "parquet.enable.dictionary": "false"}
#: Cells at which a grove is closed.
GROVE_CELLS = 1 << 20
#: Items of a block, and bytes of their texts; a longer item is a block of its own.
BLOCK_ITEMS, BLOCK_BYTES = 1024, 4 << 20
#: States that are split at a time, and cells that this may touch.
SPLIT, CELLS = 64, 1 << 20
NO_ID = np.iinfo(np.int64).max
BITS = np.array([bin(x).count("1") for x in range(16)], np.int8)
#: BELOW[mask, q]: how many quarters before q hold points.
BELOW = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], np.int8)

SHARDS = T.StructType(
    [T.StructField("n_docs", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in ("ids", "terms", "df", "masks", "tops", "rows", "cols"))]
)
SHARDS_ARROW = pa.schema([("n_docs", pa.int32()), *((n, pa.binary()) for n in SHARDS.names[1:])])


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a whole text, step by step."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(FOLD)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + STEP)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def term_counts(text: str | None) -> Counter:
    found: Counter = Counter()
    for words in pieces(text):
        found.update(words)
    return found


def spread(x: np.ndarray) -> np.ndarray:
    """Puts a zero bit before each of the 32 low bits."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def levels_of(n_rows: int, n_cols: int) -> int:
    return max(n_rows - 1, n_cols - 1, 1).bit_length()


def build_treap(rows: np.ndarray, cols: np.ndarray, impacts: np.ndarray, levels: int) -> tuple[np.ndarray, ...]:
    """(masks, tops) of all cells breadth first, and (rows, cols) of the single points in the same order. Points are distinct."""
    z = (spread(rows) << np.uint64(1)) | spread(cols)
    order = np.argsort(z)
    z, v = z[order], impacts[order]
    inside = np.arange(len(z))
    masks, tops, single = [], [], []
    for level in range(levels + 1):
        cell = z[inside] >> np.uint64(2 * (levels - level))
        start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        count = np.diff(np.r_[start, len(inside)])
        tops.append(np.maximum.reduceat(v[inside], start))
        single.append(order[inside[start[count == 1]]])
        mask = np.zeros(len(start), np.uint8)
        many = count > 1
        inside = inside[np.repeat(many, count)]
        if len(inside):
            child = z[inside] >> np.uint64(2 * (levels - level - 1))
            child = child[np.r_[True, child[1:] != child[:-1]]]
            parent = child >> np.uint64(2)
            first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
            mask[many] = np.bitwise_or.reduceat(np.uint8(1) << (child & np.uint64(3)).astype(np.uint8), first)
        masks.append(mask)
        if not len(inside):
            break
    points = np.concatenate(single)
    return np.concatenate(masks), np.concatenate(tops).astype(np.uint32), rows[points].astype(np.uint32), cols[points].astype(np.uint32)


class Treap:
    """A stored shard, ready for descents."""

    def __init__(self, shard: dict, wanted: dict[bytes, int]):
        self.ids = np.frombuffer(shard["ids"], np.int64)
        terms = shard["terms"].split(b"\n")
        self.row = {t: i for i, t in enumerate(terms) if t in wanted}
        self.levels = levels_of(len(terms), len(self.ids))
        self.masks = np.frombuffer(shard["masks"], np.uint8)
        self.tops = np.frombuffer(shard["tops"], np.uint32)
        kids = BITS[self.masks]
        self.first = 1 + np.cumsum(kids, dtype=np.int32) - kids
        # Points of single cells, by cell; -1 elsewhere.
        self.at_row, self.at_col = np.full(len(kids), -1, np.int32), np.full(len(kids), -1, np.int32)
        alone = self.masks == 0
        self.at_row[alone] = np.frombuffer(shard["rows"], np.uint32)
        self.at_col[alone] = np.frombuffer(shard["cols"], np.uint32)

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """The k best (score, document) of this shard alone."""
        return Grove([self]).best(rows[None, :], weights, k, floor)


class Grove:
    """Treaps side by side, for joint descents. Cells and documents are numbered through."""

    def __init__(self, treaps: list[Treap]):
        self.row = [t.row for t in treaps]
        self.levels = np.array([t.levels for t in treaps])
        self.ids = np.concatenate([t.ids for t in treaps])
        self.root, self.base = (np.cumsum([0, *map(len, x)])[:-1] for x in ([t.masks for t in treaps], [t.ids for t in treaps]))
        # One cell more, without points, stands for all that are missing.
        self.masks = np.concatenate([*(t.masks for t in treaps), np.zeros(1, np.uint8)])
        self.tops = np.concatenate([*(t.tops for t in treaps), np.zeros(1, np.uint32)]).astype(np.float64)
        self.first = np.concatenate([*(t.first + np.int32(r) for t, r in zip(treaps, self.root, strict=True)), np.zeros(1, np.int32)])
        self.at_row, self.at_col = (np.concatenate([*x, np.full(1, -1, np.int32)]) for x in ([t.at_row for t in treaps], [t.at_col for t in treaps]))
        self.none = len(self.masks) - 1

    def rows(self, terms: list[bytes]) -> np.ndarray:
        """The rows of the terms in each treap; -1 where a term is missing."""
        return np.array([[row.get(t, -1) for t in terms] for row in self.row], np.int32)

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """The k best (score, document) with a score above 0 and at least `floor`; equal scores by id. rows: by treap."""
        found: list[tuple[int, int, int]] = []  # (-score, id, document)
        rows = rows.astype(np.int32)
        root = self.at_row[self.root][:, None]
        cells = np.where((rows >= 0) & ((root < 0) | (root == rows)), self.root[:, None], self.none).astype(np.int32)
        tree = np.flatnonzero((cells != self.none).any(axis=1))
        # left: levels below the state.
        bound, left, start, cells = np.full(len(tree), 1 << 62), self.levels[tree], np.zeros(len(tree), np.int64), cells[tree]
        if weights.sum() * 1_000_000 < 1 << 53:
            weights = weights.astype(np.float64)  # all sums are whole numbers that doubles hold
        width = max(1, min(SPLIT, CELLS // rows.shape[1]))
        floor = max(floor, 1)
        while len(bound):
            chosen = np.argpartition(-bound, width)[:width] if len(bound) > width else np.arange(len(bound))
            b, tr, le, st, ce = self._split(tree[chosen], left[chosen], start[chosen], cells[chosen], rows, weights, floor)
            rest = np.ones(len(bound), bool)
            rest[chosen] = False
            ends = le == 0
            at = self.base[tr[ends]] + st[ends]
            found += zip((-b[ends]).tolist(), self.ids[at].tolist(), at.tolist(), strict=True)
            if len(found) > k:
                found = sorted(found)[:k]
            if len(found) == k:
                floor = max(floor, -max(found)[0])
            more = ~ends
            bound, tree = np.concatenate([bound[rest], b[more]]), np.concatenate([tree[rest], tr[more]])
            left, start, cells = np.concatenate([left[rest], le[more]]), np.concatenate([start[rest], st[more]]), np.concatenate([cells[rest], ce[more]])
            if (low := bound < floor).any():
                bound, tree, left, start, cells = bound[~low], tree[~low], left[~low], start[~low], cells[~low]
        return [(-s, i) for s, i, _ in sorted(found)]

    def _split(self, tree, left, start, cells, rows, weights, floor):
        """Halves ranges; returns (bound, tree, left, start, cells) of the halves whose bound reaches the floor."""
        below, own = (left - 1).astype(np.int32), rows[tree]
        half = 1 << below.astype(np.int64)  # documents of a half
        mask, first = self.masks[cells], self.first[cells]
        col = self.at_col[cells]
        row_bit = (own >> below[:, None]) & 1
        out = []
        for side in (0, 1):
            quarter = 2 * row_bit + side
            child = np.where((mask >> quarter) & 1 == 1, first + BELOW[mask, quarter], self.none)
            row = self.at_row[child]
            child[(row >= 0) & (row != own)] = self.none
            # A single cell goes on as it is, to the side where its point lies.
            child = np.where((col >= 0) & ((col >= (start + half)[:, None]) == side), cells, child)
            top = self.tops[child]
            b = (top @ weights if weights.dtype == np.float64 else top.astype(np.int64) @ weights).astype(np.int64)
            ok = b >= floor
            out.append((b[ok], tree[ok], left[ok] - 1, start[ok] + side * half[ok], child[ok]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def groves(batches: Iterator[pa.RecordBatch], wanted: dict[bytes, int]) -> Iterator[Grove]:
    """The shards of a task in groves of bounded size; those without a wanted term are left out."""
    treaps: list[Treap] = []
    for batch in batches:
        for at in range(batch.num_rows):
            treap = Treap(batch.slice(at, 1).to_pylist()[0], wanted)
            if treap.row:
                treaps.append(treap)
            if sum(len(t.masks) for t in treaps) >= GROVE_CELLS:
                yield Grove(treaps)
                treaps = []
    if treaps:
        yield Grove(treaps)


@dataclass
class Index:
    """Stored shards, documents with a term (N) and terms with repeats (L)."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(documents with at least one term, all terms with repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for value in batch.column(0):
                size = sum(map(len, pieces(value.as_py())))
                n, total = n + (size > 0), total + size
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return found[0] or 0, found[1] or 0


class _Shard:
    """Points of the documents that a task has read since it closed its last shard."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.sizes: list[int] = []
        self.rows: list[np.ndarray] = []
        self.tf: list[np.ndarray] = []
        self.points = 0

    def add(self, doc_id: int | None, counts: Counter) -> None:
        known = self.known
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.sizes.append(counts.total())
        self.rows.append(np.fromiter((known.setdefault(t, len(known)) for t in counts), np.int64, len(counts)))
        self.tf.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.points += len(counts)

    def close(self, n_docs: int, n_terms: int) -> pa.RecordBatch:
        # Documents of like length and terms of like frequency stand together, which makes the maxima of cells tight.
        place = np.argsort(np.array(self.sizes), kind="stable")
        column = np.empty(len(place), np.int64)
        column[place] = np.arange(len(place))
        each = np.array([len(r) for r in self.rows])
        rows, tf = np.concatenate(self.rows), np.concatenate(self.tf)
        m = np.repeat(np.array([10 + 90 * n * n_docs // n_terms for n in self.sizes], np.int64), each)
        df = np.bincount(rows, minlength=len(self.known))
        rank = np.argsort(-df, kind="stable")
        row = np.empty(len(rank), np.int64)
        row[rank] = np.arange(len(rank))
        terms = list(self.known)
        tree = build_treap(row[rows], np.repeat(column, each), (1_000_000_000 * tf) // (1000 * tf + 8 * m), levels_of(len(terms), len(place)))
        values = [np.array(self.ids, np.int64)[place].tobytes(), b"\n".join(terms[i] for i in rank), df[rank].astype(np.uint32).tobytes(), *(x.tobytes() for x in tree)]
        return pa.RecordBatch.from_arrays([pa.array([len(place)], pa.int32()), *(pa.array([x], pa.binary()) for x in values)], schema=SHARDS_ARROW)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Treaps over all terms of all whole texts, stored in the shared folder.

    Rows with a null text or without a term are not in the index. Rows with a null id count and can be found; they come last among
    equal scores. Rows that repeat an id are documents of their own. An empty table gives an empty index. Other columns, whatever
    their names, are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_docs, n_terms = corpus_size(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if counts := term_counts(text.as_py()):
                    if shard.points and (len(shard.ids) >= SHARD_DOCS or shard.points + len(counts) > SHARD_POINTS):
                        yield shard.close(n_docs, n_terms)
                        shard = _Shard()
                    shard.add(doc_id.as_py(), counts)
        if shard.points:
            yield shard.close(n_docs, n_terms)

    return Index(cut(docs.mapInArrow(run, SHARDS), "treaps", ROW_GROUPS), n_docs, n_terms)


def blocks(rows: Iterable) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Lists of (item, its distinct terms) of bounded size."""
    block: list[tuple[int, list[bytes]]] = []
    size = 0
    for key, text in rows:
        if block and (len(block) >= BLOCK_ITEMS or size + len(text or "") > BLOCK_BYTES):
            yield block
            block, size = [], 0
        if terms := list(term_counts(text)):
            block.append((key, terms))
            size += len(text)
    if block:
        yield block


def document_frequencies(index: Index, wanted: dict[bytes, int]) -> dict[bytes, int]:
    """The number of documents of each wanted term, summed over the shards; reads no treap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, df in zip(batch.column(0), batch.column(1), strict=True):
                df = np.frombuffer(df.as_py(), np.uint32)
                for i, t in enumerate(terms.as_py().split(b"\n")):
                    if (k := wanted.get(t)) is not None:
                        total[k] += int(df[i])
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], names=["k", "df"])

    found = index.shards.select("terms", "df").mapInArrow(run, "k long, df long").groupBy("k").agg(F.sum("df").alias("df"))
    names = list(wanted)
    return {names[r.k]: r.df for r in found.toLocalIterator()}


def search(index: Index, items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0, equal scores by ascending doc_id.

    Items with a null text or no known term have no rows; an item row with a null or a repeated id has rows of its own. Other
    columns of items, whatever their names, are not read.
    """
    items = cut(items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")), "items")
    hits = None
    for block in blocks((r.item, r.text) for r in items.select("item", "text").toLocalIterator()):
        wanted = {t: i for i, t in enumerate(dict.fromkeys(t for _, terms in block for t in terms))}
        df = document_frequencies(index, wanted)
        weight = {t: math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        found = cut(_descend(index, block, wanted, weight, k), "hits")
        hits = found if hits is None else hits.union(found)
    if hits is None:
        hits = items.select("item", F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    place = F.row_number().over(W.Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = hits.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _descend(index: Index, block: list[tuple[int, list[bytes]]], wanted: dict[bytes, int], weight: dict[bytes, int], k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached: dict[int, list[tuple[int, int]]] = {}  # the k best (-score, document) of each item so far
        for grove in groves(batches, wanted):
            for item, terms in block:
                held = [t for t in terms if weight.get(t, 0) > 0]
                if not held:
                    continue
                weights = np.array([weight[t] for t in held], np.int64)
                best = reached.setdefault(item, [])
                hits = grove.best(grove.rows(held), weights, k, -best[-1][0] if len(best) == k else 0)
                reached[item] = sorted([*best, *((-s, i) for s, i in hits)])[:k]
        if out := [(item, i, -s) for item, best in reached.items() for s, i in best]:
            item, ids, score = zip(*out, strict=True)
            ids = pa.array(ids, pa.int64(), mask=np.array([x == NO_ID for x in ids]))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), ids, pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return index.shards.drop("df", "n_docs").mapInArrow(run, "item long, doc_id long, score long")


ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c WHERE term IN (SELECT term FROM q) GROUP BY term),
s AS (SELECT q.item_id, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * n.n * c.docs) // c.total)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN n USING (doc_id), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""
