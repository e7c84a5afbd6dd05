"""Packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

Pieces are dealt to shards of about `shard_rows` by a hash. A shard whose best-fit-decreasing seed meets the lower bound is
done, as no packing is better. Each other one is solved by several islands, one group of (shard, island) in a task: seeds are
best-fit-decreasing packings under blurred orders, crossover injects well-filled bins of one parent whole into another,
dissolves the bins that hold a duplicate of an injected piece, and best-fits the displaced pieces. After each epoch an
island sends its elite to its neighbour in a ring; in the end the best elite of the shard counts. The loose bins of all
shards are then packed once more in fresh shards of the same size.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.bpe import Merges, merge_all
from feedlens.llm.common import by_rows, cut, forget

#: Texts of these characters only are the same under NFC, lower-case letter by letter and hold no special token.
#: Entries that a worker keeps of words and of pieces before it starts anew (about 200 bytes each).
CACHE = 300_000
PLAIN = regex.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ!\"#$%&'()*+,\-./:;=?@\[\\\]^_`{|}~]*")
ODD = re.compile(r"[^ \nA-Za-z0-9À-ÖØ-öø-ÿ!\"#$%&'()*+,\-./:;=?@\[\\\]^_`{|}~]").search
STOP = re.compile(r"(?<=[a-z0-9à-öø-ÿ])([.,])(?=[ \n]|\Z)")


class WordBpe:
    """Ids of a lower-casing BPE with word ends, as the tokenizers library gives them.

    Words between spaces and line feeds are independent of one another, so each distinct one is encoded once and
    cached. Plain ones go through the numpy merges, all others through the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        made = json.load(open(path, encoding="utf-8"))
        vocab, merges = made["model"]["vocab"], made["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        ids = np.array([[vocab[a], vocab[b], vocab[a + b]] for a, b in pairs])
        self.table = Merges(ids[:, 0], ids[:, 1], np.arange(len(ids), dtype=np.int32), ids[:, 2].astype(np.int32))
        split = made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(split).findall
        # byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names, extra = {b: chr(b) for b in own}, 256
        for b in range(256):
            if b not in names:
                names[b], extra = chr(extra), extra + 1
        self.first = np.array([vocab[names[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[names[b] + "</w>"] for b in range(256)], np.int32)
        self.cache: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def learn(self, words: list[str], plain: bool) -> None:
        """Puts the ids of words into the cache. plain: all are lower-case and PLAIN."""
        if not plain:
            other = [w for w in words if not PLAIN.fullmatch(w)]
            for at in range(0, len(other), 1000):
                part = other[at : at + 1000]
                for w, e in zip(part, self.library.encode_batch(part, add_special_tokens=False), strict=True):
                    self.cache[w] = np.array(e.ids, "<u4").tobytes()
            words = [w for w in words if w not in self.cache]
        lone = [w for w in words if w.isalpha()]
        self.cache.update(zip(lone, self.merge([w.lower() for w in lone]), strict=True))
        mixed = [w for w in words if not w.isalpha()]
        cut_ = [self.find(w.lower()) for w in mixed]
        new = list({p for ps in cut_ for p in ps if p not in self.pieces})
        self.pieces.update(zip(new, self.merge(new), strict=True))
        get = self.pieces.__getitem__
        for w, ps in zip(mixed, cut_, strict=True):
            self.cache[w] = b"".join(map(get, ps))

    def forget(self) -> None:
        """Frees what the task has cached; the worker may serve other stages next."""
        self.cache.clear()
        self.pieces.clear()

    def merge(self, words: list[str]) -> list[bytes]:
        return merge_all([w.encode("utf-8") for w in words], self.first, self.last, self.table)

    def encode(self, texts: list[str]) -> list[bytes]:
        for kept in (self.cache, self.pieces):
            if len(kept) > CACHE:
                kept.clear()
        cut_, odd, even = [], set(), set()
        for x in texts:
            if ODD(x):
                words = x.replace("\n", " ").split(" ")
                odd.update(words)
            else:
                # a lone full stop or comma behind a word is a piece of its own
                words = STOP.sub(r" \1", x.lower()).replace("\n", " ").split(" ")
                even.update(words)
            cut_.append(words)
        self.learn([w for w in even if w not in self.cache], True)
        self.learn([w for w in odd if w not in self.cache], False)
        get = self.cache.__getitem__
        return [b"".join(map(get, x)) for x in cut_]


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)


def tokenize_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document: its ids and one end id, cut where longer than capacity. Null text counts as empty."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)

        def work(texts: list, part: pa.RecordBatch) -> pa.RecordBatch:
            rows, take = [], []
            for k, ids in enumerate(bpe.encode([x or "" for x in texts])):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    raw = ids[at : at + 4 * capacity]
                    take.append(k)
                    rows.append((piece, at // 4, len(raw) // 4, zlib.crc32(raw)))
            columns = [pa.array([r[c] for r in rows], f.type) for c, f in enumerate(list(PIECE_ARROW)[1:])]
            return pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(take, pa.int64())), *columns], schema=PIECE_ARROW)

        yield from by_rows(batches, "text", work, rows=1024)
        bpe.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECE)


def best_fit(lengths: list[int], order: list[int], capacity: int, free: list[tuple[int, int]], bins: int) -> tuple[dict[int, int], int]:
    """Puts the pieces, in this order, each into the fullest bin that holds it. free: sorted (room, bin)."""
    put = {}
    for i in order:
        n = lengths[i]
        at = bisect_left(free, (n, -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            room, b, bins = capacity, bins, bins + 1
        put[i] = b
        if room > n:
            insort(free, (room - n, b))
    return put, bins


def fitness(bins: np.ndarray, lengths: np.ndarray) -> tuple[int, float]:
    """Lower is better: the number of bins, then how evenly they are filled."""
    fill = np.bincount(bins, weights=lengths)
    return int((fill > 0).sum()), -float((fill**2).sum())


def seed(lengths: np.ndarray, capacity: int, rng: np.random.Generator, jitter: float = 0.0) -> np.ndarray:
    """A best-fit-decreasing packing; jitter blurs the order."""
    order = np.argsort(-lengths * (1 + jitter * rng.random(len(lengths))), kind="stable").tolist()
    put, _ = best_fit(lengths.tolist(), order, capacity, [], 0)
    bins = np.empty(len(lengths), np.int64)
    bins[list(put)] = list(put.values())
    return bins


def refill(bins: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator, jitter: float = 0.0) -> np.ndarray:
    """Best-fits the displaced pieces (bin -1) into the bins there are, longest first up to the jitter."""
    placed = bins >= 0
    out = bins.copy()
    _, out[placed] = np.unique(bins[placed], return_inverse=True)
    k = int(out.max()) + 1
    fill = np.bincount(out[placed], weights=lengths[placed], minlength=k) if k else np.zeros(0)
    free = sorted((int(capacity - f), j) for j, f in enumerate(fill) if f < capacity)
    left = np.flatnonzero(~placed)
    put, _ = best_fit(lengths.tolist(), left[np.argsort(-lengths[left] * (1 + jitter * rng.random(len(left))), kind="stable")].tolist(), capacity, free, k)
    out[list(put)] = list(put.values())
    return out


def cross(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator, well: float = 0.995) -> np.ndarray:
    """Injects a part of a's well-filled bins (or of its best quarter) whole into b, dissolves the bins of b that hold a
    duplicate of an injected piece, and best-fits the displaced pieces."""
    fill = np.bincount(a, weights=lengths)
    good = np.flatnonzero(fill >= well * capacity)
    if len(good) < 2:
        used = np.flatnonzero(fill)
        good = used[np.argsort(-fill[used], kind="stable")[: max(1, len(used) // 4)]]
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(good, size=max(1, int(len(good) * rng.uniform(0.3, 1.0))), replace=False)] = True
    inject = chosen[a]
    fill = np.bincount(b, weights=lengths)
    broken = (fill < well * capacity) & (rng.random(len(fill)) < rng.uniform(0.0, 1.0))  # room for the displaced
    broken[b[inject]] = True
    child = np.where(broken[b], -1, b)
    child[inject] = a[inject] + len(broken)
    return refill(child, lengths, capacity, rng, float(rng.choice([0.0, 0.1, 0.5, 2.0])))


def mutate(bins: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator, share: float = 0.1) -> np.ndarray:
    """Dissolves the emptiest bin and some others, those with more room more often, and best-fits their pieces anew in random order."""
    fill = np.bincount(bins, weights=lengths)
    used = np.flatnonzero(fill)
    room = capacity - fill[used] + 1
    gone = np.zeros(len(fill), bool)
    gone[used[rng.choice(len(used), size=max(1, int(len(used) * share)), replace=False, p=room / room.sum())]] = True
    gone[used[fill[used].argmin()]] = True
    return refill(np.where(gone[bins], -1, bins), lengths, capacity, rng, float(rng.choice([0.0, 0.1, 0.5, 2.0])))


def evolve(
    lengths: np.ndarray, elites: list[np.ndarray], capacity: int, rng: np.random.Generator, population: int = 12, generations: int = 60, crossover: bool = True
) -> np.ndarray:
    """One epoch of one island: the bin of every piece in the best packing found.

    elites: packings that the island starts from besides its own best-fit seeds, its last elite and its neighbour's.
    A child takes the place of the worst packing if it is better. crossover=False leaves the seeds and mutations alone.
    """
    bound = -(-int(lengths.sum()) // capacity)
    rank = lambda bins: fitness(bins, lengths)
    pool = [(rank(x), x) for x in elites] or [(rank(x), x) for x in (seed(lengths, capacity, rng),)]
    while min(f for f, _ in pool)[0] > bound and len(pool) < population:
        x = seed(lengths, capacity, rng, float(rng.choice([0.02, 0.1, 0.5, 2.0])))
        pool.append((rank(x), x))
    pool.sort(key=lambda p: p[0])
    for turn in range(generations):
        if pool[0][0][0] <= bound:
            break
        one, two = sorted(rng.integers(len(pool), size=2)), rng.integers(len(pool))
        parent = pool[one[0]][1]
        if crossover and turn % 3:
            child = cross(parent, pool[two][1], lengths, capacity, rng)
        else:
            child = mutate(parent, lengths, capacity, rng)
        got = rank(child)
        if got < pool[-1][0] and all(got != f for f, _ in pool):
            pool[-1] = (got, child)
            pool.sort(key=lambda p: p[0])
    return pool[0][1]


#: An island sends its elite so many places on in the ring.
NEIGHBOUR = 1
STATE = PIECE + ", shard int, island int, bin long, solved boolean"
STATE_ARROW = pa.schema([*PIECE_ARROW, ("shard", pa.int32()), ("island", pa.int32()), ("bin", pa.int64()), ("solved", pa.bool_())])
KEY = [("doc_id", "ascending"), ("piece", "ascending"), ("length", "ascending"), ("ids_crc32", "ascending")]


def _lengths(group: pa.Table) -> np.ndarray:
    return group["length"].to_numpy().astype(np.int64)


def _pack_round(pieces: DataFrame, shards: int, capacity: int, islands: int, epochs: int, salt: int) -> DataFrame:
    """PIECE rows -> STATE rows of each shard's best elite.

    A shard whose best-fit seed meets the lower bound is solved and travels no further; the others go to all islands.
    """

    def done(rows: pa.Table, bins: np.ndarray, lengths: np.ndarray) -> pa.Table:
        solved = fitness(bins, lengths)[0] <= -(-int(lengths.sum()) // capacity)
        rows = rows.drop_columns([c for c in ("bin", "solved") if c in rows.column_names])
        return rows.append_column("bin", pa.array(bins, pa.int64())).append_column("solved", pa.array([solved] * len(bins), pa.bool_())).select(STATE_ARROW.names).cast(STATE_ARROW)

    def sow(group: pa.Table) -> pa.Table:
        group = group.sort_by(KEY)
        lengths = _lengths(group)
        return done(group, seed(lengths, capacity, np.random.default_rng(salt)), lengths)

    def epoch(number: int):
        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by(KEY)
            rng = np.random.default_rng([salt, number, group["shard"][0].as_py(), group["island"][0].as_py()])
            parts = [group.filter(pa.compute.equal(group["origin"], k)) for k in range(2)]
            parts = [p for p in parts if p.num_rows]
            lengths = _lengths(parts[0])
            return done(parts[0], evolve(lengths, [p["bin"].to_numpy() for p in parts], capacity, rng), lengths)

        return run

    def best(group: pa.Table) -> pa.Table:
        found = {}
        for k in sorted(set(group["island"].to_pylist())):
            own = group.filter(pa.compute.equal(group["island"], k))
            found[(*fitness(own["bin"].to_numpy(), _lengths(own)), k)] = own
        return found[min(found)].select(STATE_ARROW.names).cast(STATE_ARROW)

    shard = F.pmod(F.xxhash64(F.lit(salt), "doc_id", "piece", "length", "ids_crc32"), F.lit(shards)).cast("int")
    sown = pieces.select(*PIECE_ARROW.names, shard.alias("shard"), F.lit(0).alias("island")).groupBy("shard").applyInArrow(sow, STATE)
    sown = cut(sown, "sown")
    if not sown.where("NOT solved").limit(1).count():
        return sown
    state = sown.where("NOT solved").withColumn("island", F.explode(F.array(*(F.lit(k) for k in range(islands))))).withColumn("origin", F.lit(0))
    for number in range(epochs):
        if number:  # the elite of an island, and that of its neighbour in the ring
            ring = F.array(F.struct(F.col("island").alias("to"), F.lit(0).alias("origin")), F.struct(((F.col("island") + NEIGHBOUR) % islands).cast("int").alias("to"), F.lit(1).alias("origin")))
            state = state.withColumn("move", F.explode(ring)).withColumn("island", F.col("move.to")).withColumn("origin", F.col("move.origin")).drop("move")
        state = state.groupBy("shard", "island").applyInArrow(epoch(number), STATE)
    return sown.where("solved").unionByName(state.groupBy("shard").applyInArrow(best, STATE))


def pack(pieces: DataFrame, capacity: int = 4096, shard_rows: int = 4_096, islands: int = 3, epochs: int = 3, loose: float = 0.97) -> DataFrame:
    """PIECE rows plus sequence_id and offset (gapless from 0 in each sequence), in few sequences of at most capacity.

    Every row is placed: repeated rows and null ids too, and an empty table gives no rows. Pieces as long as capacity get a
    sequence each. Pieces of bins less than `loose` full, of all shards, are dealt once more. The only figures that reach the
    driver are numbers of pieces. A group in a task holds about shard_rows small rows, twice that where islands meet, and
    islands times that where the best of them is chosen, in both rounds.
    """
    pieces = cut(pieces, "pieces")
    n = pieces.count()
    shards = max(1, -(-n // shard_rows))
    first = cut(_pack_round(pieces, shards, capacity, islands, epochs, 1), "packed")
    forget(pieces)
    done = first.withColumn("shard", F.col("shard").cast("long"))
    if shards > 1:
        fill = first.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
        tagged = cut(first.join(fill, ["shard", "bin"]), "filled")
        forget(first)
        left = tagged.where(F.col("fill") < int(capacity * loose)).select(*PIECE_ARROW.names)
        again = _pack_round(left, max(1, -(-left.count() // shard_rows)), capacity, islands, epochs, 2)
        full = tagged.where(F.col("fill") >= int(capacity * loose)).drop("fill")
        done = full.withColumn("shard", F.col("shard").cast("long")).unionByName(again.withColumn("shard", F.col("shard").cast("long") + F.lit(shards)))
    out = pa.schema([*PIECE_ARROW, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by([("bin", "ascending"), *KEY])
        bins, lengths = group["bin"].to_numpy(), group["length"].to_numpy()
        ends = np.cumsum(lengths)
        starts = ends - lengths
        new = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]])) if len(bins) else np.array([], int)
        base = np.repeat(starts[new], np.diff(np.concatenate([new, [len(bins)]])))
        ids = group["shard"].to_numpy() * (1 << 32) + bins
        return pa.Table.from_arrays([*(group[c] for c in PIECE_ARROW.names), pa.array(ids, pa.int64()), pa.array(starts - base, pa.int64())], names=out.names).cast(out)

    return done.groupBy("shard").applyInArrow(place, PIECE + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed pieces of all documents: PIECE columns, sequence_id and offset. Null and empty texts are one end id; null ids
    and repeated rows are packed like others; an empty table gives no rows; other columns are not read."""
    return pack(tokenize_pieces(docs, path, capacity, id_col=id_col, text_col=text_col), capacity)
