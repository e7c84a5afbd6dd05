"""Near-duplicate groups by b-bit MinHash, confirmed on full shingle sets.

1. One Arrow pass gives each document the sha-256 of its word sequence, the exact size of its shingle set, 128 minima cut to two
   bits each and packed in four longs, and 25 band keys over five minima each (a pair at 0.8 is missed by all bands with
   a chance of 5e-5; at 0.9 of 1e-10). Documents of one word sequence become one node, named by its smallest doc_id.
2. Star rounds: in every band bucket one node leads, another one each round. A member meets the leaders of its buckets,
   the packed signatures estimate the similarity, corrected for chance agreement of two bits, and the best pair of each
   member is confirmed on the full sets. Confirmed pairs join components, so a bucket with a million near copies costs a
   million pairs.
3. What is left are buckets that hold several components. Their nodes get a signature of 2048 two-bit minima, and there
   every node outside the bucket's largest component meets all nodes of other components; the long signatures prune, full
   sets decide. A pair counts in the first band it shares only. A large bucket is split: one side is dealt to parts, the
   other goes to each of them. No bucket, partner or candidate is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import by_rows, cut, forget

SHINGLE, HASHES, BITS, BANDS, ROWS = 4, 128, 2, 25, 5
#: Estimates this far below the threshold are dropped unconfirmed: over four standard errors of 128 and 2048 minima.
MARGIN = 0.2
LONG_HASHES, LONG_MARGIN = 2048, 0.05
#: Broadcast at most so many ids (8 bytes each); beyond that, ids and rows meet by a shuffle.
MOST_IDS = 1_000_000
STARS = 3
#: Rows of a bucket that one task pairs with the whole bucket.
PART = 1024

_rng = np.random.default_rng(20260101)
MUL = (_rng.integers(0, 2**31, LONG_HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
XOR = _rng.integers(0, 2**32, LONG_HASHES, dtype=np.uint32)[:, None]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Words between the six ASCII blanks, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def numbered(words: list[bytes], known: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """The words as numbers of distinct words, and the hash of each distinct word."""
    own: dict[bytes, int] = {}
    ids = np.fromiter([own.setdefault(w, len(own)) for w in words], np.int64, len(words))
    return ids, np.fromiter(map(known.__getitem__, own), np.uint64, len(own))


def count_shingles(ids: np.ndarray) -> int:
    """Distinct shingles, exactly: pairs of words are numbered, then pairs of pairs counted."""
    if len(ids) < SHINGLE:
        return int(len(ids) > 0)
    pair = ids[:-1] * (int(ids.max()) + 1) + ids[1:]
    pair = np.unique(pair, return_inverse=True)[1]
    return len(np.unique(pair[:-2] * (int(pair.max()) + 1) + pair[2:]))


def shingle_hashes(words: list[bytes], known: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than a shingle count as one."""
    ids, hashes = numbered(words, known)
    return hashes_of(ids, hashes)


def hashes_of(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    w = hashes[ids]
    size = min(SHINGLE, len(w))
    h = np.zeros(len(w) - size + 1, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - size + 1 + k]
    return np.unique(mix64(h + np.uint64(size)))


def minima(hashes: np.ndarray, count: int = HASHES) -> np.ndarray:
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(count, 2**32 - 1, np.uint32)
    step = 1024 * HASHES // count
    for at in range(0, len(x), step):
        h = x[None, at : at + step] ^ XOR[:count]
        h *= MUL[:count]
        np.minimum(out, h.min(axis=1), out=out)
    return out


def pack_bits(low: np.ndarray) -> np.ndarray:
    """(rows, hashes) minima -> longs with the two low bits of a mix of each."""
    bits = (mix64(low.astype(np.uint64)) & np.uint64(3)).reshape(len(low), -1, 32)
    return (bits << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    x = low[:, : BANDS * ROWS].astype(np.uint64).reshape(len(low), BANDS, ROWS)
    h = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64)), x.shape[:2])
    for k in range(ROWS):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + x[:, :, k])
    return h.view(np.int64)


SIGNED = "doc_id long, cls binary, n long, sig array<long>, bands array<long>"


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    longs = pa.list_(pa.int64())
    out = pa.schema([("doc_id", pa.int64()), ("cls", pa.binary()), ("n", pa.int64()), ("sig", longs), ("bands", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()

        def work(texts: list, part: pa.RecordBatch) -> pa.RecordBatch:
            cls: list[bytes | None] = []
            n, low = np.zeros(len(texts), np.int64), np.zeros((len(texts), HASHES), np.uint32)
            for k, text in enumerate(texts):
                words = words_of(text)
                cls.append(hashlib.sha256(b" ".join(words)).digest() if words else None)
                if words:
                    ids, hashes = numbered(words, known)
                    n[k], low[k] = count_shingles(ids), minima(hashes_of(ids, hashes))
            sig, bands = pack_bits(low), np.ascontiguousarray(band_keys(low))
            lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.reshape(-1))
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(cls, pa.binary()), pa.array(n), lists(sig), lists(bands)], schema=out)

        yield from by_rows(batches, "text", work)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SIGNED)


def long_signatures(docs: DataFrame) -> DataFrame:
    """docs: doc_id and text. (node, long): two bits of LONG_HASHES minima of each text with words."""
    longs = pa.list_(pa.int64())
    out = pa.schema([("node", pa.int64()), ("long", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()

        def work(texts: list, part: pa.RecordBatch) -> pa.RecordBatch:
            words = [words_of(x) for x in texts]
            low = np.array([minima(shingle_hashes(w, known), LONG_HASHES) for w in words if w], np.uint32).reshape(-1, LONG_HASHES)
            ids = part.column("doc_id").filter(pa.array([bool(w) for w in words], pa.bool_()))
            return pa.RecordBatch.from_arrays([ids, pa.array(list(pack_bits(low)), longs)], schema=out)

        yield from by_rows(batches, "text", work)

    return docs.select("doc_id", "text").mapInArrow(run, "node long, long array<long>").dropDuplicates(["node"])


def estimate(a: Column, b: Column, hashes: int = HASHES) -> Column:
    """Similarity from two packed signatures: the share of equal two-bit minima, less the quarter that agree by chance."""
    same = F.lit(0)
    for k in range(hashes * BITS // 64):
        x = a[k].bitwiseXOR(b[k])
        even = F.bitwise_not(x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(0x5555555555555555))
        same = same + F.bit_count(even)
    chance = 1 / 2**BITS
    return (same / F.lit(float(hashes)) - F.lit(chance)) / F.lit(1 - chance)


def with_ids(rows: DataFrame, key: str, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join with a table of distinct ids: by broadcast where they are few, else by a shuffle."""
    few = ids.limit(MOST_IDS + 1).count() <= MOST_IDS
    ids = ids.select(F.col(ids.columns[0]).alias(key))
    return rows.join(F.broadcast(ids) if few else ids, key, how)


def confirm(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach `percent` per cent of their union. docs: doc_id, text."""
    pairs = cut(pairs.select("a", "b"), "pairs")
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = with_ids(docs, "doc_id", ids, "left_semi")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b"
    )
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def shingles(text: str) -> set:
        w = words_of(text)
        return set(zip(*(w[k:] for k in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else {tuple(w)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, set] = ("", set())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                good = []
                for x, y in zip(part.column("ta").to_pylist(), part.column("tb").to_pylist(), strict=True):
                    if y != last[0]:
                        last = (y, shingles(y))
                    s, t = shingles(x), last[1]
                    inter = len(s & t)
                    good.append(100 * inter >= percent * (len(s) + len(t) - inter))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], schema=out).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of edges (a, b): comp is the smallest node reachable. Labels spread and jump until none changes."""
    both = cut(edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct(), "edges")
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).select(F.col("a").alias("node"), "comp"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        spread = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        moved = cut(spread.join(up, "comp", "left").select("node", "was", F.least("comp", F.coalesce("top", "comp")).alias("comp")), "labels")
        changed = moved.where("comp <> was").limit(1).count()
        forget(labels)
        labels = moved.select("node", "comp")
        if not changed:
            forget(both)
            return labels


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Links join documents whose sets of distinct four-word shingles have 100 |A & B| >= percent |A | B|. Null texts and
    texts without words have an empty set, are linked with nothing and kept. A row with a null id takes the component of
    its word sequence and is kept only where that has none. Rows that repeat an id count as one document. An empty
    table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(signatures(docs), "signed")
    known = signed.where("cls IS NOT NULL AND doc_id IS NOT NULL")
    classes = cut(
        known.groupBy("cls").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes"
    )
    facts = classes.select("node", "n", "sig")
    bands = classes.select("node", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    mixed = cut(bands.join(shared, "key"), "buckets")  # buckets of several nodes
    labels: DataFrame | None = None

    def labelled(rows: DataFrame) -> DataFrame:
        rows = rows.select("key", "node")
        if labels is None:
            return rows.withColumn("comp", F.col("node"))
        return rows.join(labels, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))

    def likely(pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) whose sizes allow the threshold and whose estimate is near it or above."""
        side = lambda c: facts.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
        met = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
        fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        return met.where(fits).withColumn("est", estimate(F.col("sa"), F.col("sb"))).where(F.col("est") >= percent / 100 - MARGIN).select("a", "b", "est")

    def joined(pairs: DataFrame) -> None:
        """Confirms pairs and merges the components of the confirmed ones."""
        nonlocal labels
        edges = cut(confirm(pairs, docs, percent), "links")
        if not edges.limit(1).count():
            return
        if labels is None:
            labels = components(edges)
            return
        of = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
        lifted = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
        tops = components(lifted.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b"))
        ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        old = ends.join(labels, "node", "full").select("node", F.coalesce("comp", "node").alias("was"))
        tops = tops.select(F.col("node").alias("was"), F.col("comp").alias("top"))
        labels = cut(old.join(tops, "was", "left").select("node", F.coalesce("top", "was").alias("comp")), "labels")

    def still_mixed() -> DataFrame:
        rows = labelled(mixed)
        several = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        return cut(rows.join(several, "key"), "mixed")

    for star in range(STARS):
        rows = labelled(mixed) if star == 0 else still_mixed()
        if star and not rows.limit(1).count():
            break
        flip = F.lit(0x2545F4914F6CDD1D * star % 2**62)
        leader = rows.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(flip)).bitwiseXOR(flip).alias("b"))
        pairs = rows.join(leader, "key").where("node <> b").select(F.col("node").alias("a"), "b", "comp").distinct()
        if labels is not None:  # pairs within a component are settled
            top = labels.select(F.col("node").alias("b"), F.col("comp").alias("comp_b"))
            pairs = pairs.join(top, "b", "left").where(F.col("comp") != F.coalesce("comp_b", "b"))
        best = likely(pairs).groupBy("a").agg(F.max_by("b", F.struct("est", "b")).alias("b"))
        joined(best)
    rows = still_mixed()
    if rows.limit(1).count():
        sizes = rows.groupBy("key", "comp").count()
        main = sizes.groupBy("key").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
        ids = cut(rows.select("node").distinct(), "ids")
        signs = cut(long_signatures(with_ids(docs, "doc_id", ids, "left_semi")), "long")
        facts = classes.select("node", "n", "bands").join(signs, "node")
        rows = rows.join(main, "key").join(facts, "node")
        parts = sizes.groupBy("key").agg(F.ceil(F.sum("count") / PART).cast("int").alias("parts"))
        rows = rows.join(parts, "key")
        a = rows.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
        b = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        a, b = (x.select("key", "part", "main", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "comp", "n", "bands", "long"))) for x, s in ((a, "a"), (b, "b")))
        band = F.array_position("bands_a", F.col("key")).cast("int") - 1
        earlier = F.arrays_zip(F.slice("bands_a", F.lit(1), band).alias("x"), F.slice("bands_b", F.lit(1), band).alias("y"))
        meets = (
            (F.col("comp_a") != F.col("comp_b"))
            & ((F.col("comp_b") == F.col("main")) | (F.col("node_a") < F.col("node_b")))
            & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
            & (estimate(F.col("long_a"), F.col("long_b"), LONG_HASHES) >= percent / 100 - LONG_MARGIN)
            & ~F.exists(earlier, lambda p: p["x"] == p["y"])
        )
        rest = a.where("comp_a <> main").join(b.drop("main"), ["key", "part"]).where(meets)
        joined(rest.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    tops = classes.select("cls", "node")
    if labels is not None:
        tops = tops.join(labels, "node", "left").select("cls", F.coalesce("comp", "node").alias("component_id"))
    else:
        tops = tops.select("cls", F.col("node").alias("component_id"))
    rows = signed.select("doc_id", "cls", F.col("n").alias("n_shingles")).join(tops, "cls", "left")
    top = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", top.alias("component_id"), F.coalesce(F.col("doc_id") == top, top.isNull()).alias("kept"))
