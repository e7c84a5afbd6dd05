"""Language identification with language-bitmask n-gram filters.

Training reads the character n-grams of a bounded sample of labelled texts of each language. All of them, however rare or
shared, go into a bit-sliced Bloom filter: a slot holds one bit per language, so the AND of an n-gram's slots gives all
languages that contain it at once. A text is scored by the number of its n-grams that each language claims (per-language
popcounts), less those expected from false positives at the fill of that language's slice. A second sample, which is not in
the filter, shows how low scores of known languages go; below that a text is of no known language.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import by_rows, cut

ORDERS = (1, 2, 3, 4)
PROBES = 3
#: Slots of the filter for each n-gram of the language that has most.
SLOTS = 10
#: Training reads about this many texts of each language, and one in TRIAL of them for the limit instead of the filter.
SAMPLE, TRIAL = 1500, 5
#: Characters that are taken at a time, on to the next that is no letter.
STEP = 1 << 18
BREAK = re.compile(r"[\W\d_]").search


@functools.cache
def letters() -> np.ndarray:
    """Code point -> is it a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def steps(text: str) -> Iterator[str]:
    """The lower-cased text, cut between words."""
    text = text.lower()
    at = 0
    while at < len(text):
        end = BREAK(text, min(at + STEP, len(text)))
        end = end.start() if end else len(text)
        yield text[at:end]
        at = end


def grams(lowered: str) -> np.ndarray:
    """Hashes of the n-grams inside the words of a text; a word has one blank before it and one behind, and no other character than letters counts. Empty without letters."""
    c = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[c]
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    c = np.concatenate([[0], np.where(is_letter, c, 0), [0]]).astype(np.uint64)
    c = c[(c != 0) | np.concatenate([[True], c[:-1] != 0])]
    blank = c == 0
    out = []
    h = np.zeros(len(c), np.uint64)
    for n in ORDERS:
        h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(1)
        # a blank may only stand first or last
        ok = ~blank if n == 1 else np.ones(len(h), bool)
        for k in range(1, n - 1):
            ok &= ~blank[k : k + len(h)]
        out.append(mix(h[ok[: len(h)]] + np.uint64(n)))
    return np.concatenate(out)


@dataclass
class Filters:
    """languages in order of bits; slices: (words, slots) bit masks, of as few bits as hold all languages, or of 64 each;
    false_positive: by language. least: scores below are of no known language."""

    languages: list[str]
    slices: np.ndarray
    false_positive: np.ndarray
    default: str
    least: float = 0.0

    @classmethod
    def empty(cls, languages: list[str], slots: int, default: str) -> Filters:
        n = max(1, len(languages))
        kind = next((t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if n <= np.dtype(t).itemsize * 8), np.uint64)
        return cls(languages, np.zeros((-(-n // 64), slots), kind), np.zeros(len(languages)), default)

    def bit(self, k: int) -> np.generic:
        return self.slices.dtype.type(1 << (k % 64))

    def slots(self, h: np.ndarray) -> Iterator[np.ndarray]:
        mask, step = np.uint64(self.slices.shape[1] - 1), (h >> np.uint64(32)) | np.uint64(1)
        for k in range(PROBES):
            yield ((h + step * np.uint64(k)) & mask).astype(np.int64)

    def put(self, k: int, h: np.ndarray) -> None:
        """Adds all n-grams of a language, once for each language."""
        for at in self.slots(h):
            self.slices[k // 64, at] |= self.bit(k)
        self.false_positive[k] = (np.count_nonzero(self.slices[k // 64] & self.bit(k)) / self.slices.shape[1]) ** PROBES

    def find(self, h: np.ndarray) -> np.ndarray:
        """Languages that contain each n-gram: masks of shape (words, n)."""
        return functools.reduce(np.bitwise_and, (self.slices[:, at] for at in self.slots(h)))

    def predict(self, text: str | None) -> tuple[str, float]:
        n, found = 0, np.zeros(len(self.languages))
        for part in steps(text or ""):
            h = grams(part)
            n += len(h)
            if len(h) and self.languages:
                masks = self.find(h)
                found += [np.count_nonzero(masks[k // 64] & self.bit(k)) for k in range(len(self.languages))]
        if not n or not self.languages:
            return "und", 0.0
        true = np.maximum(0, (found - n * self.false_positive) / (1 - self.false_positive))
        best = int(true.argmax())
        if true[best] <= 0:
            return self.default, 0.0
        return self.languages[best], float(min(1.0, true[best] / n))


def train(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Filters:
    """Learns from text and language of the rows where `usable` holds and the language is not null.

    About `sample` texts of each language, chosen by a hash of the id, are read, in one job for all languages; the driver
    gets the distinct n-grams of these texts. Memory grows with the number of languages, which is meant to be in the hundreds.
    Repeated rows count each, and an empty table gives filters that say `und`.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), usable.alias("ok")).where("ok AND lang IS NOT NULL AND text IS NOT NULL")
    sizes = cut(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "sizes")
    place = F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit(3)), F.lit(1_000_000))
    chosen = rows.join(sizes, "lang").where(place < F.least(F.lit(1.0), F.lit(sample) / F.col("n")) * 1_000_000).select("lang", "text", (F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit(4)), F.lit(TRIAL)) == 0).alias("trial"))
    chosen = cut(chosen, "texts")
    out = pa.schema([("lang", pa.string()), ("gram", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(texts: list, part: pa.RecordBatch) -> pa.RecordBatch:
            by: dict[str, list] = {}
            for lang, text in zip(part.column("lang").to_pylist(), texts, strict=True):
                by.setdefault(lang, []).extend(np.unique(grams(x)) for x in steps(text))
            found = {lang: np.unique(np.concatenate(h)).view(np.int64) for lang, h in by.items() if h}
            langs = [lang for lang, h in found.items() for _ in range(len(h))]
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate([*found.values(), np.zeros(0, np.int64)]))], schema=out)

        yield from by_rows(batches, "text", work, rows=64)

    got = chosen.where("NOT trial").mapInArrow(run, "lang string, gram long").distinct().toPandas()
    by = {str(x): g.to_numpy(np.int64).view(np.uint64) for x, g in got.groupby("lang", sort=True)["gram"]}
    if not by:
        return Filters.empty([], 16, "und")
    most = {r["lang"]: r["n"] for r in sizes.where(F.col("lang").isin(list(by))).collect()}
    names = sorted(by, key=lambda x: (-most[x], x))  # of languages that claim as much, the more frequent one counts
    made = Filters.empty(names, 1 << max(12, (SLOTS * max(map(len, by.values()))).bit_length()), names[0])
    for k, x in enumerate(names):
        made.put(k, by[x])
    made.least = limit_of(chosen.where("trial"), made)
    return made


def limit_of(trial: DataFrame, filters: Filters) -> float:
    """Nine tenths of the score that all but a hundredth of the trial texts (lang, text) reach in their own language."""
    shared = trial.sparkSession.sparkContext.broadcast(filters)
    out = pa.schema([("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(texts: list, part: pa.RecordBatch) -> pa.RecordBatch:
            got = [shared.value.predict(x) for x in texts]
            return pa.RecordBatch.from_arrays([pa.array([s for (g, s), x in zip(got, part.column("lang").to_pylist(), strict=True) if g == x], pa.float64())], schema=out)

        yield from by_rows(batches, "text", work)

    scores = np.sort(trial.mapInArrow(run, "score double").toPandas()["score"].to_numpy())
    return float(0.9 * scores[len(scores) // 100]) if len(scores) else 0.0


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every whole text. `und` with score 0 if the text is null or has no letter.

    Ties go to the language with most training rows; repeated rows and null ids give a row each; an empty table gives no rows; other
    columns, whatever their names, are not read.
    """
    out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(texts: list, part: pa.RecordBatch) -> pa.RecordBatch:
            got = [shared.value.predict(x) for x in texts]
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], schema=out)

        yield from by_rows(batches, "text", work)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, filters: Filters, least: float | None = None, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a language with at least this score, by default that of the filters.

    Null texts and texts without letters go; repeated rows are judged one by one; an empty table gives no rows.
    """
    least = filters.least if least is None else least
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(texts: list, part: pa.RecordBatch) -> pa.RecordBatch:
            got = [shared.value.predict(x) for x in texts]
            return part.filter(pa.array([g[0] != "und" and g[1] >= least for g in got], pa.bool_()))

        yield from by_rows(batches, text_col, work)

    return docs.mapInArrow(run, docs.schema)
