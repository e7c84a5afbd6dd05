"""Toxicity by weak supervision.

1. Voters. A lexicon of insults and patterns of abuse is written down here. Further lexicon entries (words) and patterns (word
   beginnings) are proposed from a bounded labelled sample: every one with enough support that is far more frequent in toxic
   documents becomes a voter, without a cap on their number. Two more voters say "clean" when no lexicon entry or no pattern fires.
2. A generative label model is fitted to the votes of a bounded sample of documents by expectation maximisation. It sees no
   labels: the share of toxic documents, each voter's rates of firing on toxic and on clean documents (its accuracy) and
   the correlations of the voters given the latent class are all estimated from the votes. The correlation matrix is
   solved for the share of its evidence that each voter adds to the others', so voters that fire together count about once.
3. A linear classifier over the voters' counts is trained on the posteriors and scores every document. Where on its scale
   the decision lies is read off the labelled sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import by_rows, cut

#: Labelled rows of each class from which voters are proposed, and rows on which the label model is fitted; by a hash of the id.
SAMPLE, ROWS = 6000, 6000
#: A proposed voter occurs in this share of the toxic documents, and is this many times as frequent there as in clean ones.
SUPPORT, LIFT = 0.015, 20.0
#: A voter that does not fire abstains in part (it may be of another language): shares of its silence that may count as evidence. Training
#: takes the one that serves best in a cross-validation over the labelled sample, in FOLDS parts.
QUIETS, FOLDS = (0.25, 0.5, 0.75, 1.0), 5
#: What the share of clean documents flagged weighs against the share of toxic ones found.
FALSE_ALARM = 5.0
#: Lengths of word beginnings that serve as patterns.
PREFIXES = (3, 4, 5)
WORD = re.compile(r"[^\W\d_]+")
LEXICON = """
abomination airhead arsehole asshole bastard bigot bitch blockhead bonehead bootlicker buffoon bullshit chump clown clowns coward creep cretin crap
degenerate despicable dimwit dipshit dirtbag disgrace disgusting douche dumb dumbass dunce failure fat filth filthy fool fools freak fuck fucking
garbage goon gross halfwit hateful hideous hypocrite idiot idiotic idiots ignorant imbecile incompetent inferior jackass jerk lame liar loathsome
loser losers lowlife lunatic maggot moron moronic morons nasty nincompoop nitwit parasite pathetic pest pig prick psycho puke rat repulsive
revolting rubbish savage scum scumbag shit shithead shitty sicko simpleton slimy slob stupid sucker swine thug traitor trash twit ugly useless
vermin vile weasel weirdo whiner whore worthless wretch
""".split()
#: Name, words of which one must occur, and pattern.
PATTERNS = (
    ("~shut", {"shut"}, re.compile(r"\bshut (?:the \w+ |your \w+ )?up\b")),
    ("~hell", {"hell"}, re.compile(r"\b(?:go to|burn in|rot in) hell\b")),
    ("~kill", {"kill", "hang", "hurt"}, re.compile(r"\b(?:kill|hang|hurt) (?:yourself|yourselves|you|them all)\b")),
    ("~hate", {"hate", "despise", "detest"}, re.compile(r"\b(?:hate|despise|detest) (?:you|them all|your \w+)\b")),
    ("~dead", {"drop", "deserve", "hope"}, re.compile(r"\b(?:drop dead|deserves? to die|hope (?:you|they) die)\b")),
    ("~waste", {"waste", "piece", "bunch", "pack"}, re.compile(r"\b(?:waste of (?:space|air|oxygen|skin)|(?:piece|bunch|pack) of (?:\w+ )?(?:trash|garbage|filth|idiots|morons|liars|animals|rats|scum))\b")),
    ("~nobody", {"nobody", "everyone"}, re.compile(r"\b(?:nobody (?:likes|wants|needs|loves)|everyone hates) (?:you|your|them)\b")),
    ("~lost", {"get", "crawl", "go"}, re.compile(r"\b(?:get lost|crawl back|go back to your country)\b")),
    ("~you", {"you", "such"}, re.compile(r"\b(?:you|you're|you are|such) (?:an? |all |just |nothing but |really |so |complete |absolute |utter )*(?:" + "|".join(LEXICON) + r")\b")),
)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@dataclass
class Model:
    """features: entry -> column; entries that end in * are beginnings, those that start with ~ patterns. weights, bias: of the linear classifier."""

    features: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2))
    bias: float = -2.0

    @classmethod
    def over(cls, entries: list[str]) -> Model:
        return cls({x: k for k, x in enumerate(entries)}, np.zeros(len(entries) + 2))

    def counts(self, text: str | None) -> dict[int, int]:
        """How often each voter fires on a whole text."""
        found: dict[int, int] = {}
        get = self.features.get
        seen: dict[str, int] = {}
        lowered = text.lower() if text else ""
        for m in WORD.finditer(lowered):
            w = m[0]
            seen[w] = seen.get(w, 0) + 1
        for w, n in seen.items():
            k = get(w)
            if k is not None:
                found[k] = found.get(k, 0) + n
            for size in PREFIXES:
                if len(w) > size:
                    k = get(w[:size] + "*")
                    if k is not None:
                        found[k] = found.get(k, 0) + n
        for name, triggers, pattern in PATTERNS:
            if not triggers.isdisjoint(seen) and (k := get(name)) is not None and (n := sum(1 for _ in pattern.finditer(lowered))):
                found[k] = n
        return found

    def row(self, found: dict[int, int]) -> np.ndarray:
        """Votes of the lexicon and pattern voters as damped counts, and the two silent voters last."""
        x = np.zeros(len(self.features) + 2, np.float32)
        for k, n in found.items():
            x[k] = 1 + 0.5 * np.log(n)
        x[-2] = not any(self.is_word[k] for k in found)
        x[-1] = all(self.is_word[k] for k in found)
        return x

    def score(self, text: str | None) -> float:
        found, is_word = self.counts(text), self.is_word
        z = self.bias + sum(float(self.weights[k]) * (1 + 0.5 * np.log(n)) for k, n in found.items())
        z += float(self.weights[-2]) * (not any(is_word[k] for k in found)) + float(self.weights[-1]) * all(is_word[k] for k in found)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    @property
    def is_word(self) -> list[bool]:
        if not hasattr(self, "_is_word"):
            flags = [True] * len(self.features)
            for name, k in self.features.items():
                flags[k] = not (name.endswith("*") or name.startswith("~"))
            self._is_word = flags
        return self._is_word


def shares(corr: np.ndarray, n: int) -> np.ndarray:
    """What each voter adds to the others' evidence: the best linear combination under the correlations, shrunk by the
    number of rows they are known from. One for a voter on its own, about 1/k for each of k that always fire together."""
    shrink = max(0.02, len(corr) / (len(corr) + n))
    return np.clip(np.linalg.solve((1 - shrink) * corr + shrink * np.eye(len(corr)), np.ones(len(corr))), 0.0, 1.0)


def _correlation(centred: np.ndarray) -> np.ndarray:
    cov = (centred.T @ centred).astype(np.float64) / len(centred)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    corr = cov / np.outer(sd, sd)
    np.fill_diagonal(corr, 1.0)
    return corr


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 40, quiet: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From 0/1 votes of shape (rows, voters) and a first guess: the posterior of toxic per row, each voter's (rate on toxic,
    rate on clean), and the correlations given the class."""
    post, n = start.astype(np.float64), len(votes)
    votes = votes.astype(np.float32)
    # A class explains middling correlations and not those near one. Copies of a voter are known by the latter; without
    # this bound they would found a class of their own, in which they look independent. Powers keep the matrix definite.
    corr = _correlation(votes - votes.mean(axis=0))
    share = most = shares(corr**4, n)
    for turn in range(rounds):
        on, off = post.sum(), n - post.sum()
        hit1 = (votes.T @ post.astype(np.float32) + 0.05) / (on + 1)
        hit0 = (votes.T @ (1 - post).astype(np.float32) + 0.01) / (off + 1)
        if turn % 8 == 2:  # correlations given the latent class
            centred = votes - np.outer(post, hit1).astype(np.float32) - np.outer(1 - post, hit0).astype(np.float32)
            corr = _correlation(centred)
            share = np.minimum(shares(corr, n), most)
        fired = (np.log(hit1) - np.log(hit0)) * share
        prior = np.clip(on / n, 0.005, 0.5)
        silent = (np.log1p(-np.minimum(hit1, 0.999)) - np.log1p(-np.minimum(hit0, 0.999))) * share
        z = np.log(prior / (1 - prior)) + votes @ fired + quiet * ((1 - votes) @ silent)
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        moved = np.abs(new - post).max()
        post = new
        if turn > 12 and moved < 1e-4:
            break
    return post, np.stack([hit1, hit0]), corr


def linear(x: np.ndarray, target: np.ndarray, steps: int = 400, rate: float = 0.05, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by Adam; classes weigh the same."""
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    on = max(target.sum(), 1e-6)
    weight = np.where(target > 0.5, 0.5 * len(target) / on, 0.5 * len(target) / max(len(target) - on, 1e-6))
    weight = np.sqrt(weight)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        e = (p - target) * weight / len(target)
        g = np.concatenate([x.T @ e + ridge * w, [e.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """labels: doc_id and toxic. `usable` tells from a doc_id whether training may see its label or text.

    The driver gets the voters and their votes on about `rows` documents and the labelled sample. Null texts are left out,
    copies of a text count once, an empty table gives a model without voters but those written down.
    """
    told = labels.where(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    chosen = [told.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])  # at most 2 x sample ids
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull() & usable)
    share = int(min(1.0, rows / max(docs.count(), 1)) * 1_000_000)
    some = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < share
    # copies would make the words of one text look like a rule
    read = texts.join(F.broadcast(ids), "doc_id", "left").where(F.col("y").isNotNull() | some).groupBy("text").agg(F.max("y").cast("int").alias("y"))
    read = cut(read, "voted")
    out = pa.schema([("entry", pa.string()), ("y", pa.int32())])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(texts: list, part: pa.RecordBatch) -> pa.RecordBatch:
            names: list[str] = []
            ys: list[int] = []
            for text, y in zip(texts, part.column("y").to_pylist(), strict=True):
                words = set(words_of(text))
                own = words | {w[:size] + "*" for w in words for size in PREFIXES if len(w) > size}
                names += own
                ys += [y] * len(own)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ys, pa.int32())], schema=out)

        yield from by_rows(batches, "text", work, rows=64)

    labelled = read.where("y IS NOT NULL")
    size = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    hits = labelled.mapInArrow(entries, "entry string, y int").groupBy("entry").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    clean = F.col("n") - F.col("p")
    odds = F.log((F.col("p") + 0.5) / F.lit(pos + 1.0)) - F.log((clean + 0.5) / F.lit(neg + 1.0))
    often = (F.col("p") >= max(3, round(SUPPORT * pos))) & (odds > float(np.log(LIFT)))
    mined = [r["entry"] for r in hits.where(often).select("entry").orderBy("entry").collect()] if pos and neg else []
    model = Model.over(list(dict.fromkeys([*LEXICON, *(name for name, _, _ in PATTERNS), *mined])))
    schema = pa.schema([("y", pa.int32()), ("k", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(texts: list, part: pa.RecordBatch) -> pa.RecordBatch:
            found = [model.counts(x) for x in texts]
            return pa.RecordBatch.from_arrays([part.column("y"), pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))], schema=schema)

        yield from by_rows(batches, "text", work)

    seen = read.mapInArrow(votes, "y int, k array<int>, n array<int>").toPandas()
    x = np.zeros((len(seen), len(model.features) + 2), np.float32)
    for i, (k, n) in enumerate(zip(seen["k"], seen["n"], strict=True)):
        x[i] = model.row(dict(zip(np.asarray(k, int).tolist(), np.asarray(n, int).tolist(), strict=True)))
    # voters that never fire in the sample keep the weight of an average one, if they were written down
    live = np.flatnonzero((x > 0).any(axis=0)) if len(x) else np.zeros(0, int)
    fired = (x[:, live] > 0).astype(np.float32)
    tally = (x[:, :-2] > 0).sum(axis=1)
    if not len(x) or not tally.any():
        model.weights[:-2], model.bias = 3.0, -2.0
        return model
    y = seen["y"].to_numpy(float)
    known = ~np.isnan(y)
    best = None
    for quiet in QUIETS:
        post, _, _ = label_model(fired, np.where(tally > 0, 0.9, 0.05), quiet=quiet)
        weights, bias = linear(x[:, live], post)
        gain = trial((x[:, live] @ weights + bias)[known], y[known] > 0)
        if best is None or gain >= best[0]:
            best = gain, weights, bias
    _, weights, model.bias = best
    model.weights[:] = max(0.0, float(np.mean(weights[:-2])))
    model.weights[-2:] = 0.0
    model.weights[live] = weights
    model.bias -= decision((x @ model.weights + model.bias)[known], y[known] > 0)
    return model


def trial(z: np.ndarray, y: np.ndarray, folds: int = FOLDS) -> float:
    """Share of toxic rows found less FALSE_ALARM times the share of false alarms, each part decided by the limit of the others. Parts
    are dealt by falling log odds within each class, so they are alike; 0 where one class is missing."""
    if y.all() or not y.any():
        return 0.0
    part = np.empty(len(z), int)
    for side in (True, False):
        own = np.flatnonzero(y == side)
        part[own[np.argsort(-z[own], kind="stable")]] = np.arange(len(own)) % folds
    found = np.zeros(len(z), bool)
    for k in range(folds):
        here = part == k
        found[here] = z[here] > decision(z[~here], y[~here])
    return float(found[y].mean() - FALSE_ALARM * found[~y].mean())


def decision(z: np.ndarray, y: np.ndarray) -> float:
    """The log odds between two neighbouring rows where most of the toxic share found is left, FALSE_ALARM times the share of
    false alarms taken off. 0 where one class is missing."""
    if y.all() or not y.any():
        return 0.0
    order = np.argsort(-z, kind="stable")
    gain = np.cumsum(np.where(y[order], 1 / y.sum(), -FALSE_ALARM / (~y).sum()))
    ends = np.flatnonzero(np.concatenate([z[order][:-1] > z[order][1:], [True]]))
    best = ends[gain[ends].argmax()]
    below = z[order][best + 1] if best + 1 < len(z) else z[order][best] - 1
    return float((z[order][best] + below) / 2)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: more toxic) of every whole text; null counts as empty.

    Repeated rows and null ids give a row each; an empty table gives no rows; other columns are not read.
    """
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(texts: list, part: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([shared.value.score(x) for x in texts], pa.float64())], schema=out)

        yield from by_rows(batches, "text", work)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score below the limit. Null texts count as empty; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(texts: list, part: pa.RecordBatch) -> pa.RecordBatch:
            return part.filter(pa.array([shared.value.score(x) < limit for x in texts], pa.bool_()))

        yield from by_rows(batches, text_col, work)

    return docs.mapInArrow(run, docs.schema)
