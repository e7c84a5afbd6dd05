"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover it whole. Bytes are embedded, learned filters slide over each chunk,
their responses are max-pooled and, squared off against a hidden layer, give features of the chunk. The mean and the
maximum of these features over all chunks are combined by a logistic unit into one probability. Training is plain
back-propagation with Adam over a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import by_rows

CHUNK, OVERLAP = 256, 32
EMBED, WIDTH, STEP, FILTERS, HIDDEN = 8, 6, 2, 32, 16
#: Labelled rows of each class that training reads at most; their texts are read whole.
SAMPLE = 1200


def chunks_of(text: str | None) -> np.ndarray:
    """(chunks, CHUNK) bytes that cover the whole text; an empty text is one chunk of zeros, and zeros fill the last."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    hop = CHUNK - OVERLAP
    n = max(1, -(-max(len(raw) - OVERLAP, 1) // hop))
    padded = np.zeros((n - 1) * hop + CHUNK, np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::hop]


@dataclass
class Net:
    embed: np.ndarray
    conv: np.ndarray
    conv_b: np.ndarray
    hid: np.ndarray
    hid_b: np.ndarray
    out: np.ndarray
    out_b: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 7) -> Net:
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        return cls(
            f(256, EMBED, scale=0.5), f(WIDTH * EMBED, FILTERS, scale=0.2), np.zeros(FILTERS, np.float32),
            f(FILTERS, HIDDEN, scale=0.25), np.zeros(HIDDEN, np.float32), f(2 * HIDDEN, scale=0.2), np.zeros(1, np.float32),
        )

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.conv_b, self.hid, self.hid_b, self.out, self.out_b]

    def pooled(self, chunks: np.ndarray, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled filter responses of each chunk, and where they are, in blocks that stay in the cache."""
        out, at = np.empty((len(chunks), FILTERS), np.float32), np.empty((len(chunks), FILTERS), np.int64)
        for lo in range(0, len(chunks), block):
            part = chunks[lo : lo + block]
            e = self.embed[part].reshape(len(part), CHUNK * EMBED)
            windows = np.lib.stride_tricks.sliding_window_view(e, WIDTH * EMBED, axis=1)[:, :: STEP * EMBED]
            r = np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBED) @ self.conv
            r = r.reshape(len(part), -1, FILTERS)
            at[lo : lo + block] = r.argmax(axis=1)
            out[lo : lo + block] = np.take_along_axis(r, at[lo : lo + block, None, :], axis=1)[:, 0]
        return out + self.conv_b, at

    def maxima(self, chunks: np.ndarray, block: int = 128) -> np.ndarray:
        """As pooled, without places, in blocks that stay in the cache."""
        out = np.empty((len(chunks), FILTERS), np.float32)
        for lo in range(0, len(chunks), block):
            part = chunks[lo : lo + block]
            e = self.embed[part].reshape(len(part), CHUNK * EMBED)
            windows = np.lib.stride_tricks.sliding_window_view(e, WIDTH * EMBED, axis=1)[:, :: STEP * EMBED]
            r = np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBED) @ self.conv
            out[lo : lo + block] = r.reshape(len(part), -1, FILTERS).max(axis=1)
        return out + self.conv_b

    def combine(self, pooled: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Logits of texts whose chunks start at `starts`."""
        h = np.maximum(np.maximum(pooled, 0) @ self.hid + self.hid_b, 0)
        n = np.diff(np.concatenate([starts, [len(h)]]))[:, None]
        both = np.concatenate([np.add.reduceat(h, starts, axis=0) / n, np.maximum.reduceat(h, starts, axis=0)], axis=1)
        return both @ self.out + self.out_b[0]

    def scores(self, texts: list[str | None], most: int = 4096) -> np.ndarray:
        """Probabilities of quality for whole texts."""
        pooled, starts, waiting, n = [], [], [], 0

        def flush() -> None:
            if waiting:
                pooled.append(self.maxima(np.concatenate(waiting)))
                waiting.clear()

        held = 0
        for text in texts:
            c = chunks_of(text)
            starts.append(n)
            n += len(c)
            waiting.append(c)
            held += len(c)
            if held >= most:
                flush()
                held = 0
        flush()
        if not starts:
            return np.zeros(0)
        z = self.combine(np.concatenate(pooled), np.array(starts))
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))

    def gradients(self, chunks: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        pooled, at = self.pooled(chunks)
        p = np.maximum(pooled, 0)
        a = p @ self.hid + self.hid_b
        h = np.maximum(a, 0)
        n = np.diff(np.concatenate([starts, [len(h)]]))
        owner = np.repeat(np.arange(len(starts)), n)
        mean = np.add.reduceat(h, starts, axis=0) / n[:, None]
        top = np.maximum.reduceat(h, starts, axis=0)
        both = np.concatenate([mean, top], axis=1)
        z = np.clip(both @ self.out + self.out_b[0], -30, 30)
        q = 1 / (1 + np.exp(-z))
        loss = float(-(weight * (y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7))).mean())
        dz = ((q - y) * weight / len(y)).astype(np.float32)
        d_out, d_out_b = both.T @ dz, np.array([dz.sum()], np.float32)
        d_both = dz[:, None] * self.out[None, :]
        is_top = h == top[owner]
        is_top = is_top / np.maximum(np.add.reduceat(is_top, starts, axis=0), 1)[owner]
        dh = d_both[owner, :HIDDEN] / n[owner][:, None] + d_both[owner, HIDDEN:] * is_top
        da = (dh * (a > 0)).astype(np.float32)
        d_hid, d_hid_b = p.T @ da, da.sum(axis=0)
        dp = (da @ self.hid.T) * (pooled > 0)
        # only the window that won the pool has a gradient
        d_conv, d_embed = np.zeros_like(self.conv), np.zeros((256, EMBED), np.float32)
        for lo in range(0, len(chunks), 512):
            part, dpart = chunks[lo : lo + 512], dp[lo : lo + 512]
            begin = at[lo : lo + 512] * STEP
            bytes_at = part[np.arange(len(part))[:, None, None], begin[:, :, None] + np.arange(WIDTH)]
            x = self.embed[bytes_at].reshape(len(part), FILTERS, WIDTH * EMBED)
            d_conv += np.einsum("cfw,cf->wf", x, dpart, optimize=True).astype(np.float32)
            back = (dpart[:, :, None] * self.conv.T[None]).reshape(-1, EMBED)
            np.add.at(d_embed, bytes_at.reshape(-1), back)
        return loss, [d_embed, d_conv, dp.sum(axis=0), d_hid, d_hid_b, d_out.astype(np.float32), d_out_b]


def fit(samples: list[np.ndarray], y: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.004, seed: int = 7) -> Net:
    """samples: (chunks, CHUNK) bytes of each text; y: 0 or 1. Classes weigh the same."""
    net = Net.fresh(seed)
    if not len(y):
        return net
    share = np.clip(y.mean(), 0.02, 0.98)
    weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    m, v = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    rng, t = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            chunks = np.concatenate([samples[k] for k in pick])
            starts = np.cumsum([0, *(len(samples[k]) for k in pick)])[:-1]
            _, grads = net.gradients(chunks, starts, y[pick].astype(np.float32), weight[pick])
            t += 1
            now = rate * (0.5 if epoch >= epochs // 2 else 1.0)
            for p, g, a, b in zip(net.params(), grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= now * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-7)
    # good texts are to pass the usual limit of 0.7: all but a hundredth of those seen in training
    starts = np.cumsum([0, *map(len, samples)])[:-1]
    z = net.combine(net.maxima(np.concatenate(samples)), starts)[y > 0.5]
    if len(z):
        net.out_b += np.float32(np.clip(np.log(0.7 / 0.3) - np.quantile(z, 0.01), 0, 1.5))
    return net


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Net:
    """labels: doc_id and quality. `usable` tells from a label's doc_id whether training may see it. The driver gets at
    most 2 x sample whole texts."""
    told = labels.where(usable & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    chosen = [told.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])  # at most 2 x sample ids
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "text", F.col("y").cast("int").alias("y"))
    out = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("chunks", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(texts: list, part: pa.RecordBatch) -> pa.RecordBatch:
            raw = [np.ascontiguousarray(chunks_of(text)).tobytes() for text in texts]
            return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(raw, pa.binary())], schema=out)

        yield from by_rows(batches, "text", work)

    got = rows.mapInArrow(run, "doc_id long, y int, chunks binary").toPandas().sort_values("doc_id", kind="stable")
    samples = [np.frombuffer(x, np.uint8).reshape(-1, CHUNK) for x in got["chunks"]]
    return fit(samples, got["y"].to_numpy(float))


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every whole text; null counts as empty."""
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(texts: list, part: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.scores(texts), pa.float64())], schema=out)

        yield from by_rows(batches, "text", work)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")
