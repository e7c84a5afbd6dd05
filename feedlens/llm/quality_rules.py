"""Quality rules whose cut-offs come from the corpus: quantile sketches per language and source, then a joined filter.

The limit of a group is the quantile KEEP of its own sketch; no constant is added to it. How far a group is trusted follows
from its size without a switch: its quantile and that of its language are averaged with weights n and PULL documents, and
that of the language was averaged with the corpus' before in the same way.

A sketch is a table of (bucket, count) rows. A bucket is named by its largest value; it is one per-mille value below 128 and holds
those with the same seven highest bits above, so a quantile is exact or at most 1/64 above its value, and never below it. Two sketches merge by adding counts, which makes
the map-side combine of a hot source a merge too, and gives the sketch of a language from those of its sources.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from feedlens.llm.common import by_rows, cut

SYMBOLS = b"#*$%&|<>"
BLANK = b" \t\n\x0b\x0c\r"
BREAK = re.compile(rb"[ \t-\r]").search
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_lines")
#: metric -> (numerator, denominator); its value is their ratio in per mille.
METRICS = {
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "upper": ("n_upper", "n_letters"),
    "word_len": ("word_chars", "n_words"),
}
#: Per cent of a group's documents that each metric's limit lets through.
KEEP = 95
#: Documents that the wider sketch counts for when limits are averaged.
PULL = 50
#: Bytes of a text that are cut into words at a time.
STEP = 1 << 20


def word_numbers(raw: bytes) -> np.ndarray:
    """The words between blanks, numbered by first appearance. Only distinct words are held besides a step of the text."""
    known: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(raw):
        end = BREAK(raw, at + STEP)
        end = end.start() if end else len(raw)
        words = raw[at:end].split()  # on the six ASCII blanks only
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def repeated_words(ids: np.ndarray) -> int:
    """Words in windows of five that occur twice or more. Windows are numbered exactly, from the numbers of their halves."""
    if len(ids) < 6:
        return 0
    number = lambda a, b: np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]
    two = number(ids[:-1], ids[1:])
    five = number(number(two[:-2], two[2:])[:-1], ids[4:])
    again = np.bincount(five)[five] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[: len(again)] += again
    edge[5 : 5 + len(again)] -= again
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def count_text(text: str | None) -> tuple[int, ...]:
    """COUNTS of one whole text; a null text has no words."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    ids = word_numbers(raw)
    n = len(ids)
    chars = len(text) - (len(raw) - len(raw.translate(None, BLANK)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line.translate(None, BLANK):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = repeated_words(ids)
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    letters = sum(map(str.isalpha, text))
    return n, chars, symbols, dup, repeat, upper, letters, lines


def count_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, source and COUNTS; one Arrow pass over whole texts."""
    kept = [("doc_id", T.LongType()), ("lang", T.StringType()), ("source", T.StringType())]
    schema = T.StructType([*(T.StructField(n, t) for n, t in kept), *(T.StructField(c, T.LongType()) for c in COUNTS)])
    out = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *((c, pa.int64()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(texts: list, part: pa.RecordBatch) -> pa.RecordBatch:
            rows = [count_text(x) for x in texts]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(COUNTS))]
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *columns], schema=out)

        yield from by_rows(batches, "text", work)

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.col(text_col).cast("string").alias("text"),
    ).mapInArrow(run, schema)


def _share(metric: str) -> Column:
    top, bottom = METRICS[metric]
    return F.coalesce(F.floor(F.lit(1000) * F.col(top) / F.nullif(F.col(bottom), F.lit(0))), F.lit(0)).cast("long")


def _bucket(value: Column) -> Column:
    """The largest value with the same seven highest bits."""
    low = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low) + 1, low) - 1


def limits(counts: DataFrame) -> DataFrame:
    """Limits per (lang, source), by name of metric, from the sketches of the group, its language and the corpus."""
    long_form = counts.where("n_words > 0").select(
        "lang", "source", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), _bucket(_share(m)).alias("bucket")) for m in METRICS)))
    )
    sketch = long_form.groupBy("lang", "source", "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))

    def quantiles(keys: list[str], tag: str) -> DataFrame:
        merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
        group = W.Window.partitionBy(*keys, "metric")
        upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, 0))
        ranked = merged.select("*", F.sum("n").over(group).alias("total"), upto.alias("upto"))
        reached = F.when(100 * F.col("upto") >= KEEP * F.col("total"), F.col("bucket"))
        return ranked.groupBy(*keys, "metric").agg(F.min(reached).alias(f"q{tag}"), F.max("total").alias(f"t{tag}"))

    own, of_all = quantiles(["lang", "source"], "0"), quantiles([], "2")
    of_lang = quantiles(["lang"], "1").join(of_all, "metric")
    wide = F.expr(f"(t1 * q1 + {PULL} * q2) div (t1 + {PULL})")
    of_lang = of_lang.select(F.col("lang").alias("_l"), F.col("metric").alias("_m"), wide.alias("q1"))
    joined = own.join(of_lang, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("metric") == F.col("_m")))
    limit = F.expr(f"(t0 * q0 + {PULL} * q1) div (t0 + {PULL})")
    return joined.groupBy("lang", "source").agg(*(F.max(F.when(F.col("metric") == m, limit)).alias(f"limit_{m}") for m in METRICS))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every document, the limits of its (lang, source) group, base_failed and kept.

    A document is kept when it has ten words or more, at most a fifth of them in repeated five-word windows, and no
    metric above its group's limit. Null texts have no words and fail. Null languages and sources form groups of their
    own. Rows that repeat an id are judged one by one; an empty table gives no rows. Columns besides id, text, lang and
    source, whatever their names, are not read.
    """
    counts = cut(count_texts(docs, id_col, text_col), "rules")
    lim = limits(counts).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *(f"limit_{m}" for m in METRICS))
    joined = counts.join(lim, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fine = F.lit(True)
    for m in METRICS:
        fine = fine & (_share(m) <= F.coalesce(F.col(f"limit_{m}"), F.lit(2**62)))  # a group without words has no limits and fails
    return joined.select(
        "doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & fine).alias("kept"),
        *(_share(m).alias(f"share_{m}") for m in METRICS), *(f"limit_{m}" for m in METRICS),
    )


def oracle() -> str:
    """DuckDB SQL for the query's rows, with the same sketches."""
    share = lambda m: f"CAST(coalesce(floor(1000 * {METRICS[m][0]} / nullif({METRICS[m][1]}, 0)), 0) AS BIGINT)"
    low = "greatest(length(bin(v)) - 7, 0)"
    shares = ", ".join(f"{share(m)} AS share_{m}" for m in METRICS)

    def quantiles(name: str, keys: str) -> str:
        first = f"{keys}, " if keys else ""
        ranked = f"SELECT {first}metric, bucket, sum(n) OVER (PARTITION BY {first}metric) AS total, sum(n) OVER (PARTITION BY {first}metric ORDER BY bucket) AS upto FROM (SELECT {first}metric, bucket, sum(n) AS n FROM k GROUP BY ALL)"
        return f"{name} AS (SELECT {first}metric, min(bucket) FILTER (100 * upto >= {KEEP} * total) AS q, max(total) AS t FROM ({ranked}) GROUP BY ALL)"

    pivot = ", ".join(f"CAST(max(v) FILTER (metric = '{m}') AS BIGINT) AS limit_{m}" for m in METRICS)
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
h AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM h) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT d.doc_id, d.lang, d.source, len(w.words) AS n_words, length(array_to_string(w.words, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n.n_dup_lines, 0) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '\p{{L}}')) AS n_letters, coalesce(n.n_lines, 0) AS n_lines
  FROM d JOIN w ON w.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id),
long0 AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {share(m)} AS v FROM c WHERE n_words > 0" for m in METRICS)}),
long_ AS (SELECT lang, source, metric, (((v >> {low}) + 1) << {low}) - 1 AS bucket FROM long0),
k AS (SELECT lang, source, metric, bucket, count(*) AS n FROM long_ GROUP BY ALL),
{quantiles("o", "lang, source")}, {quantiles("l", "lang")}, {quantiles("a", "")},
e AS (SELECT l.lang, l.metric, (l.t * l.q + {PULL} * a.q) // (l.t + {PULL}) AS q FROM l JOIN a USING (metric)),
t AS (SELECT o.lang, o.source, o.metric, (o.t * o.q + {PULL} * e.q) // (o.t + {PULL}) AS v FROM o JOIN e ON e.lang IS NOT DISTINCT FROM o.lang AND e.metric = o.metric),
p AS (SELECT lang, source, {pivot} FROM t GROUP BY lang, source),
j AS (SELECT c.*, {shares}, p.* EXCLUDE (lang, source) FROM c LEFT JOIN p ON p.lang IS NOT DISTINCT FROM c.lang AND p.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {" AND ".join(f"share_{m} <= limit_{m}" for m in METRICS)} AS kept, {", ".join(f"share_{m}, limit_{m}" for m in METRICS)}
FROM j
"""
