"""Spelling variants by a relational trie frontier.

All words stand in a trie that is a table of edges (node, label, child). A search state is (word, position, node, edits); one join with
the edges moves all states a level down. A state without an edit may follow its label exactly or with one character inserted, deleted
or replaced; a state with one edit follows exact labels only. States that have used up their word at the end of another are neighbours.

Two things keep the frontier small. One edit leaves the first or the second half of a word whole, so there is a trie of the words and
one of the reversed words, and each word starts in both at the node of its whole half; the upper levels, where every word would meet
every letter, are never walked. And a chain of nodes without a branch is one edge with a long label, so the number of levels follows
the branches below a half, not the length of words. Edges carry the letters that can follow, which ends most states where they arise.

Nodes are named by a rolling hash of their prefix. A collision could only merge nodes, that is, add paths; pairs are checked by their
letters at the end.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import cut, forget

#: One (document, run) in so many loses a code point.
MISPRINT = 31
#: Least code points and occurrences of a word; a form is so many times as frequent as its variant.
LEAST, TWICE, TIMES = 7, 2, 10
#: Runs that can be words; shorter runs lose letters only.
RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST},}}")
NO_LETTER = re.compile("[^A-Za-zÀ-ÿ]")
#: Characters of a text that are cut into runs at a time, and words that a task counts before it hands them on.
STEP, HELD = 1 << 20, 100_000
BASE, PRIME = 1_000_003, (1 << 61) - 1


def runs(text: str) -> Iterator[list[str]]:
    """The runs of at least LEAST letters of a whole text, with A-Z lower-cased, step by step."""
    at = 0
    while at < len(text):
        end = NO_LETTER.search(text, at + STEP)
        end = end.start() if end else len(text)
        yield RUN.findall(text[at:end].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
        at = end


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least LEAST code points that occur at least TWICE, counted over all whole texts."""

    def flush(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                own: Counter = Counter()
                for part in runs(text.as_py() or ""):
                    own.update(part)
                doc_id = doc_id.as_py()
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), start)
                    if h % MISPRINT == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST:
                            continue
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield flush(held)
                    held.clear()
            pa.default_memory_pool().release_unused()
        yield flush(held)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TWICE)


def half(length: int, back: int) -> int:
    """Code points of the half that stays whole: of the first, or of the second read from its end."""
    return length - length // 2 if back else length // 2


def hashes(s: str, back: int) -> list[int]:
    """A rolling hash of each prefix of s, the empty one first; the two tries start from different values."""
    return list(accumulate(map(ord, s), lambda h, c: (h * BASE + c) % PRIME, initial=back + 1))


def prefixes(words: DataFrame) -> DataFrame:
    """(id, back, depth, node, next, fixed): the nodes below the half of each word, in both tries.

    `next` is the letter after the node, empty at the end of the word; `fixed` nodes are ends and those where words of about
    this length start.
    """

    names = ["id", "back", "depth", "node", "next", "fixed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        for batch in batches:
            for key, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(word)
                for back in (0, 1):
                    s = word[::-1] if back else word
                    starts = {half(n + d, back) for d in (-1, 0, 1)}
                    low = min(starts)
                    fixed = [False] * (n - low) + [True]
                    for x in starts:
                        if x <= n:
                            fixed[x - low] = True
                    here = [*s[low:], ""]
                    for column, values in zip(out, ([key] * len(here), [back] * len(here), range(low, n + 1), hashes(s, back)[low:], here, fixed), strict=True):
                        column.extend(values)
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)
                    out = [[] for _ in names]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

    return words.select("id", "word").mapInArrow(run, "id long, back long, depth long, node long, next string, fixed boolean")


def letters(back: str = "back") -> Column:
    """The word as its trie reads it."""
    return F.when(F.col(back) == 1, F.reverse("word")).otherwise(F.col("word"))


def build_trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distributed tries of the words: edges (node, first, label, child, follow, ends) and, of each word, (node, word, n) of its end.

    `follow` holds the first letters of the child's own edges and `ends` says whether a word ends there.
    """
    steps = cut(prefixes(words), "prefixes")
    forks = steps.groupBy("node").agg(F.min("next").alias("a"), F.max("next").alias("b")).where("a <> b").select("node", F.lit(True).alias("fork"))
    kept = steps.join(forks, "node", "left").where("fixed OR fork").groupBy("id", "back").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("path"))
    path = kept.select("id", "back", F.expr("inline(transform(slice(path, 1, size(path) - 1), (x, i) -> struct(x.depth AS depth, x.node AS node, path[i + 1].depth AS upto, path[i + 1].node AS child)))"))
    label = F.substring(letters(), F.col("depth").cast("int") + 1, (F.col("upto") - F.col("depth")).cast("int"))
    edges = path.join(words, "id").select("node", label.alias("label"), "child").distinct()
    edges = cut(edges.select("node", F.substring("label", 1, 1).alias("first"), "label", "child"), "edges")
    ends = steps.where("next = ''").select("id", "node").join(words, "id").select("node", "word", "n")
    ends = cut(ends, "ends")
    follow = edges.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_set("first"), "").alias("follow"))
    final = ends.select(F.col("node").alias("child"), F.lit(True).alias("ends")).distinct()
    known = cut(edges.join(follow, "child", "left").join(final, "child", "left").select("node", "first", "label", "child", F.coalesce("follow", F.lit("")).alias("follow"), F.coalesce("ends", F.lit(False)).alias("ends")), "trie")
    forget(steps, edges)
    return known, ends


def seeds(words: DataFrame) -> DataFrame:
    """The first frontier: each word in both tries, at the node of the half that stays whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word in batch.column(0).to_pylist():
                for back in (0, 1):
                    upto = half(len(word), back)
                    rows.append((word, back, upto, hashes((word[::-1] if back else word)[:upto], back)[-1]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["word", "back", "pos", "node"])

    return words.select("word").mapInArrow(run, "word string, back long, pos long, node long").select("word", "back", "pos", "node", F.lit(0).alias("edits"))


def alive(pos: str) -> str:
    """A state with its edit lives on at pos if an edge can follow, and is done if another word ends where its own does."""
    return f"(length(s) = {pos} AND ends OR length(s) > {pos} AND instr(follow, substring(s, int({pos}) + 1, 1)) > 0)"


#: A state without an edit meets a label of k letters: exactly, or by one edit against k, k - 1 or k + 1 letters of its word. Any letter
#: stands for another by one edit, and any letter can be inserted, so most labels need no edit distance.
SAME = "substring(s, int(pos) + 1, k) = label"
REPLACED = f"{alive('pos + k')} AND (k = 1 OR levenshtein(label, substring(s, int(pos) + 1, k), 1) = 1)"
INSERTED = f"{alive('pos + k - 1')} AND (k = 1 OR levenshtein(label, substring(s, int(pos) + 1, k - 1), 1) = 1)"
DELETED = f"{alive('pos + k + 1')} AND levenshtein(label, substring(s, int(pos) + 1, k + 1), 1) = 1"


def level(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """All states one edge further."""
    own = frontier.withColumn("s", letters())
    free = own.where("edits = 0").drop("edits").join(edges.drop("first"), "node").withColumn("k", F.length("label"))
    free = free.withColumn("same", F.expr(SAME)).selectExpr(
        "word", "back", "child", "same", "k", "pos", f"NOT same AND {REPLACED} AS replaced", f"{INSERTED} AS inserted", f"{DELETED} AS deleted"
    )
    ways = [f"if({flag}, struct(pos + k{d} AS pos, {n} AS edits), null)" for flag, d, n in (("same", "", 0), ("replaced", "", 1), ("inserted", " - 1", 1), ("deleted", " + 1", 1))]
    free = free.where("same OR replaced OR inserted OR deleted").selectExpr("word", "back", "child", f"inline(array({', '.join(ways)}))").where("pos IS NOT NULL")
    bound = own.where("edits = 1 AND length(s) > pos").withColumn("first", F.expr("substring(s, int(pos) + 1, 1)")).join(edges, ["node", "first"])
    bound = bound.where("substring(s, int(pos) + 1, length(label)) = label").withColumn("pos", F.col("pos") + F.length("label")).where(alive("pos"))
    return free.unionByName(bound.select("word", "back", "child", "pos", "edits")).select("word", "back", "pos", F.col("child").alias("node"), "edits")


#: A word is used up with its edit, or its last letter is the one too many.
DONE = "edits = 1 AND pos = length(word) OR edits = 0 AND pos = length(word) - 1"


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near, n of near): all ordered pairs that differ by one inserted, deleted or replaced code point."""
    edges, ends = build_trie(words)
    frontier, done = cut(seeds(words), "frontier"), None
    levels = [frontier]
    while not frontier.isEmpty():
        at_end = frontier.where(DONE).select("word", "node")
        done = at_end if done is None else done.union(at_end)
        frontier = cut(level(frontier, edges), "frontier")
        levels.append(frontier)
    if done is None:
        done = frontier.select("word", "node")
    pairs = done.join(ends.select("node", F.col("word").alias("near"), "n"), "node").where("word <> near AND levenshtein(word, near, 1) = 1")
    found = cut(pairs.groupBy("word", "near").agg(F.max("n").alias("n")), "near")
    forget(*levels, edges, ends)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): follows forms to the last. Frequencies grow tenfold with each form, so doubling ends after a few joins."""
    known = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = known.select(F.col("word").alias("root"), F.col("root").alias("far"))
        further = cut(known.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        ended = further.where("moved").isEmpty()
        forget(known)
        known = further.drop("moved")
        if ended:
            return known


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word.

    Null texts have no words. Rows with a null id are read with an empty id; rows that repeat an id count each. Of near words with equal n the
    smallest in code-point order is the form. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    counted = cut(count_words(docs, id_col, text_col), "counted")
    words = cut(counted.withColumn("id", F.monotonically_increasing_id()), "words")
    near = neighbours(words)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "near")).alias("best"))
    joined = cut(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.expr(f"if(-best.n >= {TIMES} * n, best.near, null)").alias("form"),
            F.expr(f"if(-best.n >= {TIMES} * n, -best.n, null)").alias("form_n"),
        ), "forms",
    )
    forget(counted, near)
    ends = roots(joined.where("form IS NOT NULL"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) - 64 AS BIGINT)] END)) AS bytes FROM d),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM b, tab),
m AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
v AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM p),
e AS (SELECT x.word, y.word AS near, y.n FROM v x JOIN v y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.a || v.z = w.word
  UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.a || v.z = w.word),
g AS (SELECT word, count(*) AS n_near, min(struct_pack(a := -n, b := near)) AS best FROM e GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.a >= 10 * w.n THEN best.b END AS form, CASE WHEN -best.a >= 10 * w.n THEN -best.a END AS form_n FROM w LEFT JOIN g USING (word)),
c AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c USING (word) JOIN f AS last ON last.word = c.root WHERE last.form IS NULL
"""
