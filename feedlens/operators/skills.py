"""Weighted skill demand of whole postings: one automaton over all keywords of a catalog, read once per posting.

A posting is a row, so nothing is shuffled: the columns of its fields go through one Arrow pass and come back as a list of demands.
The cost of a posting follows its length and its hits, not the number of skills.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.functions import dictionaries as D
from feedlens.functions import skills as S
from feedlens.functions import text

#: Characters that continue a word at a keyword's edge.
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+#&")
YEARS = re.compile(rb"[0-9].{0,7}year", re.S)
#: Weight of a tag, which the source itself gave, and the tones from strongest to weakest claim on a line.
TAG_WEIGHT, TONES = 3.0, ("learn", "nice", "must")
#: Fields in reading order; the last is read where all others but the title are empty.
FIELDS = ("title", "requirements", "responsibilities", "description", "scraped")

DEMAND = T.ArrayType(T.StructType([T.StructField("skill", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("emphasis", T.IntegerType())]))
DEMAND_ARROW = pa.list_(pa.struct([("skill", pa.string()), ("weight", pa.float64()), ("emphasis", pa.int32())]))


#: So many rows of a batch are Python values at a time.
ROWS = 256


def lower(value: str) -> str:
    """Lower-cases A-Z; all keywords are ASCII."""
    return value.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


class Matcher:
    """All keywords in one automaton. A blank at a keyword's end asks for a word boundary there."""

    def __init__(self, catalog: S.Catalog):
        import ahocorasick

        known: dict[str, list[tuple[int, bool, bool, bool, bool]]] = {}
        for at, (name, _, words) in enumerate(catalog.skills):
            tight = catalog.tight.get(name)
            for short, long, list_ in ((True, tight is None, words), *(((False, True, tight),) if tight is not None else ())):
                for word in list_:
                    if literal := lower(word.strip(" ")):
                        known.setdefault(literal, []).append((at, word.startswith(" "), word.endswith(" "), short, long))
        self.automaton = ahocorasick.Automaton()
        for literal, uses in known.items():
            self.automaton.add_word(literal, (len(literal), uses))
        self.any = bool(known)
        if known:
            self.automaton.make_automaton()

    def hits(self, low: str, long: bool) -> Iterator[tuple[int, int]]:
        """(start, skill) of every keyword that stands on its boundaries."""
        if not self.any:
            return
        n = len(low)
        for end, (size, uses) in self.automaton.iter(low):
            start = end + 1 - size
            for skill, left, right, in_short, in_long in uses:
                if (in_long if long else in_short) and not (left and start and low[start - 1] in WORD) and not (right and end + 1 < n and low[end + 1] in WORD):
                    yield start, skill


class Reader:
    """Demands of one posting after another."""

    def __init__(self, catalog: S.Catalog, cues: Sequence[Sequence[str]], long_bytes: int, heading: int):
        import ahocorasick

        self.catalog, self.matcher, self.long_bytes, self.heading = catalog, Matcher(catalog), long_bytes, heading
        self.cues = ahocorasick.Automaton()
        for rank in (2, 1, 0):
            for cue in cues[rank]:
                self.cues.add_word(cue, rank)
        self.cues.make_automaton()
        self.tags: dict[str, int] = {}
        for at, name in enumerate(catalog.names):
            self.tags.setdefault(skill_key(name), at)

    def read(self, fields: Sequence[str | None], tags: Sequence[str | None] | None) -> list[tuple[str, float, int]]:
        """fields: title, requirements, responsibilities, description and the scraped line, in that order."""
        lines: list[tuple[str, str]] = []
        for k, (name, value) in enumerate(zip(FIELDS, fields, strict=True)):
            if k == len(FIELDS) - 1 and any(f != "title" for f, _ in lines):
                break
            lines += [(name, x) for line in (value or "").split("\n") if (x := line.strip())]
        low = lower("\n".join([*(x for _, x in lines), ""]))
        size = len(low.encode("utf-8", "surrogatepass"))
        starts, at = [], 0
        for _, x in lines:
            starts.append(at)
            at += len(x) + 1
        named: dict[int, set[int]] = {}
        for start, skill in self.matcher.hits(low, size > self.long_bytes):
            named.setdefault(bisect_right(starts, start) - 1, set()).add(skill)
        tagged = {self.tags[k] for t in tags or () if t and (k := skill_key(t)) in self.tags}
        if not named and not tagged:
            return []
        own: dict[int, int] = {}
        for end, rank in self.cues.iter(low):
            line = bisect_right(starts, end) - 1
            own[line] = min(own.get(line, 3), rank)
        weight: dict[int, float] = {}
        count: dict[int, int] = {}
        emphasis: dict[int, int] = {}
        asked: set[int] = set(tagged)
        field, sticky = None, "plain"
        for i, (name, _) in enumerate(lines):
            if name != field:
                field, sticky = name, "plain"
            line = low[starts[i] : starts[i + 1] - 1 if i + 1 < len(lines) else len(low) - 1]
            tone = TONES[own[i]] if i in own else None
            if tone is None and "year" in line and YEARS.search(line.encode("utf-8", "surrogatepass")):
                tone = "must"
            if i not in named:
                if len(line.encode("utf-8", "surrogatepass")) <= self.heading:
                    if tone in ("nice", "learn"):
                        sticky = tone
                    elif line.endswith(":"):
                        sticky = tone or "plain"
                continue
            tone = tone or sticky
            if tone == "must" and sticky == "nice":
                tone = "nice"
            base, plain = D.FIELDS[name]
            said = {"must": 0, "nice": 1, "learn": 2}.get(tone, plain)
            for skill in named[i]:
                k = count.get(skill, 0)
                weight[skill] = weight.get(skill, 0.0) + base * D.TONE_FACTOR[tone] / (1 + 0.5 * k)
                count[skill] = k + 1
                emphasis[skill] = min(emphasis.get(skill, 2), said)
                if tone != "learn":
                    asked.add(skill)
        for skill in tagged:
            weight[skill] = weight.get(skill, 0.0) + TAG_WEIGHT
            emphasis[skill] = 0
        names = self.catalog.names
        return [(names[s], weight[s], emphasis[s]) for s in sorted(asked)]


def skill_key(name: str) -> str:
    """Letters, digits, + and # in lower case, without a trailing js."""
    kept = "".join(c for c in name if c.isalnum() or c in "+#").lower()
    return kept[:-2] if len(kept) > 2 and kept.endswith("js") else kept


def by_slices(work: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """work over slices of few rows, as lists. The results of a batch stand ready as Arrow only, so a worker's memory follows the batch's bytes."""
    parts = [work(*(c.slice(at, ROWS).to_pylist() for c in columns)) for at in range(0, max(len(columns[0]), 1), ROWS)]
    return pa.concat_arrays(parts)


def posting_demand(
    catalog: S.Catalog, title: Column, requirements: Column, responsibilities: Column, description: Column, scraped: Column, tags: Column | None = None,
    cues: Sequence[Sequence[str]] = (D.LEARN_CUES, D.NICE_CUES, D.MUST_CUES), long_bytes: int = 400, heading: int = 90,
) -> Column:
    """Demands of a posting as array<struct<skill, weight, emphasis>> in the catalog's order; emphasis 0 must, 1 nice, 2 mentioned.

    A short line that names no skill and carries a cue, or ends in a colon, sets the tone of the lines below it in its field. The n-th line that
    names a skill counts 1 / (1 + n / 2). In texts over `long_bytes` only the tighter keywords of ambiguous names count. Tags that name a
    skill of the catalog are trusted outright. Null fields are empty. The automaton is built once per task.
    """
    reader: list[Reader] = []

    @F.arrow_udf(DEMAND)
    def run(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array, e: pa.Array, t: pa.Array) -> pa.Array:
        if not reader:
            reader.append(Reader(catalog, cues, long_bytes, heading))

        def work(*lists: list) -> pa.Array:
            found = (reader[0].read(row[:5], row[5]) for row in zip(*lists, strict=True))
            return pa.array([[{"skill": s, "weight": w, "emphasis": m} for s, w, m in x] for x in found], DEMAND_ARROW)

        return by_slices(work, a, b, c, d, e, t)

    tags = tags if tags is not None else F.array().cast("array<string>")
    return run(*(c.cast("string") for c in (title, requirements, responsibilities, description, scraped)), tags.cast("array<string>"))


def demand_rows(postings: DataFrame, demand: str = "demand", *keys: str) -> DataFrame:
    """One row per posting and skill: the keys, skill, weight, emphasis."""
    return postings.select(*keys, F.inline(demand))


def coverage_of(demand: Column, owned: Column, least: int = 2) -> Column:
    """struct(coverage, asked, have): weighted share of the demanded skills that `owned` (array) has, within the row; null below `least`."""
    has = lambda s: F.array_contains(owned, s["skill"])
    total = lambda rows: F.aggregate(rows, F.lit(0.0), lambda a, s: a + s["weight"])
    asked, met = F.size(demand), F.filter(demand, has)
    return F.struct(F.when(asked >= least, total(met) / F.nullif(total(demand), F.lit(0.0))).alias("coverage"), asked.cast("long").alias("asked"), F.size(met).cast("long").alias("have"))


def names_in(catalog: S.Catalog, texts: Column, strict: bool = True, long_bytes: int = 400) -> Column:
    """The catalog's skills that a free text names, in its order. strict: tighter keywords whatever the length, as for résumé bullets."""
    matcher: list[Matcher] = []
    names = catalog.names

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(a: pa.Array) -> pa.Array:
        if not matcher:
            matcher.append(Matcher(catalog))

        def work(values: list) -> pa.Array:
            out = []
            for value in values:
                low = lower(f" {value or ''} ")
                long = strict or len(low.encode("utf-8", "surrogatepass")) > long_bytes
                out.append([names[s] for s in sorted({s for _, s in matcher[0].hits(low, long)})])
            return pa.array(out, pa.list_(pa.string()))

        return by_slices(work, a)

    return run(texts.cast("string"))


def catalog_table(spark, catalog: S.Catalog) -> DataFrame:
    """The catalog as rows: position, skill, category, key."""
    rows = [(k, n, c) for k, (n, c, _) in enumerate(catalog.skills)]
    return spark.createDataFrame(rows, "position int, skill string, category string").withColumn("key", text.skill_key(F.col("skill")))


def catalog_from(rows: DataFrame, most: int = 100_000) -> S.Catalog:
    """A catalog from rows of (position, skill, category, keywords array, tight array or null). More than `most` rows are an error, as a catalog goes to every task."""
    found = rows.orderBy("position").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a catalog of more than {most} skills")
    return S.Catalog([(r["skill"], r["category"], list(r["keywords"])) for r in found], {r["skill"]: list(r["tight"]) for r in found if r["tight"] is not None})


def canonical_skills(labels: DataFrame, catalog: DataFrame, label: str = "label") -> DataFrame:
    """Adds skill and category of the first catalog row with the label's key; null where there is none. Keys without a letter, digit, + or # name nothing."""
    first = catalog.groupBy("key").agg(F.min_by(F.struct("skill", "category"), "position").alias("_found"))
    keyed = labels.withColumn("_key", F.nullif(text.skill_key(F.col(label)), F.lit("")))
    return keyed.join(first, keyed["_key"] == first["key"], "left").select(*labels.columns, F.col("_found.skill").alias("skill"), F.col("_found.category").alias("category"))


def by_category(rows: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """(key, category, skills): the skills of each key by category, both in the catalog's order. rows: key, skill."""
    known = rows.select(key, "skill").distinct().join(catalog.select("skill", "category", "position"), "skill")
    grouped = known.groupBy(key, "category").agg(F.array_sort(F.collect_set(F.struct("position", "skill"))).alias("_all"))
    return grouped.select(key, "category", F.col("_all")[0]["position"].alias("position"), F.transform("_all", lambda x: x["skill"]).alias("skills"))
