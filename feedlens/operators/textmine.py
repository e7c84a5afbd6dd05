"""Text mining jobs: weighted skill demand, section splitting, key terms and their echo in other texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from feedlens.functions import dictionaries as D
from feedlens.functions import text

#: Bytes of text that a task of focus() reads; their terms take some 60 times as much memory until they are counted.
TASK_BYTES = 2 << 20

#: Bytes that count as part of a word at a keyword's edge.
EDGE = "[A-Za-z0-9+#&]"


def skill_pattern(keyword: str) -> str:
    """A regular expression for a keyword; a blank at its start or end asks for a word boundary there."""
    import re

    left = rf"(^|(?<!{EDGE}))" if keyword.startswith(" ") else ""
    right = rf"(?!{EDGE})" if keyword.endswith(" ") else ""
    return left + re.escape(keyword.strip(" ")) + right


def skill_hits(lines: DataFrame, skills: Sequence[tuple[str, Sequence[str]]], tight: Sequence[tuple[str, Sequence[str]]] = (), long_text: Column | None = None) -> DataFrame:
    """One row per (line, skill named in it). Lines: url, field, line, text. Where long_text holds, the tighter keywords
    of ambiguous skills count instead. One scan of a line evaluates all patterns inside generated code."""
    low = F.lower("text")
    tighter = dict(tight)

    def named(words: Sequence[str]) -> Column:
        return low.rlike("|".join(skill_pattern(w) for w in words))

    found = []
    for at, (name, words) in enumerate(skills):
        hit = named(words)
        if name in tighter and long_text is not None:
            hit = F.when(long_text, named(tighter[name])).otherwise(hit)
        found.append(F.when(hit, F.struct(F.lit(at).alias("at"), F.lit(name).alias("skill"))))
    return lines.withColumn("_skills", F.array_compact(F.array(*found)))


def demand(lines: DataFrame, skills: Sequence[tuple[str, Sequence[str]]], fields: dict[str, tuple[float, int]] | None = None, tags: DataFrame | None = None,
           cues: tuple[Sequence[str], Sequence[str], Sequence[str]] = (D.LEARN_CUES, D.NICE_CUES, D.MUST_CUES), tight: Sequence[tuple[str, Sequence[str]]] = (), long_bytes: int = 400) -> DataFrame:
    """(url, skill, weight, emphasis): how hard a posting asks for each skill; emphasis 0 must, 1 nice, 2 mentioned.

    Lines: url, field, line, text; `fields` gives the weight of a field and the emphasis of a plain line in it. A short
    line without a skill sets the tone of the lines below it in its field. tags: (url, skill), trusted outright.
    """
    fields = fields or D.FIELDS
    if tight:
        size = F.sum(F.octet_length("text") + 1).over(W.partitionBy("url"))
        lines = lines.withColumn("_long", size > long_bytes)
    hits = skill_hits(lines, skills, tight, F.col("_long") if tight else None)
    low = F.lower("text")
    own = text.tone_of(low, *cues)
    marked = hits.withColumn("_own", own)
    short = (F.size("_skills") == 0) & (F.octet_length("text") <= 90)
    sets = F.when(short & F.col("_own").isin("nice", "learn"), F.col("_own")).when(short & F.col("text").endswith(":"), F.coalesce("_own", F.lit("plain")))
    above = W.partitionBy("url", "field").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    toned = marked.withColumn("_sticky", F.coalesce(F.last(sets, ignorenulls=True).over(above), F.lit("plain"))).where(F.size("_skills") > 0)
    said = F.coalesce("_own", "_sticky")
    tone = F.when((said == "must") & (F.col("_sticky") == "nice"), "nice").otherwise(said)
    lookup = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))
    named = toned.select("url", "field", "line", tone.alias("tone"), F.explode("_skills").alias("s")).select("url", "field", "line", "tone", "s.skill", "s.at")
    order = {f: k for k, f in enumerate(["title", "requirements", "responsibilities", "description", "scraped", *fields])}
    place = F.coalesce(lookup(order)[F.col("field")], F.lit(len(order)))
    k = F.row_number().over(W.partitionBy("url", "skill").orderBy(place, "line")) - 1
    base = F.coalesce(lookup({f: w for f, (w, _) in fields.items()})[F.col("field")], F.lit(1.0))
    plain = F.coalesce(lookup({f: e for f, (_, e) in fields.items()})[F.col("field")], F.lit(2))
    emphasis = F.when(F.col("tone") == "must", 0).when(F.col("tone") == "nice", 1).when(F.col("tone") == "learn", 2).otherwise(plain)
    scored = named.select("url", "skill", (base * lookup(D.TONE_FACTOR)[F.col("tone")] / (1.0 + 0.5 * k)).alias("w"), emphasis.alias("e"), (F.col("tone") != "learn").alias("asked"))
    if tags is not None:
        scored = scored.unionByName(tags.select("url", "skill", F.lit(3.0).alias("w"), F.lit(0).alias("e"), F.lit(True).alias("asked")))
    total = scored.groupBy("url", "skill").agg(F.sum("w").alias("weight"), F.min("e").alias("emphasis"), F.bool_or("asked").alias("asked"))
    return total.where("asked").drop("asked")


def weighted_coverage(demands: DataFrame, owned: Column, least: int = 2) -> DataFrame:
    """(url, coverage, asked, have): weighted share of the demanded skills that `owned` (array) has; null below `least`."""
    has = F.array_contains(owned, F.col("skill"))
    got = demands.groupBy("url").agg(F.sum("weight").alias("all"), F.sum(F.when(has, F.col("weight")).otherwise(0.0)).alias("met"), F.count(F.lit(1)).alias("asked"), F.count_if(has).alias("have"))
    return got.select("url", F.when(F.col("asked") >= least, F.col("met") / F.nullif("all", F.lit(0.0))).alias("coverage"), "asked", "have")


def sections(blocks: DataFrame, default: str = "overview", most: int = 120, longest: int = 90) -> DataFrame:
    """Lines per section: (url, section, line, text). Blocks: url, line, text, heading, bullet.

    A heading, or a short line that is no sentence and stands before a bullet, opens a section for the lines below. Its
    own text stays in the overview only. Per section the first copy of a line counts, and at most `most` lines.
    """
    by_url = W.partitionBy("url").orderBy("line")
    opens = F.col("heading") | (~F.col("bullet") & (F.octet_length("text") <= longest) & ~F.col("text").rlike(r"[.!?]\z") & F.coalesce(F.lead("bullet").over(by_url), F.lit(False)))
    rows = blocks.withColumn("_opens", opens)
    named = text.section_of(F.col("text"))
    target = F.when(F.col("_opens"), F.when(named == "overview", F.lit(default)).otherwise(named))
    rows = rows.withColumn("section", F.coalesce(F.last(target, ignorenulls=True).over(by_url), F.lit(default)))
    rows = rows.where((~F.col("_opens") | (F.col("section") == "overview")) & (F.col("text") != ""))
    first = F.row_number().over(W.partitionBy("url", "section", "text").orderBy("line"))
    rows = rows.withColumn("_copy", first).where(F.col("_copy") == 1)
    n = F.row_number().over(W.partitionBy("url", "section").orderBy("line"))
    return rows.withColumn("_n", n).where(F.col("_n") <= most).select("url", "section", "line", "text")


def text_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of plain text: one per non-empty line; a bullet starts with -, * or •, a heading is short and ends in a colon."""
    lines = docs.select(F.col(id_col).alias("url"), F.posexplode(F.split(text_col, "\n")).alias("line", "raw"))
    bullet = F.col("raw").rlike(r"^\s*[-*•]\s+")
    clean = text.collapse_ws(F.regexp_replace("raw", r"^\s*[-*•]\s+", ""))
    rows = lines.select("url", "line", clean.alias("text"), bullet.alias("bullet")).where("text <> ''")
    return rows.withColumn("heading", ~F.col("bullet") & F.col("text").endswith(":") & (F.octet_length("text") <= 90))


def stem(word: Column) -> Column:
    """A light suffix stripper: -ing, -ed and -ly off long words, plural -s, a doubled consonant made single."""
    n = F.length(word)
    single = lambda w: F.regexp_replace(w, r"([b-df-hjkmnp-rtv-z])\1$", "$1")
    cut = lambda k: single(F.substring(word, F.lit(1), n - k))
    base = F.substring(word, F.lit(1), n - 1)
    plural = F.when(base.rlike(r"^.{2,}[sxzh]e$") & (F.length(base) >= 4), F.substring(word, F.lit(1), n - 2)).otherwise(base)
    return (
        F.when(word.endswith("ing") & (n >= 7), cut(3)).when(word.endswith("ed") & (n >= 6), cut(2)).when(word.endswith("ly") & (n >= 6), cut(2))
        .when(word.endswith("s") & ~word.endswith("ss") & ~word.endswith("us"), plural).otherwise(word)
    )


def terms(parts: DataFrame, stopwords: Sequence[str]) -> DataFrame:
    """(url, part, pos, stem, surface, next_stem): surviving words in order; next_stem is null across a clause break or a
    dropped word. Parts: url, part, text. Splitting keeps the gap behind each word, where breaks are looked for."""
    pairs = F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9]+)([^a-z0-9]*)"), F.lit(0))
    words = parts.select("url", "part", F.posexplode(pairs).alias("pos", "pair"))
    words = words.select("url", "part", "pos", F.regexp_extract("pair", "^[a-z0-9]+", 0).alias("surface"), F.regexp_extract("pair", "[^a-z0-9]*$", 0).alias("gap"))
    stops = F.array(*(F.lit(s) for s in stopwords)) if stopwords else F.array().cast("array<string>")
    root = stem(F.col("surface"))
    fine = (F.length("surface") >= 3) & ~F.col("surface").rlike("^[0-9]+$") & ~F.array_contains(stops, F.col("surface")) & (F.length(root) >= 3) & ~F.array_contains(stops, root)
    words = words.select("url", "part", "pos", "surface", "gap", F.when(fine, root).alias("stem"))
    order = W.partitionBy("url", "part").orderBy("pos")
    follows = F.when(~F.col("gap").rlike(r"[.,;:!?\n()|]"), F.lead("stem").over(order))
    return words.withColumn("next_stem", follows).where("stem IS NOT NULL")


def row_terms(text_col: Column, stopwords: Sequence[str]) -> Column:
    """The terms of one text, inside its row: array of (term, c), c 1 for surviving words and 2 for pairs of neighbours.

    Clause breaks are tokens of their own, and like dropped words they stand as empty strings, so no pair crosses them.
    """
    tokens = F.regexp_extract_all(F.lower(text_col), F.lit(r"[a-z0-9]+|[.,;:!?\n()|]"), F.lit(0))
    stops = F.array(*(F.lit(s) for s in stopwords)) if stopwords else F.array().cast("array<string>")

    def root(w: Column) -> Column:
        r = stem(w)
        fine = (F.length(w) >= 3) & ~w.rlike("^[0-9]+$") & ~F.array_contains(stops, w) & (F.length(r) >= 3) & ~F.array_contains(stops, r)
        return F.when(fine, r).otherwise(F.lit(""))

    stems = F.transform(tokens, root)
    return F.transform(F.array(stems), _with_pairs)[0]


def _with_pairs(stems: Column) -> Column:
    one = F.transform(F.filter(stems, lambda w: w != ""), lambda w: F.struct(w.alias("term"), F.lit(1).alias("c")))
    both = F.zip_with(stems, F.slice(stems, F.lit(2), F.greatest(F.size(stems) - 1, F.lit(0))), lambda a, b: F.when((a != "") & (b != ""), F.concat_ws(" ", a, b)))
    two = F.transform(F.array_compact(both), lambda w: F.struct(w.alias("term"), F.lit(2).alias("c")))
    return F.concat(one, two)


def row_counts(terms: Column) -> Column:
    """The terms (term, c) of one row with each term once and its c summed, inside the row: runs of the sorted terms, all of which have the same c."""

    def runs(s: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(s)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(s, a)["term"].alias("term"), ((b - a) * F.get(s, a)["c"]).cast("long").alias("c")))

    def counted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(F.get(s, i)["term"] != F.get(s, i - 1)["term"], F.lit(True)))
        return F.when(F.size(s) > 0, F.transform(F.array(starts), lambda x: runs(s, x))[0])

    return F.transform(F.array(F.sort_array(terms)), counted)[0]


def focus(parts: DataFrame, weights: dict[str, float], stopwords: Sequence[str], most: int = 400) -> DataFrame:
    """(url, term, weight): what a posting is about. Each section adds weight (1 + ln count) for its words and, counted
    twice, its pairs of neighbours; the best `most` terms are scaled by the best. Parts: url, part, text; a part may come
    in several rows, and its pairs do not cross them. Parts without a weight add nothing. Terms are counted in each row and
    then by (url, term), in as many tasks as the texts' bytes, which are summed first, call for."""
    known = parts.where(F.col("part").isin(*weights)).select("url", "part", "text")
    n = (known.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // TASK_BYTES + 1
    dealt = known.repartition(n, F.xxhash64("url", "part", "text"))
    each = dealt.select("url", "part", F.explode(row_counts(row_terms(F.col("text"), stopwords))).alias("t")).select("url", "part", "t.*").repartition(n, "url", "term")
    counts = each.groupBy("url", "term").agg(F.lit(True).alias("_any"), *(F.sum(F.when(F.col("part") == p, F.col("c"))).alias(f"_c{k}") for k, p in enumerate(weights)))
    added = [F.coalesce(w * (1.0 + F.log(f"_c{k}")), F.lit(0.0)) for k, w in enumerate(weights.values())]
    raw = counts.select("url", "term", F.round(reduce(lambda a, b: a + b, added, F.lit(0.0)), 9).alias("raw"))
    best = W.partitionBy("url").orderBy(F.desc("raw"), "term")
    top = raw.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most)
    return top.select("url", "term", (F.col("raw") / F.max("raw").over(W.partitionBy("url"))).alias("weight"), F.col("_n").alias("rank"))


def echo(texts: DataFrame, focus_terms: DataFrame, stopwords: Sequence[str]) -> DataFrame:
    """(id, url, echo, shared): summed weights of the distinct focus terms that a text holds. Texts: id, url, text; the
    join is on (url, term)."""
    keyed = texts.select("id", "url", F.explode(F.array_distinct(F.transform(row_terms(F.col("text"), stopwords), lambda t: t["term"]))).alias("term")).distinct()
    return keyed.join(focus_terms.select("url", "term", "weight"), ["url", "term"]).groupBy("id", "url").agg(F.sum("weight").alias("echo"), F.count(F.lit(1)).alias("shared"))
