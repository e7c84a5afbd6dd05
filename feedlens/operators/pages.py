"""Jobs over raw pages: blocks of a description, repeated cards by selectors, embedded postings, and detail assembly."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions import dates, pay, text

BLOCKS = frozenset("p div section article header footer nav aside ul ol li h1 h2 h3 h4 h5 h6 table tr td th blockquote pre form title body br".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
SILENT = frozenset(["script", "style", "noscript", "template"])


class _Blocks(HTMLParser):
    """Collects (text, heading, bullet) per block; a block that is bold throughout and short, or ends in a colon, is a heading."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, bool, bool]] = []
        self.parts: list[str] = []
        self.bold = self.silent = 0
        self.plain = self.head = self.item = False

    def flush(self) -> None:
        words = " ".join("".join(self.parts).split())
        if words:
            short = not self.item and len(words.encode()) <= 90
            self.out.append((words, self.head or short and (not self.plain or words.endswith(":")), self.item))
        self.parts, self.plain = [], False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent += 1
        if tag in BLOCKS:
            self.flush()
            self.head, self.item = tag in HEADINGS, tag == "li" or (self.item and tag == "br")
        if tag in ("b", "strong"):
            self.bold += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        if tag in BLOCKS:
            self.flush()
            self.head = self.item = self.bold = False
        if tag in ("b", "strong"):
            self.bold = max(0, int(self.bold) - 1)

    def handle_data(self, data: str) -> None:
        if self.silent or not data:
            return
        if not data.isspace():
            self.plain = self.plain or not self.bold
        self.parts.append(data)


def blocks_of(page: str | None) -> list[tuple[str, bool, bool]]:
    reader = _Blocks()
    reader.feed(page or "")
    reader.close()
    reader.flush()
    return reader.out


def html_blocks(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(url, line, text, heading, bullet) of every page, in page order; the input of textmine.sections."""
    out = pa.schema([("line", pa.int32()), ("text", pa.string()), ("heading", pa.bool_()), ("bullet", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                take, rows = [], []
                for k, page in enumerate(part.column("html").to_pylist()):
                    for n, b in enumerate(blocks_of(page)):
                        take.append(k)
                        rows.append((n, *b))
                columns = [pa.array([r[c] for r in rows], f.type) for c, f in enumerate(out)]
                yield pa.RecordBatch.from_arrays([part.column("url").take(pa.array(take, pa.int64())), *columns], names=["url", *out.names])

    rows = pages.select(F.col(id_col).alias("url"), F.col(html_col).alias("html"))
    kind = dict(rows.dtypes)["url"]
    return rows.mapInArrow(run, f"url {kind}, line int, text string, heading boolean, bullet boolean")


def visible_text(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(url, text): the visible text of a page with white space collapsed; pages without any give no row."""
    rows = html_blocks(pages, id_col, html_col)
    ordered = F.array_sort(F.collect_list(F.struct("line", "text")))
    return rows.groupBy("url").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"))


class _Cards(HTMLParser):
    """Rows by a repeated (tag, class) selector, and in each the text or an attribute of further selectors."""

    def __init__(self, row: tuple[str, str], fields: Sequence[tuple[str, str, str, str]]) -> None:
        super().__init__(convert_charrefs=True)
        self.row, self.fields = row, fields
        self.rows: list[dict[str, str]] = []
        self.depth = 0
        self.open: list[tuple[str, str, int]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        classes = (given.get("class") or "").split()
        fits = lambda t, c: tag == t and (not c or c in classes)
        if self.depth == 0 and fits(*self.row):
            self.rows.append({})
            self.depth = 1
        elif self.depth and tag == self.row[0]:
            self.depth += 1
        if self.depth:
            for name, t, c, attr in self.fields:
                if fits(t, c) and name not in self.rows[-1]:
                    if attr:
                        self.rows[-1][name] = given.get(attr) or ""
                    else:
                        self.rows[-1][name] = ""
                        self.open.append((name, tag, self.depth))

    def handle_endtag(self, tag: str) -> None:
        self.open = [o for o in self.open if o[1] != tag]
        if self.depth and tag == self.row[0]:
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        if self.depth:
            for name, _, _ in self.open:
                self.rows[-1][name] += data


def cards(pages: DataFrame, id_col: str, html_col: str, row: tuple[str, str], fields: Sequence[tuple[str, str, str, str]], link: str) -> DataFrame:
    """One row per card: (id, card_no and the fields). fields: (name, tag, class, attribute or ""); cards without the
    link field are dropped."""
    names = [f[0] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                take, rows = [], []
                for k, page in enumerate(part.column("html").to_pylist()):
                    reader = _Cards(row, fields)
                    reader.feed(page or "")
                    for n, found in enumerate(r for r in reader.rows if r.get(link)):
                        take.append(k)
                        rows.append((n, *(" ".join(found.get(c, "").split()) or None for c in names)))
                columns = [pa.array([r[c] for r in rows], pa.int32() if c == 0 else pa.string()) for c in range(len(names) + 1)]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(take, pa.int64())), *columns], names=["id", "card_no", *names])

    source = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    kind = dict(source.dtypes)["id"]
    return source.mapInArrow(run, f"id {kind}, card_no int, " + ", ".join(f"{n} string" for n in names))


POSTING = "title string, description string, datePosted string, validThrough string, hiringOrganization struct<name string>, baseSalary struct<currency string, value struct<minValue double, maxValue double, value double, unitText string>>, skills string"


def embedded_posting(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """The first JobPosting in the page's ld+json scripts: an object, a list, or a member of @graph."""
    bodies = F.regexp_extract_all(html_col, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    rows = pages.select(F.col(id_col).alias("id"), F.posexplode(bodies).alias("script", "body"))
    typed = f"struct<`@type` string, {POSTING.replace(' string', ': string').replace(' struct', ': struct').replace(' double', ': double')}>"
    one = F.from_json("body", typed)
    listed = F.from_json("body", f"array<{typed}>")
    graph = F.from_json("body", f"struct<`@graph`: array<{typed}>>")
    empty = F.array().cast(f"array<{typed}>")
    every = F.concat(F.when(one["@type"].isNotNull(), F.array(one)).otherwise(empty), F.when(F.col("body").rlike(r"^\s*\["), F.coalesce(listed, empty)).otherwise(empty), F.coalesce(graph["@graph"], empty))
    first = F.get(F.filter(every, lambda p: p["@type"].contains("JobPosting")), F.lit(0))
    found = rows.withColumn("p", first).where("p IS NOT NULL").groupBy("id").agg(F.min_by("p", "script").alias("p"))
    v = F.col("p.baseSalary.value")
    found = found.withColumn("pay", pay.pay_from_parts(F.coalesce(v["minValue"], v["value"]), v["maxValue"], F.col("p.baseSalary.currency"), v["unitText"]))
    return found.select(
        "id", F.col("p.title").alias("title"), F.col("p.hiringOrganization.name").alias("company"), F.col("p.description").alias("description"), dates.date_or_timestamp(F.col("p.validThrough")).alias("closes_at"),
        F.col("pay.min").alias("salary_min"), F.col("pay.max").alias("salary_max"), F.col("pay.period").alias("salary_period"), text.list_items(F.col("p.skills")).alias("tagged_skills"),
    )


def assemble_detail(sections: DataFrame, most: int = 8000) -> DataFrame:
    """Lines per section to one row per url: a text of at most `most` bytes per section, and status ok or empty."""
    ordered = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == name, F.struct("line", "text")))), lambda x: x["text"]), "\n")
    names = {"overview": "description", "requirements": "requirements", "responsibilities": "responsibilities", "perks": "perks"}
    got = sections.groupBy("url").agg(*(ordered(s).alias(c) for s, c in names.items()))
    for c in names.values():
        got = got.withColumn(c, F.nullif(text.truncate_words(F.col(c), most), F.lit("")))
    return got.withColumn("status", F.when(F.coalesce(*names.values()).isNotNull(), "ok").otherwise("empty"))


def merge_details(candidates: DataFrame, order: str = "chain_pos") -> DataFrame:
    """One detail per url from an ordered chain: the first with text wins, earlier facts fill its deadline and pay.

    candidates: url, chain_pos, description, closes_at, salary_min, salary_period, status.
    """
    has_text = F.coalesce("description", F.lit("")) != ""
    first = lambda c, when: F.min_by(c, F.when(when, F.col(order)))
    paid = F.col("salary_min").isNotNull()
    rank = F.min(F.when(F.col("status") == "ok", 0).when(F.col("status") == "empty", 1).when(F.col("status") == "failed", 2).otherwise(3))
    got = candidates.groupBy("url").agg(
        first("description", has_text).alias("description"), first("closes_at", F.col("closes_at").isNotNull()).alias("closes_at"), first(F.struct("salary_min", "salary_period"), paid).alias("pay"), rank.alias("rank")
    )
    status = F.when(F.col("description").isNotNull() | F.col("closes_at").isNotNull(), "ok").when(F.col("rank") == 1, "empty").when(F.col("rank") == 2, "failed").otherwise("unsupported")
    return got.select("url", "description", "closes_at", "pay.salary_min", "pay.salary_period", status.alias("status"))


def route(url: Column, mirror_id: Column, families: dict[str, str], excluded: Sequence[str]) -> Column:
    """Handlers to try for a url, in order: its board family by host, the page itself unless excluded, the mirror."""
    host = text.url_host(url)
    family = F.when(F.lit(False), F.lit(""))
    for suffix, name in families.items():
        family = family.when((host == suffix) | host.endswith("." + suffix), F.lit(name))
    readable = host.isNotNull() & ~text.has_any(F.coalesce(url, F.lit("")), ["/search", "?q="])
    for e in excluded:
        readable = readable & (host != e) & ~host.endswith("." + e)
    return F.array_compact(F.array(family, F.when(readable, F.lit("page")), F.when(mirror_id.isNotNull(), F.lit("mirror"))))
