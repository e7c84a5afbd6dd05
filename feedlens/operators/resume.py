"""Résumé documents as rows, their skills block for a posting, and variants that are frozen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_RECORD = """struct<name:string,organization:string,institution:string,awarder:string,role:string,position:string,studyType:string,title:string,area:string,
location:string,url:string,start_date:string,startDate:string,end_date:string,endDate:string,date:string,score:string,summary:string,description:string,
highlights:array<string>,keywords:array<string>>""".replace("\n", "")
#: Fields of the document and the kinds of section they fill, in the order of the sections.
KINDS = {"education": "education", "work": "experience", "projects": "projects", "volunteer": "leadership", "awards": "awards"}
#: Kinds whose detail line lists skills, and separators of a detail line in their order of preference.
STACKED = ("projects", "experience", "leadership")
SEPARATORS = ("·", "|", ";", ",")
REORDERABLE = ("projects", "leadership", "awards", "custom")


def schema(own: str) -> str:
    """The document; meta.<own> holds the ids of an earlier export."""
    basics = "struct<name:string,label:string,email:string,phone:string,url:string,location:struct<city:string,region:string,address:string>,profiles:array<struct<network:string,username:string,url:string>>>"
    lists = ", ".join(f"{k} array<{_RECORD}>" for k in KINDS)
    return f"basics {basics}, {lists}, skills array<struct<name:string,keywords:array<string>>>, meta struct<`{own}`:struct<sections:array<string>,entries:array<array<array<string>>>>>"


def read_documents(docs: DataFrame, own: str = "feedlens") -> DataFrame:
    """(resume, d) of the documents (resume, json) that are JSON; the others are dropped."""
    return docs.where(F.try_parse_json("json").isNotNull()).select("resume", F.from_json("json", schema(own)).alias("d"))


def _clean(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _filled(items: Column) -> Column:
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")


def _entry(r: Column, project: bool) -> Column:
    first = lambda *names: F.coalesce(*(r[n] for n in names), F.lit(""))
    role = first("role", "position", "studyType", "title")
    title = role if project else F.concat_ws(", ", F.nullif(F.trim(role), F.lit("")), F.nullif(_clean(r["area"]), F.lit("")))
    stack = F.nullif(F.array_join(F.transform(_filled(r["keywords"]), lambda x: F.trim(x)), " · "), F.lit(""))
    score = F.nullif(_clean(r["score"]), F.lit(""))
    bullets = F.concat(_filled(F.array(_clean(r["summary"]), _clean(r["description"]))), _filled(r["highlights"]))
    return F.struct(
        first("name", "organization", "institution", "awarder").alias("org"), title.alias("title"), _clean(r["location"]).alias("location"), F.trim(first("start_date", "startDate")).alias("start"),
        F.trim(first("end_date", "endDate", "date")).alias("end"), F.nullif(_clean(r["url"]), F.lit("")).alias("link"), (F.coalesce(stack, score) if project else F.coalesce(score, stack)).alias("detail"), bullets.alias("bullets"),
    )


def _skill_line(g: Column) -> Column:
    empty = F.lit("")
    return F.struct(
        empty.alias("org"), _clean(g["name"]).alias("title"), empty.alias("location"), empty.alias("start"), empty.alias("end"), F.lit(None).cast("string").alias("link"),
        F.array_join(F.coalesce(g["keywords"], F.array().cast("array<string>")), ", ").alias("detail"), F.array().cast("array<string>").alias("bullets"),
    )


def parts(documents: DataFrame, own: str = "feedlens") -> DataFrame:
    """One row per bullet, and one for an entry without any: positions, ids and texts. Ids of an earlier export come back by
    position; the others are digests of the place."""
    d = lambda name: F.col(f"d.{name}")
    record, project = (lambda r: _entry(r, False)), (lambda r: _entry(r, True))
    built = [F.struct(F.lit(kind).alias("kind"), F.transform(d(name), project if kind == "projects" else record).alias("entries")) for name, kind in KINDS.items()]
    skills = F.transform(F.filter(d("skills"), lambda g: (F.size(F.coalesce(g["keywords"], F.array().cast("array<string>"))) > 0) | (_clean(g["name"]) != "")), _skill_line)
    built.append(F.struct(F.lit("skills").alias("kind"), skills.alias("entries")))
    rows = documents.select("resume", d(f"meta.`{own}`").alias("ids"), F.posexplode(F.filter(F.array(*built), lambda s: F.coalesce(F.size(s["entries"]), F.lit(0)) > 0)).alias("section", "s"))
    rows = rows.select("resume", "section", "s.kind", F.get("ids.sections", F.col("section")).alias("_sid"), F.get("ids.entries", F.col("section")).alias("_ids"), F.posexplode("s.entries").alias("entry", "e"))
    rows = rows.withColumn("_row", F.get("_ids", F.col("entry")))
    rows = rows.select("*", F.posexplode_outer("e.bullets").alias("bullet", "text"))
    minted = lambda *names: F.substring(F.sha2(F.concat_ws("/", *(F.col(n).cast("string") for n in names)), 256), 1, 16)
    return rows.select(
        "resume", "section", "kind", F.coalesce("_sid", minted("resume", "section")).alias("section_id"), "entry", F.coalesce(F.get("_row", F.lit(0)), minted("resume", "section", "entry")).alias("entry_id"),
        "e.org", "e.title", "e.location", "e.start", "e.end", "e.link", "e.detail", "bullet",
        F.when(F.col("bullet").isNotNull(), F.coalesce(F.get("_row", F.col("bullet") + 1), minted("resume", "section", "entry", "bullet"))).alias("bullet_id"), "text",
    )


def contacts(documents: DataFrame) -> DataFrame:
    """One row per résumé; a profile without a url gets one where its network and name tell it, else it is left out."""
    b = lambda name: F.col(f"d.basics.{name}")
    user = lambda p: _clean(p["username"])
    made = lambda p: F.when(_clean(p["url"]) != "", p["url"]).when(user(p) == "", None).when(F.lower(p["network"]) == "github", F.concat(F.lit("https://github.com/"), user(p))).when(F.lower(p["network"]) == "linkedin", F.concat(F.lit("https://linkedin.com/in/"), user(p)))
    profiles = F.filter(F.transform(b("profiles"), lambda p: F.struct(F.coalesce(p["network"], F.lit("")).alias("label"), made(p).alias("url"))), lambda x: x["url"].isNotNull())
    none = F.array().cast("array<struct<label:string,url:string>>")
    site = F.when(_clean(b("url")) != "", F.array(F.struct(F.lit("Website").alias("label"), b("url").alias("url")))).otherwise(none)
    place = F.concat_ws(", ", F.nullif(_clean(b("location.city")), F.lit("")), F.nullif(_clean(b("location.region")), F.lit("")))
    return documents.select(
        "resume", _clean(b("name")).alias("name"), F.nullif(_clean(b("label")), F.lit("")).alias("headline"), _clean(b("email")).alias("email"), _clean(b("phone")).alias("phone"),
        F.when(place != "", place).otherwise(_clean(b("location.address"))).alias("location"), F.concat(site, F.coalesce(profiles, none)).alias("links"),
    )


def detail_items(detail: Column) -> Column:
    """Items of a detail line, split by the first separator of SEPARATORS that it holds."""
    trimmed = lambda sep: _filled(F.transform(F.split(detail, sep), lambda x: F.trim(x)))
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for sep in SEPARATORS:
        out = out.when(detail.contains(sep), trimmed(f"[{sep}]"))
    return out.otherwise(_filled(F.array(F.trim(detail))))


def export_documents(rows: DataFrame, people: DataFrame, own: str = "feedlens") -> DataFrame:
    """(resume, json) out of parts and contacts. A group is one entry, then one résumé."""
    entry = ["resume", "section", "kind", "section_id", "entry", "entry_id", "org", "title", "location", "start", "end", "link", "detail"]
    by_place = F.array_sort(F.collect_list(F.when(F.col("bullet").isNotNull(), F.struct("bullet", "bullet_id", "text"))))
    e = rows.groupBy(*entry).agg(by_place.alias("b"))
    stacked = F.col("kind").isin(*STACKED)
    line = F.coalesce("detail", F.lit(""))
    record = F.struct(
        F.col("org").alias("name"), F.col("title").alias("role"), "location", F.coalesce("link", F.lit("")).alias("url"), F.col("start").alias("startDate"), F.col("end").alias("endDate"),
        F.when(stacked, "").otherwise(line).alias("score"), F.when(stacked, detail_items(line)).otherwise(F.array().cast("array<string>")).alias("keywords"), F.transform("b", lambda x: x["text"]).alias("highlights"),
    )
    group = F.struct(F.col("title").alias("name"), _filled(F.transform(F.split(line, ","), lambda x: F.trim(x))).alias("keywords"))
    ids = F.concat(F.array("entry_id"), F.transform("b", lambda x: x["bullet_id"]))
    one = e.select("resume", F.struct("section", "entry", "kind", "section_id", record.alias("record"), group.alias("group"), ids.alias("ids")).alias("x"))
    doc = one.groupBy("resume").agg(F.array_sort(F.collect_list("x"), lambda a, b: F.when((a["section"] < b["section"]) | (a["section"] == b["section"]) & (a["entry"] < b["entry"]), -1).otherwise(1)).alias("xs"))
    of = lambda kind, field: F.transform(F.filter("xs", lambda x: x["kind"] == kind), lambda x: x[field])
    sections = F.array_distinct(F.transform("xs", lambda x: F.struct(x["section"].alias("section"), x["section_id"].alias("id"))))
    nested = F.transform(sections, lambda s: F.transform(F.filter("xs", lambda x: x["section"] == s["section"]), lambda x: x["ids"]))
    none = F.lit("")
    basics = F.struct(
        "name", F.coalesce("headline", none).alias("label"), "email", "phone", none.alias("url"), F.struct(F.col("c.location").alias("city"), none.alias("region"), none.alias("address")).alias("location"),
        F.transform("links", lambda x: F.struct(x["label"].alias("network"), none.alias("username"), x["url"].alias("url"))).alias("profiles"),
    )
    meta = F.struct(F.struct(F.transform(sections, lambda s: s["id"]).alias("sections"), nested.alias("entries")).alias(own))
    lists = [of(kind, "record").alias(name) for name, kind in KINDS.items()]
    return doc.join(people.alias("c"), "resume").select("resume", F.to_json(F.struct(basics.alias("basics"), *lists, of("skills", "group").alias("skills"), meta.alias("meta"))).alias("json"))


def generated_lines(have: DataFrame, catalog: DataFrame) -> DataFrame:
    """Skills lines of readers without any: their skills by category, in catalog order. have: resume, skill; catalog: category,
    category_pos, skill, skill_pos."""
    met = have.select("resume", "skill").distinct().join(catalog, "skill").groupBy("resume", F.col("category_pos").alias("pos"), F.col("category").alias("label"))
    return met.agg(F.transform(F.array_sort(F.collect_list(F.struct("skill_pos", "skill"))), lambda x: x["skill"]).alias("items"))


def skills_block(curated: DataFrame, generated: DataFrame, postings: DataFrame, demands: DataFrame, lead: DataFrame) -> DataFrame:
    """Skills lines of each (resume, url): what the posting asks for comes first within a line, then the lines that hold it.

    curated, generated: resume, pos, label, items; generated ones serve résumés without curated ones. postings: resume, url.
    demands: url, skill, weight up to 1. lead: resume, skill, ahead of all. All else keeps its order.
    """
    usable = curated.where((F.trim("label") != "") & (F.size("items") > 0)).select("resume", "pos", "label", "items")
    lines = usable.unionByName(generated.select("resume", "pos", "label", "items").join(usable.select("resume").distinct(), "resume", "left_anti"))
    rows = postings.join(lines, "resume").select("resume", "url", "pos", "label", F.posexplode("items").alias("place", "skill"))
    rows = rows.join(demands.groupBy("url", "skill").agg(F.max("weight").alias("weight")), ["url", "skill"], "left").join(lead.select("resume", "skill").distinct().withColumn("_lead", F.lit(2.0)), ["resume", "skill"], "left")
    rows = rows.withColumn("_less", -F.coalesce("_lead", "weight", F.lit(0.0)))
    one = rows.groupBy("resume", "url", "pos", "label").agg(F.array_sort(F.collect_list(F.struct("_less", "place", "skill"))).alias("x"), F.min("_less").alias("_best"))
    n = F.row_number().over(W.partitionBy("resume", "url").orderBy("_best", "pos"))
    return one.select("resume", "url", n.alias("position"), "label", F.transform("x", lambda x: x["skill"]).alias("items"))


def frozen_includes(rows: DataFrame, include: DataFrame, on_page: DataFrame) -> DataFrame:
    """A variant's choices (resume, id, included) with every bullet that is off the page, of sections and entries that are
    included, written down as left out; choices that were made stay."""
    off = include.where("NOT included").select("resume", "id")
    kept = rows.where("bullet_id IS NOT NULL AND trim(text) <> ''")
    for c in ("section_id", "entry_id"):
        kept = kept.join(off.withColumnRenamed("id", c), ["resume", c], "left_anti")
    ids = kept.select("resume", F.col("bullet_id").alias("id")).distinct()
    silent = ids.join(include.select("resume", "id"), ["resume", "id"], "left_anti").join(on_page.select("resume", "id"), ["resume", "id"], "left_anti")
    return include.select("resume", "id", "included").unionByName(silent.withColumn("included", F.lit(False)))


def frozen_orders(drawn: DataFrame, orders: DataFrame, kinds: Sequence[str] = REORDERABLE) -> DataFrame:
    """(resume, section_id, order): the drawn order of sections that may be reordered, of over one entry and without an order
    of their own, beside the orders given. drawn: resume, section_id, kind, order."""
    new = drawn.where(F.col("kind").isin(*kinds) & (F.size("order") > 1)).join(orders.select("resume", "section_id"), ["resume", "section_id"], "left_anti")
    return orders.select("resume", "section_id", "order").unionByName(new.select("resume", "section_id", "order"))
