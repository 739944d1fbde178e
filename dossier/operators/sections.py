"""Pages and documents line by line: sections of a page, biographies, names, rows of a printed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.names import unused
from dossier.functions.text import YEAR, is_publication, norm_text

# Headings that open and end a list of publications, and those that end a biography.
OPENING = (
    "selected publications", "representative publications", "publications", "论文发表", "发表论文", "主要论文", "代表性论文", "代表论文",
    "近年来主要论著", "主要论著", "近期主要学术成果", "主要学术成果",
)
CLOSING = (
    "工作经历", "教育经历", "任职经历", "学习经历", "个人经历", "奖励", "荣誉", "获奖", "科研项目", "研究项目", "基金项目", "教学项目", "社会兼职", "主讲课程", "讲授课程", "招生信息",
)
BIO_END = (
    "selected publications", "representative publications", "publications", "论文发表", "发表论文", "主要学术成果", "代表性论文", "代表论文",
    "近年来主要论著", "近期主要学术成果",
)
# The label before an English name, and words that no name holds.
ENGLISH_LABEL = r"(?i)(?:英文姓名|英文名|english\s+name)\s*[：:]\s*([A-Za-z][A-Za-z .,'-]{2,60})"
NO_NAME = ("university", "institute", "school", "college", "faculty", "department", "renmin", "china", "homepage", "profile")
NUMBERED = r"^[一二三四五六七八九十\d]+[、.)）]\s*"


def heading(line: Column, opening: Sequence[str] = OPENING, closing: Sequence[str] = CLOSING) -> Column:
    """``struct<kind, rest>``: whether a line is a heading that opens or closes a section, and what follows it.

    A marker stands within the first three characters behind a number, and after it a colon or
    dash, nothing, or so little that the line is nothing but a heading.
    """
    low = F.regexp_replace(F.trim(F.lower(line)), NUMBERED, "")

    def marked(kind: str, marker: str) -> Column:
        at = F.instr(low, marker)
        end = at + len(marker)
        after = F.call_function("substring", low, end, F.lit(1))
        fits = (at >= 1) & (at <= 3) & ((after == "") | after.isin("：", ":", "-", "—") | (F.length(low) <= len(marker) + 8))
        rest = F.regexp_replace(F.call_function("substring", line, end, F.length(line)), "^[ ：:—-]+", "")
        return F.when(fits, F.struct(F.lit(kind).alias("kind"), rest.alias("rest")))

    none = F.struct(F.lit("").alias("kind"), F.lit("").alias("rest"))
    return F.coalesce(*[marked(k, m) for k, ms in (("open", opening), ("close", closing)) for m in ms], none)


def lines_of(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``(id_col, at, line)``: normalised lines with something in them, numbered as they stand."""
    rows = docs.select(id_col, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("at", "line"))
    return rows.select(id_col, "at", norm_text("line").alias("line")).filter("line <> ''")


def sections(lines: DataFrame, id_col: str, opening: Sequence[str] = OPENING, closing: Sequence[str] = CLOSING) -> DataFrame:
    """Lines within an open section: ``(id_col, at, section, line)``, sections numbered within a document.

    A heading opens or closes; what follows it in its line is the section's first line.  The
    last heading before a line decides, as a running maximum over the document's lines, so
    no document is gathered.
    """
    marked = lines.withColumn("h", heading(F.col("line"), opening, closing))
    order = Window.partitionBy(id_col).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("h.kind") != "", F.struct("at", F.col("h.kind").alias("kind")))).over(order)
    opened = F.sum(F.when(F.col("h.kind") == "open", 1).otherwise(0)).over(order)
    text = F.when(F.col("h.kind") == "open", F.col("h.rest")).otherwise(F.col("line"))
    out = marked.select(id_col, "at", last.alias("last"), opened.cast("long").alias("section"), text.alias("line"))
    return out.filter((F.col("last.kind") == "open") & (F.col("line") != "")).select(id_col, "at", "section", "line")


def publication_lines(lines: DataFrame, id_col: str, most: int = 40) -> DataFrame:
    """The first ``most`` distinct publication records among the lines of publication sections."""
    own = sections(lines, id_col).filter(F.length("line").between(12, 1600) & is_publication(F.col("line")))
    first = own.groupBy(id_col, "line").agg(F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy(id_col).orderBy("at"))
    return first.withColumn("place", place).filter(F.col("place") <= most).select(id_col, "place", "line")


def biography(lines: DataFrame, id_col: str, most: int = 3000, endings: Sequence[str] = BIO_END) -> DataFrame:
    """``(id_col, bio)``: the lines before the first publication heading, long dated ones left out.

    Lines count until ``most`` characters are reached, so what a document holds is cut to a
    bound before it is collected.
    """
    order = Window.partitionBy(id_col).orderBy("at")
    low = F.lower("line")
    ends = F.lit(False)
    for marker in endings:
        ends = ends | F.contains(low, F.lit(marker))
    ended = F.max(ends).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = lines.withColumn("ended", ended).filter(~F.col("ended") & ~(F.rlike("line", F.lit(YEAR)) & (F.length("line") > 80)))
    before = F.coalesce(F.sum(F.length("line")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = kept.withColumn("before", before).filter(F.col("before") < most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), " ")
    return kept.groupBy(id_col).agg(F.left(joined, F.lit(most)).alias("bio"))


def english_person(value: Column) -> Column:
    """An English name of 2 to 4 words, none of which belongs to an institution; else empty."""
    text = F.regexp_replace(norm_text(value), r"^[-–—|,;：:()\[\]{}]+|[-–—|,;：:()\[\]{}]+$", "")
    tokens = F.regexp_extract_all(text, F.lit(r"[A-Za-z]+(?:['-][A-Za-z]+)?|[A-Z]\."), F.lit(0))
    blocked = F.exists(tokens, lambda t: F.regexp_replace(F.lower(t), r"\.+$", "").isin(*NO_NAME))
    name = F.array_join(tokens, " ")
    good = F.size(tokens).between(2, 4) & ~blocked & F.rlike(name, F.lit(r"^[A-Za-z][A-Za-z .'-]+$"))
    return F.when(good, name).otherwise("")


def english_name(text: Column, meta: Column, title: Column) -> Column:
    """``struct<name, source>``: behind a label in the text, else of the page's author, else of its heading."""
    label = english_person(F.regexp_extract(F.coalesce(text, F.lit("")), ENGLISH_LABEL, 1))
    latin = english_person(F.regexp_replace(norm_text(title), "[^A-Za-z .'-]", " "))
    own = lambda name, source: F.when(name != "", F.struct(name.alias("name"), F.lit(source).alias("source")))
    none = F.struct(F.lit("").alias("name"), F.lit("").alias("source"))
    return F.coalesce(own(label, "official_label"), own(english_person(meta), "official_meta"), own(latin, "official_heading"), none)


# Lines of the printed table that are no content, and what stands behind a row's direction.
TABLE_SKIPPED = r"^研究生导师信息库|第\s*\d+\s*页"
TAIL = r"微信|QQ|电话|\d{5,}|@\w"
PLACE = r"楼|校区|园区|大楼|主楼|座|号|校外|西溪|玉泉|紫金港|之江实验室|良渚|曹主|曹东|则通|逸夫|智泉|\d+\s*室"
DASHES = ("——", "--", "-", "—")


def is_tail(line: Column) -> Column:
    """Whether a line of a printed row is a contact or a place rather than text."""
    own = norm_text(line)
    return (own == "") | own.isin(*DASHES) | F.rlike(own, F.lit(TAIL)) | ((F.length(own) <= 35) & F.rlike(own, F.lit(PLACE)))


def table_rows(lines: DataFrame, id_col: str, headers: Sequence[str] = ()) -> DataFrame:
    """Rows of a printed table from its text lines: ``(id_col, serial, institute, name, title, direction, email)``.

    A row starts where a number of up to three digits is followed by a short institute and a
    Chinese name.  Its direction is what stands before the address, contacts and places at
    its end left out.  Row starts are found by looking ahead in a window; only the lines of
    one row are collected.
    """
    kept = lines.filter(~F.col("line").isin(*headers) & ~F.rlike("line", F.lit(TABLE_SKIPPED)))
    order = Window.partitionBy(id_col).orderBy("at")
    nxt = lambda k: F.lead("line", k).over(order)
    starts = (
        F.rlike("line", F.lit(r"^\d{1,3}$")) & ~F.rlike(nxt(1), F.lit(r"[@\d]")) & (F.length(nxt(1)) <= 12)
        & F.rlike(nxt(2), F.lit(r"^[一-鿿·]{2,8}$")) & nxt(3).isNotNull()
    )
    numbered = kept.withColumn("start", F.coalesce(starts, F.lit(False)))
    numbered = numbered.withColumn("row", F.sum(F.col("start").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    gathered = numbered.filter("row > 0").groupBy(id_col, "row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]).alias("l")
    )
    rest = F.slice("l", 5, 1 << 20)
    at = F.coalesce(F.array_position(F.transform(rest, lambda v: F.contains(v, F.lit("@"))), True), F.lit(0)).cast("int")
    before = F.when(at > 0, F.slice(rest, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(rest)
    ends = F.array_max(F.transform(before, lambda v, i: F.when(~is_tail(v), i + 1).otherwise(0)))
    direction = norm_text(F.array_join(F.slice(before, F.lit(1), F.coalesce(ends, F.lit(0))), " "))
    email = F.when(at > 0, F.regexp_extract(F.array_join(F.slice(rest, at, F.lit(2)), ""), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0)).otherwise("")
    get = lambda i: F.get("l", F.lit(i))
    return gathered.filter(F.size("l") >= 5).select(
        id_col, get(0).alias("serial"), get(1).alias("institute"), get(2).alias("name"), get(3).alias("title"), direction.alias("direction"), email.alias("email")
    )


#: Longest name that is looked for, and what stands near one of two characters that is a person's.
LONGEST_NAME = 8
NEAR_PERSON = "(?:教授|研究员|老师|导师|博士|团队)"


def mentions(docs: DataFrame, doc_id: str, text: Column, names: DataFrame, name: str, most: int = 3, width: int = 20_000) -> DataFrame:
    """``(name, doc_id, place)``: the first ``most`` documents that name each person, by doc_id.

    Each place of the runs of Chinese characters in the first ``width`` characters is filed under the two characters
    there, with no more than a name's length behind it; names are filed under their first two.  So
    names meet the places where they may begin, and no text travels.  Names of two characters count only where a
    word of research stands near, up to 12 characters before or behind; such pairs are picked out where the text is read.
    Names of other than 2 to 8 Chinese characters are not looked for; repeated names and rows add nothing.
    """
    known = names.select(F.col(name).alias("name")).filter(F.rlike("name", F.lit(rf"^[一-鿿]{{2,{LONGEST_NAME}}}$"))).distinct()
    head = F.left(F.coalesce(text, F.lit("")), F.lit(width))
    own = docs.select(F.col(doc_id).alias("id"), head.alias("head"))
    runs = own.select("id", F.explode(F.array_distinct(F.regexp_extract_all("head", F.lit("[一-鿿]{3,}"), F.lit(0)))).alias("run"))
    places = F.transform(F.sequence(F.lit(1), F.length("run") - 2), lambda i: F.call_function("substring", "run", i, F.lit(LONGEST_NAME)))
    pieces = runs.select("id", F.explode(F.array_distinct(places)).alias("piece")).distinct()
    filed = known.filter(F.length("name") > 2).withColumn("gram", F.left("name", F.lit(2)))
    found = pieces.join(filed, (F.left("piece", F.lit(2)) == F.col("gram")) & F.startswith("piece", "name")).select("name", "id")
    # Empty matches at each place: what stands there is caught by looking ahead, so pairs may overlap.
    pair, near = "[一-鿿]{2}", f"{NEAR_PERSON}"
    behind = F.regexp_extract_all("head", F.lit(f"(?<={near}.{{0,12}})(?=({pair}))"), F.lit(1))
    before = F.regexp_extract_all("head", F.lit(f"(?=({pair}).{{0,12}}{near})"), F.lit(1))
    short = own.filter(F.rlike("head", F.lit(near))).select("id", F.explode(F.array_distinct(F.concat(behind, before))).alias("pair"))
    sure = short.join(known.filter(F.length("name") == 2), F.col("pair") == F.col("name")).select("name", "id")
    every = found.unionAll(sure).distinct().withColumnRenamed("id", doc_id)
    order = Window.partitionBy("name").orderBy(doc_id)
    return every.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def person_materials(people: DataFrame, name: str, entries: DataFrame, found: DataFrame, titles: DataFrame, doc_id: str, most: int = 3) -> DataFrame:
    """``people`` with what materials say of them: ``entry``, a printed table's row under their name, and ``evidence``, titles of documents.

    ``entries`` has ``name`` and more, of rows with one name the first in order of all columns counts; ``found`` has ``name`` and
    ``doc_id`` (as ``mentions`` gives), ``titles`` has ``doc_id`` and ``title``.  ``evidence`` lists the first ``most`` titles by doc_id,
    each once; people of one name share both.  Without any they are null and empty.
    """
    p = unused(people)
    rest = [c for c in entries.columns if c != "name"]
    own = entries.filter(F.col("name").isNotNull()).groupBy(F.col("name").alias(f"{p}name")).agg(F.min(F.struct(*rest)).alias("entry"))
    named = found.select("name", F.col(doc_id).alias("id")).join(titles.select(F.col(doc_id).alias("id_"), "title"), F.col("id") == F.col("id_"))
    order = Window.partitionBy("name").orderBy("id", "title")
    first = named.select("name", "id", "title").distinct().withColumn("at", F.row_number().over(order)).filter(F.col("at") <= most)
    listed = first.groupBy(F.col("name").alias(f"{p}named")).agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("at", "title"))), lambda x: x["title"])).alias("evidence"))
    out = people.drop("entry", "evidence").join(own, F.col(name) == F.col(f"{p}name"), "left").join(listed, F.col(name) == F.col(f"{p}named"), "left").drop(f"{p}name", f"{p}named")
    return out.withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
