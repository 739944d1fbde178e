"""Registered queries of picked samples, author verification, stores, paged sources, works, homepages, mentions and re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import homepages
from dossier.operators import findings, picking, placement, ranking, restoring, sections, sheets, stores, unions, verification
from dossier.operators.graph import cut
from dossier.plans.record_queries import RANK_PROFILE
from dossier.sources import paging
from dossier.sources.tables import spread, table

SEED = "evidence-2026"
#: Categories of documents for the drawn samples, and for those held out.
SAMPLE_RULES = {
    "long_english": "n_chars > 3000 AND lang = 'en'", "long_english_again": "n_chars > 3000 AND lang = 'en'", "short": "n_chars < 200", "french": "lang = 'fr'",
    "german": "lang = 'de' AND n_chars > 500", "spanish": "lang = 'es'", "round": "n_chars % 10 = 0", "late": "doc_id % 7 = 3",
}
HOLDOUT_RULES = {"any_english": "lang = 'en'", "any_other": "lang <> 'en'", "middling": "n_chars BETWEEN 300 AND 2000"}


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "n_chars", "lang", F.col("source").alias("school"), F.concat_ws("/", "source", F.coalesce("lang", F.lit("?"))).alias("target"))


def picked_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples of documents, at most two a source and if possible one a target; and samples held out, one a source, of the rest."""
    rows = _targets(spark, d)
    rules = {name: F.expr(rule) for name, rule in SAMPLE_RULES.items()}
    drawn = picking.pick(rows, rules, "doc_id", SEED, [picking.Limit("school", 2), picking.Limit("target", 1, soft=True)])
    taken = [r["doc_id"] for r in drawn.select("doc_id").collect()]
    held = {name: F.expr(rule) for name, rule in HOLDOUT_RULES.items()}
    rest = picking.pick(rows, held, "doc_id", f"{SEED}-holdout", [picking.Limit("school", 1), picking.Limit("target", 1)], "holdout", taken)
    return drawn.unionByName(rest)


#: Shapes that stores had over time; each %s is one of the values named behind it.
STORE_SHAPES = (
    ('{"version":3,"updated_at":"u%s","statuses":{"%s":"%s","b":{"status":"%s","responses":["已发","%s","已发"],"note":" n  %s "}}}', ("id", "lang", "state", "state", "source", "id")),
    ('{"version":"7","updatedAt":"v","records":{"%s":{"contactStatus":"%s","contacted_at":"","date":%s,"replyStatuses":"官回；%s、考核, own"}},"statuses":{}}', ("source", "state", "id", "lang")),
    ('{"records":{" a  %s":{"套磁情况":"不可能","套磁时间":"2026-01-0%s","回复情况备注":"x","套磁备注":"x","contact_note":"%s"}}}', ("lang", "digit", "source")),
    ('{"version":5.7,"statuses":{"q":{"status":0,"contactStatus":"已套磁","interview_at":"2026-07-15 09:3%s:45","name":" N  %s ","college":null,"school":%s}}}', ("digit", "source", "id")),
    ('{"version":false,"statuses":{"e":5,"f":["%s"],"g":{"interview_at":"bad","reply_statuses":[]}},"records":{"z":"已套磁"}}', ("lang",)),
    ('["%s"]', ("source",)),
)
STATES = ("已套磁", "不考虑", "先不考虑", "bogus", "")


def stored_documents(docs: DataFrame) -> DataFrame:
    """A store as JSON text for each document; ``(doc_id, store)``."""
    k = F.col("doc_id")
    values = {
        "id": k.cast("string"), "lang": F.coalesce("lang", F.lit("?")), "source": F.coalesce("source", F.lit("?")), "digit": (k % 10).cast("string"),
        "state": F.get(F.array(*[F.lit(s) for s in STATES]), (k % len(STATES)).cast("int")),
    }
    made = F.lit(None).cast("string")
    for i, (shape, names) in enumerate(STORE_SHAPES):
        made = F.when(k % len(STORE_SHAPES) == i, F.format_string(shape, *[values[n] for n in names])).otherwise(made)
    return docs.select("doc_id", made.alias("store"))


def normal_store_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = stores.normal_stores(stored_documents(table(spark, d, "documents")), ["doc_id"], "store")
    return rows.withColumn("responses", F.array_join("responses", "|"))


#: Candidates of a person, who is a run of so many documents.
CANDIDATES = 8
AFFILIATIONS, CITIES = ("src1", "crawl"), ("src2", "web")


def author_choices(spark: SparkSession, d: str) -> DataFrame:
    """Runs of documents as people, each document as a candidate by its first word; pages lend people their addresses."""
    docs = table(spark, d, "documents")
    person, word = F.floor(F.col("doc_id") / CANDIDATES).cast("long"), F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), "([A-Za-z]+)", 1))
    urls = table(spark, d, "pages").select(F.col("page_id").alias("person"), "url")
    first = docs.filter(F.col("doc_id") % CANDIDATES == 0).select(person.alias("person"), F.col("source").alias("name"), word.alias("w"))
    keys = F.when(F.col("person") % 11 > 0, F.array("w", F.left("w", F.lit(3))))
    people = first.join(urls, "person", "left").select("person", "name", keys.alias("query_keys"), F.when(F.col("person") % 3 > 0, F.array("url")).alias("homepages"))
    found = docs.filter(F.col("doc_id") % 13 > 0).select(
        person.alias("person"), F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("author_id"), word.alias("author_key"), F.col("source").alias("affiliation"),
        (F.col("doc_id") % 97 == 5).alias("direct"), (F.col("doc_id") % CANDIDATES).cast("int").alias("place"),
    )
    # An author's page is that of the person, a part of it, or another.
    shift = F.when(F.col("doc_id") % 4 == 1, person).otherwise(person + 1)
    shown = docs.select(F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("author_id"), shift.alias("person"), "doc_id").join(urls, "person")
    pages = shown.select("author_id", F.array(F.lit(""), F.concat(F.regexp_replace("url", "^http://", "https://www."), F.when(F.col("doc_id") % 8 == 1, "/cv/").otherwise(""))).alias("urls"))
    overrides = docs.filter("doc_id % 400 = 0").select(person.alias("person"), F.lit(None).cast("string").alias("name"), F.concat(F.lit("o"), F.col("doc_id").cast("string")).alias("author_id"))
    named = table(spark, d, "documents").select(F.col("source").alias("name")).filter("source LIKE '%7'").distinct().select(F.lit(None).cast("long").alias("person"), "name", F.lit("named").alias("author_id"))
    return verification.identified(people, found, pages, "person", AFFILIATIONS, CITIES, overrides.unionByName(named))


#: A person of the stored pages is a run of documents, a page a run of those; people have 0 to 4 pages.
PERSON, PAGE = 40, 10
WORK = "id string, display_name string, year int, kind string"


def _stored_pages(spark: SparkSession, d: str) -> DataFrame:
    person, place = F.floor(F.col("doc_id") / PERSON).cast("long"), F.floor(F.col("doc_id") % PERSON / PAGE).cast("int")
    rows = table(spark, d, "documents").select("doc_id", "n_chars", "source", "lang", person.alias("person"), place.alias("at")).filter(F.col("at") < F.col("person") % 5)
    item = F.to_json(F.struct(
        F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("w"), (F.col("doc_id") % 15).cast("string"))).alias("id"), F.when(F.col("doc_id") % 17 > 0, F.concat_ws(" ", "lang", "source")).alias("display_name"),
        (F.col("n_chars") % 30 + 2000).alias("year"), F.col("source").alias("kind"),
    ))
    items = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", item.alias("item")))), lambda x: x["item"])
    cursor = lambda at: F.when(at == 0, "*").otherwise(F.md5(F.concat_ws(":", "person", at)))
    pages = rows.groupBy("person", "at").agg(items.alias("items"))
    after = F.when(F.col("at") + 1 < F.col("person") % 5, cursor(F.col("at") + 1))
    return cut(pages.select("person", cursor(F.col("at")).alias("cursor"), after.alias("next"), "items"))


def _read_pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    stored = _stored_pages(spark, d)
    pages = paging.walk(stored.select("person").distinct(), stored, "person")
    return pages, paging.works(pages, "person", WORK, F.col("display_name"), F.col("id"), paging.allowed(F.col("kind"), never=("src3", "src11")))


def paged_works(spark: SparkSession, d: str) -> DataFrame:
    """Works on pages that are stored and followed from one to the next, the last of those alike."""
    return _read_pages(spark, d)[1].select("person", "place", "item", "id", "display_name", "year")


def paged_reading(spark: SparkSession, d: str) -> DataFrame:
    """How the reading of each person's stored pages went."""
    pages, works = _read_pages(spark, d)
    return paging.reading(pages, works, "person")


def merged_works(spark: SparkSession, d: str) -> DataFrame:
    """Runs of seven documents as the records of a work."""
    k, source, lang = F.col("doc_id"), F.coalesce("source", F.lit("?")), F.coalesce("lang", F.lit("?"))
    origin = F.get(F.array(*[F.lit(s) for s in ("official", "openalex", "zbmath", "arxiv", "other")]), (k % 5).cast("int"))
    records = table(spark, d, "documents").select(
        k.alias("record_id"), origin.alias("source"), F.when(k % 4 > 0, F.concat(F.lit("s"), (k % 6).cast("string"))).alias("source_id"),
        F.when(k % 11 == 3, F.concat(F.lit("10.1/"), k.cast("string"))).otherwise("").alias("doi"), F.when(k % 13 == 5, k.cast("string")).alias("arxiv_id"),
        F.when(k % 29 > 0, F.concat_ws(" ", F.lit("On"), source, lang)).alias("title"), F.when(k % 3 > 0, (F.col("n_chars") % 20 + 2005).cast("int")).alias("year"),
        F.when(k % 2 == 0, source).alias("venue"), F.lit(None).cast("string").alias("publication_date"), F.concat(F.lit(" u"), (k % 8).cast("string")).alias("url"), (k % 3 == 0).alias("is_preprint"),
        F.array(source, F.upper(source), lang, F.lit(" "), F.concat(F.lit("A "), (k % 3).cast("string"))).alias("authors"),
        F.when(k % 2 == 1, F.array(lang, F.lit("62H"))).alias("classifications"), F.array(F.initcap(lang)).alias("topics"),
    )
    groups = table(spark, d, "documents").select(k.alias("record_id"), (k - k % 7).alias("work_id"))
    joined = {c: F.array_join(c, "|") for c in ("sources", "source_ids", *unions.LISTS)}
    return unions.merged_works(records, groups).withColumns(joined)


#: Links by their place in a page: an address, given the word of the page's own link, and a text.
LINKS = (
    ("", "see"), ("https://%s.github.io/a#b", "code"), ("../x/./%s.html", "Home  Page"), ("http://www.zju.edu.cn/%s", "个人主页"), ("//Lab.example.org/%s/；", "x"),
    ("?q=%s", "the lab"), ("mailto:%s@a.b", "homepage"), ("#top", "主页"), ("https://dblp.org/%s", "实验室"), ("https://%s.example.net/", "My HomePage"), ("https://%s.example.net/", "more"),
)


def homepage_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of the pages, turned into others by their place, as those of a person's page."""
    found = F.regexp_extract_all("html", F.lit('<a href="/([^"]*)">'), F.lit(1))
    word = lambda w: F.lower(F.regexp_replace(w, "[^A-Za-z]", ""))

    def link(w: Column, i: Column) -> Column:
        made = [F.when((F.col("page_id") + i) % len(LINKS) == k, F.struct(F.format_string(href, word(w)) if "%s" in href else F.lit(href), F.lit(text))) for k, (href, text) in enumerate(LINKS)]
        return F.coalesce(*made).cast("struct<href:string,text:string>")

    links = F.transform(F.slice(found, F.lit(1), F.lit(1) + (F.col("page_id") % 9).cast("int")), link)
    pages = table(spark, d, "pages").select("page_id", "url", links.alias("links"))
    ways = {"outside": homepages.outside_links, "clean": homepages.clean_homepages, "section": homepages.section_homepages}
    return pages.select("page_id", *[F.array_join(way(F.col("links"), F.col("url")), " ").alias(n) for n, way in ways.items()], homepages.one_homepage(F.col("links"), F.col("url")).alias("first"))


JOINT = placement.Joint(
    "东南大学", {"cse": "计算机科学与工程学院", "software": "软件学院", "ai": "人工智能学院"}, "cse", ("计算机科学系", "计算机工程系"), ("计算机学院",), "计算机软件与人工智能学院", ("software", "ai")
)
#: What a profile says before a document's text, by doc_id; each step of the cascade decides one of them.
PROFILES = (
    "", "欢迎报考软件学院。", "人工智能学院 副教授", "于软件学院取得学位后任教授", "东南大学软件学院、计算机学院 教授", "计算机软件与人工智能学院", "今年招收计算机科学与工程学院和人工智能学院学生", "软件学院毕业，学院教授",
)


def joint_affiliations(spark: SparkSession, d: str) -> DataFrame:
    """Documents as profiles of people in a directory that three colleges share."""
    k = F.col("doc_id")
    said = F.get(F.array(*[F.lit(p) for p in PROFILES]), (k % len(PROFILES)).cast("int"))
    docs = table(spark, d, "documents")
    people = docs.select(
        "doc_id", F.concat(F.lit("n"), (k % 100).cast("string")).alias("name"), F.concat(F.lit("http://x.edu/"), k.cast("string"), F.lit("/?utm_a=1")).alias("url"),
        F.when(k % 5 == 0, "计算机科学系").when(k % 5 == 1, "other").alias("department"), F.concat(said, F.lit(" "), F.coalesce("text", F.lit(""))).alias("profile"),
    )
    overrides = docs.filter("doc_id % 50 = 7").select(
        k.alias("seq"), F.when(k % 100 == 7, F.concat(F.lit("n"), (k % 90).cast("string"))).alias("name"), F.when(k % 200 > 7, F.concat(F.lit("http://X.edu/"), k.cast("string"))).alias("url"),
        F.array(F.lit("ai"), F.lit("unknown")).alias("targets"), F.when(k % 3 == 0, "by hand").alias("status"), F.lit("seen").alias("evidence"), F.array(F.lit("s1"), F.lit("s2")).alias("sources"),
    )
    return placement.placed(people, "doc_id", JOINT, overrides).withColumn("evidence", F.md5("evidence"))


def restored_levels(spark: SparkSession, d: str) -> DataFrame:
    """Parts ranked without confirmed search results, which an earlier output has for every third; ranked again where they matter."""
    k = F.col("p_partkey")
    now = spread(table(spark, d, "part")).select(
        "p_partkey", F.when(k % 4 == 0, "").otherwise(F.col("p_name")).alias("direction"), F.when(k % 3 == 0, F.concat(F.lit("研究方向 "), "p_name", F.lit(". "), "p_type")).otherwise(F.col("p_type")).alias("bio"), F.col("p_brand").alias("department"),
        F.col("p_type").alias("dblp_keywords"), F.col("p_name").alias("dblp_titles"), F.when(k % 2 == 0, "高").otherwise("低").alias("dblp_confidence"),
    )
    before = table(spark, d, "part").filter("p_partkey % 3 = 0").select(
        "p_partkey", F.when(k % 11 == 0, "人工确认-x").otherwise("auto").alias("WebSearch状态"), F.lit("高").alias("WebSearch置信度"), F.col("p_name").alias("WebSearch关键词"), F.lit(None).cast("string").alias("WebSearch代表证据")
    )
    out = restoring.rank_restored(ranking.rank(now, RANK_PROFILE), restoring.from_sheet(before), "p_partkey", RANK_PROFILE)
    return out.select("p_partkey", "found", "changed", "level_before", "level", "score", "score_web_search")


def department_map(spark: SparkSession, d: str) -> DataFrame:
    """The department of a name: that of the last document that has one."""
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select(k, F.when(k % 4 > 0, F.concat_ws(":", "source", (F.col("n_chars") % 50).cast("string"))).alias("name"), F.when(k % 3 > 0, F.col("lang")).alias("department"))
    return restoring.first_wins(rows, "name", "department", [-F.col("doc_id")])


def detail_rows_of_people(spark: SparkSession, d: str) -> DataFrame:
    """Documents as detail rows of people, who are every fifth document: by id, else by name, with an address that doesn't speak against it."""
    k = F.col("doc_id")
    name = F.concat_ws(":", "source", F.floor(k / 25).cast("string"))
    page = lambda key, odd: F.when(key % odd > 0, F.concat(F.lit("http://p/"), (key % 2).cast("string")))
    docs = table(spark, d, "documents")
    people = docs.filter("doc_id % 5 = 0").select(k.alias("p"), F.when(k % 15 > 0, F.concat(F.lit("i"), k.cast("string"))).alias("person"), name.alias("name"), page(F.floor(k / 5), 3).alias("url"))
    rows = docs.select(k.alias("r"), F.when(k % 6 == 0, F.concat(F.lit(" i"), (k - k % 10).cast("string"))).otherwise("").alias("person"), name.alias("name"), page(k, 4).alias("url"))
    return restoring.person_details(people, rows, "person", "name", "url").select("p", F.col("detail_r").alias("r"))


def synced_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Documents as rows of a sheet with status columns of old, brought in line with the stores that documents hold."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents")
    old = F.get(F.array(*[F.lit(s) for s in STATES]), (k % len(STATES)).cast("int"))
    rows = docs.select(
        "doc_id", F.col("source").alias("姓名"), F.when(k % 4 == 0, "备注 a").alias("套磁备注"), F.when(k % 3 == 0, " b").alias("回复情况备注"), "lang", old.alias("套磁情况"),
        F.when(k % 7 == 0, "官回；else、已发").alias("回复情况"), F.when(k % 5 == 0, "2026-03-04 05:06:07").when(k % 5 == 1, "soon").alias("约面试时间"),
    )
    entries = stores.normal_stores(stored_documents(docs), ["doc_id"], "store")
    store = entries.withColumn("row_key", F.concat_ws("|", F.col("doc_id").cast("string"), "row_key"))
    own = lambda name: lambda df: F.concat_ws("|", F.col("doc_id").cast("string"), name)
    out = sheets.synced(rows, store, own(F.lit("b")), own(F.lit("q")))
    return out.withColumnsRenamed({"姓名": "name"} | sheets.COLUMNS)


#: Works of a person: so many documents in a row; the names of parts play titles.
RUN = 12


def person_findings(spark: SparkSession, d: str) -> DataFrame:
    """Documents as works of people, titled by parts."""
    k = F.col("doc_id")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_name")
    works = table(spark, d, "documents").select(
        F.floor(k / RUN).cast("long").alias("person"), k.alias("at"), (F.col("n_chars") % 4 + 2020).cast("int").alias("year"), F.when(k % 5 > 0, F.col("source")).alias("venue"), (k % 190 + 1).alias("part")
    )
    works = works.join(parts, "part").select("person", "at", "year", "venue", F.col("p_name").alias("title"))
    return findings.person_findings(works, "person", "year", "venue", "title", "at", RANK_PROFILE)


def publication_audit(spark: SparkSession, d: str) -> DataFrame:
    """Documents as people, works, candidates and sources of a run."""
    k, docs = F.col("doc_id"), table(spark, d, "documents")
    people = docs.select(F.when(k % 10 > 0, F.md5(k.cast("string"))).otherwise(" ").alias("seed_hash"))
    details = docs.select(
        F.concat(F.lit("p"), (k % 100).cast("string")).alias("person"), F.when(k % 4 > 0, F.concat(F.lit("w"), (F.col("n_chars") % 50).cast("string"))).alias("canonical_id"), F.when(k % 9 > 0, "t").otherwise("").alias("title"),
        F.when(k % 3 == 0, "r").alias("trace_id"), F.when(k % 5 > 0, "u").otherwise(" ").alias("url"),
    )
    candidates = docs.select(F.when(k % 2 == 0, F.when(k % 6 == 0, "是").otherwise("否")).alias("needs_review"), F.when(k % 7 == 0, "review").when(k % 7 == 1, "unresolved").otherwise("accepted").alias("decision"))
    return findings.publication_audit(people, details, candidates, docs.select("source", F.when(k % 8 == 0, "failed").when(k % 8 < 5, "success").alias("status")))


def checked_entries(spark: SparkSession, d: str) -> DataFrame:
    """Documents as entries of people, the last of those alike, checked against what is known of the people."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents")
    title = F.concat(F.lit("on robust "), F.lower("source"), F.lit(" in "), F.coalesce("lang", F.lit("?")))
    entries = docs.select(
        F.floor(k / RUN).cast("long").alias("person"), k.alias("at"), title.alias("title"), F.when(k % 3 == 0, F.concat(F.lit("l"), (k % 5).cast("string"))).otherwise("").alias("link"),
        F.concat(F.lit("2024-0"), (F.col("n_chars") % 9 + 1).cast("string")).alias("published"), F.concat_ws("; ", F.lit("A. Bee"), F.concat(F.lit("C "), "lang")).alias("authors"),
    )
    kept = findings.last_entries(entries, "person", "at")
    people = docs.filter(k % RUN == 0).select(
        F.floor(k / RUN).cast("long").alias("person"), F.when(k % 24 == 0, "C. en").otherwise("").alias("dblp_author"), F.when(k % 36 > 0, "高").otherwise("低").alias("dblp_confidence"),
        F.concat(F.lit("x; On Robust src1"), (k % 7).cast("string"), F.lit(" in en; On robust SRC4 in en")).alias("dblp_titles"), F.when(k % 60 == 0, "high").alias("publication_confidence"),
        F.lit("On robust src13 in fr; on robust src2 in en").alias("publication_titles"),
    )
    return findings.cross_checked(people, kept, "person")


def directory_identities(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of pages, some under hosts that many share, as those of directory rows."""
    hosts = ("https://www.nju.edu.cn", "http://cs.seu.edu.cn", "https://dblp.org", "http://aiia.seu.edu.cn", "https://ai.fudan.edu.cn", "https://dml.fudan.edu.cn")
    ends = ("/", "/index.htm", "/x/list.htm", "/54820/list.htm", "/ann", "", "/?b=2&a=1")
    k = F.col("page_id")
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    made = F.concat(pick(hosts, k % len(hosts)), pick(ends, F.floor(k / len(hosts)) % len(ends)))
    return table(spark, d, "pages").select("page_id", F.array_join(homepages.directory_keys(made, F.col("url")), " ").alias("keys"))


def patched_store(spark: SparkSession, d: str) -> DataFrame:
    """Every third document as an entry of a store, and documents as patches of each other's."""
    k, docs, empty = F.col("doc_id"), table(spark, d, "documents"), F.array().cast("array<string>")
    key = lambda n: F.concat(F.lit("k"), n.cast("string"))
    old = F.get(F.array(*[F.lit(s) for s in STATES]), (k % len(STATES)).cast("int"))
    store = docs.filter("doc_id % 3 = 0").select(
        key(k).alias("row_key"), F.when(old.isin("已套磁", "先不考虑"), old).otherwise("").alias("status"), F.lit("2026").alias("contacted_at"), F.when(k % 2 == 0, F.array(F.lit("官回"))).otherwise(empty).alias("responses"),
        F.lit("").alias("interview_at"), F.lit("").alias("note"), *[F.lit("old").alias(c) for c in stores.ABOUT], F.lit("before").alias("updated_at"),
    )
    patches = docs.select(
        key(F.floor(k / 2).cast("long")).alias("row_key"), k.alias("seq"), F.concat(F.lit("t"), k.cast("string")).alias("at"), F.when(k % 4 > 0, old).alias("status"), F.when(k % 3 == 1, "").alias("contacted_at"),
        F.when(k % 5 == 0, empty).when(k % 5 == 1, F.array(F.lit("已发"), F.lit(" 已发 "), F.lit("own"))).alias("responses"), F.when(k % 7 == 0, "2026-01-02 03:04:05").alias("interview_at"), F.when(k % 6 == 0, F.col("lang")).alias("note"),
    )
    people = docs.filter("doc_id % 10 > 0").select(key(k).alias("row_key"), F.col("source").alias("name"), F.lit("s").alias("school"), F.lit(None).cast("string").alias("college"), F.lit(" u ").alias("teacher_url"))
    return stores.patched(store, patches, people).withColumn("responses", F.array_join("responses", "|"))


def people_materials(spark: SparkSession, d: str) -> DataFrame:
    """Sources as people with a table's entry, and the first three documents under their name as what is said of them."""
    docs = table(spark, d, "documents")
    people = docs.select(F.col("source").alias("who")).distinct()
    entries = table(spark, d, "supplier").select(F.concat(F.lit("src"), (F.col("s_suppkey") % 15).cast("string")).alias("name"), "s_suppkey", "s_name")
    found = docs.filter("doc_id % 2 = 0").select(F.col("source").alias("name"), "doc_id")
    titles = docs.select("doc_id", F.concat(F.lit("T"), (F.col("doc_id") % 60).cast("string")).alias("title"))
    out = sections.person_materials(people, "who", entries, found, titles, "doc_id")
    return out.select("who", "entry.s_suppkey", F.array_join("evidence", "|").alias("evidence"))


QUERIES = {
    f.__name__: f
    for f in (
        picked_samples, normal_store_entries, author_choices, paged_works, paged_reading, merged_works, homepage_links, joint_affiliations, restored_levels, department_map, detail_rows_of_people,
        synced_sheets, person_findings, publication_audit, checked_entries, directory_identities, patched_store,
        people_materials,
    )
}
