"""Registered queries of ranking, curation, identity, sections, validation and the viewer."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import candidates, curation, dashboard, evidence, manifest, merging, ranking, sections, seed, validation
from dossier.plans.queries import PROFILE
from dossier.sources import extractor, sinks
from dossier.sources.tables import spread, table

RANK_PROFILE = replace(PROFILE, excluded=("cold",), bonus=(("brand#1", 4), ("brand#12", 8), ("brand#3", 6)))
RUN = manifest.Run("rank", "s/c", "demo", "p1", 3, "v2", ("2024", "2025"), {"a": "b"})


def _when(*pairs: tuple[Column, object], other: object) -> Column:
    out = F.lit(other) if not isinstance(other, Column) else other
    for condition, value in reversed(pairs):
        out = F.when(condition, value).otherwise(out)
    return out


def ranked_people(spark: SparkSession, d: str) -> DataFrame:
    """Parts as people with evidence from all six sources."""
    k, name, kind = F.col("p_partkey"), F.col("p_name"), F.col("p_type")
    people = spread(table(spark, d, "part")).select(
        "p_partkey", _when((k % 4 == 0, ""), other=name).alias("direction"),
        _when((k % 3 == 0, F.concat(F.lit("研究方向 "), name, F.lit(". "), kind)), other=kind).alias("bio"), F.col("p_brand").alias("department"),
        kind.alias("dblp_keywords"), name.alias("dblp_titles"), _when((k % 2 == 0, "高"), other="低").alias("dblp_confidence"),
        name.alias("publication_keywords"), _when((k % 3 == 0, "high"), (k % 3 == 1, "medium"), other="low").alias("publication_confidence"),
        _when((k % 5 == 0, "zbmath:no_record"), other="official:no_record; zbmath:success/high").alias("publication_status"),
        name.alias("arxiv_keywords"), _when((k % 7 == 0, "中-DBLP交叉确认"), other="低").alias("arxiv_confidence"),
        kind.alias("web_keywords"), _when((k % 2 == 1, "已抓取"), other="").alias("web_status"),
        name.alias("web_search_keywords"), F.lit("高").alias("web_search_confidence"), _when((k % 11 == 0, "人工确认-x"), other="auto").alias("web_search_status"),
    )
    ranked = ranking.rank(people, RANK_PROFILE)
    return ranked.select(
        "p_partkey", "score", "level", "can_contact", "explicit_anchor", F.size("matched_keywords").alias("n_matched"),
        F.array_join("matched_direction_groups", ";").alias("groups"), F.array_join("reasons", "|").alias("reasons"),
        F.array_join("warnings", "|").alias("warnings"), *[f"score_{s}" for s in ("official", *ranking.SOURCES)],
    )


def catalogue_gate(spark: SparkSession, d: str) -> DataFrame:
    listed = F.when(F.col("c_acctbal") > 2000, "是").otherwise("否")
    level = F.when(F.col("c_mktsegment") == "BUILDING", ranking.LEVELS[0]).when(F.col("c_mktsegment") == "MACHINERY", ranking.LEVELS[1]).otherwise("x")
    wanted = evidence.wants_catalogue(listed, level, F.substring("c_name", -1, 1), ranking.LEVELS[:2], ("1", "3", "5"))
    return table(spark, d, "customer").filter(wanted).select("c_custkey")


def publication_query_gate(spark: SparkSession, d: str) -> DataFrame:
    wanted = evidence.wants_publications(F.when(F.col("c_nationkey") < 3, "是").otherwise("否"), F.col("c_acctbal") - 9000)
    return table(spark, d, "customer").filter(wanted).select("c_custkey")


def host_classes(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of pages, and of known hosts with each page's path behind them."""
    hosts = ("https://www.baidu.com", "http://cs.sjtu.edu", "https://a.edu.cn", "https://x.github.io", "https://github.com", "https://dblp.org", "https://www.so.com", "http://mit.edu")
    pages = table(spark, d, "pages")
    made = F.concat(F.array(*[F.lit(h) for h in hosts]).getItem((F.col("page_id") % len(hosts)).cast("int")), F.lit("/p"), F.col("page_id").cast("string"))
    every = pages.select("page_id", "url").unionAll(pages.select("page_id", made))
    return every.select("page_id", "url", curation.host_class(F.col("url"), F.lit("sjtu")).alias("host_class"))


def accepted_results(spark: SparkSession, d: str) -> DataFrame:
    kind = curation.host_class(F.col("url"), F.lit(""))
    confidence = _when((F.col("page_id") % 3 == 0, "高"), (F.col("page_id") % 3 == 1, "中"), other="低")
    words = _when((F.col("page_id") % 4 == 0, "ring"), other=" ")
    good = curation.acceptable(kind, confidence, words, F.concat_ws(" ", "url", F.when(F.col("page_id") % 5 == 0, "in 2024")))
    return table(spark, d, "pages").filter(good).select("page_id", "url")


def curated_items(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as curated items for customers: every other one by id, the others by a name that may be shared."""
    name = lambda key: F.concat(F.lit("n"), F.floor(key / 3 * 2).cast("string"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("person"), name(F.col("c_custkey")).alias("name"))
    items = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("item"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") * 3).cast("string").alias("person"), name(F.col("s_suppkey")).alias("name"), "s_name"
    )
    return curation.curated(items, people, "person", "name").select("item", F.col("row_id").cast("long").alias("row_id"))


def applied_curation(spark: SparkSession, d: str) -> DataFrame:
    urls = F.concat_ws("; ", F.array_repeat("url", (F.col("page_id") % 4).cast("int")))
    made = curation.apply_curated((F.col("page_id") % 3).cast("int"), urls)
    return table(spark, d, "pages").select("page_id", made.alias("m")).select("page_id", "m.status", "m.count", F.size("m.links").alias("n_links"))


def search_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Words of a part's type as results of a first search, of its name as those of another."""
    hits = lambda c: F.transform(F.split(c, " "), lambda w: F.struct(w.alias("title")))
    query = F.concat(F.lit('"'), F.substring_index("p_type", " ", 1), F.lit('" "x'), F.col("p_size").cast("string"), F.lit('"'))
    first = F.when(F.col("p_partkey") % 3 == 0, hits(F.col("p_name"))).when(F.col("p_partkey") % 3 == 1, hits(F.col("p_type")))
    chosen = curation.choose_results(first, hits(F.col("p_name")), query)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(chosen, lambda r: r["title"]), " ").alias("titles"))


def detail_rows(spark: SparkSession, d: str) -> DataFrame:
    entries = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("title"), F.when(F.length(w) > 4, "高").otherwise("低").alias("confidence")))
    rows = curation.evidence_rows(table(spark, d, "part").withColumn("evidence", entries), "evidence", ["p_partkey", "p_brand"])
    return curation.only_reliable(rows, "confidence")


def merged_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one source and length as rows of one person."""
    docs = table(spark, d, "documents").select(
        F.concat_ws(":", "source", F.floor(F.col("n_chars") / 200).cast("string")).alias("person"), "doc_id", F.col("lang").alias("title"),
        F.left("text", F.lit(5)).alias("email"), F.concat(F.lit(" d"), (F.col("doc_id") % 3).cast("string")).alias("name"), "source",
    )
    return merging.merge_rows(docs, "person", "doc_id", ["title", "email"], "name", "source").select("person", "name", "title", "email", "note", "n_merged")


def cross_target_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents as rows of their languages, alike by first words or by source and length."""
    text = F.coalesce("text", F.lit(""))
    lang = F.coalesce("lang", F.lit("?"))
    place = _when((lang == "en", 0), (lang == "de", 1), (lang == "fr", 2), other=3)
    rows = table(spark, d, "documents").select(
        (place.cast("long") * (1 << 40) + F.col("doc_id")).alias("o"), lang.alias("target"), F.when(lang.isin("de", "fr"), "both").otherwise("").alias("overlap"),
        F.col("source").alias("name"), F.array(F.concat(F.lit("u:"), F.md5(F.left(text, F.lit(60))))).alias("keys"),
        F.when(F.col("doc_id") % 4 == 0, F.concat_ws(":", "source", F.col("n_chars").cast("string"))).alias("by_name"),
    )
    return merging.across_targets(rows)


def candidate_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of a part as its candidates; the returned lines speak for and against them."""
    pairs = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.count(F.lit(1)).cast("int").alias("overlap"), F.max(F.col("l_returnflag") == "R").alias("name"), F.max(F.col("l_discount") > 0.08).alias("orcid"),
        F.max(F.col("l_tax") > 0.07).alias("affiliation"), F.max(F.col("l_quantity") > 49).alias("conflict"), F.max(F.col("l_quantity") < 2).alias("strong"),
    )
    score = F.col("overlap") * 5 + F.when(F.col("name"), 4).otherwise(0)
    rows = pairs.withColumnsRenamed({"l_partkey": "p_partkey"}).withColumns({"author_id": F.col("l_suppkey").cast("string"), "score": score})
    people = table(spark, d, "part").select("p_partkey", candidates.source_ids(F.concat(F.lit("https://x.org/A/"), (F.col("p_partkey") % 100).cast("string"), F.lit("；7"))).alias("rejected_ids"))
    out = candidates.judge(rows, "openalex", people, "p_partkey")
    return out.select("p_partkey", "author_id", "score", F.array_join("signals", ";").alias("signals"), F.array_join("conflicts", ";").alias("conflicts"), "decision")


def candidate_statuses(spark: SparkSession, d: str) -> DataFrame:
    judged = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), F.when(F.col("l_suppkey") % 2 == 0, F.array(F.lit(candidates.OVERRIDDEN))).otherwise(F.array().cast("array<string>")).alias("conflicts")
    ).filter(F.col("l_linenumber") == 1)
    people = table(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_size") == 7, " Rejected ").alias("review_status"), (F.col("p_size") % 5).alias("n_names"), F.when(F.col("p_size") == 9, "A1").alias("confirmed_id")
    )
    return candidates.search_status(people, judged, "p_partkey")


def official_statuses(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).alias("year"), (F.col("o_orderstatus") == "F").alias("is_record"))
    return candidates.official_status(rows.filter("o_custkey % 3 = 0"), "o_custkey", "year", 2001, 2001)


def chosen_authors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("person"), F.concat(F.lit("n"), (F.col("l_partkey") % 50).cast("string")).alias("name"), F.col("l_suppkey").alias("author_id")).distinct()
    own = table(spark, d, "part").filter("p_size = 3").select(F.col("p_partkey").alias("person"), F.lit(None).cast("string").alias("name"), F.lit(1).cast("long").alias("author_id"))
    shared = spark.range(10).select(F.lit(None).cast("long").alias("person"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), (F.col("id") * 10).alias("author_id"))
    return candidates.pick_author(rows, own.unionByName(shared), "person", "name").filter("direct").select("person", "author_id")


def discovered_ids(spark: SparkSession, d: str) -> DataFrame:
    source, found = _when((F.col("doc_id") % 2 == 0, "zbmath"), other="openalex"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id").cast("string")).otherwise("")
    ids = {s: candidates.discovered(source, found, s, F.lit("old")).alias(f"{s}_id") for s in ("zbmath", "openalex")}
    return table(spark, d, "documents").select("doc_id", *ids.values())


def identity_seeds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    people = table(spark, d, "customer").select(
        "c_custkey", F.col("c_name").alias("name"), F.when(k % 3 == 0, F.concat(F.lit("E "), "c_name")).alias("english_name"), F.concat_ws("; ", "c_mktsegment", "c_name").alias("english_aliases"),
        F.array(F.lit("Found"), F.lit(" ")).alias("found_names"), F.lit(None).cast("array<string>").alias("generated_names"), F.array("c_mktsegment", F.lit("")).alias("institutes"),
        F.concat(F.lit(seed.ORCID_PREFIX), k.cast("string")).alias("orcid"), F.lit("O1").alias("openalex_id"), F.lit(None).cast("string").alias("zbmath_author_id"), F.lit("").alias("dblp_pid"),
        F.array_repeat("c_name", 7).alias("titles"),
    )
    overrides = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("canonical_english_name"), F.array("s_name", F.lit("Alias")).alias("aliases"),
        F.array(F.lit("Inst")).alias("affiliations"), F.lit("").alias("orcid"), F.lit("O2").alias("openalex_id"), F.lit("Z").alias("zbmath_author_id"),
        F.lit(None).cast("string").alias("dblp_pid"), F.lit(None).cast("array<string>").alias("known_titles"), F.lit("confirmed").alias("review_status"),
    )
    out = seed.seeds(people, overrides, "c_custkey")
    joined = [F.array_join(c, "|").alias(c) for c in ("aliases", "affiliations", "known_titles", "query_names")]
    return out.select("c_custkey", "canonical_english_name", "orcid", "openalex_id", "zbmath_author_id", "dblp_pid", "review_status", *joined)


def affiliation_cascade(spark: SparkSession, d: str) -> DataFrame:
    rules = {"en": [" of the "], "de": [" und der ", " nicht "], "fr": [" dans "]}
    docs = table(spark, d, "documents")
    overrides = docs.filter("doc_id % 50 = 0").select("doc_id", F.lit("de").alias("target"), F.when(F.col("doc_id") % 100 == 0, " ").otherwise("by hand").alias("status"))
    return seed.affiliations(docs, "doc_id", F.col("source"), F.col("text"), ("home", ("src0", "src1", "source_1", "web")), rules, overrides)


def profile_ids(spark: SparkSession, d: str) -> DataFrame:
    made = F.when(F.col("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", seed.is_profile_id(made).alias("valid"), seed.custom_profile_id(made).alias("custom"))


def keyword_groups(spark: SparkSession, d: str) -> DataFrame:
    words = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    split = seed.keyword_split(words, PROFILE.direction_groups, ("rings", "trade"))
    return table(spark, d, "part").select("p_partkey", split.alias("s")).select("p_partkey", F.array_join("s.bridge", ";").alias("bridge"), F.array_join("s.core", ";").alias("core"))


def section_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents between lines that begin with some words and lines that begin with others."""
    docs = table(spark, d, "documents")
    lines = sections.lines_of(docs, "doc_id", F.col("text"))
    out = sections.sections(lines.withColumn("line", F.regexp_replace("line", "^(The|the|Der|der|La|la) ", "publications: ")), "doc_id", closing=("and ", "und ", "et ", "que "))
    return out.select("doc_id", F.col("at").cast("long").alias("at"), "section", F.md5("line").alias("line_md5"))


def biographies(spark: SparkSession, d: str) -> DataFrame:
    lines = sections.lines_of(table(spark, d, "documents"), "doc_id", F.col("text"))
    out = sections.biography(lines, "doc_id", 300, ("the and", "und der", "que la"))
    return out.select("doc_id", F.length("bio").cast("long").alias("n_bio"), F.md5("bio").alias("bio_md5"))


def english_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("职称 教授 英文名： "), F.initcap("p_name"), F.lit("，x"))).otherwise("none")
    meta = F.when(k % 3 == 1, F.concat("p_name", F.when(k % 2 == 0, F.lit(" College")).otherwise("")))
    found = sections.english_name(text, meta, F.concat(F.lit("张三 "), F.initcap("p_name"), F.lit(" (x)")))
    return table(spark, d, "part").select("p_partkey", found.alias("f")).select("p_partkey", "f.name", "f.source")


def publication_sections(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as pages: a heading, records made of an item's words and years, a closing heading."""
    words = F.trim(F.left(F.regexp_replace("text", r"\s+", " "), F.lit(60)))
    body = F.concat(F.lit("About\nPublications:\n1. "), words, F.lit(", Journal of X, 2021.\n2. "), words, F.lit(", Journal of X, 2021.\nshort 2020\n获奖 2020\nlater, Journal of Y, 2022"))
    lines = sections.lines_of(table(spark, d, "benchmark"), "item_id", body)
    return sections.publication_lines(lines, "item_id").select("item_id", F.col("place").cast("long").alias("place"), F.md5("line").alias("line_md5"))


def printed_table(spark: SparkSession, d: str) -> DataFrame:
    """Parts as rows of a printed table, text as it comes out of such a file."""
    block = F.concat_ws(
        "\n", F.lit("研究生导师信息库 x"), (F.col("p_partkey") % 1000).cast("string"), F.lit("计算所"), F.lit("王小明"), F.lit("教授"), F.col("p_name"), F.col("p_type"),
        F.lit("玉泉校区 302室"), F.concat(F.lit("a"), F.col("p_partkey").cast("string"), F.lit("@zju.edu.")), F.lit("cn"), F.lit("第 1 页"), F.lit("博导"),
    )
    return sections.table_rows(sections.lines_of(table(spark, d, "part"), "p_partkey", block), "p_partkey")


def team_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a Chinese sentence behind their text, which names some of five people."""
    people = ("李明", "王小明", "欧阳小明", "张三", "赵四")
    name = F.array(*[F.lit(p) for p in people]).getItem((F.col("doc_id") % 5).cast("int"))
    said = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("导师 "), name, F.lit("的团队"))).when(F.col("doc_id") % 11 == 0, F.concat(F.lit("题为"), name))
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce(said, F.lit("")), "text").alias("text"))
    names = spark.createDataFrame([(p,) for p in people], "name string")
    return sections.mentions(docs, "doc_id", F.col("text"), names, "name").select("name", "doc_id", F.col("place").cast("long").alias("place"))


def evidence_summary(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as results of three sources; segments and statuses play the words."""
    k = F.col("o_custkey")
    per = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")).alias("titles"),
    )

    def result(source: str, status: Column, confidence: Column) -> Column:
        own = F.lit(source)
        return F.struct(
            own.alias("source"), status.alias("status"), confidence.alias("confidence"), F.concat(own, k.cast("string")).alias("author_id"), F.concat(F.lit("u:"), own).alias("author_url"),
            F.when(k % 4 == 0, F.concat(own, F.lit("-o"))).otherwise("").alias("orcid"), F.array(own, F.lit("c"), F.lit("")).alias("classes"), F.when(k % 2 == 0, own).otherwise("").alias("reason"),
        )

    results = F.array(
        result("official", F.when(F.col("f") > 0, "success").otherwise("no_record"), F.when(F.col("f") > 0, "high").otherwise("")),
        result("zbmath", F.when(k % 3 == 0, "success").otherwise("no_candidate"), F.when(k % 2 == 0, "medium").otherwise("")),
        result("openalex", F.when(k % 5 == 0, "no_recent_record").otherwise("identity_uncertain"), F.when(k % 7 > 1, "high").otherwise("low")),
    )
    made = evidence.evidence_columns(results, F.col("titles"), F.split(F.lit("a;b;c"), ";"), F.array(F.lit("b"), F.concat(F.lit("c"), F.when(k % 2 == 0, "").otherwise("x"))))
    return per.select("o_custkey", made.alias("m")).select("o_custkey", "m.*")


def row_marks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name").alias("name"), F.col("c_mktsegment").alias("direction"), F.when(F.col("c_nationkey") > 3, F.lit("x")).alias("bio"))
    return rows.select("c_custkey", manifest.row_mark(rows, F.col("c_custkey").cast("string"), RUN).alias("mark"))


def rebuilt_rows(spark: SparkSession, d: str) -> DataFrame:
    """Customers with the evidence of their last saved event; the others marked as not processed."""
    saved = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), "event_id", F.col("event_type").alias("arxiv_status"), F.col("event_id").cast("string").alias("arxiv_keywords"))
    last = manifest.latest_checkpoints(saved.withColumn("c_custkey", F.col("c_custkey").cast("string")), "c_custkey", "event_id")
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_mktsegment")
    out = manifest.from_checkpoint(rows, last, "c_custkey", {"arxiv_status": F.lit(manifest.UNPROCESSED), "arxiv_keywords": F.lit("")})
    return out.withColumn("c_custkey", F.col("c_custkey").cast("long"))


def saved_evidence(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    dates = F.transform(F.sequence(F.lit(0), F.col("p_size") % 3), lambda i: F.concat((i + 2020).cast("string"), F.lit("-01-02")))
    made = manifest.saved_evidence(dates, F.when(k % 2 == 0, F.col("p_brand")), F.col("p_type"), F.when(k % 3 == 0, F.split("p_name", " ")), F.replace("p_type", F.lit(" "), F.lit("；")))
    out = table(spark, d, "part").select("p_partkey", made.alias("m")).select("p_partkey", "m.*")
    return out.select("p_partkey", "n_papers", F.array_join("years", ";").alias("years"), "keywords", F.array_join("snippets", ";").alias("snippets"))


def stage_states(spark: SparkSession, d: str) -> DataFrame:
    stages = table(spark, d, "nation").select(F.col("n_name").alias("stage"), F.when(F.col("n_regionkey") < 3, "demo").when(F.col("n_regionkey") == 3, "").alias("profile_id"), F.when(F.col("n_nationkey") % 2 == 0, "p1").alias("profile_hash"))
    return manifest.stage_states(stages, RUN)


def semantic_cache(spark: SparkSession, d: str) -> DataFrame:
    """Parts looked up by brand, size, type and year among those of even and, read through, of odd keys."""
    parts = table(spark, d, "part")
    keys = [F.col("p_brand").alias("source"), manifest.input_hash("works", "v1", {"size": F.col("p_size"), "name": F.col("p_name")}).alias("input"), F.lit("v1").alias("version"), F.col("p_type").alias("window")]
    status = F.when(F.col("p_partkey") % 4 < 2, "success").otherwise("request_failed").alias("status")
    cache = parts.filter("p_partkey % 2 = 0").select(*keys, status, F.col("p_partkey").alias("value"))
    through = parts.filter("p_partkey % 2 = 1").select(*keys, status, F.col("p_partkey").alias("value"))
    return manifest.semantic_cache(parts.select("p_partkey", *keys), cache, ["source", "input", "version", "window"], "status", ["value"], through).select("p_partkey", "origin", "value")


def changed_files(spark: SparkSession, d: str) -> DataFrame:
    own = lambda when, shift: table(spark, d, "orders").filter(when).select(
        F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").alias("modified"), (F.floor("o_totalprice") + shift).alias("size")
    )
    return manifest.stale_files(own("o_orderkey % 5 <> 1", F.lit(0)), own("o_orderkey % 5 <> 2", (F.col("o_orderkey") % 5 == 3).cast("int"))).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    level = lambda k: F.array(*[F.lit(v) for v in ranking.LEVELS]).getItem((k % 3).cast("int"))
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").withColumn("sample_id", k)
    samples = rows.select("sample_id", "c_mktsegment", F.when(k % 10 == 0, validation.SENTINEL).otherwise("main").alias("category"), level(k).alias("old_level"))
    queue, baseline = validation.export(samples, ["c_mktsegment"], ["category", "old_level"])
    manual = rows.select("sample_id", level(F.floor(F.col("c_acctbal") / 100).cast("long") + 1000).alias("manual_level"))
    current = rows.select("sample_id", level(F.col("c_nationkey")).alias("new_level"), (k % 7 > 0).alias("new_anchor"))
    return queue, baseline, manual, current


def validation_metrics(spark: SparkSession, d: str) -> DataFrame:
    return validation.metrics(validation.compare(*_judged(spark, d)))


def validation_rows(spark: SparkSession, d: str) -> DataFrame:
    return validation.compare(*_judged(spark, d)).select("sample_id", "category", "manual_level", "old_error", "new_error")


def validation_heads(spark: SparkSession, d: str) -> DataFrame:
    rules = {"debtor": F.col("c_acctbal") < 0, "builder": F.col("c_mktsegment") == "BUILDING", "rich builder": (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 9000)}
    return validation.categories(table(spark, d, "customer"), rules, "c_custkey", "s1", 4).select("category", "c_custkey", F.col("place").cast("long").alias("place"))


def prefix_statuses(spark: SparkSession, d: str) -> DataFrame:
    store = table(spark, d, "customer").select(F.concat_ws("|", F.col("c_nationkey").cast("string"), F.concat(F.lit("n"), (F.col("c_custkey") % 40).cast("string")), F.col("c_custkey").cast("string")).alias("row_key"), F.col("c_mktsegment").alias("entry"))
    rows = table(spark, d, "supplier").select(
        "s_suppkey", F.concat_ws("|", F.col("s_nationkey").cast("string"), F.concat(F.lit("n"), (F.col("s_suppkey") % 40).cast("string")), F.col("s_suppkey").cast("string")).alias("k"),
        F.concat_ws("|", F.col("s_nationkey").cast("string"), F.concat(F.lit("n"), (F.col("s_suppkey") % 40).cast("string")), F.lit("")).alias("p"),
    )
    return dashboard.status_by_prefix(rows, store, "k", "p").select("s_suppkey", "entry")


def merged_entries(spark: SparkSession, d: str) -> DataFrame:
    entry = lambda a, r: F.struct(a.alias("status"), F.lit(None).cast("string").alias("note"), r.alias("responses"))
    k = F.col("c_custkey")
    base = entry(F.col("c_mktsegment"), F.array("c_name"))
    stored = entry(F.when(k % 2 == 0, F.lit("x")), F.when(k % 3 == 0, F.array(F.lit("r"))).when(k % 3 == 1, F.array().cast("array<string>")))
    merged = dashboard.merge_entries(base, stored, ["status", "note"])
    return table(spark, d, "customer").select("c_custkey", merged.alias("m")).select("c_custkey", "m.status", F.array_join("m.responses", ";").alias("responses"))


def header_summary(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.header(table(spark, d, "customer"), F.col("c_acctbal") > 0, F.col("c_mktsegment"), "BUILDING", ["MACHINERY", "FURNITURE"])


def filter_choices(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    return dashboard.choices(rows, "n_name", F.col("n_regionkey") == 2)


def list_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of customers by balance: the limit is the feature."""
    return dashboard.page(table(spark, d, "customer"), [F.col("c_acctbal").desc(), F.col("c_custkey")], 3).select("c_custkey", F.col("place").cast("long").alias("place"))


def changed_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    entry = F.struct(F.when(k % 2 == 0, F.lit("2024-01-01")).otherwise("").alias("contacted_at"), F.when(k % 3 == 0, F.array(F.lit("r"))).otherwise(F.array().cast("array<string>")).alias("responses"))
    made = dashboard.change_status(entry, _when((k % 5 == 0, "已套磁"), (k % 5 == 1, ""), other="不匹配"), F.lit("2026-07-15"), "已套磁", "已发")
    return table(spark, d, "customer").select("c_custkey", made.alias("m")).select("c_custkey", "m.status", "m.contacted_at", F.array_join("m.responses", ";").alias("responses"))


def signal_chips(spark: SparkSession, d: str) -> DataFrame:
    made = dashboard.new_signals([("name", F.replace("p_name", F.lit(" "), F.lit("；"))), ("type", F.concat(F.lit("DBLP关键词："), F.replace(F.lower("p_type"), F.lit(" "), F.lit("。,")))), ("both", F.concat_ws("|", "p_name", F.upper("p_type")))])
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(made, lambda g: F.concat(g["source"], F.lit("="), F.array_join(g["signals"], "+"))), ";").alias("chips"))


def score_breakdown(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    scores = [("official", F.when(k % 3 == 0, F.col("p_size"))), ("dblp", F.when(k % 6 == 0, F.col("p_size") + 1))]
    made = dashboard.breakdown(scores, [("papers", F.col("p_size")), ("pages", F.lit(None).cast("int"))])
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(made, lambda e: F.concat(e["label"], F.lit("="), e["value"])), ";").alias("scores"))


def combined_directions(spark: SparkSession, d: str) -> DataFrame:
    made = dashboard.combined_direction(F.col("p_name"), [("DBLP关键词：", F.col("p_type")), ("", F.col("p_name")), ("arXiv关键词：", F.when(F.col("p_size") > 25, F.col("p_brand")))], 40)
    return table(spark, d, "part").select("p_partkey", made.alias("direction"))


def display_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(0.5)).alias("share"))
    return sinks.clean_columns(rows)


def restored_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("string")).otherwise("x").alias(sinks.SEARCH_COUNT), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("web_search_urls"))
    return sinks.restored_search(rows)


def json_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(1.5)).alias("share"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_nationkey")).alias("nation"))
    return sinks.as_json(rows)


def json_texts(spark: SparkSession, d: str) -> DataFrame:
    """Values that may be a text, an object, a list or nothing."""
    name = F.col("p_name")
    made = _when(
        (F.col("p_partkey") % 5 == 0, F.concat(F.lit('"'), name, F.lit('"'))), (F.col("p_partkey") % 5 == 1, F.concat(F.lit('{"title":"","name":"'), name, F.lit('"}'))),
        (F.col("p_partkey") % 5 == 2, F.concat(F.lit('{"other":"'), name, F.lit('"}'))), (F.col("p_partkey") % 5 == 3, F.concat(F.lit('["'), name, F.lit('","b"]'))), other=F.lit(None).cast("string"),
    )
    return table(spark, d, "part").select("p_partkey", candidates.text_of(made).alias("text"), F.size(candidates.as_list(made)).alias("n_list"), candidates.notes_text(F.when(F.col("p_partkey") % 5 == 3, made)).alias("notes"))


PAGE = extractor.Extractor(fields={"title": "h1", "ad": "div.ad", "first_link": "nav li a@href"})


def directory_people(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of the pages' navigation, and pages as the detail pages of their own addresses."""
    pages = table(spark, d, "pages")
    own = pages.select(F.col("url").alias("link"), F.col("url").alias("page"), F.lit(0).cast("long").alias("place"))
    out = extractor.with_details(own, "link", pages, "url", "html", PAGE)
    return out.select("link", F.md5("title").alias("title_md5"), F.length("ad").cast("long").alias("n_ad"), "first_link", "state")


QUERIES = {
    f.__name__: f
    for f in (
        ranked_people, catalogue_gate, publication_query_gate, host_classes, accepted_results, curated_items, applied_curation, search_fallback, detail_rows,
        merged_rows, cross_target_rows, candidate_decisions, candidate_statuses, official_statuses, chosen_authors, discovered_ids, identity_seeds, affiliation_cascade,
        profile_ids, keyword_groups, section_lines, biographies, english_names, publication_sections, printed_table, team_mentions, evidence_summary, row_marks, rebuilt_rows,
        saved_evidence, stage_states, semantic_cache, changed_files, validation_metrics, validation_rows, validation_heads, prefix_statuses, merged_entries, header_summary,
        filter_choices, list_page, changed_status, signal_chips, score_breakdown, combined_directions, display_rows, restored_columns, json_rows, json_texts, directory_people,
    )
}
