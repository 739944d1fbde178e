"""The registered queries: each operator on whole tables of the test data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.functions import dates, extract, identity, text
from dossier.operators import audit, authors, contact, dashboard, dedup, evidence, ranking, rows, scoring, works
from dossier.sources import connectors
from dossier.sources.tables import parse_html, table

# The demonstration profile: names of parts play the part of research directions.
PROFILE = scoring.validate(
    scoring.Profile(
        weights=[
            ("small ring", 30), ("ring", 24), ("red widget", 26), ("widget", 20), ("bolt", 10), ("gizmo", 0),
            ("gear", 18), ("anvil", 18), ("promo", 8), ("economy", 6), ("hot", 5), ("cold", 5),
        ],
        core=["small ring", "ring", "red widget", "widget", "gear"],
        alias_groups=[["gear", "anvil"]],
        direction_groups={"rings": ["small ring", "ring"], "widgets": ["red widget", "widget"], "trade": ["promo", "economy"]},
    )
)
WORDS = ("hast", "edth", "intion", "gelich", "quetion", "que la", "of the", "und der")
SEED = "2026-07"


def _part_text() -> Column:
    return F.concat_ws(" ", "p_name", "p_type")


def keyword_match(spark: SparkSession, d: str) -> DataFrame:
    lowered = F.lower(text.norm_text(F.col("text")))
    hits = F.explode(scoring.matched_terms(lowered, WORDS))
    return table(spark, d, "documents").select("doc_id", hits.alias("keyword"))


def keyword_score(spark: SparkSession, d: str) -> DataFrame:
    s = scoring.score(_part_text(), PROFILE)
    rows = table(spark, d, "part").select("p_partkey", s.alias("s"))
    return rows.select("p_partkey", F.col("s.score").alias("score"), F.array_join("s.keywords", ";").alias("keywords"))


def _ranked_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts with official evidence from name and type, and a second source from their line items."""
    sold = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned")
    )
    parts = table(spark, d, "part").join(sold, "p_partkey", "left")
    lowered = F.lower(text.norm_text(_part_text()))
    raw = F.coalesce("n_lines", F.lit(0).cast("long"))
    confirmed = F.coalesce(F.col("n_returned") * 4 <= F.col("n_lines"), F.lit(False))
    out = parts.select(
        "p_partkey", scoring.score(_part_text(), PROFILE).alias("s"),
        (F.size(scoring.matched_terms(lowered, PROFILE.core)) > 0).alias("anchor"), raw.alias("raw"), confirmed.alias("confirmed"),
    )
    out = out.withColumns(
        {
            "official": F.least(F.col("s.score"), F.lit(ranking.OFFICIAL_CAP)),
            "publication": ranking.source_score(F.col("raw"), "publication", F.col("anchor") & F.col("confirmed")),
            "groups": scoring.direction_groups(F.col("s.keywords"), PROFILE),
        }
    )
    grouped = (F.size("groups") >= 2) | (F.col("publication") > 0)
    total = F.col("official") + F.col("publication")
    return out.withColumn("d", ranking.decide(total, F.col("anchor"), F.lit(False), grouped)).select(
        "p_partkey", "official", "publication", F.array_join("groups", ";").alias("direction_groups"), "d.*"
    )


def gated_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranking.in_order(_ranked_parts(spark, d), "p_partkey")


def priority_list(spark: SparkSession, d: str) -> DataFrame:
    return ranking.priority_list(_ranked_parts(spark, d)).select("p_partkey", "score", "level")


def level_counts(spark: SparkSession, d: str) -> DataFrame:
    return _ranked_parts(spark, d).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def direction_groups(spark: SparkSession, d: str) -> DataFrame:
    return _ranked_parts(spark, d).groupBy("direction_groups").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


def relevance_labels(spark: SparkSession, d: str) -> DataFrame:
    rules = {"english": ["of the", "that"], "german": ["und der", "nicht"], "french": ["dans", "est"], "spanish": ["que la", "por"]}
    labels = scoring.relevance_labels(F.col("text"), rules)
    return table(spark, d, "documents").select("doc_id", F.array_join(labels, ";").alias("labels"))


def search_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = (
        table(spark, d, "customer")
        .join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    )  # nation and region are of fixed size
    found = dashboard.search(rows, "Building", ["c_name", "n_name", "r_name", "c_mktsegment"], F.col("c_acctbal") > 0)
    return found.select("c_custkey", "c_name", "n_name", "r_name")


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    events = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_events"))
    rows = table(spark, d, "customer").join(orders, "c_custkey", "left").join(events, "c_custkey", "left")
    zero = F.lit(0).cast("long")
    return rows.withColumns({"n_orders": F.coalesce("n_orders", zero), "n_events": F.coalesce("n_events", zero)})


def weak_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = _evidence(spark, d)
    return rows.filter(dashboard.is_weak(F.col("n_orders"), F.col("n_events"))).select("c_custkey", "n_orders", "n_events")


def deep_query_gate(spark: SparkSession, d: str) -> DataFrame:
    wanted = evidence.wants_deep_query(
        F.when(F.col("c_acctbal") >= 8000, "是").otherwise("否"), F.col("c_custkey") % 25, F.col("n_orders") - 12,
        F.when(F.col("c_nationkey") == 7, "http://x"), F.col("c_mktsegment").rlike("(?i)build|machin"),
    )
    return _evidence(spark, d).filter(wanted).select("c_custkey", "n_orders")


def normalized_url(spark: SparkSession, d: str) -> DataFrame:
    url = identity.normalize_url(F.col("url"), ("utm_", "ref"))
    return table(spark, d, "pages").select("page_id", url.alias("url"))


def _page_basis(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit("")
    row = {"profile_url": F.col("url"), "personal_url": none, "email": none, "name": none, "title": none, "department": none, "ordinal": F.col("page_id")}
    basis = identity.identity_basis(F.lit("s"), F.lit("c"), row)
    return table(spark, d, "pages").select("page_id", basis.alias("b"))


def person_id(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("b")
    return _page_basis(spark, d).select(
        "page_id", identity.person_id(b).alias("person_id"), identity.identity_confidence(b).alias("confidence")
    )


def email_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(text.emails(F.col("text"))).alias("email"))


def _cited(spark: SparkSession, d: str) -> DataFrame:
    """Documents, each with a line behind its text: every other one a citation with year, DOI and link, the rest a career note."""
    k = F.col("doc_id")
    year = (F.lit(1990) + k % 40).cast("string")
    cited = F.concat(F.lit("A. Author, B. Other, Some long title, Journal of Things, "), year, F.lit(", doi:10.1000/x."), k.cast("string"), F.lit(" see https://a.example/p"), (k % 9).cast("string"), F.lit("，and https://a.example/p0"))
    note = F.concat(F.lit("Assistant professor since "), year, F.lit(" at the journal department"))
    return table(spark, d, "documents").withColumn("text", F.concat_ws("\n", "text", F.when(k % 2 == 0, cited).otherwise(note)))


def year_extract(spark: SparkSession, d: str) -> DataFrame:
    return _cited(spark, d).select("doc_id", F.explode(F.array_distinct(text.years(F.col("text")))).alias("year"))


def norm_text_stats(spark: SparkSession, d: str) -> DataFrame:
    clean = text.norm_text(F.col("text"))
    return table(spark, d, "documents").select(
        "doc_id", F.length(clean).cast("long").alias("n_clean"), F.md5(clean).alias("clean_md5"),
        F.length(text.normalized_name(F.col("text"))).cast("long").alias("n_name"),
    )


def html_text_length(spark: SparkSession, d: str) -> DataFrame:
    clean = text.html_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(clean).cast("long").alias("n_text"), F.md5(clean).alias("text_md5"))


def html_links(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "pages").select("page_id", F.posexplode(text.html_links(F.col("html"))).alias("place", "href"))
    return links.select("page_id", F.col("place").cast("long").alias("place"), "href")


def html_parse(spark: SparkSession, d: str) -> DataFrame:
    parsed = table(spark, d, "pages").select("page_id", parse_html(F.col("html")).alias("p"))
    return parsed.select("page_id", F.length("p.text").alias("n_text"), F.size("p.links").alias("n_links"))


def publication_gate(spark: SparkSession, d: str) -> DataFrame:
    lines = _cited(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(text.is_publication(F.col("line"))).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


def split_entries(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "documents").select("doc_id", text.split_entries(F.col("text")).alias("e"))
    return entries.select("doc_id", F.size("e").cast("long").alias("n_entries"), F.md5(F.array_join("e", "\n")).alias("entries_md5"))


LINE_KEYS = ["l_orderkey", "l_linenumber"]


def _line_order(desc: bool) -> list[Column]:
    names = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    if not desc:
        return [F.col(n) for n in names]
    return [-F.unix_micros(F.col(n).cast("timestamp")) if n == "l_shipdate" else -F.col(n) for n in names]


def dedup_keep_last(spark: SparkSession, d: str) -> DataFrame:
    return dedup.keep(table(spark, d, "lineitem"), LINE_KEYS, _line_order(True)).select(*LINE_KEYS, "l_partkey", "l_extendedprice")


def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return dedup.keep(table(spark, d, "lineitem"), LINE_KEYS, _line_order(False)).select(*LINE_KEYS, "l_partkey", "l_extendedprice")


def exact_canonical_works(spark: SparkSession, d: str) -> DataFrame:
    key = F.md5(F.regexp_replace(F.lower("text"), r"[^a-z0-9]", ""))
    measures = {"n_records": F.count(F.lit(1)), "longest": F.max("n_chars"), "n_sources": F.count_distinct("source")}
    return works.exact_works(table(spark, d, "documents"), key, F.col("doc_id"), measures)


def greedy_dedup(spark: SparkSession, d: str) -> DataFrame:
    keys = F.array(F.concat(F.lit("t:"), F.md5("text")), F.concat_ws(":", F.lit("p"), "source", "n_chars"))
    rows = table(spark, d, "documents").select("doc_id", keys.alias("keys"))
    return dedup.greedy_groups(rows, "doc_id", "keys")


def fuzzy_works(spark: SparkSession, d: str) -> DataFrame:
    """Texts play the part of titles, sources that of authors; e-mails, links and telephones that of ids."""
    first = lambda found: F.coalesce(F.get(found, F.lit(0)), F.lit(""))
    body = F.col("text")
    records = table(spark, d, "documents").select(
        F.col("doc_id").alias("record_id"), "source", first(extract.phones(body)).alias("source_id"), first(text.emails(body)).alias("doi"),
        first(extract.links(body)).alias("arxiv_id"), body.alias("title"), text.first_year(body).alias("year"), F.array("source").alias("authors"),
    )
    return works.fuzzy_works(records)


def title_overlap(spark: SparkSession, d: str) -> DataFrame:
    found = works.contained_titles(
        table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("title")), "text", "title"
    )
    return found.select("doc_id", "item_id")


def publication_summary(spark: SparkSession, d: str) -> DataFrame:
    per_year = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    rows = per_year.groupBy("o_custkey").agg(
        F.sum("n").alias("n_orders"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("k"), "n"))), lambda x: F.concat_ws(":", (-x["k"]).cast("string"), x["n"].cast("string"))), ";").alias("by_year"),
    )
    return table(spark, d, "customer").join(rows, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "n_orders", "by_year")


def best_candidate_margin(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("l_returnflag") == "R").alias("returned"), F.max(F.col("l_discount") >= 0.05).alias("cheap")
    )
    signals = {"name": F.col("n") >= 2, "orcid": F.col("cheap"), "homepage": ~F.col("returned")}
    value = authors.additive(signals, authors.SIGNALS["zbmath"], F.col("n").cast("int"))
    best = authors.best_with_margin(per, ["l_partkey"], value, [F.col("l_suppkey")])
    level = authors.catalogue_confidence("zbmath", F.col("candidate_score"), F.col("n") >= 3, F.col("n"), F.col("margin"))
    return best.select("l_partkey", "l_suppkey", "candidate_score", "margin", level.alias("confidence"))


def contact_overlay(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")

    def last(key: Column) -> DataFrame:
        return events.groupBy(key.alias("row_key")).agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("t")).select("row_key", F.col("t.event_type").alias("status"), F.col("t.value").alias("amount"))

    store = last(F.concat(F.lit("u:"), F.col("user_id").cast("string"))).unionAll(last(F.concat(F.lit("n:"), (F.col("user_id") % 20).cast("string"))))
    rows = table(spark, d, "customer").select(
        "c_custkey", F.concat(F.lit("u:"), F.col("c_custkey").cast("string")).alias("k1"), F.concat(F.lit("n:"), F.col("c_nationkey").cast("string")).alias("k2")
    )
    return contact.overlay(rows, store, "k1", "k2", ["status", "amount"]).select("c_custkey", "status", "amount")


def contact_upsert(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    store = events.filter(F.col("event_type") == "signup").groupBy("user_id").agg(F.max(F.struct("event_id", "event_type", "value")).alias("t")).select("user_id", "t.*")
    changes = events.filter(F.col("event_type") != "signup").withColumn("deleted", F.col("event_type") == "error")
    return contact.upsert(store, changes, "user_id", "event_id")


def detail_fallback_join(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), F.concat(F.lit("n"), (F.col("c_custkey") % 97).cast("string")).alias("name"))
    orders = table(spark, d, "orders")
    rows = orders.select(
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("pid"),
        F.concat(F.lit("n"), (F.col("o_orderkey") % 97).cast("string")).alias("name"), "o_orderkey",
    )
    out = dashboard.details(people, rows, "pid", "name")
    return out.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_order"))


def progress_rollup(spark: SparkSession, d: str) -> DataFrame:
    n = _evidence(spark, d).join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = n.join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return dashboard.progress(rows, ["r_name", "n_name"], F.col("n_orders") > 0, F.col("n_orders") > 10, F.col("n_events") > 0)


def calendar_28d(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.calendar(table(spark, d, "events"), [F.to_date("ts"), F.to_date(F.col("ts") + F.expr("interval 36 hours"))], "2024-01-08")


def weekly_events(spark: SparkSession, d: str) -> DataFrame:
    week = dates.week_start(F.to_date("ts"))
    offset = dates.relative_week(F.to_date("ts"), F.lit("2024-01-17").cast("date"))
    return table(spark, d, "events").groupBy(week.alias("week"), offset.alias("offset")).agg(F.count(F.lit(1)).alias("n"))


def _user_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("types"))


def response_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(_user_types(spark, d), F.col("c_custkey") == F.col("user_id"), "left")
    return dashboard.response_counts(rows, F.col("types"), "none")


def response_priority(spark: SparkSession, d: str) -> DataFrame:
    state = dashboard.first_present(F.col("types"), ["purchase", "signup", "error", "click", "view"])
    return _user_types(spark, d).select("user_id", state.alias("state"))


def _order_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("shipped"))
    return table(spark, d, "orders").join(lines, "o_orderkey", "left")


def missing_date(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.undated(_order_lines(spark, d), F.col("o_orderstatus") == "F", F.col("shipped")).select("o_orderkey")


def range_overlap(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.within(_order_lines(spark, d), [F.col("o_orderdate"), F.col("shipped")], "1998-03-01", "1998-03-28").select("o_orderkey")


def _levels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    new = F.when((F.col("n_chars") >= 200) & ~F.col("text").rlike(r"\*\*\*|\$\$\$|%%%"), "high").otherwise("low")
    return rows.select("doc_id", F.when(F.col("quality") == 1, "high").otherwise("low").alias("old"), new.alias("new"), "toxic")


def shadow_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.transitions(_levels(spark, d), F.col("old"), F.col("new"))


def audit_violations(spark: SparkSession, d: str) -> DataFrame:
    rules = {
        "promoted": (F.col("old") == "low") & (F.col("new") == "high"),
        "demoted": (F.col("old") == "high") & (F.col("new") == "low"),
        "toxic_high": (F.col("toxic") == 1) & (F.col("new") == "high"),
    }
    return audit.violations(_levels(spark, d), rules)


def duplicate_group_rows(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicated(table(spark, d, "lineitem"), LINE_KEYS).groupBy("group_size").agg(F.count(F.lit(1)).alias("n_rows"))


def _order_states(spark: SparkSession, d: str) -> DataFrame:
    def marks(status: Column) -> DataFrame:
        mark = audit.fingerprint(F.col("o_orderkey"), status, F.col("o_totalprice").cast("decimal(18,2)"))
        return table(spark, d, "orders").select("o_orderkey", mark.alias("mark"))

    changed = F.when(F.col("o_orderkey") % 10 == 3, F.lit("X")).otherwise(F.col("o_orderstatus"))
    return audit.checkpoint_state(marks(F.col("o_orderstatus")), marks(changed).filter(F.col("o_orderkey") % 7 != 2), "o_orderkey", "mark")


def checkpoint_coverage(spark: SparkSession, d: str) -> DataFrame:
    return audit.coverage(_order_states(spark, d))


def row_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return _order_states(spark, d).select("o_orderkey", "mark", "state")


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return audit.hash_sample(table(spark, d, "customer"), "c_mktsegment", "c_custkey", SEED, 5).select("c_mktsegment", "c_custkey", F.col("place").cast("long").alias("place"))


def holdout_sample(spark: SparkSession, d: str) -> DataFrame:
    first = hash_sample(spark, d).select("c_custkey")
    rest = table(spark, d, "customer").join(first, "c_custkey", "left_anti")
    return audit.hash_sample(rest, "c_mktsegment", "c_custkey", SEED + "-holdout", 3).select("c_mktsegment", "c_custkey", F.col("place").cast("long").alias("place"))


def agreement_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = F.when(F.col("n_chars") >= 2000, 2).when(F.col("n_chars") >= 200, 1).otherwise(0)
    truth = F.col("quality") + F.when(F.col("toxic") == 0, 1).otherwise(0)
    return audit.agreement(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id"), truth, found, F.col("quality") + 1)


def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return a.unionByName(b, allowMissingColumns=True)


def affiliation_flatmap(spark: SparkSession, d: str) -> DataFrame:
    rules = F.array_compact(
        F.array(
            F.when(F.col("c_acctbal") < 0, F.lit("debtor")), F.when(F.col("c_mktsegment") == "BUILDING", F.lit("builder")),
            F.when(F.col("c_nationkey") < 5, F.lit("home")),
        )
    )
    own = F.when(F.size(rules) > 0, rules).otherwise(F.array(F.lit("pending")))
    return table(spark, d, "customer").select("c_custkey", F.explode(own).alias("affiliation"))


def ordinal_renumber(spark: SparkSession, d: str) -> DataFrame:
    out = dedup.renumber(table(spark, d, "part"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")])
    return out.select("p_partkey", "p_brand", F.col("ordinal").cast("long").alias("ordinal"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.sum("k").alias("sum_k"), F.count("k").alias("n_k"))


def record_navigation(spark: SparkSession, d: str) -> DataFrame:
    ordered = [F.col("p_retailprice").desc(), F.col("p_partkey")]
    return dashboard.neighbours(table(spark, d, "part"), ["p_brand"], ordered, "p_partkey").select("p_partkey", "previous_id", "next_id")


def source_report(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("source") == "src7", "not_configured").when(F.col("doc_id") % 97 == 5, "schema_changed").when(F.col("doc_id") % 2 == 0, "no_record").otherwise("success")
    return dashboard.source_report(table(spark, d, "documents"), "source", F.col("n_chars") >= 200, status, F.col("n_chars") > 15_000)


def top_venues(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("l_suppkey").orderBy(F.col("n").desc(), "l_partkey")
    return per.withColumn("place", F.row_number().over(order)).filter("place <= 10").select("l_suppkey", "l_partkey", "n", F.col("place").cast("long").alias("place"))


def web_search_gate(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose evidence is thin: orders and events stand for counts, the balance for a score."""
    score = F.col("c_acctbal") / 100
    wanted = evidence.wants_web_search(
        F.col("c_custkey") % 11 == 0, F.when(F.col("c_acctbal") > 5000, "是").otherwise("否"), F.col("c_acctbal") < 2000, score,
        [F.col("n_orders")], F.col("n_events"), F.when(F.col("c_custkey") % 3 == 0, "http://x").otherwise(""), F.col("c_mktsegment") == "BUILDING",
    )
    return _evidence(spark, d).filter(wanted).select("c_custkey", "n_orders", "n_events")


def confidence_levels(spark: SparkSession, d: str) -> DataFrame:
    host = identity.normalize_url(F.col("url"))
    level = evidence.web_confidence(
        host.contains("example.org"), host.contains("//blog."), host.contains("//m."), F.col("page_id") % 2 == 0, F.col("page_id") % 3 == 0
    )
    return table(spark, d, "pages").select("page_id", level.alias("confidence"))


def phone_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(extract.phones(F.col("text")), "; ").alias("phones"))


def link_extract(spark: SparkSession, d: str) -> DataFrame:
    found = F.posexplode(extract.links(F.col("text"))).alias("place", "link")
    return _cited(spark, d).select("doc_id", found).select("doc_id", F.col("place").cast("long").alias("place"), "link")


def host_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", extract.host_key(F.col("url")).alias("host_key"))


def homepage_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Whether a page links to itself, in whole or to a part of it."""
    found = extract.homepage_overlap(F.array("url"), text.html_links(F.col("html")))
    return table(spark, d, "pages").select("page_id", found.alias("overlaps"))


def label_values(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.when(F.col("turn") % 3 == 0, "研究 方向：").when(F.col("turn") % 3 == 1, "E mail: a：").otherwise(""), "text")
    lines = table(spark, d, "conversations").select("conv_id", "turn", extract.label_value(marked).alias("p"))
    return lines.select("conv_id", "turn", "p.label", F.md5("p.value").alias("value_md5"))


def text_snippets(spark: SparkSession, d: str) -> DataFrame:
    found = extract.snippets(F.col("text"), [text.YEAR, "(?i)licen[sc]e"], "\n")
    return table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n_snippets"), F.md5(F.array_join(found, "\n")).alias("snippets_md5"))


def pattern_keywords(spark: SparkSession, d: str) -> DataFrame:
    found = extract.pattern_keywords(F.col("text"), ["(?i)licen[sc]e", "(?i)copyright"])
    return table(spark, d, "documents").select("doc_id", found.alias("keywords"))


def search_phrases(spark: SparkSession, d: str) -> DataFrame:
    templates = ['"{name}" "{school}" {keywords}', "{name} homepage"]
    made = extract.search_phrases(F.col("p_name"), F.col("p_brand"), F.replace("p_type", F.lit(" "), F.lit(";")), "paper", templates)
    return table(spark, d, "part").select("p_partkey", F.array_join(made, "|").alias("phrases"))


def work_summary(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "orders").select(
        "o_custkey", "o_orderkey", F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("venue"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("title"), F.floor(F.col("o_totalprice") / 50000).alias("s"),
    )
    return rows.summary(made, "o_custkey", "y", "venue", "title", "s", "o_orderkey")


def cached_lookup(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), F.col("ts").alias("fetched_at"), "event_id", "event_type")
    found = connectors.cached(
        table(spark, d, "customer").select("c_custkey"), cache, "c_custkey", F.lit("2024-01-25").cast("timestamp"), 14, F.col("event_type") != "error"
    )
    return found.select("c_custkey", "hit", "event_id")


def kept_columns(spark: SparkSession, d: str) -> DataFrame:
    previous = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    now = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return rows.keep_previous(now, previous, "c_custkey", ["c_acctbal"], F.col("c_custkey") % 3 == 0)


def null_tolerant_override(spark: SparkSession, d: str) -> DataFrame:
    """Overrides of nations by name, by segment, or by both."""
    people = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("nation"), F.lit("").alias("segment"), F.concat(F.lit("n:"), "n_name").alias("v"), F.col("n_nationkey").alias("k"))
    both = nations.filter("k % 5 = 1").withColumns({"segment": F.lit("BUILDING"), "v": F.concat(F.lit("both:"), "v")})
    segment = nations.filter("k = 2").withColumns({"nation": F.lit(""), "segment": F.lit("MACHINERY"), "v": F.lit("s:machines")})
    dim = nations.filter("k % 5 = 2").unionByName(both).unionByName(segment).drop("k")
    return rows.override(people, dim, ["nation", "segment"], "v", "affiliation").select("c_custkey", "affiliation")


def link_crawl(spark: SparkSession, d: str) -> DataFrame:
    """A tree of customers, followed from its root."""
    key = F.col("c_custkey")
    edges = table(spark, d, "customer").select(F.floor(key / 10).alias("src"), key.alias("dst"))
    found = connectors.follow_links(edges, spark.range(1, 2).select(F.col("id").alias("node")))
    return found.select("node", F.col("depth").cast("long").alias("depth"))


def local_order(spark: SparkSession, d: str) -> DataFrame:
    """Places of nations by name within their region where case decides nothing, every other name in lower case."""
    name = F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name"))
    order = Window.partitionBy("n_regionkey").orderBy(F.collate(name, "UNICODE_CI"), "n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", F.row_number().over(order).cast("long").alias("place"))


def cited_works(spark: SparkSession, d: str) -> DataFrame:
    found = works.official_works(_cited(spark, d), "doc_id", "text")
    return found.select("doc_id", F.col("entry_no").cast("long").alias("entry_no"), "year", "doi")


def title_overlap_counts(spark: SparkSession, d: str) -> DataFrame:
    own = F.array(F.concat_ws(" ", "p_name", "p_type", "p_brand"), F.concat_ws(" ", "p_type", "p_name"), F.lit("short one"))
    other = F.array(F.concat_ws(" ", "p_name", F.when(F.col("p_size") > 20, F.col("p_type")), F.when(F.col("p_size") > 30, F.col("p_brand"))), F.lit("short one"))
    return table(spark, d, "part").select("p_partkey", works.title_overlap(own, other).alias("n"))


def directory_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", identity.dedup_url(F.concat("url", F.when(F.col("page_id") % 2 == 0, "/").otherwise(""))).alias("url"))


def evidence_rules(spark: SparkSession, d: str) -> DataFrame:
    """The decision tables of evidence over all combinations that an order's key makes."""
    k = F.col("o_orderkey")
    pick = lambda values, by: F.array(*[F.lit(v) for v in values]).getItem((by % len(values)).cast("int"))
    status = pick(("identity_confirmed", "success", "terms_required", "no_record", "identity_probable", "other"), k)
    confidence, source = pick(("high", "medium", "low"), F.floor(k / 6)), pick(("official", "zbmath"), F.floor(k / 18))
    decision = pick(("review", "rejected", "unresolved", "confirmed"), k)
    lead = F.when(k % 4 > 0, (k % 40).cast("int"))
    return table(spark, d, "orders").select(
        "o_orderkey", evidence.works_wanted(status, confidence).alias("wanted"), evidence.works_accepted(status, source, confidence).alias("accepted"), evidence.source_health(status).alias("health"),
        evidence.arxiv_confidence(k % 7 == 0, k % 2 == 0, k % 3 == 0, k % 5 == 0).alias("arxiv"), evidence.needs_review(k % 3, decision, k % 2 == 0, k % 11).alias("review"),
        authors.dblp_confidence(k % 11 == 0, k % 13 == 0, k % 2 == 0, k % 3 == 0, k % 5 == 0, lead).alias("dblp"),
        dates.in_years(F.year("o_orderdate"), 2000, 3).alias("recent"), identity.record_key(F.lit("s"), F.lit("c"), k.cast("string")).alias("record_key"),
        text.has_cjk(F.when(k % 2 == 0, "王")).alias("cjk"), F.hex(text.strip_control(F.concat(F.lit("a\x01"), "o_orderstatus", F.lit("\t\x1f")))).alias("clean"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        keyword_match, keyword_score, gated_ranking, priority_list, level_counts, direction_groups, relevance_labels,
        search_filter, weak_evidence, deep_query_gate, normalized_url, person_id, email_extract, year_extract,
        norm_text_stats, html_text_length, html_links, html_parse, publication_gate, split_entries, dedup_keep_last,
        dedup_keep_first, exact_canonical_works, greedy_dedup, fuzzy_works, title_overlap, publication_summary,
        best_candidate_margin, contact_overlay, contact_upsert, detail_fallback_join, progress_rollup, calendar_28d,
        weekly_events, response_counts, response_priority, missing_date, range_overlap, shadow_audit, audit_violations,
        duplicate_group_rows, checkpoint_coverage, row_fingerprints, hash_sample, holdout_sample, agreement_metrics,
        union_by_name, affiliation_flatmap, ordinal_renumber, json_props, record_navigation, source_report, top_venues, web_search_gate, confidence_levels,
        phone_extract, link_extract, host_keys, homepage_overlap, label_values, text_snippets, pattern_keywords,
        search_phrases, work_summary, cached_lookup, kept_columns, null_tolerant_override, link_crawl, local_order,
        cited_works, title_overlap_counts, directory_urls, evidence_rules,
    )
}
