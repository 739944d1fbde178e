"""Picks, stores, author verification and what follows from them: sequential rules and odd rows."""

import datetime
import hashlib
import json
import random
import re
import urllib.parse

import pytest
from pyspark.sql import functions as F

from dossier.functions import homepages
from dossier.operators import candidates, contact, dashboard, findings, manifest, merging, picking, placement, ranking, restoring, scoring, sections, sheets, stores, unions, verification
from dossier.operators.works import contained_titles
from dossier.sources import paging, sinks

RULES = {"a": "n % 2 = 0", "a_again": "n % 2 = 0", "b": "n % 3 = 0", "c": "n % 5 = 0 AND n % 2 = 1", "any": "true"}


def slow_pick(rows, tests, seed, limits, exclude=()):
    """rows: (key, school, target, n); limits: (position, most, soft)."""
    out = []
    for name, test in tests.items():
        own = sorted((r for r in rows if r[0] is not None and test(r[3]) and r[0] not in exclude), key=lambda r: hashlib.sha256(f"{seed}|{r[0]}".encode()).hexdigest())
        own = [r for r in own if r[0] not in {p[1][0] for p in out}]
        for soft in (True, False):
            keep = [v for v in limits if soft or not v[2]]
            found = next((r for r in own if all(sum(p[1][at] == r[at] for p in out) < most for at, most, _ in keep)), None)
            if found:
                break
        if not found:
            raise ValueError(name)
        out.append((name, found))
    return out


@pytest.mark.parametrize("head", [1, 3, 64])
def test_pick_like_the_sequential_rule(spark, head):
    """Whatever the head, also where one school holds most rows and the targets run out."""
    tests = {"a": lambda n: n % 2 == 0, "a_again": lambda n: n % 2 == 0, "b": lambda n: n % 3 == 0, "c": lambda n: n % 5 == 0 and n % 2 == 1, "any": lambda n: True}
    for seed in range(4):
        rng = random.Random(seed)
        rows = [(k, rng.choice(["hot"] * 6 + ["x", "y", None]), rng.choice(["t"] * 4 + ["u", "v"]), rng.randrange(100)) for k in range(120)] + [(None, "z", "w", 0)]
        df = spark.createDataFrame(rows, "id long, school string, target string, n int")
        limits = [picking.Limit("school", 2), picking.Limit("target", 1, soft=True)]
        got = picking.pick(df, {k: F.expr(v) for k, v in RULES.items()}, "id", str(seed), limits, exclude=[3, 4], head=head).collect()
        want = slow_pick(rows, tests, seed, [(1, 2, False), (2, 1, True)], (3, 4))
        assert [(r.category, (r.id, r.school, r.target)) for r in got] == [(name, r[:3]) for name, r in want]
        assert [r.sample_id for r in got] == [f"sample_{i:02d}" for i in range(1, 6)]
    with pytest.raises(ValueError, match="category late"):
        picking.pick(df, {"any": F.lit(True), "late": F.col("school") == "z"}, "id", "s", [picking.Limit("school", 1)], head=head)
    with pytest.raises(ValueError, match="category a"):
        picking.pick(df.limit(0), {"a": F.lit(True)}, "id", "s", head=head)


def normal(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("status", F.lit("kept out"))
    return sorted(tuple(r) for r in stores.normal_stores(df, ["id"], "t", **more).collect())


def test_stores_of_any_shape(spark):
    texts = [
        '{"version":3,"updatedAt":" x ","statuses":{"a":"已套磁","b":{"status":"","contactStatus":"不考虑","responses":["已发"," own ","已发",""],"note":"n"},"c":"bogus","e":5,"f":["x"]}}',
        '{"version":"7","records":{" k  1 ":{"status":0,"套磁情况":"不可能","name":" N  N "},"k 1":{"status":"不匹配"}},"statuses":{}}',
        '{"version":5.7,"statuses":{"q":{"status":false,"note":null,"contact_note":"m","套磁备注":"m","回复情况":"官回,其他；其他"}}}',
        '{"version":"old","statuses":{"z":{"interviewAt":"2026-02-30 10:00","date":20240101}}}',
        "[1]", '"x"', "null", None, "{}", '{"statuses":[1]}', '{"statuses":{"k":{}}}',
    ]
    rest = ("", "", "", "", "")
    assert normal(spark, texts) == [
        (0, 4, "x", "a", "已套磁", "", [], "", "", *rest), (0, 4, "x", "b", "先不考虑", "", ["已发"], "", "n；own", *rest), (1, 7, "", "k 1", "不匹配", "", [], "", "", *rest),
        (2, 5, "", "q", "", "", ["官回"], "", "m；其他", *rest), (3, 4, "", "z", "", "20240101", [], "", "", *rest),
    ]
    assert normal(spark, []) == []


def test_stores_that_do_not_parse(spark):
    texts = ['{"statuses":{"a":"已套磁"}}', '{"statuses":{"a":']
    with pytest.raises(Exception, match="(?i)malformed|json"):
        normal(spark, texts)
    assert [r[:5] for r in normal(spark, texts, strict=False)] == [(0, 4, "", "a", "已套磁")]
    large = '{"statuses":{%s}}' % ",".join(f'"k{i}":{{"note":"{"n" * 100}"}}' for i in range(5_000))
    assert len(normal(spark, [large, large])) == 10_000


PEOPLE = "p long, name string, query_keys array<string>, homepages array<string>"
FOUND = "p long, author_id string, author_key string, affiliation string, direct boolean, place int"


def test_authors_are_verified_by_their_pages(spark):
    people = [(1, "n1", ["ann"], ["http://www.a.edu/~ann/"]), (2, "n2", ["bob"], None), (3, "n3", ["cy"], ["http://c.org"]), (4, "n4", [], ["x"]), (5, "n5", ["eve"], []), (6, "both", ["f"], None), (7, "named", ["g"], None),
              (8, "n8", ["hal"], ["ftp://h"]), (None, "nobody", ["i"], None)]
    found = [
        (1, "w", "ann", "", False, 0), (1, "x", "ann", "", False, 1), (1, "y", "ann", "shanghai", False, 2), (1, "far", "annette", "shanghai", False, 3),  # x's page is ann's
        (2, "x", "bob", "fudan", False, 0), (2, "y", "bobby", "fudan", False, 1),  # a lead of 40
        (3, "certain", "cy", "fudan", False, 0), (3, "x", "cy", "fudan", False, 1), (3, "z", "cy", "", None, 2),  # best is certain, so no page is looked up; no lead
        (4, "x", "d", "", True, 0), (6, "x", "f", "", True, 0), (7, "x", "g", "", False, 0),
        (8, "lone", "hal9", "Shanghai FUDAN", False, 0), (8, "lone", "hal9", "", False, 1), (9, "x", "j", "", True, 0), (None, "x", "i", "", True, 0),
    ]
    pages = spark.createDataFrame([("x", [None, "", "https://A.edu/~ann/cv"]), ("w", ["http://b.edu"]), ("z", None)], "author_id string, urls array<string>")
    overrides = spark.createDataFrame([(6, None, "own"), (None, "both", "shared"), (None, "named", "shared"), (None, None, "none")], "p long, name string, author_id string")
    got = verification.identified(spark.createDataFrame(people, PEOPLE), spark.createDataFrame(found, FOUND), pages, "p", ("fudan",), ("shanghai",), overrides)
    assert got.columns == ["p", "author_id", "score", "margin", "confidence", "status"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([
        (1, "x", 165, 75, "高", "已匹配-高"), (2, "x", 155, 40, "高", "已匹配-高"), (3, None, 155, 0, None, "歧义/未采用"), (4, None, None, None, None, "未匹配"), (5, None, None, None, None, "未匹配"),
        (6, "own", 200, None, "高", "已匹配-高"), (7, "shared", 90, None, "中", "已匹配-中"), (8, "lone", 115, 115, "低", "已匹配-低"), (None, None, None, None, None, "未匹配"),
    ], key=repr)
    empty = verification.identified(spark.createDataFrame([], PEOPLE), spark.createDataFrame([], FOUND), pages, "p")
    assert empty.count() == 0


def test_keys_of_pages(spark):
    urls = [None, "", "x", "http://www.A.org/B/", "https://a.org/b?q#f", "http://a.org", "http://a.org/bc;p"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(verification.domain_key(F.col("u")).alias("k"))
    assert [r.k for r in df.collect()] == ["", "", "", "a.org/b", "a.org/b", "a.org", "a.org/bc"]


def scripted(answers):
    """A client over a list of answers; errors are raised.  Gives it with the waits and the requests it made."""
    waits, asked, left = [], [], list(answers)

    def fetch(url, params):
        asked.append((url, dict(params)))
        answer = left.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    now = lambda: datetime.datetime(2026, 1, 1, 0, 0, 10, tzinfo=datetime.UTC)
    return paging.Client(fetch, sleep=waits.append, now=now), waits, asked


OK = paging.Response(200, '{"results": []}', "application/json")


@pytest.mark.parametrize(
    ("answers", "waits"),
    [
        ([OK], []), ([ConnectionError("x"), OK], [1]), ([ConnectionError("x"), TimeoutError("y"), OK], [1, 2]), ([paging.Response(503), paging.Response(500), OK], [1, 2]),
        ([paging.Response(429, retry_after="7"), OK], [7]), ([paging.Response(429, retry_after="900"), OK], [30]), ([paging.Response(429, retry_after="-5"), OK], [0]),
        ([paging.Response(429, retry_after="soon"), OK], [1]), ([paging.Response(429, retry_after="nan"), OK], [1]),
        ([paging.Response(503, retry_after="Thu, 01 Jan 2026 00:00:15 GMT"), OK], [5]),
        ([paging.Response(503, retry_after="Thu, 01 Jan 2026 00:00:15 GMT", date="Thu, 01 Jan 2026 00:00:03 GMT"), OK], [12]),
    ],
)
def test_client_tries_again(answers, waits):
    client, waited, asked = scripted(answers)
    assert client.get("u", {"a": 1}, ("results",)) == {"results": []} and waited == waits and len(asked) == len(answers)


@pytest.mark.parametrize(
    ("answers", "kind", "status"),
    [
        ([paging.Response(503)] * 3, "request_failed", 503), ([OSError("down")] * 3, "request_failed", None), ([paging.Response(404)], "request_failed", 404),
        ([paging.Response(200, " <!DOCTYPE html> please Accept the Terms")], "terms_required", 200), ([paging.Response(403, "<p>Terms of Use", "text/html")], "terms_required", 403),
        ([paging.Response(200, "<html>")], "schema_changed", 200), ([paging.Response(200, "{")], "schema_changed", 200), ([paging.Response(200, "[1]")], "schema_changed", 200),
        ([paging.Response(200, '{"other": 1}')], "schema_changed", 200),
    ],
)
def test_client_tells_errors_apart(answers, kind, status):
    client, waited, _ = scripted(answers)
    with pytest.raises(paging.SourceError) as error:
        client.get("u", {}, ("results",))
    assert (error.value.kind, error.value.status) == (kind, status) and len(waited) == len(answers) - 1


def answer(url, params):
    """A source in which person n has n pages of two items; it is busy at first, and fails for some."""
    person, page = int(url), 0 if params["cursor"] == "*" else int(params["cursor"][1:])
    if person == 7:
        return paging.Response(500)
    if person == 8 and page == 1:
        return paging.Response(200, "<html>moved")
    items = [{"id": f"w{person}.{page}", "display_name": f"title {page % 2}"}, {"display_name": " Title  x ", "n": page}] if page < person else []
    return paging.Response(200, json.dumps({"results": items, "meta": {"next_cursor": f"c{page + 1}" if page + 1 < person else None}}))


def test_pages_are_followed_and_errors_are_rows(spark):
    people = spark.createDataFrame([(n,) for n in (0, 1, 3, 4, 7, 8, None)], "p long")
    pages = paging.collect(people, "p", lambda p: (str(p), {}), lambda: paging.Client(answer, sleep=lambda s: None))
    assert pages.columns == ["p", "place", "cursor", "next", "items", "state", "message"]
    found = paging.works(pages, "p", "id string, display_name string, n int", F.col("display_name"), F.col("id"))
    told = {r.p: tuple(r)[1:] for r in paging.reading(pages, found, "p").collect()}
    assert told == {
        0: (1, 0, 0, False, "ok"), 1: (1, 2, 2, False, "ok"), 3: (3, 6, 4, False, "ok"), 4: (3, 6, 4, True, "ok"), 7: (0, 0, 0, False, "request_failed"), 8: (1, 2, 2, False, "schema_changed"),
    }
    assert {(r.p, r.n, r.place) for r in found.filter("id IS NULL").collect()} == {(1, 0, 0), (3, 2, 2), (4, 2, 2), (8, 0, 0)}
    stored = pages.filter("state = 'ok'").select("p", "cursor", "next", "items")
    again = paging.walk(people.unionAll(people), stored, "p")
    same = lambda df: sorted(map(tuple, df.filter("state = 'ok'").collect()))
    assert same(again.filter("p <> 8")) == same(pages.filter("p <> 8"))
    assert paging.walk(people.limit(0), stored, "p").count() == 0


def test_field_filter(spark):
    df = spark.createDataFrame([("Professor",), (" Dean ",), (None,), ("",)], "t string")
    keep = lambda **k: [r.ok for r in df.select(paging.allowed(F.col("t"), **k).alias("ok")).collect()]
    assert keep(only=["Professor", "Dean"], never=["Dean"]) == [True, False, False, False] and keep(never=["Dean"]) == [True, False, True, True]


def test_addresses_are_resolved_as_by_the_library(spark):
    bases = ["http://a.org", "http://A.org/", "https://a.org/b/c", "https://a.org/b/c/?q=1#f", "http://a.org/x.html?u"]
    hrefs = ["", "p", "p/q.html?r#s", "/p", "/", "//h.org/p", "../p", "../../../p", "./p/./q/..", "..", ".", "?q", "#f", "mailto:x@y", "http://b.org/../c", "p//q", "javascript:;", "/p/../q/"]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    for r in df.withColumn("got", homepages.resolve(F.col("b"), F.col("h"))).collect():
        assert r.got == urllib.parse.urljoin(r.b, r.h), (r.b, r.h)


def links_of(spark, links, base, way):
    df = spark.createDataFrame([(base, links)], "u string, l array<struct<href:string,text:string>>")
    return df.select(way(F.col("l"), F.col("u")).alias("o")).first().o


def test_homepages_of_a_page(spark):
    base = "http://cs.x.edu/teacher/ann.htm"
    links = [("a.htm", "news"), (None, "x"), ("http://WWW.zju.edu.cn/ann", "个人主页"), ("https://ann.github.io/；", "code"), ("http://cs.x.edu/teacher/ann.htm/", "主页"), ("/~ann#:~:text=x", "Homepage"), ("http://dblp.org/ann", "lab"), ("http://m.org", None)]
    assert links_of(spark, links, base, homepages.clean_homepages) == ["https://ann.github.io/"]
    assert links_of(spark, [*links, ("/~ann)", " Home  page of Ann")], base, homepages.clean_homepages) == ["http://cs.x.edu/~ann"]
    assert links_of(spark, links, base, homepages.outside_links) == ["http://WWW.zju.edu.cn/ann", "https://ann.github.io/；", "http://cs.x.edu/teacher/ann.htm/", "http://cs.x.edu/~ann#:~:text=x", "http://dblp.org/ann", "http://m.org"]
    assert links_of(spark, links, base, homepages.section_homepages) == ["https://ann.github.io/；", "http://cs.x.edu/teacher/ann.htm/", "http://cs.x.edu/~ann#:~:text=x", "http://m.org"]
    assert links_of(spark, links, base, homepages.one_homepage) == "http://WWW.zju.edu.cn/ann" and links_of(spark, links[6:], base, homepages.one_homepage) == "http://dblp.org/ann"
    found = F.array(F.lit("http://k.org/1"), F.lit("http://doi.org/1"), F.lit("http://m.org"))
    assert links_of(spark, links[7:], base, lambda v, u: homepages.section_homepages(v, u, found)) == ["http://m.org", "http://k.org/1"]
    for way in (homepages.clean_homepages, homepages.outside_links, homepages.section_homepages):
        assert links_of(spark, [], base, way) == [] and links_of(spark, [(None, None)], base, way) == []
    assert links_of(spark, [], base, homepages.one_homepage) == ""


RECORD = (
    "record_id long, source string, source_id string, doi string, arxiv_id string, title string, year int, venue string, publication_date string, url string, is_preprint boolean, "
    "authors array<string>, classifications array<string>, topics array<string>"
)


def slow_merge(rows):
    texts = lambda v: " ".join((v or "").split())
    rank = {"official": 4, "openalex": 3, "zbmath": 2, "arxiv": 1}
    rows = sorted(rows, key=lambda r: r[0])
    rows.sort(key=lambda r: (bool(r[3]), not r[10], rank.get(r[1], 0), len(texts(r[5]))), reverse=True)

    def union(values):
        seen = {}
        for v in map(texts, values):
            if v:
                seen.setdefault(v.lower(), v)
        return list(seen.values())

    first = lambda k: next((texts(r[k]) for r in rows if texts(r[k])), "")
    ids = union(f"{r[1]}:{r[2]}" for r in rows if r[2])
    name = f"doi:{first(3)}" if first(3) else f"arxiv:{first(4)}" if first(4) else ids[0] if ids else "title:" + re.sub("[^a-z0-9]", "", texts(rows[0][5]).lower())
    lists = [union(v for r in rows for v in r[k] or ()) for k in (11, 12, 13)]
    return (name, texts(rows[0][5]), max((r[6] for r in rows if r[6]), default=None), *map(first, (3, 4, 7, 8, 9)), all(r[10] for r in rows), len(rows), union(r[1] for r in rows), ids, *lists)


def test_works_are_merged_in_order(spark):
    rng = random.Random(6)
    some = lambda *v: rng.choice(v)
    words = lambda: some(None, [], [some("Ann Lee", "ANN LEE", " ann  lee", "Bo", "Çi", None, "") for _ in range(rng.randrange(6))])
    rows = [
        (i, some("official", "openalex", "zbmath", "arxiv", "else"), some(None, "", "s1", "s2"), some("", "", None, "10.1/a", "10.1/b"), some(None, "", "2401.1"), some(None, " ", "On it", "On  it more", "on IT"),
         some(None, 2020, 2024), some(None, "V"), some("", "2024-01"), some(None, "u1", "u2"), some(True, False), words(), words(), words())
        for i in range(300)
    ]
    groups = [(i, i % 40 if i % 3 else -1) for i in range(290)]  # one group holds a third of all
    got = unions.merged_works(spark.createDataFrame(rows, RECORD).repartition(7), spark.createDataFrame(groups, "record_id long, work_id long"))
    own = {w: [r for r in rows if (r[0], w) in groups and (r[5] or "").strip()] for w in {g for _, g in groups}}
    assert {r.work_id: tuple(r)[1:] for r in got.collect()} == {w: slow_merge(v) for w, v in own.items() if v}
    assert unions.merged_works(spark.createDataFrame([], RECORD), spark.createDataFrame([], "record_id long, work_id long")).count() == 0


def test_mentions_without_texts_in_the_join(spark):
    docs = [(1, "王小明和李明教授"), (2, "李明"), (3, None), (4, "x李明y老师 欧阳小明"), (5, "张" * 30_000 + "李明教授"), (6, "王小明"), (7, "王小明"), (8, "王小明"), (8, "王小明"), (None, "王小明")]
    names = spark.createDataFrame([("王小明",), ("李明",), ("小明",), ("欧阳小明",), ("李明",), ("Ann",), (None,), ("张" * 9,), ("张" * 8,)], "name string")
    df = spark.createDataFrame(docs, "id long, t string").withColumn("name", F.lit("x")).withColumn("gram", F.lit("x"))
    found = sections.mentions(df, "id", F.col("t"), names, "name")
    assert sorted((r.name, r.id, r.place) for r in found.filter("id IS NOT NULL").collect()) == sorted(
        [("王小明", 1, 2), ("王小明", 6, 3), ("李明", 1, 1), ("李明", 4, 2), ("欧阳小明", 4, 1), ("张" * 8, 5, 1), ("小明", 1, 1), ("小明", 4, 2)]
    )
    assert ("王小明", None, 1) in {(r.name, r.id, r.place) for r in found.collect()}
    assert sections.mentions(df.limit(0), "id", F.col("t"), names, "name").count() == 0 and sections.mentions(df, "id", F.col("t"), names.limit(0), "name").count() == 0
    people = spark.createDataFrame([("王小明", 1), ("none", 2), (None, 3)], "who string, k int")
    entries = spark.createDataFrame([("王小明", "b", 2), ("王小明", "a", 9), (None, "c", 1)], "name string, title string, n int")
    titles = spark.createDataFrame([(1, "T1"), (6, "T1"), (7, "T7"), (8, "T8")], "id long, title string")
    every = spark.createDataFrame([("王小明", i) for i in (1, 6, 7, 8)], "name string, id long")
    out = sections.person_materials(people, "who", entries, every, titles, "id")
    assert sorted(((r.k, r.entry and tuple(r.entry), r.evidence) for r in out.collect())) == [(1, ("a", 9), ["T1", "T7"]), (2, None, []), (3, None, [])]


PROFILE = scoring.validate(scoring.Profile(weights=[("robot", 24), ("vision", 20)], core=["robot", "vision"], alias_groups=[], direction_groups={}))


def test_restored_rows_are_ranked_again(spark):
    columns = "k long, direction string, web_search_keywords string, web_search_status string, extra_ int"
    rows = spark.createDataFrame([(1, "robot", None, None, 7), (2, "robot", None, "auto", 7), (3, "robot", "old", None, 7), (4, "poetry", None, None, 7), (None, "robot", None, None, 7)], columns)
    before = spark.createDataFrame([(1, "人工确认-a", "高", "vision"), (2, "auto", "", ""), (4, "人工确认-a", "高", "vision"), (9, "人工确认", "高", "robot"), (None, "人工确认", "高", "robot")], "k long, `WebSearch状态` string, `WebSearch置信度` string, `WebSearch关键词` string")
    ranked = ranking.rank(rows, PROFILE)
    out = restoring.rank_restored(ranked, restoring.from_sheet(before), "k", PROFILE)
    got = {r.k: (r.found, r.changed, r.web_search_keywords, r.web_search_evidence, r.score_web_search > 0, r.score, r.extra_) for r in out.collect()}
    assert got == {
        1: (True, True, "vision", "", True, 27, 7), 2: (True, False, "", "", False, 24, 7), 3: (False, False, "old", "", False, 24, 7), 4: (True, True, "vision", "", False, 0, 7), None: (False, False, None, "", False, 24, 7),
    }
    whole = ranking.rank(restoring.restored(rows, restoring.from_sheet(before), "k"), PROFILE)
    assert {(r.k, r.score, r.level) for r in whole.collect()} == {(r.k, r.score, r.level) for r in out.collect()}
    assert restoring.rank_restored(ranked.limit(0), restoring.from_sheet(before), "k", PROFILE).count() == 0


def test_sheets_and_tables_rank_alike(spark):
    table = spark.createDataFrame([(1, "robot", "高", "vision", "x", "人工确认-b", "中", "robot"), (2, "", "低", "vision", None, None, None, None)], "k long, direction string, dblp_confidence string, dblp_keywords string, arxiv_keywords string, web_search_status string, web_search_confidence string, web_search_keywords string")
    sheet = restoring.to_sheet(table)
    assert "DBLP匹配置信度" in sheet.columns and not set(restoring.SHEET.values()) & set(sheet.columns)
    of = lambda df: [(r.k, r.score, r.level, r.reasons, r.warnings) for r in df.orderBy("k").collect()]
    assert of(restoring.rank_sheet(sheet, PROFILE)) == of(ranking.rank(table, PROFILE))
    both = table.withColumn("研究方向", F.when(F.col("k") == 2, "robot").otherwise(" "))
    assert [r.direction for r in restoring.from_sheet(both).orderBy("k").collect()] == ["robot", "robot"]


def test_first_wins_and_details(spark):
    rows = spark.createDataFrame([("a", "x", 2), ("a", "z", 1), ("a", "y", 1), ("b", None, 0), (None, "q", 0), ("b", "w", None)], "k string, v string, o int")
    assert sorted(map(tuple, restoring.first_wins(rows, "k", "v", [F.col("o")]).collect())) == [("a", "y"), ("b", "w")]
    people = spark.createDataFrame([(1, " i1", "ann", "u"), (2, "i9", "ann", "u"), (3, None, "ann", None), (4, "", "", ""), (5, "i1", "else", "v")], "p int, i string, n string, u string")
    details = spark.createDataFrame([(10, "i1", "other", "w"), (11, "", "ann", "u "), (12, None, " ann", "w"), (13, "", "ann", None), (14, "", "", "q"), (15, "i7", "ann", "u"), (11, "", "ann", "u ")], "r int, i string, n string, u string")
    got = restoring.person_details(people, details, "i", "n", "u")
    assert got.columns == ["p", "i", "n", "u", "detail_r", "detail_i", "detail_n", "detail_u"]
    assert sorted((r.p, r.detail_r) for r in got.collect()) == [(1, 10), (2, 11), (2, 11), (2, 13), (3, 11), (3, 11), (3, 12), (3, 13), (4, 14), (5, 10)]
    assert restoring.person_details(people.limit(0), details, "i", "n", "u").count() == 0


def test_places_of_people(spark):
    joint = placement.Joint("东南大学", {"cse": "计算机科学与工程学院", "software": "软件学院"}, "cse", ("计算机科学系",), ("计算机学院",), "软件与智能学院", ("software",))
    said = ["计算机科学系", None, None, None, None, None]
    profile = ["软件学院 教授", "毕业于软件学院，学位后任教授", None, "软件与智能学院", "东南大学软件学院与计算机学院 讲师", "x" * 500 + "招收" + "y" * 100 + "软件学院"]
    rows = [(i, "ann" if i < 3 else f"n{i}", f"http://a.org/{i}/", d, p) for i, (d, p) in enumerate(zip(said, profile, strict=True))] + [(None, None, None, None, None)]
    people = spark.createDataFrame(rows, "id int, name string, url string, department string, profile string").withColumn("status", F.lit("x"))
    hand = [(1, "ann", None, ["software", "none"], None, "e1", ["s"]), (2, "ann", "http://A.org/1", ["software"], "sure", None, None), (3, None, "http://a.org/3", ["cse"], " ", "e3", ["a", "b"]), (4, "bo", "http://a.org/4", ["cse"], "", "", []), (5, None, None, ["cse"], "", "", [])]
    overrides = spark.createDataFrame(hand, "seq int, name string, url string, targets array<string>, status string, evidence string, sources array<string>")
    got = {(r.id, r.target): (r.status, r.step, len(r.evidence), r.source) for r in placement.placed(people, "id", joint, overrides).collect()}
    page = "http://a.org/{}/".format
    assert got == {
        (0, "cse"): ("官方确认", 0, 6, page(0)), (0, "software"): ("人工确认", 5, 2, "s"), (1, "software"): ("sure", 5, 0, ""), (2, "software"): ("人工确认", 5, 2, "s"),
        (3, "software"): ("官方确认", 4, 7, page(3)), (3, "cse"): ("人工确认", 5, 2, "a; b"), (4, "software"): ("官方确认", 3, 17, page(4)), (5, "software"): ("官方确认", 1, 104, page(5)), (None, "cse"): ("待复核", 6, 0, ""),
    }
    alone = {(r.id, r.target, r.step) for r in placement.placed(people, "id", joint).collect()}
    assert alone == {(0, "cse", 0), (0, "software", 2), (1, "cse", 6), (2, "cse", 6), (3, "software", 4), (4, "software", 3), (5, "software", 1), (None, "cse", 6)}
    assert placement.placed(people.limit(0), "id", joint, overrides).count() == 0


def test_statuses_are_synced_into_tables(spark, tmp_path):
    schema = "k string, `姓名` string, `套磁备注` string, `套磁情况` string, `回复情况` string, `约面试时间` string"
    rows = [("a", "n", "old", "不考虑", "官回、else", "2026-01-02 03:04"), ("b", "n", None, "bogus", None, "x"), ("c", "n", " ", "已套磁", "else；else", None), (None, "n", None, None, None, None)]
    store = spark.createDataFrame([("a", "不可能", "", [], "", ""), ("B", "", "2026", ["已发", "官回"], "", "said"), (None, "不可能", "", [], "", "")], "row_key string, status string, contacted_at string, responses array<string>, interview_at string, note string")
    root = str(tmp_path / "root")
    spark.createDataFrame(rows, schema).write.parquet(f"{root}/people")
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{root}/other")
    assert sinks.sync_statuses(spark, root, store, lambda df: F.col("k"), lambda df: F.upper("k")) == ["people"]
    got = spark.read.parquet(f"{root}/people")
    assert got.columns == ["k", "姓名", *sheets.COLUMNS] and spark.read.parquet(f"{root}/other").count() == 1
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([
        ("a", "n", "不可能", "", "官回", "2026-01-02T03:04", "old；else"), ("b", "n", "", "2026", "已发；官回", "", "said"), ("c", "n", "已套磁", "", "", "", "else"), (None, "n", "", "", "", "", ""),
    ], key=repr)
    again = sheets.synced(got, store, lambda df: F.col("k"), lambda df: F.upper("k"))
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, got.collect()), key=repr)
    strict = sheets.synced(spark.createDataFrame(rows, schema), store, lambda df: F.col("k"), lambda df: F.upper("k"), authoritative=True)
    assert sorted((tuple(r)[2:] for r in strict.collect())) == sorted([("不可能", "", "", "", ""), ("", "2026", "已发；官回", "", "said"), ("", "", "", "", ""), ("", "", "", "", "")])
    assert sheets.synced(got.limit(0), store, lambda df: F.col("k"), lambda df: F.col("k")).count() == 0


def test_columns_of_any_name_stay(spark):
    """Operators that add columns for a while leave those alone that are named alike."""
    odd = ["__text", "__o", "__m", "__f", "__first", "__a", "__b", "__e", "__h", "__own", "__shared", "__key", "__old", "__k1", "__name", "c", "v", "o", "l", "t"]
    wear = lambda df: df.select("*", *[F.lit("x").alias(n) for n in odd if n not in df.columns])
    people = wear(spark.createDataFrame([("p", 1, "a", "n", "t1"), ("p", 2, "b", "n", "t1")], "person string, at int, title string, name string, target string"))
    merged = merging.merge_rows(people, "person", "at", ["title"], "name", "target").first()
    assert (merged.title, merged.n_merged, merged["__text"], merged["__m"], merged.c) == ("a; b", 2, "x", "x", "x")
    store = spark.createDataFrame([("p", "s")], "row_key string, status string")
    laid = contact.overlay(people, store, "person", "name", ["status"])
    assert sorted(laid.columns) == sorted([*people.columns, "status"]) and {r.status for r in laid.collect()} == {"s"} and laid.first()["__a"] == "x"
    by = dashboard.status_by_prefix(people, spark.createDataFrame([("p", "e")], "row_key string, entry string"), "person", "target")
    assert by.first().entry == "e" and by.first()["__b"] == "x"
    back = manifest.from_checkpoint(people, spark.createDataFrame([("p", "w")], "person string, web string"), "person", {"web": F.lit("")})
    assert {r.web for r in back.collect()} == {"w"} and back.first()["__e"] == "x"
    kept = restoring.restored(people, spark.createDataFrame([("p", "k")], "person string, web_search_keywords string"), "person")
    assert kept.first()["__old"] == "x" and kept.first().web_search_keywords == "k"
    picked = candidates.pick_author(people.withColumn("author_id", F.lit("z")), spark.createDataFrame([("p", None, "z")], "person string, name string, author_id string"), "person", "name")
    assert picked.first().direct and picked.first()["__own"] == "x"
    titles = spark.createDataFrame([("a b c",)], "title string")
    found = contained_titles(wear(spark.createDataFrame([("x a b c y",)], "text string")), titles.withColumn("__in", F.lit(1)), "text", "title")
    assert found.count() == 1 and found.first()["__text"] == "x"


def test_findings_of_people(spark):
    profile = scoring.validate(scoring.Profile(weights=[("small ring", 30), ("ring", 24), ("robot", 10), ("bolt", 0)], core=["ring"], alias_groups=[], direction_groups={}))
    works = [("a", 1, 2024, "V", "A small ring"), ("a", 2, 2023, None, "Robots and bolts"), ("a", 3, 2024, "V", None), ("b", 4, 2020, "", "on rings"), (None, 5, 2021, "W", "ring")]
    df = spark.createDataFrame(works, "p string, o int, y int, v string, t string").withColumn("terms", F.lit(1))
    got = {r.p: tuple(r)[1:] for r in findings.person_findings(df, "p", "y", "v", "t", "o", profile).collect()}
    assert got["a"][:3] == (3, "2024:2; 2023:1", "V(2)") and got["a"][3].startswith("[2024 V] A small ring；[2023] Robots and bolts") and got["a"][4:] == ("small ring; robot", 40, False)
    assert got["b"][4:] == ("", 0, False) and got[None][4:] == ("ring", 24, True)
    assert findings.person_findings(df.limit(0), "p", "y", "v", "t", "o", profile).count() == 0


def test_publication_audit_of_tables(spark):
    people = spark.createDataFrame([("h",), (" ",), (None,)], "seed_hash string")
    details = [("p", "c", "t", "r", None), ("p ", "c", "t", None, "u"), ("q", "c", " ", None, " "), (None, "c", None, "r", "u"), (None, " c ", "t", "r", "u"), ("p", None, "t", "r", "u"), ("p", "", "t", "r", "u")]
    details = spark.createDataFrame(details, "person string, canonical_id string, title string, trace_id string, url string")
    candidates = spark.createDataFrame([("是", "accepted"), ("否", "review"), (None, "unresolved"), (None, None)], "needs_review string, decision string")
    sources = spark.createDataFrame([("a", "ok"), ("a", "ok"), (None, "x")], "source string, status string")
    got = dict(map(tuple, findings.publication_audit(people, details, candidates, sources).collect()))
    assert got == {
        "people": 3, "identity_seed_coverage": 1, "publication_rows": 7, "blank_titles": 2, "missing_trace_rows": 1, "duplicate_canonical_rows": 4, "review_queue": 2, "ok": 0, "a|ok": 2, "|x": 1,
    }
    none = dict(map(tuple, findings.publication_audit(people.limit(0), details.limit(0), candidates.limit(0), sources.limit(0)).collect()))
    assert none["ok"] == 1 and sum(none.values()) == 1


def test_entries_are_checked_against_known_titles(spark):
    schema = "p string, o int, link string, title string, published string, authors string"
    rows = [("a", 1, "l", "Old one", "2024-02", ""), ("a", 2, "l", "New one", "2024-01", ""), ("a", 3, "", "SAME Title of it", "2024-03", ""), ("a", 4, None, "same title of IT", "2024-01", "x"), ("b", 5, None, None, None, None), ("b", 6, "", "", None, None)]
    last = findings.last_entries(spark.createDataFrame(rows, schema), "p", "o")
    assert sorted((r.p, r.place, r.o) for r in last.collect()) == [("a", 0, 2), ("a", 1, 4), ("b", 0, 6)]
    people = [("a", "Ann Lee", "高", "x; Robust networks of all", None, None), ("b", "Ann Lee", "低", "Robust networks of all", "medium", "Robust Networks, of all 2"), ("c", None, None, None, "high", None), ("d", "Ann Lee", "高", "short", "low", "short")]
    people = spark.createDataFrame(people, "p string, dblp_author string, dblp_confidence string, dblp_titles string, publication_confidence string, publication_titles string")
    entries = [("a", 1, "", "robust networks: of all", "", "Bo; ann-LEE"), ("b", 1, "", "Robust networks of ALL", "", "Bo"), ("c", 1, "", "robust networks of all", "", None), ("d", 1, "", "short", "", "Ann Lee"), ("e", 1, "", "x", "", "")]
    got = findings.cross_checked(people, spark.createDataFrame(entries + entries[:1], schema), "p")
    assert sorted(map(tuple, got.collect())) == [("a", 2, findings.IN_DBLP), ("b", 1, findings.IN_CATALOGUE), ("c", 1, findings.BY_NAME), ("d", 1, findings.BY_NAME)]


def test_addresses_that_many_share(spark):
    shared = ["", "http://www.nju.edu.cn", "http://www.nju.edu.cn/index.html", "http://www.nju.edu.cn/a/list.htm", "http://doi.org/10.1/x", "http://aiia.seu.edu.cn/ann", "http://cad.zju.edu.cn/english.html", "http://cs.seu.edu.cn/dsxx/list.htm", "https://dml.fudan.edu.cn", "http://a.org/b#c"]
    own = ["http://a.org", "http://www.nju.edu.cn/ann", "http://cs.seu.edu.cn/ann", "http://x.edu/list.htm"]
    df = spark.createDataFrame([(u,) for u in shared + own], "u string").select("u", homepages.is_shared_url(F.col("u")).alias("s"))
    assert {r.u for r in df.collect() if r.s} == set(shared)
    keys = spark.createDataFrame([("http://A.org/x/", "http://a.org/x"), ("http://a.org/#me", "http://doi.org/1"), (None, "http://b.org/?q")], "h string, p string").select(homepages.directory_keys(F.col("h"), F.col("p")).alias("k"))
    assert [r.k for r in keys.collect()] == [["url:http://a.org/x"], [], ["url:http://b.org?q"]]


def test_patches_change_and_delete_entries(spark):
    fields = "row_key string, status string, contacted_at string, responses array<string>, interview_at string, note string"
    store = spark.createDataFrame([("a", "已套磁", "2026", ["已发"], "", "n", *["old"] * 4, "t0"), ("b", "", "2026", [], "", "", *["old"] * 4, "t0"), ("c", "", "", ["x"], "", "", *["old"] * 4, "t0")], fields + ", name string, school string, college string, teacher_url string, updated_at string")
    patches = [("a", None, None, None, None, "m", 1, "t1"), ("a", "不考虑", None, None, "2026-01-02 03:04", None, 3, "t3"), ("a", "bogus", None, [" ", "y", "y"], None, None, 2, "t2"), ("b", None, "", None, None, None, 1, "t1"), ("d", None, None, ["z"], None, None, 1, None),
               ("e", "", None, [], None, " ", 1, "t"), ("nobody", "已套磁", None, None, None, None, 1, "t"), (None, "已套磁", None, None, None, None, 1, "t")]
    patches = spark.createDataFrame(patches, fields + ", seq int, at string")
    people = spark.createDataFrame([(k, f" n  {k}", "s", None, "u") for k in ("a", "b", "c", "d", "e")] + [(None, "x", "s", None, "u")], "row_key string, name string, school string, college string, teacher_url string")
    got = sorted(map(tuple, stores.patched(store, patches, people).collect()))
    assert got == [
        ("a", "先不考虑", "2026", ["y"], "2026-01-02T03:04", "m", "n a", "s", "", "u", "t3"), ("c", "", "", ["x"], "", "", *["old"] * 4, "t0"), ("d", "", "", ["z"], "", "", "n d", "s", "", "u", None),
    ]
    assert stores.patched(store.limit(0), patches.limit(0), people).count() == 0


def test_short_names_stand_near_a_word_of_research(spark):
    rng = random.Random(14)
    people = [a + b for a in "李王张" for b in "明李教"]
    texts = ["".join(rng.choices(["李", "王", "张", "明", "教", "教授", "研究员", "博士", "x", "，", "\n", "yyyyyyyyyy"], k=rng.randrange(1, 25))) for _ in range(300)]
    near = sections.NEAR_PERSON
    want = {(n, i) for i, t in enumerate(texts) for n in people if re.search(f"{near}.{{0,12}}{n}|{n}.{{0,12}}{near}", t)}
    got = sections.mentions(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", F.col("t"), spark.createDataFrame([(p,) for p in people], "name string"), "name", most=1_000)
    assert {(r.name, r.id) for r in got.collect()} == want and len(want) > 200
