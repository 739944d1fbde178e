"""Extractors, row operators and connectors on small inputs."""

import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from dossier.functions import extract
from dossier.operators import rows
from dossier.sources import connectors, tables


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("out")).first()["out"]


def test_names(spark):
    assert one(spark, extract.clean_name(F.col("v")), v=" 张 三（教授） ") == "张三"
    assert one(spark, extract.clean_name(F.col("v")), v="Jane  Doe (chair)") == "Jane Doe"
    assert one(spark, extract.name_titles(F.col("v"), F.col("c")), v="李四（教授、博士，院士）", c="特聘") == "特聘; 教授; 院士"
    got = one(spark, extract.name_aliases(F.col("s"), F.col("u")), s=["zhang", "xiao", "ming"], u="http://a.edu/~x/zhangxm2.html")
    assert got == ["xiaoming zhang", "xiao ming zhang", "zhang xiaoming", "zhang xiao ming", "xm zhang", "zhang xm"]
    assert one(spark, extract.name_aliases(F.col("s"), F.col("u")), s=["zhang"], u=None) == []
    assert one(spark, extract.author_strings(F.col("p"), F.col("a")), p="1. Xiaoming Zhang, Bo Li. A title. 2024", a=["xiaoming zhang"]) == ["Xiaoming Zhang"]


def test_links_and_labels(spark):
    assert one(spark, extract.phones(F.col("v")), v="021-65642222, 65642222 65642222 010-12345678") == ["021-65642222", "65642222"]
    assert one(spark, extract.link_list(F.col("v")), v="a.edu/x，http://b.org/y; c.com") == ["https://a.edu/x", "http://b.org/y", "https://c.com"]
    assert one(spark, extract.host_key(F.col("v")), v="HTTP://www.A.edu/B/?q#f") == "a.edu/b"
    assert one(spark, extract.homepage_overlap(F.col("a"), F.col("b")), a=["http://www.a.edu/x/"], b=["https://a.edu/x/me", ""]) is True
    assert one(spark, extract.homepage_overlap(F.col("a"), F.col("b")), a=[""], b=["https://a.edu"]) is False
    pair = one(spark, extract.label_value(F.col("v")), v="研究 方向：机器: 学习")
    assert (pair.label, pair.value) == ("研究方向", "机器: 学习")
    assert one(spark, extract.direction(F.col("v")), v="简介。研究方向：机器学习与优化。其他") == "研究方向：机器学习与优化"
    assert one(spark, extract.catalogue_id(F.col("v")), v="https://dblp.org/pid/12/345-1.html") == "12/345-1"
    assert one(spark, extract.catalogue_id(F.col("v")), v="https://x.org/pid/12/3") == ""
    for f in (extract.phones, extract.links, extract.link_list):
        assert one(spark, f(F.col("v")), v=None) == []


def test_snippets(spark):
    text = "Short 2024. A sentence long enough about 2024 results. Another sentence that says nothing new! The third of 2025 is also long."
    assert one(spark, extract.sentence_snippet(F.col("v"), ["202[45]"]), v=text) == (
        "A sentence long enough about 2024 results.；The third of 2025 is also long."
    )
    assert one(spark, extract.pattern_keywords(F.col("v"), ["(?i)ai", "(?i)ml"]), v="ml AI ai ML") == "AI; ml"


def test_row_shapes(spark):
    df = spark.createDataFrame([(1, "x", "old")], "id int, name string, legacy string")
    out = rows.insert_after(df, "name", ["status", "note"], "note", ["legacy"])
    assert out.columns == ["id", "name", "status", "note"] and out.first().note == "old"
    assert rows.project(df, ["name", "none"]).first().none == ""
    sounds = spark.createDataFrame([("张", "zhang"), ("三", "san"), ("ab", "no")], "character string, sound string")
    people = spark.createDataFrame([(1, "张三"), (2, "Bob")], "id int, name string")
    assert [tuple(r) for r in rows.syllables(people, "id", "name", sounds).collect()] == [(1, ["zhang", "san"])]
    decisions = spark.createDataFrame([("success", "high"), ("success", "medium"), ("identity_rejected", ""), ("x", None)], "s string, c string")
    assert [r[0] for r in decisions.select(rows.identity_decision(F.col("s"), F.col("c"))).collect()] == ["confirmed", "probable", "rejected", "unresolved"]


def test_paged_source(spark):
    spark.dataSource.register(connectors.paged_source("pages_of_three", "n int, v string", lambda p: [(p * 3 + i, f"v{i}") for i in range(3)], [0, 1]))
    df = spark.read.format("pages_of_three").load()
    assert sorted(r.n for r in df.collect()) == [0, 1, 2, 3, 4, 5]
    assert connectors.truncated(df.withColumn("k", F.lit(1)), "k", 3, 2).first().truncated is True


def test_catalogues(spark):
    person = """<dblpperson name="A"><r><article key="j/1"><author>A B</author><author>C D</author><title>Old</title><year>2020</year><journal>J</journal></article></r>
      <r><inproceedings key="c/1"><author>A B</author><title>New</title><year>2024</year><booktitle>C</booktitle><ee>http://x</ee></inproceedings></r>
      <r><article key="j/2"><author>A B</author><title>Mid</title><year>2023</year><journal>J</journal></article></r></dblpperson>"""
    df = spark.createDataFrame([(1, person), (2, "<dblpperson/>")], "id int, x string")
    got = connectors.catalogue_records(df, "id", F.col("x"), 2022, 2024).orderBy("place").collect()
    assert [(r.id, r.place, r.key, r.kind, r.venue, r.title) for r in got] == [(1, 0, "c/1", "inproceedings", "C", "New"), (1, 1, "j/2", "article", "J", "Mid")]
    feed = """<feed><entry><id>http://arxiv.org/abs/1</id><title>One
      two</title><published>2024-01-02T00:00:00Z</published><author><name>Xi Zhang</name></author><category term="cs.AI"/></entry>
      <entry><id>2</id><title>Other</title><published>2024-05-02T00:00:00Z</published><author><name>Xin Zhang</name></author></entry></feed>"""
    df = spark.createDataFrame([(1, feed, "xi zhang")], "id int, x string, n string")
    got = connectors.feed_entries(df, "id", F.col("x"), F.col("n"), 2024, 2024).collect()
    assert [(r.title, r.categories) for r in got] == [("One two", ["cs.AI"])]


def test_cache(spark):
    day = datetime.datetime(2024, 1, 1)
    cache = spark.createDataFrame([(1, day, "a"), (1, day + datetime.timedelta(2), "b"), (2, day - datetime.timedelta(9), "c")], "k int, fetched_at timestamp, body string")
    ask = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    now = F.lit(day + datetime.timedelta(3))
    assert [(r.k, r.hit, r.body) for r in connectors.cached(ask, cache, "k", now, 7).orderBy("k").collect()] == [(1, True, "b"), (2, False, None), (3, False, None)]
    assert connectors.cached(ask, cache, "k", now, 0).filter("hit").count() == 0


def test_follow_links_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("b", None)], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",)], "node string")
    assert sorted(tuple(r) for r in connectors.follow_links(edges, seeds).collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_follow_links_has_no_last_step(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(104)] + [(104, 0), (0, 2)], "src int, dst int").coalesce(1)
    seeds = spark.createDataFrame([(0,)], "node int")
    assert sorted(tuple(r) for r in connectors.follow_links(edges, seeds).collect()) == [(0, 0), (1, 1)] + [(i, i - 1) for i in range(2, 105)]


def test_materials(spark, tmp_path):
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>One  </w:t><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>three</w:t></w:r></w:p></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as archive:
        archive.writestr("word/document.xml", body)
    (tmp_path / "b.md").write_text(" x \t y ")
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in connectors.read_materials(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": "One two\nthree", "b.md": "x y"}
    (tmp_path / "c.exe").write_text("x")
    with pytest.raises(Exception, match="unsupported material"):
        connectors.read_materials(spark, str(tmp_path)).collect()


def test_anchor_text_ends_with_the_anchor(spark):
    page = '<meta property="og:title" content="T"><a href="/x">in</a> out <a href="/y">two</a> end'
    got = one(spark, tables.parse_html(F.col("h")), h=page)
    assert [(link.href, link.text) for link in got.links] == [("/x", "in"), ("/y", "two")]
    assert got.text == "T in out two end"


def test_long_anchor_text_is_whole(spark):
    inner = "".join(f"<b>word {i}</b> and " for i in range(60))
    got = one(spark, tables.parse_html(F.col("h")), h=f'<a href="/x">{inner}</a> out')
    assert got.links[0].text == " ".join(f"word {i} and" for i in range(60))
