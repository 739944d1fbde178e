"""Merging, extraction, sections, candidates, manifests, validation and sinks on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from dossier.operators import candidates, curation, dashboard, dedup, manifest, merging, seed, sections, validation
from dossier.operators.works import contained_titles
from dossier.sources import extractor, sinks, tables


def slow_across(rows):
    """What becomes of each row in turn: merged, kept beside its owner, asked for review, or new; and who says so."""
    leads, called, row_of, said = {}, {}, {}, {}

    def tell(text, *who):
        for w in who:
            said.setdefault(w, {})[text] = None  # a dict keeps the order and each text once

    out = {}
    for row in sorted(rows):
        o, target, overlap, name, keys, by_name = row
        row_of[o] = row
        into = next(iter(leads[k] for k in keys if k in leads), None)
        there = None if into is None else row_of[into]
        if there and not (overlap and there[2] == overlap):
            out[o] = into
            tell(f"跨目标重复记录合并（identity）：{name} @ {target} -> {there[1]}", into)
        else:
            out[o] = o
            if there:
                tell(f"跨目标多学院归属保留：{name} @ {there[1]} / {target}", into, o)
            elif by_name and by_name in called:
                tell(f"同校同名待人工复核：{name} @ {target} / {row_of[called[by_name]][1]}", called[by_name], o)
        leads = {k: out[o] for k in keys} | leads
        called = ({by_name: out[o]} if by_name else {}) | called
    return {(o, w, "; ".join(said.get(o, ())) if o == w else "") for o, w in out.items()}


def test_across_targets_like_the_sequential_rule(spark):
    rng = random.Random(3)
    rows = []
    for o in range(120):
        target = f"t{o // 30}"
        keys = [f"u{rng.randrange(60)}" for _ in range(rng.choice((0, 1, 1, 2)))]
        rows.append((o, target, "g" if target in ("t1", "t2") else "", f"p{rng.randrange(9)}", keys, f"name:s:{rng.randrange(40)}" if rng.random() < 0.4 else ""))
    schema = "o long, target string, overlap string, name string, keys array<string>, by_name string"
    got = {tuple(r) for r in merging.across_targets(spark.createDataFrame(rows, schema)).collect()}
    assert got == slow_across(rows) and any("保留" in n for _, _, n in got) and any("复核" in n for _, _, n in got) and any("合并" in n for _, _, n in got)
    assert merging.across_targets(spark.createDataFrame([], schema)).count() == 0
    odd = spark.createDataFrame([(1, "t", None, None, None, None), (2, "t", None, "x", ["k"], None), (3, "u", None, "y", ["k"], None)], schema)
    assert {(r.o, r.owner) for r in merging.across_targets(odd).collect()} == {(1, 1), (2, 2), (3, 2)}


def test_pointers_of_any_depth_and_hot_keys(spark):
    rows = [(i, [f"k{i - 1}", f"k{i}"]) for i in range(1, 70)] + [(i, ["hot", f"k{i}"]) for i in range(100, 300)] + [(400, [None, "hot"]), (401, [None]), (402, None)]
    got = {r.o: r.group for r in dedup.greedy_groups(spark.createDataFrame(rows, "o long, keys array<string>").repartition(5), "o", "keys").collect()}
    assert got == {**{i: 1 for i in range(1, 70)}, **{i: 100 for i in range(100, 300)}, 400: 100, 401: 401, 402: 402}
    schema = "o long, target string, overlap string, name string, keys array<string>, by_name string"
    rng = random.Random(12)
    chain = [(i, f"t{i % 5}", rng.choice(["", "g", "h"]), f"p{i % 3}", [f"k{i - 1}", f"k{i}"] if i < 14 else ["k3"], "n" if i % 2 else "") for i in range(1, 80)]
    assert {tuple(r) for r in merging.across_targets(spark.createDataFrame(chain, schema)).collect()} == slow_across(chain)


def test_overlap_group_keeps_both(spark):
    schema = "o long, target string, overlap string, name string, keys array<string>, by_name string"
    rows = [(1, "seu_cse", "seu", "张三", ["u"], "name:seu:张三"), (2, "seu_ai", "seu", "张三", ["u"], "name:seu:张三")]
    got = merging.across_targets(spark.createDataFrame(rows, schema)).orderBy("o").collect()
    assert [r.owner for r in got] == [1, 2] and all("跨目标多学院归属保留" in r.note and "复核" not in r.note for r in got)


def test_merged_rows_keep_first_and_join_values(spark):
    rows = [("a", 1, "教授", "x@y.cn", "n1"), ("a", 2, "教授", "", "n2"), ("a", 3, "博导", "z@y.cn", "n3"), ("b", 4, None, None, "n4")]
    df = spark.createDataFrame(rows, "person string, o int, title string, email string, name string").withColumn("target", F.lit("t"))
    got = {r.person: r for r in merging.merge_rows(df, "person", "o", ["title", "email"], "name", "target").collect()}
    assert (got["a"].title, got["a"].email, got["a"].name) == ("教授; 博导", "x@y.cn; z@y.cn", "n1")
    assert got["a"].note == "同目标重复记录合并：n2 @ t; 同目标重复记录合并：n3 @ t" and (got["b"].title, got["b"].note, got["b"].n_merged) == ("", "", 1)
    names = spark.createDataFrame([("张 三",), ("李四（博士）",), ("Ann",), (None,)], "n string").select(merging.name_key(F.lit("s"), F.col("n")).alias("k"))
    assert [r.k for r in names.collect()] == ["name:s:张三", "name:s:李四", None, None]


def test_greedy_groups_fold_repeated_lists_once(spark):
    rng = random.Random(6)
    rows = [(o, [f"k{rng.randrange(25)}" for _ in range(rng.choice((0, 1, 2, 2)))]) for o in range(400)]
    seen, want = {}, {}
    for o, keys in rows:
        group = next((seen[k] for k in keys if k in seen), o)
        for k in keys:
            seen.setdefault(k, group)
        want[o] = group
    got = dedup.greedy_groups(spark.createDataFrame(rows, "o long, keys array<string>"), "o", "keys").collect()
    assert {r.o: r.group for r in got} == want


DIRECTORY = """<html><body><div class="box sztuanduia"><h1><a href='/t/1.htm'>姓名：张三</a></h1><p>职称：教授（统计学院）</p><P>研究方向：因果推断 联系方式：a@ruc.edu.cn</p></div>
<div class="sztuanduia"><h1>李四</h1><p>职称：讲师</div><script>var x = "<div class='sztuanduia'><h1>no</h1></div>";</script></body>"""
RULES = extractor.Extractor(
    items=".sztuanduia", fields={"name": "h1", "link": "h1 a@href"}, labels={"title": "职称", "direction": "研究方向", "contact": "联系方式"}, stops=("联系方式", "办公")
)


def test_extractor_reads_cards():
    assert extractor.extract(DIRECTORY, "http://s.cn/list/index.htm", RULES) == [
        ["姓名：张三", "http://s.cn/t/1.htm", "教授（统计学院）", "因果推断", ""], ["李四", "", "讲师", "", ""],
    ]
    assert extractor.extract("", "", RULES) == [] and extractor.extract("<p class=sztuanduia><b>x", "", RULES) == [["", "", "", "", ""]]
    nested = "<ul id=a><li class='x y'>1<li class=x>2</ul><ul><li>3</ul>"
    assert extractor.extract(nested, "", extractor.Extractor(items="#a li", fields={"v": "", "c": "@class"})) == [["1", "x y"], ["2", "x"]]
    assert [n.text() for n in extractor.select(extractor.parse(nested), "ul#a li.x")] == ["1", "2"]
    deep = "<div>" * 5000 + "text"
    assert extractor.parse(deep).text() == "text"


def test_people_and_their_details(spark):
    pages = [("http://s.cn/list/index.htm", DIRECTORY), ("http://s.cn/list/index1.htm", DIRECTORY), ("http://s.cn/t/1.htm", "<div class=h><h2>Zhang</h2><p>职称：院长</p></div>"), ("http://s.cn/none", None)]
    df = spark.createDataFrame(pages, "url string, html string")
    listed = extractor.people(df, "url", "html", RULES)
    assert listed.count() == 4
    detail = extractor.Extractor(fields={"english": "h2", "email": ".mail"}, labels={"title": "职称"})
    got = {r.link: r for r in extractor.with_details(listed, "link", df, "url", "html", detail).collect()}
    assert set(got) == {"http://s.cn/t/1.htm", ""} and got[""].state == "missing"
    one = got["http://s.cn/t/1.htm"]
    assert (one.page, one.title, one.english, one.email, one.state) == ("http://s.cn/list/index.htm", "院长", "Zhang", "", "parsed")


PAGE = """个人简介
张三，教授，主要从事统计研究。
2001年毕业于某大学，随后在多个学校任教，这一行因为很长并且带有年份所以不应进入个人简介文本之中，它超过八十个字符，确实超过八十个字符了，还要再长一点才行，再长一点点就可以了。
一、代表论文：
1. Zhang S. Causal inference in practice. Journal of Statistics, 2021.
not a record
2. Zhang S, Li T. Another good title here. Annals of Things, 2020.
2. Zhang S, Li T. Another good title here. Annals of Things, 2020.
获奖
3. Zhang S. After the end, Journal of X, 2019.
论文发表
4. Wang W. Second section title, Journal of Y, 2018."""


def test_sections_of_a_page(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "Publications")], "id int, text string")
    lines = sections.lines_of(df, "id", F.col("text"))
    got = [r.line[:2] for r in sections.publication_lines(lines, "id").orderBy("id", "place").collect()]
    assert got == ["1.", "2.", "4."]
    assert {r.section for r in sections.sections(lines, "id").collect()} == {1, 2}
    bio = {r.id: r.bio for r in sections.biography(lines, "id").collect()}
    assert bio == {1: "个人简介 张三，教授，主要从事统计研究。 一、代表论文：".replace(" 一、代表论文：", "")}


def test_english_names_in_order_of_trust(spark):
    rows = [("英文姓名：San Zhang", "Other Name", "x"), ("none", "San Zhang University", "张三 (San Zhang)"), (None, "San Z. Zhang", None), ("English name: Zhang", None, "张三"), ("x", "A B C D E", "y")]
    got = spark.createDataFrame(rows, "t string, m string, h string").select(sections.english_name(F.col("t"), F.col("m"), F.col("h")).alias("n")).select("n.*").collect()
    assert [tuple(r) for r in got] == [("San Zhang", "official_label"), ("San Zhang", "official_heading"), ("San Z Zhang", "official_meta"), ("", ""), ("", "")]


def test_rows_of_a_printed_table(spark):
    text = "研究生导师信息库 2024\n序号\n1\n计算所\n王小明\n教授\n机器学习\n数据挖掘 \n玉泉校区 曹主302\nwxm@zju\n.edu.cn\n博导\n第 2 页\n2\n软件所\n李四\n副教授\n编程语言\n——"
    lines = sections.lines_of(spark.createDataFrame([(1, text)], "id int, text string"), "id", F.col("text"))
    got = sorted(tuple(r) for r in sections.table_rows(lines, "id", ("序号",)).collect())
    assert got == [(1, "1", "计算所", "王小明", "教授", "机器学习 数据挖掘", "wxm@zju.edu.cn"), (1, "2", "软件所", "李四", "副教授", "编程语言", "")]


def test_candidates_and_statuses(spark):
    schema = "person int, author_id string, score int, overlap int, name boolean, orcid boolean, affiliation boolean, conflict boolean, strong boolean"
    rows = [(1, "A1", 9, 1, True, False, False, False, False), (1, "A2", 16, 0, True, True, False, False, True), (1, "A3", 4, 0, True, False, False, True, False), (2, "A9", 20, 2, True, True, True, False, True), (3, "A5", 4, 0, True, False, False, False, False)]
    people = spark.createDataFrame([(1, "x"), (2, "https://openalex.org/A9；"), (3, None)], "person int, refused string").select("person", candidates.source_ids(F.col("refused")).alias("rejected_ids"))
    judged = candidates.judge(spark.createDataFrame(rows, schema), "zbmath", people, "person")
    got = {r.author_id: (r.decision, r.conflicts, r.signals) for r in judged.collect()}
    assert got["A1"][0] == "probable" and got["A2"] == ("confirmed", [], ["name", "orcid"]) and got["A3"][:2] == ("rejected", ["orcid_mismatch"])
    assert got["A9"] == ("rejected", [candidates.OVERRIDDEN], []) and got["A5"][0] == "review" and got["A1"][2] == ["name", "official_title_overlap:1"]
    asked = spark.createDataFrame([(1, None, 2, None), (2, None, 1, ""), (3, "rejected", 1, None), (4, None, 1, "Z1"), (5, None, 0, None), (6, None, 1, None)], "person int, review_status string, n_names int, confirmed_id string")
    status = {r.person: r.status for r in candidates.search_status(asked, judged, "person").collect()}
    assert status == {1: "candidates", 2: "identity_rejected", 3: "identity_rejected", 4: "identity_confirmed", 5: "missing_identity_seed", 6: "no_candidate"}


def test_row_marks_follow_row_and_run(spark):
    run = manifest.Run("rank", "s/c", policy_version="v1", years=("2025",))
    row = spark.createDataFrame([("p", " 张三 ", "d", 1)], "person string, name string, direction string, other int")
    mark = lambda df, r: df.select(manifest.row_mark(df, F.col("person"), r).alias("m")).first().m
    base = mark(row, run)
    assert base == mark(row.withColumn("name", F.lit("张三")).withColumn("other", F.lit(2)), run)
    changed = [mark(row.withColumn("direction", F.lit("e")), run), mark(row, manifest.Run("rank", "s/c", policy_version="v2", years=("2025",))),
               mark(row, manifest.Run("rank", "s/c", policy_version="v1", years=("2025",), metadata={"a": 1})), mark(row.withColumn("relevance_labels", F.lit("x")), run)]
    assert len({base, *changed}) == 5
    assert {r.item for r in manifest.provenance(spark, run).collect()} >= {"profile_id", "policy_version", "fingerprint"}


def test_stage_gates():
    run = manifest.Run("final", "s/c", "mine", "h1")
    manifest.check_stage({"dblp": {"profile_id": "mine", "profile_hash": "h1"}}, "dblp", run)
    manifest.check_stage({}, "dblp", manifest.Run("final", "s/c"))
    for stages in ({}, {"dblp": {"profile_id": "mine", "profile_hash": "h2"}}, {"dblp": {}}):
        with pytest.raises(RuntimeError):
            manifest.check_stage(stages, "dblp", run)
    assert manifest.check_shadow("/data/_shadow/run1") == "/data/_shadow/run1"
    with pytest.raises(ValueError):
        manifest.check_shadow("/data/shadow/run1")


def test_comparison_fails_without_a_judgement(spark):
    level = "sample_id int, {} string"
    queue = spark.createDataFrame([(1, "t")], "sample_id int, target string")
    base = spark.createDataFrame([(1, "main", "强烈建议")], "sample_id int, category string, old_level string")
    new = spark.createDataFrame([(1, "可以考虑", True)], "sample_id int, new_level string, new_anchor boolean")
    compared = validation.compare(queue, base, spark.createDataFrame([(1, "暂不优先")], level.format("manual_level")), new)
    assert [(r.old_error, r.new_error) for r in compared.collect()] == [(2, 1)]
    counts = validation.metrics(compared).first().asDict()
    lines = [r.line for r in validation.report("Check", counts, compared).collect()]
    assert lines[0] == "# Check" and "- old_weighted_error: 2" in lines and lines[-1] == "| 1 | main | 暂不优先 | 强烈建议 | 可以考虑 | yes |"
    with pytest.raises(Exception, match="sample without all judgements"):
        validation.compare(queue, base, spark.createDataFrame([], level.format("manual_level")), new).collect()


def test_documents_are_written_whole(spark, tmp_path):
    path = tmp_path / "a" / "doc.json"
    sinks.write_document(str(path), {"b": float("nan"), 1: [None, "é"]})
    assert json.loads(path.read_text()) == {"b": None, "1": [None, "é"]} and "é" in path.read_text()
    with pytest.raises(TypeError):
        sinks.write_document(str(path), [{"z": 1}, 5].__iter__, lines=True)
    assert json.loads(path.read_text())["b"] is None
    sinks.write_document(str(path), [{"z": 1, "a": 2}], lines=True)
    assert path.read_text() == '{"a": 2, "z": 1}\n'


def test_tables_replaced_and_read(spark, tmp_path):
    root = str(tmp_path / "root")
    tables.write_tables(root, {"one": spark.range(3), "two": spark.range(5)})
    read = sinks.read_tables(spark, root)
    sinks.replace_table(read["one"].filter("id > 0"), root, "one")
    assert {n: df.count() for n, df in sinks.read_tables(spark, root).items()} == {"one": 2, "two": 5}
    artefacts = {n: spark.range(2) for n in sinks.ARTEFACTS}
    sinks.write_artefacts(str(tmp_path / "audit"), artefacts)
    assert spark.read.json(str(tmp_path / "audit" / "review_queue")).count() == 2
    with pytest.raises(ValueError, match="missing artefacts"):
        sinks.write_artefacts(str(tmp_path / "other"), {"query_plan": spark.range(1)})
    assert not (tmp_path / "other").exists()
    calls = sinks.api({"people": spark.createDataFrame([(1, None)], "person_id int, n string"), "works": spark.createDataFrame([(1, "w"), (2, "v")], "person_id int, t string")})
    assert [tuple(r) for r in calls["health"]().orderBy("name").collect()] == [("people", 1), ("works", 2)]
    assert calls["data"]().first().n == "" and calls["detail"](1)["works"].count() == 1


def test_partitioned_targets_and_logs(spark, tmp_path):
    root = str(tmp_path / "targets")
    for school, college in (("a", "x"), ("a", "archive"), ("b", "y")):
        spark.range(2).write.parquet(f"{root}/school={school}/college={college}/people")
    got = tables.target_tables(spark, root, "people", excluded=("college=archive",))
    assert {(r.school, r.college) for r in got.select("school", "college").distinct().collect()} == {("a", "x"), ("b", "y")}
    log = str(tmp_path / "log")
    for n in range(2):
        tables.append_log(spark.createDataFrame([("k", n)], "key string, seq int"), log)
    last, bad = tables.read_log(spark, log, spark.createDataFrame([], "key string, seq int").schema, "key", "seq")
    assert [tuple(r) for r in last.select("key", "seq").collect()] == [("k", 1)] and bad.count() == 0


def test_curated_needs_exactly_one(spark):
    people = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "pid int, name string")
    items = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, 2, "zzz"), (4, 9, "a"), (5, None, None)], "item int, pid int, name string")
    assert {r.item: r.row_id for r in curation.curated(items, people, "pid", "name").collect()} == {1: "1", 3: "2"}


def test_titles_in_texts_like_nested_search(spark):
    rng = random.Random(2)
    vocabulary = ["ab", "ba", "a", "b", "ab,", "x\ty", "a\n b"]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    texts = [(i, say(rng.randrange(12))) for i in range(80)] + [(900, None), (901, "")]
    titles = [(i, say(rng.randrange(1, 7))) for i in range(60)] + [(800, None), (801, ""), (802, " ab ba ab "), (803, "b a"), (803, "b a"), (804, "never such words here")]
    df, named = spark.createDataFrame(texts, "t int, text string"), spark.createDataFrame(titles, "n int, title string")
    want = sorted((t, n) for t, text in texts for n, title in titles if text is not None and title is not None and title in text)
    for most in (32 << 20, 300):
        assert sorted((r.t, r.n) for r in contained_titles(df, named, "text", "title", most).collect()) == want
    assert contained_titles(df, named.limit(0), "text", "title").count() == 0


def test_viewer_rules(spark):
    texts = ["机器学习；Ａ．Ｉ。", "DBLP近三年关键词: 机器学习, b"]
    df = spark.createDataFrame([tuple(texts)], "a string, b string")
    got = df.select(dashboard.new_signals([("x", F.col("a")), ("y", F.col("b"))]).alias("g")).first().g
    assert [(g.source, g.signals) for g in got] == [("x", ["机器学习", "Ａ．Ｉ。"]), ("y", ["b"])]
    names = spark.createDataFrame([("张三",), ("李四",), ("王五",)], "n string").orderBy(F.collate("n", "zh")).collect()
    assert [r.n for r in names] == ["李四", "王五", "张三"]


def test_profile_lookup(spark):
    rows = [("b", True), ("a", True), ("legacy-default", False), ("c", False)]
    df = spark.createDataFrame(rows, "profile_id string, active boolean")
    ask = lambda d, e="": [r.profile_id for r in seed.active_profile(d, e).collect()]
    assert ask(df) == ["a"] and ask(df, "c") == ["c"] and ask(df, "zz") == [] and ask(df.filter("not active")) == ["legacy-default"]
    ids = spark.createDataFrame([("Demo_1",), ("-x",), ("",), (None,), ("x" * 65,)], "p string").select(seed.is_profile_id(F.col("p")).alias("ok"))
    assert [r.ok for r in ids.collect()] == [True, False, False, False, False]
