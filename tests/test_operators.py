"""Golden cases of the matching, identity, ranking, dedup, contact and incremental operators."""

import itertools
import json
import random
import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dossier.functions import dates, identity, text
from dossier.operators import audit, authors, contact, dashboard, dedup, evidence, ranking, scoring, works
from dossier.sources import tables
from dossier.streaming import incremental

ROBOT = scoring.Profile([("robot manipulation", 30), ("robot", 24), ("llm", 0), ("vision", 5)], ["robot manipulation", "robot"])
ALIAS = scoring.Profile([("robot", 24), ("robotic", 24)], ["robot", "robotic"], [["robot", "robotic"]])
WIDE = scoring.Profile(
    [("machine learning", 26), ("causal inference", 26), ("high-dimensional data analysis", 26), ("bayesian statistics", 26), ("applied statistics", 16)],
    ["machine learning", "causal inference", "high-dimensional data analysis", "bayesian statistics"],
    direction_groups={"statistics_methods": ["causal inference", "bayesian statistics"], "ai_methods": ["machine learning"], "bridge": ["high-dimensional data analysis"]},
)
NARROW = scoring.Profile(
    [("bayesian statistics", 26), ("high-dimensional data analysis", 26)], ["bayesian statistics", "high-dimensional data analysis"],
    direction_groups={"statistics_methods": ["bayesian statistics", "high-dimensional data analysis"]},
)
EXCLUDING = scoring.Profile([("convex optimization", 10)], ["convex optimization"], excluded=["functional analysis"])


def one(spark, expr, **values):
    columns = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*columns).select(expr.alias("x")).first()["x"]


def ranked(spark, profile, **row):
    return ranking.rank(spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()]), profile).first()


def test_scores(spark):
    s = scoring.score(F.col("t"), ROBOT)
    assert tuple(one(spark, s, t="LLM and large models")) == (0, [])
    assert tuple(one(spark, s, t="Robot  manipulation and robots")) == (30, ["robot manipulation"])
    assert tuple(one(spark, scoring.score(F.col("t"), ALIAS), t="robot and robotic systems")) == (24, ["robotic"])


def slow_score(lowered, profile, cap=4):
    found = [(kw, w) for kw, w in profile.weights if w > 0 and f" {kw} " in lowered]
    picks, used = [], set()
    for group in profile.alias_groups:
        own = [next((m for m in found if m[0] == a), None) for a in group]
        if own := [m for m in own if m]:
            picks.append(max(own, key=lambda m: (m[1], len(m[0]))))
            used |= set(group)
    picks += [m for m in found if m[0] not in used]
    kept = []
    for kw, w in sorted(picks, key=lambda m: (len(m[0]), m[1]), reverse=True):
        if not any(kw in k for k, _ in kept):
            kept.append((kw, w))
    return sum(w for _, w in kept[:cap]), [k for k, _ in kept[:cap]]


def test_scores_like_the_sequential_rule(spark):
    words = ["aa", "bb", "cc", "dd", "ee"]
    phrases = [*words, *(" ".join(p) for p in itertools.permutations(words, 2))]
    rng = random.Random(1)
    profile = scoring.validate(scoring.Profile([(p, rng.randint(0, 9)) for p in phrases], alias_groups=[["bb", "aa bb", "cc"], ["dd", "ee aa"]]))
    texts = [" ".join(rng.choices([*words, "zz"], k=rng.randint(1, 9))) for _ in range(150)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scoring.score(F.col("t"), profile).alias("s")).collect()
    for r in got:
        padded = " " + r.t.replace(" ", "  ") + " "
        spaced = profile.__class__([(k.replace(" ", "  "), w) for k, w in profile.weights], alias_groups=[[a.replace(" ", "  ") for a in g] for g in profile.alias_groups])
        want = slow_score(padded, spaced)
        assert (r.s.score, r.s.keywords) == (want[0], [k.replace("  ", " ") for k in want[1]]), r.t


def test_profile_rules():
    for bad in (scoring.Profile([]), scoring.Profile([("a", -1)]), scoring.Profile([("a", 1), ("A", 2)]), scoring.Profile([("a", 0)], ["a"]),
                scoring.Profile([("a", 1)], alias_groups=[["b"]]), scoring.Profile([("a", 1), ("b", 1)], alias_groups=[["a", "b"], ["a"]])):
        with pytest.raises(ValueError):
            scoring.validate(bad)


def test_decisions(spark):
    r = ranked(spark, WIDE, direction="causal inference")
    assert (r.level, r.explicit_anchor, r.matched_direction_groups) == ("可以考虑", True, ["statistics_methods"])
    r = ranked(spark, WIDE, direction="causal inference; high-dimensional data analysis")
    assert r.level == "强烈建议" and r.score == 52 and len(r.matched_direction_groups) == 2
    r = ranked(spark, NARROW, direction="Bayesian statistics and high-dimensional data analysis")
    assert (r.score, r.level) == (52, "可以考虑") and any("单一画像方向组" in x for x in r.reasons)
    evidence = {"publication_confidence": "high", "publication_status": "official:success/high", "publication_keywords": "bayesian statistics"}
    r = ranked(spark, NARROW, direction="Bayesian statistics and high-dimensional data analysis", **evidence)
    assert r.level == "强烈建议" and r.score_publication == 9
    r = ranked(spark, NARROW, direction="poetry", **evidence)
    assert (r.level, r.can_contact, r.score_publication, r.explicit_anchor) == ("暂不优先", "否", 0, False) and r.warnings
    for status in ("official:no_record", "zbmath:identity_rejected/high", ""):
        assert ranked(spark, NARROW, direction="Bayesian statistics", **{**evidence, "publication_status": status}).score_publication == 0
    r = ranked(spark, EXCLUDING, direction="functional analysis")
    assert r.level == "暂不优先" and "functional analysis" in r.warnings[0]
    r = ranked(spark, ROBOT, bio="He was born. Research interests include robot manipulation. More.")
    assert r.explicit_anchor and r.level == "可以考虑" and r.score == 30


def test_small_files_are_ranked_by_all_cores(spark):
    """One file of parts was ranked by one task (F4, F5)."""
    from dossier.plans import evidence_queries, record_queries

    cores = spark.sparkContext.defaultParallelism
    for query in (record_queries.ranked_people, evidence_queries.restored_levels):
        rows = query(spark, "/root/testdata/sf0.001")
        used = rows.select(F.spark_partition_id().alias("p")).distinct().count()
        assert used >= cores
        # What is ranked again is read from written rows, not ranked twice.
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_white_space(spark):
    """As the long class replaced run by run, but blanks that stand alone aren't touched (F4 to F9)."""
    rng = random.Random(4)
    spaces = [" ", " ", "  ", "\t", "\n", "\x1c", "\x85", "\u00a0", "\u2003", "\u3000", "\r\n"]
    texts = ["".join(rng.choice([*spaces, "a", "bc", "é", "王", "~", "!", "\U0001f600"]) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "i int, t string")
    got = {r.i: (r.new, r.old) for r in rows.select("i", text.collapse("t").alias("new"), F.trim(F.regexp_replace(F.coalesce("t", F.lit("")), text.SPACE, " ")).alias("old")).collect()}
    assert all(new == old for new, old in got.values())
    assert not re.search(text.UNEVEN, "one two three")


def test_texts_are_matched_once(spark):
    """What is read twice is written first, and a text is put into normal form once (F6, F9)."""
    from dossier.plans import evidence_queries, record_queries

    for query in (evidence_queries.joint_affiliations, record_queries.affiliation_cascade):
        rows = query(spark, "/root/testdata/sf0.001")
        assert "RLIKE" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_parsed_pages_leave_in_pieces(spark):
    """The results of a batch were held whole by the worker (F7)."""
    n = 2 * tables.PAGES + 3
    pages = spark.range(n).repartition(1).select("id", F.concat(F.lit("<a href='/"), "id", F.lit("'>t</a>")).alias("html"))
    got = pages.select("id", tables.parse_html(F.col("html")).alias("p")).collect()
    assert len(got) == n and all(r.p.links == [(f"/{r.id}", "t")] for r in got)


def test_publication_lines_by_plain_searches_first(spark):
    """Searches for what the patterns need change nothing (F8)."""
    lines = ["see 10.1000/ABC.9 there", "see 10.100/ABC.9 there", "ArXiv : 2101.00001v2", "preprint arXiv 21.1", "A title of some words, Journal 1999", "A title of some words, Journal 11999", "short 2001", "nan"]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, t string").select("i", text.is_publication(F.col("t")).alias("p"), text.split_entries(F.lit("a  b 2. c\t d 10) e1. f")).alias("e"))
    assert [r.p for r in rows.orderBy("i").collect()] == [True, False, True, False, True, False, False, False]
    assert rows.first().e == ["a b", "2. c d", "10) e1. f"]
    assert "Contains(" in text.is_publication(F.col("t"))._jc.toString() or text.is_publication(F.col("t"))._jc.toString().count("contains(") >= 4


def test_half_even(spark):
    rows = spark.range(401).select("id", *[ranking.half_even(F.col("id") * F.lit(c)).alias(n) for n, (c, _) in ranking.SOURCES.items()]).collect()
    assert all(r[n] == round(r["id"] * c) for r in rows for n, (c, _) in ranking.SOURCES.items())


def test_urls_and_ids(spark):
    n = identity.normalize_url(F.col("u"))
    assert one(spark, n, u="https://A.edu/x/?b=2&utm_source=q&a=1#top; http://other") == "https://a.edu/x?a=1&b=2"
    assert one(spark, n, u="ftp://a/") == "" and one(spark, n, u="https://a.edu") == "https://a.edu/"
    assert one(spark, n, u="http://a.edu/p?q=100%&r=x%20y") == "http://a.edu/p?q=100%25&r=x+y"
    g = identity.is_generic_url(F.col("u"))
    assert one(spark, g, u="https://a.edu/list.htm") and not one(spark, g, u="https://ai.fudan.edu.cn/abc/list.htm")
    names = ("profile_url", "personal_url", "email", "name", "title", "department", "ordinal")

    def basis(**given):
        return one(spark, identity.identity_basis(F.lit("s"), F.lit("c"), {k: F.lit(given.get(k, "")) for k in names}))

    assert tuple(basis(profile_url="https://a.edu/z http://a.edu/p?utm_x=1", personal_url="https://b.io/me")) == ("url", "s|http://a.edu/p")
    assert tuple(basis(email="B@x.cn a@x.cn")) == ("email", "s|a@x.cn")
    assert basis(name="Li  Wei", ordinal="3").basis == "s|c|liwei||||3"


def test_publication_text(spark):
    assert one(spark, text.normalize_doi(F.col("d")), d="https://doi.org/10.1000/Robust.1).") == "10.1000/robust.1"
    assert one(spark, text.normalize_arxiv_id(F.col("d")), d="arXiv: 2401.01234v3") == "2401.01234"
    assert one(spark, text.normalized_title(F.col("d")), d="A \\emph{Robust} ＡＢ $x$") == "arobustabx"
    keep = text.is_publication(F.col("d"))
    lines = {"X. Li, A robust estimator, Journal of Statistics, 2024.": True, "2019.09 至 2023 PhD at X University 2019": False,
             "国家自然科学基金项目 主持 2024 1234567": False, "doi 10.1000/abc.def something": True, "short 2024": False, "获得优秀教学奖 2024 年度的奖励": False}
    assert {k: one(spark, keep, d=k) for k in lines} == lines
    assert one(spark, text.split_entries(F.col("d")), d="1. First 10.1/a.2 x 2. Second\n\n third") == ["1. First 10.1/a.2 x", "2. Second", "third"]
    assert one(spark, text.norm_text(F.col("d")), d=" a　 b\x1c\n c ") == "a b c" and one(spark, text.norm_text(F.col("d")), d="NaN") == ""
    assert one(spark, text.labelled_value(F.col("d"), "电话", ["邮箱"]), d="姓名 李 电话： 123 邮箱 a@b.c") == "123"
    assert one(spark, text.snippet(F.col("d"), F.lit("xx"), 2), d="abcdxxefgh") == "cdxxef"


def test_dates(spark):
    assert one(spark, dates.valid_date(F.col("d")), d="2024-02-30") is None and one(spark, dates.valid_date(F.col("d")), d="2024-02-29") == "2024-02-29"
    assert one(spark, dates.minute(F.col("d")), d="2026-07-15 09:30:45") == "2026-07-15T09:30" and one(spark, dates.minute(F.col("d")), d="soon") == ""
    assert dates.recent_years(2026, 5) == (2022, 2026)


def slow_greedy(rows):
    seen, out = {}, {}
    for o, keys in sorted(rows):
        out[o] = next((seen[k] for k in keys if k in seen), o)
        for k in keys:
            seen.setdefault(k, out[o])
    return out


def test_greedy_groups(spark):
    rng = random.Random(8)
    for rows in ([(1, ["A"]), (2, ["B"]), (3, ["A", "B"])], [(i, rng.sample("abcdefghijklmnopqrstuvwxyz", rng.randint(0, 2))) for i in range(40)]):
        df = spark.createDataFrame(rows, "o long, keys array<string>").repartition(3)
        assert {r.o: r.group for r in dedup.greedy_groups(df, "o", "keys").collect()} == slow_greedy(rows)


def test_works(spark):
    rows = [
        (1, "arxiv", "", "", "2401.00001", "Robust estimation of large networks", 2024, ["A Li"], True),
        (2, "zbmath", "z1", "10.1000/robust.1", "", "Robust estimation of large networks.", 2025, ["A Li", "B Wu"], False),
        (3, "openalex", "", "", "", "Robust estimation of large networkz", 2025, ["C Xu"], False),
        (4, "openalex", "", "10.1000/ROBUST.1".lower(), "", "Other title", 2020, None, False),
    ]
    df = spark.createDataFrame(rows, "record_id long, source string, source_id string, doi string, arxiv_id string, title string, year int, authors array<string>, is_preprint boolean")
    groups = works.fuzzy_works(df)
    assert {r.record_id: r.work_id for r in groups.collect()} == {1: 1, 2: 1, 3: 3, 4: 1}
    main = {r.work_id: r for r in works.roll_up(df, groups).collect()}[1]
    assert (main.canonical_id, main.year, main.is_preprint, main.n_records) == ("doi:10.1000/robust.1", 2025, False, 3)


WORK = "record_id long, source string, source_id string, doi string, arxiv_id string, title string, year int, authors array<string>"


def slow_works(rows):
    names = WORK.replace("array<string>", "").replace("int", "").replace("string", "").replace("long", "").replace(" ", "").split(",")
    groups, out = [], {}
    for row in sorted(rows):
        r = dict(zip(names, row, strict=True))
        r |= {"title_key": re.sub("[^a-z0-9]", "", (r["title"] or "").lower()), "author_keys": [re.sub("[^a-z0-9]", "", a.lower()) for a in r["authors"] or []]}
        home = next((g for g in groups if any(works.same_work(r, o) for o in g)), None)
        if home is None:
            groups.append(home := [])
        home.append(r)
        out[r["record_id"]] = home[0]["record_id"]
    return out


def test_alike_titles_like_the_sequential_fold(spark):
    long = "Robust estimation of large sparse networks under noise"
    near = [(1, "s", "", "", "", long, 2024, ["A Li"]), (2, "t", "", "", "", long.replace("sparse", "sparze"), 2025, ["A. Li", "B"]),
            (3, "t", "", "", "", long.replace("noise", "noises"), 2030, ["A Li"]), (4, "t", "", "", "", long.replace("R", "r") + "x", None, ["C"])]
    got = {r.record_id: r.work_id for r in works.fuzzy_works(spark.createDataFrame(near, WORK)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4} == slow_works(near)
    rng = random.Random(3)
    words = ["estimation", "of", "networks", "robust", "large", "sparse", "noise", "bounds", "graph"]
    base = [" ".join(rng.choices(words, k=n)) for n in (1, 2, 6, 8, 9, 30, 60)]
    rows = []
    for i in range(160):
        title = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            title[rng.randrange(len(title))] = rng.choice(("", "q", "zz"))
        rows.append((i, rng.choice("st"), rng.choice(("", "", "", "1", "2")), rng.choice(("", "", "", "", "d1", "d2", "d3")), rng.choice(("", "", "", "", "x1", None)),
                     "".join(title), rng.choice((None, 2020, 2021, 2022)), rng.choice((None, [], ["A"], ["B", "A"], ["C"]))))
    got = {r.record_id: r.work_id for r in works.fuzzy_works(spark.createDataFrame(rows, WORK).repartition(3)).collect()}
    assert got == slow_works(rows)


def edited(rng, title, times):
    letters = list(title)
    for _ in range(times):
        letters[rng.randrange(len(letters))] = rng.choice(("", "q", "zz", "a"))
    return "".join(letters)


def long_titles(rng, n, rare):
    """Titles of syllables, of lengths on both sides of all levels, with near copies, and letters that are rare in them."""
    parts = "the of ing tion er an re st ou ble ly en".split()
    out = []
    for size in (90, 180, 205, 320, 590, 640, 1500, 2350, 2500, 3900, 4200) * n:
        words = "".join(rng.choices(parts, k=size // 2))[:size]
        base = "".join(rng.choice("kqvxz") if rng.random() < rare else c for c in words)
        out += [base] + [edited(rng, base, rng.randint(1, max(2, size // rng.choice((12, 25, 60, 400))))) for _ in range(2)]
    return out


def test_alike_titles_give_the_ratio_of_the_matcher():
    rng = random.Random(5)
    for rare in (0, 0.01, 0.04, 0.2):
        titles = long_titles(rng, 1, rare)
        pairs = [(a, b) for i in range(0, len(titles), 3) for a in titles[i : i + 3] for b in titles[i : i + 3] if a != b]
        pairs += [(a, a[:-3] + b[:9]) for a, b in zip(titles, titles[3:], strict=False)]
        want = [SequenceMatcher(None, a, b).ratio() >= 0.94 for a, b in pairs]
        assert [works.alike_titles(a, b) for a, b in pairs] == want and any(want)
        assert all(works._may_be_alike(a, b) for (a, b), w in zip(pairs, want, strict=True) if w)


def test_blocks_are_those_of_the_matcher_without_its_visits_of_all_letters():
    rng = random.Random(11)
    for rare in (0, 0.01, 0.2):
        titles = long_titles(rng, 1, rare)
        for a, b in zip(titles, titles[1:], strict=False):
            matcher, find = SequenceMatcher(None, a, b), works._finder(a, b)
            for _ in range(6):
                alo, blo = rng.choice(((0, 0), (rng.randrange(len(a)), rng.randrange(len(b)))))
                place = (alo, rng.randint(alo, len(a)), blo, rng.randint(blo, len(b)))
                assert tuple(find(*place)) == tuple(matcher.find_longest_match(*place))


def test_marks_are_few_and_equal_titles_and_letters_meet_without_a_group_each():
    rng = random.Random(13)
    titles = [t for t in long_titles(rng, 1, 0.02) if len(t) > 1000]
    rows = pd.DataFrame({"title_key": titles, "bys": [[5]] * len(titles), "nodes": [[i] for i in range(len(titles))]})
    rows["n"], rows["need"] = [len(t) for t in titles], [works._shared(works._codes(t)) for t in titles]
    marks = pd.concat(works._marked(iter([rows])))
    assert 0 < len(marks) < 0.15 * sum(map(len, titles)) and len(marks) == len(marks[["h", "node"]].drop_duplicates())
    letters = [works._letters(works._codes(t)) for t in titles]
    dealt = pd.concat([rows.assign(kind=range(len(titles)), author=5, year=float("nan")), pd.DataFrame(letters, columns=works.COUNTS)], axis=1)
    dealt["need"] = -dealt["n"]
    got = set(works._beside(dealt, dealt).itertuples(index=False, name=None))
    assert got == {
        (i, j) for i, a in enumerate(titles) for j, b in enumerate(titles)
        if i != j and 94 * max(len(a), len(b)) <= 106 * min(len(a), len(b)) and 200 * np.minimum(letters[i], letters[j]).sum() >= 94 * (len(a) + len(b))
    }


def test_equal_titles_like_the_rule(spark):
    rng = random.Random(17)
    title = "robust estimation of large networks"
    rows = [(i, rng.choice("st"), rng.choice(("", "1", "2")), rng.choice(("", "", "d1", "d2")), rng.choice(("", "", "x1", "x2")), title,
             rng.choice((None, 2020, 2021, 2022)), rng.choice(([], ["a"], ["a", "b"], ["c"]))) for i in range(60)]
    brief = spark.createDataFrame([(*r, "t:same") for r in rows], WORK.replace("record_id", "kind").replace("title ", "title_key ").replace("authors", "author_keys") + ", key string")
    names = ["kind", "source", "source_id", "doi", "arxiv_id", "title_key", "year", "author_keys"]
    dicts = [dict(zip(names, r, strict=True)) for r in rows]
    got = sorted((r.a, r.b) for r in works._equal(brief).collect())
    assert got == sorted((a["kind"], b["kind"]) for a in dicts for b in dicts if a["kind"] != b["kind"] and works.same_work(a, b))


def test_only_titles_that_may_be_alike_are_compared(spark):
    rng = random.Random(7)
    titles = [t for rare in (0, 0.02, 0.06) for t in long_titles(rng, 2, rare)]
    rows = [(i, ["a"], t) for i, t in enumerate(titles)]
    kinds = spark.createDataFrame(rows, "kind long, author_keys array<string>, title_key string").withColumn("year", F.lit(None).cast("int"))
    columns = "kind long, author_keys array<string>, title_key string, year int, n int, need int, " + ", ".join(f"{c} int" for c in works.COUNTS)
    got = {(r.x, r.y) for r in works._candidates(kinds.mapInPandas(works._sized, columns)).collect()}
    want = {(i, j) for i in range(len(titles)) for j in range(i + 1, i + 3 - i % 3) for a, b in ((titles[i], titles[j]), (titles[j], titles[i]))
            if j < len(titles) and SequenceMatcher(None, a, b).ratio() >= 0.94}
    assert len(want) > 20 and want <= got
    banded = sum(0.94 / 1.06 <= len(a) / len(b) <= 1.06 / 0.94 for i, a in enumerate(titles) for b in titles[:i])
    assert len(got) < banded / 4


def test_contained_titles_beyond_a_slice(spark):
    texts = spark.createDataFrame([(i, f"a{i} b{i + 1} c") for i in range(30)], "doc_id int, text string")
    titles = spark.createDataFrame([(i, f"{'ab'[i % 2]}{i} ") for i in range(25)] + [(99, None)], "item_id int, title string")
    want = sorted((r.doc_id, r.item_id) for r in works.contained_titles(texts, titles, "text", "title").collect())
    got = sorted((r.doc_id, r.item_id) for r in works.contained_titles(texts, titles, "text", "title", most_bytes=300).collect())
    assert got == want == sorted((d, i) for d in range(30) for i in range(25) if f"{'ab'[i % 2]}{i} " in f"a{d} b{d + 1} c")


def test_authors(spark):
    df = spark.createDataFrame([(1, "a", 12), (1, "b", 9), (2, "c", 5)], "p long, c string, s int")
    got = {r.p: (r.c, r.margin) for r in authors.best_with_margin(df, ["p"], F.col("s"), [F.col("c")]).collect()}
    assert got == {1: ("a", 3), 2: ("c", None)}
    level = authors.catalogue_confidence("zbmath", F.lit(9), F.lit(False), F.lit(1), F.lit(2))
    assert one(spark, level) == "low"


def test_contact_store(spark):
    raw = spark.createDataFrame([("k1", "不考虑", "2026-02-30", "已发；已回、已发", "2026-07-15 09:30:45", " n "), ("k2", "?", "", "", "", "")],
                                "row_key string, status string, contacted_at string, responses string, interview_at string, note string")
    got = contact.normalize(raw).collect()
    assert [tuple(r) for r in got] == [("k1", "先不考虑", "", ["已发", "已回"], "2026-07-15T09:30", "n")]
    rows = spark.createDataFrame([("k1", "z", "own"), ("q", "k1", "own"), ("q", "z", "own")], "a string, b string, note string")
    store = contact.normalize(raw).select("row_key", "status", "note")
    assert sorted(r.note for r in contact.overlay(rows, store, "a", "b", ["status", "note"]).collect()) == ["n", "n", "own"]
    assert [r.note for r in contact.overlay(rows, store, "a", "b", ["status", "note"], authoritative=True).collect()].count(None) == 1
    people = spark.createDataFrame([(1, "A"), (2, "A")], "pid long, name string")
    detail = spark.createDataFrame([(1, "A", "x"), (None, "A", "y"), (3, "A", "z")], "pid long, name string, v string")
    assert sorted((r.pid, r.v) for r in dashboard.details(people, detail, "pid", "name").collect()) == [(1, "x"), (2, "y")]


def test_sampling():
    rows = [{"category": c, "id": f"{c}{i}", "school": f"s{i // 3}", "target": f"t{i // 2}"} for c in "ab" for i in range(6)]
    picked = audit.constrained_pick(rows, ["a", "b"], 2)
    assert len({p["id"] for p in picked}) == 4 and all([p["school"] for p in picked].count(s) <= 2 for s in "s0 s1".split())
    with pytest.raises(ValueError):
        audit.constrained_pick(rows[:1], ["a"], 2)


def test_checkpoints(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, mark string")
    saved = spark.createDataFrame([(1, "a"), (2, "x")], "k long, mark string")
    stated = audit.checkpoint_state(rows, saved, "k", "mark")
    assert tuple(audit.coverage(stated).first()) == (3, 1, 1, 1, 0.3333)
    done, todo = incremental.split_work(rows, saved, "k", "mark")
    assert (done.count(), todo.count()) == (1, 2)
    assert audit.require_full(stated, partial=True).count() == 3
    with pytest.raises(Exception, match="no valid checkpoint"):
        audit.require_full(stated).collect()


def test_stores(spark, tmp_path):
    schema = StructType().add("k", "string").add("seq", "long").add("v", "string")
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text('{"k": "x", "seq": 1, "v": "old"}\n\n{"k": "x", "seq": 2, "v": "new"}\n{broken\n')
    last, bad = tables.read_log(spark, str(tmp_path / "log"), schema, "k", "seq")
    assert [tuple(r) for r in last.collect()] == [("x", 2, "new")] and bad.count() == 1
    store = {"version": 4, "statuses": {"k1": {"status": "不可能"}, "k2": {"status": ""}}}
    (tmp_path / "s.json").write_text(json.dumps(store, indent=1))
    assert {r.row_key for r in tables.read_store(spark, str(tmp_path / "s.json"), "status string").collect()} == {"k1", "k2"}
    (tmp_path / "bad.json").write_text("{nope")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        tables.read_store(spark, str(tmp_path / "bad.json"), "status string").collect()
    assert tables.first_table(spark, str(tmp_path), ["no", "none"], schema).count() == 0
    page = "<html><meta name='author' content='Li'><script>x()</script><p>Hi <a href='/a'>link</a>"
    got = one(spark, tables.parse_html(F.col("h")), h=page)
    assert got.text == "Li Hi link" and [(x.href, x.text) for x in got.links] == [("/a", "link")]


def test_stream_keeps_the_last_entry(spark, tmp_path):
    schema = StructType().add("k", "string").add("seq", "long").add("v", "string").add("deleted", "boolean")
    (tmp_path / "in").mkdir()

    def run(name, *lines):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(schema.names, x, strict=True))) for x in lines))
        q = incremental.maintain_store(incremental.read_appended(spark, str(tmp_path / "in"), schema), str(tmp_path / "store"), str(tmp_path / "cp"), "k", "seq")
        q.awaitTermination()
        return sorted(map(tuple, incremental.read_store(spark, str(tmp_path / "store")).select("k", "v").collect()))

    assert run("1.json", ("a", 1, "x", False), ("b", 2, "y", False)) == [("a", "x"), ("b", "y")]
    assert run("2.json", ("a", 5, "z", False), ("b", 6, None, True)) == [("a", "z")]


def test_evidence(spark):
    link = evidence.unwrap_redirect(F.col("u"))
    assert one(spark, link, u="https://bing.com/ck/a?u=a1aHR0cHM6Ly9hLmVkdS94&p=1") == "https://a.edu/x"
    assert one(spark, link, u="https://duckduckgo.com/l/?uddg=https%3A%2F%2Fa.edu%2Fy&rut=1") == "https://a.edu/y"
    assert one(spark, link, u="https://a.edu") == "https://a.edu"
    kind = evidence.response_class(F.col("s"), F.col("c"), F.col("b"))
    cases = [(503, "", "", "retry"), (404, "", "", "request_failed"), (200, "text/html", "Accept the terms", "terms_required"),
             (200, "", " <!DOCTYPE html>", "schema_changed"), (200, "application/json", "{}", "ok")]
    assert all(one(spark, kind, s=s, c=c, b=b) == want for s, c, b, want in cases)
    assert one(spark, evidence.first_number(F.col("a"), F.col("b")), a="", b="3") == 3.0
    assert one(spark, evidence.best_confidence(F.array(F.col("a"), F.col("b"))), a="低", b="中") == "中"
    entries = F.array(F.struct(F.lit("2024").alias("date"), F.lit("T").alias("title"), F.lit("math").alias("classes"), F.lit("u").alias("link")))
    assert one(spark, evidence.entries_text(entries)) == "[2024] T (math) u"
