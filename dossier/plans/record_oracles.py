"""SQL with the same rows as the queries of ``record_queries``."""

from __future__ import annotations

from dossier.operators.manifest import canonical
from dossier.operators.ranking import EXCLUDED, NO_ANCHOR, ONE_GROUP, SAID, TOO_WEAK
from dossier.operators.sections import PLACE, TAIL
from dossier.plans.record_queries import RANK_PROFILE, RUN

_KEYWORDS = ", ".join(f"({i}, '{kw}', {w})" for i, (kw, w) in enumerate(RANK_PROFILE.weights) if w > 0)
_CORE = ", ".join(f"'{k}'" for k in RANK_PROFILE.core)
_TEXTS = {"official": ("official", 4), "dblp": ("p_type || ' ' || p_name", 4), "publication": ("p_name", 8), "arxiv": ("p_name", 4), "web": ("p_type", 4), "web_search": ("p_name", 4)}
_SHARES = {"dblp": (0.45, 24), "publication": (0.35, 18), "arxiv": (0.2, 10), "web": (0.18, 8), "web_search": (0.15, 6)}
_TRUST = {
    "dblp": "p_partkey % 2 = 0", "publication": "p_partkey % 3 < 2 AND p_partkey % 5 <> 0", "arxiv": "p_partkey % 7 = 0",
    "web": "p_partkey % 2 = 1", "web_search": "p_partkey % 11 = 0",
}


def _holds(text: str, word: str = "kw") -> str:
    return f"regexp_matches(lower({text}), '(^|[^a-z0-9])' || {word} || '($|[^a-z0-9])')"


def _scored(name: str, text: str, most: int) -> str:
    """Common tables that end in ``sc_name``: score and keywords of a text, by the rules of aliases, overlaps and the cap."""
    return f"""
m_{name} AS (SELECT p_partkey, kw.* FROM base, kw WHERE {_holds(text)}),
a_{name} AS (SELECT * FROM m_{name} WHERE kw NOT IN ('gear', 'anvil') UNION ALL
  SELECT p_partkey, -1, kw, w FROM m_{name} WHERE kw IN ('gear', 'anvil')
  QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY w DESC, length(kw) DESC, CASE kw WHEN 'gear' THEN 0 ELSE 1 END) = 1),
k_{name} AS (SELECT x.* FROM a_{name} x WHERE NOT EXISTS (SELECT 1 FROM a_{name} y WHERE y.p_partkey = x.p_partkey AND length(y.kw) > length(x.kw) AND contains(y.kw, x.kw))),
c_{name} AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY length(kw) DESC, w DESC, ord) AS r FROM k_{name} QUALIFY r <= {most}),
sc_{name} AS (SELECT p_partkey, sum(w)::INT AS s_{name}, list(kw ORDER BY r) AS kw_{name} FROM c_{name} GROUP BY 1)"""


_SCORES = ",".join(_scored(n, t, m) for n, (t, m) in _TEXTS.items())
_JOINS = " ".join(f"LEFT JOIN sc_{n} USING (p_partkey)" for n in _TEXTS)
_SUBS = ",\n  ".join(
    f"CASE WHEN anchored AND {_TRUST[n]} THEN least(round_even(coalesce(s_{n}, 0) * {share}::DOUBLE, 0)::INT, {cap}) ELSE 0 END AS score_{n}" for n, (share, cap) in _SHARES.items()
)
_OWN = ", ".join(f"CASE WHEN anchored AND {_TRUST[n]} THEN coalesce(kw_{n}, []) ELSE [] END" for n in _SHARES)
_COUNTED = ", ".join(f"CASE WHEN score_{n} > 0 THEN '{SAID[n][0]}' END" for n in _SHARES)
_BACK = ", ".join(f"CASE WHEN NOT (anchored AND {_TRUST[n]}) AND coalesce(s_{n}, 0) > 0 THEN '{SAID[n][1]}' END" for n in _SHARES if SAID[n][1])
_GROUPS = ", ".join(f"CASE WHEN list_has_any(matched, {list(terms)}) THEN '{name}' END" for name, terms in RANK_PROFILE.direction_groups.items())

RANKED = f"""WITH kw(ord, kw, w) AS (VALUES {_KEYWORDS}),
base AS (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS direction,
  CASE WHEN p_partkey % 3 = 0 THEN '研究方向 ' || p_name || '. ' || p_type ELSE p_type END AS bio,
  direction || ' ' || CASE WHEN p_partkey % 3 = 0 THEN bio ELSE '' END AS explicit, direction || ' ' || bio || ' ' || p_brand AS official FROM part),
core AS (SELECT p_partkey, list(kw ORDER BY kw) AS cores FROM base, kw WHERE kw IN ({_CORE}) AND {_holds("explicit")} GROUP BY 1),{_SCORES},
b AS (SELECT *, coalesce(len(cores), 0) > 0 AS anchored, {_holds("official", "'cold'")} AS excluded,
  CASE WHEN contains(lower(p_brand), 'brand#12') THEN 8 WHEN contains(lower(p_brand), 'brand#1') THEN 4 WHEN contains(lower(p_brand), 'brand#3') THEN 6 ELSE 0 END AS bonus
  FROM base LEFT JOIN core USING (p_partkey) {_JOINS}),
s AS (SELECT *, least(coalesce(s_official, 0) + CASE WHEN anchored THEN bonus ELSE 0 END, 80) AS score_official,
  {_SUBS},
  list_distinct(flatten([coalesce(kw_official, []), CASE WHEN bonus > 0 THEN ['bonus'] ELSE [] END, {_OWN}])) AS matched FROM b),
g AS (SELECT *, score_dblp + score_publication + score_arxiv + score_web + score_web_search AS second, list_filter([{_GROUPS}], lambda x: x IS NOT NULL) AS groups FROM s),
t AS (SELECT *, len(groups) >= 2 OR second > 0 AS grouped, CASE WHEN anchored THEN score_official + second ELSE least(score_official + second, 23) END AS score FROM g),
l AS (SELECT *, CASE WHEN NOT anchored THEN '暂不优先' WHEN score >= 44 AND grouped THEN '强烈建议' WHEN score >= 24 THEN '可以考虑' ELSE '暂不优先' END AS level FROM t)
SELECT p_partkey, score, level, CASE WHEN level = '暂不优先' THEN '否' ELSE '是' END AS can_contact, anchored AS explicit_anchor, len(matched)::INT AS n_matched,
  array_to_string(groups, ';') AS groups,
  concat_ws('|', CASE WHEN level = '强烈建议' THEN '官方方向明确命中核心方向：' || array_to_string(cores[1:4], '; ') WHEN level = '可以考虑' THEN '官方方向命中核心方向：' || array_to_string(cores[1:4], '; ') END,
    {_COUNTED},
    CASE WHEN NOT anchored AND excluded THEN '{EXCLUDED}' WHEN NOT anchored THEN '{NO_ANCHOR}' WHEN score < 24 THEN '{TOO_WEAK}' WHEN score >= 44 AND NOT grouped THEN '{ONE_GROUP}' END) AS reasons,
  concat_ws('|', CASE WHEN excluded THEN '当前画像排除方向命中：cold' END, {_BACK}) AS warnings,
  score_official, score_dblp, score_publication, score_arxiv, score_web, score_web_search FROM l"""

_HOST = "regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1)"
_CLASS = f"""CASE WHEN regexp_matches(lower(url), 'baidu\\.com|bing\\.com|duckduckgo\\.com|google\\.com/search|sogou\\.com|so\\.com') THEN 'blocked'
  WHEN SCHOOL ends_with({_HOST}, 'edu.cn') OR ends_with({_HOST}, '.edu') THEN 'official'
  WHEN ends_with({_HOST}, 'github.io') OR {_HOST} IN ('github.com', 'sites.google.com') THEN 'personal_or_project'
  WHEN regexp_matches({_HOST}, 'dblp|arxiv|aclanthology|openreview|ieee|acm\\.org|springer') THEN 'paper' ELSE 'other' END"""
_SJTU = f"ends_with({_HOST}, 'sjtu.edu.cn') OR ends_with({_HOST}, 'sjtu.edu') OR"

_NEW = "(SELECT doc_id, unnest(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10))) AS raw, generate_subscripts(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)), 1) - 1 AS pos FROM documents)"
_LINES = f"lines AS (SELECT doc_id, pos, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS line FROM {_NEW} WHERE trim(regexp_replace(raw, '\\s+', ' ', 'g')) <> '')"

_MARK = "concat_ws(chr(31), c_custkey::VARCHAR, json_object(" + ", ".join(
    f"'{c}', " + {"name": "c_name", "direction": "c_mktsegment", "bio": "CASE WHEN c_nationkey > 3 THEN 'x' ELSE '' END"}.get(c, "''")
    for c in sorted(
        "name profile_url personal_url email direction registry_direction team_evidence bio dblp_confidence dblp_url dblp_keywords dblp_titles publication_status "
        "publication_confidence author_id openalex_id zbmath_author_id seed_hash decision_hash source_report_hash works_hash publication_classes publication_keywords publication_titles".split()
    )
) + f")::VARCHAR, '{canonical(RUN.settings())}')"

_LEVEL = "(['强烈建议', '可以考虑', '暂不优先'])[(({}) % 3)::INT + 1]"
_PLACE = "(CASE {} WHEN '强烈建议' THEN 2 WHEN '可以考虑' THEN 1 ELSE 0 END)"
_JUDGED = f"""WITH j AS (SELECT c_custkey AS sample_id, CASE WHEN c_custkey % 10 = 0 THEN 'zero_weight_sentinel' ELSE 'main' END AS category, {_LEVEL.format("c_custkey")} AS old_level,
  {_LEVEL.format("floor(c_acctbal / 100)::BIGINT + 1000")} AS manual_level, {_LEVEL.format("c_nationkey")} AS new_level, c_custkey % 7 > 0 AS new_anchor FROM customer),
v AS (SELECT *, abs({_PLACE.format("old_level")} - {_PLACE.format("manual_level")}) AS old_error, abs({_PLACE.format("new_level")} - {_PLACE.format("manual_level")}) AS new_error FROM j)"""

_SIGNALS = """WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS a, list_filter(list_transform(regexp_split_to_array(replace(lower(p_type), ' ', '。,'), '[;；,，、|]+'), lambda x: trim(x)), lambda x: x <> '') AS b,
  [p_name, upper(p_type)] AS c FROM part),
k AS (SELECT *, list_transform(a, lambda x: lower(x)) AS ka, list_transform(b, lambda x: trim(regexp_replace(lower(x), '[。.]$', ''))) AS kb, list_transform(c, lambda x: lower(x)) AS kc FROM p),
f AS (SELECT *, list_filter(a, lambda x, i: list_position(ka, lower(x)) = i) AS fa,
  list_filter(b, lambda x, i: kb[i] <> '' AND list_position(kb, kb[i]) = i AND NOT list_contains(ka, kb[i])) AS fb,
  list_filter(c, lambda x, i: list_position(kc, kc[i]) = i AND NOT list_contains(ka, kc[i]) AND NOT list_contains(kb, kc[i])) AS fc FROM k)
SELECT p_partkey, concat_ws(';', CASE WHEN len(fa) > 0 THEN 'name=' || array_to_string(fa, '+') END, CASE WHEN len(fb) > 0 THEN 'type=' || array_to_string(fb, '+') END,
  CASE WHEN len(fc) > 0 THEN 'both=' || array_to_string(fc, '+') END) AS chips FROM f"""

ORACLE_SQL = {
    "ranked_people": RANKED,
    "catalogue_gate": "SELECT c_custkey FROM customer WHERE c_acctbal > 2000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND right(c_name, 1) IN ('1', '3', '5')",
    "publication_query_gate": "SELECT c_custkey FROM customer WHERE c_nationkey < 3 OR c_acctbal > 9000",
    "host_classes": f"""WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id, (['https://www.baidu.com', 'http://cs.sjtu.edu', 'https://a.edu.cn', 'https://x.github.io', 'https://github.com',
      'https://dblp.org', 'https://www.so.com', 'http://mit.edu'])[page_id % 8 + 1] || '/p' || page_id FROM pages) SELECT page_id, url, {_CLASS.replace("SCHOOL", _SJTU)} AS host_class FROM u""",
    "accepted_results": f"""SELECT page_id, url FROM pages WHERE {_CLASS.replace("SCHOOL", "")} <> 'blocked' AND page_id % 3 < 2
      AND (page_id % 4 = 0 OR page_id % 5 = 0 OR regexp_matches(url, '(^|\\D)(19|20)\\d\\d(\\D|$)'))""",
    "curated_items": """WITH p AS (SELECT c_custkey AS id, floor(c_custkey / 3 * 2) AS name FROM customer), i AS (SELECT s_suppkey AS item, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 3 END AS id, floor(s_suppkey / 3 * 2) AS name FROM supplier),
      n AS (SELECT name, min(id) AS id FROM p GROUP BY 1 HAVING count(*) = 1)
      SELECT item, coalesce(p.id, n.id) AS row_id FROM i LEFT JOIN p ON p.id = i.id LEFT JOIN n ON i.id IS NULL AND n.name = i.name WHERE coalesce(p.id, n.id) IS NOT NULL""",
    "applied_curation": "SELECT page_id, '人工确认-本地证据' AS status, greatest(page_id % 3, page_id % 4)::INT AS count, (page_id % 4)::INT AS n_links FROM pages",
    "search_fallback": """WITH p AS (SELECT *, string_split(p_type, ' ')[1] AS w FROM part), f AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type END AS first FROM p)
      SELECT p_partkey, CASE WHEN first IS NOT NULL AND (contains(first, w) OR (length('x' || p_size) >= 2 AND contains(first, 'x' || p_size))) THEN first ELSE p_name END AS titles FROM f""",
    "detail_rows": "SELECT p_partkey, p_brand, title, '高' AS confidence FROM (SELECT p_partkey, p_brand, unnest(string_split(p_name, ' ')) AS title FROM part) WHERE length(title) > 4",
    "merged_rows": """WITH d AS (SELECT source || ':' || floor(n_chars / 200)::BIGINT AS person, doc_id, coalesce(lang, '') AS title, trim(regexp_replace(left(coalesce(text, ''), 5), '\\s+', ' ', 'g')) AS email, doc_id % 3 AS k, source FROM documents),
      f AS (SELECT *, min(doc_id) OVER (PARTITION BY person) AS first, count(*) OVER (PARTITION BY person) AS n FROM d),
      v AS (SELECT person, c, v, min(doc_id) AS o FROM (SELECT person, 1 AS c, title AS v, doc_id FROM f UNION ALL SELECT person, 2, email, doc_id FROM f
        UNION ALL SELECT person, 3, '同目标重复记录合并：d' || k || ' @ ' || source, doc_id FROM f WHERE doc_id > first) WHERE v <> '' GROUP BY ALL),
      j AS (SELECT person, c, string_agg(v, '; ' ORDER BY o, v) AS t FROM v GROUP BY ALL)
      SELECT f.person, ' d' || k AS name, coalesce(a.t, '') AS title, coalesce(b.t, '') AS email, coalesce(c.t, '') AS note, n AS n_merged FROM f
      LEFT JOIN j a ON a.person = f.person AND a.c = 1 LEFT JOIN j b ON b.person = f.person AND b.c = 2 LEFT JOIN j c ON c.person = f.person AND c.c = 3 WHERE doc_id = first""",
    "candidate_decisions": """WITH p AS (SELECT l_partkey AS p_partkey, l_suppkey::VARCHAR AS author_id, l_suppkey, count(*) AS overlap, bool_or(l_returnflag = 'R') AS name, bool_or(l_discount > 0.08) AS orcid, bool_or(l_tax > 0.07) AS aff,
        bool_or(l_quantity > 49) AS conflict, bool_or(l_quantity < 2) AS strong FROM lineitem GROUP BY 1, 2, 3),
      s AS (SELECT p.*, overlap * 5 + CASE WHEN name THEN 4 ELSE 0 END AS score, coalesce(p.author_id IN ((part.p_partkey % 100)::VARCHAR, '7'), false) AS refused, name::INT + orcid::INT + aff::INT + 1 AS n FROM p LEFT JOIN part USING (p_partkey))
      SELECT p_partkey, author_id, CASE WHEN refused THEN 0 ELSE score END::INT AS score,
        CASE WHEN refused THEN '' ELSE concat_ws(';', CASE WHEN name THEN 'name' END, CASE WHEN orcid THEN 'orcid' END, CASE WHEN aff THEN 'affiliation' END, 'official_title_overlap:' || overlap) END AS signals,
        CASE WHEN refused THEN 'private_override_rejected_source_id' WHEN conflict THEN 'orcid_mismatch' ELSE '' END AS conflicts,
        CASE WHEN refused OR conflict THEN 'rejected' WHEN strong THEN 'confirmed' WHEN score >= 9 AND n >= 2 THEN 'probable' ELSE 'review' END AS decision FROM s""",
    "candidate_statuses": """WITH j AS (SELECT l_partkey AS p_partkey, count(*) AS n, count(*) FILTER (l_suppkey % 2 = 0) AS r FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
      SELECT p_partkey, CASE WHEN p_size = 7 THEN 'identity_rejected' WHEN p_size % 5 = 0 THEN 'missing_identity_seed' WHEN p_size = 9 THEN 'identity_confirmed' WHEN coalesce(n, 0) = 0 THEN 'no_candidate'
        WHEN r = n THEN 'identity_rejected' ELSE 'candidates' END AS status FROM part LEFT JOIN j USING (p_partkey)""",
    "official_statuses": """SELECT o_custkey, CASE WHEN n_recent > 0 THEN 'success' WHEN n_records > 0 THEN 'no_recent_record' ELSE 'no_record' END AS status, CASE WHEN n_recent > 0 THEN 'high' ELSE '' END AS confidence, n_records, n_recent
      FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_records, count(*) FILTER (o_orderstatus <> 'P' AND year(o_orderdate) = 2001) AS n_recent FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1)""",
    "chosen_authors": """SELECT DISTINCT l_partkey AS person, l_suppkey AS author_id FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size = 3
      WHERE l_suppkey = CASE WHEN p_partkey IS NOT NULL THEN 1 WHEN l_partkey % 50 < 10 THEN (l_partkey % 50) * 10 END""",
    "discovered_ids": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 > 0 THEN doc_id::VARCHAR ELSE 'old' END AS zbmath_id, CASE WHEN doc_id % 2 = 1 AND doc_id % 3 > 0 THEN doc_id::VARCHAR ELSE 'old' END AS openalex_id FROM documents""",
    "identity_seeds": """WITH r AS (SELECT *, s_suppkey IS NOT NULL AS o, CASE WHEN s_suppkey % 2 = 0 THEN s_name WHEN c_custkey % 3 = 0 THEN 'E ' || c_name ELSE '' END AS canonical FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey),
      n AS (SELECT *, concat_ws('|', nullif(canonical, ''), CASE WHEN o AND s_name <> canonical THEN s_name END, CASE WHEN o THEN 'Alias' END, c_mktsegment, CASE WHEN c_name <> canonical THEN c_name END, 'Found') AS al FROM r)
      SELECT c_custkey, canonical AS canonical_english_name, c_custkey::VARCHAR AS orcid, CASE WHEN o THEN 'O2' ELSE 'O1' END AS openalex_id, CASE WHEN o THEN 'Z' ELSE '' END AS zbmath_author_id, '' AS dblp_pid,
        CASE WHEN o THEN 'confirmed' ELSE 'automatic' END AS review_status, al AS aliases, CASE WHEN o THEN 'Inst|' ELSE '' END || c_mktsegment AS affiliations, c_name AS known_titles,
        array_to_string(string_split(al, '|')[1:2], '|') AS query_names FROM n""",
    "affiliation_cascade": r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS source, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents),
      a AS (SELECT doc_id, 'home' AS target, 1 AS rank, 'department' AS method, 'confirmed' AS status FROM d WHERE source IN ('src0', 'src1', 'source_1', 'web')
        UNION ALL SELECT doc_id, 'en', 2, 'profile', 'confirmed' FROM d WHERE regexp_matches(t, ' of the ')
        UNION ALL SELECT doc_id, 'de', 2, 'profile', 'confirmed' FROM d WHERE regexp_matches(t, ' und der | nicht ')
        UNION ALL SELECT doc_id, 'fr', 2, 'profile', 'confirmed' FROM d WHERE regexp_matches(t, ' dans ')
        UNION ALL SELECT doc_id, 'de', 3, 'override', CASE WHEN doc_id % 100 = 0 THEN 'reviewed' ELSE 'by hand' END FROM d WHERE doc_id % 50 = 0),
      b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY doc_id, target ORDER BY rank DESC) = 1)
      SELECT doc_id, target, status, method FROM b UNION ALL SELECT doc_id, 'home', 'pending', 'directory' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM b)""",
    "profile_ids": """SELECT p_partkey, p_partkey % 2 = 0 AS valid, 'custom-' || left(sha256(CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '-') ELSE p_name END), 12) AS custom FROM part""",
    "keyword_groups": """WITH p AS (SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS w FROM part)
      SELECT p_partkey, array_to_string(list_filter(w, lambda x: lower(x) IN ('small ring', 'ring', 'promo', 'economy')), ';') AS bridge,
        array_to_string(list_filter(w, lambda x: lower(x) NOT IN ('small ring', 'ring', 'promo', 'economy')), ';') AS core FROM p""",
    "section_lines": f"""WITH {_LINES},
      w AS (SELECT doc_id, pos, regexp_replace(line, '^(The|the|Der|der|La|la) ', 'publications: ') AS line FROM lines),
      n AS (SELECT *, regexp_replace(trim(lower(line)), '^[一二三四五六七八九十\\d]+[、.)）]\\s*', '') AS low FROM w),
      h AS (SELECT *, CASE WHEN instr(low, 'publications') BETWEEN 1 AND 3 AND (substr(low, instr(low, 'publications') + 12, 1) IN ('', '：', ':', '-', '—') OR length(low) <= 20) THEN 'open'
        ELSE (SELECT 'close' FROM (VALUES ('and '), ('und '), ('et '), ('que ')) m(x) WHERE instr(low, x) BETWEEN 1 AND 3 AND (substr(low, instr(low, x) + length(x), 1) IN ('', '：', ':', '-', '—') OR length(low) <= length(x) + 8) LIMIT 1) END AS kind FROM n),
      s AS (SELECT *, last_value(kind IGNORE NULLS) OVER w1 AS now, count(*) FILTER (kind = 'open') OVER w1 AS section,
        CASE WHEN kind = 'open' THEN regexp_replace(substr(line, instr(low, 'publications') + 12), '^[ ：:—-]+', '') ELSE line END AS rest FROM h WINDOW w1 AS (PARTITION BY doc_id ORDER BY pos))
      SELECT doc_id, pos AS "at", section, md5(rest) AS line_md5 FROM s WHERE now = 'open' AND rest <> ''""",
    "biographies": f"""WITH {_LINES},
      e AS (SELECT *, bool_or(contains(lower(line), 'the and') OR contains(lower(line), 'und der') OR contains(lower(line), 'que la')) OVER (PARTITION BY doc_id ORDER BY pos) AS ended FROM lines),
      k AS (SELECT * FROM e WHERE NOT ended AND NOT (regexp_matches(line, '(^|\\D)(19|20)\\d\\d(\\D|$)') AND length(line) > 80)),
      b AS (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos) - length(line) AS before FROM k),
      j AS (SELECT doc_id, left(string_agg(line, ' ' ORDER BY pos), 300) AS bio FROM b WHERE before < 300 GROUP BY 1)
      SELECT doc_id, length(bio) AS n_bio, md5(bio) AS bio_md5 FROM j""",
    "english_names": """WITH p AS (SELECT p_partkey, p_name, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS cap FROM part)
      SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 AND p_partkey % 2 = 1 THEN p_name WHEN p_partkey % 3 = 0 THEN cap ELSE cap || ' x' END AS name,
        CASE WHEN p_partkey % 3 = 0 THEN 'official_label' WHEN p_partkey % 3 = 1 AND p_partkey % 2 = 1 THEN 'official_meta' ELSE 'official_heading' END AS source FROM p""",
    "publication_sections": """WITH b AS (SELECT item_id, trim(left(regexp_replace(text, '\\s+', ' ', 'g'), 60)) AS t FROM benchmark)
      SELECT item_id, place, md5(place || '. ' || t || ', Journal of X, 2021.') AS line_md5 FROM b, range(1, 3) r(place)""",
    "printed_table": f"""WITH p AS (SELECT p_partkey, p_name, p_type, (length(p_name) <= 35 AND regexp_matches(p_name, '{PLACE}')) OR regexp_matches(p_name, '{TAIL}') AS tail FROM part)
      SELECT p_partkey, (p_partkey % 1000)::VARCHAR AS serial, '计算所' AS institute, '王小明' AS name, '教授' AS title, p_name || ' ' || p_type AS direction, 'a' || p_partkey || '@zju.edu.cn' AS email FROM p""",
    "team_mentions": """WITH n AS (SELECT doc_id, (['李明', '王小明', '欧阳小明', '张三', '赵四'])[doc_id % 5 + 1] AS name FROM documents WHERE doc_id % 7 = 0 OR (doc_id % 11 = 0 AND doc_id % 5 IN (1, 2))),
      r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS place FROM n) SELECT name, doc_id, place FROM r WHERE place <= 3""",
    "evidence_summary": """WITH o AS (SELECT o_custkey, o_custkey AS k, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, list(o_orderkey::VARCHAR ORDER BY o_orderdate, o_orderkey) AS titles FROM orders GROUP BY 1),
      z AS (SELECT *, CASE WHEN f > 0 THEN 'success/high' ELSE 'no_record' END AS a, CASE WHEN k % 3 = 0 THEN 'success' ELSE 'no_candidate' END || CASE WHEN k % 2 = 0 THEN '/medium' ELSE '' END AS b,
        CASE WHEN k % 5 = 0 THEN 'no_recent_record' ELSE 'identity_uncertain' END || CASE WHEN k % 7 > 1 THEN '/high' ELSE '/low' END AS c,
        CASE WHEN k % 5 = 0 AND k % 7 > 1 THEN 'openalex' WHEN k % 3 = 0 AND k % 2 = 0 THEN 'zbmath' WHEN f > 0 THEN 'official' ELSE '' END AS best FROM o)
      SELECT o_custkey, 'official:' || a || '; zbmath:' || b || '; openalex:' || c AS status, CASE best WHEN 'openalex' THEN 'high' WHEN 'zbmath' THEN 'medium' WHEN 'official' THEN 'high' ELSE '' END AS confidence,
        CASE WHEN best = '' THEN '' ELSE best || k END AS author_id, 'u:zbmath' AS zbmath_url, 'openalex' || k AS openalex_id, CASE WHEN k % 4 <> 0 THEN '' WHEN best = '' THEN 'zbmath-o' ELSE best || '-o' END AS orcid,
        concat_ws('；', CASE WHEN f > 0 THEN 'official' END, CASE WHEN f > 0 THEN 'c' END, CASE WHEN k % 3 = 0 THEN 'zbmath' END, CASE WHEN f = 0 AND k % 3 = 0 THEN 'c' END) AS classes_unordered,
        CASE WHEN k % 2 = 0 THEN 'a' ELSE 'a；c' END AS core_keywords, CASE WHEN k % 2 = 0 THEN 'b；c' ELSE 'b' END AS bridge_keywords, n::INT AS n_works, array_to_string(titles[1:5], '；') AS titles,
        CASE WHEN k % 2 = 0 THEN 'official:official; zbmath:zbmath; openalex:openalex' ELSE '' END AS reasons FROM z""",
    "row_marks": f"SELECT c_custkey, sha256({_MARK}) AS mark FROM customer",
    "rebuilt_rows": """WITH l AS (SELECT user_id, max(event_id) AS e, arg_max(event_type, event_id) AS t FROM events GROUP BY 1)
      SELECT c_custkey, c_mktsegment, coalesce(t, '未深检索-时间/同名风险') AS arxiv_status, coalesce(e::VARCHAR, '') AS arxiv_keywords FROM customer LEFT JOIN l ON user_id = c_custkey""",
    "saved_evidence": """SELECT p_partkey, (p_size % 3 + 1)::INT AS n_papers, array_to_string((['2020', '2021', '2022'])[1:(p_size % 3 + 1)::INT], ';') AS years, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS keywords,
      replace(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type END, ' ', ';') AS snippets FROM part""",
    "stage_states": "SELECT n_name AS stage, CASE WHEN n_regionkey >= 3 THEN 'profile_changed' WHEN n_nationkey % 2 = 1 THEN 'content_changed' ELSE 'same' END AS state FROM nation",
    "semantic_cache": """WITH g AS (SELECT p_brand, p_size, p_name, p_type, max(p_partkey) FILTER (p_partkey % 4 = 0) AS a, max(p_partkey) FILTER (p_partkey % 4 = 1) AS b FROM part GROUP BY ALL)
      SELECT p_partkey, CASE WHEN a IS NOT NULL THEN 'cache' WHEN b IS NOT NULL THEN 'through' ELSE 'miss' END AS origin, coalesce(a, b) AS value FROM part JOIN g USING (p_brand, p_size, p_name, p_type)""",
    "changed_files": """SELECT (['fresh', 'new', 'gone', 'changed', 'fresh'])[CASE o_orderkey % 5 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 1 END] AS state, count(*) AS n, min(o_orderkey::VARCHAR) AS first_path FROM orders GROUP BY 1""",
    "validation_metrics": f"""{_JUDGED} SELECT count(*) FILTER (category = 'main') AS main_samples, count(*) FILTER (category = 'main' AND old_error = 0) AS old_exact, count(*) FILTER (category = 'main' AND new_error = 0) AS new_exact,
      (sum(old_error) FILTER (category = 'main'))::BIGINT AS old_weighted_error, (sum(new_error) FILTER (category = 'main'))::BIGINT AS new_weighted_error, count(*) FILTER (category = 'main' AND new_error <= 1) AS new_within_one_level,
      count(*) FILTER (category = 'main' AND manual_level = '暂不优先' AND new_level = '强烈建议') AS new_severe_promotions, count(*) FILTER (new_level <> '暂不优先' AND NOT new_anchor) AS priority_without_anchor FROM v""",
    "validation_rows": f"{_JUDGED} SELECT sample_id, category, manual_level, old_error::INT AS old_error, new_error::INT AS new_error FROM v",
    "validation_heads": """WITH c AS (SELECT 'debtor' AS category, c_custkey FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'builder', c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'
        UNION ALL SELECT 'rich builder', c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)
      SELECT category, c_custkey, row_number() OVER (PARTITION BY category ORDER BY sha256('s1|' || c_custkey), c_custkey) AS place FROM c QUALIFY place <= 4""",
    "prefix_statuses": """WITH c AS (SELECT c_nationkey AS n, c_custkey % 40 AS m, c_custkey AS k, c_mktsegment AS entry FROM customer), o AS (SELECT n, m, min(entry) AS entry FROM c GROUP BY 1, 2 HAVING count(*) = 1)
      SELECT s_suppkey, coalesce(c.entry, o.entry) AS entry FROM supplier LEFT JOIN c ON c.n = s_nationkey AND c.k = s_suppkey LEFT JOIN o ON o.n = s_nationkey AND o.m = s_suppkey % 40""",
    "merged_entries": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE c_mktsegment END AS status, CASE WHEN c_custkey % 3 = 0 THEN 'r' ELSE c_name END AS responses FROM customer",
    "header_summary": """SELECT count(*) AS total, count(*) FILTER (c_acctbal > 0) AS shown, count(*) FILTER (c_mktsegment = 'BUILDING') AS contacted, count(*) FILTER (c_mktsegment IN ('MACHINERY', 'FURNITURE')) AS blocked FROM customer""",
    "filter_choices": "SELECT DISTINCT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2",
    "list_page": "SELECT c_custkey, place FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place BETWEEN 241 AND 360",
    "changed_status": """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '已套磁' WHEN 1 THEN NULL ELSE '不匹配' END AS status, CASE WHEN c_custkey % 2 = 0 THEN '2024-01-01' WHEN c_custkey % 5 = 0 THEN '2026-07-15' ELSE '' END AS contacted_at,
      CASE WHEN c_custkey % 3 = 0 THEN 'r' WHEN c_custkey % 5 = 0 THEN '已发' ELSE '' END AS responses FROM customer""",
    "signal_chips": _SIGNALS,
    "score_breakdown": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'official=' || p_size || ';dblp=' || CASE WHEN p_partkey % 6 = 0 THEN (p_size + 1)::VARCHAR ELSE '0' END ELSE 'papers=' || p_size || ';pages=0' END AS scores FROM part""",
    "combined_directions": "SELECT p_partkey, left(p_name || '; DBLP关键词：' || p_type || CASE WHEN p_size > 25 THEN '; arXiv关键词：' || p_brand ELSE '' END, 40) AS direction FROM part",
    "display_rows": """SELECT o_orderkey::VARCHAR AS o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE '' END AS status,
      CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '0.5' END AS share FROM orders""",
    "restored_columns": """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE 0 END::INT AS web_search_count, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE '' END AS web_search_urls, '' AS web_search_status, '' AS web_search_confidence,
      '' AS web_search_keywords, '' AS web_search_evidence, '' AS web_search_advice FROM supplier""",
    "json_rows": """SELECT '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","share":' || CASE WHEN s_suppkey % 2 = 0 THEN 'null' ELSE '1.5' END || ',"nation":' || CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey::VARCHAR ELSE 'null' END || '}' AS json FROM supplier""",
    "json_texts": """SELECT p_partkey, CASE WHEN p_partkey % 5 < 2 THEN p_name ELSE '' END AS text, CASE p_partkey % 5 WHEN 3 THEN 2 WHEN 4 THEN 0 ELSE 1 END::INT AS n_list, CASE WHEN p_partkey % 5 = 3 THEN p_name || ' b' ELSE '' END AS notes FROM part""",
}
ORACLE_SQL["evidence_summary"] = ORACLE_SQL["evidence_summary"].replace("classes_unordered", "classes")
