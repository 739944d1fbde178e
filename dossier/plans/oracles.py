"""SQL with the same rows as the registered queries, for an independent engine."""

from __future__ import annotations

from dossier.functions import extract
from dossier.plans.queries import PROFILE, SEED, WORDS


def _bounded(kw: str) -> str:
    return f"(^|[^a-z0-9]){kw}($|[^a-z0-9])"


NORM = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_KEYWORDS = ", ".join(f"({i}, '{kw}', {w})" for i, (kw, w) in enumerate(PROFILE.weights))
_CORE = ", ".join(f"'{k}'" for k in PROFILE.core)

SCORED = f"""
kw(ord, kw, w) AS (VALUES {_KEYWORDS}),
m AS (
  SELECT p_partkey, kw.* FROM part, kw
  WHERE w > 0 AND regexp_matches(lower(p_name || ' ' || p_type), '(^|[^a-z0-9])' || kw || '($|[^a-z0-9])')
),
al AS (
  SELECT * FROM m WHERE kw NOT IN ('gear', 'anvil')
  UNION ALL
  SELECT p_partkey, -1 AS ord, kw, w FROM (
    SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY w DESC, length(kw) DESC, CASE kw WHEN 'gear' THEN 0 ELSE 1 END) r
    FROM m WHERE kw IN ('gear', 'anvil')) WHERE r = 1
),
kept AS (
  SELECT a.* FROM al a WHERE NOT EXISTS (
    SELECT 1 FROM al b WHERE b.p_partkey = a.p_partkey AND length(b.kw) > length(a.kw) AND contains(b.kw, a.kw))
),
capped AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY length(kw) DESC, w DESC, ord) r FROM kept) WHERE r <= 4
),
sc AS (
  SELECT p.p_partkey, coalesce(sum(c.w), 0)::INT AS score, coalesce(string_agg(c.kw, ';' ORDER BY c.r), '') AS keywords
  FROM part p LEFT JOIN capped c USING (p_partkey) GROUP BY p.p_partkey
)"""

RANKED = f"""
WITH {SCORED},
anchor AS (SELECT p_partkey, bool_or(kw IN ({_CORE})) AS a FROM m GROUP BY p_partkey),
sold AS (SELECT l_partkey AS p_partkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS nr FROM lineitem GROUP BY 1),
base AS (
  SELECT sc.p_partkey, least(sc.score, 80) AS official, coalesce(a, false) AS a,
    CASE WHEN coalesce(a, false) AND coalesce(nr * 4 <= n, false) THEN least(round_even(n * 0.35::DOUBLE, 0)::INT, 18) ELSE 0 END AS publication,
    concat_ws(';',
      CASE WHEN list_has_any(string_split(keywords, ';'), ['small ring', 'ring']) THEN 'rings' END,
      CASE WHEN list_has_any(string_split(keywords, ';'), ['red widget', 'widget']) THEN 'widgets' END,
      CASE WHEN list_has_any(string_split(keywords, ';'), ['promo', 'economy']) THEN 'trade' END) AS direction_groups
  FROM sc LEFT JOIN anchor USING (p_partkey) LEFT JOIN sold USING (p_partkey)
),
t AS (SELECT *, CASE WHEN a THEN official + publication ELSE least(official + publication, 23) END AS score FROM base),
ranked AS (
  SELECT p_partkey, official, publication, direction_groups, score,
    CASE WHEN NOT a THEN '暂不优先' WHEN score >= 44 AND (contains(direction_groups, ';') OR publication > 0) THEN '强烈建议'
         WHEN score >= 24 THEN '可以考虑' ELSE '暂不优先' END AS level FROM t
)
"""

CITED = """WITH cited AS (SELECT doc_id, concat_ws(chr(10), text, CASE WHEN doc_id % 2 = 0 THEN 'A. Author, B. Other, Some long title, Journal of Things, ' || (1990 + doc_id % 40) || ', doi:10.1000/x.' || doc_id
  || ' see https://a.example/p' || (doc_id % 9) || '，and https://a.example/p0' ELSE 'Assistant professor since ' || (1990 + doc_id % 40) || ' at the journal department' END) AS text FROM documents)
"""

EVIDENCE = """
WITH ev AS (
  SELECT c.*, coalesce(o.n, 0) AS n_orders, coalesce(e.n, 0) AS n_events FROM customer c
  LEFT JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) o ON o_custkey = c_custkey
  LEFT JOIN (SELECT user_id, count(*) n FROM events GROUP BY 1) e ON user_id = c_custkey
)
"""

URL = r"""
WITH p AS (
  SELECT page_id, regexp_extract(url, '^(https?)://([^/?#]*)([^?#;]*)[^?#]*(?:\?([^#]*))?', 1) AS scheme,
    lower(regexp_extract(url, '^(https?)://([^/?#]*)', 2)) AS host,
    regexp_replace(regexp_extract(url, '^(https?)://([^/?#]*)([^?#;]*)', 3), '/+$', '') AS path,
    regexp_extract(url, '^(https?)://([^/?#]*)([^?#;]*)[^?#]*(?:\?([^#]*))?', 4) AS query
  FROM pages
), q AS (
  SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT DROPPED)), '&') AS kept FROM p
), u AS (
  SELECT page_id, path, CASE WHEN host = '' THEN '' ELSE scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END
    || CASE WHEN kept = '' THEN '' ELSE '?' || kept END END AS url FROM q
)
"""
_UTM = "starts_with(lower(x), 'utm_')"

PUBLICATION = r"""
  length(t) >= 12 AND (
    regexp_matches(t, '(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+') OR regexp_matches(t, '(?i)\barxiv\s*:?\s*\d{4}\.\d{4,5}(?:v\d+)?\b')
    OR (NOT regexp_matches(t, '(?i)\d{4}.{0,20}至今|assistant\s+professor|associate\s+professor|award')
      AND regexp_matches(t, '(^|\D)(19|20)\d{2}(\D|$)')
      AND (regexp_matches(t, '(?i)journal|proceedings|conference|transactions|letters|annals|biometrika|econometrica|statistica|springer|wiley|elsevier|siam|ieee|acm|accepted|forthcoming|in\s+press|to\s+appear|submitted|preprint|volume|\bvol\.?\s*\d|\bissue\s*\d|\bpp?\.\s*\d|\d+\s*\(\s*\d+\s*\)|paper\s+link')
        OR (len(regexp_extract_all(t, '[A-Za-z][A-Za-z''-]{2,}')) >= 4 AND regexp_matches(t, '[.,;:()]')))))
"""

LEVELS = r"""
WITH lv AS (
  SELECT doc_id, CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS old, toxic,
    CASE WHEN n_chars >= 200 AND NOT regexp_matches(text, '\*\*\*|\$\$\$|%%%') THEN 'high' ELSE 'low' END AS new
  FROM documents JOIN labels USING (doc_id)
)
"""

STATES = """
WITH a AS (SELECT o_orderkey, sha256(concat_ws(chr(31), o_orderkey::VARCHAR, o_orderstatus, o_totalprice::DECIMAL(18,2)::VARCHAR)) AS mark FROM orders),
b AS (SELECT o_orderkey, sha256(concat_ws(chr(31), o_orderkey::VARCHAR, CASE WHEN o_orderkey % 10 = 3 THEN 'X' ELSE o_orderstatus END, o_totalprice::DECIMAL(18,2)::VARCHAR)) AS saved
  FROM orders WHERE o_orderkey % 7 <> 2),
st AS (SELECT a.*, CASE WHEN saved IS NULL THEN 'missing' WHEN saved = mark THEN 'valid' ELSE 'stale' END AS state FROM a LEFT JOIN b USING (o_orderkey))
"""


def _keep(direction: str) -> str:
    order = ", ".join(f"{c} {direction}" for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    return f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) r FROM lineitem) WHERE r = 1"""


def _host_key(url: str) -> str:
    return (
        rf"regexp_replace(regexp_extract(lower(trim({url})), '^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)', 1), '^www\.', '')"
        rf" || regexp_replace(regexp_extract(lower(trim({url})), '^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)', 1), '/+$', '')"
    )


def _cut(line: str) -> str:
    """Marks places before entry numbers; twice, as neighbours share the blank between them."""
    return rf"regexp_replace({line}, '(^|\s)(\d{{1,2}}[、.)）]\s)', '\1' || chr(1) || '\2', 'g')"


_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, '{w}' AS keyword FROM d WHERE regexp_matches(t, '{_bounded(w)}')" for w in WORDS
)
_LABELS = {"english": ["of the", "that"], "german": ["und der", "nicht"], "french": ["dans", "est"], "spanish": ["que la", "por"]}
_LABEL_SQL = ", ".join(
    f"CASE WHEN {' OR '.join(f"regexp_matches(t, '{_bounded(w)}')" for w in terms)} THEN '{name}' END" for name, terms in _LABELS.items()
)
_TYPES = "ut AS (SELECT user_id, list(DISTINCT event_type) AS types FROM events GROUP BY 1)"
_PRIORITY = " ".join(f"WHEN list_contains(types, '{t}') THEN '{t}'" for t in ("purchase", "signup", "error", "click", "view"))
_SAMPLE = f"SELECT c_mktsegment, c_custkey, place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('{SEED}|' || c_custkey), c_custkey) AS place FROM customer) WHERE place <= 5"

ORACLE_SQL = {
    "keyword_match": f"WITH d AS (SELECT doc_id, lower({NORM}) AS t FROM documents) {_MATCHES}",
    "keyword_score": f"WITH {SCORED} SELECT p_partkey, score, keywords FROM sc",
    "gated_ranking": RANKED + "SELECT *, CASE WHEN level = '暂不优先' THEN '否' ELSE '是' END AS can_contact FROM ranked",
    "priority_list": RANKED + "SELECT p_partkey, score, level FROM ranked WHERE level <> '暂不优先'",
    "level_counts": RANKED + "SELECT level, count(*) AS n FROM ranked GROUP BY 1",
    "direction_groups": RANKED + "SELECT direction_groups, count(*) AS n, max(score) AS best FROM ranked GROUP BY 1",
    "relevance_labels": f"WITH d AS (SELECT doc_id, lower({NORM}) AS t FROM documents) SELECT doc_id, concat_ws(';', {_LABEL_SQL}) AS labels FROM d",
    "search_filter": """SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      WHERE contains(lower(concat_ws(' ', c_name, n_name, r_name, c_mktsegment)), 'building') AND c_acctbal > 0""",
    "weak_evidence": EVIDENCE + "SELECT c_custkey, n_orders, n_events FROM ev WHERE n_orders + n_events <= 1",
    "deep_query_gate": EVIDENCE + "SELECT c_custkey, n_orders FROM ev WHERE c_acctbal >= 8000 OR c_custkey % 25 >= 20 OR n_orders > 12 OR c_nationkey = 7 OR c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "normalized_url": URL.replace("DROPPED", f"({_UTM} OR starts_with(lower(x), 'ref'))") + "SELECT page_id, url FROM u",
    "person_id": URL.replace("DROPPED", _UTM) + r""", k AS (
      SELECT page_id, url, url = '' OR lower(path) IN ('', '/index.htm', '/index.html', '/system/caslogin.jsp')
        OR suffix(lower(path), '/list.htm') OR suffix(lower(path), '/list.html') OR suffix(lower(path), '/index.htm') AS generic FROM u)
      SELECT page_id, CASE WHEN generic THEN 'provisional_' || left(sha256('provisional|s|c||' || url || '|||' || page_id), 24)
        ELSE 'teacher_' || left(sha256('url|s|' || url), 24) END AS person_id, CASE WHEN generic THEN '低-待复核' ELSE '高' END AS confidence FROM k""",
    "email_extract": rf"SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower({NORM}), '[\w.\-+]+@[\w.\-]+\.\w+')) AS email FROM documents",
    "year_extract": CITED + r"""SELECT DISTINCT doc_id, y::INT AS year FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\d+')) AS y FROM cited)
      WHERE regexp_full_match(y, '(19|20)\d{2}')""",
    "norm_text_stats": rf"""SELECT doc_id, length(t) AS n_clean, md5(t) AS clean_md5, length(regexp_replace(lower(t), '[^a-z0-9一-鿿]', '', 'g')) AS n_name
      FROM (SELECT doc_id, {NORM} AS t FROM documents)""",
    "html_text_length": r"""SELECT page_id, length(t) AS n_text, md5(t) AS text_md5 FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_replace(html, '(?is)<(?:script\b.*?</script|style\b.*?</style|noscript\b.*?</noscript|svg\b.*?</svg)\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages)""",
    "html_links": """SELECT page_id, place - 1 AS place, href FROM (SELECT page_id, unnest(l) AS href, generate_subscripts(l, 1) AS place
      FROM (SELECT page_id, list_transform(regexp_extract_all(html, '(?i)<a [^>]*href *= *("[^"]*"|[^ >]*)', 1), lambda h: trim(h, '"')) AS l FROM pages))""",
    "publication_gate": CITED + rf""", l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM cited)),
      n AS (SELECT *, trim(regexp_replace(line, '\s+', ' ', 'g')) AS t FROM l) SELECT doc_id, line_no, line FROM n WHERE {PUBLICATION}""",
    "split_entries": rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r]'), lambda v: trim(regexp_replace(v, '\s+', ' ', 'g'))), lambda v: v <> '') AS ls FROM documents),
      p AS (SELECT doc_id, list_filter(flatten(list_transform(ls, lambda v: list_transform(string_split({_cut(_cut("v"))}, chr(1)), lambda x: trim(x)))), lambda v: v <> '') AS e FROM l)
      SELECT doc_id, len(e) AS n_entries, md5(array_to_string(e, chr(10))) AS entries_md5 FROM p""",
    "dedup_keep_last": _keep("DESC"),
    "dedup_keep_first": _keep("ASC"),
    "exact_canonical_works": """SELECT md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS work_key, min(doc_id) AS first_record, count(*) AS n_records,
      max(n_chars) AS longest, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1""",
    "title_overlap": "SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)",
    "publication_summary": """SELECT o_custkey AS c_custkey, sum(n)::BIGINT AS n_orders, string_agg(y || ':' || n, ';' ORDER BY y DESC) AS by_year
      FROM (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2) JOIN customer ON c_custkey = o_custkey GROUP BY 1""",
    "best_candidate_margin": """WITH per AS (SELECT l_partkey, l_suppkey, count(*) AS n, bool_or(l_returnflag = 'R') AS ret, bool_or(l_discount >= 0.05) AS cheap FROM lineitem GROUP BY 1, 2),
      s AS (SELECT *, (CASE WHEN n >= 2 THEN 4 ELSE 0 END + CASE WHEN cheap THEN 12 ELSE 0 END + CASE WHEN NOT ret THEN 10 ELSE 0 END + 5 * least(n, 3))::INT AS candidate_score FROM per),
      r AS (SELECT *, row_number() OVER w AS place, candidate_score - lead(candidate_score) OVER w AS margin FROM s WINDOW w AS (PARTITION BY l_partkey ORDER BY candidate_score DESC, l_suppkey))
      SELECT l_partkey, l_suppkey, candidate_score, margin, CASE WHEN n >= 3 OR candidate_score >= 12 THEN 'high'
        WHEN candidate_score >= 8 AND n >= 1 AND NOT (coalesce(margin, 99) < 3 AND n < 3) THEN 'medium' ELSE 'low' END AS confidence FROM r WHERE place = 1""",
    "contact_overlay": """WITH st AS (SELECT 'u:' || user_id AS k, arg_max(event_type, (ts, event_id)) AS status, arg_max(value, (ts, event_id)) AS amount FROM events GROUP BY 1
        UNION ALL SELECT 'n:' || (user_id % 20), arg_max(event_type, (ts, event_id)), arg_max(value, (ts, event_id)) FROM events GROUP BY 1)
      SELECT c_custkey, CASE WHEN a.k IS NOT NULL THEN a.status ELSE b.status END AS status, CASE WHEN a.k IS NOT NULL THEN a.amount ELSE b.amount END AS amount
      FROM customer LEFT JOIN st a ON a.k = 'u:' || c_custkey LEFT JOIN st b ON b.k = 'n:' || c_nationkey""",
    "contact_upsert": """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r FROM events) WHERE r = 1 AND event_type <> 'error'""",
    "detail_fallback_join": """WITH p AS (SELECT c_custkey AS pid, 'n' || (c_custkey % 97) AS name FROM customer),
      r AS (SELECT CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS pid, 'n' || (o_orderkey % 97) AS name, o_orderkey FROM orders),
      d AS (SELECT p.pid, o_orderkey FROM p JOIN r USING (pid) UNION ALL
        SELECT p.pid, o_orderkey FROM p JOIN r ON p.name = r.name AND r.pid IS NULL WHERE p.pid NOT IN (SELECT pid FROM r WHERE pid IS NOT NULL))
      SELECT pid, count(*) AS n, min(o_orderkey) AS first_order FROM d GROUP BY 1""",
    "progress_rollup": EVIDENCE + """SELECT r_name, n_name, count(*) AS total, count(*) FILTER (n_orders > 0) AS contacted, count(*) FILTER (n_orders > 10) AS progressed,
      count(*) FILTER (n_events > 0) AS interviews, floor(count(*) FILTER (n_orders > 0) * 100.0 / count(*) + 0.5)::BIGINT AS pct
      FROM ev JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "calendar_28d": """WITH g AS (SELECT unnest(generate_series(DATE '2024-01-08', DATE '2024-02-04', INTERVAL 1 DAY))::DATE AS day),
      e AS (SELECT unnest(list_distinct([ts::DATE, (ts + INTERVAL 36 HOUR)::DATE])) AS day FROM events)
      SELECT g.day, count(e.day) AS n FROM g LEFT JOIN e ON e.day = g.day GROUP BY 1""",
    "weekly_events": """SELECT date_trunc('week', ts)::DATE AS week, (date_diff('day', DATE '2024-01-15', date_trunc('week', ts)::DATE) / 7)::BIGINT AS "offset", count(*) AS n FROM events GROUP BY 1, 2""",
    "response_counts": f"""WITH {_TYPES} SELECT response, count(*) AS n FROM (SELECT unnest(coalesce(types, ['none'])) AS response FROM customer LEFT JOIN ut ON user_id = c_custkey) GROUP BY 1""",
    "response_priority": f"WITH {_TYPES} SELECT user_id, CASE {_PRIORITY} END AS state FROM ut",
    "missing_date": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "range_overlap": """SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
      WHERE o_orderdate::DATE BETWEEN '1998-03-01' AND '1998-03-28' OR s::DATE BETWEEN '1998-03-01' AND '1998-03-28'""",
    "shadow_audit": LEVELS + "SELECT old || ' -> ' || new AS transition, count(*) AS n FROM lv GROUP BY 1",
    "audit_violations": LEVELS + """SELECT count(*) AS n_rows, count(*) FILTER (old = 'low' AND new = 'high') AS promoted,
      count(*) FILTER (old = 'high' AND new = 'low') AS demoted, count(*) FILTER (toxic = 1 AND new = 'high') AS toxic_high FROM lv""",
    "duplicate_group_rows": "SELECT g AS group_size, sum(g)::BIGINT AS n_rows FROM (SELECT count(*) AS g FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE g > 1 GROUP BY 1",
    "checkpoint_coverage": STATES + """SELECT count(*) AS total, count(*) FILTER (state = 'valid') AS valid, count(*) FILTER (state = 'stale') AS stale,
      count(*) FILTER (state = 'missing') AS missing, round(count(*) FILTER (state = 'valid') / count(*)::DOUBLE, 4) AS coverage FROM st""",
    "row_fingerprints": STATES + "SELECT o_orderkey, mark, state FROM st",
    "hash_sample": _SAMPLE,
    "holdout_sample": f"""SELECT c_mktsegment, c_custkey, place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('{SEED}-holdout|' || c_custkey), c_custkey) AS place
      FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM ({_SAMPLE}))) WHERE place <= 3""",
    "agreement_metrics": """WITH r AS (SELECT quality + CASE WHEN toxic = 0 THEN 1 ELSE 0 END AS t, CASE WHEN n_chars >= 2000 THEN 2 WHEN n_chars >= 200 THEN 1 ELSE 0 END AS f, quality + 1 AS w
        FROM documents JOIN labels USING (doc_id))
      SELECT count(*) AS n, count(*) FILTER (t = f) AS exact, count(*) FILTER (abs(t - f) <= 1) AS within_one, sum(abs(t - f) * w)::BIGINT AS weighted_error,
        count(*) FILTER (f - t >= 2) AS severe_promotions FROM r""",
    "union_by_name": "SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier",
    "affiliation_flatmap": """WITH a AS (SELECT c_custkey, list_filter([CASE WHEN c_acctbal < 0 THEN 'debtor' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'builder' END,
        CASE WHEN c_nationkey < 5 THEN 'home' END], lambda x: x IS NOT NULL) AS l FROM customer)
      SELECT c_custkey, unnest(CASE WHEN len(l) = 0 THEN ['pending'] ELSE l END) AS affiliation FROM a""",
    "ordinal_renumber": "SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS ordinal FROM part",
    "json_props": "SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS sum_k, count(json_extract_string(props, '$.k')) AS n_k FROM events GROUP BY 1",
    "record_navigation": """SELECT p_partkey, lag(p_partkey) OVER w AS previous_id, lead(p_partkey) OVER w AS next_id FROM part
      WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)""",
    "source_report": """SELECT source, count(*) AS raw, count(*) FILTER (n_chars >= 200) AS accepted, greatest(0, count(*) FILTER (NOT coalesce(n_chars >= 200, false))) AS rejected, max(n_chars) > 15000 AS truncated,
      CASE WHEN source = 'src7' THEN 'not_configured' WHEN count(*) FILTER (doc_id % 97 = 5) > 0 THEN 'degraded' ELSE 'ok' END AS health FROM documents GROUP BY source""",
    "web_search_gate": EVIDENCE + """SELECT c_custkey, n_orders, n_events FROM ev WHERE c_custkey % 11 <> 0 AND (
      (c_acctbal > 5000 AND (n_orders + n_events <= 1 OR n_events = 0))
      OR (c_acctbal < 2000 AND c_acctbal / 100 BETWEEN 10 AND 45 AND c_mktsegment = 'BUILDING')
      OR (c_custkey % 3 <> 0 AND c_acctbal / 100 >= 10 AND c_mktsegment = 'BUILDING'))""",
    "confidence_levels": """SELECT page_id, CASE WHEN (contains(url, 'example.org') AND (page_id % 2 = 0 OR page_id % 3 = 0)) OR page_id % 6 = 0 THEN '高'
      WHEN (contains(url, '//blog.') OR contains(url, '//m.')) AND (page_id % 2 = 0 OR page_id % 3 = 0) THEN '中'
      WHEN page_id % 2 = 0 OR page_id % 3 = 0 THEN '低' ELSE '' END AS confidence FROM pages""",
    "top_venues": """SELECT l_suppkey, l_partkey, n, place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) AS place
      FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE place <= 10""",
    "phone_extract": rf"""SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(generate_series(1, len(l)), lambda i: {{'i': i, 'v': l[i]}}),
        lambda x: list_position(l, x.v) = x.i), lambda x: x.v), '; ') AS phones
      FROM (SELECT doc_id, regexp_extract_all(text, '{extract.PHONE}')[1:3] AS l FROM documents)""",
    "link_extract": CITED + r""", l AS (SELECT doc_id, regexp_extract_all(text, 'https?://[^\s，,；;。)）]+') AS l FROM cited),
      u AS (SELECT doc_id, unnest(l) AS link, generate_subscripts(l, 1) AS i FROM l),
      f AS (SELECT doc_id, link, min(i) AS i FROM u GROUP BY 1, 2)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS place, link FROM f""",
    "host_keys": rf"SELECT page_id, {_host_key('url')} AS host_key FROM pages",
    "homepage_overlap": rf"""WITH k AS (SELECT page_id, {_host_key('url')} AS a, list_filter(list_transform(list_transform(regexp_extract_all(html, '(?i)<a [^>]*href *= *("[^"]*"|[^ >]*)', 1), lambda h: trim(h, '"')),
        lambda u: {_host_key('u')}), lambda v: v <> '') AS bs FROM pages)
      SELECT page_id, a <> '' AND len(list_filter(bs, lambda b: contains(a, b) OR contains(b, a))) > 0 AS overlaps FROM k""",
    "label_values": rf"""WITH m AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '研究 方向：' WHEN 1 THEN 'E mail: a：' ELSE '' END || text AS text FROM conversations),
      t AS (SELECT conv_id, turn, {NORM} AS t FROM m),
      c AS (SELECT *, CASE WHEN contains(t, '：') THEN strpos(t, '：') ELSE strpos(t, ':') END AS p FROM t)
      SELECT conv_id, turn, CASE WHEN p > 0 THEN replace(left(t, p - 1), ' ', '') ELSE '' END AS label,
        md5(CASE WHEN p > 0 THEN trim(substr(t, p + 1)) ELSE t END) AS value_md5 FROM c""",
    "text_snippets": r"""WITH l AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda v: trim(regexp_replace(v, '\s+', ' ', 'g'))),
        lambda v: length(v) >= 25 AND regexp_matches(v, '(^|\D)(19|20)\d{2}(\D|$)|(?i:licen[sc]e)'))[1:18], lambda v: left(v, 500)) AS s FROM documents)
      SELECT doc_id, len(s) AS n_snippets, md5(array_to_string(s, chr(10))) AS snippets_md5 FROM l""",
    "pattern_keywords": r"""WITH l AS (SELECT doc_id, list_concat(regexp_extract_all(text, '(?i)licen[sc]e'), regexp_extract_all(text, '(?i)copyright')) AS l FROM documents)
      SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(generate_series(1, len(l)), lambda i: {'i': i, 'v': l[i]}),
        lambda x: list_position(list_transform(l, lambda y: lower(y)), lower(x.v)) = x.i), lambda x: x.v)[1:12], '; ') AS keywords FROM l""",
    "search_phrases": """SELECT p_partkey, '"' || p_name || '" "' || p_brand || '" ' || array_to_string(list_filter(string_split(p_type, ' '), lambda x: x <> '')[1:3], ' ')
      || '|' || p_name || ' homepage' AS phrases FROM part""",
    "work_summary": """WITH o AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS y, o_orderstatus AS v, floor(o_totalprice / 50000) AS s FROM orders),
      a AS (SELECT o_custkey, sum(n)::BIGINT AS n, string_agg(y || ':' || n, '; ' ORDER BY y DESC) AS years FROM (SELECT o_custkey, y, count(*) AS n FROM o GROUP BY 1, 2) GROUP BY 1),
      b AS (SELECT o_custkey, string_agg(v || '(' || n || ')', '; ' ORDER BY r) AS venues FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) AS r
        FROM (SELECT o_custkey, v, count(*) AS n, min(o_orderkey) AS f FROM o GROUP BY 1, 2)) WHERE r <= 10 GROUP BY 1),
      c AS (SELECT o_custkey, string_agg('[' || y || ' ' || v || '] o' || o_orderkey, '；' ORDER BY r) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
        ORDER BY s DESC, y DESC, o_orderkey) AS r FROM o) WHERE r <= 10 GROUP BY 1)
      SELECT o_custkey, n, years, venues, titles FROM a JOIN b USING (o_custkey) JOIN c USING (o_custkey)""",
    "cached_lookup": """SELECT c_custkey, e IS NOT NULL AS hit, e AS event_id FROM customer LEFT JOIN (SELECT user_id, arg_max(event_id, (ts, event_id)) AS e FROM events
      WHERE ts >= TIMESTAMP '2024-01-11' AND event_type <> 'error' GROUP BY 1) ON user_id = c_custkey""",
    "kept_columns": """SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND s_suppkey IS NOT NULL THEN s_acctbal ELSE c_acctbal END AS c_acctbal
      FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""",
    "null_tolerant_override": """SELECT c_custkey, CASE WHEN n_nationkey % 5 = 1 AND c_mktsegment = 'BUILDING' THEN 'both:n:' || n_name WHEN n_nationkey % 5 = 2 THEN 'n:' || n_name
      WHEN c_mktsegment = 'MACHINERY' THEN 's:machines' END AS affiliation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "link_crawl": """WITH RECURSIVE r AS (SELECT 1::BIGINT AS node, 0::BIGINT AS depth UNION ALL SELECT c_custkey, depth + 1 FROM r JOIN customer ON c_custkey // 10 = node)
      SELECT node, min(depth) AS depth FROM r GROUP BY 1""",
    "local_order": "SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY lower(n_name), n_nationkey) AS place FROM nation",
    "cited_works": CITED + rf""", l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r]'), lambda v: trim(regexp_replace(v, '\s+', ' ', 'g'))), lambda v: v <> '') AS ls FROM cited),
      p AS (SELECT doc_id, list_filter(flatten(list_transform(ls, lambda v: list_transform(string_split({_cut(_cut("v"))}, chr(1)), lambda x: trim(x)))), lambda v: v <> '') AS e FROM l),
      x AS (SELECT doc_id, unnest(e) AS t, generate_subscripts(e, 1) - 1 AS entry_no FROM p)
      SELECT doc_id, entry_no, list_filter(regexp_extract_all(t, '\d+'), lambda y: regexp_full_match(y, '(19|20)\d\d'))[1]::INT AS year, regexp_extract(lower(t), '10\.1000/x\.\d+') AS doi FROM x WHERE {PUBLICATION}""",
    "title_overlap_counts": """WITH p AS (SELECT p_partkey, [p_name || ' ' || p_type || ' ' || p_brand, p_type || ' ' || p_name] AS o, concat_ws(' ', p_name, CASE WHEN p_size > 20 THEN p_type END, CASE WHEN p_size > 30 THEN p_brand END) AS c FROM part)
      SELECT p_partkey, len(list_filter(o, lambda x: length(x) >= 16 AND length(c) >= 16 AND (contains(x, c) OR contains(c, x))))::INT AS n FROM p""",
    "directory_urls": r"""WITH u AS (SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '' END AS u FROM pages),
      s AS (SELECT page_id, regexp_extract(u, '^(https?)://([^/?#]*)([^?#;]*)[^?#]*(?:\?([^#]*))?', ['s', 'h', 'p', 'q']) AS x FROM u)
      SELECT page_id, x.s || '://' || lower(x.h) || rtrim(x.p, '/') || CASE WHEN x.q = '' THEN '' ELSE '?' || x.q END AS url FROM s""",
    "evidence_rules": """WITH k AS (SELECT o_orderkey AS k, o_orderdate, o_orderstatus, (['identity_confirmed', 'success', 'terms_required', 'no_record', 'identity_probable', 'other'])[o_orderkey % 6 + 1] AS status,
        (['high', 'medium', 'low'])[(o_orderkey // 6) % 3 + 1] AS confidence, (['official', 'zbmath'])[(o_orderkey // 18) % 2 + 1] AS source, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 40 ELSE 999 END AS lead FROM orders)
      SELECT k AS o_orderkey, status IN ('identity_confirmed', 'identity_probable') AND confidence <> 'low' AS wanted, status = 'success' AND (source = 'official' OR confidence <> 'low') AS accepted,
        CASE WHEN status IN ('success', 'no_record') THEN 'healthy' WHEN status = 'terms_required' THEN status ELSE 'review' END AS health,
        CASE WHEN k % 7 = 0 THEN '中-学术库题名交叉确认' WHEN k % 30 = 0 THEN '中-DBLP交叉确认' ELSE '低' END AS arxiv,
        k % 3 = 1 AND (k % 4 = 1 OR (k % 4 IN (0, 2) AND k % 2 = 0 AND k % 11 > 4)) AS review,
        CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN '高' WHEN k % 10 = 0 AND lead >= 20 THEN '高' WHEN k % 2 = 0 AND lead >= 20 THEN '中' WHEN k % 15 = 0 AND lead >= 30 THEN '低' END AS dblp,
        year(o_orderdate) BETWEEN 1998 AND 2000 AS recent, 's/c|' || k AS record_key, CASE WHEN k % 2 = 0 THEN true END AS cjk, hex('a' || o_orderstatus || chr(9)) AS clean FROM k""",
}
