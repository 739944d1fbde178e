"""SQL with the same rows as the queries of ``evidence_queries``."""

from __future__ import annotations

from dossier.operators import placement, stores, verification
from dossier.plans import evidence_queries as made
from dossier.plans.record_oracles import _CORE, _KEYWORDS, RANKED, _scored


def _picks(rules: dict[str, str], prefix: str, seed: str, before: str, school: int, soft: bool) -> str:
    """One common table a category: the first row in hash order that the ones before leave free."""
    parts, taken = [], f"{prefix}_0"
    parts.append(f"{taken} AS (SELECT '' AS sample_id, '' AS category, doc_id, school, target FROM r LIMIT 0)")
    for i, (name, rule) in enumerate(rules.items(), 1):
        used = f"target IN (SELECT target FROM {taken})"
        parts.append(
            f"""{prefix}_{i} AS (SELECT * FROM {taken} UNION ALL SELECT * FROM (SELECT '{prefix}_{i:02d}', '{name}', doc_id, school, target FROM r
            WHERE ({rule}) AND doc_id NOT IN (SELECT doc_id FROM {taken}){before} AND (SELECT count(*) FROM {taken} t WHERE t.school = r.school) < {school}
            {'' if soft else f'AND NOT {used}'} ORDER BY {used}, sha256('{seed}|' || doc_id) LIMIT 1))"""
        )
        taken = f"{prefix}_{i}"
    return ",\n".join(parts)


_LAST = f"sample_{len(made.SAMPLE_RULES)}"
PICKS = f"""WITH r AS (SELECT doc_id, n_chars, lang, source AS school, source || '/' || coalesce(lang, '?') AS target FROM documents),
{_picks(made.SAMPLE_RULES, "sample", made.SEED, "", 2, True)},
{_picks(made.HOLDOUT_RULES, "holdout", made.SEED + "-holdout", f" AND doc_id NOT IN (SELECT doc_id FROM {_LAST})", 1, False)}
SELECT * FROM {_LAST} UNION ALL SELECT * FROM holdout_{len(made.HOLDOUT_RULES)}"""

_VALUES = {
    "id": "doc_id::VARCHAR", "lang": "coalesce(lang, '?')", "source": "coalesce(source, '?')", "digit": "(doc_id % 10)::VARCHAR",
    "state": f"{list(made.STATES)}[(doc_id % {len(made.STATES)} + 1)::INT]",
}


def _shape(shape: str, names: tuple[str, ...]) -> str:
    parts = shape.split("%s")
    return " || ".join([f"'{parts[0]}'", *(f"{_VALUES[n]} || '{p}'" for n, p in zip(names, parts[1:], strict=True))])


def _field(name: str) -> str:
    return f"""(v -> '$."{name}"')"""


def _said(names: tuple[str, ...]) -> str:
    cases = [f"CASE WHEN {_field(n)}::VARCHAR NOT IN ('null', '0', '0.0', 'false', '\"\"', '[]', '{{}}') THEN {_field(n)} END" for n in names]
    return f"CASE WHEN json_type(v) = 'OBJECT' THEN coalesce({', '.join(cases)}) END"


def _text(json: str) -> str:
    return f"coalesce(trim(regexp_replace(({json}) ->> '$', '\\s+', ' ', 'g')), '')"


_A = stores.ALIASES
_CASES = " ".join(f"WHEN {i} THEN {_shape(*shape)}" for i, shape in enumerate(made.STORE_SHAPES))
_NOTES = ", ".join(_text(f"CASE WHEN json_type(v) = 'OBJECT' THEN {_field(n)} END") for n in stores.NOTES)
_PLAIN = ", ".join(_text(f"CASE WHEN json_type(v) = 'OBJECT' THEN {_field(n)} END") + f" AS {n}" for n in stores.PLAIN)
STORES = f"""WITH s AS (SELECT doc_id, (CASE doc_id % {len(made.STORE_SHAPES)} {_CASES} END)::JSON AS j FROM documents),
o AS (SELECT doc_id, j, j -> '$.version' AS ver, CASE WHEN len(json_keys(j -> '$.statuses')) > 0 THEN j -> '$.statuses' ELSE j -> '$.records' END AS e FROM s WHERE json_type(j) = 'OBJECT'),
i AS (SELECT doc_id, greatest(coalesce(CASE WHEN json_type(ver) = 'VARCHAR' THEN try_cast(ver ->> '$' AS INT) WHEN json_type(ver) <> 'BOOLEAN' THEN trunc(ver::DOUBLE)::INT END, 4), 4) AS version,
  coalesce(j ->> '$.updated_at', j ->> '$.updatedAt', '') AS store_updated_at, e, unnest(json_keys(e)) AS key FROM o),
v AS (SELECT *, json_extract(e, '$."' || key || '"') AS v FROM i),
f AS (SELECT *, {_said(_A["responses"])} AS rs, {_text(f"CASE WHEN json_type(v) = 'VARCHAR' THEN v ELSE {_said(_A['status'])} END")} AS st FROM v),
g AS (SELECT *, list_filter(list_transform(CASE WHEN json_type(rs) = 'ARRAY' THEN rs::VARCHAR[] ELSE string_split_regex({_text("rs")}, '[；;、,]') END,
  lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM f),
d AS (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i) AS u FROM g),
n AS (SELECT doc_id, version, store_updated_at, trim(regexp_replace(key, '\\s+', ' ', 'g')) AS row_key,
  CASE WHEN st = '不考虑' THEN '先不考虑' WHEN st IN ('已套磁', '先不考虑', '不可能', '不匹配') THEN st ELSE '' END AS status, {_text(_said(_A["contacted_at"]))} AS contacted_at,
  array_to_string(list_filter(u, lambda x: x IN {stores.KNOWN_RESPONSES}), '|') AS responses,
  CASE WHEN try_cast(left({_text(_said(_A["interview_at"]))}, 16) AS TIMESTAMP) IS NOT NULL THEN replace(left({_text(_said(_A["interview_at"]))}, 16), ' ', 'T') ELSE '' END AS interview_at,
  [{_NOTES}, array_to_string(list_filter(u, lambda x: x NOT IN {stores.KNOWN_RESPONSES}), '；')] AS notes, {_PLAIN} FROM d),
t AS (SELECT * EXCLUDE (notes), array_to_string(list_filter(notes, lambda x, i: x <> '' AND list_position(notes, x) = i), '；') AS note FROM n)
SELECT * FROM t WHERE concat(status, contacted_at, responses, interview_at, note, name, school, college, teacher_url, updated_at) <> ''"""


def _held(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce(affiliation, '')), '{w}')" for w in words) + ")"


def _key(url: str) -> str:
    return f"""CASE WHEN regexp_extract({url}, '^[A-Za-z]+://([^/?#]*)', 1) <> '' THEN regexp_replace(lower(regexp_extract({url}, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', '')
      || lower(rtrim(regexp_extract({url}, '^[A-Za-z]+://[^/?#]*([^?#;]*)', 1), '/')) ELSE '' END"""


_W = verification.WEIGHTS
AUTHORS = f"""WITH d AS (SELECT *, doc_id // {made.CANDIDATES} AS person, lower(regexp_extract(coalesce(text, ''), '([A-Za-z]+)', 1)) AS w FROM documents),
people AS (SELECT person, source AS name, CASE WHEN person % 11 > 0 THEN [w, left(w, 3)] ELSE [] END AS names, CASE WHEN person % 3 > 0 AND url IS NOT NULL THEN url END AS home
  FROM d LEFT JOIN pages ON page_id = person WHERE doc_id % {made.CANDIDATES} = 0),
shown AS (SELECT doc_id, regexp_replace(url, '^http://', 'https://www.') || CASE WHEN doc_id % 8 = 1 THEN '/cv/' ELSE '' END AS url
  FROM d JOIN pages ON page_id = CASE WHEN doc_id % 4 = 1 THEN person ELSE person + 1 END),
c AS (SELECT d.person, doc_id, names, home, w AS key, source AS affiliation, doc_id % 97 = 5 AS direct, doc_id % {made.CANDIDATES} AS place FROM d JOIN people USING (person) WHERE doc_id % 13 > 0 AND len(names) > 0),
e AS (SELECT *, list_contains(names, key) AS exact, {_held(made.AFFILIATIONS)} AS known FROM c),
n AS (SELECT *, NOT exact AND len(list_filter(names, lambda x: x <> '' AND (contains(key, x) OR contains(x, key)))) > 0 AS near FROM e),
s AS (SELECT *, CASE WHEN direct THEN {_W["direct"]} ELSE 0 END + CASE WHEN exact THEN {_W["exact_name"]} WHEN near THEN {_W["near_name"]} ELSE 0 END
  + CASE WHEN known THEN {_W["affiliation"]} WHEN {_held(made.CITIES)} THEN {_W["city"]} ELSE 0 END AS base FROM n),
t AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY base DESC, place) AS r, max(base) OVER (PARTITION BY person) AS top FROM s QUALIFY r <= {verification.VERIFIED}),
v AS (SELECT t.*, home IS NOT NULL AND top < {verification.CERTAIN} AND base >= {verification.WORTH} AND shown.url IS NOT NULL
  AND {_key("home")} <> '' AND (contains({_key("home")}, {_key("shown.url")}) OR contains({_key("shown.url")}, {_key("home")})) AS page FROM t LEFT JOIN shown USING (doc_id)),
x AS (SELECT *, base + CASE WHEN coalesce(page, false) THEN {_W["homepage"]} ELSE 0 END AS score FROM v),
y AS (SELECT *, score - coalesce(lead(score) OVER (PARTITION BY person ORDER BY score DESC, r), 0) AS margin, row_number() OVER (PARTITION BY person ORDER BY score DESC, r) AS pos FROM x QUALIFY pos = 1),
z AS (SELECT *, CASE WHEN direct OR coalesce(page, false) THEN '高' WHEN exact AND known AND margin >= 20 THEN '高' WHEN exact AND margin >= 20 THEN '中' WHEN near AND known AND margin >= 30 THEN '低' END AS sure FROM y),
o AS (SELECT person, 'o' || doc_id AS a FROM d WHERE doc_id % 400 = 0)
SELECT p.person, CASE WHEN o.a IS NOT NULL THEN o.a WHEN p.name LIKE '%7' THEN 'named' WHEN sure IS NOT NULL THEN 'a' || z.doc_id END AS author_id,
  CASE WHEN o.a IS NOT NULL THEN 200 WHEN p.name LIKE '%7' THEN 90 ELSE score END::INT AS score, CASE WHEN o.a IS NULL AND NOT coalesce(p.name LIKE '%7', false) THEN margin END::INT AS margin,
  CASE WHEN o.a IS NOT NULL THEN '高' WHEN p.name LIKE '%7' THEN '中' ELSE sure END AS confidence,
  CASE WHEN o.a IS NOT NULL THEN '已匹配-高' WHEN p.name LIKE '%7' THEN '已匹配-中' WHEN sure IS NOT NULL THEN '已匹配-' || sure WHEN z.person IS NOT NULL THEN '歧义/未采用' ELSE '未匹配' END AS status
FROM people p LEFT JOIN z USING (person) LEFT JOIN o USING (person)"""

_ITEMS = f"""WITH i AS (SELECT doc_id, doc_id // {made.PERSON} AS person, (doc_id % {made.PERSON} // {made.PAGE})::INT AS place, doc_id % 3 > 0 AS named, 'w' || doc_id % 15 AS id,
    CASE WHEN doc_id % 17 > 0 THEN lang || ' ' || source END AS display_name, (n_chars % 30 + 2000)::INT AS year, source AS kind FROM documents),
  r AS (SELECT *, (row_number() OVER (PARTITION BY person, place ORDER BY doc_id) - 1)::INT AS item FROM i WHERE place < least(person % 5, 3)),
  w AS (SELECT * FROM r WHERE display_name <> '' AND kind NOT IN ('src3', 'src11')
    QUALIFY row_number() OVER (PARTITION BY person, CASE WHEN named THEN 'i' || id ELSE 't' || lower(display_name) END ORDER BY doc_id DESC) = 1)"""
PAGED = f"{_ITEMS} SELECT person, place, item, CASE WHEN named THEN id END AS id, display_name, year FROM w"
READING = f"""{_ITEMS}, k AS (SELECT person, count(*) AS n FROM w GROUP BY 1)
SELECT person, count(DISTINCT place) AS pages, count(*) AS raw_count, coalesce(any_value(n), 0) AS accepted_count, person % 5 > 3 AND max(place) = 2
  AND EXISTS (SELECT 1 FROM i WHERE i.person = r.person AND i.place = 3) AS truncated, 'ok' AS state FROM r LEFT JOIN k USING (person) GROUP BY person"""


def _union(values: str, work: str = "g") -> str:
    """A list of lists joined, alike values in any case once, as first written."""
    flat = f"list_filter(list_transform(flatten({values}), lambda x: trim(x)), lambda x: x <> '')"
    return f"array_to_string(list_filter({flat}, lambda x, i: list_position(list_transform({flat}, lambda y: lower(y)), lower(x)) = i), '|')"


def _first(column: str) -> str:
    return f"coalesce((list({column} ORDER BY o) FILTER ({column} <> ''))[1], '')"


MERGED = f"""WITH d AS (SELECT *, coalesce(source, '?') AS s, coalesce(lang, '?') AS l FROM documents),
r AS (SELECT doc_id AS id, doc_id - doc_id % 7 AS work_id, ['official', 'openalex', 'zbmath', 'arxiv', 'other'][(doc_id % 5 + 1)::INT] AS source, CASE WHEN doc_id % 4 > 0 THEN 's' || doc_id % 6 END AS source_id,
  CASE WHEN doc_id % 11 = 3 THEN '10.1/' || doc_id ELSE '' END AS doi, CASE WHEN doc_id % 13 = 5 THEN doc_id::VARCHAR END AS arxiv_id, 'On ' || s || ' ' || l AS title,
  CASE WHEN doc_id % 3 > 0 THEN (n_chars % 20 + 2005)::INT END AS year, CASE WHEN doc_id % 2 = 0 THEN s END AS venue, 'u' || doc_id % 8 AS url, doc_id % 3 = 0 AS is_preprint,
  [s, upper(s), l, ' ', 'A ' || doc_id % 3] AS authors, CASE WHEN doc_id % 2 = 1 THEN [l, '62H'] END AS classifications, [upper(l[1]) || lower(l[2:])] AS topics FROM d WHERE doc_id % 29 > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY doi = '', is_preprint, doc_rank, -length(title), id) AS o FROM
  (SELECT *, list_position(['official', 'openalex', 'zbmath', 'arxiv', 'other'], source) AS doc_rank FROM r)),
g AS (SELECT work_id, (list(title ORDER BY o))[1] AS title, max(year) AS year, {_first("doi")} AS doi, {_first("arxiv_id")} AS arxiv_id, {_first("venue")} AS venue, '' AS publication_date, {_first("url")} AS url,
  bool_and(is_preprint) AS is_preprint, count(*) AS n_records, {_union("list([source] ORDER BY o)")} AS sources, {_union("list([source || ':' || source_id] ORDER BY o) FILTER (source_id IS NOT NULL)")} AS source_ids,
  {_union("list(authors ORDER BY o)")} AS authors, {_union("list(classifications ORDER BY o) FILTER (classifications IS NOT NULL)")} AS classifications, {_union("list(topics ORDER BY o)")} AS topics FROM o GROUP BY 1)
SELECT * REPLACE (coalesce(source_ids, '') AS source_ids, coalesce(classifications, '') AS classifications),
  CASE WHEN doi <> '' THEN 'doi:' || doi WHEN arxiv_id <> '' THEN 'arxiv:' || arxiv_id WHEN coalesce(source_ids, '') <> '' THEN string_split(source_ids, '|')[1] ELSE 'title:' || regexp_replace(lower(title), '[^a-z0-9]', '', 'g') END AS canonical_id FROM g"""

_AT = f"(page_id + i - 1) % {len(made.LINKS)}"
_HREFS = " ".join(f"WHEN {k} THEN " + " || w || ".join(f"'{p}'" for p in href.split("%s")) for k, (href, _) in enumerate(made.LINKS))
_SAID = " ".join(f"WHEN {k} THEN '{' '.join(text.lower().split())}'" for k, (_, text) in enumerate(made.LINKS))
_ROOT, _PATH = "regexp_extract(url, '^https?://[^/?#]*')", "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"


def _hosts(names: tuple[str, ...]) -> str:
    return "host IN (" + ", ".join(f"'{n}'" for n in names) + ")"


def _words(names: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(said, '{n}')" for n in names) + ")"


_H = made.homepages
_PAPER = f"({_hosts(_H.PAPER_HOSTS)} OR contains(host, 'dblp.'))"
HOMEPAGES = f"""WITH p AS (SELECT page_id, url, regexp_extract_all(html, '<a href="/([^"]*)">', 1)[1:(1 + page_id % 9)] AS found FROM pages),
l AS (SELECT page_id, url, i, lower(regexp_replace(found[i], '[^A-Za-z]', '', 'g')) AS w FROM p, unnest(range(1, len(found) + 1)) t(i)),
h AS (SELECT *, CASE {_AT} {_HREFS} END AS raw, CASE {_AT} {_SAID} END AS said, {_ROOT} AS root, {_PATH} AS path, regexp_replace({_PATH}, '[^/]*$', '') AS folder FROM l),
c AS (SELECT *, CASE WHEN raw = '' THEN url WHEN starts_with(raw, '//') THEN string_split(root, ':')[1] || ':' || raw WHEN starts_with(raw, '..') THEN root || regexp_replace(folder, '[^/]+/$', '') || 'x/' || w || '.html'
  WHEN starts_with(raw, '?') THEN root || path || raw WHEN starts_with(raw, '#') THEN regexp_replace(url, '#.*$', '') || raw ELSE raw END AS href FROM h),
a AS (SELECT *, lower(regexp_extract(href, '^https?://([^/?#]*)', 1)) AS host, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS home FROM c WHERE regexp_matches(href, '^https?://')),
x AS (SELECT *, rtrim(href, '；') AS tidy, lower(rtrim(path, '/')) AS own, lower(rtrim(regexp_extract(rtrim(href, '；'), '^https?://[^/?#]*([^?#]*)', 1), '/')) AS their FROM a),
y AS (SELECT *, raw <> '' AND raw <> '#' AND NOT {_hosts(_H.COMMON_HOSTS)} AND NOT {_PAPER} AND NOT (host = home AND own = their) AS good FROM x),
z AS (SELECT *, good AND {_words(_H.SAYS_HOME)} AS direct, good AND regexp_matches(host, '{_H.PERSON_HOSTS}') AS fallback FROM y),
m AS (SELECT page_id, list(href ORDER BY i) FILTER (host <> home OR {_words(_H.SAYS_PERSON)}) AS outs, list(tidy ORDER BY i) FILTER (direct) AS ds, list(tidy ORDER BY i) FILTER (fallback) AS fs,
  list(href ORDER BY i) FILTER (NOT ({_hosts(_H.SECTION_HOSTS + _H.COMMON_HOSTS)} OR {_PAPER}) AND (host <> home OR {_words(_H.SAYS_PERSON)})) AS ss,
  list(href ORDER BY i) FILTER (host <> home AND {_words(_H.SAYS_OWN)}) AS ps, list(href ORDER BY i) FILTER (host <> home) AS os FROM z GROUP BY 1)
SELECT page_id, {", ".join(f"coalesce(array_to_string(list_filter({v}, lambda x, i: list_position({v}, x) = i), ' '), '') AS {n}" for n, v in (("outside", "outs"), ("clean", "coalesce(ds, fs)"), ("section", "ss")))},
  coalesce(ps[1], os[1], '') AS first FROM pages LEFT JOIN m USING (page_id)"""

#: By profile: the targets that it confirms, with the step that decides and the words shown.
_STEPS = {2: [("ai", 2, "人工智能学院")], 4: [("software", 3, "软件学院")], 5: [("software", 4, made.JOINT.merged), ("ai", 4, made.JOINT.merged)], 6: [("cse", 1, "计算机科学与工程学院"), ("ai", 1, "人工智能学院")]}
_TOLD = ", ".join(f"({i}, '{t}', {step}, '{needle}')" for i, told in _STEPS.items() for t, step, needle in told)
_M = placement.METHODS
AFFILIATIONS = rf"""WITH told(i, target, step, needle) AS (VALUES {_TOLD}),
p AS (SELECT doc_id, 'n' || doc_id % 100 AS name, 'http://x.edu/' || doc_id || '/?utm_a=1' AS page, trim(regexp_replace({list(made.PROFILES)}[(doc_id % {len(made.PROFILES)} + 1)::INT] || ' ' || coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents),
e AS (SELECT doc_id, target, '{placement.CONFIRMED}' AS status, '{_M["profile"]}' AS method, step, trim(substr(t, greatest(instr(t, needle) - 100, 1), instr(t, needle) - greatest(instr(t, needle) - 100, 1) + length(needle) + 100)) AS evidence, page AS source, 0 AS seq
    FROM p JOIN told ON i = doc_id % {len(made.PROFILES)}
  UNION ALL SELECT doc_id, 'cse', '{placement.CONFIRMED}', '{_M["department"]}', 0, '计算机科学系', page, 0 FROM p WHERE doc_id % 5 = 0
  UNION ALL SELECT p.doc_id, 'ai', CASE WHEN o.doc_id % 3 = 0 THEN 'by hand' ELSE '{placement.BY_HAND}' END, '{_M["hand"]}', 5, 'seen', 's1; s2', o.doc_id FROM p JOIN documents o ON o.doc_id % 50 = 7
    AND CASE WHEN o.doc_id % 200 > 7 THEN o.doc_id = p.doc_id AND (o.doc_id % 100 <> 7 OR p.name = 'n' || o.doc_id % 90) ELSE p.name = 'n' || o.doc_id % 90 END),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, target ORDER BY step DESC, seq DESC) = 1)
SELECT doc_id, target, status, method, step, md5(evidence) AS evidence, source FROM l
UNION ALL SELECT doc_id, 'cse', '{placement.PENDING}', '{_M["directory"]}', 6, md5(''), page FROM p WHERE doc_id NOT IN (SELECT doc_id FROM l)"""


def _ranked(web_search: str) -> str:
    """Parts ranked with but two sources that may be trusted."""
    out = RANKED.replace("p_partkey % 11 = 0", web_search)
    for other in ("p_partkey % 3 < 2 AND p_partkey % 5 <> 0", "p_partkey % 7 = 0", "p_partkey % 2 = 1"):
        out = out.replace(other, "false")
    return out


RESTORED = f"""SELECT b.p_partkey, b.p_partkey % 3 = 0 AS found, b.p_partkey % 3 = 0 AS changed, b.level AS level_before, a.level, a.score, a.score_web_search
FROM ({_ranked("false")}) b JOIN ({_ranked("p_partkey % 33 = 0")}) a USING (p_partkey)"""
DEPARTMENTS = """SELECT source || ':' || n_chars % 50 AS name, arg_max(lang, doc_id) AS department FROM documents WHERE doc_id % 4 > 0 AND doc_id % 3 > 0 AND lang IS NOT NULL AND source IS NOT NULL GROUP BY 1"""
DETAILS = """WITH p AS (SELECT doc_id AS p, CASE WHEN doc_id % 15 > 0 THEN 'i' || doc_id ELSE '' END AS i, source || ':' || doc_id // 25 AS n, CASE WHEN doc_id // 5 % 3 > 0 THEN 'http://p/' || doc_id // 5 % 2 ELSE '' END AS u FROM documents WHERE doc_id % 5 = 0),
r AS (SELECT doc_id AS r, CASE WHEN doc_id % 6 = 0 THEN 'i' || (doc_id - doc_id % 10) ELSE '' END AS i, source || ':' || doc_id // 25 AS n, CASE WHEN doc_id % 4 > 0 THEN 'http://p/' || doc_id % 2 ELSE '' END AS u FROM documents),
k AS (SELECT p, r FROM p JOIN r ON p.i = r.i AND p.i <> '')
SELECT * FROM k UNION ALL SELECT p, r FROM p JOIN r ON p.n = r.n AND r.i = '' AND (p.u = '' OR r.u = '' OR p.u = r.u) WHERE p NOT IN (SELECT p FROM k)"""

SHEETS = f"""WITH e AS ({STORES}),
s AS (SELECT doc_id, source AS name, lang, {list(made.STATES)}[(doc_id % {len(made.STATES)} + 1)::INT] AS raw FROM documents),
o AS (SELECT *, CASE WHEN raw = '不考虑' THEN '先不考虑' WHEN raw IN ('已套磁', '先不考虑') THEN raw ELSE '' END AS own_status, CASE WHEN doc_id % 7 = 0 THEN '官回；已发' ELSE '' END AS own_said,
  CASE WHEN doc_id % 5 = 0 THEN '2026-03-04T05:06' ELSE '' END AS own_at,
  concat_ws('；', CASE WHEN doc_id % 3 = 0 THEN 'b' END, CASE WHEN doc_id % 4 = 0 THEN '备注 a' END, CASE WHEN doc_id % 7 = 0 THEN 'else' END) AS own_note FROM s),
f AS (SELECT o.*, coalesce(b.doc_id, q.doc_id) IS NOT NULL AS hit, CASE WHEN b.doc_id IS NOT NULL THEN b ELSE q END AS t FROM o LEFT JOIN e b ON b.doc_id = o.doc_id AND b.row_key = 'b' LEFT JOIN e q ON q.doc_id = o.doc_id AND q.row_key = 'q')
SELECT doc_id, name, lang, coalesce(nullif(t.status, ''), own_status) AS status, coalesce(t.contacted_at, '') AS contacted_at, coalesce(nullif(replace(t.responses, '|', '；'), ''), own_said) AS responses,
  coalesce(nullif(t.interview_at, ''), own_at) AS interview_at, coalesce(nullif(t.note, ''), own_note) AS note FROM f"""

FINDINGS = f"""WITH kw(ord, kw, w) AS (VALUES {_KEYWORDS}),
w AS (SELECT doc_id // {made.RUN} AS person, doc_id AS pos, (n_chars % 4 + 2020)::INT AS year, CASE WHEN doc_id % 5 > 0 THEN source END AS venue, p_name AS title FROM documents JOIN part ON p_partkey = doc_id % 190 + 1),
b1 AS (SELECT pos AS p_partkey, concat_ws(' ', title, venue) AS t FROM w),{_scored("one", "t", 4).replace("FROM base", "FROM b1")},
b2 AS (SELECT person AS p_partkey, string_agg(concat_ws(' ', title, venue), ' ; ') AS t FROM w GROUP BY 1),{_scored("all", "t", 4).replace("FROM base", "FROM b2")},
y AS (SELECT person, sum(n)::BIGINT AS n, string_agg(year || ':' || n, '; ' ORDER BY year DESC) AS years FROM (SELECT person, year, count(*) AS n FROM w GROUP BY ALL) GROUP BY 1),
v AS (SELECT person, string_agg(venue || '(' || n || ')', '; ' ORDER BY n DESC, f, venue) AS venues FROM (SELECT * FROM (SELECT person, venue, count(*) AS n, min(pos) AS f FROM w WHERE venue <> '' GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY person ORDER BY n DESC, f, venue) <= 10) GROUP BY 1),
t AS (SELECT person, string_agg('[' || concat_ws(' ', year, venue) || '] ' || title, '；' ORDER BY r) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY coalesce(s_one, 0) DESC, year DESC, pos) AS r
  FROM w LEFT JOIN sc_one ON p_partkey = pos QUALIFY r <= 10) GROUP BY 1)
SELECT person, n, years, coalesce(venues, '') AS venues, titles, coalesce(array_to_string(kw_all, '; '), '') AS keywords, coalesce(s_all, 0)::INT AS score, coalesce(list_has_any(kw_all, [{_CORE}]), false) AS has_core
FROM y LEFT JOIN v USING (person) JOIN t USING (person) LEFT JOIN sc_all ON p_partkey = person"""

AUDIT = """WITH d AS (SELECT *, CASE WHEN doc_id % 4 > 0 THEN 'w' || n_chars % 50 END AS work FROM documents),
m(metric, n) AS (SELECT 'people', count(*) FROM d UNION ALL SELECT 'identity_seed_coverage', count(*) FILTER (doc_id % 10 > 0) FROM d UNION ALL SELECT 'publication_rows', count(*) FROM d
  UNION ALL SELECT 'blank_titles', count(*) FILTER (doc_id % 9 = 0) FROM d UNION ALL SELECT 'missing_trace_rows', count(*) FILTER (doc_id % 3 > 0 AND doc_id % 5 = 0) FROM d
  UNION ALL SELECT 'duplicate_canonical_rows', coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM d WHERE work IS NOT NULL GROUP BY doc_id % 100, work HAVING count(*) > 1)
  UNION ALL SELECT 'review_queue', count(*) FILTER (CASE WHEN doc_id % 2 = 0 THEN doc_id % 6 = 0 ELSE doc_id % 7 < 2 END) FROM d)
SELECT metric, n::BIGINT AS n FROM m
UNION ALL SELECT 'ok', (max(n) FILTER (metric = 'people') = max(n) FILTER (metric = 'identity_seed_coverage') AND sum(n) FILTER (metric IN ('blank_titles', 'missing_trace_rows', 'duplicate_canonical_rows')) = 0)::BIGINT FROM m
UNION ALL SELECT coalesce(source, '') || '|' || CASE WHEN doc_id % 8 = 0 THEN 'failed' WHEN doc_id % 8 < 5 THEN 'success' ELSE '' END, count(*) FROM documents GROUP BY 1"""

_LETTERS = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')".format
CHECKED = f"""WITH e AS (SELECT doc_id // {made.RUN} AS person, doc_id AS pos, 'on robust ' || lower(source) || ' in ' || coalesce(lang, '?') AS title, CASE WHEN doc_id % 3 = 0 THEN 'l' || doc_id % 5 ELSE '' END AS link, coalesce(lang, '') AS lang FROM documents),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY person, CASE WHEN link <> '' THEN link ELSE lower(title) END ORDER BY pos DESC) = 1),
p AS (SELECT doc_id // {made.RUN} AS person, doc_id % 24 = 0 AS named, doc_id % 36 > 0 AS sure, doc_id % 60 = 0 AS verified, 'x; On Robust src1' || doc_id % 7 || ' in en; On robust SRC4 in en' AS dblp, 'On robust src13 in fr; on robust src2 in en' AS works
  FROM documents WHERE doc_id % {made.RUN} = 0)
SELECT person, count(*) AS n, CASE WHEN any_value(verified) AND bool_or(contains({_LETTERS("works")}, {_LETTERS("title")})) THEN '{made.findings.IN_CATALOGUE}'
  WHEN any_value(sure) AND any_value(named) AND bool_or(lang = 'en') AND bool_or(contains({_LETTERS("dblp")}, {_LETTERS("title")})) THEN '{made.findings.IN_DBLP}' ELSE '{made.findings.BY_NAME}' END AS confidence
FROM l JOIN p USING (person) GROUP BY person"""


def _plain(url: str) -> str:
    return f"""regexp_extract({url}, '^(https?)://', 1) || '://' || lower(regexp_extract({url}, '^https?://([^/?#]*)', 1)) || rtrim(regexp_extract({url}, '^https?://[^/?#]*([^?#]*)', 1), '/')
      || CASE WHEN contains({url}, '?') THEN '?' || regexp_extract({url}, '[?]([^#]*)', 1) ELSE '' END"""


_STARTS = " OR ".join(f"({_hosts(h)} AND path IN ({', '.join(repr(p) for p in paths)}))" for h, paths in _H.SCHOOL_STARTS.items())
IDENTITIES = f"""WITH m AS (SELECT page_id, url, ['https://www.nju.edu.cn', 'http://cs.seu.edu.cn', 'https://dblp.org', 'http://aiia.seu.edu.cn', 'https://ai.fudan.edu.cn', 'https://dml.fudan.edu.cn'][(page_id % 6 + 1)::INT]
    || ['/', '/index.htm', '/x/list.htm', '/54820/list.htm', '/ann', '', '/?b=2&a=1'][(page_id // 6 % 7 + 1)::INT] AS made FROM pages),
u AS (SELECT page_id, 0 AS i, {_plain("made")} AS k FROM m UNION ALL SELECT page_id, 1, {_plain("url")} FROM m WHERE NOT contains(url, '#')),
h AS (SELECT *, regexp_extract(k, '^https?://([^/?#]*)', 1) AS host, rtrim(regexp_extract(k, '^https?://[^/?#]*([^?#]*)', 1), '/') AS path FROM u),
g AS (SELECT * FROM h WHERE NOT (rtrim(k, '/') IN {_H.SHARED_URLS} OR {_hosts(_H.PAPER_HOSTS)} OR host = '{_H.SHARED_HOST}' OR ({_hosts(_H.COMMON_HOSTS)} AND (path IN {_H.START_PATHS} OR ends_with(path, '/list.htm'))) OR {_STARTS}))
SELECT page_id, coalesce(string_agg('url:' || k, ' ' ORDER BY i), '') AS keys FROM pages LEFT JOIN g USING (page_id) GROUP BY page_id"""

def _newest(value: str) -> str:
    return f"(list({value} ORDER BY doc_id DESC) FILTER ({value} IS NOT NULL))[1]"


_OLD = f"{list(made.STATES)}[(doc_id % {len(made.STATES)} + 1)::INT]"
PATCHED = f"""WITH s AS (SELECT 'k' || doc_id AS row_key, CASE WHEN {_OLD} IN ('已套磁', '先不考虑') THEN {_OLD} ELSE '' END AS status, '2026' AS contacted_at, CASE WHEN doc_id % 2 = 0 THEN '官回' ELSE '' END AS responses,
    '' AS interview_at, '' AS note, 'old' AS name, 'old' AS school, 'old' AS college, 'old' AS teacher_url, 'before' AS updated_at FROM documents WHERE doc_id % 3 = 0),
p AS (SELECT 'k' || doc_id // 2 AS row_key, {_newest(f"CASE WHEN doc_id % 4 > 0 THEN {_OLD} END")} AS st, {_newest("CASE WHEN doc_id % 3 = 1 THEN '' END")} AS ca, {_newest("CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '已发|own' END")} AS rs,
    {_newest("CASE WHEN doc_id % 7 = 0 THEN '2026-01-02T03:04' END")} AS ia, {_newest("CASE WHEN doc_id % 6 = 0 THEN lang END")} AS nt, 't' || max(doc_id) AS ts FROM documents GROUP BY 1),
m AS (SELECT 'k' || d.doc_id AS row_key, coalesce(st, s.status, '') AS raw, coalesce(ca, s.contacted_at, '') AS contacted_at, coalesce(rs, s.responses, '') AS responses, coalesce(ia, s.interview_at, '') AS interview_at,
    coalesce(nt, s.note, '') AS note, source AS name, 's' AS school, '' AS college, 'u' AS teacher_url, ts AS updated_at FROM documents d JOIN p ON p.row_key = 'k' || d.doc_id LEFT JOIN s ON s.row_key = p.row_key WHERE d.doc_id % 10 > 0),
n AS (SELECT row_key, CASE WHEN raw = '不考虑' THEN '先不考虑' WHEN raw IN ('已套磁', '先不考虑') THEN raw ELSE '' END AS status, contacted_at, responses, interview_at, note, name, school, college, teacher_url, updated_at FROM m)
SELECT * FROM n WHERE concat(status, contacted_at, responses, interview_at, note) <> '' UNION ALL SELECT * FROM s WHERE row_key NOT IN (SELECT row_key FROM m)"""

MATERIALS = """WITH t AS (SELECT source AS who, doc_id, 'T' || doc_id % 60 AS title FROM documents WHERE doc_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3),
f AS (SELECT who, list(title ORDER BY doc_id) AS l FROM t GROUP BY 1), e AS (SELECT 'src' || s_suppkey % 15 AS who, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1)
SELECT who, s_suppkey, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|'), '') AS evidence FROM (SELECT DISTINCT source AS who FROM documents) LEFT JOIN f USING (who) LEFT JOIN e USING (who)"""

ORACLE_SQL = {
    "picked_samples": PICKS, "normal_store_entries": STORES, "author_choices": AUTHORS, "paged_works": PAGED, "paged_reading": READING, "merged_works": MERGED, "homepage_links": HOMEPAGES,
    "joint_affiliations": AFFILIATIONS, "restored_levels": RESTORED, "department_map": DEPARTMENTS, "detail_rows_of_people": DETAILS,
    "synced_sheets": SHEETS, "person_findings": FINDINGS, "publication_audit": AUDIT, "checked_entries": CHECKED, "directory_identities": IDENTITIES, "patched_store": PATCHED, "people_materials": MATERIALS,
}
