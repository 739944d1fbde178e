"""SQL with the same rows for those queries of the training-data operators that SQL can express."""

from __future__ import annotations

from dossier.llm import chat_format, merkle, mixture, secret_scan, spelling, url_filter

_HOST = "translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"


def _fit(column: int) -> str:
    cases = []
    for rule in sorted(url_filter.HOST_RULES, key=lambda r: -len(r[1] + r[2])):
        value = rule[1] + rule[2] if column else rule[0]
        cases.append(f"WHEN (host = '{rule[1]}' OR ends_with(host, '.{rule[1]}')) AND starts_with(path, '{rule[2]}') THEN '{value}'")
    return f"CASE {' '.join(cases)} END"


def _hits(action: str) -> str:
    own = [f"regexp_matches(coalesce(url, ''), '{r.pattern}')" for r in url_filter.PATTERN_RULES if r.action == action]
    return f"({' OR '.join(own)})"


URLS = f"""WITH p AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path FROM pages)
SELECT page_id, host, path, {_fit(1)} AS rule,
  coalesce({_fit(0)}, CASE WHEN {_hits("block")} AND NOT {_hits("allow")} THEN 'block' ELSE 'allow' END) AS verdict FROM p"""


def _found(k: int, kind: str, pattern: str, group: int, least: int, more: str = "") -> str:
    """Spans of one kind: texts between matches and matches alternate, so running sums are places."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, s, s + length(w) AS e FROM (
      SELECT doc_id, w, g, sum(length(b) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) - length(w) AS s FROM (
        SELECT doc_id, unnest(string_split_regex(t, '{quoted}')) AS b,
          unnest(list_append(regexp_extract_all(t, '{quoted}'), '')) AS w, unnest(list_append(regexp_extract_all(t, '{quoted}', {group}), '')) AS g,
          unnest(range(len(regexp_extract_all(t, '{quoted}')) + 1)) AS i
        FROM d WHERE regexp_matches(t, '{quoted}'))) WHERE w <> '' AND length(g) >= {least}{more}"""


def _entropy(k: int, cls: secret_scan.CharClass) -> str:
    allowed = " ".join(f"AND NOT regexp_matches(w, '{a}')" for a in secret_scan.ALLOW)
    windows = f"list_transform(range(1, greatest(1, length(w) - {cls.window} + 1) + 1), lambda i: round(list_entropy(string_split(substr(w, i, {cls.window}), '')), 9))"
    return _found(k, cls.kind, cls.pattern, 0, 0, f" AND regexp_matches(w, '{cls.must}') {allowed} AND list_max({windows}) >= {cls.bits}")


_ALL = " UNION ALL ".join(
    [_found(k, kind, pattern, group, least) for k, (kind, pattern, group, least) in enumerate(secret_scan.BASE)]
    + [_entropy(len(secret_scan.BASE) + i, cls) for i, cls in enumerate(secret_scan.CLASSES)]
)

SECRETS = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({_ALL})
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k), '') AS spans
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"""

_NIBBLES = "list_transform(range(1, 41), lambda i: instr('0123456789abcdef', substr(x, i, 1)) - 1)"
ARCHIVES = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
n AS (SELECT *, {_NIBBLES} AS v FROM p),
b AS (SELECT *, list_transform(range(0, 160), lambda j: (v[j // 4 + 1] >> (3 - j % 4)) & 1) AS bits FROM n)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda q: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (bits[5*q+1]*16 + bits[5*q+2]*8 + bits[5*q+3]*4 + bits[5*q+4]*2 + bits[5*q+5] + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""

CHATS = rf"""WITH d AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT conv_id, last_turn, max(text) AS answer FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM d WHERE role = 'assistant') WHERE turn = last_turn GROUP BY ALL),
e AS (SELECT a.conv_id, a.last_turn, b.answer FROM a JOIN a b ON b.conv_id = xor(a.conv_id, 1)),
t AS (SELECT conv_id, 0 AS side, turn, role, text FROM d JOIN e USING (conv_id) WHERE turn <= last_turn
  UNION ALL SELECT conv_id, 1, turn, role, text FROM d JOIN e USING (conv_id) WHERE turn < last_turn UNION ALL SELECT conv_id, 1, last_turn, 'assistant', answer FROM e),
u AS (SELECT conv_id AS pair_id, turn, role, text, min(side) = 0 AS c, max(side) = 1 AS r FROM t GROUP BY ALL),
x AS (SELECT pair_id, min(turn) AS parts_at FROM u WHERE NOT (c AND r) GROUP BY 1),
h AS (SELECT u.*, parts_at IS NULL OR turn < parts_at AS shared,
  '<|' || role || '|>' || chr(10) AS head, replace(text, '<|', '< |') || '<|end|>' || chr(10) AS body FROM u LEFT JOIN x USING (pair_id)),
k AS (SELECT pair_id, turn, dense_rank() OVER (PARTITION BY pair_id ORDER BY step) - 1 AS block FROM (
  SELECT pair_id, turn, (sum(n) OVER (PARTITION BY pair_id ORDER BY turn) - n)::BIGINT // {chat_format.MOST} AS step
  FROM (SELECT pair_id, turn, sum(length(head) + length(body)) AS n FROM h GROUP BY ALL))),
w AS (SELECT * FROM h JOIN k USING (pair_id, turn)),
v AS (SELECT w.*, part FROM w, (VALUES ('prompt'), ('chosen'), ('rejected')) parts(part)
  WHERE CASE part WHEN 'prompt' THEN shared WHEN 'chosen' THEN c AND NOT shared ELSE r AND NOT shared END),
s AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY pair_id, part ORDER BY turn, role, text) AS e FROM v),
g AS (SELECT pair_id, block, part, count(*) AS n, string_agg(head || body, '' ORDER BY turn, role, text) AS txt,
  string_agg((e - length(body)) || ':' || e, ',' ORDER BY turn, role, text) FILTER (role = 'assistant') AS msk FROM s GROUP BY ALL),
o AS (SELECT pair_id, block, coalesce(max(n) FILTER (part = 'prompt'), 0) AS n, coalesce(max(txt) FILTER (part = 'prompt'), '') AS prompt,
  coalesce(max(txt) FILTER (part = 'chosen'), '') AS chosen, coalesce(max(msk) FILTER (part = 'chosen'), '') AS chosen_mask,
  coalesce(max(txt) FILTER (part = 'rejected'), '') AS rejected, coalesce(max(msk) FILTER (part = 'rejected'), '') AS rejected_mask FROM g GROUP BY ALL)
SELECT pair_id, block, max(block) OVER (PARTITION BY pair_id) + 1 AS blocks, (sum(n) OVER (PARTITION BY pair_id))::BIGINT AS n_prompt_turns,
  prompt, chosen, chosen_mask, rejected, rejected_mask FROM o"""



def _crc_table() -> list[int]:
    """Checksums of single bytes, by the polynomial of CRC-32."""
    table = list(range(256))
    for _ in range(8):
        table = [0xEDB88320 ^ (c >> 1) if c & 1 else c >> 1 for c in table]
    return table


def _crc(text: str) -> str:
    """CRC-32 of a text of code points below 256, in UTF-8."""
    of_bytes = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN ord(c) > 127 THEN [195, ord(c) - 64] ELSE [ord(c)] END))"
    step = f"xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {of_bytes}::BIGINT[]), lambda c, b: {step}), 4294967295)"


def _budgets() -> str:
    """One nested budget after the other: running sums in the order of keys show where each runs out."""
    parts = ["b0 AS (SELECT *, greatest(floor(target + 0.000001 - times * source_size), 0)::BIGINT AS lft, -1::BIGINT AS aft, 0 AS once FROM t)"]
    for i in range(mixture.ROUNDS):
        parts.append(
            f"""c{i} AS (SELECT *, key > aft AND size <= lft AND lft > 0 AS c FROM b{i}),
            u{i} AS (SELECT *, sum(size) FILTER (c) OVER (PARTITION BY source ORDER BY key) AS upto FROM c{i}),
            s{i} AS (SELECT *, min(key) FILTER (c AND upto > lft) OVER (PARTITION BY source) AS stp FROM u{i}),
            k{i} AS (SELECT *, c AND (stp IS NULL OR key < stp) AS got FROM s{i}),
            r{i} AS (SELECT *, lft - coalesce(sum(size) FILTER (got) OVER (PARTITION BY source), 0) AS rest FROM k{i}),
            b{i + 1} AS (SELECT doc_id, source, size, key, source_size, target, times, CASE WHEN stp IS NOT NULL AND rest > target * {mixture.NEAR} THEN rest ELSE 0 END::BIGINT AS lft,
              stp AS aft, once + got::INT AS once FROM r{i})"""
        )
    return ",\n".join(parts)


MIX = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, '-'))), 1, 15))::BIGINT AS key FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS source_size, {list(mixture.WEIGHTS)}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixture.WEIGHTS)} + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, {mixture.CAP} * source_size::DOUBLE AS most, sum(source_size) OVER () * {mixture.SHARE} AS whole, sum(w) OVER () AS ws FROM z),
p AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
  coalesce(sum(w) OVER (ORDER BY most / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wabove FROM o),
l AS (SELECT max((whole - above) / (ws - wabove)) FILTER ((whole - above) / (ws - wabove) <= most / w) AS level FROM p),
t AS (SELECT doc_id, d.source, size, key, source_size, least(most, level * w)::DOUBLE AS target, CASE WHEN source_size > 0 THEN floor(least(most, level * w) / source_size) ELSE 0 END::BIGINT AS times
  FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source, l),
{_budgets()}
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (times + once))::BIGINT AS taken FROM b{mixture.ROUNDS}"""


def _leaf(n_chars: str) -> str:
    parts = [f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(parts)})"


_SHUT = "CASE WHEN s.d IS NULL THEN sha256(c.x) WHEN c.i % 2 = 0 THEN sha256(c.x || s.d) ELSE sha256(s.d || c.x) END"
MANIFEST = f"""WITH RECURSIVE a AS (SELECT doc_id, lang AS g, {_leaf("n_chars")} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND {_crc("doc_id::VARCHAR")} % {merkle.TAMPER} = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS x FROM documents),
v AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM a),
t AS (SELECT g, 0 AS l, i, leaf AS d, n FROM v
  UNION ALL SELECT g, l + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY g, l, i // 2, n),
r AS (SELECT g, l AS h, d AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
q AS (SELECT 0 AS l, i, subroot AS d, n FROM r
  UNION ALL SELECT l + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM q WHERE n > 1 GROUP BY l, i // 2, n),
c AS (SELECT doc_id, v.g, 0 AS l, v.i, h, x, '' AS p FROM v JOIN r ON v.g IS NOT DISTINCT FROM r.g
  UNION ALL SELECT c.doc_id, c.g, c.l + 1, c.i // 2, c.h, {_SHUT}, c.p || coalesce(s.d, '')
  FROM c LEFT JOIN t s ON s.g IS NOT DISTINCT FROM c.g AND s.l = c.l AND s.i = xor(c.i, 1) WHERE c.l < c.h),
e AS (SELECT doc_id, c.g, 0 AS l, r.i, (SELECT max(l) FROM q) AS h, x, p FROM c JOIN r ON c.g IS NOT DISTINCT FROM r.g WHERE c.l = c.h
  UNION ALL SELECT c.doc_id, c.g, c.l + 1, c.i // 2, c.h, {_SHUT}, c.p || coalesce(s.d, '')
  FROM e c LEFT JOIN q s ON s.l = c.l AND s.i = xor(c.i, 1) WHERE c.l < c.h)
SELECT v.doc_id, leaf, subroot, w.d AS root, sha256(e.p) AS proof_sha256, e.x AS folded_root, e.x = w.d AS verified
FROM v JOIN r ON v.g IS NOT DISTINCT FROM r.g JOIN e ON e.doc_id IS NOT DISTINCT FROM v.doc_id AND e.l = e.h, (SELECT d FROM q WHERE n = 1) w"""

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPELLINGS = rf"""WITH RECURSIVE o AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOW}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) GROUP BY ALL),
h AS (SELECT *, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM o),
x AS (SELECT CASE WHEN h % {spelling.SLIP} = 0 THEN left(w, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS w, n FROM h),
v AS (SELECT w, sum(n)::BIGINT AS n FROM x WHERE length(w) >= {spelling.MIN_LENGTH} GROUP BY w HAVING sum(n) >= {spelling.MIN_COUNT}),
k AS (SELECT w, n, i, left(w, i) || substr(w, i + 2) AS r FROM (SELECT w, n, unnest(range(length(w))) AS i FROM v)),
m AS (SELECT k.w, v.w AS y, v.n AS m FROM k JOIN v ON k.r = v.w UNION SELECT v.w, k.w, k.n FROM k JOIN v ON k.r = v.w
  UNION SELECT a.w, b.w, b.n FROM k a JOIN k b ON a.r = b.r AND a.i = b.i AND a.w <> b.w),
b AS (SELECT w, count(*) AS n_near, max(m) AS form_n, arg_min(y, (-m, y)) AS form FROM m GROUP BY w),
f AS (SELECT v.w AS word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {spelling.TIMES} * v.n THEN form END AS form, CASE WHEN form_n >= {spelling.TIMES} * v.n THEN form_n END AS form_n FROM v LEFT JOIN b USING (w)),
g AS (SELECT word, word AS root FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON g.root = f.word WHERE f.form IS NOT NULL),
e AS (SELECT g.word, g.root FROM g JOIN f ON g.root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)"""

ORACLE_SQL = {
    "op2_secret_scan": SECRETS, "op3_chat_format": CHATS, "op8_url_filter": URLS, "op9_warc": ARCHIVES, "op11_source_mix": MIX,
    "op12_merkle_manifest": MANIFEST, "op13_spelling_variants": SPELLINGS,
}
