"""SQL of the operators of this round: personal data, vector codes, repair of conversations."""

from __future__ import annotations

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_RULES = {"email": _EMAIL, "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
_TERM = r"\p{L}[\p{L}\p{M}]*"
_VALID = r"""CASE kind WHEN 'email' THEN true WHEN 'ip' THEN len([x FOR x IN string_split(h, '.') IF length(ltrim(x, '0')) > 3 OR CAST('0' || right(x, 3) AS INT) > 255]) = 0
  WHEN 'card' THEN length(regexp_replace(h, '[^0-9]', '', 'g')) BETWEEN 14 AND 19 AND list_sum(list_transform(string_split(reverse(regexp_replace(h, '[^0-9]', '', 'g')), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN CAST(x AS INT) WHEN CAST(x AS INT) > 4 THEN CAST(x AS INT) * 2 - 9 ELSE CAST(x AS INT) * 2 END)) % 10 = 0
  ELSE length(regexp_replace(h, '[^0-9]', '', 'g')) BETWEEN 10 AND 15 END"""


def _each(sql: str) -> str:
    return " UNION ALL ".join(sql.format(k=i, kind=kind, p=p, term=_TERM) for i, (kind, p) in enumerate(_RULES.items()))


#: Places are sums of the texts between and of matches; windows, counts and scores as in ``pii``.
PII = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
e AS ({_each("SELECT rid, {k} AS k, '{kind}' AS kind, regexp_extract_all(text, '(?s)(.*?)({p})', 1) AS gaps, regexp_extract_all(text, '(?s)(.*?)({p})', 2) AS hits FROM d")}),
m AS (SELECT rid, k, kind, unnest(gaps) AS g, unnest(hits) AS h, generate_subscripts(gaps, 1) AS i FROM e),
s AS (SELECT *, CAST(sum(length(g) + length(h)) OVER (PARTITION BY rid, k ORDER BY i) AS BIGINT) AS stop FROM m),
b AS (SELECT rid, k, kind, stop - length(h) AS start, stop FROM s WHERE {_VALID}),
held AS (SELECT *, regexp_replace(text, '{_EMAIL}', '@', 'g') AS bare FROM d WHERE rid IN (SELECT rid FROM b)),
w AS ({_each("SELECT rid, '{kind}' AS kind, regexp_extract_all(x, '{p}') AS hits, [regexp_extract_all(g, '{term}') FOR g IN string_split_regex(x, '{p}')] AS gaps FROM (SELECT rid, CASE '{kind}' WHEN 'email' THEN text ELSE bare END AS x FROM held)")}),
c AS (SELECT rid, kind, unnest(hits) AS h, generate_subscripts(hits, 1) AS i, len(hits) AS n, gaps FROM w),
near AS (SELECT rid, kind || ':' || CASE kind WHEN 'email' THEN lower(h) WHEN 'ip' THEN h ELSE regexp_replace(h, '[^0-9]', '', 'g') END AS entity,
  [lower(t) FOR t IN list_concat(list_slice(gaps[i], len(gaps[i]) - least(8, CASE WHEN i = 1 THEN len(gaps[i]) ELSE len(gaps[i]) // 2 END) + 1, len(gaps[i])),
    list_slice(gaps[i + 1], 1, least(8, CASE WHEN i = n THEN len(gaps[i + 1]) ELSE (len(gaps[i + 1]) + 1) // 2 END)))] AS terms FROM c WHERE {_VALID}),
pairs AS (SELECT entity, t, count(*) AS n_both, count(DISTINCT terms) AS windows FROM (SELECT entity, terms, unnest(terms) AS t FROM near) GROUP BY ALL),
around AS (SELECT entity, sum(n_both) AS n_entity FROM pairs GROUP BY entity),
words AS (SELECT lower(unnest(regexp_extract_all(text, '{_TERM}'))) AS t FROM d),
counts AS (SELECT t, count(*) AS n_term FROM words GROUP BY t),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM words),
flagged AS (SELECT entity, t FROM pairs JOIN around USING (entity) JOIN counts USING (t), total WHERE windows >= 3 AND n_entity < n AND round(ln(n_both * n / (n_term * n_entity)) / ln(n / n_entity), 9) >= 0.9),
marked AS (SELECT DISTINCT rid, t FROM near JOIN flagged USING (entity)),
outside AS (SELECT rid, unnest(string_split_regex(text, '{_EMAIL}')) AS piece, generate_subscripts(string_split_regex(text, '{_EMAIL}'), 1) AS i, list_concat(regexp_extract_all(text, '{_EMAIL}'), ['']) AS mails FROM held WHERE rid IN (SELECT rid FROM marked)),
begun AS (SELECT rid, piece, coalesce(sum(length(piece) + length(mails[i])) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first, i FROM outside),
parts AS (SELECT rid, first, i, unnest(regexp_extract_all(piece, '(?s)(.*?)({_TERM})', 1)) AS g, unnest(regexp_extract_all(piece, '(?s)(.*?)({_TERM})', 2)) AS t, generate_subscripts(regexp_extract_all(piece, '{_TERM}'), 1) AS j FROM begun),
placed AS (SELECT rid, lower(t) AS t, length(t) AS size, CAST(first + sum(length(g) + length(t)) OVER (PARTITION BY rid, i ORDER BY j) AS BIGINT) AS stop FROM parts),
spans AS (SELECT * FROM b UNION ALL SELECT rid, 4, 'term', stop - size, stop FROM placed SEMI JOIN marked USING (rid, t)),
g AS (SELECT rid, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone, count(*) FILTER (k = 4) AS n_term,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < 4) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_term, 0) AS n_term
FROM d LEFT JOIN g USING (rid)
"""


def _codes() -> str:
    """Every round against every entry."""
    square = "list_inner_product(x, x) - 2 * list_inner_product(x, e) + list_inner_product(e, e)"
    near = "SELECT rid, part, any_value(x) AS x, min({{'d': {d}, 'entry': entry}}) AS best FROM p JOIN c{r} USING (part) GROUP BY rid, part"
    out = """WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, [floor(4096 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v, len(embedding) // 8 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT rid, part, list_slice(v, part * w + 1, (part + 1) * w) AS x FROM k, range(8) AS r(part)),
c0 AS (SELECT part, rid - 1 AS entry, x AS e FROM p WHERE rid <= 16)"""
    for r in range(6):
        out += f""",
a{r} AS MATERIALIZED ({near.format(d=square, r=r)}),
u{r} AS (SELECT part, best.entry AS entry, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{r}),
m{r} AS (SELECT part, entry, list(v ORDER BY i) AS e FROM (SELECT part, entry, i, floor(sum(v) / count(*)) AS v FROM u{r} GROUP BY ALL) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.e, c{r}.e) AS e FROM c{r} LEFT JOIN m{r} USING (part, entry))"""
    return out + f""",
z AS ({near.format(d=square, r=6)}),
f AS (SELECT rid, string_agg(printf('%02x', CAST(best.entry AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM z GROUP BY rid),
h AS (SELECT sha256(string_agg(CAST(v AS BIGINT)::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM c6))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN f USING (rid), h"""


CODES = _codes()


def _repair() -> str:
    """Costs and least edits of all states, carried back row by row."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    put = lambda n, letter, s: f"{{'c': s{s}.c + {n}, 'x': '{letter}' || s{s}.x}}"
    kept = {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}
    steps = []
    for s, n in after.items():
        stays = [f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {put('1 + extra', 'R', n)} END", *[f"CASE WHEN fault NOT IN ('blank', 'duplicate') AND role[1] = '{i}' THEN {put('extra', 'K', t)} END" for i, t in kept[s]]]
        steps.append(f"list_min([{put(2, 'D', s)}, {', '.join(stays)}]) AS s{s}")
    body = f"SELECT conv_id, i - 1 AS i, {', '.join(steps)} FROM back JOIN f USING (conv_id, i)"
    for _ in range(3):
        body = "SELECT conv_id, i, " + ", ".join(f"least(s{s}, {put(5, 'I', n)}) AS s{s}" for s, n in after.items()) + f" FROM ({body})"
    end = ", ".join(f"{{'c': {c}, 'x': '{x}'}} AS s{s}" for s, (c, x) in enumerate(((0, ""), (10, "II"), (5, "I"), (0, ""))))
    return rf"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(name, '')])),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 20 AS what FROM t),
damaged AS (SELECT conv_id, turn, CASE what WHEN 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE what WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM crc WHERE what <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM o),
back AS (SELECT conv_id, max(i) AS i, {end} FROM f GROUP BY conv_id UNION ALL {body}),
best AS (SELECT conv_id, CAST(s0.c AS BIGINT) AS cost, s0.x AS audit FROM back WHERE i = 0),
told AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
letters AS (SELECT conv_id, audit, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS j FROM best),
numbered AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter IN ('K', 'R', 'I')) OVER w AS place FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
opened AS (SELECT n.*, f.role, f.text, max(CASE WHEN letter = 'K' AND place = 1 AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS led FROM numbered n LEFT JOIN f USING (conv_id, i) WHERE letter <> 'D'),
lines AS (SELECT conv_id, j, CASE letter WHEN 'K' THEN role || ':' || text ELSE CASE WHEN (place - led) % 2 = 1 THEN 'user:' ELSE 'assistant:' END || CASE letter WHEN 'R' THEN text ELSE '' END END AS line FROM opened),
joined AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY j) AS whole FROM lines GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN joined USING (conv_id)
"""


REPAIR = _repair()
