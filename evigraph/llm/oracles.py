"""Checking SQL of the pipeline operators, for DuckDB over the driver tables.

Written from the contracts with plain regular expressions (no possessive forms), row lists and
windows; the only values shared with the operators are their published parameters.
"""

from __future__ import annotations

from evigraph.llm import pii, secrets

WORD = r"[^\x20\x09-\x0D]+"
ORACLES: dict[str, str] = {}

ORACLES["op2_hamming_topk"] = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 AND NOT isnan(x) THEN 1 ELSE 0 END) AS bits FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_sum(list_transform(list_zip(q.bits, v.bits), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS distance
      FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(distance AS INTEGER) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= 10"""

def _key(parts: str) -> str:
    """A number of 52 bits from the MD5 of the parts."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {parts})), 1, 13) AS BIGINT)"


ORACLES["op3_mix"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
                  CAST('0x' || substr(md5(concat_ws('|', 11, doc_id, text)), 1, 13) AS BIGINT) AS spot FROM documents),
s0 AS (SELECT source, count(*) AS n, sum(size)::BIGINT AS words FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM s0),
s2 AS (SELECT *, ((rank - 1) % 3 + 1)::DOUBLE AS weight FROM s1),
s3 AS (SELECT *, row_number() OVER o AS place,
              (sum(words) OVER () * 1.0::DOUBLE - 3.0::DOUBLE * coalesce(sum(words) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS rate
       FROM s2 WINDOW o AS (ORDER BY words / weight, rank), b AS (ORDER BY words / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (SELECT min(place) FROM s3 WHERE rate * weight < 3.0 * words) AS stop FROM s3),
s5 AS (SELECT *, CASE WHEN stop IS NULL OR place < stop THEN 3.0::DOUBLE * words ELSE weight * (SELECT max(rate) FROM s4 WHERE place = stop) END AS target FROM s4),
s6 AS (SELECT *, least(65536, CAST(ceil(n / 128) AS BIGINT)) AS blocks, CASE WHEN words > 0 THEN CAST(floor(target / words) AS BIGINT) ELSE 0 END AS full_passes FROM s5),
s7 AS (SELECT *, CAST(floor(target - full_passes * words) AS BIGINT) AS rest FROM s6),
p AS MATERIALIZED (SELECT d.*, s7.rank, s7.words AS source_size, s7.target, s7.full_passes, s7.rest, (d.spot % 65536) * s7.blocks // 65536 AS block FROM d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source),
-- the last pass: in permuted order up to the first row that does not fit, then the smallest behind it
a AS (SELECT *, {_key("11, 'block', rank, block")} AS turn, {_key("11, 'row', spot")} AS draw FROM (SELECT rank, rest, block, spot, sum(size)::BIGINT AS size FROM p GROUP BY ALL) WHERE size BETWEEN 1 AND rest),
u AS (SELECT *, sum(size) OVER (PARTITION BY rank ORDER BY turn, block, draw, spot) AS until FROM a),
m AS (SELECT rank, rest - coalesce(sum(size) FILTER (until <= rest), 0) AS rem FROM u GROUP BY rank, rest),
v AS (SELECT u.*, rem, sum(size) OVER (PARTITION BY rank ORDER BY size, turn, block, draw, spot) AS upto FROM u JOIN m USING (rank) WHERE until > rest AND size <= rem),
f AS MATERIALIZED (SELECT rank, block, spot FROM u WHERE until <= rest UNION ALL SELECT rank, block, spot FROM v WHERE upto <= rem),
-- units, and their tree: at (low, high) source after source draws a number of the units that go left
n AS MATERIALIZED (SELECT DISTINCT rank, block, unnest(range(full_passes)) AS pass FROM p WHERE size > 0 UNION ALL SELECT DISTINCT rank, block, full_passes FROM f JOIN (SELECT DISTINCT rank, full_passes FROM p) USING (rank)),
q AS MATERIALIZED (SELECT list(coalesce(c, 0) ORDER BY rank) AS q FROM s7 LEFT JOIN (SELECT rank, count(*) AS c FROM n GROUP BY 1) USING (rank)),
tree AS (SELECT 0 AS low, 16 AS high, q, 1 AS i, list_sum(q)::BIGINT AS total, (list_sum(q) * 8 // 16)::BIGINT AS drawn, []::BIGINT[] AS lft FROM q
  UNION ALL SELECT * FROM (
    SELECT low, high, q, i + 1, total - q[i], drawn - took, list_append(lft, took) FROM (
      SELECT *, a + least(b - a, len(list_filter(range(1, len(w) + 1), lambda j: list_sum(w[1:j]) <= list_sum(w) * {_key("11, low, high, i")} / 4503599627370496))) AS took FROM (
        SELECT *, list_transform(range(a, b + 1), lambda k: exp(lgamma(mid + 1) - lgamma(k + 1) + lgamma(q[i] - mid + 1) - lgamma(q[i] - k + 1) + lgamma(drawn - mid + 1) - lgamma(drawn - k + 1) + lgamma(total - q[i] - drawn + mid + 1) - lgamma(total - q[i] - drawn + k + 1))) AS w FROM (
          SELECT *, greatest(low_k, round(mean)::BIGINT - spread) AS a, least(high_k, round(mean)::BIGINT + spread) AS b, least(high_k, greatest(low_k, round(mean)::BIGINT)) AS mid FROM (
            SELECT *, greatest(0, drawn + q[i] - total) AS low_k, least(q[i], drawn) AS high_k, drawn * q[i] / greatest(total, 1) AS mean, ceil(9 * sqrt(drawn * q[i] / greatest(total, 1) * (1 - q[i] / greatest(total, 1)) + 1))::BIGINT AS spread
            FROM tree WHERE i <= len(q) AND high - low > 1))))
    UNION ALL
    SELECT l, h, list_transform(range(1, len(q) + 1), lambda j: x[j]), 1, list_sum(x)::BIGINT, CASE WHEN h - l > 1 THEN list_sum(x)::BIGINT * ((h - l + 1) // 2) // (h - l) ELSE list_sum(x)::BIGINT END, []::BIGINT[] FROM (
      SELECT low AS l, low + (high - low + 1) // 2 AS h, lft AS x, q FROM tree WHERE i > len(q) AND high - low > 1
      UNION ALL SELECT low + (high - low + 1) // 2, high, list_transform(range(1, len(q) + 1), lambda j: q[j] - lft[j]), q FROM tree WHERE i > len(q) AND high - low > 1))),
leaf AS (SELECT low AS shard, generate_subscripts(q, 1) AS rank, unnest(q) AS quota FROM tree WHERE high - low = 1),
rng AS (SELECT *, sum(quota) OVER (PARTITION BY rank ORDER BY shard) AS until FROM leaf),
num AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY {_key("11, 'unit', rank, pass, block")}, pass, block) AS k FROM n),
unit AS (SELECT num.rank, block, pass, shard FROM num JOIN rng ON num.rank = rng.rank AND k > until - quota AND k <= until),
t AS (SELECT p.doc_id, p.size, source_size, target, p.text_no, CASE WHEN p.size > 0 THEN full_passes + (f.spot IS NOT NULL)::INT ELSE 0 END AS times,
             string_agg(shard || ':' || pass || ':' || {_key("11, shard, pass, p.spot")}, ',' ORDER BY pass) FILTER (p.size > 0 AND (pass < full_passes OR f.spot IS NOT NULL)) AS places
      FROM (SELECT *, row_number() OVER () AS text_no FROM p) p LEFT JOIN f ON p.rank = f.rank AND p.spot = f.spot LEFT JOIN unit ON unit.rank = p.rank AND unit.block = p.block GROUP BY ALL)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * times)::BIGINT AS taken, md5(coalesce(places, '')) AS places_md5 FROM t"""


def found(kind: str, rank: int, pattern: str, passes: str = "true") -> str:
    """Rows (doc_id, kind, rank, s, e, val, lft, rgt) of leftmost non-overlapping matches."""
    p = pattern.replace("'", "''")
    return f"""SELECT * FROM (SELECT doc_id, '{kind}' AS kind, {rank} AS rank,
  sum(len(gap)) OVER w + sum(len(val)) OVER w - len(val) AS s, sum(len(gap)) OVER w + sum(len(val)) OVER w AS e, val, right(gap, 48) AS lft, left(lead(gap) OVER (PARTITION BY doc_id ORDER BY i), 48) AS rgt
  FROM (SELECT doc_id, unnest(range(len(gaps))) AS i, unnest(gaps) AS gap, unnest(vals) AS val FROM (SELECT doc_id, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS vals FROM t))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE val IS NOT NULL AND ({passes})"""


def listing(counted: tuple[str, ...], alias: str) -> str:
    """The digest columns of a table of spans."""
    names = ", ".join(f"'{k}'" for k in counted)
    text = "kind || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in counted)
    return f"""SELECT doc_id, {counts}, sha256(coalesce(string_agg({text}, ',' ORDER BY s, rank) FILTER (kind IN ({names})), '')) AS base_sha256,
coalesce(string_agg({text}, ',' ORDER BY s, rank), '') AS spans FROM (SELECT doc_id, kind, rank, s, e FROM t LEFT JOIN {alias} USING (doc_id)) GROUP BY doc_id"""


_T = "t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_terms = "[" + ", ".join(map(str, secrets.TERMS)) + "]"
_known = f"regexp_replace(val, '{secrets.KNOWN}', '', 'g')"

ORACLES["op5_secrets"] = rf"""
WITH {_T},
base AS ({found("assign", 0, _ASSIGN, "len(regexp_extract(val, '" + _ASSIGN.replace("'", "''") + "', 2)) >= 8")} UNION ALL {found("access", 1, "AKIA[A-Z0-9]+", "len(val) >= 16")} UNION ALL {found("hex", 2, "[0-9a-f]+", "len(val) >= 32")}),
runs AS ({found("entropy", 3, "[A-Za-z0-9+/_=-]{20,}", "regexp_matches(" + _known + ", '[0-9]') AND regexp_matches(" + _known + ", '[A-Za-z]') AND len(" + _known + ") >= 20")}),
windows AS (SELECT doc_id, s, val, unnest(range(len(val) - 19)) AS k FROM runs),
sums AS (SELECT doc_id, s, k, CASE WHEN regexp_matches(val, '^[0-9A-Fa-f]+$') THEN {secrets.limit_sum(3.0)} ELSE {secrets.limit_sum(3.6)} END AS most,
         list_sum(list_transform(map_values(list_aggregate(string_split(substr(val, k + 1, 20), ''), 'histogram')), lambda c: ({_terms})[c::BIGINT + 1])) AS total FROM windows),
hot AS (SELECT doc_id, 'entropy' AS kind, 3 AS rank, s + min(k) AS s, s + max(k) + 20 AS e FROM sums WHERE total <= most GROUP BY doc_id, sums.s),
spans AS (SELECT doc_id, kind, rank, s, e FROM base UNION ALL SELECT * FROM hot)
{listing(("assign", "access", "hex"), "spans")}"""

_LUHN = "list_sum(list_transform(range(len(digits)), lambda i: CASE WHEN i % 2 = 1 THEN 2 * digits[len(digits) - i]::INT - CASE WHEN digits[len(digits) - i]::INT > 4 THEN 9 ELSE 0 END ELSE digits[len(digits) - i]::INT END)) % 10 = 0"
_DIGITS = "string_split(regexp_replace(val, '[^0-9]', '', 'g'), '')"
_IBAN = "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(val, ' ', ''), 5) || substr(replace(val, ' ', ''), 1, 4), ''), lambda c: ascii(c))), lambda a, c: CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END) = 1"

ORACLES["op8_pii"] = rf"""
WITH {_T},
spans AS ({found("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")}
UNION ALL {found("ip", 1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(val, '.'), lambda p: len(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS BIGINT), 0) > 255)) = 0")}
UNION ALL {found("card", 2, r"[0-9]([\x20-]?[0-9])+", "len(" + _DIGITS + ") BETWEEN 12 AND 19 AND " + _LUHN.replace("digits", _DIGITS))}
UNION ALL {found("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", "len(" + _DIGITS + ") BETWEEN 9 AND 15")}
UNION ALL {found("iban", 4, pii.IBAN, _IBAN + " AND NOT regexp_matches(lft, '[A-Za-z0-9]$') AND NOT regexp_matches(rgt, '^[A-Za-z0-9]')")}
UNION ALL {found("ssn", 5, "[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT regexp_matches(val, '^(?:000|666|9)|-00-|-0000$') AND NOT regexp_matches(lft, '[0-9-]$') AND NOT regexp_matches(rgt, '^[0-9-]') AND regexp_matches(lower(lft || ' ' || left(rgt, 24)), '" + pii.WORDS["ssn"] + "')")})
{listing(pii.BASE, "spans")}"""

ORACLES["op7_chat"] = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
k AS (SELECT *, len(regexp_extract_all(text, '{WORD}')) + 4 AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
             23 + len(role) + len(text) + len(regexp_replace(role || text, '[^<\[\\]', '', 'g')) AS n FROM c),
h AS (SELECT *, coalesce(max(CASE WHEN pos = 1 AND role = 'system' AND tokens <= 512 THEN tokens END) OVER (PARTITION BY conv_id), 0) AS head FROM k),
x AS (SELECT *, (768 - head) // 2 AS st FROM h),
p AS (SELECT *, sum(tokens) OVER w - tokens AS start, sum((tokens > st)::INT) OVER w AS big FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
q AS (SELECT *, start // st + 2 * big - (tokens > st)::INT AS win, pos = 1 AND head > 0 AS sys FROM p),
w AS (SELECT conv_id, win, min(pos) AS p0, min(start) AS s0, least(256, 1024 - max(head) - sum(tokens)) AS room FROM q GROUP BY ALL HAVING min(pos) > 1),
again AS (SELECT w.conv_id, q.n FROM w JOIN q ON q.conv_id IS NOT DISTINCT FROM w.conv_id AND (q.sys OR q.pos BETWEEN w.p0 - 2 AND w.p0 - 1 AND w.s0 - q.start <= w.room)),
f AS (SELECT conv_id, sum(n) AS n FROM (SELECT conv_id, n FROM q UNION ALL SELECT * FROM again) GROUP BY conv_id),
r AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS whole, coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss FROM q GROUP BY conv_id)
SELECT r.conv_id, n_turns, sha256(whole) AS turns_sha256, len(loss) AS loss_chars, sha256(loss) AS loss_sha256, f.n::BIGINT AS formatted_chars FROM r JOIN f ON r.conv_id IS NOT DISTINCT FROM f.conv_id"""

ORACLES["op9_quality"] = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM t WHERE len(w) > 2),
h AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM g),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM h) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM t),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
m AS (SELECT t.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars, len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words FROM t LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > n_words OR 10 * n_dup_lines > 5 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept FROM m"""

ORACLES["op10_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: ('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[1 + ((CAST('0x' || substr(hex, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31)]), 'string_agg', '') AS payload_digest,
  CASE WHEN best IS NULL OR page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN best IS NOT NULL AND page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM q"""

ORACLES["op6_near_duplicates"] = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
sz AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT x, y FROM pairs JOIN sz a ON a.doc_id = x JOIN sz b ON b.doc_id = y WHERE 10 * c >= 8 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS d, doc_id AS root FROM documents UNION SELECT link.y, reach.root FROM reach JOIN link ON link.x = reach.d),
least AS (SELECT d, min(root) AS class_id FROM reach GROUP BY 1),
links AS (SELECT x, count(*) AS n FROM link GROUP BY 1)
SELECT w.doc_id, class_id, CASE WHEN len(w.w) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY w.text) END AS copies, coalesce(links.n, 0) AS n_links
FROM w JOIN least ON least.d = w.doc_id LEFT JOIN links ON links.x = w.doc_id"""

ORACLES["op12_source_divergence"] = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
o AS MATERIALIZED (SELECT doc, lang, source, unnest(w) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS ln FROM o GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 10),
l AS MATERIALIZED (SELECT lang, count(term) AS v, coalesce(sum(ln), 0) AS lt FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY 1),
c AS MATERIALIZED (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS MATERIALIZED (SELECT lang, source, v, lt, coalesce(sum(n), 0)::HUGEINT AS t FROM (SELECT DISTINCT lang, source FROM d) JOIN l USING (lang) LEFT JOIN c USING (lang, source) GROUP BY 1, 2, 3, 4),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.t + 2 * g.v) AS p, 1 + 1000000000 * (k.ln + 2) // (g.lt + 2 * g.v) AS q
      FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 10"""

ORACLES["op13_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2, ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN len(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

ORACLES["op11_suffix_dedup"] = """
WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, md5_number(array_slice(b, i + 1, i + 100)) AS h FROM (SELECT doc_id, b, unnest(range(n - 99)) AS i FROM d WHERE n >= 100)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
e AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true)::INT AS fresh FROM r),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM e),
s AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY doc_id, span),
k AS (SELECT doc_id, z AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM s UNION ALL SELECT doc_id, 0, min(a) FROM s GROUP BY 1),
t AS (SELECT doc_id, n, b, coalesce(removed, 0) AS removed, coalesce(spans, 0) AS spans FROM d LEFT JOIN (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM s GROUP BY 1) USING (doc_id)),
x AS (SELECT doc_id, string_agg(hex(array_slice(b, a + 1, coalesce(z, n))), '' ORDER BY a) AS h FROM k JOIN d USING (doc_id) WHERE a < coalesce(z, n) GROUP BY 1)
SELECT doc_id, n AS n_bytes, removed::BIGINT AS n_removed, spans AS n_spans, sha256(CASE WHEN removed = 0 THEN b ELSE unhex(coalesce(x.h, '')) END) AS kept_sha256 FROM t LEFT JOIN x USING (doc_id)"""
