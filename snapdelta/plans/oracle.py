"""The same questions as SQL for another engine, in relational form: a row a line, token, member and feature."""

from __future__ import annotations

from snapdelta.functions.families import sql_name, sql_value

EXCLUDED = ("fr/", "D1")

CORPUS = """
docs AS (SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS snapshot, 'L' || lang || '/D' || (d.doc_id // 2) || ';' AS class_name,
    lang, source, coalesce(text, '') AS text, CASE WHEN lang = 'en' THEN 'Ljava/lang/Object;' ELSE 'L' || lang || '/Base;' END AS extends,
    coalesce((quality = 1)::INT, 0) + coalesce((toxic = 1)::INT, 0) AS n_implements
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
lists AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: len(list_filter(string_split(x, ' '), lambda w: w <> '')) >= 2) AS lines FROM docs),
methods AS (SELECT doc_id, idx, line, string_split(line, ' ')[1] AS descriptor, string_split(line, ' ')[2] AS access
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS idx FROM lists)),
mwords AS (SELECT doc_id, idx, w FROM (SELECT doc_id, idx, unnest(string_split(line, ' ')) AS w FROM methods) WHERE length(w) >= 7),
mrefs AS (SELECT doc_id, idx, count(*) AS n FROM mwords GROUP BY ALL),
codes AS (SELECT doc_id, idx, p, unicode(c) AS op FROM (SELECT doc_id, idx, unnest(chars) AS c, generate_subscripts(chars, 1) AS p FROM (SELECT doc_id, idx, string_split(line, '') AS chars FROM methods))),
tokens AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS t FROM docs) WHERE t <> '' GROUP BY ALL),
fields AS (SELECT doc_id, t AS descriptor, right(t, 3) AS access, length(t) >= 10 AS analysed, n * length(t) AS n_read, unicode(t) % 7 AS n_write,
    CASE WHEN regexp_matches(t, '[0-9]') THEN t END AS init_value FROM tokens WHERE length(t) >= 9),
xfrom AS (SELECT DISTINCT doc_id, t AS peer, length(t)::VARCHAR AS kind FROM tokens WHERE length(t) <= 2),
xto AS (SELECT DISTINCT doc_id, substr(t, 1, 1) AS peer, length(t)::VARCHAR AS kind FROM tokens WHERE length(t) >= 7),
sizes AS (SELECT doc_id, snapshot, class_name,
    (SELECT count(*) FROM methods m WHERE m.doc_id = d.doc_id) AS n_methods, (SELECT count(*) FROM fields f WHERE f.doc_id = d.doc_id) AS n_fields,
    (SELECT count(*) FROM fields f WHERE f.doc_id = d.doc_id AND analysed) AS n_analysed_fields, n_implements,
    (SELECT count(DISTINCT peer) FROM xfrom x WHERE x.doc_id = d.doc_id) AS from_peers, (SELECT count(DISTINCT peer) FROM xto x WHERE x.doc_id = d.doc_id) AS to_peers
  FROM docs d),
live AS (SELECT * FROM sizes WHERE n_methods > 0 OR n_analysed_fields > 0)
"""

FEATURES = f"""
class_features AS (
  SELECT doc_id, unnest(list_filter(string_split(lang, ''), lambda c: c <> '')) AS feature, 1 AS n FROM docs
  UNION ALL SELECT doc_id, n_methods::VARCHAR, 1 FROM sizes
  UNION ALL SELECT doc_id, CASE WHEN n_fields > 0 THEN 'has_fields' ELSE 'no_fields' END, CASE WHEN n_fields > 0 THEN 3 ELSE 1 END FROM sizes
  UNION ALL SELECT doc_id, n_fields::VARCHAR, 1 FROM sizes
  UNION ALL SELECT doc_id, from_peers::VARCHAR, 1 FROM sizes WHERE from_peers > 0
  UNION ALL SELECT doc_id, kind, count(*) FROM xfrom GROUP BY ALL
  UNION ALL SELECT doc_id, to_peers::VARCHAR, 1 FROM sizes WHERE to_peers > 0
  UNION ALL SELECT doc_id, kind, count(*) FROM xto GROUP BY ALL
  UNION ALL SELECT doc_id, n_implements::VARCHAR, 1 FROM sizes
  UNION ALL SELECT doc_id, 'implements', 2 FROM sizes WHERE n_implements > 0
  UNION ALL SELECT doc_id, 'extends', 2 FROM docs WHERE extends <> 'Ljava/lang/Object;'),
method_features AS (
  SELECT doc_id, descriptor AS feature, 1 AS n FROM methods UNION ALL SELECT doc_id, access, 1 FROM methods
  UNION ALL SELECT doc_id, right(w, 3), 1 FROM mwords WHERE length(w) >= 9
  UNION ALL SELECT doc_id, '0', 1 FROM mrefs),
field_features AS (
  SELECT doc_id, unnest([descriptor, access, n_read::VARCHAR, n_write::VARCHAR]) AS feature, 1 AS n FROM fields WHERE analysed
  UNION ALL SELECT doc_id, init_value, 1 FROM fields WHERE analysed AND init_value IS NOT NULL),
code_features AS (SELECT doc_id, name AS feature, n FROM (SELECT doc_id, {sql_name('op')} AS name, n FROM (SELECT doc_id, op, count(*) AS n FROM codes GROUP BY ALL)) WHERE name IS NOT NULL),
features AS (SELECT doc_id, component, feature, sum(n)::BIGINT AS n FROM (
  SELECT *, 'class_sh' AS component FROM class_features UNION ALL SELECT *, 'method_sh' FROM method_features
  UNION ALL SELECT *, 'field_sh' FROM field_features UNION ALL SELECT *, 'code_sh' FROM code_features) GROUP BY ALL)
"""


def fnv(column: str) -> str:
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(0, length(hex({column})) // 2), lambda i: ('0x' || substr(hex({column}), 2 * i + 1, 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"


SIGNATURES = f"""
words AS (SELECT feature, {fnv('feature')} AS h FROM (SELECT DISTINCT feature FROM features)),
simhashes AS (SELECT doc_id, component, sum(n) AS total, {', '.join(f'sum(n * ((h >> {b}) & 1)) AS v{b}' for b in range(32))} FROM features JOIN words USING (feature) GROUP BY ALL),
packed AS (SELECT doc_id, component, ({' + '.join(f'CASE WHEN 2 * v{b} > total THEN {1 << b} ELSE 0 END' for b in range(32))})::BIGINT AS simhash FROM simhashes),
components AS (SELECT l.doc_id AS doc_id, snapshot, class_name, c AS component, coalesce(simhash, 0) AS simhash
  FROM (SELECT *, unnest(['class_sh', 'method_sh', 'field_sh', 'code_sh']) AS c FROM live) l LEFT JOIN packed p ON l.doc_id = p.doc_id AND l.c = p.component),
sigs AS (SELECT doc_id, snapshot, class_name, {', '.join(f"max(simhash) FILTER (component = '{c}') AS {c}" for c in ('class_sh', 'method_sh', 'field_sh', 'code_sh'))} FROM components GROUP BY ALL)
"""
_DISTANCE = " + ".join(f"bit_count(xor(a.{c}, b.{c}))::INT" for c in ("class_sh", "method_sh", "field_sh", "code_sh"))
#: By brute force: every class of a with every class of b.
PAIRS = f"""
pairs AS MATERIALIZED (SELECT * FROM (SELECT a.doc_id AS a_id, b.doc_id AS b_id, a.class_name AS class_a, b.class_name AS class_b, ({_DISTANCE})::BIGINT AS hamming
  FROM sigs a, sigs b WHERE a.snapshot = 'a' AND b.snapshot = 'b') WHERE hamming <= 3)
"""

SEQUENCES = f"""
mapped AS (SELECT doc_id, idx, list(v ORDER BY p) AS vs FROM (SELECT doc_id, idx, p, {sql_value('op')} AS v FROM codes) WHERE v IS NOT NULL GROUP BY ALL),
signed AS (SELECT m.doc_id, m.idx, coalesce(vs, []) AS vs,
    (len(coalesce(vs, [])) << 4) | coalesce(list_reduce(vs, lambda x, y: xor(x, y)), 0) AS sig FROM (SELECT doc_id, idx FROM methods) m LEFT JOIN mapped p ON m.doc_id = p.doc_id AND m.idx = p.idx),
latest AS (SELECT doc_id, sig, arg_max(vs, idx) AS vs FROM signed GROUP BY ALL),
sequences AS (SELECT l.doc_id AS doc_id, l.snapshot, l.class_name, coalesce(nullif(ltrim(string_agg(bits, '' ORDER BY sig), '0'), ''), '0') AS code FROM live l LEFT JOIN
  (SELECT doc_id, sig, array_to_string(list_transform(vs, lambda v: lpad(bin(v), 4, '0')), '') AS bits FROM latest) s ON l.doc_id = s.doc_id GROUP BY ALL)
"""


def jaccard(x: str, y: str) -> str:
    a, b = f"coalesce({x}, [])", f"coalesce({y}, [])"
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END)"


def cp(w: str, x: str, y: str) -> str:
    return f"(CASE WHEN {x} = {y} THEN {w}::DOUBLE ELSE {w}::DOUBLE * 0.9::DOUBLE / abs({x} - {y}) END)"


def mp(w: str, x: str, y: str) -> str:
    return f"(CASE WHEN abs({x} - {y}) < 1 THEN {w}::DOUBLE ELSE {w}::DOUBLE * 0.9::DOUBLE / abs({x} - {y}) END)"


def _refs(d: str) -> str:
    x, y = f"a.{d}_peers", f"b.{d}_peers"
    return f"(CASE WHEN {x} = 0 AND {y} = 0 THEN 0.1::DOUBLE WHEN {x} = 0 OR {y} = 0 THEN 0.05::DOUBLE * 0.9::DOUBLE / greatest({x}, {y}) ELSE {cp('0.05', x, y)} + 0.05::DOUBLE * {jaccard(f'a.{d}_kinds', f'b.{d}_kinds')} END)"


def J(w: str, c: str) -> str:
    return f"{w}::DOUBLE * {jaccard(f'a.{c}', f'b.{c}')}"


FIELDS_SCORE = f"(CASE WHEN a.n_analysed_fields = 0 AND b.n_analysed_fields = 0 THEN 0.16::DOUBLE WHEN a.n_analysed_fields = 0 OR b.n_analysed_fields = 0 THEN 0::DOUBLE ELSE {J('0.05', 'f_descriptors')} + {J('0.05', 'f_access')} + {mp('0.03', 'a.reads', 'b.reads')} + {mp('0.03', 'a.writes', 'b.writes')} END)"
CLASS_SCORE = f"({cp('0.08', 'a.n_methods', 'b.n_methods')} + {cp('0.06', 'a.n_fields', 'b.n_fields')} + {_refs('from')} + {_refs('to')} + {cp('0.04', 'a.n_implements', 'b.n_implements')})"
METHOD_SCORE = f"({J('0.08', 'm_descriptors')} + {J('0.07', 'm_access')} + 0.04::DOUBLE + 0.04::DOUBLE + {J('0.04', 'm_to_access')} + {mp('0.04', 'a.m_to', 'b.m_to')})"
#: Edit distances of all pairs; in slices that add up to all of them, as an engine that deals rows to threads by the thousand would take one thread.
CODED = "coded AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT a_id, b_id, CASE WHEN sa.code = sb.code THEN 0 ELSE levenshtein(sa.code, sb.code) END AS d FROM pairs p JOIN sequences sa ON p.a_id = sa.doc_id JOIN sequences sb ON p.b_id = sb.doc_id WHERE (p.a_id // 2) % 8 = {k}" for k in range(8)
) + "), code_scores AS (SELECT a_id, b_id, CASE WHEN d = 0 THEN 0.15::DOUBLE ELSE 0.12::DOUBLE / sqrt(d) END AS code_score FROM coded)"

SHAPES = f"""
shapes AS (SELECT s.*, f.* EXCLUDE (doc_id), m.* EXCLUDE (doc_id), r.* EXCLUDE (doc_id), coalesce(m_to_, 0) AS m_to, xf.kinds AS from_kinds, xt.kinds AS to_kinds,
    coalesce(reads_, 0) AS reads, coalesce(writes_, 0) AS writes FROM live s
  LEFT JOIN (SELECT doc_id, list(DISTINCT descriptor) AS f_descriptors, list(DISTINCT access) AS f_access, avg(n_read) FILTER (analysed) AS reads_, avg(n_write) FILTER (analysed) AS writes_ FROM fields GROUP BY 1) f ON s.doc_id = f.doc_id
  LEFT JOIN (SELECT doc_id, list(DISTINCT descriptor) AS m_descriptors, list(DISTINCT access) AS m_access FROM methods GROUP BY 1) m ON s.doc_id = m.doc_id
  LEFT JOIN (SELECT w.doc_id, list(DISTINCT right(w, 3)) FILTER (length(w) >= 9) AS m_to_access, any_value(x.mean) AS m_to_ FROM mwords w JOIN (SELECT doc_id, avg(n) AS mean FROM mrefs GROUP BY 1) x ON w.doc_id = x.doc_id GROUP BY 1) r ON s.doc_id = r.doc_id
  LEFT JOIN (SELECT doc_id, list(DISTINCT kind) AS kinds FROM xfrom GROUP BY 1) xf ON s.doc_id = xf.doc_id
  LEFT JOIN (SELECT doc_id, list(DISTINCT kind) AS kinds FROM xto GROUP BY 1) xt ON s.doc_id = xt.doc_id),
parts AS MATERIALIZED (SELECT p.a_id, p.b_id, class_a, class_b, {FIELDS_SCORE} AS fields_score, {CLASS_SCORE} AS class_score, {METHOD_SCORE} AS method_score
  FROM pairs p JOIN shapes a ON p.a_id = a.doc_id JOIN shapes b ON p.b_id = b.doc_id)
"""
TOTALS = """
scored AS (SELECT *, CASE WHEN 1 - s < 1e-7 THEN 1.0::DOUBLE ELSE s END AS score FROM (SELECT p.*, c.code_score, fields_score + class_score + method_score + c.code_score AS s FROM parts p JOIN code_scores c ON p.a_id = c.a_id AND p.b_id = c.b_id)),
best AS (SELECT class_a, max(score) AS score, string_agg(class_b, ',' ORDER BY class_b) AS candidates FROM (SELECT *, rank() OVER (PARTITION BY class_a ORDER BY round(score, 9) DESC) AS r FROM scored) WHERE r = 1 GROUP BY 1)
"""


def micro(column: str) -> str:
    return f"floor({column} * 1e6 + 0.5)::BIGINT"


_EXCLUDED = " OR ".join(f"strpos(substr(class_name, 2), '{e}') > 0" for e in EXCLUDED)
TO_PAIRS = [CORPUS, FEATURES, SIGNATURES, PAIRS]
TO_PARTS = [*TO_PAIRS, SHAPES]
TO_SCORES = [*TO_PARTS, SEQUENCES, CODED, TOTALS]


def q(parts: list[str], select: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts) + "\n" + select


def _features(component: str) -> str:
    return q([CORPUS, FEATURES], f"SELECT snapshot, class_name, feature, n FROM features JOIN docs USING (doc_id) WHERE component = '{component}'")


_PART = lambda part: q(TO_PARTS, f"SELECT class_a, class_b, {micro(part)} AS {part} FROM parts")
_SCORED = lambda part: q(TO_SCORES, f"SELECT class_a, class_b, {micro(part)} AS {part} FROM scored")
_HEX = " || ".join(f"lower(lpad(to_hex({c}), 8, '0'))" for c in ("class_sh", "method_sh", "field_sh", "code_sh"))
_BLOCK = " || '.' || ".join(f"(({c} >> (24 - 8 * block)) & 255)" for c in ("class_sh", "method_sh", "field_sh", "code_sh"))
_SOURCES = "JOIN docs da ON p.a_id = da.doc_id JOIN docs db ON p.b_id = db.doc_id"
_SAME = "bool_or(da.source = db.source AND da.lang = db.lang)"

_UNMAPPED = lambda s: f"(SELECT count(*) FROM codes c JOIN live l ON c.doc_id = l.doc_id WHERE snapshot = '{s}' AND ({sql_value('op')}) IS NULL) AS unmapped_{s}"

ORACLE = {
    "package_classes": """
      SELECT 'Lnation/N' || n_nationkey || ';' AS class_name, true AS is_internal, 'public final' AS access_flags, 'Lregion/R' || n_regionkey || ';' AS extends, 1::BIGINT AS n_methods, 1::BIGINT AS n_fields,
        n_nationkey::VARCHAR AS init_value, 'STRING,CALL,ENDOFBASICBLOCK' AS families, 1::BIGINT AS n_used, 0::BIGINT AS n_users FROM nation
      UNION ALL SELECT 'Lregion/R' || r_regionkey || ';', true, 'public abstract', 'Ljava/lang/Object;', 1, 0, NULL, 'CALL,ENDOFBASICBLOCK', 1, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) FROM region
      UNION ALL SELECT 'Ljava/lang/Object;', false, '', 'Ljava/lang/Object;', 0, 0, NULL, '', 0, (SELECT count(*) FROM region)""",
    "scan_classes": q([CORPUS], "SELECT d.snapshot, d.class_name, d.lang AS access_flags, d.extends, s.n_methods, s.n_fields, s.n_analysed_fields, s.n_implements::BIGINT AS n_implements FROM docs d JOIN sizes s ON d.doc_id = s.doc_id"),
    "excluded_filter": q([CORPUS], f"SELECT snapshot, class_name FROM docs WHERE NOT ({_EXCLUDED})"),
    "empty_filter": q([CORPUS], "SELECT snapshot, class_name, n_methods = 0 AND n_analysed_fields = 0 AS is_empty FROM sizes"),
    "opcode_family": q([CORPUS], f"SELECT op AS opcode, count(*) AS n, {sql_name('op')} AS family, {sql_value('op')}::INT AS value FROM codes GROUP BY op"),
    "class_features": _features("class_sh"),
    "method_features": _features("method_sh"),
    "field_features": _features("field_sh"),
    "code_features": _features("code_sh"),
    "fnv1a32": q([CORPUS], f"SELECT t AS feature, {fnv('t')} AS h FROM (SELECT DISTINCT t FROM tokens)"),
    "simhash32": q([CORPUS, FEATURES, SIGNATURES], "SELECT snapshot, class_name, component, simhash FROM components"),
    "signature128": q([CORPUS, FEATURES, SIGNATURES], f"SELECT snapshot, class_name, {_HEX} AS signature FROM sigs"),
    "lsh_blocks": q([CORPUS, FEATURES, SIGNATURES], f"SELECT snapshot, class_name, block, {_BLOCK} AS block_key FROM (SELECT *, unnest([0, 1, 2, 3]) AS block FROM sigs)"),
    "near_dup_join": q(TO_PAIRS, "SELECT class_a, class_b, hamming FROM pairs"),
    "deleted_anti": q(TO_PAIRS, "SELECT class_name FROM live WHERE snapshot = 'a' AND class_name NOT IN (SELECT class_a FROM pairs)"),
    "added_anti": q(TO_PAIRS, "SELECT class_name FROM live WHERE snapshot = 'b' AND class_name NOT IN (SELECT class_b FROM pairs)"),
    "name_absent_count": q(TO_PAIRS, f"SELECT count(*) AS name_absent FROM (SELECT class_a FROM pairs p {_SOURCES} GROUP BY 1 HAVING NOT {_SAME})"),
    "candidate_report": q(TO_PAIRS, f"""SELECT l.class_name AS class_a, l.class_name || CASE WHEN c IS NULL THEN ' -> none' ELSE CASE WHEN same THEN '' ELSE ' (own name missing)' END || ' -> [' || c || ']' END AS line
      FROM live l LEFT JOIN (SELECT class_a, string_agg(class_b, ' ' ORDER BY class_b) AS c, {_SAME} AS same FROM pairs p {_SOURCES} GROUP BY 1) x ON l.class_name = x.class_a WHERE snapshot = 'a'"""),
    "summary_metrics": q(TO_PAIRS, f"""SELECT (SELECT count(*) FROM live WHERE snapshot = 'a') AS classes_a, (SELECT count(*) FROM live WHERE snapshot = 'b') AS classes_b, {_UNMAPPED('a')}, {_UNMAPPED('b')}, count(*) AS pairs,
      count(DISTINCT class_a) AS with_candidates, (SELECT count(*) FROM live WHERE snapshot = 'a') - count(DISTINCT class_a) AS without_candidates, {micro('(count(*)::DOUBLE / nullif(count(DISTINCT class_a), 0))')} AS mean_candidates FROM pairs"""),
    "jaccard": q(TO_PARTS, f"SELECT class_a, class_b, {micro(jaccard('a.f_descriptors', 'b.f_descriptors'))} AS jaccard FROM pairs p JOIN shapes a ON p.a_id = a.doc_id JOIN shapes b ON p.b_id = b.doc_id"),
    "avg_or_zero": q([CORPUS], f"SELECT l.snapshot, l.class_name, {micro('coalesce(avg(n_read), 0)')} AS reads FROM live l LEFT JOIN (SELECT * FROM fields WHERE analysed) f ON l.doc_id = f.doc_id GROUP BY 1, 2"),
    "ratio_penalty": q(TO_PARTS, f"SELECT class_a, class_b, {micro(cp('0.08', 'a.n_methods', 'b.n_methods'))} AS count_penalty, {micro(mp('0.03', 'a.reads', 'b.reads'))} AS mean_penalty FROM pairs p JOIN shapes a ON p.a_id = a.doc_id JOIN shapes b ON p.b_id = b.doc_id"),
    "method_code_sig": q([CORPUS, SEQUENCES], "SELECT l.snapshot, l.class_name, idx::INT AS idx, sig::BIGINT AS sig FROM signed s JOIN live l ON s.doc_id = l.doc_id"),
    "code_sequence": q([CORPUS, SEQUENCES], "SELECT snapshot, class_name, code FROM sequences"),
    "code_score": _SCORED("code_score"),
    "fields_score": _PART("fields_score"),
    "class_score": _PART("class_score"),
    "method_score": _PART("method_score"),
    "score_pairs": q(TO_SCORES, f"SELECT class_a, class_b, {', '.join(f'{micro(c)} AS {c}' for c in ('fields_score', 'class_score', 'method_score', 'code_score', 'score'))} FROM scored"),
    "similarity_score": _SCORED("score"),
    "best_match": q(TO_SCORES, f"SELECT class_a, {micro('score')} AS score, candidates FROM best"),
    "best_above_threshold": q(TO_SCORES, f"SELECT class_a, class_b, {micro('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY class_a ORDER BY round(score, 9) DESC, class_b) AS r FROM scored WHERE score >= 0.5) WHERE r = 1"),
    "diff_status": q(TO_SCORES, f"""SELECT class_a AS class_name, 'similar' AS status, {micro('score')} AS score, candidates FROM best
      UNION ALL SELECT class_name, 'deleted', NULL, '' FROM live WHERE snapshot = 'a' AND class_name NOT IN (SELECT class_a FROM pairs)
      UNION ALL SELECT class_name, 'added', NULL, '' FROM live WHERE snapshot = 'b' AND class_name NOT IN (SELECT class_b FROM pairs)
      UNION ALL SELECT class_name, 'empty', NULL, '' FROM sizes WHERE snapshot = 'a' AND n_methods = 0 AND n_analysed_fields = 0"""),
}
