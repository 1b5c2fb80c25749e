"""DuckDB SQL for the queries of records."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# --- controlled language: blocks of an order, in words of both dialects ------------------------

_KEYWORD = "CASE o_orderkey % 6 WHEN 0 THEN 'recommend' WHEN 1 THEN 'suggest' WHEN 2 THEN 'may-consider' WHEN 3 THEN 'not-recommend' WHEN 4 THEN 'not-suggest' ELSE 'contraindicate' END"
_FRAME = "CASE o_orderkey % 6 WHEN 0 THEN 'it is recommended that' WHEN 1 THEN 'it is recommended that' WHEN 2 THEN 'it is admissible that' WHEN 3 THEN 'it is not recommended that' WHEN 4 THEN 'it is not recommended that' ELSE 'it is not possible that' END"
_CONCEPT = "CASE (o_orderkey + {0}) % 3 WHEN 0 THEN 'sepsis' WHEN 1 THEN 'severe-renal-impairment' ELSE 'pregnancy' END"
_MARKER = "CASE o_orderkey % 4 WHEN 0 THEN 'at least' WHEN 1 THEN 'more than' WHEN 2 THEN 'at most' ELSE 'less than' END"
_AGE = "o_orderkey % 90 + 2"


def _sentence(k: int) -> str:
    return f"""concat(chr(10), 'If a patient has a ', {_CONCEPT.format(k)}, CASE WHEN (o_orderkey + {k}) % 2 = 0 THEN concat(' and the patient has an age of ', {_MARKER}, ' ', {_AGE}, ' years') ELSE '' END,
  ' then ', {_FRAME}, ' the patient takes Abx-A.')"""


BLOCKS = f"""concat(chr(10), chr(10), 'rule ', o_orderkey, ' ', {_KEYWORD}, CASE WHEN o_orderkey % 4 = 0 THEN ' certainty low' ELSE '' END, CASE WHEN o_orderkey % 5 = 0 THEN concat(' basis "b', o_orderkey, '"') ELSE '' END,
 {_sentence(0)}, CASE WHEN o_orderkey % 2 = 1 THEN {_sentence(1)} ELSE '' END,
 CASE WHEN o_orderkey % 3 = 0 THEN concat(chr(10), chr(10), 'exception ', o_orderkey, ' rule ', o_orderkey, chr(10), 'A patient has a ', {_CONCEPT.format(2)}, '.') ELSE '' END)"""

_ID = "CASE ({0}) WHEN 'sepsis' THEN 'cond.sepsis' WHEN 'severe-renal-impairment' THEN 'cond.renal_severe' ELSE 'cond.pregnancy' END"
_FACTS = f"""
o AS (SELECT *, 'd' || o_custkey AS d, 1 + o_orderkey % 2 AS ns, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS ne FROM orders WHERE o_custkey % 10 <> 3),
r AS (SELECT *, d || '.rule.' || (row_number() OVER w - 1) AS rule, sum(ns) OVER w - ns AS s0, sum(ns + ne) OVER w - ns - ne AS i0, sum(ns * ne) OVER w - ns * ne AS e0 FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
s AS (SELECT *, d || '.stmt.' || (s0 + j) AS stmt, CASE WHEN (o_orderkey + j) % 2 = 0 THEN 2 ELSE 1 END AS na FROM (SELECT *, unnest(range(0, ns)) AS j FROM r)),
a AS (SELECT *, sum(na) OVER (PARTITION BY o_custkey ORDER BY o_orderkey, j) - na AS b0 FROM s),
facts AS (
 SELECT d AS document_id, 'direction' AS relation, rule AS a, CASE o_orderkey % 6 WHEN 2 THEN 'permit' WHEN 3 THEN 'against' WHEN 4 THEN 'against' WHEN 5 THEN 'contraindicate' ELSE 'for' END AS b, '' AS rest FROM r
 UNION ALL SELECT d, 'strength', rule, CASE WHEN o_orderkey % 6 IN (0, 3, 5) THEN 'strong' ELSE 'weak' END, '' FROM r
 UNION ALL SELECT d, 'certainty', rule, 'low', '' FROM r WHERE o_orderkey % 4 = 0
 UNION ALL SELECT d, 'source', rule, d, array_to_string(range(CAST(i0 AS BIGINT), CAST(i0 + ns AS BIGINT)), ',') || CASE WHEN o_orderkey % 5 = 0 THEN '|b' || o_orderkey ELSE '' END FROM r
 UNION ALL SELECT d, 'rule', rule, stmt, '' FROM a UNION ALL SELECT d, 'population', stmt, 'pop.patient', '' FROM a UNION ALL SELECT d, 'action', stmt, 'act.administer:drug.abx_a', '' FROM a
 UNION ALL SELECT d, 'condition', d || '.bind.' || CAST(b0 AS BIGINT), stmt, 'concept|' || {_ID.format("CASE (o_orderkey + j) % 3 WHEN 0 THEN 'sepsis' WHEN 1 THEN 'severe-renal-impairment' ELSE 'pregnancy' END")} FROM a
 UNION ALL SELECT d, 'condition', d || '.bind.' || CAST(b0 + 1 AS BIGINT), stmt, 'interval|q.age_years|' || ({_AGE}) || CASE o_orderkey % 4 WHEN 0 THEN '|closed|lower' WHEN 1 THEN '|open|lower' WHEN 2 THEN '|closed|upper' ELSE '|open|upper' END FROM a WHERE na = 2
 UNION ALL SELECT d, 'exception', d || '.exc.' || CAST(e0 + j AS BIGINT), stmt, 'concept|' || {_ID.format(_CONCEPT.format(2))} FROM a WHERE ne = 1
 UNION ALL SELECT d, 'source', d || '.exc.' || CAST(e0 + j AS BIGINT), d, CAST(CAST(i0 + ns AS BIGINT) AS VARCHAR) FROM a WHERE ne = 1),
lines AS (SELECT o_custkey AS c, sum(1 + o_orderkey % 2 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) AS n FROM orders GROUP BY 1)"""
ORACLES["cnl_facts"] = f"""
WITH {_FACTS} SELECT * FROM facts UNION ALL SELECT 'd' || c_custkey, 'reject', 'empty_block', '', CAST(CAST(coalesce(n, 0) AS BIGINT) AS VARCHAR) FROM customer LEFT JOIN lines ON c = c_custkey WHERE c_custkey % 10 = 3"""
_DOC = "CAST(regexp_extract({0}, '^d([0-9]+)[.]', 1) AS BIGINT)"
ORACLES["cnl_fact_violations"] = f"""
WITH {_FACTS}, rl AS (SELECT a AS rule, b AS stmt FROM facts WHERE relation = 'rule' AND {_DOC.format('a')} % 11 <> 2),
v AS (SELECT 'missing_population' AS kind, stmt FROM rl WHERE {_DOC.format('stmt')} % 7 = 0
 UNION SELECT 'duplicate_strength', a FROM facts WHERE relation = 'strength' AND {_DOC.format('a')} % 9 = 1
 UNION SELECT 'dangling_rule_ref', a FROM facts WHERE relation IN ('direction', 'strength', 'certainty') AND a NOT IN (SELECT rule FROM rl)
 UNION SELECT 'dangling_stmt_ref', a FROM facts WHERE relation = 'population' AND {_DOC.format('a')} % 7 <> 0 AND a NOT IN (SELECT stmt FROM rl)
 UNION SELECT 'dangling_stmt_ref', a FROM facts WHERE relation = 'action' AND a NOT IN (SELECT stmt FROM rl)
 UNION SELECT 'dangling_stmt_ref', b FROM facts WHERE relation IN ('condition', 'exception') AND b NOT IN (SELECT stmt FROM rl)
 UNION SELECT 'dangling_source_ref', a FROM facts WHERE relation = 'source' AND a NOT IN (SELECT rule FROM rl) AND a NOT IN (SELECT a FROM facts WHERE relation = 'exception'))
SELECT kind, count(*) AS n FROM v GROUP BY kind"""

_ENDS = """f AS (SELECT l_orderkey AS k, l_suppkey % 3 AS q, max(struct_pack(v := v, f := CAST(op AS INT))) FILTER (lower) AS lo, min(struct_pack(v := v, f := CAST(NOT op AS INT))) FILTER (NOT lower) AS hi
 FROM (SELECT *, l_linestatus = 'O' AS lower, l_quantity + CASE WHEN l_linestatus = 'O' THEN 0 ELSE 10 END AS v, CASE WHEN l_linestatus = 'O' THEN l_returnflag = 'R' ELSE l_returnflag = 'A' END AS op FROM lineitem) GROUP BY 1, 2)"""


def _empty(lo: str, hi: str) -> str:
    return f"coalesce({lo}.v > {hi}.v OR ({lo}.v = {hi}.v AND ({lo}.f = 1 OR {hi}.f = 0)), false)"


ORACLES["kb_conflicts"] = f"""
WITH {_ENDS}, need AS (SELECT l_orderkey AS k, list_distinct(list(l_returnflag) FILTER (l_linenumber = 1)) AS need, list_distinct(list(l_returnflag) FILTER (l_linenumber = 2)) AS bar FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS k, 'd.rule.' || o_orderkey AS r, o_custkey AS c, o_orderstatus <> 'F' AS pos, coalesce(need, []) AS need, coalesce(bar, []) AS bar FROM orders LEFT JOIN need ON k = o_orderkey),
p AS (SELECT a.k AS ak, b.k AS bk, a.r AS rule_a, b.r AS rule_b FROM o a JOIN o b ON a.c = b.c AND a.r < b.r AND a.pos <> b.pos AND NOT list_has_any(list_concat(a.need, b.need), list_concat(a.bar, b.bar))),
e AS (SELECT ak, bk, q, max(lo) AS lo, min(hi) AS hi FROM (SELECT ak, bk, q, lo, hi FROM p JOIN f ON f.k = ak UNION ALL SELECT ak, bk, q, lo, hi FROM p JOIN f ON f.k = bk) GROUP BY 1, 2, 3)
SELECT rule_a, rule_b FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.ak = p.ak AND e.bk = p.bk AND {_empty('e.lo', 'e.hi')})"""

ORACLES["cassette_replay"] = """
WITH a AS (SELECT item_id AS source, item_id % 4 AS seed, CASE WHEN item_id % 6 = 0 THEN 'other' ELSE 'c' || (item_id % 7) END AS c, text FROM benchmark),
j AS (SELECT *, CASE WHEN seed <> source % 3 THEN 'missing' WHEN c = 'other' THEN 'constraint_drift' WHEN source % 5 = 0 AND regexp_matches(hex(encode(text)), '[A-F]') THEN 'invalid_hex' END AS problem FROM a)
SELECT source, seed, problem, CASE WHEN problem IS NULL THEN sha256(text) END AS output_sha FROM j"""
ORACLES["accepted_fills"] = """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS spot FROM orders),
e AS (SELECT o_custkey AS source, min(spot) FILTER (o_orderstatus = 'F') AS hit, min(spot) FILTER (o_orderstatus = 'P' AND substr(o_orderpriority, 1, 1) = '1') AS dead, max(spot) AS last FROM o WHERE spot <= 3 GROUP BY 1),
g AS (SELECT *, hit IS NOT NULL AND (dead IS NULL OR hit < dead) AS accepted FROM e)
SELECT source, accepted, CASE WHEN accepted THEN hit ELSE coalesce(dead, last) END AS repairs, CASE WHEN accepted THEN 'out ' || o_orderkey END AS output FROM g LEFT JOIN o ON o_custkey = source AND spot = hit"""
ORACLES["absent_grounding"] = """
SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS document_id, CAST(l_partkey AS VARCHAR) AS id, 'region' AS what FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0)
UNION ALL SELECT DISTINCT CAST(l_orderkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), 'word' FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)"""
ORACLES["log_round_trip"] = "SELECT event_id AS sequence, 'u' || user_id AS run_id, event_type AS event FROM events"
ORACLES["stage_chains"] = """
WITH made AS (SELECT conv_id, x AS kind, min(turn) AS first FROM (SELECT conv_id, turn, unnest(CASE WHEN role = 'user' THEN ['assistant'] ELSE ['user', 'tool'] END) AS x FROM conversations) GROUP BY 1, 2)
SELECT t.conv_id AS pipeline, t.turn AS ord, t.need AS kind FROM (SELECT conv_id, turn, unnest([role, 'tool']) AS need FROM conversations WHERE turn > 0) t LEFT JOIN made ON made.conv_id = t.conv_id AND made.kind = t.need WHERE first IS NULL OR first >= t.turn"""
ORACLES["safe_paths"] = """
WITH u AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS u FROM pages)
SELECT page_id, coalesce(page_id % 6 = 0 AND u <> '' AND NOT list_has_any(string_split(u, '/'), ['', '.', '..']), false) AS safe FROM u"""
ORACLES["lexicon_candidates"] = """
SELECT surface, string_agg(DISTINCT 'reg.' || n_regionkey, ',' ORDER BY 'reg.' || n_regionkey) AS concepts FROM (SELECT n_regionkey, CASE WHEN n_nationkey % 2 = 1 THEN n_name || ' w' || (n_nationkey % 4) ELSE 'w' || (n_nationkey % 10) END AS surface FROM nation) GROUP BY surface"""
ORACLES["term_entries"] = """
SELECT CASE WHEN p_size % 2 = 0 THEN 'pn_sg' ELSE 'noun_sg' END AS form, p_name || ' ' || p_partkey AS surface, p_name || ' ' || p_partkey AS lemma, 'neutr' AS gender FROM part
UNION ALL SELECT * FROM (VALUES ('noun_sg', 'year', 'year', 'neutr'), ('noun_pl', 'years', 'year', 'neutr'), ('tv_finsg', 'takes', 'take', NULL), ('tv_infpl', 'take', 'take', NULL), ('tv_finsg', 'has', 'have', NULL), ('tv_infpl', 'have', 'have', NULL), (NULL, NULL, NULL, NULL))"""
ORACLES["term_integrity"] = """
SELECT 'uncovered' AS problem, 'cond.sepsis' AS subject UNION ALL SELECT 'unknown', 'cond.n' || n_nationkey FROM nation
UNION ALL SELECT 'ambiguous', 'word' || (n_nationkey % 15) FROM nation GROUP BY n_nationkey % 15 HAVING count(*) > 1"""

# --- readers and validators --------------------------------------------------------------------

PAYLOADS = """CASE event_id % 12 WHEN 0 THEN concat('{"k":"', user_id, '","note":"a b","share":{"den":"3","num":"-1"},"tags":["a","b:', event_id, '"]}')
 WHEN 1 THEN concat('{"k":"', user_id, '","tags":[]') WHEN 2 THEN concat('{"k":"', user_id, '","tags":[]} ') WHEN 3 THEN concat('{"k":', user_id, ',"tags":[]}')
 WHEN 4 THEN concat('{"k":"0', user_id, '","tags":[]}') WHEN 5 THEN concat('{"k":"', user_id, '","other":"","tags":[]}') WHEN 6 THEN '{"tags":[]}' WHEN 7 THEN concat('{"k":"', user_id, '","tags":["b","a"]}')
 WHEN 8 THEN concat('{"k":"', user_id, '","share":{"den":"4","num":"2"},"tags":[]}') WHEN 9 THEN concat('{"k":"', user_id, '","note":"a  b","tags":[]}') WHEN 10 THEN concat('{"k":"', user_id, '","tags":["A"]}')
 ELSE concat('{"k":"', user_id, '", "tags":[]}') END"""
ORACLES["canonical_reads"] = """
SELECT event_id, CASE event_id % 12 WHEN 1 THEN 'Eof' WHEN 2 THEN 'Trailing' WHEN 3 THEN 'Token' WHEN 4 THEN 'Integer' WHEN 5 THEN 'UnknownField' WHEN 6 THEN 'MissingField' WHEN 7 THEN 'Unsorted'
 WHEN 8 THEN 'RationalNotReduced' WHEN 9 THEN 'Unnormalized' WHEN 10 THEN 'Policy' WHEN 11 THEN 'Syntax' END AS error FROM events"""
ORACLES["solver_outputs"] = """
WITH e AS (SELECT event_id, event_id % 7 AS k, user_id, CASE WHEN event_id % 2 = 0 THEN 'overlap' ELSE 'deontic' END AS role FROM events),
v AS (SELECT *, CASE WHEN k = 0 THEN 'sat' WHEN k IN (1, 6) THEN 'unsat' WHEN k = 2 THEN 'unknown' END AS verdict FROM e),
c AS (SELECT *, CASE WHEN k IN (2, 3) THEN 'unknown' WHEN k = 4 THEN 'target_syntax_failure' WHEN k = 5 THEN 'solver_execution_failure' WHEN role = 'deontic' AND verdict = 'unsat' THEN 'semantic_contradiction' ELSE 'semantic_no_conflict' END AS category FROM v)
SELECT event_id, role, verdict, CASE WHEN k = 1 THEN 'a.d.rule.' || user_id || ',a.x' END AS core, '4.' || user_id AS version, category,
 CASE WHEN category = 'semantic_contradiction' THEN 'finding' WHEN category = 'semantic_no_conflict' AND NOT (role = 'overlap' AND verdict = 'sat') THEN 'no_conflict' END AS part FROM c"""
ORACLES["result_checks"] = """
WITH e AS (SELECT 'q.' || event_id AS query_id, event_id % 6 AS k, user_id % 5 AS m, event_type AS t, event_id % 4 AS c FROM events),
v AS (SELECT *, CASE WHEN k < 2 THEN 'sat' WHEN k < 4 THEN 'unsat' WHEN k = 4 THEN 'unknown' ELSE 'none' END AS verdict FROM e)
SELECT query_id, 'ModelWithoutSat' AS kind FROM v WHERE t IN ('view', 'click') AND verdict <> 'sat' UNION ALL SELECT query_id, 'CoreWithoutUnsat' FROM v WHERE m < 4 AND verdict <> 'unsat'
UNION ALL SELECT query_id, 'EmptyModel' FROM v WHERE t = 'click' UNION ALL SELECT query_id, 'EmptyCore' FROM v WHERE m = 3 UNION ALL SELECT query_id, 'Duplicate' FROM v WHERE m = 2 UNION ALL SELECT query_id, 'Unsorted' FROM v WHERE m = 1
UNION ALL SELECT query_id, 'CategoryVerdict' FROM v WHERE NOT (CASE c WHEN 0 THEN verdict = 'unsat' WHEN 1 THEN verdict IN ('sat', 'unsat') WHEN 2 THEN verdict = 'unknown' ELSE verdict = 'none' END)"""
ORACLES["artifact_checks"] = """
WITH o AS (SELECT *, o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS artifact, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
v AS (SELECT artifact, 'QueryCount' AS kind, '' AS subject FROM o GROUP BY artifact HAVING bool_or(k % 37 = 0)
 UNION SELECT artifact, 'QuerySlotMismatch', CAST(2 * n - 2 AS VARCHAR) FROM o WHERE k % 23 = 0
 UNION SELECT artifact, 'EmptyBody', CASE WHEN k % 23 = 0 THEN 'q.other' ELSE 'q.' || k || '.o' END FROM o WHERE k % 29 = 0
 UNION SELECT artifact, 'PairInvalid', 'pair' || CASE WHEN k % 31 = 0 THEN 1 ELSE n END FROM o WHERE k % 13 = 0 OR k % 17 = 0 OR k % 19 = 0
 UNION SELECT artifact, 'Duplicate', 'pair' || p FROM (SELECT artifact, CASE WHEN k % 31 = 0 THEN 1 ELSE n END AS p FROM o) GROUP BY artifact, p HAVING count(*) > 1
 UNION SELECT artifact, 'Duplicate', 'q.other' FROM o WHERE k % 23 = 0 GROUP BY artifact HAVING count(*) > 1
 UNION SELECT artifact, 'Unsorted', x || 'r1' FROM (SELECT artifact, k, CASE k % 5 WHEN 0 THEN 'x.' WHEN 1 THEN 'ctx.' ELSE 'a.' END AS x FROM o) WHERE k % 7 = 0
 UNION SELECT artifact, 'EmptyAssertionRefs', x || 'r' || k FROM (SELECT artifact, k, CASE k % 5 WHEN 0 THEN 'x.' WHEN 1 THEN 'ctx.' ELSE 'a.' END AS x FROM o) WHERE k % 7 = 1
 UNION SELECT artifact, 'AssertionForm', CASE WHEN k % 7 = 0 THEN 'x.r1' ELSE 'x.r' || k END FROM o WHERE k % 5 = 0 AND k % 7 <> 1)
SELECT artifact, kind, count(*) AS n FROM v GROUP BY 1, 2"""
ORACLES["trace_checks"] = """
WITH o AS (SELECT o_orderkey AS k, 'g' || o_custkey AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS spot FROM orders),
f AS (SELECT *, 'finding.' || g || '.' || CASE WHEN k % 41 = 0 THEN '0' || spot WHEN k % 43 = 0 THEN CAST(spot + 100 AS VARCHAR) ELSE CAST(spot AS VARCHAR) END AS id, CASE WHEN k % 41 = 0 THEN NULL WHEN k % 43 = 0 THEN spot + 100 ELSE spot END AS num FROM o)
SELECT kind, subject FROM (VALUES ('DuplicateNodeId', 'doc'), ('NodeKind', 'odd'), ('EmptyPath', 'odd'), ('EdgeUnresolved', 'doc lost'), ('EdgeRank', 'report doc'), ('EdgeOperation', 'report doc')) AS t(kind, subject)
UNION SELECT 'FindingIdForm', id FROM f WHERE k % 41 = 0
UNION SELECT 'FindingSequenceNumbers', g FROM f WHERE num IS NOT NULL GROUP BY g HAVING count(*) <> count(DISTINCT num) OR max(num) <> count(*) - 1
UNION SELECT 'QueryOutsidePair', id FROM f WHERE k % 13 = 0
UNION SELECT 'CategoryVerdict', id FROM f WHERE k % 2 = 0 AND k % 17 = 0
UNION SELECT 'ConflictKindPresence', id FROM f WHERE k % 19 = 0
UNION SELECT 'EmptyEvidence', id FROM f WHERE k % 11 = 1 UNION SELECT 'SetOrder', id FROM f WHERE k % 11 = 0
UNION SELECT 'ReportRef', id FROM f WHERE k % 23 = 0"""

# --- scalars -----------------------------------------------------------------------------------

_M64 = "18446744073709551616::UHUGEINT"
ORACLES["attempt_seeds"] = f"""
WITH a AS (SELECT o_orderkey, (CAST(o_orderkey * 1000003 AS UHUGEINT) + CAST(o_custkey % 5 AS UHUGEINT) * 11400714819323198485::UHUGEINT) % {_M64} AS z FROM orders),
b AS (SELECT o_orderkey, (CAST(xor(CAST(z AS UBIGINT), CAST(z AS UBIGINT) >> 30) AS UHUGEINT) * 13787848793156543929::UHUGEINT) % {_M64} AS z FROM a),
c AS (SELECT o_orderkey, (CAST(xor(CAST(z AS UBIGINT), CAST(z AS UBIGINT) >> 27) AS UHUGEINT) * 10723151780598845931::UHUGEINT) % {_M64} AS z FROM b)
SELECT o_orderkey, CAST(xor(CAST(z AS UBIGINT), CAST(z AS UBIGINT) >> 31) AS VARCHAR) AS seed FROM c"""
ORACLES["close_words"] = """
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), s AS (SELECT DISTINCT unnest([word || 'x', substr(word, 2), 'q' || substr(word, 2), reverse(word)]) AS surface FROM w)
SELECT word, surface, levenshtein(word, surface) AS distance FROM w, s WHERE levenshtein(word, surface) <= 1"""
_FOLDED = r"trim(regexp_replace(text || ' ', '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) || ' '"
ORACLES["compatibility_policies"] = f"""
WITH f AS (SELECT doc_id, text, ltrim({_FOLDED}) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, sha256(text || ' ﬁｎ①　Ａ、B。  ') AS raw, sha256(text || ' fin1 A、B。  ') AS nfkc, sha256(t || 'fin1 A、B。') AS folded, sha256(t || 'fin1 A,B.') AS ja,
 sha256(translate(t || 'fin1 A,B.', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS en FROM f"""
ORACLES["range_intersections"] = f"""
WITH b AS (SELECT l_orderkey AS id, l_suppkey % 3 AS quantity, l_quantity AS v, CASE l_returnflag WHEN 'R' THEN 'open' WHEN 'A' THEN 'closed' ELSE CASE WHEN l_tax > 0.07 THEN 'ajar' ELSE 'closed' END END AS o, l_linestatus = 'O' AS lower FROM lineitem),
f AS (SELECT id, quantity, max(struct_pack(v := v, f := CAST(o = 'open' AS INT))) FILTER (lower AND o <> 'ajar') AS lo, min(struct_pack(v := v, f := CAST(o = 'closed' AS INT))) FILTER (NOT lower AND o <> 'ajar') AS hi FROM b GROUP BY 1, 2)
SELECT id, quantity, coalesce(lo.v, -1) AS lo, coalesce(hi.v, -1) AS hi, CAST(coalesce(lo.f, -1) AS BIGINT) AS lo_open, CAST(coalesce(hi.f, -1) AS BIGINT) AS hi_closed, {_empty('lo', 'hi')} AS empty FROM f"""
ORACLES["single_bounds"] = "SELECT l_orderkey, l_suppkey % 3 AS quantity, count(*) = 1 AND bool_and(l_quantity >= 3 AND NOT l_tax > 0.07) AS lawful FROM lineitem GROUP BY 1, 2"
ORACLES["sparse_numbers"] = "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*)"
ORACLES["route_table"] = """
WITH o AS (SELECT o_orderpriority AS route, o_custkey AS g, o_orderkey AS k, o_orderstatus AS st FROM orders),
fills AS (SELECT route, 3 * count(*) AS calls, sum(k % 3) AS bad, sum(k % 2) AS repairs, count(*) FILTER (st = 'O') AS ok, count(*) AS n, count(*) FILTER (st <> 'P') AS parsed FROM o GROUP BY 1),
per AS (SELECT route, g, count(*) FILTER (st = 'O') AS c, count(*) AS n, count(*) FILTER (st = 'F') AS none FROM o GROUP BY 1, 2),
hit AS (SELECT route, count(*) FILTER (CASE WHEN g % 4 < 2 THEN c = 1 AND g % 2 = 0 ELSE n = none AND none >= 1 END) AS hits FROM per GROUP BY 1),
prints AS (SELECT route, g, print, count(*) AS n FROM (SELECT route, g, k % 3 AS s, max(st) AS print FROM o GROUP BY 1, 2, 3) GROUP BY 1, 2, 3),
same AS (SELECT route, sum(a) AS agreeing, 3 * count(*) AS pairs FROM (SELECT route, g, sum(n * (n - 1) // 2) + (3 - sum(n)) * (2 - sum(n)) // 2 AS a FROM prints GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT f.route, u.metric, u.num, u.den FROM fills f JOIN hit USING (route) JOIN same USING (route), LATERAL (SELECT unnest([
  {'metric': 'acceptance_rate', 'num': CAST(ok AS BIGINT), 'den': CAST(n AS BIGINT)}, {'metric': 'conflict_verdict_accuracy', 'num': CAST(hits AS BIGINT), 'den': (SELECT count(*) FROM customer)}, {'metric': 'k_sample_convergence', 'num': CAST(agreeing AS BIGINT), 'den': CAST(pairs AS BIGINT)},
  {'metric': 'recorded_call_count', 'num': CAST(calls AS BIGINT), 'den': CAST(1 AS BIGINT)}, {'metric': 'repair_count', 'num': CAST(repairs AS BIGINT), 'den': CAST(1 AS BIGINT)}, {'metric': 'schema_valid_rate', 'num': CAST(calls - bad AS BIGINT), 'den': CAST(calls AS BIGINT)}, {'metric': 'target_syntactic_validity', 'num': CAST(parsed AS BIGINT), 'den': CAST(n AS BIGINT)}], recursive := true)) AS u),
r AS (SELECT route, metric, num // gcd(num, den) AS num, den // gcd(num, den) AS den FROM m),
d AS (SELECT a.route, a.metric, a.num * b.den - b.num * a.den AS num, a.den * b.den AS den FROM r a JOIN r b ON a.metric = b.metric AND b.route = '1-URGENT' WHERE a.route <> '1-URGENT')
SELECT route, metric, num, den, 'value' AS what FROM r UNION ALL SELECT route, metric, CAST(sign(num) * (abs(num) // gcd(num, den)) AS BIGINT), den // gcd(num, den), 'delta' FROM d"""
