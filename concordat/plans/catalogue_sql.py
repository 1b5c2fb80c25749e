"""DuckDB SQL for the queries of the catalogue."""

ORACLES: dict[str, str] = {}

_RULES = "SELECT o_custkey AS group_id, o_orderpriority AS action_key, o_orderkey AS id, o_orderstatus IN ('O', 'P') AS positive FROM orders"
_PAIRS = f"""SELECT a.group_id, a.action_key, a.id AS a_id, b.id AS b_id, a.positive AS a_p, b.positive AS b_p
  FROM ({_RULES}) a JOIN ({_RULES}) b ON a.group_id = b.group_id AND a.action_key = b.action_key AND a.id < b.id AND a.positive <> b.positive"""
_BOUNDS = """SELECT l_orderkey AS id, l_suppkey % 3 AS quantity, CAST(l_quantity + CASE WHEN l_linestatus = 'O' THEN 0 ELSE 10 END AS DOUBLE) AS v, l_linestatus = 'O' AS lower,
  CASE WHEN l_linestatus = 'O' THEN l_returnflag = 'R' ELSE l_returnflag = 'A' END AS open FROM lineitem"""
_FOLD = f"""SELECT id, quantity, max(struct_pack(v := v, f := CAST(open AS INT))) FILTER (lower) AS lo, min(struct_pack(v := v, f := CAST(NOT open AS INT))) FILTER (NOT lower) AS hi
  FROM ({_BOUNDS}) GROUP BY id, quantity"""


def _empty(lo: str, hi: str) -> str:
    return f"coalesce({lo}.v > {hi}.v OR ({lo}.v = {hi}.v AND ({lo}.f = 1 OR {hi}.f = 0)), false)"


ORACLES["eligible_pairs"] = f"SELECT group_id, action_key, a_id, b_id, row_number() OVER (PARTITION BY group_id ORDER BY a_id, b_id) AS n FROM ({_PAIRS})"
ORACLES["interval_fold"] = f"SELECT id, quantity, coalesce(lo.v, -1) AS lo_value, CAST(coalesce(lo.f, -1) AS BIGINT) AS lo_open, coalesce(hi.v, -1) AS hi_value, CAST(coalesce(hi.f, -1) AS BIGINT) AS hi_closed, {_empty('lo', 'hi')} AS is_empty FROM ({_FOLD})"
ORACLES["interval_overlap"] = f"""
WITH f AS (SELECT f.*, o_custkey FROM ({_FOLD}) f JOIN orders ON o_orderkey = id),
p AS (SELECT a.id AS a_id, b.id AS b_id, a.quantity,
  CASE WHEN a.lo IS NULL THEN b.lo WHEN b.lo IS NULL THEN a.lo ELSE greatest(a.lo, b.lo) END AS lo, CASE WHEN a.hi IS NULL THEN b.hi WHEN b.hi IS NULL THEN a.hi ELSE least(a.hi, b.hi) END AS hi
  FROM f a JOIN f b ON a.o_custkey = b.o_custkey AND a.quantity = b.quantity AND a.id < b.id)
SELECT a_id, b_id, quantity, NOT {_empty('lo', 'hi')} AS overlap FROM p"""
ORACLES["interval_coherent"] = """
WITH g AS (SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN p_size END AS ge, CASE WHEN p_partkey % 4 IN (1, 2) THEN p_size END AS gt,
  CASE WHEN p_partkey % 5 < 2 THEN 25 END AS le, CASE WHEN p_partkey % 5 IN (1, 2) THEN 25 END AS lt FROM part)
SELECT p_partkey, coalesce(ge, gt, le, lt) IS NOT NULL AND NOT (ge IS NOT NULL AND gt IS NOT NULL) AND NOT (le IS NOT NULL AND lt IS NOT NULL)
  AND coalesce(coalesce(ge, gt) < coalesce(le, lt) OR (coalesce(ge, gt) = coalesce(le, lt) AND gt IS NULL AND lt IS NULL), true) AS coherent FROM g"""
ORACLES["bound_satisfaction"] = """
SELECT c_custkey, CASE WHEN n_nationkey % 4 < 2 AND n_nationkey % 2 = 0 THEN c_acctbal > n_nationkey * 300 WHEN n_nationkey % 4 < 2 THEN c_acctbal >= n_nationkey * 300
  WHEN n_nationkey % 2 = 0 THEN c_acctbal < n_nationkey * 300 ELSE c_acctbal <= n_nationkey * 300 END AS satisfied FROM customer JOIN nation ON c_nationkey = n_nationkey"""
ORACLES["conflict_pairs"] = f"""
WITH p AS ({_PAIRS}), f AS ({_FOLD}),
ends AS (SELECT a_id, b_id, quantity, max(lo) AS lo, min(hi) AS hi FROM
  (SELECT a_id, b_id, quantity, lo, hi FROM p JOIN f ON f.id = a_id UNION ALL SELECT a_id, b_id, quantity, lo, hi FROM p JOIN f ON f.id = b_id) GROUP BY 1, 2, 3)
SELECT group_id, action_key, a_id, b_id FROM p WHERE NOT EXISTS (SELECT 1 FROM ends e WHERE e.a_id = p.a_id AND e.b_id = p.b_id AND {_empty('e.lo', 'e.hi')})"""
ORACLES["unsatisfiable_rules"] = f"SELECT id, count(*) AS n_empty FROM ({_FOLD}) WHERE {_empty('lo', 'hi')} GROUP BY id"
_KB = """
rule AS (SELECT 'd.rule.' || o_custkey AS rule_id, 'd.stmt.' || o_orderkey AS stmt_id FROM orders),
direction AS (SELECT 'd.rule.' || c_custkey AS rule_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'for' WHEN 'MACHINERY' THEN 'sideways' ELSE 'against' END AS direction FROM customer),
strength AS (SELECT 'd.rule.' || c_custkey AS rule_id, 'strong' AS strength FROM customer WHERE c_acctbal >= 0),
certainty AS (SELECT 'd.rule.' || c_custkey AS rule_id, v AS certainty FROM customer, (VALUES ('high'), ('low')) AS t(v) WHERE c_nationkey < 5),
population AS (SELECT 'd.stmt.' || o_orderkey AS stmt_id FROM orders WHERE o_orderstatus IN ('O', 'F')),
action AS (SELECT 'd.stmt.' || o_orderkey AS stmt_id, o_orderstatus AS s FROM orders),
condition AS (SELECT 'd.bind.' || (l_orderkey * 10 + l_linenumber) AS bind_id, 'd.stmt.' || l_orderkey AS stmt_id, l_returnflag AS f, l_linestatus AS s FROM lineitem),
exception AS (SELECT 'd.exc.' || l_orderkey AS exc_id, 'd.stmt.' || (l_orderkey + CASE WHEN l_tax > 0.07 THEN 10000000 ELSE 0 END) AS stmt_id, l_discount > 0.08 AS odd FROM lineitem WHERE l_quantity > 40),
source AS (SELECT 'd.rule.' || n_nationkey AS id, n_regionkey AS r FROM nation)"""
ORACLES["kb_violations"] = f"""
WITH {_KB}, v AS (
SELECT 'unknown_direction' AS kind, rule_id AS s FROM direction WHERE direction = 'sideways'
UNION ALL SELECT DISTINCT 'dangling_rule_ref', rule_id FROM (SELECT rule_id FROM direction UNION ALL SELECT rule_id FROM strength UNION ALL SELECT rule_id FROM certainty) WHERE rule_id NOT IN (SELECT rule_id FROM rule)
UNION ALL SELECT DISTINCT 'missing_strength', rule_id FROM rule WHERE rule_id NOT IN (SELECT rule_id FROM strength)
UNION ALL SELECT DISTINCT 'missing_direction', rule_id FROM rule WHERE rule_id NOT IN (SELECT rule_id FROM direction)
UNION ALL SELECT DISTINCT 'duplicate_certainty', rule_id FROM certainty
UNION ALL SELECT DISTINCT 'missing_population', stmt_id FROM rule WHERE stmt_id NOT IN (SELECT stmt_id FROM population)
UNION ALL SELECT DISTINCT 'malformed_action_key', stmt_id FROM action WHERE s = 'F'
UNION ALL SELECT DISTINCT 'unknown_action_kind', stmt_id FROM action WHERE s NOT IN ('O', 'F')
UNION ALL SELECT DISTINCT 'unknown_concept', bind_id FROM condition WHERE f = 'R'
UNION ALL SELECT DISTINCT 'bad_interval_openness', bind_id FROM condition WHERE f NOT IN ('A', 'R') AND s <> 'O'
UNION ALL SELECT bind_id AS k, b FROM (SELECT 'duplicate_bind' AS bind_id, bind_id AS b FROM condition GROUP BY bind_id HAVING count(*) > 1)
UNION ALL SELECT DISTINCT 'dangling_stmt_ref', stmt_id FROM (SELECT stmt_id FROM condition UNION ALL SELECT stmt_id FROM exception) WHERE stmt_id NOT IN (SELECT stmt_id FROM rule)
UNION ALL SELECT DISTINCT 'malformed_atom', exc_id FROM exception WHERE odd
UNION ALL SELECT 'duplicate_exception', exc_id FROM exception GROUP BY exc_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'malformed_source', id FROM source WHERE r <= 0
UNION ALL SELECT DISTINCT 'dangling_source_ref', id FROM source WHERE r > 0 AND id NOT IN (SELECT rule_id FROM rule))
SELECT kind, count(*) AS n FROM v GROUP BY kind"""
ORACLES["kb_fact_lines"] = f"""
WITH {_KB}, l AS (SELECT DISTINCT 'direction(''' || rule_id || ''',' || direction || ').' AS line FROM direction
UNION SELECT 'strength(''' || rule_id || ''',' || strength || ').' FROM strength UNION SELECT 'certainty(''' || rule_id || ''',' || certainty || ').' FROM certainty)
SELECT line, sha256(line) AS line_sha FROM l"""
ORACLES["derivable"] = """
WITH segs AS (SELECT ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'] AS s)
SELECT c_custkey AS ctx_id, 'd.stmt.' || n_nationkey AS stmt_id FROM customer, nation, segs
WHERE (n_nationkey % 4 = 3 OR c_mktsegment = s[n_nationkey % 5 + 1])
  AND (n_nationkey % 3 <> 0 OR CASE WHEN n_nationkey % 2 = 0 THEN CAST(c_acctbal AS DECIMAL(18, 2)) >= n_nationkey * 200 ELSE CAST(c_acctbal AS DECIMAL(18, 2)) > n_nationkey * 200 END)
  AND NOT (n_nationkey % 4 <> 1 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND substr(o_orderpriority, 1, 1) = CAST(n_nationkey % 5 + 1 AS VARCHAR)))"""
ORACLES["relational_division"] = "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT o_totalprice > 20000)"
ORACLES["exception_expansion"] = """
WITH s AS (SELECT c_nationkey AS doc, o_custkey AS rule, o_orderkey AS stmt, o_orderpriority AS p FROM orders JOIN customer ON o_custkey = c_custkey),
e AS (SELECT DISTINCT doc, rule, p AS exc FROM s)
SELECT doc, rule, stmt, exc, row_number() OVER (PARTITION BY doc ORDER BY rule, stmt, exc) - 1 AS exc_no FROM (SELECT s.doc, s.rule, s.stmt, e.exc FROM s JOIN e ON s.doc = e.doc AND s.rule = e.rule)"""
ORACLES["exception_atoms"] = """
WITH g AS (SELECT l_orderkey, coalesce(list_distinct(list(l_returnflag) FILTER (l_linestatus = 'O')), []) AS a, coalesce(list_distinct(list('not ' || l_returnflag) FILTER (l_linestatus = 'F')), []) AS e FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(a, e))), '|') AS atoms FROM g"""
ORACLES["smt_bodies"] = f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY a_id, b_id) AS n FROM ({_PAIRS})),
b AS (SELECT *, '|pos:' || action_key || '|' AS p FROM n)
SELECT 'q.' || group_id || '.pair' || n || '.overlap' AS q1_id, 'q.' || group_id || '.pair' || n || '.deontic' AS q2_id, true AS looks_right,
 '(set-logic QF_UF)' || chr(10) || '(set-option :print-success false)' || chr(10) || '(set-option :produce-unsat-cores true)' || chr(10) || '(declare-const ' || p || ' Bool)' || chr(10) ||
 '(assert (! ' || CASE WHEN a_p THEN p ELSE '(not ' || p || ')' END || ' :named |a.' || a_id || '|))' || chr(10) ||
 '(assert (! ' || CASE WHEN b_p THEN p ELSE '(not ' || p || ')' END || ' :named |a.' || b_id || '|))' || chr(10) || '(check-sat)' || chr(10) || '(get-unsat-core)' || chr(10) AS body FROM b"""
ORACLES["smt_guards"] = f"""
WITH f AS ({_FOLD}),
t AS (SELECT id, quantity, list_filter([CASE WHEN lo.f = 0 THEN '(>= |q.' || quantity || '| ' || CAST(lo.v AS BIGINT) || ')' END, CASE WHEN lo.f = 1 THEN '(> |q.' || quantity || '| ' || CAST(lo.v AS BIGINT) || ')' END,
  CASE WHEN hi.f = 1 THEN '(<= |q.' || quantity || '| ' || CAST(hi.v AS BIGINT) || ')' END, CASE WHEN hi.f = 0 THEN '(< |q.' || quantity || '| ' || CAST(hi.v AS BIGINT) || ')' END], lambda x: x IS NOT NULL) AS b FROM f),
a AS (SELECT id, list(CASE WHEN len(b) = 1 THEN b[1] ELSE '(and ' || array_to_string(b, ' ') || ')' END ORDER BY quantity) AS atoms, string_agg('(declare-const |q.' || quantity || '| Real)', chr(10) ORDER BY quantity) AS declared FROM t GROUP BY id)
SELECT id, CASE WHEN len(atoms) = 1 THEN atoms[1] ELSE '(and ' || array_to_string(atoms, ' ') || ')' END AS guard, declared FROM a"""

ORACLES["dictionary_scan"] = """
SELECT doc_id, surface, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(Licensed under|password|secret|de la|that|tion|and|the|de)', 1)) AS surface FROM documents) GROUP BY 1, 2"""
_WHITE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
ORACLES["string_policies"] = f"""
SELECT doc_id, sha256(translate(translate(trim(regexp_replace(text, '{_WHITE}', ' ', 'g')), '、。', ',.'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS folded_sha,
  CASE WHEN regexp_full_match(source, '[a-z0-9_:./-]+') THEN source END AS source_id, strlen(text) AS n_bytes FROM documents"""
ORACLES["nearest_preceding"] = """
SELECT conv_id, turn, coalesce(user_turn, -1) AS user_turn FROM (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_turn FROM conversations) WHERE role = 'assistant'"""
ORACLES["trace_closure"] = """
WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn FROM conversations),
r AS (SELECT conv_id, turn, turn AS root, CAST(0 AS BIGINT) AS depth FROM t AS a WHERE NOT EXISTS (SELECT 1 FROM t AS b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 1)
  UNION ALL SELECT t.conv_id, t.turn, r.root, r.depth + 1 FROM r JOIN t ON t.conv_id = r.conv_id AND t.turn = r.turn + 1)
SELECT * FROM r"""
ORACLES["slot_resolution"] = """
WITH k AS (SELECT user_id, coalesce(list_sort(list_distinct(list(event_type) FILTER (event_type IN ('purchase', 'error') AND value > 50))), []) AS k FROM events GROUP BY 1)
SELECT user_id, len(k) AS n, CASE len(k) WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status, CASE WHEN len(k) = 1 THEN k[1] END AS value, k[1] AS lowest FROM k"""
ORACLES["counter_ids"] = """
SELECT l_orderkey, l_linenumber, l_orderkey || '.seg.' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1) AS seg_id FROM lineitem WHERE l_returnflag <> 'N'"""
ORACLES["content_hash"] = """
WITH p AS (SELECT n_nationkey, '{"key":"' || n_nationkey || '","name":"' || n_name || '",' || CASE WHEN n_nationkey > 12 THEN '"note":"' || n_name || '",' ELSE '' END || '"region":{"tag":"region"' || coalesce(',"value":"' || r_name || '"', '') || '}}' AS payload
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, payload, 'sha256:' || sha256(payload) AS hash FROM p"""
ORACLES["set_hash"] = "SELECT p_size, 'sha256:' || sha256(string_agg(DISTINCT p_brand, chr(10) ORDER BY p_brand)) AS hash FROM part GROUP BY 1"
ORACLES["structural_hash"] = """
WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_partkey) AS first FROM lineitem),
d AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY first, l_partkey) - 1 AS i FROM f)
SELECT l_orderkey, string_agg('i' || i, ' ' ORDER BY l_linenumber, l_partkey) AS names, 'sha256:' || sha256('[' || string_agg('"i' || i || '"', ',' ORDER BY l_linenumber, l_partkey) || ']') AS hash FROM d GROUP BY 1"""
ORACLES["replay_diff"] = """
WITH o AS (SELECT sha256(o_orderkey || '|' || o_orderstatus) AS hash, * FROM orders), l AS (SELECT hash FROM o WHERE o_totalprice > 10000), r AS (SELECT hash FROM o WHERE o_orderpriority <> '1-URGENT')
SELECT hash, 'left' AS side FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT hash, 'right' FROM (SELECT * FROM r EXCEPT SELECT * FROM l)"""
ORACLES["severity_fold"] = """
WITH m AS (SELECT user_id, max(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 5 END) AS rank FROM events GROUP BY 1)
SELECT user_id, CAST(rank AS BIGINT) AS rank, ['ok', 'residual', 'ambiguity', 'unsupported', 'incoherence', 'invalid'][rank + 1] AS outcome FROM m"""
_METRICS = """
WITH e AS (SELECT event_type AS route, count(*) AS n, count(*) FILTER (value > 50) AS high, count(*) FILTER (value <= 0) AS none, count(DISTINCT user_id) AS users FROM events GROUP BY 1),
m AS (SELECT route, 'acceptance_rate' AS metric, high AS a, n AS b FROM e UNION ALL SELECT route, 'recorded_call_count', n, 1 FROM e UNION ALL SELECT route, 'schema_valid_rate', n - none, n FROM e
  UNION ALL SELECT route, 'repair_rate', none, none FROM e UNION ALL SELECT route, 'users_per_call', users, n FROM e),
r AS (SELECT route, metric, CASE WHEN b <> 0 THEN a // gcd(a, b) END AS num, CASE WHEN b <> 0 THEN b // gcd(a, b) END AS den FROM m)"""
_AGREE = """
WITH p AS (SELECT user_id, isodow(ts) AS s, list_sort(list_distinct(list(event_type))) AS print FROM events GROUP BY 1, 2),
g AS (SELECT u.user_id, d.s, print FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(1, 8)) AS s) d LEFT JOIN p ON p.user_id = u.user_id AND p.s = d.s),
a AS (SELECT x.user_id, count(*) FILTER (x.print IS NOT DISTINCT FROM y.print) AS agreeing, count(*) AS pairs FROM g x JOIN g y ON x.user_id = y.user_id AND x.s < y.s GROUP BY 1)"""
ORACLES["sample_agreement"] = f"{_AGREE} SELECT * FROM a"
ORACLES["k_sample_convergence"] = f"{_AGREE}, t AS (SELECT sum(agreeing)::BIGINT AS a, sum(pairs)::BIGINT AS b FROM a) SELECT a // gcd(a, b) AS num, b // gcd(a, b) AS den FROM t"
ORACLES["failure_taxonomy"] = """
WITH b AS (SELECT user_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS code, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2)
SELECT u.user_id, coalesce(string_agg(code || ':' || n, ',' ORDER BY code), '') AS taxonomy FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN b ON b.user_id = u.user_id GROUP BY 1"""
ORACLES["key_coherence"] = """
SELECT 'repeated line' AS what, count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'customer without order', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'customer without nation', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey)"""
ORACLES["text_spans"] = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, p - 1 AS line, ls[p] AS x, list_sum(list_transform(ls[1:p], lambda y: strlen(y) + 1)) - 1 AS e FROM l, unnest(range(1, len(ls) + 1)) AS u(p))
SELECT doc_id, line, CAST(e - strlen(x) AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", 'sha256:' || sha256(x) AS text_hash FROM e"""
