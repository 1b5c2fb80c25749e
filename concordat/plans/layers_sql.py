"""DuckDB SQL for the queries of layers: the tables of a run told from the orders alone."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

#: Texts and markup of an order's units, in words of both dialects.
_SLOTS = """concat(CASE o_orderkey % 4 WHEN 0 THEN '成人 ' WHEN 1 THEN '小児 ' ELSE '' END,
  CASE o_orderkey % 5 WHEN 0 THEN '状態X ' WHEN 1 THEN '状態Y ' WHEN 2 THEN '共通 ' ELSE '' END,
  CASE o_orderkey % 3 WHEN 0 THEN '薬A ' WHEN 1 THEN 'drugA ' ELSE '薬B ' END, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '投与 ' END,
  CASE WHEN o_orderkey % 11 < 6 THEN '推奨する' WHEN o_orderkey % 11 < 9 THEN '推奨しない' WHEN o_orderkey % 11 = 9 THEN '禁忌' ELSE '推奨する 推奨しない' END,
  CASE o_orderkey % 13 WHEN 0 THEN ' 根拠A' WHEN 1 THEN ' 根拠A 根拠B' ELSE '' END)"""
PARAGRAPH = f"""CASE o_orderstatus WHEN 'O' THEN {_SLOTS}
  WHEN 'F' THEN concat('ただし', CASE o_orderkey % 3 WHEN 0 THEN '状態X' WHEN 1 THEN '状態Y' ELSE '共通' END, 'を除く') ELSE concat('Plain ', o_orderkey) END"""
_HEADING = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN concat('CQ', o_orderkey, ' q') WHEN '2' THEN concat('定義 ', o_orderkey) END"
PIECE = f"""concat(coalesce(concat('<h2>', {_HEADING}, '</h2>'), ''), '<p>', {PARAGRAPH}, '</p>',
  CASE WHEN o_orderkey % 5 = 0 THEN concat('<ul><li>evidence ', o_orderkey, '</li><li> </li></ul>') ELSE '' END,
  CASE WHEN o_orderkey % 7 = 0 THEN concat('<table><tr><th>H', o_orderkey, '</th><th></th></tr><tr><td>a', o_orderkey, '</td><td>b', o_orderkey, '</td></tr></table>') ELSE '' END,
  CASE WHEN o_orderkey % 11 = 0 THEN '<div>x</div>' ELSE '' END)"""

# u: units of documents (c) in order (k, j); p: with node, span and region numbers and parents
_UNITS = f"""
u AS (SELECT c_custkey AS c, -2 AS k, 0 AS j, 'document' AS kind, NULL AS txt, NULL AS rw, NULL AS cl, NULL AS hd FROM customer
 UNION ALL SELECT c_custkey, -1, 0, 'section', 'Guideline ' || c_custkey, NULL, NULL, NULL FROM customer
 UNION ALL SELECT o_custkey, o_orderkey, 1, 'section', {_HEADING}, NULL, NULL, NULL FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('1', '2')
 UNION ALL SELECT o_custkey, o_orderkey, 2, 'paragraph', {PARAGRAPH}, NULL, NULL, NULL FROM orders
 UNION ALL SELECT o_custkey, o_orderkey, 3, 'list', NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 5 = 0
 UNION ALL SELECT o_custkey, o_orderkey, 4, 'paragraph', 'evidence ' || o_orderkey, NULL, NULL, NULL FROM orders WHERE o_orderkey % 5 = 0
 UNION ALL SELECT o_custkey, o_orderkey, 5, 'table', NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 7 = 0
 UNION ALL SELECT o_custkey, o_orderkey, 6, 'cell', 'H' || o_orderkey, '0', '0', 'true' FROM orders WHERE o_orderkey % 7 = 0
 UNION ALL SELECT o_custkey, o_orderkey, 7, 'cell', 'a' || o_orderkey, '1', '0', NULL FROM orders WHERE o_orderkey % 7 = 0
 UNION ALL SELECT o_custkey, o_orderkey, 8, 'cell', 'b' || o_orderkey, '1', '1', NULL FROM orders WHERE o_orderkey % 7 = 0
 UNION ALL SELECT o_custkey, o_orderkey, 9, 'residual', NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 11 = 0),
nk AS (SELECT *, 'doc.' || c AS doc, count(*) FILTER (kind <> 'residual') OVER w - 1 AS nk, count(txt) OVER w - 1 AS sk FROM u WINDOW w AS (PARTITION BY c ORDER BY k, j)),
here AS (SELECT *, max(CASE WHEN kind = 'section' THEN nk END) OVER w AS sec, max(CASE WHEN kind = 'list' THEN nk END) OVER w AS lst, max(CASE WHEN kind = 'table' THEN nk END) OVER w AS tab FROM nk WINDOW w AS (PARTITION BY c ORDER BY k, j)),
fst AS (SELECT *, kind = 'residual' AND row_number() OVER (PARTITION BY c, sec, kind ORDER BY k) = 1 AS opens FROM here),
p AS (SELECT *, count(*) FILTER (txt IS NOT NULL OR opens) OVER (PARTITION BY c ORDER BY k, j) - 1 AS rk,
  CASE WHEN kind = 'document' THEN NULL WHEN k = -1 THEN 0 WHEN kind = 'section' THEN 1 WHEN j = 4 THEN lst WHEN kind = 'cell' THEN tab ELSE sec END AS up FROM fst),
hd AS (SELECT c, nk AS sec, txt AS head FROM p WHERE kind = 'section')"""

ORACLES["html_graph"] = f"""
WITH {_UNITS} SELECT doc AS document_id, 'n.' || nk AS node_id, kind, 'n.' || up AS parent_id, rw AS row, cl AS col, hd AS header,
 CASE WHEN txt IS NOT NULL THEN 's.' || sk END AS span_id, txt AS raw_text, CASE WHEN txt IS NOT NULL THEN sk END AS reading_order FROM p WHERE kind <> 'residual'"""
ORACLES["html_regions"] = f"""
WITH {_UNITS} SELECT doc AS document_id, 'r.' || rk AS region_id, 'n.' || CASE WHEN kind = 'residual' THEN sec ELSE nk END AS nodes, CASE WHEN kind = 'residual' THEN '' ELSE 's.' || sk END AS spans FROM p WHERE txt IS NOT NULL OR opens"""
ORACLES["html_residuals"] = f"""
WITH {_UNITS} SELECT doc AS document_id, 'extraction_uncertain' AS code, 'residual' AS outcome, 'unknown flow element: div' AS detail, 'r.' || min(rk) AS regions, count(*) AS n FROM p WHERE kind = 'residual' GROUP BY doc, sec"""
ORACLES["span_texts"] = f"""
WITH {_UNITS} SELECT doc AS document_id, 's.' || sk AS span_id, CAST(0 AS BIGINT) AS start, CAST(strlen(txt) AS BIGINT) AS "end", txt AS search_text, 'sha256:' || sha256(txt) AS text_hash FROM p WHERE txt IS NOT NULL"""
ORACLES["text_blocks"] = f"""
WITH {_UNITS} SELECT doc AS document_id, 's.' || sk AS span_id, kind, txt AS raw_text, sk AS reading_order FROM p WHERE txt IS NOT NULL"""
ORACLES["table_cells"] = f"""
WITH {_UNITS} SELECT doc AS document_id, 'n.' || up AS table_id, CAST(rw AS BIGINT) AS row, CAST(cl AS BIGINT) AS col, hd IS NOT NULL AS header, txt AS text FROM p WHERE kind = 'cell'"""
ORACLES["graph_violations"] = f"""
WITH {_UNITS}, d AS (SELECT doc, c % 10 AS m, count(txt) AS spans, coalesce(bool_or(opens AND sec = 1), false) AS grounded FROM p GROUP BY doc, c)
SELECT doc AS document_id, kind, subject FROM d, (VALUES (1, 'MissingParent', 'n.1'), (2, 'SpanDerived', 's.0'), (3, 'SpanOffsets', 's.0'), (4, 'ReadingOrder', 's.1'),
 (5, 'Dangling', 's.0'), (5, 'UnspannedTextualNode', 'n.1'), (6, 'Dangling', 'r.0'), (7, 'Duplicate', 'r.0'), (8, 'EmptyRegion', 'r.66666'), (9, 'ExtraDocumentNode', 'n.55555')) AS v(n, kind, subject)
WHERE m = n AND NOT (n = 4 AND spans < 2) AND NOT (kind = 'UnspannedTextualNode' AND grounded)"""

# seg: numbered segments; found: concept surfaces in them
_SEGMENTS = f"""{_UNITS},
single AS (SELECT c, doc, k, j, sk AS place, 'r.' || rk AS regions, txt, CASE WHEN kind = 'section' AND regexp_matches(txt, '^CQ[0-9]') THEN 'cq' WHEN kind = 'section' THEN 'metadata' WHEN j = 4 THEN 'evidence'
  WHEN contains(txt, 'ただし') OR contains(txt, 'を除く') THEN 'exception' WHEN contains(txt, '推奨する') OR contains(txt, '推奨しない') OR contains(txt, '禁忌') THEN 'recommendation' END AS kind
  FROM p WHERE txt IS NOT NULL AND kind <> 'cell'),
tr AS (SELECT c, doc, k, NULL AS j, min(sk) AS place, array_to_string(list_sort(list('r.' || rk)), ',') AS regions, NULL AS txt, CASE WHEN NOT bool_and(hd IS NOT NULL) AND contains(any_value(head), '定義') THEN 'definition' ELSE 'table_row' END AS kind
  FROM (SELECT p.*, head FROM p JOIN hd USING (c, sec) WHERE kind = 'cell') GROUP BY c, doc, k, rw),
seg AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY place) - 1 AS ord FROM (SELECT * FROM single WHERE kind IS NOT NULL UNION ALL SELECT * FROM tr))"""
ORACLES["guideline_segments"] = f"WITH {_SEGMENTS} SELECT doc AS document_id, 'seg.' || ord AS segment_id, kind, regions FROM seg"
ORACLES["unplaced_spans"] = f"WITH {_SEGMENTS} SELECT doc AS document_id, 'segmentation_boundary_error' AS code, 'residual' AS outcome, 'unclassified paragraph: ' || txt AS detail, regions FROM single WHERE kind IS NULL"

_BOUND = f"""{_SEGMENTS},
lex AS (SELECT * FROM (VALUES ('drugA', 'drug.a', 'synonym', ''), ('薬A', 'drug.a', 'exact', ''), ('薬B', 'drug.b', 'exact', ''), ('成人', 'pop.adult', 'exact', ''), ('小児', 'pop.child', 'exact', ''),
  ('状態X', 'cond.x', 'exact', ''), ('状態Y', 'cond.y', 'exact', ''), ('共通', 'cond.y', 'ambiguous', 'cond.y,cond.z')) AS t(surface, code, status, alternatives)),
hits AS (SELECT *, unnest(regexp_extract_all(txt, 'drugA|状態X|状態Y|共通|小児|成人|薬A|薬B')) AS surface, unnest(range(len(regexp_extract_all(txt, 'drugA|状態X|状態Y|共通|小児|成人|薬A|薬B')))) AS spot FROM seg WHERE kind IN ('recommendation', 'exception')),
bound AS (SELECT hits.*, code, status, alternatives, row_number() OVER (PARTITION BY c ORDER BY ord, spot) - 1 AS b FROM hits JOIN lex USING (surface))"""
ORACLES["guideline_bindings"] = f"WITH {_BOUND} SELECT doc AS document_id, 'bind.' || b AS binding_id, 'seg.' || ord AS segment_id, kind, code, status, alternatives, regions, surface FROM bound"

_STATEMENTS = f"""{_SEGMENTS},
stmt AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY ord) - 1 AS n, CASE k % 4 WHEN 0 THEN 'pop.adult' WHEN 1 THEN 'pop.child' ELSE '' END AS population, CASE k % 5 WHEN 0 THEN 'cond.x' WHEN 1 THEN 'cond.y' ELSE '' END AS condition,
  CASE WHEN k % 3 = 2 THEN 'drug.b' ELSE 'drug.a' END AS target, CASE WHEN k % 11 < 6 THEN 'for' WHEN k % 11 < 9 THEN 'against' ELSE 'contraindicate' END AS direction, CASE WHEN k % 13 = 0 THEN 'high' END AS certainty
  FROM seg WHERE kind = 'recommendation' AND k % 11 <> 10 AND (k % 7 <> 0 OR k % 11 = 9))"""
ORACLES["guideline_statements"] = f"""
WITH {_STATEMENTS} SELECT doc AS document_id, 'stmt.' || n AS statement_id, 'seg.' || ord AS segment_id, population, condition, 'administer:' || target AS action_key, direction, 'strong' AS strength, certainty FROM stmt"""
ORACLES["withheld_statements"] = f"""
WITH {_SEGMENTS}, r AS (SELECT * FROM seg WHERE kind = 'recommendation')
SELECT doc AS document_id, 'terminology_ambiguous' AS code, 'ambiguity' AS outcome, 'modality for strong,against strong' AS detail, regions FROM r WHERE k % 11 = 10
UNION ALL SELECT doc, 'semantic_slot_missing', 'residual', 'kinds', regions FROM r WHERE k % 7 = 0 AND k % 11 <> 9
UNION ALL SELECT doc, 'terminology_ambiguous', 'ambiguity', 'certainty high,low', regions FROM r WHERE k % 13 = 1"""

_EXCEPTIONS = f"""{_STATEMENTS},
owned AS (SELECT e.*, (SELECT max(s.n) FROM stmt s WHERE s.c = e.c AND s.ord < e.ord) AS owner, CASE k % 3 WHEN 0 THEN 'cond.x' WHEN 1 THEN 'cond.y' END AS code FROM seg e WHERE kind = 'exception'),
exc AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY ord) - 1 AS x FROM owned WHERE owner IS NOT NULL AND code IS NOT NULL)"""
ORACLES["guideline_exceptions"] = f"""
WITH {_EXCEPTIONS} SELECT doc AS document_id, 'exc.' || x AS what, 'stmt.' || owner AS statement_id, code AS codes, regions FROM exc
UNION ALL SELECT doc, CASE WHEN owner IS NULL THEN 'exception without statement' ELSE 'exception without concept' END, '', 'semantic_slot_missing', regions FROM owned WHERE owner IS NULL OR code IS NULL"""

_RULES = f"""{_EXCEPTIONS},
bars AS (SELECT c, owner AS n, list_distinct(list(code)) AS bar, list_sort(list('"exc.' || x || '"')) AS refs, list(regions) AS more FROM exc GROUP BY c, owner),
rule AS (SELECT stmt.*, doc || '.rule.' || n AS rule_id, coalesce(bar, []) AS bar, coalesce(refs, []) AS refs, list_sort(list_distinct(list_concat([regions], coalesce(more, [])))) AS named,
  CASE WHEN condition = '' THEN [] ELSE [condition] END AS need, CASE population WHEN 'pop.adult' THEN 'ge' WHEN 'pop.child' THEN 'lt' END AS age FROM stmt LEFT JOIN bars USING (c, n)),
said AS (SELECT *, list_sort(list_concat(list_concat(CASE WHEN age IS NULL THEN [] ELSE ['{{"tag":"interval","value":{{"' || age || '":"18","var":"q.age"}}}}'] END,
  list_transform(need, lambda x: '{{"tag":"concept","value":"' || x || '"}}')), list_transform(bar, lambda x: '{{"tag":"concept_negated","value":"' || x || '"}}'))) AS atoms FROM rule),
shown AS (SELECT *, list_transform(atoms, lambda a: CASE WHEN contains(a, '"ge"') THEN '(>= |q.age| 18)' WHEN contains(a, '"lt"') THEN '(< |q.age| 18)' WHEN contains(a, 'negated') THEN '(not |' || regexp_extract(a, 'cond[.]\\w') || '|)' ELSE '|' || regexp_extract(a, 'cond[.]\\w') || '|' END) AS terms FROM said),
guarded AS (SELECT *, CASE len(terms) WHEN 0 THEN 'true' WHEN 1 THEN terms[1] ELSE '(and ' || array_to_string(terms, ' ') || ')' END AS guard FROM shown)"""
ORACLES["guideline_rules"] = f"""
WITH {_RULES} SELECT doc AS document_id, rule_id, '{{"action":{{"key":"administer:' || target || '","kind":"administer","target":"' || target || '"}},' || coalesce('"certainty":"' || certainty || '",', '') ||
 '"context":{{"any":[{{"all":[' || array_to_string(atoms, ',') || ']}}]}},"direction":"' || direction || '","exception_refs":[' || array_to_string(refs, ',') || '],"rule_id":"' || rule_id || '","source_region_ids":["' || array_to_string(named, '","') || '"],"strength":"strong"}}' AS payload,
 array_to_string(named, ',') AS regions FROM said"""
ORACLES["profile_gate"] = f"WITH {_RULES} SELECT doc AS document_id, rule_id FROM rule WHERE age IS NOT NULL"

_PAIRS = f"""{_RULES},
duo AS (SELECT a.c // 3 AS g, 'administer:' || a.target AS action_key, a.rule_id AS a_id, b.rule_id AS b_id, a.doc AS a_doc, b.doc AS b_doc, a.direction = 'for' AS a_pos, b.direction = 'for' AS b_pos, a.guard AS a_guard, b.guard AS b_guard,
  a.named AS a_named, b.named AS b_named, a.n AS a_n, b.n AS b_n, a.ord AS a_ord, b.ord AS b_ord, list_distinct(list_concat(list_concat(a.need, a.bar), list_concat(b.need, b.bar))) AS names, a.age IS NOT NULL OR b.age IS NOT NULL AS aged,
  NOT list_has_any(list_concat(a.need, b.need), list_concat(a.bar, b.bar)) AND NOT coalesce(a.age <> b.age, false) AS overlap
  FROM guarded a JOIN guarded b ON a.c // 3 = b.c // 3 AND a.target = b.target AND a.rule_id < b.rule_id AND (a.direction = 'for') <> (b.direction = 'for')),
pair AS (SELECT *, 'group.g' || g AS group_id, row_number() OVER (PARTITION BY g ORDER BY a_id, b_id) AS n, 'q.g' || g || '.pair' || row_number() OVER (PARTITION BY g ORDER BY a_id, b_id) AS q FROM duo),
res AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n, place) - 1 AS seq FROM (
  SELECT *, 0 AS place, q || '.overlap' AS query_id, 'overlap' AS role, 'semantic_no_conflict' AS category, CASE WHEN overlap THEN 'sat' ELSE 'unsat' END AS verdict, CASE WHEN NOT overlap THEN 'ctx.' || a_id || ',ctx.' || b_id END AS core FROM pair
  UNION ALL SELECT *, 1, q || '.deontic', 'deontic', 'semantic_contradiction', 'unsat', 'a.' || a_id || ',a.' || b_id FROM pair WHERE overlap))"""
_L = "chr(10)"
ORACLES["compiled_pairs"] = f"""
WITH {_PAIRS}, s AS (SELECT *, array_to_string(list_sort(list_concat(list_transform(names, lambda x: '(declare-const |' || x || '| Bool)'), CASE WHEN aged THEN ['(declare-const |q.age| Real)'] ELSE [] END)), {_L}) AS declared, '|pos:' || action_key || '|' AS sym FROM pair)
SELECT group_id, n, 'pair' || n AS pair_id, action_key, a_id, b_id, q || '.overlap' AS q1_id, q || '.deontic' AS q2_id, overlap,
 sha256('(set-logic QF_LRA)' || {_L} || '(set-option :print-success false)' || {_L} || '(set-option :produce-models true)' || {_L} || CASE WHEN declared = '' THEN '' ELSE declared || {_L} END ||
  '(assert (! ' || a_guard || ' :named |ctx.' || a_id || '|))' || {_L} || '(assert (! ' || b_guard || ' :named |ctx.' || b_id || '|))' || {_L} || '(check-sat)' || {_L} || '(get-model)' || {_L}) AS q1_sha,
 sha256('(set-logic QF_UF)' || {_L} || '(set-option :print-success false)' || {_L} || '(set-option :produce-unsat-cores true)' || {_L} || '(declare-const ' || sym || ' Bool)' || {_L} ||
  '(assert (! ' || CASE WHEN a_pos THEN sym ELSE '(not ' || sym || ')' END || ' :named |a.' || a_id || '|))' || {_L} || '(assert (! ' || CASE WHEN b_pos THEN sym ELSE '(not ' || sym || ')' END || ' :named |a.' || b_id || '|))' || {_L} || '(check-sat)' || {_L} || '(get-unsat-core)' || {_L}) AS q2_sha FROM s"""
ORACLES["assertion_map"] = f"""
WITH {_PAIRS} SELECT group_id, q || '.overlap' AS query_id, 'ctx.' || a_id AS assertion, a_id AS rule_id, array_to_string(a_named, ',') AS region_ids FROM pair
UNION ALL SELECT group_id, q || '.overlap', 'ctx.' || b_id, b_id, array_to_string(b_named, ',') FROM pair
UNION ALL SELECT group_id, q || '.deontic', 'a.' || a_id, a_id, array_to_string(a_named, ',') FROM pair
UNION ALL SELECT group_id, q || '.deontic', 'a.' || b_id, b_id, array_to_string(b_named, ',') FROM pair"""
ORACLES["query_results"] = f"WITH {_PAIRS} SELECT group_id, n, seq, query_id, role, category, verdict, core FROM res"
_QUOTED = """
side AS (SELECT group_id, n, a_doc AS doc, unnest(a_named) AS region FROM pair UNION SELECT group_id, n, b_doc, unnest(b_named) FROM pair),
quote AS (SELECT group_id, n, string_agg(txt, ' | ' ORDER BY doc, sk) AS quoted FROM (SELECT DISTINCT s.group_id, s.n, s.doc, p.sk, p.txt FROM side s JOIN p ON p.doc = s.doc AND 'r.' || p.rk = s.region AND p.txt IS NOT NULL) GROUP BY group_id, n)"""
ORACLES["guideline_findings"] = f"""
WITH {_PAIRS}, {_QUOTED} SELECT 'finding.' || group_id || '.' || seq AS finding_id, group_id, query_id, CASE role WHEN 'deontic' THEN 'finding' ELSE 'no_conflict' END AS part, category, verdict,
 CASE role WHEN 'deontic' THEN 'deontic_direction_conflict' END AS conflict_kind, core, a_id || ',' || b_id AS rules, quoted FROM res JOIN quote USING (group_id, n) WHERE verdict = 'unsat'"""
_LINEAGE = """
lin AS (SELECT 'finding.' || group_id || '.' || seq AS finding_id, a_doc AS document_id, query_id, category, a_id AS rule_id, 'stmt.' || a_n AS statement_id, 'seg.' || a_ord AS segment_id, a_named AS named FROM res
 UNION ALL SELECT 'finding.' || group_id || '.' || seq, b_doc, query_id, category, b_id, 'stmt.' || b_n, 'seg.' || b_ord, b_named FROM res)"""
ORACLES["finding_lineage"] = f"WITH {_PAIRS}, {_LINEAGE} SELECT finding_id, document_id, query_id, category, rule_id, statement_id, segment_id, array_to_string(named, ',') AS region_ids FROM lin"
ORACLES["fresh_lineage"] = f"""
WITH {_PAIRS}, {_LINEAGE} SELECT document_id, count(*) AS n, document_id || '.bundle' AS from_id, 'group.g' || (CAST(substr(document_id, 5) AS BIGINT) // 3) || '.compiled' AS to_id FROM lin
WHERE CAST(substr(document_id, 5) AS BIGINT) % 5 <> 0 GROUP BY document_id"""
ORACLES["trace_edges"] = f"""
WITH {_PAIRS}, {_LINEAGE}, sp AS (SELECT DISTINCT document_id, segment_id, 's.' || sk AS span_id FROM (SELECT document_id, segment_id, unnest(named) AS region FROM lin) l JOIN p ON p.doc = l.document_id AND 'r.' || p.rk = l.region AND p.txt IS NOT NULL)
SELECT DISTINCT * FROM (SELECT 'source' AS from_kind, document_id AS from_id, 'span' AS to_kind, document_id || '/' || span_id AS to_id FROM sp
UNION ALL SELECT 'span', document_id || '/' || span_id, 'segment', document_id || '/' || segment_id FROM sp
UNION ALL SELECT 'segment', document_id || '/' || segment_id, 'statement', document_id || '/' || statement_id FROM lin
UNION ALL SELECT 'statement', document_id || '/' || statement_id, 'rule', rule_id FROM lin
UNION ALL SELECT 'rule', rule_id, 'query', query_id FROM lin UNION ALL SELECT 'query', query_id, 'finding', finding_id FROM lin)"""
ORACLES["group_scores"] = f"""
WITH {_PAIRS}, per AS (SELECT g, count(*) FILTER (role = 'deontic') AS n_contra, count(*) AS n, max(core) FILTER (role = 'deontic') AS core, count(*) FILTER (role = 'overlap' AND verdict = 'unsat') AS closed FROM res GROUP BY g),
gs AS (SELECT DISTINCT c_custkey // 3 AS g FROM customer)
SELECT 'group.g' || gs.g AS group_id, CASE WHEN gs.g % 3 = 0 THEN 'semantic_no_conflict' ELSE 'semantic_contradiction' END AS expected_outcome,
 coalesce(CASE WHEN gs.g % 3 = 0 THEN per.n > 0 AND n_contra = 0 AND (gs.g % 2 <> 0 OR closed >= 1) ELSE n_contra = 1 AND per.core = 'a.' || a_id || ',a.' || b_id END, false) AS matched
FROM gs LEFT JOIN per ON per.g = gs.g LEFT JOIN pair ON pair.g = gs.g AND pair.n = 1"""
ORACLES["verdict_prints"] = f"""
WITH {_PAIRS}, l AS (SELECT group_id, 0 AS place, n AS spot, 'pair ' || q || '.overlap ' || q || '.deontic' AS line FROM pair UNION ALL SELECT group_id, 1, seq, 'result ' || query_id || ' ' || category || ' ' || verdict || ' ' || coalesce(core, '-') FROM res)
SELECT group_id, 'sha256:' || sha256(string_agg(line, {_L} ORDER BY place, spot)) AS print_hash FROM l GROUP BY group_id"""

_USES = f"""{_PAIRS}, {_BOUND.removeprefix(_SEGMENTS + ',')},
uses AS (
 SELECT 'binding' AS kind, doc || '/bind.' || b AS component, NULL AS owner FROM bound
 UNION ALL SELECT 'statement', doc || '/stmt.' || n, NULL FROM stmt UNION ALL SELECT 'rule', rule_id, doc || '/fc.' || rule_id FROM rule
 UNION ALL SELECT 'segment', doc || '/seg.' || ord, NULL FROM seg UNION ALL SELECT 'segment', doc || '/seg.' || ord, doc || '/stmt.' || n FROM stmt
 UNION ALL SELECT 'constraint', 'fc.' || rule_id, NULL FROM rule
 UNION ALL SELECT 'constraint', 'fc.' || x, a_doc || '/' || group_id || '/pair' || n FROM (SELECT *, unnest([a_id, b_id]) AS x FROM pair)
 UNION ALL SELECT 'action', 'administer:' || target, doc || '/stmt.' || n FROM stmt UNION ALL SELECT 'action', 'administer:' || target, doc || '/' || rule_id FROM rule UNION ALL SELECT 'action', 'administer:' || target, doc || '/fc.' || rule_id FROM rule
 UNION ALL SELECT 'concept', code, doc || '/bind.' || b FROM bound UNION ALL SELECT 'concept', unnest(string_split(alternatives, ',')), doc || '/bind.' || b FROM bound WHERE alternatives <> ''
 UNION ALL SELECT 'concept', population, doc || '/stmt.' || n FROM stmt WHERE population <> '' UNION ALL SELECT 'concept', condition, doc || '/stmt.' || n FROM stmt WHERE condition <> ''
 UNION ALL SELECT 'concept', code, doc || '/stmt.' || owner FROM exc
 UNION ALL SELECT 'concept', x, doc || '/' || o FROM (SELECT doc, unnest(list_concat(need, bar)) AS x, rule_id FROM rule) r, LATERAL (SELECT unnest([r.rule_id, 'fc.' || r.rule_id]) AS o))"""
ORACLES["layer_components"] = f"""
WITH {_USES} SELECT kind, component, len(us) AS n_uses, sha256(array_to_string(us, {_L})) AS uses_sha,
 CASE kind WHEN 'concept' THEN 'sha256:' || sha256('"' || component || '"') WHEN 'action' THEN 'sha256:' || sha256('{{"key":"' || component || '","kind":"administer","target":"' || substr(component, 12) || '"}}') END AS name_hash
FROM (SELECT kind, component, coalesce(list_sort(list_distinct(list(owner) FILTER (owner IS NOT NULL))), []) AS us FROM uses GROUP BY kind, component)"""
ORACLES["bundle_breaks"] = f"""
WITH {_RULES}, d AS (SELECT c_custkey AS c, 'doc.' || c_custkey AS doc, c_custkey % 10 AS m, EXISTS (SELECT 1 FROM rule r WHERE r.c = c_custkey) AS ruled FROM customer),
b AS (SELECT DISTINCT c FROM seg WHERE kind IN ('recommendation', 'exception') AND (kind = 'exception' OR txt <> ''))
SELECT doc AS document_id, v.kind FROM d, (VALUES (1, 'Dangling', false), (2, 'KeyMismatch', true), (3, 'EmptySupport', true), (4, 'ConstraintMismatch', true), (5, 'ComponentsMismatch', false), (6, 'HashMismatch', true), (7, 'DocLayerMismatch', false)) AS v(n, kind, needs)
WHERE m = n AND (ruled OR NOT needs) UNION ALL SELECT doc, 'Duplicate' FROM d JOIN b USING (c) WHERE m = 8"""
ORACLES["run_hashes"] = f"""
WITH {_RULES}, x AS (SELECT c, '{{"action":{{"key":"administer:' || target || '","kind":"administer","target":"' || target || '"}},' || coalesce('"certainty":"' || certainty || '",', '') ||
 '"context":{{"any":[{{"all":[' || array_to_string(atoms, ',') || ']}}]}},"direction":"' || direction || '","exception_refs":[' || array_to_string(refs, ',') || '],"rule_id":"' || rule_id || '","source_region_ids":["' || array_to_string(named, '","') || '"],"strength":"' AS t FROM said)
SELECT 'sha256:' || sha256(t || 'strong"}}') AS hash, 'left' AS side FROM x WHERE c % 7 = 0 UNION ALL SELECT 'sha256:' || sha256(t || 'weak"}}'), 'right' FROM x WHERE c % 7 = 0"""
