"""DuckDB SQL that gives the same rows as the queries it can express."""

from quillon.llm.fusion import COUNTRY_STAND_INS, STAND_INS


def _list(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


ORACLES = {
    "p4_found": """
WITH RECURSIVE links AS (
  SELECT canonical_id AS u, unnest(source_ids) AS v FROM merge_audit WHERE lower(trim(decision)) = 'merged'
  UNION ALL SELECT left_id, right_id FROM er_gold_pair WHERE lower(trim(label)) = 'match'
), both_ways AS (
  SELECT u, v FROM links WHERE u IS NOT NULL AND v IS NOT NULL
  UNION SELECT v, u FROM links WHERE u IS NOT NULL AND v IS NOT NULL
), ids AS (
  SELECT canonical_id AS id FROM merge_audit UNION SELECT unnest(source_ids) FROM merge_audit
  UNION SELECT left_id FROM er_gold_pair UNION SELECT right_id FROM er_gold_pair
), reach(id, r) AS (
  SELECT id, id FROM ids WHERE id IS NOT NULL
  UNION SELECT reach.id, b.v FROM reach JOIN both_ways b ON b.u = reach.r
)
SELECT id AS record_id, min(r) AS group_id FROM reach GROUP BY id
""",
    "p6_found": f"""
WITH ok AS (
  SELECT id, entity_id, raw_entity::JSON AS j FROM er_queue_item
  WHERE status = 'resolved' AND entity_id IS NOT NULL AND json_valid(raw_entity)
), props AS (
  SELECT id, entity_id, j, unnest(json_keys(j, '$.properties')) AS field FROM ok WHERE json_type(j, '$.properties') = 'OBJECT'
), vals AS (
  SELECT id, entity_id, j, field, unnest(from_json(json_extract(j, '$.properties.' || field), '["VARCHAR"]')) AS v FROM props
  WHERE json_type(j, '$.properties.' || field) = 'ARRAY'
), norm AS (SELECT *, lower(trim(regexp_replace(v, '\\s+', ' ', 'g'))) AS n FROM vals WHERE v IS NOT NULL),
bare AS (SELECT *, trim(regexp_replace(n, '^[\\[\\(<{{"'']+|[\\]\\)>}}"''.]+$', '', 'g')) AS b FROM norm),
live AS (
  SELECT DISTINCT id, entity_id, j, field FROM bare
  WHERE n NOT IN ({_list(STAND_INS)}) AND b NOT IN ({_list(STAND_INS)}) AND regexp_matches(n, '[\\p{{L}}\\p{{N}}]')
    AND NOT regexp_matches(n, '^(0[\\s./-]*)+$') AND NOT regexp_matches(n, '^(x[\\s./-]*){{2,}}$|^(9[\\s./-]*){{6,}}$')
    AND NOT (field IN ('country', 'nationality', 'jurisdiction', 'flag') AND b IN ({_list(COUNTRY_STAND_INS)}))
), graded AS (
  SELECT l.*, coalesce(s.grade, 6) AS grade, try_cast(json_extract_string(j, '$.context.wm_prov_retrieved_at') AS TIMESTAMPTZ) AS seen
  FROM live l LEFT JOIN (
    SELECT connector_id || ':' || natural_key AS src, min(instr('ABCDEF', coalesce(reliability, 'B')) - 1) AS grade FROM seed_spec GROUP BY 1
  ) s ON s.src = json_extract_string(j, '$.context.wm_prov_source_id')
), members AS (
  SELECT DISTINCT canonical_id, entity_id FROM (
    SELECT canonical_id, unnest(source_ids) AS entity_id FROM merge_audit WHERE lower(trim(decision)) = 'merged' AND canonical_id IS NOT NULL)
), ranked AS (
  SELECT canonical_id, field, id, row_number() OVER (PARTITION BY canonical_id, field ORDER BY grade, seen DESC NULLS LAST, id) AS k
  FROM graded JOIN members USING (entity_id)
)
SELECT canonical_id, field, id AS queue_item_id FROM ranked WHERE k = 1
""",
}
