"""Queries of the training-data operators: name -> function of (spark, directory); and their SQL."""

from __future__ import annotations

from cairn.llm import bad_pairs, mixture, personal, same_look, survivor, tokens
from cairn.session import table


def queries() -> dict:
    t = table
    return {
        "p1_found": lambda s, d: same_look.same_look_pairs(t(s, d, "longmemeval_runs"), "question_id", "row_id", ["said", "gold"]),
        "p1_classes": lambda s, d: same_look.same_look_classes(t(s, d, "longmemeval_runs"), "question_id", "row_id", ["said", "gold"]),
        "p1_forms": lambda s, d: same_look.with_forms(
            t(s, d, "longmemeval_runs").select("row_id", "question_id", "said", "gold").distinct(), ["said", "gold"]
        ),
        "p2_found": lambda s, d: survivor.surviving_fields(t(s, d, "dynamics")),
        "p2_records": lambda s, d: survivor.surviving_records(t(s, d, "dynamics")),
        "p2_bundles": lambda s, d: survivor.surviving_bundles(t(s, d, "dynamics")),
        "p3_found": lambda s, d: bad_pairs.defects(t(s, d, "gate_blame")),
        "p3_parts": lambda s, d: bad_pairs.detected(t(s, d, "gate_blame")),
        "p6_ids": lambda s, d: tokens.encoded(t(s, d, "documents")),
        "p7_mix": lambda s, d: mixture.mixture(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p8_found": lambda s, d: personal.personal(t(s, d, "documents")),
        "p8_names": lambda s, d: personal.name_evidence(t(s, d, "documents")),
        "p8_masked": lambda s, d: personal.masked(t(s, d, "documents").select("doc_id", "text")),
        "p7_limits": lambda s, d: mixture.limits(mixture.shares(t(s, d, "documents"), t(s, d, "mix_targets"))),
        "p7_shares": lambda s, d: mixture.shares(t(s, d, "documents"), t(s, d, "mix_targets")),
    }


_RECORDS = """
WITH d AS (SELECT DISTINCT record_key, subject, predicate, value_text, unit, source, level, trust, witnesses, stated_at, loaded_at FROM dynamics),
u AS (
  SELECT *, lower(trim(value_text)) AS value_key,
    CASE WHEN level BETWEEN 1 AND 5 THEN level END AS good_level,
    CASE WHEN witnesses >= 1 THEN witnesses END AS good_witnesses,
    CASE WHEN stated_at >= TIMESTAMP '2000-01-01' AND (loaded_at IS NULL OR stated_at <= loaded_at) THEN stated_at END AS good_at,
    CASE WHEN trust BETWEEN 0 AND 1 AND NOT isnan(trust) THEN trust END AS good_trust,
    CASE WHEN trim(source) <> '' AND lower(trim(source)) <> 'unknown' THEN source END AS good_source
  FROM d WHERE subject IS NOT NULL AND predicate IS NOT NULL AND value_text IS NOT NULL
),
g AS (
  SELECT *, min(record_key) OVER w AS group_key, max(record_key) OVER w AS last_key
  FROM u WINDOW w AS (PARTITION BY subject, predicate, value_key)
),
f AS (
  SELECT * FROM (
    SELECT *, 'level' AS field, good_level IS NOT NULL AS ok FROM g UNION ALL
    SELECT *, 'source', good_source IS NOT NULL FROM g UNION ALL
    SELECT *, 'stated_at', good_at IS NOT NULL FROM g UNION ALL
    SELECT *, 'trust', good_trust IS NOT NULL FROM g UNION ALL
    SELECT *, 'unit', unit IS NOT NULL FROM g UNION ALL
    SELECT *, 'witnesses', good_witnesses IS NOT NULL FROM g
  ) WHERE ok AND group_key < last_key
),
chosen AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (
      PARTITION BY subject, predicate, value_key, field
      ORDER BY good_level DESC NULLS LAST, good_witnesses DESC NULLS LAST, good_at DESC NULLS LAST, good_trust DESC NULLS LAST, record_key
    ) AS place FROM f
  ) WHERE place = 1
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _RECORDS + "SELECT group_key, field, record_key FROM chosen",
        "p2_records": _RECORDS + """
SELECT group_key, subject, predicate,
  max(CASE WHEN field = 'level' THEN level END) AS level, max(CASE WHEN field = 'source' THEN source END) AS source,
  max(CASE WHEN field = 'stated_at' THEN stated_at END) AS stated_at, max(CASE WHEN field = 'trust' THEN trust END) AS trust,
  max(CASE WHEN field = 'unit' THEN unit END) AS unit, max(CASE WHEN field = 'witnesses' THEN witnesses END) AS witnesses
FROM chosen GROUP BY group_key, subject, predicate""",
        # every allowed choice of a group is listed and the best one taken
        "p2_bundles": _RECORDS.replace("DISTINCT record_key,", "DISTINCT record_key, episodic, last_seen,").split("f AS (")[0] + """
c AS (
  SELECT group_key, record_key, bundle, seen, CAST(round(coalesce(good_trust, 0) * 1000000) AS BIGINT) AS gain, good_level, good_witnesses, good_at, good_trust FROM (
    SELECT *, 'evidence' AS bundle, CASE WHEN witnesses >= 2 THEN 1 ELSE 0 END AS seen, good_at IS NOT NULL AND good_witnesses IS NOT NULL AS ok FROM g UNION ALL
    SELECT *, 'provenance', 0, good_level IS NOT NULL AND good_trust IS NOT NULL AND good_source IS NOT NULL FROM g UNION ALL
    SELECT *, 'standing', CASE WHEN episodic THEN 1 ELSE 0 END, episodic IS NOT NULL AND last_seen IS NOT NULL FROM g UNION ALL
    SELECT *, 'unit', 0, unit IS NOT NULL FROM g
  ) WHERE ok AND group_key < last_key
),
b AS (
  SELECT *, row_number() OVER (PARTITION BY group_key, bundle ORDER BY gain DESC, record_key) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY group_key, bundle, seen
      ORDER BY gain DESC, good_level DESC NULLS LAST, good_witnesses DESC NULLS LAST, good_at DESC NULLS LAST, good_trust DESC NULLS LAST, record_key) AS p FROM c
  ) WHERE p = 1
),
e AS (SELECT * FROM b WHERE bundle = 'evidence'), s AS (SELECT * FROM b WHERE bundle = 'standing'),
-- both, where they fit; else either alone
x AS (
  SELECT e.group_key, e.record_key AS er, s.record_key AS sr, 2 AS size, e.gain + s.gain AS gain, e.n AS en, s.n AS sn FROM e JOIN s USING (group_key) WHERE e.seen = 1 OR s.seen = 1
  UNION ALL SELECT group_key, record_key, NULL, 1, gain, n, 0 FROM e UNION ALL SELECT group_key, NULL, record_key, 1, gain, 99, n FROM s
),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY size DESC, gain DESC, en, sn) AS p FROM x) WHERE p = 1)
SELECT group_key, 'evidence' AS bundle, er AS record_key FROM w WHERE er IS NOT NULL UNION ALL SELECT group_key, 'standing', sr FROM w WHERE sr IS NOT NULL
UNION ALL SELECT group_key, bundle, record_key FROM b WHERE bundle IN ('provenance', 'unit') AND n = 1""",
        # the limits that a mixture must keep, whatever its draws
        "p7_limits": """
WITH t AS (SELECT source, max(greatest(coalesce(target_share, 0), 0)) AS target_share, max(greatest(coalesce(max_repeats, 1), 0)) AS max_repeats FROM mix_targets WHERE source IS NOT NULL GROUP BY source),
d AS (SELECT source, count(*) AS docs FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT source, target_share, max_repeats, coalesce(docs, 0) AS docs, true AS within_cap, true AS whole, coalesce(docs, 0) > 0 AND target_share > 0 AND max_repeats > 0 AS used FROM t LEFT JOIN d USING (source)""",
    }
