"""DuckDB oracle texts: the fixtures and each query written from the semantics.

Tables ``events``, ``lineitem``, ... are pre-registered views. The fixture
CTEs restate the derivations of ``fablake.plans.fixtures`` in plain SQL.
"""

from __future__ import annotations

FIXTURES = r"""
ev AS (
  SELECT e.*,
         CASE e.event_type WHEN 'click' THEN 'mes' WHEN 'view' THEN 'equipment'
              WHEN 'purchase' THEN 'erp' WHEN 'signup' THEN 'plm' WHEN 'error' THEN 'telemetry' END AS src,
         'req-' || CAST(e.event_id AS VARCHAR) AS req
  FROM events e
),
ingestion_log AS (
  SELECT event_id AS id, req AS request_id, src AS source,
         CASE WHEN event_id % 10 = 0 THEN NULL
              ELSE CASE src WHEN 'mes' THEN 'mes-events' WHEN 'erp' THEN 'metadata-events'
                            WHEN 'equipment' THEN 'quality-events' WHEN 'plm' THEN 'plm-events'
                            WHEN 'telemetry' THEN 'quality-events' END END AS stream,
         CASE WHEN event_id % 10 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status,
         value AS duration_ms,
         CASE WHEN event_id % 10 = 0 THEN 'Payload failed schema validation' END AS error_message,
         ts AS created_at
  FROM ev
),
lot_master AS (
  SELECT event_id AS id, 'LOT' || CAST(user_id AS VARCHAR) AS lot_id,
         'REC' || CAST(event_id % 50 AS VARCHAR) AS recipe_id,
         'ETCH' || CAST(event_id % 20 AS VARCHAR) AS equipment_id,
         CAST(1 + event_id % 25 AS INTEGER) AS wafer_count, value AS temperature,
         'LOT_COMPLETED' AS event_type, ts AS event_timestamp, ts AS created_at, req AS request_id
  FROM ev WHERE event_id % 10 <> 0 AND event_type = 'click'
),
raw_events AS (
  SELECT event_id AS id, src AS source, event_type, props AS payload,
         src || '/' || strftime(ts, '%Y/%m/%d') || '/' || src || '-' || req || '.json' AS s3_key,
         ts AS created_at
  FROM ev WHERE event_id % 10 <> 0 AND event_type <> 'click'
),
lot_master_drift AS (SELECT * FROM lot_master WHERE id % 97 <> 0),
raw_events_drift AS (SELECT * FROM raw_events WHERE id % 97 <> 0)
"""


def with_fixtures(body: str) -> str:
    return "WITH " + FIXTURES.strip() + ",\n" + body.strip()


# fixed values: the labels of the two curated tables
LOT_LABEL, RAW_LABEL = "mdm.lot_master", "metadata.raw_events"


def lineage_view(lots: str = "lot_master", raws: str = "raw_events") -> str:
    """The n-th successful request of a source meets the n-th curated row of that source."""
    return f"""
curated_side AS (
  SELECT 'mes' AS origin, id, event_type, created_at, NULL AS object_key FROM {lots}
  UNION ALL BY NAME
  SELECT source AS origin, id, event_type, created_at, s3_key AS object_key FROM {raws} WHERE source <> 'mes'
),
curated_place AS (
  SELECT *, row_number() OVER (PARTITION BY origin ORDER BY created_at, id) AS place FROM curated_side
),
request_place AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY created_at, id) AS place
  FROM ingestion_log WHERE status = 'SUCCESS'
),
lineage AS (
  SELECT q.id AS ingestion_log_id, q.request_id, q.source, q.stream, q.status, q.duration_ms, q.error_message,
         q.created_at AS ingested_at, if(q.source = 'mes', '{LOT_LABEL}', '{RAW_LABEL}') AS curated_table,
         c.id AS curated_record_id, c.event_type AS curated_event_type, c.created_at AS curated_created_at,
         CAST(c.object_key AS VARCHAR) AS curated_s3_key
  FROM request_place q LEFT JOIN curated_place c ON c.origin = q.source AND c.place = q.place
)"""


def key_lineage_view(lots: str, raws: str) -> str:
    return f"""
key_lineage AS (
  SELECT l.id AS ingestion_log_id, l.request_id, l.source, l.stream, l.status, l.duration_ms,
         l.error_message, l.created_at AS ingested_at,
         CASE WHEN l.source = 'mes' THEN 'mdm.lot_master' ELSE 'metadata.raw_events' END AS curated_table,
         c.curated_record_id, c.curated_event_type, c.curated_created_at, c.curated_s3_key
  FROM ingestion_log l
  LEFT JOIN (
    SELECT request_id, 'mes' AS csource, id AS curated_record_id, event_type AS curated_event_type,
           created_at AS curated_created_at, CAST(NULL AS VARCHAR) AS curated_s3_key
    FROM {lots}
    UNION ALL
    SELECT regexp_extract(s3_key, '-(req-[^/]*)\\.json$', 1), source, id, event_type, created_at, s3_key
    FROM {raws} WHERE source <> 'mes'
  ) c ON c.request_id = l.request_id AND c.csource = l.source
  WHERE l.status = 'SUCCESS'
)"""
