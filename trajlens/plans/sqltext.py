"""The table bindings as SQL common table expressions."""


def b1(session: str = "user_id", name: str = "b1") -> str:
    return f"""{name}_raw AS (
  SELECT {session} AS session_id, event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS step,
         event_type AS symbol, event_type <> 'error' AS success, value * 100 AS latency_ms,
         CASE event_type WHEN 'view' THEN 'gathering' WHEN 'signup' THEN 'planning'
              WHEN 'click' THEN 'executing' WHEN 'error' THEN 'verifying'
              WHEN 'purchase' THEN 'delivering' END AS phase,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY session_id)) / 1e6 AS timestamp
  FROM {name}_raw)"""


def b1l() -> str:
    return b1("user_id % 15")


B1A = """b1a AS (
  SELECT 'all' AS session_id, row_number() OVER (ORDER BY ts, event_id) AS step, event_id, ts,
         user_id % 3 AS agent_id, k % 20 AS resource, event_type AS symbol,
         event_type IN ('view', 'click') AS is_read, event_type IN ('purchase', 'signup') AS is_write
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))"""

def b1t(session: str = "user_id") -> str:
    return b1(session) + """,
bt AS (
  SELECT *, CASE WHEN type = 'tool_call' THEN CASE event_type WHEN 'view' THEN 'read_file' WHEN 'click' THEN 'bash'
              WHEN 'purchase' THEN 'edit_file' WHEN 'error' THEN 'pytest' END END AS tool,
         'i' || (k % 2) AS input_hash, 'o' || (k % 6) AS output_hash,
         CASE WHEN type = 'reasoning' THEN 'I will ' || CASE k % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'test' ELSE 'write' END
                   || ' f' || (k % 7)
              WHEN type = 'user_input' THEN CASE WHEN k % 50 = 0 THEN 'tests pass, looks good' ELSE 'next please' END
         END AS goal_text, k AS tokens_in, CAST(floor(value) AS BIGINT) AS tokens_out
  FROM (SELECT *, CASE WHEN k % 25 = 0 THEN 'user_input' WHEN event_type = 'signup' THEN 'reasoning'
               ELSE 'tool_call' END AS type FROM b1)),
bp AS (
  SELECT *, CASE WHEN type = 'reasoning' THEN 2 WHEN tool = 'pytest' THEN 4 WHEN tool IN ('bash', 'edit_file') THEN 3
                 WHEN tool = 'read_file' THEN 1 ELSE 2 END AS class_rank,
         coalesce(tool IN ('bash', 'edit_file', 'pytest'), false) AS strong FROM bt),
bc AS (SELECT *, CASE WHEN step = 1 OR strong
         OR class_rank = lag(class_rank) OVER (PARTITION BY session_id ORDER BY step) THEN class_rank END AS commit_rank FROM bp),
bh AS (SELECT *, last_value(commit_rank IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY step) AS phase_rank FROM bc),
bm AS (SELECT *, coalesce(lag(phase_rank) OVER (PARTITION BY session_id ORDER BY step), 0) AS from_rank FROM bh)"""


B2 = b1() + """,
b2 AS (
  SELECT session_id, step * 2 - 1 AS turn, 'ai' AS role,
         'I will ' || event_type || ' f' || (k % 7) || chr(10) || '```' || chr(10) ||
         CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'search_dir' WHEN 'signup' THEN 'edit'
              WHEN 'purchase' THEN 'python' WHEN 'error' THEN 'create' END
         || ' f' || (k % 10) || '.py' || chr(10) || '```' AS text FROM b1
  UNION ALL
  SELECT session_id, step * 2, 'user',
         CASE WHEN event_type = 'error' THEN 'Traceback: error' ELSE 'ok' END FROM b1)"""

B3 = """b3 AS (
  SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn, role, text
  FROM conversations)"""

B6 = """b6 AS (
  SELECT user_id % 40 AS session_id, event_type AS rater, k % 5 AS dimension, 1 + k % 5 AS value,
         k % 4 AS confidence, ts, event_id
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))"""

LR = """lr0 AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
lr AS (SELECT CASE WHEN k % 3 = 0 THEN lpad(CAST(user_id AS VARCHAR), 8, '0') ELSE lpad(CAST(user_id AS VARCHAR), 8, '0') || '-full' END AS session_id,
    annotator_type, 'a' || (k % 4) AS annotator_id,
    CASE annotator_type WHEN 'detector' THEN 'unlabeled' WHEN 'auto' THEN 'auto_labeled' WHEN 'human' THEN 'human_reviewed' ELSE 'adjudicated' END AS label_status,
    k % 4 <> 0 AS has_failure, (['2.1', '2.2', '4.2', '4.4', '5.4', ''])[k % 6 + 1] AS code, k AS onset_step, k % 6 AS severity,
    (k // 2) % 6 AS confidence, k % 5 = 0 AS is_latent, ts AS updated_at, event_id AS seq, user_id
  FROM (SELECT *, CASE WHEN event_type = 'click' THEN 'auto' WHEN event_type = 'signup' THEN 'human'
     WHEN event_type = 'purchase' AND k % 10 = 0 THEN 'adjudicated' WHEN event_type = 'purchase' THEN 'human' ELSE 'detector' END AS annotator_type FROM lr0))"""
