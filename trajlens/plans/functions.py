"""Event and text functions applied to every row of the bindings; time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlens.functions import events as fe
from trajlens.functions import text as tx
from trajlens.functions.taxonomy import failure_types
from trajlens.plans.features import ACTS
from trajlens.plans.registry import query
from trajlens.plans.sqltext import B2, b1, b1t
from trajlens.sources import bind

KINDS = ["tool_call", "file_read", "file_write", "shell_command", "memory_load", "memory_store", "memory_evict",
         "memory_tier_escalation", "phase_boundary", "agent_handoff", "evaluation_result", "contract_event", "error"]
TOOLS = ["read_file", "Bash", "edit", "pytest", "reasoning", "custom-tool", "git push"]
ROLES = ["planner", "generator", "evaluator", "orchestrator"]
FILES = ["/a/b/c.py", "src\\\\x\\\\y.ts", "tests/test_z.py", "README.md", "docker-compose.yml", "db/schema.sql", ""]


def pick(names, i):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))


def arr(names):
    return "[" + ", ".join("'" + n + "'" for n in names) + "]"


OB = b1() + f""", ob AS (SELECT session_id, step, k, event_type AS raw_type, value, ({arr(KINDS)})[k % 13 + 1] AS event_type,
  ({arr(TOOLS)})[k % 7 + 1] AS tool_name, ({arr([f.replace(chr(92) * 2, chr(92)) for f in FILES])})[k % 7 + 1] AS target_path,
  CASE WHEN k % 9 = 0 THEN ({arr(ROLES)})[k % 4 + 1] END AS agent_role, 'memory://agent/gen/skills/x' || (k % 3) AS uri,
  CASE WHEN k % 2 = 0 THEN 'l' || (k % 3) END AS memory_tier, 'ns' || (k % 4) AS namespace FROM b1)"""


def observable(spark, sf_dir):
    k = F.col("k")
    return bind.events(spark, sf_dir).df.select(
        "session_id", "step", "k", F.col("event_type").alias("raw_type"), "value", pick(KINDS, k % 13).alias("event_type"), pick(TOOLS, k % 7).alias("tool_name"),
        pick([f.replace("\\\\", "\\") for f in FILES], k % 7).alias("target_path"), F.when(k % 9 == 0, pick(ROLES, k % 4)).alias("agent_role"),
        F.concat(F.lit("memory://agent/gen/skills/x"), (k % 3).cast("string")).alias("uri"),
        F.when(k % 2 == 0, F.concat(F.lit("l"), (k % 3).cast("string"))).alias("memory_tier"),
        F.concat(F.lit("ns"), (k % 4).cast("string")).alias("namespace"))


PATH2 = "CASE WHEN target_path = '' THEN 'unknown' ELSE array_to_string(list_slice(string_split(replace(target_path, chr(92), '/'), '/'), -2, -1), '/') END"


@query("event_symbols", f"""WITH {OB} SELECT session_id, step, CASE event_type WHEN 'tool_call' THEN 'tool:' || tool_name WHEN 'file_read' THEN 'read:' || {PATH2}
  WHEN 'file_write' THEN 'write:' || {PATH2} WHEN 'shell_command' THEN 'shell:' || tool_name WHEN 'memory_load' THEN 'mem_load:' || coalesce(memory_tier, '?') || ':' || namespace
  WHEN 'memory_store' THEN 'mem_store:' || namespace WHEN 'memory_evict' THEN 'mem_evict:' || namespace WHEN 'memory_tier_escalation' THEN 'mem_esc:?>' || coalesce(memory_tier, '?')
  WHEN 'phase_boundary' THEN 'phase:unknown' WHEN 'agent_handoff' THEN 'handoff:' || coalesce(agent_role, 'unknown') WHEN 'evaluation_result' THEN 'eval:general'
  WHEN 'contract_event' THEN 'contract:unknown' ELSE event_type END AS symbol FROM ob""")
def event_symbols(spark, sf_dir):
    df = observable(spark, sf_dir)
    cols = {c: F.col(c) for c in ("event_type", "tool_name", "target_path", "memory_tier", "namespace", "agent_role")}
    none = F.lit(None).cast("string")
    cols |= {c: none for c in ("symbol", "previous_tier", "phase", "evaluation_criterion", "contract_status")}
    return df.select("session_id", "step", fe.symbol_of(cols).alias("symbol"))


@query("event_stages", f"""WITH {OB} SELECT session_id, step, coalesce(CASE agent_role WHEN 'planner' THEN 'decision_making' WHEN 'generator' THEN 'action' WHEN 'evaluator' THEN 'feedback' WHEN 'orchestrator' THEN 'decision_making' END,
  CASE lower(tool_name) WHEN 'read_file' THEN 'perception' WHEN 'bash' THEN 'action' WHEN 'edit' THEN 'action' WHEN 'pytest' THEN 'feedback' WHEN 'reasoning' THEN 'decision_making' END,
  CASE WHEN event_type IN ('file_read', 'memory_load') THEN 'perception' WHEN event_type IN ('memory_evict', 'memory_tier_escalation') THEN 'working_memory' WHEN event_type = 'evaluation_result' THEN 'feedback'
    WHEN event_type = 'contract_event' THEN 'decision_making' ELSE 'action' END) AS stage,
  event_type IN ('phase_boundary', 'session_start', 'session_end') AS is_marker, starts_with(event_type, 'memory_') AS is_memory,
  lower(tool_name) = 'pytest' OR event_type IN ('error', 'evaluation_result') AS is_feedback, 'agent/gen/skills' AS namespace FROM ob""")
def event_stages(spark, sf_dir):
    kind = F.col("event_type")
    return observable(spark, sf_dir).select(
        "session_id", "step", fe.stage_of(F.col("agent_role"), F.col("tool_name"), kind).alias("stage"), kind.isin(*fe.MARKERS).alias("is_marker"),
        kind.isin(*fe.MEMORY_EVENTS).alias("is_memory"), fe.is_feedback(F.col("tool_name"), kind, F.col("target_path"), F.lit("")).alias("is_feedback"),
        fe.namespace_of(F.col("uri")).alias("namespace"))


@query("observable_types", f"""WITH {OB}, t AS (SELECT *, CASE WHEN raw_type = 'signup' THEN 'reasoning' ELSE 'tool_call' END AS type FROM ob)
SELECT session_id, step, CASE WHEN type = 'reasoning' THEN 'tool_call' WHEN lower(tool_name) = 'read_file' THEN 'file_read' WHEN lower(tool_name) = 'edit' THEN 'file_write'
  WHEN lower(tool_name) = 'bash' THEN 'shell_command' ELSE 'tool_call' END AS event_type,
  CASE WHEN type = 'reasoning' THEN 2 WHEN tool_name = 'git push' THEN 5 WHEN tool_name = 'pytest' THEN 4 WHEN tool_name IN ('Bash', 'edit') THEN 3 WHEN tool_name = 'read_file' THEN 1 ELSE 3 END AS phase_rank,
  type <> 'reasoning' AND tool_name IN ('git push', 'pytest', 'Bash', 'edit') AS is_strong FROM t""")
def observable_types(spark, sf_dir):
    kind = F.when(F.col("raw_type") == "signup", "reasoning").otherwise("tool_call")
    tool = F.col("tool_name")
    rank = fe.phase_of(kind, tool)
    return observable(spark, sf_dir).select(
        "session_id", "step", fe.observable_type(kind, tool).alias("event_type"), rank.alias("phase_rank"), fe.is_strong(kind, tool, rank).alias("is_strong"))


@query("path_categories", f"""WITH {OB} SELECT session_id, step, CASE WHEN target_path = '' THEN '' WHEN contains(target_path, 'test') THEN 'test' WHEN contains(target_path, '.ts') THEN 'frontend' WHEN contains(target_path, '.py') THEN 'backend'
  WHEN contains(lower(target_path), 'docker') OR contains(lower(target_path), 'readme') THEN 'config' WHEN contains(target_path, '.sql') THEN 'database' ELSE 'other' END AS category FROM ob""")
def path_categories(spark, sf_dir):
    return observable(spark, sf_dir).select("session_id", "step", fe.path_category(F.col("target_path")).alias("category"))


@query("synthetic_times", f"""WITH {b1()} SELECT session_id, step, round(coalesce(sum(latency_ms) OVER (PARTITION BY session_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000, 4) AS timestamp,
  md5(event_type || ':' || k || ':' || CASE WHEN success THEN 'True' ELSE 'False' END) AS output_hash FROM b1""")
def synthetic_times(spark, sf_dir):
    """Times from the latencies before each event, and digests for missing output hashes."""
    ev = bind.events(spark, sf_dir).running(exclusive=True, _before=("sum", F.col("latency_ms")))
    return ev.df.select("session_id", "step", F.round(F.col("_before").cast("double") / 1000, 4).alias("timestamp"), fe.output_hash(
        F.lit(None).cast("string"), F.col("event_type"), F.col("k"), F.col("success")).alias("output_hash"))


@query("message_flags", f"""WITH {b1t()} SELECT session_id, step, contains(goal_text, 'looks good') AS verifies, false AS continues, contains(goal_text, 'looks good') AS positive, false AS negative,
  CASE WHEN k % 2 = 0 THEN 'environmental' ELSE 'command' END AS error_origin FROM bt WHERE type = 'user_input'""")
def message_flags(spark, sf_dir):
    from trajlens.operators.detectors import CONTINUATION, VERIFICATION
    text = F.col("goal_text")
    error = F.when(F.col("k") % 2 == 0, "Connection refused by host").otherwise("exit code 1")
    return bind.trace_events(spark, sf_dir).df.where("type = 'user_input'").select(
        "session_id", "step", text.rlike(VERIFICATION).alias("verifies"), text.rlike(CONTINUATION).alias("continues"),
        text.rlike(tx.POSITIVE_CLOSE).alias("positive"), text.rlike(tx.NEGATIVE_CLOSE).alias("negative"), tx.error_origin(error).alias("error_origin"))


@query("error_results", f"""WITH {B2} SELECT session_id, turn, contains(lower(text), 'error') OR contains(lower(text), 'traceback') AS is_error,
  trim(split_part(split_part(text, chr(10), 1), ' && ', 1)) AS command FROM b2 WHERE role = 'user'""")
def error_results(spark, sf_dir):
    ev = bind.turns(spark, sf_dir)
    return ev.df.where("role = 'user'").select("session_id", "turn", tx.is_error_result(F.lit(False), F.col("text")).alias("is_error"),
                                               tx.normal_command(F.col("text")).alias("command"))


@query("thoughts_and_targets", f"""WITH {ACTS} SELECT session_id, turn, 'I will ' || split_part(text, ' ', 3) || ' ' || split_part(split_part(text, ' ', 4), chr(10), 1) AS thought, lower(regexp_extract(args, '([A-Za-z_][A-Za-z0-9_]+)', 1)) AS target,
  CASE tool_name WHEN 'open' THEN 'observe' WHEN 'search_dir' THEN 'search' WHEN 'python' THEN 'verify' ELSE 'mutate' END AS category FROM act""")
def thoughts_and_targets(spark, sf_dir):
    from trajlens.operators.trajectories import actions
    acted = actions(bind.turns(spark, sf_dir))
    return acted.df.select("session_id", "turn", tx.thought_of(F.col("text")).alias("thought"), tx.target_token(F.col("args")).alias("target"),
                           tx.verb_category(F.lower("tool_name")).alias("category"))


@query("likert_buckets", f"""WITH {b1()}, s AS (SELECT session_id, sum(value) / 1000 AS v FROM b1 GROUP BY session_id)
SELECT session_id, CAST(greatest(1, least(5, round_even(1 + greatest(least((v - 0.9) / (1.7 - 0.9), 1.0), 0.0) * 4, 0))) AS INT) AS direct,
  CAST(greatest(1, least(5, round_even(1 + greatest(least((1.7 - v) / (1.7 - 0.9), 1.0), 0.0) * 4, 0))) AS INT) AS inverted FROM s""")
def likert_buckets(spark, sf_dir):
    s = bind.raw_events(spark, sf_dir).groupBy(F.col("user_id").alias("session_id")).agg((F.sum("value") / 1000).alias("v"))
    return s.select("session_id", tx.likert(F.col("v"), 0.9, 1.7).alias("direct"), tx.likert(F.col("v"), 0.9, 1.7, True).alias("inverted"))


@query("trace_names", f"""WITH {b1()}, n AS (SELECT DISTINCT session_id, (['etl_pipeline', 'chat_app', 'bash_utility', 'odd'])[session_id % 4 + 1] || '_' || (['clean', 'loop', 'stall', 'weird'])[session_id % 3 + 1] AS name FROM b1)
SELECT session_id, regexp_replace(name, '_(clean|loop|stall)$', '') AS task, split_part(name, '_', -1) AS variant, CASE WHEN starts_with(name, 'etl') THEN 'data_pipeline' WHEN starts_with(name, 'chat') THEN 'web_app' WHEN starts_with(name, 'bash') THEN 'devops' ELSE 'unknown' END AS domain FROM n""")
def trace_names(spark, sf_dir):
    from trajlens.functions.taxonomy import domain_of, task_of, variant_of
    ids = bind.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id")).distinct()
    name = F.concat_ws("_", pick(["etl_pipeline", "chat_app", "bash_utility", "odd"], F.col("session_id") % 4), pick(["clean", "loop", "stall", "weird"], F.col("session_id") % 3))
    return ids.withColumn("name", name).select("session_id", task_of(F.col("name")).alias("task"), variant_of(F.col("name")).alias("variant"),
                                               domain_of(task_of(F.col("name"))).alias("domain"))


@query("failure_lookup", f"""WITH {b1()}, c AS (SELECT session_id, (['2.1', '4.2', '8.4', '9.9'])[k % 4 + 1] AS code FROM b1)
SELECT code, CASE code WHEN '2.1' THEN 'context_loss' WHEN '4.2' THEN 'error_cascade' WHEN '8.4' THEN 'strategy_fixation' END AS failure,
  coalesce(CASE code WHEN '2.1' THEN 'attention' WHEN '4.2' THEN 'feedback' WHEN '8.4' THEN 'decision_making' END, 'unknown') AS stage, count(*) AS events, count(DISTINCT session_id) AS sessions FROM c GROUP BY code""")
def failure_lookup(spark, sf_dir):
    rows = bind.raw_events(spark, sf_dir).select("user_id", pick(["2.1", "4.2", "8.4", "9.9"], F.col("k") % 4).alias("code"))
    counts = rows.groupBy("code").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("sessions"))
    types = failure_types(spark)  # a fixed table of 33 rows
    return counts.join(F.broadcast(types), "code", "left").select(
        "code", "failure", F.coalesce("stage", F.lit("unknown")).alias("stage"), "events", "sessions")


@query("tumbling_windows", """SELECT time_bucket(INTERVAL 6 HOURS, ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_windows(spark, sf_dir):
    from trajlens.streaming.windows import tumbling
    return tumbling(bind.raw_events(spark, sf_dir), "6 hours", "event_type")


@query("sliding_windows", """SELECT w AS window_start, event_type, count(*) AS events FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOURS, ts), time_bucket(INTERVAL 6 HOURS, ts) - INTERVAL 6 HOURS]) AS w FROM events) GROUP BY ALL""")
def sliding_windows(spark, sf_dir):
    from trajlens.streaming.windows import sliding
    return sliding(bind.raw_events(spark, sf_dir), "12 hours", "6 hours", "event_type")


@query("activity_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 4 HOURS THEN 0 ELSE 1 END AS n, event_id FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 4 HOURS AS ended, count(*) AS events FROM s GROUP BY user_id, sid""")
def activity_sessions(spark, sf_dir):
    from trajlens.streaming.windows import activity
    return activity(bind.raw_events(spark, sf_dir), "4 hours", "user_id")


# Calls with inputs of every kind the signature tells apart, from the events.
RAW_CALLS = f"""{b1()}, rc AS (SELECT session_id, step, event_type, k,
  CASE k % 8 WHEN 0 THEN 'Bash' WHEN 1 THEN 'Read' WHEN 2 THEN 'Grep' WHEN 3 THEN 'TaskUpdate' WHEN 4 THEN 'TaskCreate' WHEN 5 THEN 'Edit' WHEN 6 THEN 'Glob' ELSE 'Fetch' END AS tool FROM b1)"""


def raw_calls(spark, sf_dir):
    k = F.col("k")
    tool = pick(["Bash", "Read", "Grep", "TaskUpdate", "TaskCreate", "Edit", "Glob", "Fetch"], k % 8)
    command = F.concat(F.when(k % 3 == 0, "git reset --hard ").otherwise("run  the\t"), (k % 5).cast("string"), F.lit("\nsecond line"))
    data = F.to_json(F.struct(
        F.when(k % 8 == 0, command).alias("command"), F.when((k % 8).isin(1, 5), F.concat(F.lit("/src/f"), (k % 7).cast("string"))).alias("file_path"),
        F.when((k % 8).isin(2, 6), F.concat(F.lit("p"), (k % 4).cast("string"))).alias("pattern"), F.when(k % 8 == 2, "src").alias("path"),
        F.when(k % 8 == 3, F.when(k % 2 == 1, "Completed").otherwise("open")).alias("status"),
        F.when(k % 8 == 7, (k % 3).cast("string")).alias("z"), F.when(k % 8 == 7, "u").alias("a")))
    events = bind.trace_events(spark, sf_dir).df
    return events.select("session_id", "step", "event_type", "k").withColumns(
        {"tool": tool, "input": data, "has_result": F.col("event_type") != "signup"})


@query("call_signatures", f"""WITH {RAW_CALLS} SELECT session_id, step, lower(tool) || ':' || CASE tool
  WHEN 'Bash' THEN CASE WHEN k % 3 = 0 THEN 'git reset --hard ' ELSE 'run the ' END || (k % 5) WHEN 'Read' THEN '/src/f' || (k % 7) WHEN 'Edit' THEN '/src/f' || (k % 7)
  WHEN 'Grep' THEN 'p' || (k % 4) || ':src' WHEN 'Glob' THEN 'p' || (k % 4) || ':' WHEN 'TaskUpdate' THEN '{{"status":"' || CASE WHEN k % 2 = 1 THEN 'Completed' ELSE 'open' END || '"}}'
  WHEN 'TaskCreate' THEN '{{}}' ELSE '{{"a":"u","z":"' || (k % 3) || '"}}' END AS signature FROM rc""")
def call_signatures(spark, sf_dir):
    return raw_calls(spark, sf_dir).select("session_id", "step", tx.call_signature(F.col("tool"), F.col("input")).alias("signature"))


@query("call_signals", f"""WITH {RAW_CALLS} SELECT session_id, count(*) AS tool_calls, count(*) FILTER (WHERE event_type <> 'signup') AS tool_results,
  count(*) FILTER (WHERE tool = 'TaskCreate') AS tasks_created, count(*) FILTER (WHERE tool = 'TaskUpdate' AND k % 2 = 1) AS tasks_completed,
  count(*) FILTER (WHERE tool = 'Bash' AND k % 3 = 0) AS git_undo FROM rc GROUP BY session_id""")
def call_signals(spark, sf_dir):
    from trajlens.operators.sessions import call_signals as per_session
    return per_session(raw_calls(spark, sf_dir))


@query("first_in_first_out", f"""WITH {b1()}, o AS (SELECT session_id, step, event_type IN ('view', 'signup') AS u, event_type IN ('click', 'error') AS r,
  sum(CASE WHEN event_type IN ('view', 'signup') THEN 1 WHEN event_type IN ('click', 'error') THEN -1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY step) AS s FROM b1),
l AS (SELECT *, r AND s < least(0, coalesce(min(s) OVER (PARTITION BY session_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS orphan FROM o),
n AS (SELECT *, count(*) FILTER (WHERE u) OVER w AS nu, count(*) FILTER (WHERE r AND NOT orphan) OVER w AS nr FROM l WINDOW w AS (PARTITION BY session_id ORDER BY step))
SELECT a.session_id, a.step, b.step AS use_step FROM n a LEFT JOIN n b ON a.session_id = b.session_id AND b.u AND NOT a.orphan AND b.nu = a.nr WHERE a.r""")
def first_in_first_out(spark, sf_dir):
    from trajlens.sources.adapters import first_in_first_out as paired
    ev = bind.trace_events(spark, sf_dir).select("event_type")
    return paired(ev, F.col("event_type").isin("view", "signup"), F.col("event_type").isin("click", "error"))
