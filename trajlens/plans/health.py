"""Health, status and context of sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlens.functions.events import phase_name
from trajlens.operators import agreement as ag
from trajlens.operators import baselines as bl
from trajlens.operators import cognition as cg
from trajlens.operators import detectors as dt
from trajlens.operators import health as he
from trajlens.operators import metrics as me
from trajlens.operators import phases as ph
from trajlens.plans.baselines import DIST, MET, METRICS, SIG, SPLIT, measured, signatures, signed, split_shares
from trajlens.plans.functions import OB, observable
from trajlens.plans.phases import NAME, phased, segment_table
from trajlens.operators import stats as st
from trajlens.plans.registry import query
from trajlens.plans.sqltext import LR, b1t
from trajlens.sequence import Ordered
from trajlens.sources import bind

T = b1t()


@query("memory_operations", f"""WITH {OB}, m AS (SELECT session_id, step, row_number() OVER w AS n, round(entropy(namespace) OVER v + 1e-12, 4) AS e,
  round(sum(CASE WHEN event_type = 'memory_tier_escalation' THEN 1 ELSE 0 END) OVER v / least(row_number() OVER w, 50) + 1e-12, 4) AS r FROM ob WHERE starts_with(event_type, 'memory_')
  WINDOW w AS (PARTITION BY session_id ORDER BY step), v AS (PARTITION BY session_id ORDER BY step ROWS 49 PRECEDING))
SELECT ob.session_id, ob.step, last_value(CASE WHEN n >= 10 THEN e END IGNORE NULLS) OVER w AS namespace_entropy, last_value(CASE WHEN n >= 10 THEN r END IGNORE NULLS) OVER w AS escalation_rate
FROM ob LEFT JOIN m USING (session_id, step) WINDOW w AS (PARTITION BY ob.session_id ORDER BY ob.step)""")
def memory_operations(spark, sf_dir):
    ev = bind.events(spark, sf_dir)
    ob = Ordered(observable(spark, sf_dir).select("session_id", "step", "event_type", "namespace"), ("session_id",), "step", ev.longest, ev.chunk_rows)
    return he.memory_operations(ob).df.select("session_id", "step", "namespace_entropy", "escalation_rate")


@query("status_colours", f"""{SIG}, j AS (SELECT b1.session_id, b1.step, signature FROM b1 LEFT JOIN sig USING (session_id, step)),
l AS (SELECT session_id, step, max(CASE WHEN signature IS NOT NULL THEN step END) OVER w AS at_, last_value(signature IGNORE NULLS) OVER w AS nm FROM j WINDOW w AS (PARTITION BY session_id ORDER BY step))
SELECT session_id, step, CASE WHEN step - at_ <= 30 THEN CASE WHEN nm IN ('mechanical_repetition', 'stagnation', 'context_thrashing') THEN 'red' ELSE 'yellow' END ELSE 'green' END AS colour,
  coalesce(step - at_ = 30, false) AS recovered FROM l""")
def status_colours(spark, sf_dir):
    m = measured(spark, sf_dir)
    marked = m.on(bl.calibrated(m, METRICS).df.withColumn("signature", bl.signature(METRICS)))
    return he.status(marked).df.select("session_id", "step", "colour", "recovered")


PLAN = {"gathering": (1.0, 0.3), "planning": (0.5, 0.2), "executing": (1.5, 0.3), "verifying": (1.2, 0.2), "delivering": (0.4, 0.1)}


@query("plan_deviation", f"""WITH {T}, e AS (SELECT session_id, step, phase, round(entropy(symbol) OVER (PARTITION BY session_id ORDER BY step ROWS 49 PRECEDING) + 1e-12, 4) AS h FROM b1),
x AS (SELECT *, {' '.join(['CASE phase', *[f"WHEN '{p}' THEN abs(h - {m}) / {s}" for p, (m, s) in PLAN.items()], 'END'])} AS z FROM e)
SELECT session_id, step, phase, round(h, 3) AS entropy, round(z + 1e-9, 2) AS z_score FROM x WHERE h <> 0 AND z > 2.5""")
def plan_deviation(spark, sf_dir):
    ev = bind.with_phase(bind.events(spark, sf_dir)).select("symbol", "phase")
    return he.plan_deviation(me.sliding_entropy(ev, out="action_entropy"), PLAN)


@query("evaluation_learning", f"""{SIG}, g AS (SELECT DISTINCT session_id, s AS sprint, s * 200 AS from_step, s * 200 + 150 AS to_step, ((session_id + s) % 4) / 4.0 AS score FROM b1, (SELECT unnest([0, 1, 2]) AS s)),
p AS (SELECT * FROM g WHERE score < 0.7), i AS (SELECT p.session_id, sprint, signature FROM p JOIN sig ON sig.session_id = p.session_id AND step BETWEEN from_step AND to_step)
SELECT signature, count(*) AS patterns, count(DISTINCT session_id || '-' || sprint) AS sprints, CAST(count(*) * -0.5 AS DOUBLE) AS threshold_change FROM i GROUP BY 1
UNION ALL SELECT 'none', count(*), count(*), 0.0::DOUBLE FROM p WHERE (session_id, sprint) NOT IN (SELECT (session_id, sprint) FROM i)""")
def evaluation_learning(spark, sf_dir):
    ids = bind.table(spark, sf_dir, "events").select((F.col("user_id") % 15).alias("session_id")).distinct()
    grades = ids.select("session_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("sprint")).select(
        "session_id", "sprint", (F.col("sprint") * 200).alias("from_step"), (F.col("sprint") * 200 + 150).alias("to_step"),
        (((F.col("session_id") + F.col("sprint")) % 4) / 4.0).alias("score"))
    return he.evaluation_learning(grades, signed(spark, sf_dir))


CASC = """, rs AS (SELECT *, sum(chg) OVER (PARTITION BY session_id ORDER BY step) AS rid FROM (SELECT *, CASE WHEN success = lag(success) OVER (PARTITION BY session_id ORDER BY step) THEN 0 ELSE 1 END AS chg FROM bm)),
ca AS (SELECT session_id, max(n) AS chain FROM (SELECT session_id, rid, count(*) AS n FROM rs WHERE NOT success GROUP BY ALL) GROUP BY session_id HAVING max(n) >= 3)"""


@query("session_health", f"""WITH {T}{CASC}, pr AS (SELECT session_id, max(phase_rank) AS m, count(*) FILTER (WHERE phase_rank < from_rank) AS reg, count(*) AS n FROM bm GROUP BY session_id),
h AS (SELECT pr.*, chain, greatest(0, m * 20 - reg * 5) AS done, least(chain / 10.0, 1.0) AS conf FROM pr LEFT JOIN ca USING (session_id))
SELECT session_id, CAST(done AS BIGINT) AS completion, CASE WHEN chain IS NULL THEN 0 ELSE 1 END::BIGINT AS diagnoses, round(CASE WHEN chain IS NULL THEN 0 ELSE 100.0 / n END, 2)::DOUBLE AS failure_density,
  (CASE WHEN chain IS NULL THEN 1.0 WHEN chain >= 7 THEN 0.8 ELSE 0.92 END)::DOUBLE AS trust, CASE WHEN chain >= 7 THEN 'failing' WHEN chain IS NOT NULL OR done < 30 THEN 'degraded' ELSE 'healthy' END AS health FROM h""")
def session_health(spark, sf_dir):
    ev = bind.trace_events(spark, sf_dir)
    return he.session_health(ph.progress(ph.phase_machine(ev.select("type", "tool"))), dt.run_detectors(ev, ("error_cascade",)))


@query("session_triage", f"""WITH {T}{CASC}, f AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE type = 'tool_call') AS calls, coalesce(bool_or(tool = 'edit_file'), false) AS wrote, arg_max(phase_rank, step) AS cur FROM bm GROUP BY session_id)
SELECT session_id, NOT (wrote AND cur = 1 AND calls > 5) AS plausible, CASE WHEN wrote AND cur = 1 AND calls > 5 THEN 'parser_issue' WHEN chain IS NULL THEN 'clean' WHEN chain >= 7 THEN 'real' ELSE 'ambiguous' END AS verdict FROM f LEFT JOIN ca USING (session_id)""")
def session_triage(spark, sf_dir):
    ev = bind.trace_events(spark, sf_dir)
    return he.triage(ev, ph.progress(ph.phase_machine(ev.select("type", "tool"))), dt.run_detectors(ev, ("error_cascade",)))


def named(spark, sf_dir, *cols):
    m = ph.phase_machine(bind.trace_events(spark, sf_dir).select("type", "tool", *cols))
    return m.with_columns(phase=phase_name(F.col("phase_rank")))


@query("calibrated_repetition")
def calibrated_repetition(spark, sf_dir):
    return he.calibrated_repetition(named(spark, sf_dir), bl.phase_distributions(segment_table(spark, sf_dir)), 2)


@query("calibrated_drift", f"""WITH {T}, mv AS (SELECT session_id, from_rank AS f, phase_rank AS t, phase_rank < from_rank AS reg FROM bm WHERE phase_rank <> from_rank),
md AS (SELECT f, t, count(*) / sum(count(*)) OVER (PARTITION BY f) < 0.2 AS rare FROM mv GROUP BY f, t),
pe AS (SELECT session_id, count(*) FILTER (WHERE rare) AS a, count(*) FILTER (WHERE reg) AS r FROM mv JOIN md USING (f, t) GROUP BY session_id),
cl AS (SELECT session_id, step, tool, type = 'tool_call' AND tool IS NOT NULL AS is_call, {NAME.format('phase_rank')} AS phase,
  max(step) OVER s AS n, {NAME.format('arg_max(phase_rank, step) OVER s')} AS last FROM bm WINDOW s AS (PARTITION BY session_id)),
ex AS (SELECT phase, tool, count(*) / sum(count(*)) OVER (PARTITION BY phase) AS q FROM cl WHERE is_call GROUP BY phase, tool),
ob AS (SELECT session_id, last AS phase, tool, count(*) / sum(count(*)) OVER (PARTITION BY session_id) AS p FROM cl WHERE is_call AND step > n - 30 GROUP BY session_id, last, tool),
k AS (SELECT DISTINCT session_id, phase FROM ob WHERE phase IN (SELECT phase FROM ex)),
al AS (SELECT k.session_id, tool FROM k JOIN ex USING (phase) UNION SELECT session_id, tool FROM ob WHERE session_id IN (SELECT session_id FROM k)),
pq AS (SELECT k.session_id, ex.tool IS NULL AS novel, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM al JOIN k ON k.session_id = al.session_id
  LEFT JOIN ob ON ob.session_id = al.session_id AND ob.tool = al.tool LEFT JOIN ex ON ex.phase = k.phase AND ex.tool = al.tool),
dv AS (SELECT session_id, round(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0), 6) AS d,
  round(coalesce(sum(p) FILTER (WHERE novel), 0), 6) AS nr FROM pq GROUP BY session_id),
sc AS (SELECT session_id, a, r, coalesce(d, 0)::DOUBLE AS d, round((CASE WHEN a >= 3 THEN 0.4 WHEN a >= 1 THEN 0.2 ELSE 0.0 END + CASE WHEN d > 1 THEN 0.3 WHEN d > 0.5 THEN 0.15 ELSE 0.0 END
  + CASE WHEN nr > 0.3 THEN 0.2 ELSE 0.0 END + CASE WHEN r > 8 THEN 0.2 ELSE 0.0 END)::DOUBLE, 3) AS c FROM pe LEFT JOIN dv USING (session_id))
SELECT session_id, c AS confidence, a AS anomalous_transitions, r AS regressions, round(d, 4) AS divergence FROM sc WHERE c >= 0.5""")
def calibrated_drift(spark, sf_dir):
    machine = phased(spark, sf_dir)
    moves = ph.transitions(machine)
    # The calls among a session's last 30 events, held against all sessions' calls in the phase the session ends in.
    whole = machine.totals(_n=F.max("step"), _last=F.max_by("phase_rank", "step")).df.where("type = 'tool_call' AND tool IS NOT NULL")
    recent = whole.where("step > _n - 30").select("session_id", phase_name(F.col("_last")).alias("phase"), "tool")
    observed = bl.share_table(recent, ["session_id", "phase"], "tool")
    expected = bl.share_table(whole.select(phase_name(F.col("phase_rank")).alias("phase"), "tool"), ["phase"], "tool")
    return he.calibrated_drift(moves, bl.transition_model(moves, 0.2), bl.tool_divergence(observed, expected), bl.novel_calls(observed, expected))


@query("calibrated_missing_verification")
def calibrated_missing_verification(spark, sf_dir):
    return he.calibrated_missing_verification(bind.trace_events(spark, sf_dir), bl.phase_distributions(segment_table(spark, sf_dir)), 3, 3.0)


@query("calibrated_context_loss", f"""WITH {T}, w AS (SELECT *, count(*) FILTER (WHERE type = 'tool_call' AND tool <> 'read_file') OVER (PARTITION BY session_id ORDER BY step) AS work FROM bm),
p AS (SELECT session_id, output_hash AS resource, min(step) AS f, max(step) AS at_step, count(*) AS n, max(work) - min(work) AS gap FROM w WHERE tool = 'read_file' GROUP BY ALL),
c AS (SELECT session_id, arg_max(phase_rank, step) AS cur FROM bm GROUP BY session_id)
SELECT session_id, least(n / 4.0, 1.0) AS confidence, at_step, resource, n AS read_count, gap AS intervening_operations FROM p JOIN c USING (session_id)
WHERE n >= 2 AND gap >= CASE WHEN cur = 1 THEN 5 ELSE 3 END QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY f) = 1""")
def calibrated_context_loss(spark, sf_dir):
    return he.calibrated_context_loss(named(spark, sf_dir, "output_hash"), {"gathering": 0.6, "executing": 0.1})


@query("stall_context", f"""WITH {T}, s AS (SELECT *, latency_ms > 15000 AS st, max(CASE WHEN type = 'user_input' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM bt),
r AS (SELECT *, step - max(CASE WHEN NOT st THEN step ELSE 0 END) OVER (PARTITION BY session_id ORDER BY step) AS run, max(CASE WHEN st THEN step END) OVER (PARTITION BY session_id) AS lst FROM s)
SELECT session_id, count(*) FILTER (WHERE st) AS stalls, max(CASE WHEN st AND near = 1 AND type <> 'user_input' THEN 1 ELSE 0 END) AS user_near, max(CASE WHEN st THEN run END) AS max_consecutive,
  count(*) FILTER (WHERE step > lst AND type = 'tool_call') AS calls_after, count(DISTINCT CASE WHEN step > lst AND type = 'tool_call' AND success THEN tool || '|' || output_hash END) AS unique_after FROM r WHERE lst IS NOT NULL GROUP BY session_id""")
def stall_context(spark, sf_dir):
    ev = bind.trace_events(spark, sf_dir).select("type", "tool", "success", "output_hash", "latency_ms")
    return he.stall_context(ev, ev.df.where("latency_ms > 15000"))


@query("onset_context", f"""WITH {T}, o AS (SELECT session_id, min(step) AS onset FROM bt WHERE NOT success GROUP BY session_id), e AS (SELECT bt.*, onset, count(*) OVER (PARTITION BY session_id) AS n FROM bt JOIN o USING (session_id)),
l AS (SELECT *, concat_ws(' ', '#' || step, type, tool, CASE WHEN NOT success THEN 'FAILED' END) AS line FROM e)
SELECT session_id, step, line, CASE WHEN step = onset THEN 'onset' WHEN step < onset THEN 'before' ELSE 'after' END AS part FROM l WHERE step BETWEEN greatest(1, onset - 15) AND onset + 10
UNION ALL SELECT session_id, step, line, 'head' FROM l WHERE step <= 5 UNION ALL SELECT session_id, step, line, 'tail' FROM l WHERE step > n - 10""")
def onset_context(spark, sf_dir):
    ev = bind.trace_events(spark, sf_dir).select("type", "tool", "success")
    onsets = ev.df.where(~F.col("success")).groupBy("session_id").agg(F.min("step").alias("onset_step"))
    return he.onset_context(ev, onsets)


@query("behavioural_audit", f"""{SIG}, f AS (SELECT session_id, max(step) AS events, arg_max(action_mi, step) AS mi, arg_max(kl_divergence, step) AS kl FROM met GROUP BY session_id),
c AS (SELECT session_id, count(*) AS n, mode(signature ORDER BY signature) AS dominant FROM sig GROUP BY session_id)
SELECT CASE WHEN mi < 0.4 THEN 'looping' WHEN kl > 0.45 OR coalesce(n, 0) / events > 0.15 THEN 'phase_shifting' ELSE 'steady' END AS state, count(*) AS sessions, CAST(sum(events) AS BIGINT) AS events,
  CAST(sum(coalesce(n, 0)) AS BIGINT) AS anomalies FROM f LEFT JOIN c USING (session_id) GROUP BY 1""")
def behavioural_audit(spark, sf_dir):
    m = measured(spark, sf_dir)
    marked = bl.calibrated(m, METRICS).df.withColumn("signature", bl.signature(METRICS))
    per = marked.groupBy("session_id").agg(F.max("step").alias("events"), F.max_by("action_mi", "step").alias("mi"),
                                           F.max_by("kl_divergence", "step").alias("kl"), F.count("signature").alias("n"))
    return per.groupBy(he.audit_state(F.col("events"), F.col("n"), F.col("mi"), F.col("kl")).alias("state")).agg(
        F.count("*").alias("sessions"), F.sum("events").alias("events"), F.sum("n").alias("anomalies"))


@query("session_profile", f"""WITH {T}, r AS (SELECT *, coalesce(tool, '') AS tl, CASE WHEN coalesce(tool, '') = lag(coalesce(tool, '')) OVER (PARTITION BY session_id ORDER BY step) THEN 0 ELSE 1 END AS chg FROM bt),
s AS (SELECT *, step - max(CASE WHEN chg = 1 THEN step END) OVER (PARTITION BY session_id ORDER BY step) + 1 AS run FROM r),
a AS (SELECT session_id, count(*) AS c FROM (SELECT session_id, output_hash FROM bt WHERE tool = 'read_file' GROUP BY ALL HAVING count(*) > 1) GROUP BY session_id)
SELECT session_id, round(avg(latency_ms) + 1e-9, 1) AS avg_latency_ms, round(avg((NOT success)::INT), 3) AS error_rate, count(DISTINCT tool) AS unique_tools, max(run) AS longest_streak, coalesce(any_value(c), 0) AS reread_count
FROM s LEFT JOIN a USING (session_id) GROUP BY session_id""")
def session_profile(spark, sf_dir):
    return he.session_profile(bind.trace_events(spark, sf_dir))


@query("repeated_reads", f"""WITH {T} SELECT session_id, output_hash AS resource, count(*) AS reads FROM bt WHERE tool = 'read_file' GROUP BY ALL HAVING count(*) >= 3""")
def repeated_reads(spark, sf_dir):
    return bind.trace_events(spark, sf_dir).df.where("tool = 'read_file'").groupBy("session_id", F.col("output_hash").alias("resource")).agg(
        F.count("*").alias("reads")).where("reads >= 3")


@query("trajectory_view", f"""WITH {T}, v AS (SELECT session_id, step, NOT success AS errored, success AND NOT lag(success) OVER w AS recovered, tool IS NOT DISTINCT FROM lag(tool) OVER w AND step > 1 AS redundant,
   sum(tokens_in + tokens_out) OVER w AS used FROM bt WINDOW w AS (PARTITION BY session_id ORDER BY step))
SELECT session_id, step, errored, coalesce(recovered, false) AS recovered, redundant, round(used / max(used) OVER (PARTITION BY session_id), 4) AS load FROM v""")
def trajectory_view(spark, sf_dir):
    ev = bind.trace_events(spark, sf_dir).select("tool", "success", (F.col("tokens_in") + F.col("tokens_out")).alias("t"))
    v = ev.frame(1, 0, {
        "recovered": lambda w: F.coalesce(F.col("success") & ~F.lag("success").over(w), F.lit(False)),
        "redundant": lambda w: (F.col("step") > 1) & F.lag("tool").over(w).eqNullSafe(F.col("tool"))}).running(used=("sum", F.col("t"))).totals(
        total=F.sum("t"))
    return v.df.select("session_id", "step", (~F.col("success")).alias("errored"), "recovered", "redundant", F.round(F.col("used") / F.col("total"), 4).alias("load"))


PAIR = LR + """, n AS (SELECT * FROM lr QUALIFY row_number() OVER (PARTITION BY user_id, annotator_type ORDER BY updated_at DESC, seq DESC) = 1),
p AS (SELECT a.user_id, a.has_failure AS fa, b.has_failure AS fb, a.onset_step AS oa, b.onset_step AS ob, a.severity AS sa, b.severity AS sb FROM n a JOIN n b USING (user_id) WHERE a.annotator_type = 'auto' AND b.annotator_type = 'human')"""


def annotator_pair(spark, sf_dir):
    from trajlens.operators.labels import latest
    newest = latest(bind.label_records(spark, sf_dir).drop("session_id"), ["user_id", "annotator_type"], "updated_at", "seq")
    def side(layer, s):
        return newest.where(F.col("annotator_type") == layer).select("user_id", F.col("has_failure").alias(f"f{s}"), F.col("onset_step").alias(f"o{s}"), F.col("severity").alias(f"s{s}"))
    return side("auto", "a").join(side("human", "b"), "user_id")


@query("annotator_agreement", f"""WITH {PAIR} SELECT count(*) AS n, round(avg((fa = fb)::INT), 4) AS agreement, round(avg(abs(oa - ob)), 2) AS onset_mae, round(avg((abs(oa - ob) <= 5)::INT), 4) AS within_5,
  round((avg((fa = fb)::INT) - (avg(fa::INT) * avg(fb::INT) + (1 - avg(fa::INT)) * (1 - avg(fb::INT)))) / (1 - (avg(fa::INT) * avg(fb::INT) + (1 - avg(fa::INT)) * (1 - avg(fb::INT)))), 4) AS kappa FROM p""")
def annotator_agreement(spark, sf_dir):
    p = annotator_pair(spark, sf_dir).withColumn("_one", F.lit(1))
    gap = F.abs(F.col("oa") - F.col("ob"))
    base = p.groupBy("_one").agg(F.count("*").alias("n"), F.round(F.avg((F.col("fa") == F.col("fb")).cast("int")), 4).alias("agreement"),
                                 F.round(F.avg(gap), 2).alias("onset_mae"), F.round(F.avg((gap <= 5).cast("int")), 4).alias("within_5"))
    k = ag.cohens_kappa(p, ["_one"], "fa", "fb").select("_one", F.round("kappa", 4).alias("kappa"))
    return base.join(k, "_one").drop("_one")


@query("auto_against_manual", f"""WITH {LR}, a AS (SELECT DISTINCT user_id, code FROM lr WHERE annotator_type = 'auto' AND has_failure AND code <> ''), h AS (SELECT DISTINCT user_id, code FROM lr WHERE annotator_type = 'human' AND has_failure AND code <> ''),
j AS (SELECT coalesce(a.code, h.code) AS code, a.user_id IS NOT NULL AS x, h.user_id IS NOT NULL AS y FROM a FULL JOIN h ON a.user_id = h.user_id AND a.code = h.code),
c AS (SELECT code, count(*) FILTER (WHERE x AND y) AS tp, count(*) FILTER (WHERE x AND NOT y) AS fp, count(*) FILTER (WHERE y AND NOT x) AS fn FROM j GROUP BY code)
SELECT *, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall FROM c""")
def auto_against_manual(spark, sf_dir):
    r = bind.label_records(spark, sf_dir).where(F.col("has_failure") & (F.col("code") != ""))
    def side(layer):
        return r.where(F.col("annotator_type") == layer).select("user_id", "code").distinct()
    both = side("auto").withColumn("x", F.lit(1)).join(side("human").withColumn("y", F.lit(1)), ["user_id", "code"], "full_outer")
    c = both.groupBy("code").agg(F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("y").isNull(), 1)).alias("fp"),
                                 F.count(F.when(F.col("x").isNull(), 1)).alias("fn"))
    return c.select("code", "tp", "fp", "fn", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 4).alias("precision"), F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 4).alias("recall"))


@query("baseline_comparison")
def baseline_comparison(spark, sf_dir):
    """First firing of the self, corpus and change-point baselines: share of sessions and median step."""
    m = measured(spark, sf_dir).kept()
    fires = {"self": signatures(bl.calibrated(m, METRICS)).groupBy("session_id").agg(F.min("step").alias("first_step")),
             "corpus": bl.leave_one_out(m, METRICS), "change_point": bl.change_points(m, ("action_entropy", "action_mi"))}
    total = m.df.select("session_id").distinct().count()
    out = None
    for name, f in fires.items():
        part = f.select(F.lit(name).alias("baseline"), "first_step")
        out = part if out is None else out.unionByName(part)
    median = st.quantiles(out, ["baseline"], "first_step", {"median_step": 0.5}).drop("n")
    out = out.groupBy("baseline").agg(F.round(F.count("*") / float(total), 4).alias("fire_rate"),
                                      (F.max("first_step") - F.min("first_step")).alias("spread")).join(median, "baseline", "left")
    return out.withColumn("artifact", (F.col("fire_rate") >= 0.8) & (F.col("spread") <= 120))
