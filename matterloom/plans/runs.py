"""Trials, jobs, scenes and stage timings over the events table: a user is a case or scene, a type a state or stage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.hashing import int_hash_sql, uniform
from ..operators import runs, search, stats, trials
from . import query

TRIALS = "t AS (SELECT user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS trial_id, event_type IN ('click', 'purchase') AS passed FROM events)"
BEFORE = TRIALS + ", b AS (SELECT *, coalesce(sum(passed::INT) OVER (PARTITION BY case_id ORDER BY trial_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS passed_before FROM t)"


def _trials(t):
    n = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    return t.events.select(F.col("user_id").alias("case_id"), n.alias("trial_id"), F.col("event_type").isin("click", "purchase").alias("passed"))


@query(f"WITH {BEFORE} SELECT * FROM b WHERE passed_before < 4 AND trial_id < 20")
def trial_quota(t):
    return trials.within_quota(_trials(t), "case_id", "trial_id", "passed", 4, 20)


@query(f"WITH {TRIALS} SELECT case_id, trial_id, row_number() OVER (PARTITION BY case_id ORDER BY trial_id) - 1 AS sample_id FROM t WHERE passed")
def trial_renumber(t):
    return trials.renumbered(_trials(t), "case_id", "trial_id", "passed").drop("passed")


@query(f"WITH {BEFORE} SELECT case_id, passed_before FROM b WHERE trial_id = 20 AND passed_before < 7")
def trial_abandon(t):
    return trials.abandoned(_trials(t), "case_id", "trial_id", "passed", 10, 100 / 7)


@query(f"""WITH {TRIALS}, c AS (SELECT case_id, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, max(trial_id) FILTER (WHERE NOT passed) AS last FROM t GROUP BY ALL)
  SELECT case_id, passed, passed + failed AS total, greatest(passed + failed, coalesce(last + 1, 0)) AS next_trial FROM c""")
def trial_counters(t):
    rows = _trials(t)
    return trials.restored(rows.where("passed"), rows.where("NOT passed"), "case_id", "trial_id")


@query(f"WITH {TRIALS} SELECT case_id, count(*) AS total, count(*) FILTER (WHERE passed) AS passed FROM t GROUP BY ROLLUP (case_id)")
def case_totals(t):
    return trials.totals(_trials(t), "case_id", "passed")


@query(f"WITH {TRIALS}, c AS (SELECT case_id, count(*) AS total, count(*) FILTER (WHERE passed) AS passed FROM t GROUP BY ALL) SELECT * FROM c WHERE total > 0 AND total < 100000 AND passed < 100000 ORDER BY passed DESC, case_id LIMIT 10")
def top_unfinished(t):
    whole = trials.totals(_trials(t), "case_id", "passed").where("case_id IS NOT NULL")
    return trials.unfinished(whole, "case_id", 100_000, 100_000).limit(10)


@query(f"WITH {TRIALS} SELECT case_id, count(*) AS total FROM t GROUP BY ALL HAVING bool_or(NOT passed) ORDER BY case_id LIMIT 16")
def next_cases(t):
    return _trials(t).groupBy("case_id").agg(F.count("*").alias("total"), F.bool_or(~F.col("passed")).alias("open")).where("open").orderBy("case_id").limit(16).drop("open")


JOBS = "j AS (SELECT user_id AS seed, 'task' || event_id % 3 || CASE WHEN event_id % 2 = 0 THEN '_0' ELSE '' END AS task, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY ALL)"


def _jobs(t):
    task = F.concat(F.lit("task"), F.col("event_id") % 3, F.when(F.col("event_id") % 2 == 0, "_0").otherwise(""))
    return runs.last_states(t.events.select(F.col("user_id").alias("seed"), task.alias("task"), F.col("event_type").alias("state"), "ts", "event_id"), ["seed", "task"], "state", ["ts", "event_id"])


@query(f"WITH {JOBS} SELECT state, CASE WHEN grouping(split_part(task, '_', 1)) = 1 THEN 'total' ELSE split_part(task, '_', 1) END AS task, count(*) AS n FROM j WHERE state <> 'signup' GROUP BY state, ROLLUP (split_part(task, '_', 1))")
def job_state_rollup(t):
    return runs.state_counts(_jobs(t), "state", "task", "signup")


STATES = f"""WITH {JOBS}, s AS (SELECT seed, count(*) FILTER (WHERE state = 'purchase') AS num_done, count(*) FILTER (WHERE state = 'click') AS num_running, count(*) FILTER (WHERE state = 'error') > 2 AS crashed, count(*) AS n FROM j GROUP BY ALL),
  r AS (SELECT seed, num_done, num_running, CASE WHEN crashed THEN 'crashed' WHEN num_done = n THEN 'done' WHEN num_running > 0 THEN 'running' ELSE 'waiting' END AS state FROM s)"""


@query(STATES.replace("count(*) FILTER (WHERE state = 'error') > 2", "bool_or(state = 'error' AND task LIKE 'task0%')") + " SELECT * FROM r")
def scene_state(t):
    s = F.col("state")
    return runs.scene_states(_jobs(t), "seed", s == "purchase", s == "click", (s == "error") & F.col("task").startswith("task0"))


@query(STATES.replace("count(*) FILTER (WHERE state = 'error') > 2", "bool_or(state = 'error' AND task LIKE 'task0%')") + " SELECT * FROM r WHERE state NOT IN ('done', 'crashed') ORDER BY num_running + num_done DESC, seed LIMIT 20")
def next_scenes(t):
    return runs.next_scenes(scene_state(t), "seed", 20)


@query(r"""WITH d AS (SELECT doc_id, lang, text || chr(10) AS x FROM documents), r AS (SELECT doc_id, CASE WHEN contains(x, 'System is out of GPU memory') THEN 'Out of GPU memory' WHEN contains(x, 'this scene is timed-out') OR contains(x, 'DUE TO TIME LIMIT') THEN 'Timed out'
  WHEN doc_id % 11 = 0 THEN 'SIGKILL: 9 (out-of-memory, probably)' WHEN contains(x, 'SIGCONT') THEN 'SIGCONT (timeout?)' WHEN contains(x, 'srun: error') THEN 'srun error'
  WHEN doc_id % 5 = 0 THEN 'Error: stage ' || lang ELSE 'Could not summarize cause' END AS reason FROM d) SELECT reason, count(*) AS n FROM r GROUP BY ALL""")
def crash_reasons(t):
    log = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 11 == 0, "\n<Signals.SIGKILL: 9>").otherwise(""), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("\nError: stage "), "lang", F.lit("\nError: Not freed memory blocks: 3"))).otherwise(""), F.lit("\n"))
    return t.documents.select(fx.crash_reason(log).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_id, event_type, round(delta, 6) AS delta FROM (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS delta FROM events WHERE event_type <> 'error') WHERE delta IS NOT NULL AND delta <> 0""")
def stage_deltas(t):
    rows = t.events.withColumn("ran", F.col("event_type") != "error")
    return runs.deltas(rows, ["user_id"], "event_id", "value", "ran").select("user_id", "event_id", "event_type", F.round("delta", 6).alias("delta"))


@query("""WITH e AS (SELECT user_id, event_type AS step, event_id % 4 AS stage, value FROM events), r AS (SELECT *, sum(value) OVER (PARTITION BY user_id) AS scene_s, sum(value) OVER (PARTITION BY user_id, step) AS step_s FROM e)
  SELECT step, stage, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(sum(value), 6) AS total,
  round(100 * sum(value) / sum(scene_s), 6) AS percent_scene, round(100 * sum(value) / sum(step_s), 6) AS percent_step, round(count(*) / (SELECT count(DISTINCT user_id) FROM events), 6) AS chance FROM r GROUP BY ALL""")
def stage_stats(t):
    rows = t.events.select("user_id", F.col("event_type").alias("step"), (F.col("event_id") % 4).alias("stage"), "value")
    return runs.stage_shares(rows, "user_id", "step", "stage", "value", rows.select("user_id").distinct().count())


@query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY ALL""")
def step_stats(t):
    return stats.spread(t.events, ["event_type"], "value")


@query("SELECT user_id, round(sum(value), 4) AS seconds FROM events GROUP BY ALL")
def scene_time(t):
    return t.events.groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("seconds"))


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id, " + ", ".join(f"round(sum(value) FILTER (WHERE event_type = '{x}'), 4) AS \"{x}\"" for x in TYPES) + " FROM events GROUP BY ALL")
def scene_report_wide(t):
    long = t.events.groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("s"))
    return runs.wide_report(long, "user_id", "event_type", "s", TYPES)


@query("""SELECT user_id, it, best FROM (SELECT user_id, row_number() OVER w - 1 AS it, min(value) OVER (w ROWS UNBOUNDED PRECEDING) AS best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE (it + 1) % 5 = 0""")
def running_best(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = t.events.select("user_id", (F.row_number().over(w) - 1).cast("long").alias("it"), F.min("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("best"))
    return rows.where((F.col("it") + 1) % 5 == 0)


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, event_type <> 'error' AS ok, CASE event_id % 3 WHEN 0 THEN 'prev_succeeded' WHEN 1 THEN 'prev_failed' ELSE 'always' END AS rule FROM events),
  g(user_id, pos, ok, rule, ran, state) AS (SELECT user_id, pos, ok, rule, rule <> 'prev_failed', CASE WHEN rule <> 'prev_failed' THEN ok ELSE true END FROM e WHERE pos = 1
    UNION ALL SELECT e.user_id, e.pos, e.ok, e.rule, e.rule = 'always' OR g.state = (e.rule = 'prev_succeeded'), CASE WHEN e.rule = 'always' OR g.state = (e.rule = 'prev_succeeded') THEN e.ok ELSE g.state END FROM g JOIN e ON e.user_id = g.user_id AND e.pos = g.pos + 1)
  SELECT user_id, pos, ran, ran AND NOT ok AND NOT coalesce(next_rule IN ('prev_failed', 'always'), false) AS fatal FROM (SELECT *, lead(rule) OVER (PARTITION BY user_id ORDER BY pos) AS next_rule FROM g)""")
def task_gating(t):
    k = F.col("event_id") % 3
    rows = t.events.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("pos"), (F.col("event_type") != "error").alias("ok"), F.when(k == 0, "prev_succeeded").when(k == 1, "prev_failed").otherwise("always").alias("rule"))
    return runs.gated(rows, "user_id", "pos", "ok", "rule").select("user_id", "pos", "ran", "fatal")


@query(r"""SELECT event_id, CASE WHEN value >= 100 THEN floor(value)::BIGINT * 60 + 5 ELSE floor(value)::BIGINT * 3600 + 125 END AS seconds,
  printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS clock FROM (SELECT *, floor(value * 10)::BIGINT AS s FROM events)""")
def duration_parse(t):
    whole = F.floor("value").cast("long")
    minutes = F.format_string("%d:%02d:05", F.floor(whole / 60), whole % 60)
    days = F.concat(F.floor(whole / 24).cast("string"), F.lit(" days, "), F.format_string("%d:02:05.250", whole % 24))
    text = F.when(F.col("value") >= 100, minutes).otherwise(days)
    return t.events.select("event_id", fx.seconds(text).alias("seconds"), fx.clock(F.floor(F.col("value") * 10)).alias("clock"))


@query(r"""WITH l AS (SELECT CASE WHEN event_id % 13 = 0 THEN 'no line of a job' ELSE concat_ws(' ', event_id, 'job_' || user_id, 'cpu=4,node=1,mem=' || event_id || CASE event_id % 3 WHEN 0 THEN 'K' WHEN 1 THEN 'M' ELSE '?' END, floor(value)::BIGINT,
    CASE WHEN event_id % 7 = 0 THEN event_type ELSE upper(event_type) END, CASE WHEN event_id % 11 = 0 THEN 'gpu' ELSE 'node' END || user_id, '2023-07-01T10:00:00') || CASE WHEN event_id % 5 = 0 THEN ' 12 more' ELSE '' END END AS line FROM events),
  p AS (SELECT regexp_extract(line, '^([0-9]+) +(\S+) +(\S+) +([0-9]+) +([A-Z_]+) +(node[0-9]+) +(\S+).*$', ['id', 'name', 'has', 'elapsed', 'state', 'node', 'start']) AS j FROM l),
  m AS (SELECT j, regexp_extract(j.has, '(?:^|,)mem=([0-9.]+)([GMK])$', ['n', 'unit']) AS m FROM p WHERE j.id <> '')
  SELECT j.id::BIGINT AS job_id, j.name AS name, j.elapsed::BIGINT AS elapsed, j.state AS state, j.node AS node, CASE m.unit WHEN 'K' THEN round(TRY_CAST(m.n AS DOUBLE) / 1e6, 9) WHEN 'M' THEN round(TRY_CAST(m.n AS DOUBLE) / 1e3, 9) WHEN 'G' THEN TRY_CAST(m.n AS DOUBLE) ELSE -1.0 END AS memory_gb FROM m""")
def job_line_parse(t):
    memory = F.concat(F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "K").when(F.col("event_id") % 3 == 1, "M").otherwise("?"))
    line = F.when(F.col("event_id") % 13 == 0, F.lit("no line of a job")).otherwise(F.concat_ws(" ", "event_id", F.concat(F.lit("job_"), "user_id"), F.concat(F.lit("cpu=4,node=1,mem="), memory), F.floor("value").cast("string"), F.when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise(F.upper("event_type")), F.concat(F.when(F.col("event_id") % 11 == 0, "gpu").otherwise("node"), "user_id"), F.lit("2023-07-01T10:00:00")))
    line = F.when((F.col("event_id") % 5 == 0) & (F.col("event_id") % 13 != 0), F.concat(line, F.lit(" 12 more"))).otherwise(line)
    job = fx.job_line(line)
    return t.events.select(job.alias("j")).where("j IS NOT NULL").select("j.job_id", "j.name", "j.elapsed", "j.state", "j.node", F.round(fx.memory_gb(F.try_element_at("j.resources", F.lit("mem"))), 9).alias("memory_gb"))


@query("""WITH l AS (SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN 'stage_' || event_id % 5 END AS stage, CASE WHEN event_type = 'click' THEN 'node' || event_id % 7 END AS node,
    CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'Out of GPU memory' WHEN 1 THEN 'Timed out' WHEN 2 THEN 'srun error' ELSE 'Error: mesh ' || event_id END END AS reason, event_id % 2 = 0 AS fatal FROM events),
  a AS (SELECT user_id, event_id, last_value(stage IGNORE NULLS) OVER w AS stage, last_value(node IGNORE NULLS) OVER w AS node, reason, fatal FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
  SELECT * FROM a WHERE reason IS NOT NULL""")
def crash_records(t):
    k = F.col("event_id")
    text = F.coalesce(
        F.when(F.col("event_type") == "view", F.concat(F.lit("[stage_"), k % 5, F.lit("] started"))),
        F.when(F.col("event_type") == "click", F.concat(F.lit("running on node"), k % 7)),
        F.when(F.col("event_type") == "error", F.when(k % 4 == 0, "System is out of GPU memory").when(k % 4 == 1, "slurmstepd: CANCELLED DUE TO TIME LIMIT").when(k % 4 == 2, "srun: error: exit 1").otherwise(F.concat(F.lit("Error: mesh "), k))),
        F.lit("Error: Not freed memory blocks: 2"),
    )
    lines = t.events.select("user_id", "event_id", text.alias("text"))
    read = lambda pattern: F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    return runs.crash_records(lines, ["user_id"], ["event_id"], F.floor(k / 4096), read(r"^\[([^\]]+)\] started"), read(r"\b(node\d+)\b"), fx.crash_line(F.col("text")), k % 2 == 0)


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS example, event_id AS it, value AS metric, {int_hash_sql("'4' || user_id || '/' || event_id")} / 4294967295 AS draw, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events),
  g(example, it, pos, current, best, p0, p1, p2) AS (SELECT DISTINCT example, -1::BIGINT, 0::BIGINT, 90.0::DOUBLE, 90.0::DOUBLE, 'start', NULL::VARCHAR, NULL::VARCHAR FROM e
    UNION ALL SELECT example, it, pos, CASE WHEN ok THEN metric ELSE current END, least(best, current), CASE WHEN ok AND it % 3 = 0 THEN it::VARCHAR ELSE p0 END, CASE WHEN ok AND it % 3 = 1 THEN it::VARCHAR ELSE p1 END, CASE WHEN ok AND it % 3 = 2 THEN it::VARCHAR ELSE p2 END
    FROM (SELECT e.*, g.current, g.best, g.p0, g.p1, g.p2, e.metric < g.current OR e.draw < 0.05 AS ok FROM g JOIN e ON e.example = g.example AND e.pos = g.pos + 1))
  SELECT example, it, current, best, concat_ws(',', 'p0=' || p0, 'p1=' || p1, 'p2=' || p2) AS state FROM g WHERE pos > 0 AND (it + 1) % 20 = 0""")
def search_states(t):
    steps = t.events.select(F.col("user_id").alias("example"), F.col("event_id").alias("it"), F.col("value").alias("metric"), uniform(4, F.col("user_id"), F.lit("/"), F.col("event_id")).alias("draw"))
    changes = steps.select("example", "it", F.concat(F.lit("p"), F.col("it") % 3).alias("param"), F.col("it").cast("string").alias("value"))
    first = steps.select("example").distinct().select("example", F.lit(-1).cast("long").alias("it"), F.lit("p0").alias("param"), F.lit("start").alias("value"))
    out = search.search_states(steps, changes.unionByName(first), 90.0, 20, part=512)
    text = F.array_join(F.transform(F.map_entries("state"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return out.withColumn("state", text)
