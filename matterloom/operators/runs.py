"""Run logs: deltas of stages, states of jobs and scenes, gating of tasks, wide reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import percentiles

#: Steps (a range of their order) of a scene that one task goes through; longer scenes go in parts.
PART = 65_536


def deltas(stages: DataFrame, keys: list[str], order: str, value: str, ran: str) -> DataFrame:
    """Change of a value between stages that ran, one after the other; no change and the first are left out."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return stages.where(ran).withColumn("delta", step).where("delta IS NOT NULL AND delta <> 0")


def stage_shares(times: DataFrame, scene: str, step: str, stage: str, seconds: str, finished: int, digits: int = 6) -> DataFrame:
    """Per stage: its times, its share of its scenes' and steps' time (a scene's total counts once for each run of the stage), and its chance."""
    by_scene = times.groupBy(scene).agg(F.sum(seconds).alias("scene_s"))
    by_step = times.groupBy(scene, step).agg(F.sum(seconds).alias("step_s"))
    rows = times.join(by_step, [scene, step]).join(by_scene, scene)
    levels = percentiles(times, [step, stage], seconds, {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}, digits)
    shares = rows.groupBy(step, stage).agg(
        F.count("*").alias("n"),
        F.round(F.avg(seconds), digits).alias("mean"),
        F.round(F.sum(seconds), digits).alias("total"),
        F.round(100 * F.sum(seconds) / F.sum("scene_s"), digits).alias("percent_scene"),
        F.round(100 * F.sum(seconds) / F.sum("step_s"), digits).alias("percent_step"),
        F.round(F.count("*") / finished, digits).alias("chance"),
    )
    return shares.join(levels, [step, stage], "left")


def last_states(events: DataFrame, keys: list[str], state: str, order: list[str]) -> DataFrame:
    """The last state of each key, by a partial aggregate."""
    return events.groupBy(*keys).agg(F.max_by(state, F.struct(*order)).alias(state))


def state_counts(jobs: DataFrame, state: str, task: str, ignored: str) -> DataFrame:
    """Jobs by state and task, the task's name cut at the first underscore, and a total for each state."""
    rows = jobs.where(F.col(state) != ignored).withColumn(task, F.split_part(task, F.lit("_"), F.lit(1)))
    counted = rows.rollup(state, task).agg(F.grouping_id().alias("g"), F.count("*").alias("n")).where("g < 3")
    return counted.select(state, F.when(F.col("g") == 1, "total").otherwise(F.col(task)).alias(task), "n")


def scene_states(jobs: DataFrame, scene: str, done, running, fatal) -> DataFrame:
    """Per scene: jobs done and running, and its state."""
    out = jobs.groupBy(scene).agg(F.count_if(done).alias("num_done"), F.count_if(running).alias("num_running"), F.bool_or(fatal).alias("crashed"), F.count("*").alias("n"))
    state = F.when(F.col("crashed"), "crashed").when(F.col("num_done") == F.col("n"), "done").when(F.col("num_running") > 0, "running").otherwise("waiting")
    return out.select(scene, "num_done", "num_running", state.alias("state"))


def next_scenes(states: DataFrame, scene: str, n: int) -> DataFrame:
    """The scenes to go on with: neither done nor crashed, those furthest on first."""
    return states.where("state NOT IN ('done', 'crashed')").orderBy(F.desc(F.col("num_running") + F.col("num_done")), scene).limit(n)


def gated(tasks: DataFrame, scene: str, order: str, succeeded: str, condition: str, part: int = PART) -> DataFrame:
    """Which tasks run (E13): a condition of ``prev_succeeded`` or ``prev_failed`` is held against the last task that ran; a
    skipped task leaves that state as it was. A failure is fatal unless the next task runs because of it. Before the first
    task the state is a success; a missing success is a failure, a missing condition is ``prev_failed``; ``order`` is a number of
    its own for each task of a scene.

    Each task either sets the state, whatever it was, or leaves it: one that always runs sets its outcome, one that runs after
    a success can only set a failure, and the other way round. So the state is the last that was set. Scenes are cut into parts
    by ``order``; a part takes over the state of those before it, and looks at the first condition of the next."""
    ok = F.coalesce(F.col(succeeded), F.lit(False))
    rule = F.coalesce(F.col(condition), F.lit("prev_failed"))
    after_success = rule == "prev_succeeded"
    sets = F.when(rule == "always", ok).when(after_success & ~ok, False).when(~after_success & ok, True)
    rows = tasks.withColumns({"_part": F.floor(F.col(order) / part), "_kind": F.lit(1), "_sets": sets, "_saves": rule.isin("prev_failed", "always")})
    ends = rows.groupBy(scene, "_part").agg(F.max_by("_sets", F.when(F.col("_sets").isNotNull(), F.col(order))).alias("last"), F.min_by("_saves", order).alias("first"))
    parts = Window.partitionBy(scene).orderBy(F.col("_part").asc_nulls_last())
    before = F.last("last", ignorenulls=True).over(parts.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(scene, "_part", before.alias("_sets"), F.lead("first").over(parts).alias("_saves"))
    rows = rows.unionByName(ends.select(scene, "_part", "_sets", F.lit(0).alias("_kind")), allowMissingColumns=True)
    rows = rows.unionByName(ends.select(scene, "_part", "_saves", F.lit(2).alias("_kind")), allowMissingColumns=True)
    inside = Window.partitionBy(scene, "_part").orderBy("_kind", F.col(order).asc_nulls_last())
    state = F.coalesce(F.last("_sets", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    rows = rows.withColumns({"_state": state, "_saved": F.coalesce(F.lead("_saves").over(inside), F.lit(False))}).where("_kind = 1")
    rows = rows.withColumn("ran", (rule == "always") | (F.col("_state") == after_success))
    return rows.withColumn("fatal", F.col("ran") & ~ok & ~F.col("_saved")).select(*tasks.columns, "ran", "fatal")


def wide_report(long: DataFrame, key: str, metric: str, value: str, metrics: list[str]) -> DataFrame:
    """One row for each key with a column for each of the given metrics."""
    return long.groupBy(key).pivot(metric, metrics).agg(F.first(value))


def running(rows: DataFrame, keys: list[str], order: list[str], part: Column, last: dict[str, Column] | None = None, least: dict[str, Column] | None = None, upto: int = 0) -> DataFrame:
    """``rows`` with what each has behind it within its keys: by name the last value that is not null, or the least, up to the row itself
    (``upto`` 0) or the one before it (-1). An as-of join of rows to those before them.

    ``part`` rises with ``order``: a key's rows are gone through part by part, and a part begins with what those before it leave, so a key
    with a third of all rows is spread over tasks."""
    columns = {**(last or {}), **(least or {})}
    rows = rows.withColumns({"_part": part, "_kind": F.lit(1), **{f"_{n}": c for n, c in columns.items()}})
    end = lambda n: F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.struct(*order))) if n in (last or {}) else F.min(f"_{n}")
    over = lambda n, w: F.last(f"_{n}", ignorenulls=True).over(w) if n in (last or {}) else F.min(f"_{n}").over(w)
    ends = rows.groupBy(*keys, "_part").agg(*[end(n).alias(f"_{n}") for n in columns])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_part", F.lit(0).alias("_kind"), *[over(n, before).alias(f"_{n}") for n in columns])
    inside = Window.partitionBy(*keys, "_part").orderBy("_kind", *order).rowsBetween(Window.unboundedPreceding, upto)
    out = rows.unionByName(carried, allowMissingColumns=True).withColumns({n: over(n, inside) for n in columns})
    return out.where("_kind = 1").drop("_part", "_kind", *[f"_{n}" for n in columns])


def crash_records(lines: DataFrame, keys: list[str], order: list[str], part: Column, stage: Column, node: Column, reason: Column, fatal: Column) -> DataFrame:
    """A record of each crash in the lines of a log (D24): (keys, order, stage, node, reason, fatal), the stage and the node being the last
    that the log names before. ``stage``, ``node`` and ``reason`` are read from a line, null where it names none; a line whose
    reason is not null is a crash."""
    rows = running(lines.withColumns({"_reason": reason, "_fatal": fatal}), keys, order, part, last={"stage": stage, "node": node})
    return rows.where("_reason IS NOT NULL").select(*keys, *order, "stage", "node", F.col("_reason").alias("reason"), F.col("_fatal").alias("fatal"))
