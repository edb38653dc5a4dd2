"""Plans over calendars: proportional allocation, due dates, levels, competition ranking."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allocate(phases: DataFrame, key: str = "plan_id") -> DataFrame:
    """(plan, ordinal, start, end): days between a plan's start_date and end_date shared out to its phases by weight.

    Each phase has its rounded share, halves to the even, at least one day, and no more than leaves a day for each phase behind it; the last
    takes what is left. A plan with fewer days than phases has no row.
    """
    w = Window.partitionBy(key).orderBy("ordinal")
    whole = Window.partitionBy(key)
    days, n, k = F.datediff("end_date", "start_date") + 1, F.row_number().over(w), F.count(F.lit(1)).over(whole)
    rows = phases.withColumn("_days", days).withColumn("_n", n).withColumn("_k", k).withColumn("_own", F.greatest(F.lit(1), F.bround(F.col("_days") * F.col("weight") / F.sum("weight").over(whole)).cast("int")))
    # shares are a day at least, so the bound of the phase itself is the only one that can count
    upto = F.sum("_own").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_end", F.when(F.col("_n") == F.col("_k"), F.col("_days")).otherwise(F.least(upto, F.col("_days") - F.col("_k") + F.col("_n"))).cast("int"))
    rows = rows.withColumn("_from", F.coalesce(F.lag("_end").over(w), F.lit(0))).where("_days >= _k")
    return rows.select(key, "ordinal", F.date_add("start_date", F.col("_from")).alias("start"), F.date_add("start_date", F.col("_end") - 1).alias("end"))


def due_date(start: Column, end: Column, blocked: Column) -> Column:
    """Latest day of a range that isn't blocked; null if all are."""
    return F.array_max(F.array_except(F.sequence(start, end), F.coalesce(blocked, F.array().cast("array<date>"))))


#: Terms of answers that tell experience, and what a task's level asks for.
ADVANCED = ("获奖", "复现", "论文", "项目", "多次", "熟练", "advanced")
INTERMEDIATE = ("参加过", "基础", "课程", "一次", "intermediate")
EXPERIENCE = {"beginner": 0, "intermediate": 1, "experienced": 2}


def preparation_level(text: Column, has_awards: Column, has_projects: Column, advanced=ADVANCED, intermediate=INTERMEDIATE) -> Column:
    """beginner, intermediate or experienced: 2 for an advanced term, 1 for an intermediate one, 2 each for awards and projects; cut at 6 and 2."""
    score = F.lit(0)
    low = F.lower(F.coalesce(text, F.lit("")))
    for weight, terms in ((2, advanced), (1, intermediate)):
        for t in terms:
            score = score + F.when(F.contains(low, F.lit(t.lower())), weight).otherwise(0)
    for said in (has_awards, has_projects):
        score = score + F.when(F.coalesce(said, F.lit(False)), 2).otherwise(0)
    return F.when(score >= 6, "experienced").when(score >= 2, "intermediate").otherwise("beginner")


def schedule_tasks(tasks: DataFrame, key: str = "plan_id") -> DataFrame:
    """(plan, ordinal, outcome, due): which of a plan's ``tasks`` get a place, in order.

    ``tasks``: the plan, ordinal, required, hours, level (of the person), least (level that the task asks for), start, end, blocked (array of dates), budget (hours for optional tasks). Tasks
    above the person's level go; unknown levels are the lowest. A due date is the latest free day of the range. Without one, or without the hours, an optional task is
    dropped, and a required one is impossible. An optional task that doesn't fit leaves its hours to later ones, so plans stream through tasks in order, each with one number of state.
    """
    rank = F.create_map(*(F.lit(x) for pair in EXPERIENCE.items() for x in pair))
    place = lambda c: F.coalesce(F.try_element_at(rank, F.col(c)), F.lit(0))
    rows = tasks.where(place("level") >= place("least")).select(key, "ordinal", F.coalesce("required", F.lit(False)).alias("required"), F.coalesce(F.col("hours").cast("double"), F.lit(0.0)).alias("hours"), F.greatest(F.lit(0.0), F.coalesce(F.col("budget").cast("double"), F.lit(0.0))).alias("budget"), due_date(F.col("start"), F.col("end"), F.col("blocked")).alias("due"))
    rows = rows.withColumn("outcome", F.when(F.col("required"), F.when(F.col("due").isNull(), "impossible").otherwise("required")).when(F.col("due").isNull(), "dropped"))

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan, used = None, 0.0
        for part in parts:
            out = []
            for own, hours, budget, outcome in part[[key, "hours", "budget", "outcome"]].itertuples(index=False):
                if own != plan:
                    plan, used = own, 0.0
                if outcome is None:
                    outcome = "dropped" if used + hours > budget else "optional"
                    used += hours if outcome == "optional" else 0.0
                out.append(outcome)
            yield part.assign(outcome=out)

    placed = rows.repartition(key).sortWithinPartitions(key, "ordinal").mapInPandas(fit, rows.schema)
    return placed.select(key, "ordinal", "outcome", F.when(F.col("outcome").isin("required", "optional"), F.col("due")).alias("due"))


def rank_competitions(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Rows with score and rank: weighted mean of component columns; ties by catalogue, name, id."""
    total = sum(weights.values())
    score = F.lit(0.0)
    for c, w in weights.items():
        score = score + F.lit(w) * F.coalesce(F.col(c), F.lit(0.0))
    scored = rows.withColumn("score", F.bround(score / total, 6))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("in_catalog"), "name", "id")))


#: Why a card that changes a plan is refused.
NO_SOURCE, NO_TASK, NO_PHASE, BAD_DATE, BAD_TASK, MUST_STAY, BAD_SCHEDULE, NO_ADVICE = (
    "missing_required_fields", "target_task_not_found", "target_phase_not_found", "date_out_of_range", "invalid_add_task_fields", "required_task_delete_forbidden", "phase_schedule_invalid", "invalid_advice_fields",
)


def change_cards(cards: DataFrame, plans: DataFrame, phases: DataFrame, tasks: DataFrame, today: Column) -> DataFrame:
    """(card_id, status, code): whether each card may change its plan, and the first reason why not; nothing is changed.

    ``cards``: card_id, plan_id, type (move_task, add_task, delete_task, reschedule_phase, append_advice), status, code, n_sources, target_task,
    target_phase (a key), new_date, new_task (whether a valid one is there), due_date, schedule (array of phase, start, end), advice. ``plans``:
    plan_id, time_model, target_date, valid. ``phases``: plan_id, phase_id, phase_key, start, end. ``tasks``, optional ones included: plan_id, task_id, phase_id,
    mandatory. A card that is refused already stays so. Cards of an unknown plan find nothing. Of phases of equal key or tasks of equal id the last id counts.
    """
    own = tasks.groupBy("plan_id", F.col("task_id").alias("target_task")).agg(F.max_by(F.struct("phase_id", "mandatory"), F.struct("phase_id", "mandatory")).alias("_task"))
    by_key = phases.groupBy("plan_id", F.col("phase_key").alias("target_phase")).agg(F.max_by(F.struct("start", "end"), "phase_id").alias("_keyed"))
    by_id = phases.groupBy("plan_id", F.col("phase_id").alias("_home")).agg(F.max(F.struct("start", "end")).alias("_own"))
    known = phases.groupBy("plan_id").agg(F.collect_set("phase_key").alias("_keys"))  # a plan's phases
    rows = cards.join(own, ["plan_id", "target_task"], "left").withColumn("_home", F.col("_task.phase_id"))
    rows = rows.join(by_key, ["plan_id", "target_phase"], "left").join(by_id, ["plan_id", "_home"], "left").join(known, "plan_id", "left").join(plans, "plan_id", "left")
    phase = F.when(F.coalesce("target_phase", F.lit("")) != "", F.col("_keyed")).otherwise(F.col("_own"))
    within = lambda day, p: (day >= today) & (day >= p["start"]) & (day <= p["end"])
    move = F.when(F.col("_task").isNull(), NO_TASK).when(F.col("new_date").isNull(), BAD_DATE).when(phase.isNull(), NO_PHASE).when(~within(F.col("new_date"), phase), BAD_DATE)
    add = F.when(F.col("_keyed").isNull(), NO_PHASE).when(~F.coalesce("new_task", F.lit(False)), BAD_TASK).when(~F.coalesce(within(F.col("due_date"), F.col("_keyed")), F.lit(False)), BAD_DATE)
    delete = F.when(F.col("_task").isNull(), NO_TASK).when(F.col("_task.mandatory"), MUST_STAY)

    def wrong(item: Column) -> Column:
        early = (F.col("time_model") == "submission_deadline") & (item["phase"] == "defense_prep") & (item["start"] <= F.col("target_date"))
        off = (F.col("time_model") == "competition_window") & (item["phase"] == "event_sprint") & (item["start"] != F.col("target_date"))
        missing = ~F.array_contains(F.coalesce("_keys", F.array().cast("array<string>")), item["phase"])
        bad = (item["start"] < today) | (item["start"] > item["end"]) | F.coalesce(early, F.lit(False)) | F.coalesce(off, F.lit(False))
        return F.when(missing, NO_PHASE).when(bad, BAD_SCHEDULE)

    first = F.get(F.filter(F.transform("schedule", wrong), lambda x: x.isNotNull()), F.lit(0))
    some = F.coalesce(F.size("schedule"), F.lit(0)) > 0
    reschedule = F.when(~some, BAD_SCHEDULE).otherwise(F.coalesce(first, F.when(~F.coalesce("valid", F.lit(False)), BAD_SCHEDULE)))
    advice = F.when(F.coalesce(F.trim("advice"), F.lit("")) == "", NO_ADVICE)
    kind = F.col("type")
    reason = (
        F.when((kind != "append_advice") & (F.coalesce("n_sources", F.lit(0)) == 0), NO_SOURCE)
        .when(kind == "move_task", move).when(kind == "add_task", add).when(kind == "delete_task", delete).when(kind == "reschedule_phase", reschedule).when(kind == "append_advice", advice).otherwise(NO_SOURCE)
    )
    before = F.col("status") == "rejected"
    code = F.when(F.coalesce(before, F.lit(False)), F.col("code")).otherwise(reason)
    return rows.select("card_id", F.when(F.coalesce(before, F.lit(False)) | reason.isNotNull(), "rejected").otherwise("passed").alias("status"), code.alias("code"))
