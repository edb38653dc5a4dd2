import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from siltstone.operators import planning

TODAY = date(2026, 3, 1)


def plain(card, plans, phases, tasks):
    """One card by the rules, one after another."""
    if card["status"] == "rejected":
        return "rejected", card["code"]
    code = reason(card, plans.get(card["plan_id"]), [p for p in phases if p["plan_id"] == card["plan_id"]], [t for t in tasks if t["plan_id"] == card["plan_id"]])
    return ("rejected" if code else "passed"), code


def reason(card, plan, phases, tasks):
    kind = card["type"]
    if kind != "append_advice" and not card["n_sources"]:
        return planning.NO_SOURCE
    keyed, ided = {p["phase_key"]: p for p in sorted(phases, key=lambda p: p["phase_id"])}, {p["phase_id"]: p for p in phases}
    task = next((t for t in tasks if t["task_id"] == card["target_task"]), None)
    inside = lambda day, p: day >= TODAY and p["start"] <= day <= p["end"]
    if kind == "move_task":
        phase = (keyed.get(card["target_phase"]) if card["target_phase"] else ided.get(task["phase_id"])) if task else None
        return planning.NO_TASK if task is None else planning.BAD_DATE if card["new_date"] is None else planning.NO_PHASE if phase is None else None if inside(card["new_date"], phase) else planning.BAD_DATE
    if kind == "add_task":
        phase = keyed.get(card["target_phase"])
        return planning.NO_PHASE if phase is None else planning.BAD_TASK if not card["new_task"] else None if inside(card["due_date"], phase) else planning.BAD_DATE
    if kind == "delete_task":
        return planning.NO_TASK if task is None else planning.MUST_STAY if task["mandatory"] else None
    if kind == "reschedule_phase":
        if not card["schedule"]:
            return planning.BAD_SCHEDULE
        for key, start, end in card["schedule"]:
            if key not in keyed:
                return planning.NO_PHASE
            if start < TODAY or start > end:
                return planning.BAD_SCHEDULE
            if plan["time_model"] == "submission_deadline" and key == "defense_prep" and plan["target_date"] and start <= plan["target_date"]:
                return planning.BAD_SCHEDULE
            if plan["time_model"] == "competition_window" and key == "event_sprint" and plan["target_date"] and start != plan["target_date"]:
                return planning.BAD_SCHEDULE
        return None if plan["valid"] else planning.BAD_SCHEDULE
    if kind == "append_advice":
        return None if card["advice"] and card["advice"].strip() else planning.NO_ADVICE
    return planning.NO_SOURCE


def test_cards_one_by_one(spark):
    draw = random.Random(9)
    day = lambda: TODAY + timedelta(draw.randrange(-5, 40))
    keys = ["warm_up", "event_sprint", "defense_prep"]
    plans = [{"plan_id": i, "time_model": draw.choice(["submission_deadline", "competition_window", None]), "target_date": draw.choice([None, TODAY + timedelta(10)]), "valid": draw.random() < 0.8} for i in range(12)]
    phases, tasks = [], []
    for p in plans:
        for n, k in enumerate(keys[: draw.randrange(1, 4)]):
            start = day()
            phases.append({"plan_id": p["plan_id"], "phase_id": f"f{n}", "phase_key": k, "start": start, "end": start + timedelta(draw.randrange(15))})
        tasks += [{"plan_id": p["plan_id"], "task_id": f"t{n}", "phase_id": f"f{draw.randrange(3)}", "mandatory": draw.random() < 0.5} for n in range(4)]
    cards = []
    for i in range(900):
        span = [(draw.choice([*keys, "other"]), (s := day()), s + timedelta(draw.randrange(-1, 9))) for _ in range(draw.randrange(3))]
        cards.append({
            "card_id": i, "plan_id": draw.randrange(12), "type": draw.choice(["move_task", "add_task", "delete_task", "reschedule_phase", "append_advice", "other"]), "status": draw.choice(["pending", "pending", "rejected", None]), "code": "before", "n_sources": draw.choice([0, 1, 2, 3]),
            "target_task": draw.choice([None, "t0", "t1", "t9"]), "target_phase": draw.choice([None, "", *keys]), "new_date": draw.choice([None, day(), day()]), "new_task": draw.choice([True, True, False, None]), "due_date": day(), "schedule": draw.choice([span, span, None]), "advice": draw.choice([None, " ", "do this"]),
        })
    card = "card_id int, plan_id int, type string, status string, code string, n_sources int, target_task string, target_phase string, new_date date, new_task boolean, due_date date, schedule array<struct<phase:string,start:date,end:date>>, advice string"
    out = planning.change_cards(
        spark.createDataFrame([tuple(c.values()) for c in cards], card), spark.createDataFrame([tuple(p.values()) for p in plans], "plan_id int, time_model string, target_date date, valid boolean"),
        spark.createDataFrame([tuple(p.values()) for p in phases], "plan_id int, phase_id string, phase_key string, start date, end date"), spark.createDataFrame([tuple(t.values()) for t in tasks], "plan_id int, task_id string, phase_id string, mandatory boolean"), F.lit(TODAY),
    )
    got = {r.card_id: (r.status, r.code) for r in out.collect()}
    by_id = {p["plan_id"]: p for p in plans}
    assert got == {c["card_id"]: plain(c, by_id, phases, tasks) for c in cards}
    assert {c for _, c in got.values()} >= {None, planning.NO_TASK, planning.NO_PHASE, planning.BAD_DATE, planning.BAD_TASK, planning.MUST_STAY, planning.BAD_SCHEDULE, planning.NO_ADVICE, planning.NO_SOURCE, "before"}
