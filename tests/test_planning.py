import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from siltstone.operators import planning

DAY = date(2026, 3, 1)


def shared(start, end, weights):
    """Days of phases, one phase after another; none if there are too few."""
    total, at, out = (end - start).days + 1, start, []
    if total < len(weights):
        return []
    left = total
    for i, w in enumerate(weights):
        behind = len(weights) - i - 1
        days = left if not behind else min(max(1, round(total * w / sum(weights))), left - behind)
        out.append((i, at, at + timedelta(days - 1)))
        at, left = at + timedelta(days), left - days
    return out


def test_days_are_shared_out_as_one_after_another(spark):
    draw, rows, want = random.Random(4), [], set()
    for plan in range(300):
        end = DAY + timedelta(draw.randrange(0, 40))
        weights = [draw.choice([1.0, 1.0, 2.0, 0.5, 10.0, 0.01]) for _ in range(draw.randrange(1, 8))]
        rows += [(plan, i, w, DAY, end) for i, w in enumerate(weights)]
        want |= {(plan, *x) for x in shared(DAY, end, weights)}
    got = planning.allocate(spark.createDataFrame(rows, "plan_id int, ordinal int, weight double, start_date date, end_date date"))
    assert {tuple(r) for r in got.collect()} == want


def test_levels(spark):
    df = spark.createDataFrame([("多次获奖，复现论文", None, None), ("参加过 课程", False, None), ("nothing", True, True), (None, None, None), ("ADVANCED 项目", True, None), ("一次", None, None)], "t string, a boolean, p boolean")
    got = [r[0] for r in df.select(planning.preparation_level(F.col("t"), F.col("a"), F.col("p"))).collect()]
    assert got == ["experienced", "intermediate", "intermediate", "beginner", "experienced", "beginner"]


def test_tasks_get_places_in_order(spark):
    draw, rows, want = random.Random(6), [], set()
    levels = ["beginner", "intermediate", "experienced", None]
    for plan in range(60):
        used, level, budget = 0.0, draw.choice(levels), draw.choice([0.0, 5.0, 12.0, None])
        for n in range(12):
            start = DAY + timedelta(draw.randrange(5))
            end = start + timedelta(draw.randrange(3))
            blocked = [DAY + timedelta(i) for i in range(8) if draw.random() < 0.5]
            required, hours, least = draw.choice([True, False, False]), float(draw.randrange(6)), draw.choice(levels)
            rows.append((plan, n, required, hours, level, least, start, end, blocked, budget))
            place = planning.EXPERIENCE
            if place.get(level, 0) < place.get(least, 0):
                continue
            due = max((start + timedelta(i) for i in range((end - start).days + 1) if start + timedelta(i) not in blocked), default=None)
            if required:
                outcome = "impossible" if due is None else "required"
            elif due is None or used + hours > (budget or 0.0):
                outcome = "dropped"
            else:
                outcome, used = "optional", used + hours
            want.add((plan, n, outcome, due if outcome in ("required", "optional") else None))
    schema = "plan_id int, ordinal int, required boolean, hours double, level string, least string, start date, end date, blocked array<date>, budget double"
    got = planning.schedule_tasks(spark.createDataFrame(rows, schema).repartition(5))
    assert {tuple(r) for r in got.collect()} == want
