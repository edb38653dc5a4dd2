import random
from datetime import UTC, datetime

import pytest

from siltstone.streaming import queue as queues

COMMANDS = "queue long, at timestamp, seq long, kind string, item string, number double"


def replayed(commands, most=3, base=30.0, cap=3600.0, lease=600.0, retry_first=False):
    """Every queue by looking at all its items at every moment at which something can happen."""
    out = []
    for q in sorted({c[0] for c in commands}):
        items, said = {}, []
        own = sorted((c for c in commands if c[0] == q), key=lambda c: (c[1], c[2]))

        def put_back(at, i, items=items, said=said):
            x = items[i]
            x["state"], x["due"] = ("retry" if x["n"] < most else "failed"), None
            said.append((at, i, x["state"], x["n"], None, "interrupted_run_reset"))

        for _, at, _, kind, item, number in own:
            while over := sorted((x["due"], i) for i, x in items.items() if x["due"] is not None and x["due"] <= at):
                time, i = over[0]
                if items[i]["state"] == "in_progress":
                    put_back(time, i)
                else:
                    items[i]["due"] = None
                    said.append((time, i, items[i]["state"], items[i]["n"], None, "due"))
            x = items.get(item)
            if kind == "add" and x is None:
                items[item] = {"state": "pending", "n": 0, "p": number or 0.0, "due": None}
                said.append((at, item, "pending", 0, None, "added"))
            elif kind == "add":
                x["p"] = max(x["p"], number or 0.0)
            elif kind == "claim":
                for _ in range(1 if number is None else int(number)):
                    free = [(i, x) for i, x in items.items() if x["state"] in ("pending", "retry") and x["due"] is None and x["n"] < most]
                    if free:
                        i, x = min(free, key=lambda f: (f[1]["state"] != "retry", f[0]) if retry_first else (-f[1]["p"], f[0]))
                        x.update(state="in_progress", n=x["n"] + 1, due=at + lease)
                        said.append((at, i, "in_progress", x["n"], None, "claimed"))
            elif kind == "reset":
                for i in sorted(i for i, x in items.items() if x["state"] == "in_progress"):
                    put_back(at, i)
            elif x is not None and x["state"] == "in_progress":
                x["due"] = None
                if kind == "error" and x["n"] < most:
                    x["state"], x["due"] = "retry", at + min(base * 2 ** (x["n"] - 1), cap)
                else:
                    x["state"] = {"ok": "done", "skip": "skipped", "error": "failed"}[kind]
                said.append((at, item, x["state"], x["n"], x["due"], kind))
        out += [(q, *s) for s in said]
    return out


def drawn(seed, n, queue_count=3, items=12):
    draw, at, out = random.Random(seed), 1_000_000.0, []
    for seq in range(n):
        at += draw.choice([0, 1, 5, 40, 200])
        kind = draw.choices(["add", "claim", "ok", "error", "skip", "reset"], [4, 5, 2, 4, 1, 0.3])[0]
        item = None if kind in ("claim", "reset") else f"i{draw.randrange(items):02}"
        number = draw.choice([1, 2, 5, None]) if kind == "claim" else float(draw.randrange(4)) if kind == "add" else None
        out.append((draw.randrange(queue_count), at, seq, kind, item, None if number is None else float(number)))
    return out


def stamped(commands):
    return [(q, datetime.fromtimestamp(at, UTC).replace(tzinfo=None), seq, *rest) for q, at, seq, *rest in commands]


def told(rows):
    second = lambda x: None if x is None else x.replace(tzinfo=UTC).timestamp()
    return sorted(map(repr, ((r.queue, second(r.at), r.item, r.state, r.attempts, second(r.next_retry_at), r.reason) for r in rows)))


class Kept(dict):
    put = dict.__setitem__

    def all(self):
        return iter(self.items())


@pytest.mark.parametrize("retry_first", [False, True])
@pytest.mark.parametrize("size", [1, 3, 1000])
def test_rules_against_a_replay(retry_first, size):
    """However small the head that stands beside the items, the same changes in the same order."""
    for seed in range(20):
        commands = drawn(seed, 400, 1, items=25)
        queue = queues.Queue(Kept(), retry_first=retry_first, size=size, lease=150.0)
        for _, at, _, kind, item, number in commands:
            queue.apply(at, kind, item, number)
        assert [(0, *x) for x in queue.out] == replayed(commands, lease=150.0, retry_first=retry_first)


def test_a_table_of_commands(spark):
    commands = drawn(3, 1500)
    odd = [(None, 1.0, 1, "add", "x", 1.0), (1, 1.0, 1, None, "x", 1.0), (1, 1.0, 1, "ok", None, None)]
    df = spark.createDataFrame(stamped(commands) + stamped(odd), COMMANDS).repartition(7)
    assert told(queues.changes(df).collect()) == sorted(map(repr, replayed(commands)))
    assert queues.changes(df.limit(0)).collect() == []


def test_a_stream_in_batches_with_timers_and_a_restart(spark, tmp_path):
    """The same changes whatever the batches, over a restart; what comes due without a command is said by timers."""
    commands = drawn(8, 240, 2)
    last = commands[-1][1]
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))

    def put(part):
        spark.createDataFrame(stamped(part), COMMANDS).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(COMMANDS).parquet(source)
        query = queues.changes(stream, lease=150.0).writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode("append").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    put(commands[:90])
    run()
    put(commands[90:100])
    run()
    # long after all others: their leases and waits end before it, whether a row of that queue comes or not
    ends = [(7, last + 100_000.0, 10_000, "claim", None, 1.0)]
    put(commands[100:] + ends)
    run()
    put([(7, last + 200_000.0, 10_001, "claim", None, 1.0)])
    run()
    tail = [(q, last + 100_000.0, 10_000, "claim", None, 0.5) for q in (0, 1)]  # claims nothing, but lets things come due
    want = sorted(map(repr, replayed(commands + tail, lease=150.0)))
    assert told(spark.read.parquet(out).collect()) == want and sum("'due'" in w or "interrupted" in w for w in want) > 10
