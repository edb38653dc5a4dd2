"""Finds of persons: rounds over all finds against a plain replay."""

import random

import pytest

from siltstone.operators import crawl

SCHEMA = "row long, unit long, name_key string, email string, homepage string, link string"


def plain(finds):
    names, owner, people, out = {}, {}, {}, {}
    for row, unit, name, *values in sorted(finds):
        mine = {c: v for c, v in zip(crawl.CONTACTS, values, strict=True) if v}
        found = [names.get((unit, name)) if name is not None else None] + [owner.get(x) for x in mine.items()]
        person = next((p for p in found if p is not None), row)
        own = people.setdefault(person, {"name": name})
        names.setdefault((unit, own["name"]), person)
        for c, v in mine.items():
            if own.setdefault(c, v) == v:
                owner[c, v] = min(person, owner.get((c, v), person))
        out[row] = person
    return out


def finds(seed, n, names, values, units):
    rng = random.Random(seed)
    some = lambda p: rng.choice((None, None, "", f"{p}{rng.randrange(values)}"))
    return [(r, rng.choice((None, *range(units))), rng.choice((None, *(f"n{rng.randrange(names)}" for _ in range(9)))), some("m"), some("h"), some("l")) for r in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize(("seed", "names", "values", "units"), [(1, 40, 12, 3), (2, 300, 60, 2), (3, 400, 400, 1)])
def test_rounds_give_what_the_replay_gives(spark, seed, names, values, units):
    rows = finds(seed, 400, names, values, units)
    want = plain(rows)
    table = spark.createDataFrame(rows, SCHEMA)
    assert {r.row: r.person for r in crawl.save_people(table, 20).collect()} == want and 5 < len(set(want.values())) < 395
    assert {r.row: r.person for r in crawl.save_people(table).collect()} == want


def test_no_task_replays_more_than_the_head(spark, monkeypatch):
    seen, replay = [], crawl._replayed
    monkeypatch.setattr(crawl, "_replayed", lambda df: seen.append(df.count()) or replay(df))
    rows = [(r, 0, f"n{r}", "m", None, None) for r in range(200)]
    assert {r.person for r in crawl.save_people(spark.createDataFrame(rows, SCHEMA), 50).collect()} == {0} and seen == [50]


def test_a_chain_of_finds_is_followed_to_its_end(spark):
    """Every find waits for the one before it: its person is whom that one gave its value to."""
    rows = [(0, 0, "a", "m0", None, None)]
    for i in range(1, 8):
        rows += [(2 * i - 1, i, f"b{i}", f"m{i - 1}", f"h{i}", None), (2 * i, i, f"c{i}", f"m{i}", f"h{i}", None)]
    assert {r.row: r.person for r in crawl.save_people(spark.createDataFrame(rows, SCHEMA), 1).collect()} == plain(rows)


def test_a_unit_that_a_person_joined_by_a_value_knows_its_name(spark):
    rows = [(1, 0, "a", "m", None, None), (2, 1, "b", "m", None, None), (3, 1, "a", None, None, None)]
    for head in (1, 100):
        assert {r.row: r.person for r in crawl.save_people(spark.createDataFrame(rows, SCHEMA), head).collect()} == plain(rows) == {1: 1, 2: 1, 3: 1}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Finds that change something are replayed by themselves: a chain of forty behind the head is not followed a find a round."""
    rounds, learned = [], crawl._learned
    monkeypatch.setattr(crawl, "_learned", lambda people: rounds.append(1) or learned(people))
    rows = [(r, 0, "f", "z", None, None) for r in range(60)] + [(60, 0, "a", "m0", None, None)]
    for i in range(1, 21):
        rows += [(2 * i + 59, i, f"b{i}", f"m{i - 1}", f"h{i}", None), (2 * i + 60, i, f"c{i}", f"m{i}", f"h{i}", None)]
    assert {r.row: r.person for r in crawl.save_people(spark.createDataFrame(rows, SCHEMA), 60).collect()} == plain(rows) and len(rounds) <= 4


def test_later_finds_of_their_own_name_are_left_out(spark, monkeypatch):
    """Once all values have owners, finds that come to a later person of their own name change nothing; the rows are the replay's all the same."""
    live, settled = [], crawl._live
    monkeypatch.setattr(crawl, "_live", lambda *a: live.append(settled(*a)) or live[-1])
    rng = random.Random(4)
    rows = [(r, r % 2, f"n{rng.randrange(120)}", f"m{r % 5}" if r % 4 == 0 else None, f"h{r % 7}" if r % 3 == 0 else None, None) for r in range(1500)]
    assert {r.row: r.person for r in crawl.save_people(spark.createDataFrame(rows, SCHEMA), 300).collect()} == plain(rows)
    assert 300 < live[0][1].count() < sum(r[3] is not None or r[4] is not None for r in rows)
