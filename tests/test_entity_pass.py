"""One pass over entities against the operators that look at each of their days."""

import random
from datetime import date, timedelta

from tests.helpers import cube, records
from tidemeter.operators import entities as en
from tidemeter.operators import sequence as sq
from tidemeter.operators import turns as tn


def _rows():
    rng = random.Random(5)
    day = lambda: str(date(2026, 3, 1) + timedelta(days=rng.randrange(40)))
    return [{"day": day(), "hour": rng.choice([None, 3, 9]), "total": rng.choice([0, 0, 5, 7, 40]), "project": f"p{rng.randrange(4)}",
             "session": rng.choice([None, "", "hot", "hot", *(f"s{rng.randrange(30)}" for _ in range(4))])} for _ in range(300)]


def test_pass_agrees_with_entity_cubes(spark):
    rows = _rows()
    usage, rec = cube(spark, rows), records(spark, rows)
    days = {k: en.entity_cube(rec, k, ["day", "entity"]).cache() for k in ("project", "session")}
    done = {k: en.entity_pass(d).cache() for k, d in days.items()}
    plain = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert plain(sq.first_seen_from(usage, done["project"], done["session"])) == plain(sq.first_seen(usage, days["project"], days["session"]))
    assert plain(tn.running_max_from(usage, done["session"])) == plain(tn.running_max_turns(usage, days["session"]))
    assert plain(en.distribution_from(usage, done["project"], done["session"])) == plain(en.distribution(usage, days["project"], days["session"]))
    # Days up to one are what the range that ends there says.
    early = days["session"].where("day <= '2026-03-20'")
    part = "part = 'day' and day <= '2026-03-20'"
    assert plain(done["session"].where(part)) == plain(en.entity_pass(early).where(part))


def test_pass_keeps_no_entity_and_shuffles_once_by_it(spark):
    rec = records(spark, _rows())
    done = en.entity_pass(en.entity_cube(rec, "session", ["day", "entity"]))
    plan = done._jdf.queryExecution().executedPlan().toString()
    # Partial sums by day and entity, entities in order of their days, sums by day and by total.
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("hashpartitioning(entity#") == 1
    assert plan.count("Sort [entity#") == 1 and "SortAggregate" not in plan


def test_empty_entities(spark):
    usage = cube(spark, [{"day": "2026-03-01", "hour": 1, "total": 5}])
    none = en.entity_pass(en.entity_cube(records(spark, [{"day": "2026-03-01"}]), "session", ["day", "entity"]))
    (row,) = en.distribution_from(usage, none, none).collect()
    assert (row.sessions, row.projects, row.session_median) == (0, 0, None)
    assert [r.max_turns for r in tn.running_max_from(usage, none).collect()] == [0]
