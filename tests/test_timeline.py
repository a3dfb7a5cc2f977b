import datetime as dt
import random

from claimsweep.operators.tasks import event_timeline


def test_a_task_of_one_day_is_numbered_by_many_parts(spark):
    r = random.Random(1)
    start = dt.datetime(2026, 1, 5)
    rows = [("hot", i, start + dt.timedelta(seconds=r.randrange(20000)), "view", "x") for i in range(4000)]
    rows += [(f"t{i % 7}", 5000 + i, start + dt.timedelta(days=r.randrange(30)), "click", "y") for i in range(300)]
    r.shuffle(rows)
    events = spark.createDataFrame(rows, "task_id string, event_id long, created_at timestamp_ntz, event_type string, part string")
    got = {x["event_id"]: (x["position"], x["previous_at"]) for x in event_timeline(events).collect()}
    for task in {x[0] for x in rows}:
        own, before = sorted((x[2], x[1]) for x in rows if x[0] == task), None
        for n, (when, event) in enumerate(own):
            assert got[event] == (n + 1, before)
            before = when
    assert len(got) == len(rows) and event_timeline(events.limit(0)).count() == 0
