"""Windows that end at each row's own time, against pandas loops."""
import datetime as dt
import math
import random

from tabloom.operators.rolling import recent_against_year, trailing_sums

START = dt.datetime(2023, 1, 1)


def brute(refs, events, spans):
    out = []
    for i, k, t in refs:
        hits = {n: [v for q, e, v in events if v is not None and k is not None and t is not None and q == k and e is not None
                    and t - dt.timedelta(days=d) <= e <= t] for n, d in spans.items()}
        out.append((i, *[round(math.fsum(h), 4) for h in hits.values()], *[len(h) for h in hits.values()]))
    return sorted(out)


def test_hot_key_ties_and_missing_values(spark):
    r = random.Random(3)

    def when():
        return START + dt.timedelta(days=r.randrange(500), hours=r.choice([0, 0, 6, 13]))
    events = [(7 if r.random() < 0.4 else r.randrange(20), when(), r.choice([None, 1.5, -2.25, 1e9 + 0.01])) for _ in range(600)]
    events += [(None, when(), 1.0), (7, None, 1.0)]
    refs = [(i, 7 if r.random() < 0.4 else r.randrange(25), when()) for i in range(200)] + [(900, None, when()), (901, 7, None)]
    refs += [(i + 1000, k, e) for i, (k, e, _) in enumerate(events[:50])]
    ev = spark.createDataFrame(events, "k long, at timestamp, v double")
    rf = spark.createDataFrame(refs, "id long, k long, ref timestamp")
    spans = {"d30": 30, "d365": 365, "d1": 1}
    for seconds in (3600, 86400 * 40):
        got = trailing_sums(rf, ev, "k", "id", "ref", "at", "v", spans, seconds)
        assert sorted((x["id"], *[round(x[n], 4) for n in spans], *[x[f"{n}_n"] for n in spans]) for x in got.collect()) == brute(refs, events, spans)


def test_recent_against_year_and_no_events(spark):
    ev = spark.createDataFrame([(1, START, 10.0), (1, START + dt.timedelta(days=100), 5.0)], "k long, at timestamp, v double")
    rf = spark.createDataFrame([(1, 1, START + dt.timedelta(days=110)), (2, 2, START)], "id long, k long, ref timestamp")
    got = {r["id"]: r for r in recent_against_year(rf, ev, "k", "id", "ref", "at", "v").collect()}
    assert got[1]["recent"] == 5.0 and got[1]["recent_n"] == 1 and abs(got[1]["yearly_mean"] - 15 * 30 / 365) < 1e-12
    assert abs(got[1]["recent_ratio"] - 5 / (15 * 30 / 365)) < 1e-12
    assert tuple(got[2])[1:] == (0.0, 0, 0.0, None)
    assert [tuple(r)[1:3] for r in recent_against_year(rf, ev.limit(0), "k", "id", "ref", "at", "v").collect()] == [(0.0, 0)] * 2
