"""Operators that once did a part of their job, against the whole of it."""

import hashlib
import random

import pandas as pd
from pyspark.sql import functions as F

from corvane.plans import experiments, sampling


def candidates(spark, records):
    """records: pool_no, id, variant, length of the question."""
    return spark.createDataFrame([(p, i, v, "问" * n) for p, i, v, n in records], "pool_no int, id string, variant string, query_original string")


def brute_match(records):
    out = []
    for pool in {r[0] for r in records}:
        free = {i: n for p, i, v, n in records if p == pool and v == "clean"}
        for i, n in sorted((i, n) for p, i, v, n in records if p == pool and v == "hard_negative"):
            if free:
                best = min(free, key=lambda k: (abs(free[k] - n), k))
                out.append((i, best, abs(free.pop(best) - n)))
    return sorted(out)


def test_controls_are_the_nearest_free_of_the_whole_pool(spark):
    r = random.Random(5)
    records = [(p, f"{p}-{k:03}", r.choice(["clean", "hard_negative"]), r.randrange(1, 60)) for p in (1, 2, 3) for k in r.sample(range(900), 80)] + [(4, "4-1", "hard_negative", 8), (4, "4-2", "clean", 40), (5, "5-1", "hard_negative", 8)]
    got = experiments.greedy_matched_controls(lambda name: candidates(spark, records).repartition(3))
    assert sorted(tuple(x) for x in got.select("id", "control", "distance").collect()) == brute_match(records)


def test_choices_in_small_and_large_pools():
    for seed in range(60):
        r = random.Random(seed)
        records = [(1, f"{k:03}", r.choice(["clean", "hard_negative", "hard_negative"][: 2 + seed % 2]), r.randrange(1, r.choice([3, 20, 90]))) for k in r.sample(range(999), r.randrange(90))]
        got = experiments.match_nearest(pd.DataFrame([x[1:] for x in records], columns=["id", "v", "n"]))
        assert sorted(got.itertuples(index=False, name=None)) == brute_match(records)


# --- folds and orders ------------------------------------------------------------------------------------------------
def test_the_fold_goes_on_over_days(spark):
    r = random.Random(4)
    events = [(k, f"2024-01-{1 + k // 7:02} 10:00:00", u, round(r.random() * 9, 2)) for k in range(60) for u in (1, 2) if r.random() < 0.8]
    df = spark.createDataFrame(events, "event_id long, ts string, user_id long, value double").withColumn("ts", F.to_timestamp("ts")).repartition(3)
    want = {}
    for user in (1, 2):
        acc = 0.0
        for _, ts, _, value in sorted((e for e in events if e[2] == user), reverse=True):
            acc = value + 0.95 * acc
            want[user, ts[:10]] = acc
    got = {(x.user_id, str(x.day)): x.advantage for x in sampling.gae_reverse_fold(lambda name: df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_shuffle_places_every_record(spark):
    df = candidates(spark, [(1, f"r{k}", "clean", 3) for k in range(500)]).repartition(3)
    order = sorted((f"r{k}" for k in range(500)), key=lambda i: hashlib.sha256(f"43\x00{i}".encode()).hexdigest())
    got = experiments.deterministic_shuffle(lambda name: df).orderBy("position").collect()
    assert [(x.id, x.position) for x in got] == [(i, k) for k, i in enumerate(order)]
    rest = experiments.deterministic_shuffle(lambda name: df, start=490).orderBy("position").collect()
    assert [(x.id, x.position) for x in rest] == [(i, k) for k, i in enumerate(order)][490:]
