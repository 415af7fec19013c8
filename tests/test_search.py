"""The ranked search under outliers, crowds and equal questions."""

import math
import random

from pyspark.sql import functions as F

from terramill.operators import relations, search

def candidates(spark, places, asked, k=10):
    """Pairs that the first round of a search looks at."""
    scratch = search.Scratch(spark, "test")
    held = scratch.cut(search.located(places), "places")
    box = held.agg(*[f(c) for c in ("x", "y") for f in (F.min, F.max)]).first()
    ids = scratch.cut(asked.withColumn("asked_id", F.col("question_id")), "asked")
    first = search.first_radius(ids, held, k, tuple(box)).withColumn("reach", F.col("radius"))
    assert first.where("radius IS NULL").isEmpty()
    return search.meet(search.ringed(first), held, search.ring_levels(first)).count()


def test_an_outlier_or_a_crowd_changes_no_other_search(spark):
    draw = random.Random(5)
    spread = [(i, f"c{i % 4}", draw.uniform(0, 60000), draw.uniform(0, 60000)) for i in range(5000)]
    asked = spark.createDataFrame([(i, f"c{i % 4}", draw.uniform(0, 60000), draw.uniform(0, 60000), -1) for i in range(200)], "question_id long, category string, x double, y double, anchor_index long")
    table = lambda rows: spark.createDataFrame(rows, "poi_id long, category string, x double, y double")
    plain = candidates(spark, table(spread), asked)
    assert plain < 200 * 10 * 12
    stray = [*spread, (9000, "c0", 1e7, 1e7), (9001, "c1", -3e6, 2e6)]
    crowd = [*spread, *((10000 + i, "c0", 61000.0 + i % 50, 61000.0 + i % 50) for i in range(5000))]
    assert candidates(spark, table(stray), asked) <= 2 * plain
    assert candidates(spark, table(crowd), asked) <= 2 * plain
    got = {(r["question_id"], r["rank"]): r["poi_id"] for r in relations.near(asked, table(stray), 10).collect()}
    for q in asked.collect():
        best = sorted((math.hypot(x - q["x"], y - q["y"]), i) for i, c, x, y in stray if c == q["category"])[:10]
        assert [got[q["question_id"], n + 1] for n in range(10)] == [i for _, i in best]


def test_equal_questions_and_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(search, "CROWD", 5)
    places = spark.createDataFrame([(i, "c", float(i), 0.0) for i in range(60)], "poi_id long, category string, x double, y double")
    asked = spark.createDataFrame([(i, "c", 10.2 if i < 40 else 10.0 + i / 100, 0.0, None) for i in range(80)], "question_id long, category string, x double, y double, anchor_index long")
    rows = relations.near(asked, places, 3).collect()
    assert len(rows) == 240 and all({r["poi_id"] for r in rows if r["question_id"] == i} == {10, 11, 9} for i in range(40))


def test_cells_of_a_segment_are_those_it_touches(spark):
    rows = [(0.0, 0.0, 1000.0, 900.0), (5.0, 900.0, 5.0, -300.0), (0.0, 7.0, 800.0, 7.0), (3.0, 3.0, 3.0, 3.0)]
    segments = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, ax double, ay double, bx double, by double")
    got = {}
    for r in relations._cells_of(segments, 100, 20.0).collect():
        got.setdefault(r["i"], set()).add((r["cx"], r["cy"]))
    draw = random.Random(1)
    for i, (ax, ay, bx, by) in enumerate(rows):
        for _ in range(400):
            t, dx, dy = draw.random(), draw.uniform(-20, 20), draw.uniform(-20, 20)
            assert (math.floor((ax + t * (bx - ax) + dx) / 100), math.floor((ay + t * (by - ay) + dy) / 100)) in got[i]
    assert len(got[0]) < 50  # of the 110 in its box
