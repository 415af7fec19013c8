"""Ties, and plans whose work follows the rows and not their pairs."""

import hashlib
import math

from pyspark.sql import functions as F

from terramill.operators import relations, sampling, search, semantic, validate


def test_correlation_of_equal_coordinates_is_null(spark):
    rows = [(1, 0, 5.0), (1, 1, 5.0), (1, 2, 5.0), (2, 0, 9.0), (2, 1, 7.0), (3, 0, 1.0), (4, 0, 1.0), (4, 1, 2.0), (4, 2, 2.0)]
    answers = spark.createDataFrame(rows, "question_id long, rank long, coordinate double")
    got = {r["question_id"]: (r["n"], r["rho"] and round(r["rho"], 6)) for r in validate.direction_correlation(answers, ["question_id"]).collect()}
    assert got == {1: (3, None), 2: (2, 1.0), 3: (1, None), 4: (3, -0.866025)}


def test_search_broadcasts_no_rows_repeated_for_levels(spark):
    places = spark.range(400).selectExpr("id AS poi_id", "'c' AS category", "double(id * 37 % 5000) AS x", "double(id * 91 % 5000) AS y")
    asked = spark.range(3000).selectExpr("id AS question_id", "'c' AS category", "double(id % 5000) AS x", "double(id * 7 % 5000) AS y", "id AS anchor_index", "'east' AS direction")
    scratch = search.Scratch(spark, "test")
    held, ids = scratch.cut(places, "places"), scratch.cut(asked.withColumnRenamed("question_id", "asked_id"), "asked")
    first = search.first_radius(ids, held, 10, (0.0, 5000.0, 0.0, 5000.0))
    plans = [first, search._met(first.withColumn("reach", F.col("radius")), held, scratch, "0", 3000)]
    for plan, joined in zip(plans, ("level", "cx")):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in text.split("\n") if "BroadcastHashJoin [" in line and joined in line.split("]")[0]], text
    small = [r for r in places.collect()]
    got = {}
    for r in relations.near_cardinal(asked.where("question_id < 2500"), places, 5).collect():
        got.setdefault(r["question_id"], []).append((r["rank"], r["poi_id"]))
    for q in asked.where("question_id < 50").collect():
        fits = sorted((math.hypot(p["x"] - q["x"], p["y"] - q["y"]), p["poi_id"]) for p in small if p["poi_id"] != q["anchor_index"] and abs((math.degrees(math.atan2(p["x"] - q["x"], p["y"] - q["y"])) - 90 + 540) % 360 - 180) <= 70)
        assert [i for _, i in sorted(got.get(q["question_id"], []))] == [i for _, i in fits[:5]]


def most_rows(plan):
    """The most rows that a node of an executed plan gave."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return most_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return most_rows(plan.plan())
    metric, children = plan.metrics().get("numOutputRows"), plan.children()
    return max([metric.get().value() if metric.isDefined() else 0, *(most_rows(children.apply(i)) for i in range(children.size()))])


def test_redrawn_answers_list_no_pairs_of_batches_and_places(spark):
    truth = spark.range(400).selectExpr("array('category bar') AS question", "id AS poi_id")
    batches = spark.range(300).selectExpr("id AS batch_id", "array(array('category bar'), array('category bar', null), array('none')) AS questions", "array(id, id + 1000, id + 1000, null, 7) AS poi_ids")
    rows = semantic.redraw_answers(batches, truth, 3)
    got = {r["batch_id"]: r["poi_ids"] for r in rows.collect()}
    qid = hashlib.md5(b"category bar").hexdigest()
    first = sorted(sorted(range(400), key=lambda i: hashlib.md5(f"42:{qid}:{i}".encode()).hexdigest())[:3])
    assert got == {i: [*first, i + 1000] for i in range(300)}
    assert most_rows(rows._jdf.queryExecution().executedPlan()) < 20 * 300


def test_only_strata_that_lack_questions_go_deeper_and_see_no_candidate_twice(spark):
    every = spark.range(3000).selectExpr("int(id % 3) AS stratum", "int(id / 3) + 1 AS place", "id AS question_id").cache()
    seen = []

    def answer(rows):
        seen.extend((r["stratum"], r["question_id"]) for r in rows.collect())
        return rows.where("stratum < 2 OR place IN (700, 900)").select("question_id")

    chosen, answers = sampling.first_answered(search.Scratch(spark, "test"), [(0, 1.0), (1, 1.0), (2, 1.0)], 9, lambda depth: every.where(F.col("place") <= depth), answer, ["question_id"])
    assert sorted((r["stratum"], r["question_id"] // 3 + 1) for r in chosen.collect()) == [*((0, i) for i in range(1, 5)), *((1, i) for i in range(1, 4)), (2, 700), (2, 900)]
    assert len(seen) == len(set(seen)) and len([s for s, _ in seen if s < 2]) < 200
    assert answers.count() == len([s for s, _ in seen if s < 2]) + 2
