"""Orphan references against a definition by loops, and their edge cases."""

import random
from datetime import datetime, timedelta

from conftest import BENCHMARK, OSM, rows_of

from terramill.operators import orphans

DAY = datetime(2024, 1, 1)


def holds(osm, poi, at):
    return any(r["poi_id"] == poi and r["loaded_at"] is not None and at is not None and r["loaded_at"] <= at and (r.get("deleted_at") is None or at < r["deleted_at"]) for r in osm)


def test_equals_definition(tables):
    rng = random.Random(1)
    osm = []
    for poi in range(100, 700):
        if poi % 37:
            start = DAY + timedelta(days=rng.choice([-100, -100, -100, rng.randint(0, 60)]))
            osm.append({"poi_id": poi, "loaded_at": start, "deleted_at": rng.choice([None, None, start + timedelta(days=rng.randint(1, 80))])})
            if rng.random() < 0.1:
                osm.append({"poi_id": poi, "loaded_at": start + timedelta(days=90), "deleted_at": None})
    osm += osm[:50] + [{"poi_id": None, "loaded_at": DAY}, {"poi_id": 90, "loaded_at": None}]
    asked = [
        {"question_id": q, "anchor_index": rng.choice([None, rng.randint(90, 710)]), "results_poi_id": rng.choice([None, [], [rng.randint(90, 710) for _ in range(4)] + [None]]), "created_at": DAY + timedelta(days=rng.randint(0, 60), hours=rng.randint(0, 23))}
        for q in range(300)
    ]
    asked += asked[:30]
    expected = set()
    for r in asked:
        for field, ids in (("anchor_index", [r["anchor_index"]]), ("results_poi_id", r["results_poi_id"] or [])):
            expected |= {(r["question_id"], field, i) for i in ids if i is not None and not holds(osm, i, r["created_at"])}
    found = orphans.orphans_found(tables.make(BENCHMARK, asked, True), tables.make(OSM, osm, True))
    assert rows_of(found.select("question_id", "field", "poi_id")) == sorted(expected)
    report = orphans.orphans_report(found)
    assert sum(r["n_orphans"] for r in report.collect()) == len(expected)


def test_runs_are_contiguous_and_bounded(tables):
    osm = tables.make(OSM, [{"poi_id": i, "loaded_at": DAY} for i in [*range(0, 600), *range(700, 710)]])
    valid = orphans.validity(osm, "poi_id", "loaded_at", "deleted_at", orphans_micros(DAY), orphans_micros(DAY) + 1)
    got = rows_of(orphans.runs(valid).select("run_start", "run_end"))
    assert got == [(0, 255), (256, 511), (512, 599), (700, 709)]


def orphans_micros(at):
    return int((at - datetime(1970, 1, 1)).total_seconds() * 1e6)


def test_interval_ends_and_empty_tables(tables):
    osm = [{"poi_id": 1, "loaded_at": DAY, "deleted_at": DAY + timedelta(days=1)}, {"poi_id": 1, "loaded_at": DAY + timedelta(days=2)}]
    asked = [{"question_id": i, "anchor_index": 1, "created_at": DAY + timedelta(days=i)} for i in (-1, 0, 1, 2)] + [{"question_id": 9, "anchor_index": 1}]
    found = orphans.orphans_found(tables.make(BENCHMARK, asked), tables.make(OSM, osm))
    assert [r[0] for r in rows_of(found.select("question_id"))] == [-1, 1, 9]
    assert orphans.orphans_found(tables.make(BENCHMARK), tables.make(OSM, osm)).count() == 0
    assert orphans.orphans_found(tables.make(BENCHMARK, asked), tables.make(OSM)).count() == 5
