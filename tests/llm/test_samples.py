"""Top N, quotas and stable samples."""

import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from conftest import BENCHMARK, CONFIG, OSM, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from terramill.llm import quota, stable, topn


def answers(n=500, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = rng.choice([0, 1, 3, 6])
        out.append({
            "question_id": i, "category_query": rng.choice(["cafe", "Café ", " CAFE", "ferry-terminal", None]), "anchor_index": rng.choice([1, 1, 1, 2, 3, None]),
            "results_poi_id": rng.choice([None, [rng.choice([None, *range(20)]) for _ in range(k)]]),
            "results_poi_dist": rng.choice([None, [rng.choice([None, float("nan"), -1.0, 0.0, -0.0, 5.0, 5.0, rng.random() * 9]) for _ in range(rng.choice([k, k, 2]))]]),
            "results_poi_rank": rng.choice([None, [rng.choice([None, 1, 2, 3]) for _ in range(k)]]),
        })
    return out + out[:50]


def fold(c):
    return c.strip().lower().replace("é", "e").replace("-", "_").replace(" ", "_")


def best(rows, n=5):
    groups = {}
    for r in rows:
        if None in (r["category_query"], r["anchor_index"], r["results_poi_id"], r["results_poi_dist"]):
            continue
        for i, p in enumerate(r["results_poi_id"]):
            d = r["results_poi_dist"][i] if i < len(r["results_poi_dist"]) else None
            k = r["results_poi_rank"][i] if r["results_poi_rank"] and i < len(r["results_poi_rank"]) else None
            if p is not None and d is not None and d == d and d >= 0:
                g = groups.setdefault((fold(r["category_query"]), r["anchor_index"]), {})
                g[p] = min(g.get(p, (9e9, 9e9)), (d, 9e9 if k is None else k))
    return sorted((*g, p) for g, items in groups.items() for _, p in sorted((v, p) for p, v in items.items())[:n])


def test_top_n(tables):
    rows = answers()
    assert rows_of(topn.topn_found(tables.make(BENCHMARK, rows, True))) == best(rows)
    assert topn.topn_found(tables.make(BENCHMARK)).count() == 0


def test_top_n_of_a_hundred_runs_merges_few_at_once(tables, monkeypatch):
    monkeypatch.setattr(topn, "RUN", 20)
    monkeypatch.setattr(topn, "FAN_IN", 4)  # more at once would raise
    rows = answers(600, 6) + [{"question_id": 9000 + i, "category_query": "hot", "anchor_index": 1, "results_poi_id": [i % 50, i], "results_poi_dist": [float(i % 7), 3.0], "results_poi_rank": [1, 2]} for i in range(900)]
    assert rows_of(topn.topn_found(tables.make(BENCHMARK, rows).repartition(12))) == best(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=12), min_size=1, max_size=9))
def test_loser_tree_sorts(lists):
    sources = [sorted(x) for x in lists]
    at = [0] * len(sources)
    tree = topn.LoserTree([s[0] if s else None for s in sources])
    out = []
    while tree.keys[tree.winner] is not None:
        i = tree.winner
        out.append(tree.keys[i])
        at[i] += 1
        tree.replace(sources[i][at[i]] if at[i] < len(sources[i]) else None)
    assert out == sorted(x for s in sources for x in s)


def runs_of(rows):
    return pd.DataFrame(sorted(rows, key=lambda r: (r[0], r[1], r[6], r[5], r[3], r[4], r[2])), columns=["category_query", "anchor_index", "poi_id", "dist", "rank", "run", "target"])


def test_merge_seeks_to_the_next_group():
    frame = runs_of([("a", 1, p, float(p), 1, run, 0) for run in range(3) for p in range(run, 90, 3)] + [("b", 1, 7, 1.0, 1, 2, 0)])
    for size in (1, 2, 7, 200):  # groups go on from one frame of a stream to the next
        merged = pd.concat(topn.merge_runs((frame.iloc[i : i + size] for i in range(0, len(frame), size)), 5, 3))
        assert merged["poi_id"].tolist() == [0, 1, 2, 3, 4, 7]
    with pytest.raises(ValueError):
        topn.merge_groups(frame, 5, 2)


def population(tables, clash=False):
    osm = [{"poi_id": i, "category": "cafe" if i < 500 else "Bar " if i < 560 else "zoo" if i < 563 else None} for i in range(600)]
    asked = [{"question_id": i, "category_query": "Café" if i % 2 else "bar"} for i in range(80)]
    return tables.make(OSM, osm + osm[:100], clash), tables.make(BENCHMARK, asked + asked[:9], clash)


CONFIGS = [
    {"config_id": 1, "population": "df_osm", "sample_size": 100, "ratio_category": {"cafe": 0.5, "bar": 0.3, "CAFE": 0.1, "zoo": 0.1}, "min_per_category": 5, "seed": 1},
    {"config_id": 2, "population": "benchmark", "sample_size": 60, "ratio_category": {"cafe": 0.7, "bar": 0.3, "none": 0.0}, "min_per_category": 0, "seed": 2},
    {"config_id": 3, "population": "df_osm", "sample_size": 10, "ratio_category": None, "seed": None},
    {"config_id": 4, "population": "df_osm", "sample_size": 20, "ratio_category": {"cafe": 0.98, "zoo": 0.01, "unicorn": 0.01}, "min_per_category": 3},
    {"config_id": 5, "population": "df_osm", "sample_size": None, "ratio_category": {}},
    {"config_id": 6, "population": "elsewhere", "sample_size": 5, "ratio_category": {"cafe": 1.0}},
]


def test_gaps(tables):
    osm, asked = population(tables, True)
    configs = tables.make(CONFIG, CONFIGS + CONFIGS[:1], True)
    assert rows_of(quota.quota_gaps(osm, asked, configs)) == [(1, "zoo"), (2, "cafe"), (4, "unicorn"), (6, "cafe")]


def test_sample_sizes_and_reproducibility(tables, monkeypatch):
    monkeypatch.setattr(quota, "BLOCK", 40)
    osm, asked = population(tables)
    configs = tables.make(CONFIG, CONFIGS)
    got = rows_of(quota.quota_sample(osm, asked, configs))
    assert got == rows_of(quota.quota_sample(osm.repartition(7), asked.repartition(3), configs))
    counts = {}
    for config, _, category, _ in got:
        counts[config, category] = counts.get((config, category), 0) + 1
    plans = {(p.config_id, p.category): p for p in quota.calibrate(quota.population(osm, asked), configs)}
    assert counts == {k: p.target for k, p in plans.items() if p.target}
    assert counts[1, "zoo"] == 3 and sum(v for k, v in counts.items() if k[0] == 1) == 100
    assert counts[4, "zoo"] == 3 and sum(v for k, v in counts.items() if k[0] == 4) == 20
    assert counts[3, "*"] == 10
    assert len({r[:1] + r[3:] for r in got}) == len(got)
    report = quota.quota_report(osm, asked, configs).collect()
    assert {(r["config_id"], r["category"]): r["shortage"] for r in report if r["shortage"]} == {(1, "zoo"): 7, (2, "cafe"): 2, (4, "unicorn"): 3, (6, "cafe"): 5}


def test_empty_population(tables):
    osm, asked, configs = tables.make(OSM), tables.make(BENCHMARK), tables.make(CONFIG, CONFIGS)
    assert quota.quota_sample(osm, asked, configs).count() == 0
    assert quota.quota_gaps(osm, asked, tables.make(CONFIG)).count() == 0
    assert len(quota.quota_gaps(osm, asked, configs).collect()) == 9


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 1), st.integers(0, 200)), min_size=1, max_size=8), st.integers(0, 300), st.integers(0, 20))
def test_integer_targets(cells, size, floor):
    shares, available = {f"c{i}": s for i, (s, _) in enumerate(cells)}, {f"c{i}": n for i, (_, n) in enumerate(cells)}
    got = quota.integer_targets(shares, available, size, floor)
    assert all(min(floor, available[c]) <= got[c] <= available[c] for c in got)
    floors = sum(min(floor, n) for n in available.values())
    assert sum(got.values()) == max(floors, min(size, sum(available.values())))


def test_newton_reaches_targets():
    n, t = np.array([1000, 10, 5, 0, 7]), np.array([10.0, 9.0, 5.0, 3.0, 9.0])
    chance, expected = quota.tilt(n, t)
    assert np.allclose(expected, [10, 9, 5, 0, 7])
    # probability 1 and less than wanted: the gaps
    assert [bool(c >= 1 and e < w) for c, e, w in zip(chance, expected, t)] == [False, False, False, True, True]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 10**6)), min_size=1, max_size=8))
def test_gaps_of_the_calibrated_solution_are_exact(cells):
    n, t = (np.array(x) for x in zip(*cells))
    chance, expected = quota.tilt(n, t.astype(float))
    assert [bool(c >= 1 and e < w) for c, e, w in zip(chance, expected, t)] == (n < t).tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0.001, 1), st.integers(0, 20), st.integers(0, 1000)), min_size=1, max_size=9), st.integers(0, 4000))
def test_one_multiplier_levels_the_shares(cells, size):
    shares, low, high = (np.array(x, float) for x in zip(*cells))
    low = np.minimum(low, high)
    got = quota.level(shares, low, high, size)
    assert np.isclose(got.sum(), min(max(size, low.sum()), high.sum()))
    inner = (got > low + 1e-6) & (got < high - 1e-6)
    ratio = (got / shares)[inner]
    assert len(ratio) == 0 or np.allclose(ratio, ratio[0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 1), max_size=60), st.integers(0, 1000))
def test_pivotal_keeps_the_size(weights, seed):
    w = np.array(weights, float)
    taken, holder, held = quota.pivotal(w, seed)
    assert abs(taken.sum() + held - w.sum()) < 1e-6 and (holder >= 0) == (held > 0)


def test_pivotal_keeps_the_probabilities():
    w = np.array([0.1, 0.5, 0.9, 0.3, 0.2])
    share = np.mean([quota.pivotal(w, s)[0] for s in range(4000)], axis=0)
    assert np.abs(share - w).max() < 0.03


def osm_rows(n):
    return [{"poi_id": i, "category": ["cafe", "Bar", None, " "][i % 4], "loaded_at": datetime(2024, 1, 1 + i % 28)} for i in range(n)]


def test_stable_sample_keeps_members(tables):
    configs = tables.make(CONFIG, [{"config_id": 1, "seed": 42, "ratio_test": 0.2}, {"config_id": 2, "seed": None, "ratio_test": 1.0}, {"config_id": 3, "seed": 1, "ratio_test": None}])
    old = osm_rows(800)
    first = rows_of(stable.config_samples(tables.make(OSM, old + old[:50], True), configs))
    assert first == rows_of(stable.config_samples(tables.make(OSM, old[::-1]).repartition(5), configs))
    later = [{"poi_id": i, "category": "zoo", "loaded_at": datetime(2025, 1, 1)} for i in range(700, 1000)] + [{"poi_id": None}, {"poi_id": 2000, "category": "x"}]
    second = rows_of(stable.config_samples(tables.make(OSM, old + later), configs))
    assert set(first) <= set(second)
    assert 0.15 < sum(r[0] == 1 for r in first) / 800 < 0.25
    assert sum(r[0] == 2 for r in first) == 800 and not any(r[0] == 3 for r in first)
    assert {r[1] for r in first} == {"cafe", "bar", stable.NO_STRATUM}
    assert stable.config_samples(tables.make(OSM), configs).count() == 0


def test_stored_thresholds_are_only_raised(tables, spark, tmp_path):
    osm, store = tables.make(OSM, osm_rows(800)), f"file://{tmp_path}/thresholds"
    config = lambda share: tables.make(CONFIG, [{"config_id": 1, "seed": 7, "ratio_test": share}])
    rates = lambda **by: spark.createDataFrame([(1, s, r) for s, r in by.items()], "config_id long, stratum string, rate double")
    first = rows_of(stable.config_samples(osm, config(0.05), store, rates(cafe=0.3, bar=0.1)))
    second = rows_of(stable.config_samples(osm, config(0.01), store, rates(cafe=0.1, bar=0.5)))
    third = rows_of(stable.config_samples(osm, config(None), store))
    assert set(first) < set(second) and second == third
    assert {r for r in first if r[1] != "bar"} == {r for r in second if r[1] != "bar"}
    assert stable.Store(spark, store).versions() == [0, 1, 2]
    bounds = {r["stratum"]: r["bound"] for r in stable.Store(spark, store).read().collect()}
    assert bounds == {"cafe": round(0.3 * stable.SPAN), "bar": round(0.5 * stable.SPAN), stable.NO_STRATUM: round(0.05 * stable.SPAN)}
    # a store of its own starts empty
    assert rows_of(stable.config_samples(osm, config(0.01))) != third


def test_odd_rates(tables):
    osm = tables.make(OSM, osm_rows(40))
    shares = [{"config_id": i, "seed": 1, "ratio_test": r} for i, r in enumerate([float("nan"), -1.0, 7.0, None])]
    assert {r[0] for r in rows_of(stable.config_samples(osm, tables.make(CONFIG, shares)))} == {2}
    assert stable.config_samples(osm, tables.make(CONFIG)).count() == 0
