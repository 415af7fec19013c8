"""Cross-split overlaps and linked groups against brute force."""

import random
import re
import unicodedata

import pytest
from conftest import BATCHES, CONFIG, rows_of

from terramill.llm import components, overlap


def words(questions):
    text = " ".join(f for q in questions or [] if q for f in q if f)
    text = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return set(re.findall(r"[^\W_]+", text))


def jaccard(a, b):
    return len(a & b) / len(a | b)


def make(n=400, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["crème", "brûlée", "naïve"]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            base = rng.choice(out)
            pois, frags = list(base["poi_ids"] or [1]), [list(q) for q in base["questions"] or [["w1"]] if q]
            if rng.random() < 0.6:
                pois = pois[1:] + [rng.randint(1, 60)]
            if rng.random() < 0.6 and frags:
                frags[0] = [*frags[0], rng.choice(vocabulary)]
        else:
            pois = [rng.randint(1, 60) for _ in range(rng.randint(1, 9))]
            frags = [[" ".join(rng.sample(vocabulary, 3)) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 4))]
        out.append({"batch_id": i, "split": rng.choice(["train", " Train", "TRAIN ", "test", "Validation", None, "other"]), "source": rng.choice(["a", None]), "questions": frags, "poi_ids": pois, "author": rng.choice([None, None, None, f"A{rng.randint(0, 200)} "])})
    out += [{"batch_id": n, "split": "test"}, {"batch_id": n + 1, "split": "train", "questions": [None, [None, "é"]], "poi_ids": [None, 5]}, {"batch_id": n + 2, "split": "test", "questions": [["E!"]], "poi_ids": [5, 5]}, {"batch_id": n + 3, "split": "test", "questions": [], "poi_ids": []}]
    out.append({"batch_id": n + 4, "split": "test", "questions": [["x " * 20000]], "poi_ids": [9]})
    return out + out[:30]


def brute(rows):
    by = {}
    for r in rows:
        s, p, w = (r["split"] or "").strip().lower(), {i for i in r.get("poi_ids") or [] if i is not None}, words(r.get("questions"))
        if p and w:
            by[r["batch_id"]] = (s, p, w)
    return sorted(
        (min(a, b), max(a, b)) for a, (s, p, w) in by.items() if s == "train" for b, (t, q, v) in by.items()
        if t in ("test", "validation") and jaccard(p, q) >= 0.7 and jaccard(w, v) >= 0.7
    )


def test_overlaps(tables):
    rows = make()
    assert len(brute(rows)) > 20
    assert rows_of(overlap.overlap_found(tables.make(BATCHES, rows, True))) == brute(rows)


def test_overlaps_in_crowds_shards_and_blocks(tables, monkeypatch):
    monkeypatch.setattr(overlap, "CROWD", 2)
    monkeypatch.setattr(overlap, "SHARD", 40)
    monkeypatch.setattr(overlap, "BLOCK", 50)
    rows = make(300, 7)
    assert rows_of(overlap.overlap_found(tables.make(BATCHES, rows))) == brute(rows)


def ordered(questions):
    text = " ".join(f for q in questions or [] if q for f in q if f)
    text = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return re.findall(r"[^\W_]+", text)


def brute_coverage(rows):
    """Share of each evaluation batch's words in five words in a row (or a shorter whole text) of a training batch."""
    texts = {}
    for r in rows:
        text, split = ordered(r.get("questions")), (r["split"] or "").strip().lower()
        if text and any(p is not None for p in r.get("poi_ids") or []):
            texts[r["batch_id"]] = split, text
    holds = lambda text, part: any(text[i : i + len(part)] == part for i in range(len(text) - len(part) + 1))
    training = [t for s, t in texts.values() if s == "train"]
    out = {}
    for key, (split, text) in texts.items():
        if split in ("test", "validation"):
            seen = set()
            for i in range(max(1, len(text) - 4)):
                if any(holds(t, text[i : i + 5]) for t in training):
                    seen |= set(range(i, min(i + 5, len(text))))
            out[key] = len(seen) / len(text)
    return out


def test_report_covers_every_evaluation_batch(tables, monkeypatch):
    monkeypatch.setattr(overlap, "SHARD", 30)
    monkeypatch.setattr(overlap, "BLOCK", 20)
    rows = make(200, 3)
    report = overlap.overlap_report(tables.make(BATCHES, rows)).collect()
    pairs, covered = brute(rows), brute_coverage(rows)
    assert sum(r["n_pairs"] for r in report) == len(pairs)
    assert sum(r["n_batches"] for r in report) == len(covered)
    total = sum(r["mean_coverage"] * r["n_batches"] for r in report)
    assert any(0 < c < 1 for c in covered.values()) and abs(total - sum(covered.values())) < 1e-3
    assert overlap.overlap_report(tables.make(BATCHES)).count() == 0


def test_passages_of_words_in_a_row():
    shard = overlap.Shard([7, 8], [[1, 2, 3], [4]], [["a", "b", "c", "d", "e", "f", "g"], ["x", "y"]], 0.7, spans=True)
    assert shard.matches([1, 2], "u a b c d e v y x".split()) == []
    assert shard.intervals() == {0: [(0, 5)]}
    # the same words in another order are no passage, but as similar
    assert shard.matches([1, 2, 3], "g f e d c b a".split()) == [(0, 1.0, 1.0)]
    assert shard.intervals() == {}
    shard.matches([4], "x y c d e f g".split())
    assert shard.intervals() == {0: [(2, 7)], 1: [(0, 2)]}


def test_neighbouring_ids_lose_no_pair():
    rng = random.Random(6)
    for _ in range(3000):
        a = set(rng.sample(range(60), rng.randint(1, 25)))
        b = {x for x in a if rng.random() > 0.2} | set(rng.sample(range(60), rng.randint(0, 6)))
        if b and jaccard(a, b) >= 0.7:
            assert set(overlap.runs(sorted(a), 2)) & set(overlap.runs(sorted(b), 2)), (a, b)


def test_overlapping_intervals_merge():
    assert overlap.merged([(3, 8), (0, 5), (9, 12), (12, 13)]) == [(0, 8), (9, 13)]
    assert overlap.merged([]) == []


def closure(rows):
    owner = {}

    def find(x):
        owner.setdefault(x, x)
        while owner[x] != x:
            owner[x] = owner[owner[x]]
            x = owner[x]
        return x

    for r in rows:
        b = ("b", r["batch_id"])
        find(b)
        author = (r.get("author") or "").strip().lower()
        for k in [("p", i) for i in r.get("poi_ids") or [] if i is not None] + ([("a", author)] if author else []):
            owner[find(b)] = find(k)
    groups = {}
    for r in rows:
        groups.setdefault(find(("b", r["batch_id"])), set()).add(r["batch_id"])
    return groups.values()


def sparse(n=300, seed=4):
    rng = random.Random(seed)
    return [{"batch_id": i, "poi_ids": rng.choice([None, [], [rng.randint(0, 2000), None, rng.randint(0, 2000)]]), "author": rng.choice([None, "", " ", f"x{rng.randint(0, 400)}", f" X{rng.randint(0, 400)} "])} for i in range(n)]


@pytest.mark.parametrize("few", [0, 25, 10**6])
def test_groups(tables, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    for rows in (sparse(), [{"batch_id": i, "poi_ids": [i, i + 1]} for i in range(0, 60)], [{"batch_id": i, "author": "hot"} for i in range(150)]):
        want = sorted((b, min(g)) for g in closure(rows) if len(g) > 1 for b in g)
        assert rows_of(components.linked_groups(tables.make(BATCHES, rows + rows[:10], True))) == want
    assert components.linked_groups(tables.make(BATCHES)).count() == 0
    assert components.linked_groups(tables.make(BATCHES, [{"batch_id": 1, "poi_ids": [1]}, {"poi_ids": [1]}])).count() == 0


def test_splits_keep_groups_and_shares(tables):
    rows = sparse(600, 9)
    batches = tables.make(BATCHES, rows + rows[:20])
    configs = tables.make(CONFIG, [{"config_id": 1, "ratio_test": 0.2, "ratio_validation": 0.1, "seed": 5}, {"config_id": 2, "ratio_test": 0.1, "ratio_validation": None, "seed": None}, {"config_id": 3, "ratio_test": None}])
    got = {(r["config_id"], r["batch_id"]): r["split"] for r in components.group_splits(batches, configs).collect()}
    assert len(got) == 3 * 600
    for c, shares in ((1, {"test": 0.2, "validation": 0.1}), (2, {"test": 0.1, "validation": 0}), (3, {"test": 0, "validation": 0})):
        for g in closure(rows):
            assert len({got[c, b] for b in g}) == 1
        biggest = max(map(len, closure(rows)))
        for split, share in shares.items():
            assert abs(sum(got[c, r["batch_id"]] == split for r in rows) - share * 600) <= max(12, biggest)
    assert components.group_splits(tables.make(BATCHES), configs).count() == 0
    report = components.split_report(components.group_splits(batches, configs), configs)
    assert abs(sum(r["share"] for r in report.collect()) - 3) < 1e-9
