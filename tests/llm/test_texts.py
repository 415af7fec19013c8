"""Encoding, mixing and truncation."""

import base64
import math

import numpy as np
import pytest
from conftest import DOCUMENTS, TARGETS, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from terramill.llm import bpe, mixing, truncation


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks())


@pytest.fixture(scope="module")
def peer():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.read_ranks().splitlines())}
    return tiktoken.Encoding("peer", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_library(encoder, peer, text):
    assert encoder.encode(text) == peer.encode_ordinary(text)


def test_special_and_long_texts(encoder, peer):
    for text in ("<|endoftext|>", "a" * 3000, " " * 500, "é" * 700, "12345" * 300, "\n\n\t x", "😋" * 50, "Crème brûlée " * 2000):
        assert encoder.encode(text) == peer.encode_ordinary(text)
    assert encoder.encode("") == encoder.encode(None) == []


def test_pairs_are_their_own_encoding(encoder, peer):
    for a, b in ((b"th", b"e"), (b"ab", b"c"), (b" a", b"b"), (b"in", b"g")):
        together = encoder.encode_piece(a + b)
        assert encoder.compatible(encoder.rank[a], encoder.rank[b]) == (together == [encoder.rank[a], encoder.rank[b]])


def test_documents(tables, encoder):
    rows = [{"doc_id": 1, "text": "Hello world"}, {"doc_id": 2, "text": ""}, {"doc_id": 3}, {"doc_id": None, "text": "x"}, {"doc_id": 1, "text": "Hello world"}]
    got = bpe.encode_documents(tables.make(DOCUMENTS, rows, True))
    assert got.columns == ["doc_id", "ids"]
    assert sorted(((r["doc_id"] or 0), r["ids"]) for r in got.collect()) == [(0, [87]), (1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert bpe.encode_documents(tables.make(DOCUMENTS)).count() == 0


def test_temperature():
    sizes = {"a": 1000.0, "b": 10.0, "c": 0.0}
    assert mixing.temperature_weights(sizes, 0) == {"a": 0.5, "b": 0.5, "c": 0.0}
    assert math.isclose(mixing.temperature_weights(sizes, 1)["a"], 1000 / 1010)
    a = mixing.exponent_for_entropy(sizes, 0.5)
    assert math.isclose(mixing.entropy(mixing.temperature_weights(sizes, a)), 0.5, abs_tol=1e-6)
    b = mixing.exponent_for_repeats(sizes, 400, dict.fromkeys(sizes, 4))
    assert math.isclose(mixing.temperature_weights(sizes, b)["b"] * 400, 40, rel_tol=1e-6)
    assert mixing.exponent_for_repeats(sizes, 1, dict.fromkeys(sizes, 4)) == 0


def corpus():
    rows = [{"doc_id": i, "text": "word " * (1 + i % 9), "source": "big"} for i in range(400)]
    rows += [{"doc_id": 1000 + i, "text": "tiny text", "source": " Small "} for i in range(5)]
    return rows + rows[:20] + [{"doc_id": 2000, "source": "big"}, {"doc_id": 2001, "text": "", "source": "big"}, {"doc_id": 2002, "text": "x"}, {"text": "x", "source": "big"}]


def test_mix(tables):
    docs = tables.make(DOCUMENTS, corpus(), True)
    targets = [
        {"mix_id": 1, "source": "big", "target_weight": 3.0, "max_repeats": 2, "total_tokens": 800}, {"mix_id": 1, "source": "SMALL", "target_weight": 1.0, "max_repeats": 3, "total_tokens": 800},
        {"mix_id": 2, "source": "big", "target_weight": 1.0, "max_repeats": 4}, {"mix_id": 2, "source": "small", "target_weight": 1.0, "max_repeats": 4}, {"mix_id": 2, "source": "none", "target_weight": 1.0, "max_repeats": 4},
        {"mix_id": 3, "source": "big", "target_weight": None}, {"mix_id": None, "source": "big", "target_weight": 1.0},
    ]
    report = {(r["mix_id"], r["source"]): r for r in mixing.mix_report(docs, tables.make(TARGETS, targets + targets[:1], True)).collect()}
    assert set(report) == {(1, "big"), (1, "small"), (2, "big"), (2, "small"), (2, "none")}
    small = report[1, "small"]
    assert small["most_copies"] == 3 and small["tokens"] == 3 * small["available"] and small["shortage"] > 0
    assert report[1, "big"]["target_tokens"] - 10 <= report[1, "big"]["tokens"] <= report[1, "big"]["target_tokens"]
    two = [report[2, s]["tokens"] for s in ("big", "small")]
    assert two[1] == 4 * small["available"] and abs(two[0] - two[1]) <= 10 and report[2, "none"]["tokens"] == 0
    chosen = mixing.mix_documents(docs, tables.make(TARGETS, targets)).collect()
    assert max(r["copies"] for r in chosen if r["mix_id"] == 1 and r["source"] == "big") <= 2
    assert mixing.mix_documents(tables.make(DOCUMENTS), tables.make(TARGETS, targets)).count() == 0
    assert mixing.mix_report(docs, tables.make(TARGETS)).count() == 0


def test_temperature_mixes_are_realised(tables):
    docs = tables.make(DOCUMENTS, corpus(), True)
    targets = tables.make(TARGETS, [
        {"mix_id": 1, "source": "big", "target_weight": 3.0, "max_repeats": 2, "total_tokens": 800}, {"mix_id": 1, "source": "small", "target_weight": 2.0, "max_repeats": 3, "total_tokens": 800},
        {"mix_id": 1, "source": "none", "target_weight": 2.0, "max_repeats": 3, "total_tokens": 800}, {"mix_id": 2, "source": "none", "target_weight": 1.0},
    ])
    report = {(r["rule"], r["source"]): r for r in mixing.temperature_report(docs, targets).collect()}
    assert set(report) == {(r, s) for r in ("entropy", "repeats") for s in ("big", "small")}
    for rule in ("entropy", "repeats"):
        shares = {s: report[rule, s]["target_share"] for s in ("big", "small")}
        sizes = {s: float(report[rule, s]["available"]) for s in shares}
        want = mixing.temperature_weights(sizes, report[rule, "big"]["exponent"])
        assert all(math.isclose(shares[s], want[s]) for s in shares)
        for s in shares:  # budgets are met but for less than a document, within the limit of repeats
            r = report[rule, s]
            assert min(r["target_tokens"], {"big": 2, "small": 3}[s] * r["available"]) - 11 <= r["tokens"] <= r["target_tokens"] + 1
    assert math.isclose(mixing.entropy({s: report["entropy", s]["target_share"] for s in ("big", "small")}), mixing.entropy({"big": 0.6, "small": 0.4}), abs_tol=1e-6)
    assert report["repeats", "small"]["most_copies"] <= 3 and report["repeats", "small"]["shortage"] == 0
    assert mixing.temperature_documents(tables.make(DOCUMENTS), targets).count() == 0


ENDINGS = {
    "The room felt bright. It was good.": "finished", "Is it open?": "finished", "He said \"yes.\"": "finished", "Great place! 🥐": "finished", "<p>Done.</p>": "finished",
    "A text cut in a ta<": "cut", "the d&eacut": "cut", "broken �": "cut", "Fish & chips. B &": "open", "It stopped in the mid": "open", "And so on [...]": "open", "": "finished",
}


def test_endings():
    for text, state in ENDINGS.items():
        assert truncation.Ending(text).state == state, text


def test_alignment():
    long = "the owner tells the story of the street while the queue reaches the corner of the square. More here."
    assert truncation.ends_early("the owner tells the story of the street while the queue rea", long)
    assert truncation.ends_early("the owner tells the story of the street while the queue", long)
    assert not truncation.ends_early("the owner tells the story of the street while the queue reaches the corner of the square.", long)
    assert not truncation.ends_early("nothing in common with the other text at all", long)


def sentences(i):
    return f"Place number {i} is a quiet spot near the lock. The owner of house {i * 7} tells the story of the street while the queue reaches the corner. Expect to pay about {i} euros each, drinks included."


def test_truncated_documents(tables):
    rows = [{"doc_id": i, "text": sentences(i), "source": "A "} for i in range(60)]
    rows += [{"doc_id": 100 + i, "text": sentences(i) + " loved it", "source": "a"} for i in range(5)]
    rows += [{"doc_id": 200 + i, "text": sentences(i)[: -6 - i], "source": "b"} for i in range(8)]
    rows += [{"doc_id": 300 + i, "text": sentences(30 + i) + " To be continued…"} for i in range(4)]
    rows += [{"doc_id": 400, "text": sentences(50)[:-30] + "…"}, {"doc_id": 401, "text": ""}, {"doc_id": 402, "text": "  \n"}, {"doc_id": 403}, {"text": "abc"}, {"doc_id": 404, "text": "word " * 60000 + "end."}]
    docs = tables.make(DOCUMENTS, rows + rows[:10] + rows[65:68], True)
    assert [r[0] for r in rows_of(truncation.truncated_found(docs))] == [*range(200, 208), 400]
    report = {r["source"]: (r["n_documents"], r["n_truncated"]) for r in truncation.truncation_report(docs).collect()}
    assert report == {"a": (65, 0), "b": (8, 8), None: (6, 1)}
    assert truncation.truncated_found(tables.make(DOCUMENTS)).count() == 0
    assert truncation.truncation_report(tables.make(DOCUMENTS)).count() == 0


def test_lists_of_keywords(tables):
    pairs = ["wifi free", "wifi paid", "music jazz", "music live piano", "price low", "price high", "view river", "view garden"]
    rows = [{"doc_id": i * 8 + j, "text": f"kind {i} {j} " + " ".join(pairs[(i + k) % 8] for k in range(5 + j % 3)) + ("" if j % 2 else f" rue des mots {10000 + i * 31 + j}")} for i in range(40) for j in range(8)]
    cut = [{"doc_id": 9000, "text": "cafe wifi free music live"}, {"doc_id": 9001, "text": "bar price low view gar"}, {"doc_id": 9002, "text": "bar price low rue des mots 123"}]
    assert [r[0] for r in rows_of(truncation.truncated_found(tables.make(DOCUMENTS, rows + cut)))] == [9000, 9001, 9002]


def near_copies(spark, texts):
    """Numbers of the texts that near_copies shows to be cut."""
    scratch = truncation.Scratch(spark, "test")
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "key long, text string, copies long")
    described = scratch.cut(table.mapInArrow(truncation.read, truncation.READ), "read").where("key IS NOT NULL")
    return [r[0] for r in rows_of(truncation.near_copies(described, table, scratch))]


def test_every_copy_of_a_bucket_is_met(spark):
    body = " ".join(f"word{i}" for i in range(60))
    # four cut at the same place; the longest text has the shingles of the whole one, and so its buckets, but its last words don't go on
    cut = [f"{zero} {body} and the corner of the squ" for zero in ("ZERO", "Zero", "zero")]
    whole = f"zero {body} and the corner of the square in the old town"
    assert near_copies(spark, [*cut, ";; " + cut[0], whole, whole.replace("corner of", "corner - of -")]) == [0, 1, 2, 3]


def test_continuing_copies_equal_all_pairs(spark):
    import random

    draw = random.Random(3)
    base = [f"w{i}" for i in range(70)]
    texts = set()
    for _ in range(150):
        words = list(base)
        words[draw.randrange(70)] = f"x{draw.randrange(9)}"
        text = " ".join(words[:60]) + draw.choice([" ", "\n"]) + " ".join(words[60:])
        texts.add(text[: draw.choice([len(text), 200, 205, 210, 215])] + draw.choice(["", "", "."]))
    texts = sorted(texts)
    hashes = [truncation.word_hashes(t) for t in texts]
    keys = [set(row) for row in truncation.bands(hashes).tolist()]
    similar = lambda i, j: truncation.similarity(hashes[i], hashes[j]) >= truncation.SIMILAR
    shows = lambda i, j: i != j and len(texts[i]) <= len(texts[j]) and truncation.ends_early(texts[i], texts[j]) and similar(i, j)
    open_ones = [i for i, t in enumerate(texts) if truncation.Ending(t).state == "open"]
    met = [i for i in open_ones if any(keys[i] & keys[j] and shows(i, j) for j in range(len(texts)))]
    every = [i for i in open_ones if any(shows(i, j) for j in range(len(texts)))]
    assert met and near_copies(spark, texts) == met
    assert len(met) >= 0.9 * len(every)


def hashed(items):
    return np.array([truncation.xxhash.xxh3_64_intdigest(x) for x in items], np.uint64)


def test_banding_meets_similar_texts():
    import random

    draw = random.Random(8)
    agreed, pairs = 0, 300
    for n in range(pairs):
        a = [f"{n} {i}" for i in range(80)]
        b = [*a[:71], *(f"other {n} {i}" for i in range(9))]  # 71 of 89: a Jaccard index just below 0.8
        keys = truncation.bands([hashed(x) for x in (draw.sample(a, 80), b)])
        agreed += bool(set(keys[0]) & set(keys[1]))
    assert agreed >= 0.98 * pairs
    # texts with little in common seldom meet: hashes keep no order from one function to the next
    chance = [truncation.bands([hashed([f"{n} {k} {i}" if i > 20 else f"{n} {i}" for i in range(80)]) for k in "ab"]) for n in range(100)]
    assert sum(bool(set(k[0]) & set(k[1])) for k in chance) <= 20


def test_long_words_and_fragments_are_judged_alike(tables):
    long = "verylong" * 12
    lists = [f"cafe {i} wifi free music {w}" for i in range(40) for w in (long + "end", "jazz")]
    remark = "as told by the keeper of the little museum behind the old harbour wall, who has been there for ages"
    signed = [sentences(i) + " " + remark for i in range(30)]
    rows = [{"doc_id": i, "text": t} for i, t in enumerate(lists + signed)]
    rows += [{"doc_id": 900, "text": f"cafe 77 wifi free music {long}"}, {"doc_id": 901, "text": sentences(400) + " " + remark[:70]}]
    assert [r[0] for r in rows_of(truncation.truncated_found(tables.make(DOCUMENTS, rows)))] == [900, 901]
