"""Documents whose text was cut off before its end.

Three kinds of evidence, in this order:

1. The ending itself: broken characters, tags or entities, and marks of omission
   are unfinished; sentence ends, closing tags and emoji are finished.
2. Near-copies: texts whose min-hash signatures agree in a band are verified by
   their five-word shingles: 0.8 or more of the shorter text's must be the longer
   one's (every pair with a Jaccard index of 0.8 has that). They are aligned; a copy
   whose alignment ends where the longer one goes on within the same line is cut.
3. Terminality: how often the corpus ends where this text ends. For closing
   fragments (remarks, sign-offs, phrases with a mark of omission), how many of
   the fragments that begin alike end just so. For lists of keywords, queries
   and hours, how many of the words that begin alike end a line or text. Prose
   without a sentence end is finished only by such a fragment.

All counts are over all different texts; equal texts count once, so that copies
of a cut text don't vouch for each other.

Scale: texts are shuffled once, to find equal ones, and read once in Python, which
gives endings, signatures and pre-aggregated counts. Within a bucket of a band an
open text meets first the longest text for each word that follows its last words,
and only where that shows nothing every other text in which they go on (an
equi-join on their hash, salted): no member that could show the cut is left out.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terramill.functions.text import fold_label
from terramill.session import Scratch

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 12, 4
#: Texts of a bucket with the same four words beyond which they are salted.
CROWD = 1000
#: Least share of fragments that end so; least share of words that end a line, of numbers, and of words after the same word.
FRAGMENT_SHARE, WORD_SHARE, NUMBER_SHARE, AFTER_SHARE = 0.3, 0.01, 0.1, 0.05
#: A word or pair is the beginning of another if that one occurs this many times as often.
DOMINATED = 10

# Marks and patterns of endings.
OMISSION = re.compile(r"\s*(?:…|\.\.\.+|\[\s*(?:…|\.\.\.)\s*\]|\(\s*(?:…|\.\.\.)\s*\))[\s\"'»”’]*$")
BROKEN = re.compile(r"(?:�|<[^<>]*|&#?[A-Za-z0-9]{0,8})$")
FINISHED = re.compile(r"[.!?。！？؟।][\"'»”’)\]]*$")
BREAK = re.compile(r"(?:[.!?。！？؟…][\"'»”’)\]]*\s+|[\r\n]+\s*|<br\s*/?>\s*|</?(?:p|li|ul|ol|div|h[1-6])>\s*)")
SENTENCE = re.compile(r"[.!?。！？؟][\"'»”’)\]]*(?:\s|<|$)|,\s|;\s")
LINE = re.compile(r"[\r\n]+|<br\s*/?>")
DIGIT = re.compile(r"\d")
TAG = re.compile(r"<[^<>]*>")
WORD = re.compile(r"[^\W_]+")


def is_emoji(char: str) -> bool:
    return unicodedata.category(char) in ("So", "Sk") or char in "‍️⃣" or 0x1F000 <= ord(char) <= 0x1FAFF


def shape(token: str) -> str:
    return DIGIT.sub("0", token)


@lru_cache(1 << 16)
def token_class(token: str) -> str:
    first = token[:1]
    return "number" if any(c.isdigit() for c in token) else "upper" if first.isupper() else "lower" if first.isalpha() else "other"


@lru_cache(1 << 16)
def is_money(token: str) -> bool:
    return unicodedata.category(token[-1:] or " ") == "Sc"


def untagged(text: str) -> str:
    return TAG.sub(" ", text) if "<" in text else text


def bare(fragment: str) -> str:
    """A fragment without blanks around it and without emoji before it."""
    fragment = fragment.strip()
    at = 0
    while at < len(fragment) - 1 and (is_emoji(fragment[at]) or fragment[at].isspace()):
        at += 1
    return fragment[at:]


class Parsed:
    """A text without entities, in fragments and lines."""

    __slots__ = ("clean", "pieces", "lines", "sentences")

    def __init__(self, text: str):
        self.clean = html.unescape(text)
        self.pieces = [bare(p) for p in BREAK.split(self.clean) if p and not p.isspace()]
        self.lines = LINE.split(self.clean)
        self.sentences = SENTENCE.search(self.clean) is not None


class Ending:
    """What the end of one text shows; ``state`` is finished, cut or open."""

    __slots__ = ("state", "fragment", "word", "before", "prose", "marked")

    def __init__(self, text: str, parsed: Parsed | None = None):
        raw = text.rstrip().rstrip("\u200b\ufeff")
        self.fragment, self.word, self.before, self.prose, self.marked = "", "", "", True, False
        if not raw:
            self.state = "finished"
            return
        if BROKEN.search(raw) and not re.search(r"(?:^|\s)&$", raw):
            self.state = "cut"
            return
        parsed = Parsed(raw) if parsed is None or raw != text else parsed
        clean = parsed.clean
        plain = untagged(clean).rstrip()
        self.fragment = parsed.pieces[-1] if parsed.pieces else ""
        line = next((x for x in reversed(parsed.lines) if x and not x.isspace()), "")
        tokens = untagged(line).split()
        self.word = tokens[-1] if tokens else ""
        self.before = tokens[-2] if len(tokens) > 1 else ""
        self.prose = parsed.sentences and not self._tabular(line)
        if OMISSION.search(clean):
            self.marked, self.state = True, "open"
        elif FINISHED.search(plain) or re.search(r"</[a-zA-Z0-9]+>$", raw) or (plain and is_emoji(plain[-1])):
            self.state = "finished"
        else:
            self.state = "open"

    def _tabular(self, line: str) -> bool:
        """A last line that ends in a number or currency, as addresses, hours and menus do, is judged as a list."""
        return bool(self.word) and (token_class(self.word) == "number" or is_money(self.word))


@lru_cache(1 << 16)
def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


_BASE = np.array([pow(0x9E3779B97F4A7C15, SHINGLE - i, 1 << 64) for i in range(SHINGLE)], np.uint64)


def word_hashes(text: str) -> np.ndarray:
    """Distinct hashes of the five-word shingles of the folded words; of all words together if they are fewer; none without words."""
    found = np.array([_hash(w) for w in WORD.findall(html.unescape(untagged(text)).lower())], np.uint64)
    if not len(found):
        return found
    size = max(1, len(found) - SHINGLE + 1)
    out = np.zeros(size, np.uint64)
    for i in range(min(SHINGLE, len(found))):
        out += found[i : i + size] * _BASE[i]
    return np.unique(out ^ (out >> np.uint64(31)))


#: Odd multipliers: a product's order modulo 2**64 has nothing left of the order of the hashes.
_FACTORS = np.random.default_rng(20240601).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: list[np.ndarray]) -> np.ndarray:
    """For each set of hashes (none empty) one key for each band of its min-hash signature; keys of different bands differ."""
    flat = np.concatenate(hashes)
    starts = np.cumsum([0, *map(len, hashes[:-1])])
    keys = np.zeros((len(hashes), BANDS), np.uint64)
    for i, factor in enumerate(_FACTORS):
        band, row = divmod(i, ROWS)
        low = np.minimum.reduceat(flat * factor, starts)
        keys[:, band] = (keys[:, band] ^ low) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band)
    return keys.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smaller set's members that the other has: a cut copy lacks what was cut, so the Jaccard index would be too strict."""
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b)) if len(a) and len(b) else 0.0


def ends_early(short: str, long: str) -> bool:
    """Whether ``short``, aligned with its near-copy, stops within a line in which ``long`` goes on.

    The end is aligned by the last whole words before it: they must stand in
    the longer text, followed by a word that begins with the unfinished last
    one, or by more of the same sentence.
    """
    a, b = short.split(), long.split()
    for drop in (1, 0):  # the last word may itself be cut
        tail = a[len(a) - drop - 4 : len(a) - drop] if len(a) - drop >= 4 else []
        if not tail:
            continue
        for at in range(len(b) - 4, -1, -1):
            if b[at : at + 4] == tail:
                rest = b[at + 4 :]
                if drop and rest and rest[0] != a[-1] and rest[0].startswith(a[-1]):
                    return True
                if not drop and rest and not FINISHED.search(a[-1]):
                    after = long.split(None, at + 4)[-1] if len(b) > at + 4 else ""
                    gap = long[: len(long) - len(after)]
                    return "\n" not in gap[len(gap.rstrip()) :]
                break
    return False


def _gram(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(words)) - (1 << 63)


def last_words(text: str) -> list[tuple[int, str | None]]:
    """(gram, word) that a longer copy must have for ``ends_early``: the four words before the last, and that one; the last four, without a word."""
    a = html.unescape(text).split()
    before = [(_gram(a[-5:-1]), a[-1])] if len(a) > 4 else []
    return before + ([(_gram(a[-4:]), None)] if len(a) > 3 and not FINISHED.search(a[-1]) else [])


def goes_on(text: str) -> dict[int, tuple[str, bool]]:
    """Of every four words in a row, where they stand last: the word after them, and whether it is in the same line."""
    text = html.unescape(text)
    at = [m.span() for m in re.finditer(r"\S+", text)]
    words = [text[i:j] for i, j in at]
    found = {}
    for i in range(len(words) - 3):
        gram = _gram(words[i : i + 4])
        if i + 4 < len(words):
            found[gram] = words[i + 4], "\n" not in text[at[i + 3][1] : at[i + 4][0]]
        else:
            found.pop(gram, None)
    return found


def fragment_names(fragment: str) -> list[str]:
    """Names under which the beginnings of a fragment are counted: those of 1, 2, 4, ... characters, hashed."""
    return [f"s:{i}:{xxhash.xxh3_64_hexdigest(fragment[: 1 << i])}" for i in range(len(fragment).bit_length())]


def closing_name(fragment: str) -> str:
    return f"f:{xxhash.xxh3_64_hexdigest(fragment)}"


def brief(fragment: str) -> bool:
    """Whether a fragment is too short for a shingle, so that equal ones needn't be copies."""
    return len(fragment.split(None, SHINGLE)) < SHINGLE


class Counts:
    """Counts of texts: beginnings of fragments (s:) and closing fragments (f:); outside prose, words (w:), pairs of words (p:) and followers (b:).

    A text that is but one brief fragment counts as often as it occurs, all others once.
    """

    def __init__(self):
        self.begun: list[Counter] = []
        self.closed, self.words, self.pairs, self.after, self.word_ends, self.after_ends = (Counter() for _ in range(6))

    def __len__(self) -> int:
        return sum(map(len, (*self.begun, self.closed, self.words, self.pairs, self.after)))

    def add(self, parsed: Parsed, copies: int) -> None:
        pieces = parsed.pieces
        times = copies if len(pieces) == 1 and brief(pieces[0]) else 1
        for piece in pieces:
            for i in range(len(piece).bit_length()):
                if i == len(self.begun):
                    self.begun.append(Counter())
                self.begun[i][piece[: 1 << i]] += times
        if pieces:
            self.closed[pieces[-1]] += times
        prose = parsed.sentences
        for line in parsed.lines:
            tokens = untagged(line).split()
            last = len(tokens) - 1
            for i, token in enumerate(tokens):
                kind = token_class(token)
                if prose and kind != "number" and not is_money(token):
                    continue
                word = shape(token) if kind == "number" else token
                self.words[word] += 1
                if i == last:
                    self.word_ends[word] += 1
                if i and not prose:
                    self.pairs[tokens[i - 1], word] += 1
                    self.after[tokens[i - 1], kind] += 1
                    if i == last:
                        self.after_ends[tokens[i - 1], kind] += 1

    def rows(self) -> tuple[list[str], list[int], list[int]]:
        """Names, numbers, numbers of ends."""
        out = [(f"s:{i}:{xxhash.xxh3_64_hexdigest(k)}", v, 0) for i, counter in enumerate(self.begun) for k, v in counter.items()]
        out += [(closing_name(k), v, 0) for k, v in self.closed.items()]
        out += [(f"w:{k}", v, self.word_ends[k]) for k, v in self.words.items()]
        out += [(f"p:{a} {b}", v, 0) for (a, b), v in self.pairs.items()]
        out += [(f"b:{a}\t{b}", v, self.after_ends[a, b]) for (a, b), v in self.after.items()]
        return tuple(map(list, zip(*out))) if out else ([], [], [])


def is_list_like(e: Ending) -> bool:
    """Whether an ending is judged by its last word: in lists, and where it is a number or an amount."""
    return bool(e.word) and (not e.prose or token_class(e.word) == "number" or is_money(e.word))


def asked_names(fragment: str, word: str, before: str, listed: bool) -> list[str]:
    """Names of the counts that ``judge`` looks up."""
    names = [closing_name(fragment), fragment_names(fragment)[-1]] if fragment else []
    if listed:
        names += [f"w:{word}", f"x:{word}"]
        if before:
            names += [f"p:{before} {word}", f"y:{before} {word}", f"b:{before}\t{token_class(word)}"]
    return names


#: A row describes a text (name is null) or counts a name (key is null).
READ = (
    "key long, state string, fragment string, word string, before string, prose boolean, marked boolean, n_chars int, bands array<bigint>, "
    "asked array<struct<gram:bigint,word:string>>, names array<string>, name string, n long, n_end long"
)
_READ = pa.schema([
    ("key", pa.int64()), ("state", pa.string()), ("fragment", pa.string()), ("word", pa.string()), ("before", pa.string()), ("prose", pa.bool_()), ("marked", pa.bool_()), ("n_chars", pa.int32()),
    ("bands", pa.list_(pa.int64())), ("asked", pa.list_(pa.struct([("gram", pa.int64()), ("word", pa.string())]))), ("names", pa.list_(pa.string())), ("name", pa.string()), ("n", pa.int64()), ("n_end", pa.int64()),
])


def _rows(**columns: list) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _READ], schema=_READ)


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over texts (key, text, copies): their endings, signatures and closing words, and the counts."""
    counts = Counts()
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in _READ if f.name not in ("name", "n", "n_end")}
        shingles: list[np.ndarray] = []
        for key, text, copies in zip(*(batch[c].to_pylist() for c in ("key", "text", "copies"))):
            parsed = Parsed(text)
            e = Ending(text, parsed)
            listed = is_list_like(e)
            word = shape(e.word) if token_class(e.word) == "number" else e.word
            is_open = e.state == "open"
            for name, value in (("key", key), ("state", e.state), ("fragment", e.fragment), ("word", word), ("before", e.before), ("prose", e.prose), ("marked", e.marked), ("n_chars", len(text))):
                out[name].append(value)
            out["asked"].append(last_words(text) if is_open else [])
            out["names"].append(asked_names(e.fragment, word, e.before, listed) if is_open else [])
            shingles.append(word_hashes(text))
            counts.add(parsed, copies)
        if shingles:
            live = [i for i, h in enumerate(shingles) if len(h)]
            keys = iter(bands([shingles[i] for i in live]).tolist() if live else [])
            out["bands"] = [next(keys) if len(h) else [] for h in shingles]
            out["asked"] = [[{"gram": g, "word": w} for g, w in row] for row in out["asked"]]
            yield _rows(**out)
        if len(counts) > 500_000:  # pre-aggregated so far; a bound of memory only
            yield _rows(**dict(zip(("name", "n", "n_end"), counts.rows())))
            counts = Counts()
    if len(counts):
        yield _rows(**dict(zip(("name", "n", "n_end"), counts.rows())))


GOES = "other long, gram long, next string, inline boolean"
_GOES = pa.schema([("other", pa.int64()), ("gram", pa.int64()), ("next", pa.string()), ("inline", pa.bool_())])


def _goes_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(key, gram, *after) for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist()) for gram, after in goes_on(text).items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), _GOES)], schema=_GOES)


def distinct_texts(documents: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, hash) of the documents with text, and (key, hash, text, copies) of the different texts; the keys are given by the written table."""
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").where(F.col("text").rlike(r"[^\s\p{Z}]"))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), fold_label(F.col("source")).alias("source"), F.unhex(F.md5("text")).alias("hash"), "text")
    texts = rows.groupBy("hash").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    return rows.drop("text"), scratch.cut(texts.select(F.monotonically_increasing_id().alias("key"), "*"), "texts")


def near_copies(described: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(key) of the texts that end early beside a verified near-copy."""
    # a finished ending can't be cut, whatever a copy goes on with, and a cut one needs no copy
    is_open = F.col("state") == "open"
    banded = described.select("key", is_open.alias("open"), F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.max("open").alias("asks")).where("n > 1 AND asks").select("bucket")
    members = scratch.cut(banded.join(scratch.cut(buckets, "buckets"), "bucket").select("bucket", "key", "open"), "members")
    asked = described.where(is_open).select("key", "n_chars", F.inline("asked"))
    asked = scratch.cut(asked.join(members.where("open").select("key", "bucket"), "key"), "asked")
    near = texts.join(members.select("key").distinct(), "key", "left_semi")
    goes = near.select("key", "text").mapInArrow(_goes_on, GOES).join(asked.select("gram").distinct(), "gram", "left_semi")
    sizes = members.select(F.col("key").alias("other"), "bucket").join(described.select(F.col("key").alias("other"), F.col("n_chars").alias("chars")), "other")
    place = ["bucket", "gram"]
    goes = scratch.cut(goes.join(sizes, "other").join(asked.select(*place).distinct(), place, "left_semi"), "goes")
    follows = F.when(F.col("word").isNull(), F.col("inline")).otherwise(F.col("next").startswith(F.col("word")) & (F.col("next") != F.col("word")))
    met = (F.col("key") != F.col("other")) & (F.col("n_chars") <= F.col("chars")) & follows

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = lru_cache(64)(word_hashes)
        for frame in frames:
            keep = [ends_early(html.unescape(a), html.unescape(b)) and similarity(hashes(a), hashes(b)) >= SIMILAR for a, b in zip(frame["short"], frame["long"])]
            yield frame.loc[keep, ["key"]]

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.cut(pairs.select("key", "other").distinct(), f"{name}_pairs")
        texts_of = lambda key, text: near.select(F.col("key").alias(key), F.col("text").alias(text))
        both = pairs.join(texts_of("key", "short"), "key").join(texts_of("other", "long"), "other")
        return scratch.cut(both.select("key", "short", "long").mapInPandas(verify, "key long").distinct(), name)

    # one continuing copy is enough: first the longest one for each following word, then all others where it shows nothing
    longest = goes.groupBy(*place, "next", "inline").agg(F.max(F.struct("chars", "other")).alias("top")).select(*place, "next", "inline", "top.*")
    found = verified(asked.join(longest, place).where(met), "first")
    crowds = goes.groupBy(*place).agg(F.ceil(F.count("*") / CROWD).cast("int").alias("parts"))
    rest = asked.join(found, "key", "left_anti").join(crowds, place).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    salted = goes.join(crowds, place).withColumn("salt", F.pmod(F.xxhash64("other"), F.col("parts")).cast("int")).drop("parts")
    others = rest.join(salted, [*place, "salt"]).where(met)
    tried = longest.select(*place, "next", "inline", "other")
    return found.unionByName(verified(others.join(tried, [*place, "next", "inline", "other"], "left_anti"), "others")).distinct()


def judge(state: str, prose: bool, marked: bool, fragment: str, word: str, before: str, known: dict) -> bool:
    """Whether a text is cut, from its ending and the corpus counts (n, n_end) of the names in ``known``."""
    if state != "open":
        return state == "cut"
    count = lambda name: known.get(name, (0, 0))
    if fragment:
        same, alike = count(closing_name(fragment))[0], count(fragment_names(fragment)[-1])[0]
        if same >= 3 and same >= FRAGMENT_SHARE * alike:
            return False
        if not marked and same < 3 and prose and brief(fragment) and (fragment[0].islower() or fragment[0] in "—–(") and alike <= 2 * same:
            return False
    if marked:
        return True
    kind = token_class(word)
    n, ends = count(f"w:{word}")
    family = count(f"x:{word}")[0]
    if kind == "number" or (word and is_money(word)):
        return ends <= 1 or ends - 1 < NUMBER_SHARE * family
    if prose:
        return True
    # a word's own share decides if it is frequent enough for one end to be expected
    if n * AFTER_SHARE >= 1:
        return ends - 1 < WORD_SHARE * family
    if not before:
        return family > n
    pair, pairs = count(f"p:{before} {word}")[0], count(f"y:{before} {word}")[0]
    if pairs - pair >= DOMINATED * max(1, pair) or family - n >= DOMINATED * DOMINATED * max(1, n):
        return True
    after, after_end = count(f"b:{before}\t{kind}")
    return after_end - 1 < AFTER_SHARE * after or after_end <= 1


def families(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """(name, n, n_end) of the asked x: and y: names: sums over all words, or second words after the same first one, that begin so.

    Beginnings are taken at the lengths that are asked, however long they are.
    """
    first = F.when(F.col("name").startswith("w:") | F.col("name").startswith("x:"), 3).otherwise(F.locate(" ", F.col("name"), 3) + 1)
    wanted = asked.where(F.col("name").startswith("x:") | F.col("name").startswith("y:"))
    sizes = wanted.select(F.translate(F.substring("name", 1, 1), "xy", "wp").alias("kind"), (F.length("name") - first + 1).alias("size"))
    sizes = sizes.groupBy("kind").agg(F.collect_set("size").alias("sizes"))  # two rows, of the different lengths of words
    listed = counts.where(F.col("name").startswith("w:") | F.col("name").startswith("p:")).withColumn("kind", F.substring("name", 1, 1)).withColumn("first", first)
    listed = listed.join(sizes, "kind").withColumn("size", F.explode(F.filter("sizes", lambda i: i <= F.length("name") - F.col("first") + 1)))
    begun = F.concat(F.translate(F.col("kind"), "wp", "xy"), F.substring(F.col("name"), F.lit(2), F.col("first") - 2 + F.col("size")))
    begun = listed.select(begun.alias("name"), "n", "n_end").join(wanted, "name", "left_semi")
    return begun.groupBy("name").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end"))


def judge_open(described: DataFrame, counted: DataFrame, scratch: Scratch) -> DataFrame:
    """(key) of the texts that their ending alone, or its terminality in the corpus, shows to be cut."""
    counts = scratch.cut(counted.groupBy("name").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end")), "counts")
    cases = described.where("state = 'open'").select("key", "state", "prose", "marked", "fragment", "word", "before", "names")
    asked = scratch.cut(cases.select(F.explode("names").alias("name")).distinct(), "names")
    answers = counts.join(asked, "name", "left_semi").unionByName(families(counts, asked))
    looked = cases.select("key", F.explode("names").alias("name")).join(answers, "name").groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("name", F.struct("n", "n_end")))).alias("known"))
    rows = cases.drop("names").join(looked, "key", "left")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            keys = [r["key"] for r in rows if judge(r["state"], r["prose"], r["marked"], r["fragment"], r["word"], r["before"], {k: (v["n"], v["n_end"]) for k, v in (r["known"] or [])})]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], ["key"])

    return rows.mapInArrow(decide, "key long").unionByName(described.where("state = 'cut'").select("key"))


def truncated(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source) of the cut documents, and the same of all documents with text."""
    scratch = Scratch(documents.sparkSession, "truncation")
    rows, texts = distinct_texts(documents, scratch)
    passed = scratch.cut(texts.select("key", "text", "copies").mapInArrow(read, READ), "read")
    described, counted = passed.where("key IS NOT NULL").drop("name", "n", "n_end"), passed.where("name IS NOT NULL").select("name", "n", "n_end")
    keys = near_copies(described, texts, scratch).unionByName(judge_open(described, counted, scratch)).distinct()
    cut = scratch.cut(texts.join(keys, "key", "left_semi").select("hash"), "cut")
    return rows.join(cut, "hash", "left_semi").drop("hash"), rows.drop("hash")


def truncated_found(documents: DataFrame) -> DataFrame:
    """p10_found (doc_id): every document whose text is cut; null, empty and blank texts are none, repeated rows count once."""
    return truncated(documents)[0].select("doc_id").distinct()


def truncation_report(documents: DataFrame) -> DataFrame:
    """p10_report (source, n_documents, n_truncated, share): sources without case and surrounding blanks, null as its own row."""
    cut, rows = truncated(documents)
    every = rows.groupBy("source").agg(F.countDistinct("doc_id").alias("n_documents"))
    some = cut.groupBy("source").agg(F.countDistinct("doc_id").alias("n_truncated"))
    joined = every.join(some, every["source"].eqNullSafe(some["source"]), "left")
    n = F.coalesce("n_truncated", F.lit(0).cast("long"))
    return joined.select(every["source"], "n_documents", n.alias("n_truncated"), (n / F.col("n_documents")).alias("share"))
