"""Exact byte-pair encoding by dynamic programming over prefixes.

For every prefix of a piece of text the last token of its encoding is unique.
It is found among the tokens that end there, which an Aho-Corasick automaton
(the suffix automaton of the vocabulary) reports: the token is the right one if
the prefix before it encodes with a last token that is compatible with it, that
is if the two tokens side by side are their own encoding. Back-pointers from the end give
the ids. Nothing is merged step by step, and cost doesn't depend on merge order.

Scale: encoding is a map over documents, without a shuffle. The vocabulary
(fixed, under 2 MB) is broadcast; the automaton is built once per Python worker.
Pieces are remembered, so a text costs a lookup per repeated word.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizers' vocabularies.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
# Fixed value: the published pattern by which this vocabulary's text is cut into pieces before encoding.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces a worker remembers before it forgets all; a bound of memory only.
REMEMBERED = 400_000
LONGEST_REMEMBERED = 64


def read_ranks(path: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> bytes:
    """The vocabulary file: a token in base 64 and its rank on each line."""
    return Path(path, f"{vocabulary}.tiktoken").read_bytes()


class Encoder:
    """Encodes pieces of bytes with a ranked vocabulary in which every longer token is a merge of two others."""

    def __init__(self, ranks_file: bytes):
        self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks_file.splitlines())}
        self.token = {r: t for t, r in self.rank.items()}
        self.length = {r: len(t) for t, r in self.rank.items()}
        self.parts = {r: self._split(t, r) for t, r in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.merged = {pair: r for r, pair in self.parts.items() if pair is not None}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.pieces = regex.compile(PIECES)

    def _split(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge is this one: the parts left when all merges of lower rank are done."""
        if len(token) == 1:
            return None
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.rank[parts[0]], self.rank[parts[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes together encode to just these two.

        Undoes both tokens' merges from the latest on. At each stage the tokens
        that touch were both there at that point of the encoding; if their
        merge ranks before the one that takes either of them away, the encoder
        would have crossed the border.
        """
        key = (left, right)
        known = self.fits.get(key)
        if known is not None:
            return known
        deadline = 1 << 62  # rank of the merge that ends the stage
        result = True
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < deadline:
                result = False
                break
            a, b = self.parts[left], self.parts[right]
            if a is None and b is None:
                break
            # the later merge is undone first; of equal ranks the right one is, as merges run from the left
            if b is None or (a is not None and left > right):
                deadline, left = left, a[1]
            else:
                deadline, right = right + 1, b[0]
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[key] = result
        return result

    def encode_piece(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        last = [-1] * (len(piece) + 1)  # last token of the encoding of each prefix
        length, compatible = self.length, self.compatible
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length[rank]
            if start == 0 or (last[start] >= 0 and compatible(last[start], rank)):
                last[end] = rank
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        return ids[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null and empty text have none. Special tokens' strings are ordinary text."""
        if not text:
            return []
        ids: list[int] = []
        known = self.known
        for piece in self.pieces.findall(text):
            found = known.get(piece)
            if found is None:
                found = tuple(self.encode_piece(piece.encode("utf-8", "replace")))
                if len(piece) <= LONGEST_REMEMBERED:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = found
            ids += found
        return ids


_encoders: dict[int, Encoder] = {}


def encoder_of(ranks_file: bytes) -> Encoder:
    """This process's encoder for a vocabulary."""
    key = hash(ranks_file)
    if key not in _encoders:
        _encoders[key] = Encoder(ranks_file)
    return _encoders[key]


def encode_documents(documents: DataFrame, path: str = TOKENIZERS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """p8_ids (doc_id, ids): the token ids of every document; an empty and a null text both give an empty list.

    Every row is kept, repeated ones and null keys too; other columns are left out.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks.value)
        for batch in batches:
            ids = [encoder.encode(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    rows = documents.select(key, F.col(text).alias("text"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind}, ids array<int>")


def count_tokens(documents: DataFrame, keep: list[str], path: str = TOKENIZERS) -> DataFrame:
    """Columns ``keep`` of every document and its ``n_tokens`` (0 for null and empty text)."""
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks.value)
        for batch in batches:
            sizes = pa.array([len(encoder.encode(t)) for t in batch["text"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], sizes], [*keep, "n_tokens"])

    rows = documents.select(*keep, "text")
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{schema}, n_tokens long")
