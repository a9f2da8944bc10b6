"""Byte-level BPE encoding and decoding by longest matches and backtracking."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.bpe import Ranks, read_ranks
from ridelens.llm.shared import Memo, tokenizer_path, units, unused
from ridelens.llm.unit_ids import SpacedUnits

TOKENIZER = "byte_bpe_50k.tiktoken"
UNITS_KEPT, PIECES_KEPT = 80_000, 250_000
NONE = -1
COLUMN_UNITS_KEPT = 800_000  # of whole columns: in arrays, not as Python objects


class Encoder:
    """Ids of texts, each match of the pattern by itself, without special tokens.

    Bytes are read as Latin-1 letters, so that an automaton over strings finds the
    longest token at a place. A token is kept if it fits its neighbour on the left;
    otherwise the next shorter one, known for each token, is tried, and where none is
    left, the last token is taken back and its end marked, so that no end is tried twice.
    """

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.ranks = Ranks(read_ranks(path))
        self.find = regex.compile(pattern).findall
        self.ids = {token.decode("latin-1"): i for token, i in self.ranks.ids.items()}
        self.trie = ahocorasick.Automaton()
        self.match: dict[str, int] = {}  # the longest token that begins a way down the trie
        self.size, self.shorter = ([n] * (max(self.ids.values()) + 1) for n in (0, NONE))
        for token, i in sorted(self.ids.items()):  # a token comes after those it begins with
            self.trie.add_word(token, i)
            self.size[i] = len(token)
            for n in range(1, len(token)):
                self.shorter[i] = self.match.setdefault(token[:n], self.shorter[i])
            self.match[token] = i
        self.pieces = Memo(self._piece, PIECES_KEPT)
        self.units = Memo(lambda unit: self._plain(" " + unit), UNITS_KEPT)

    def encode(self, text: str) -> array:
        """Ids as unsigned 32-bit integers."""
        first, *rest = units(text)
        ids = array("I", self._plain(first))
        ids.frombytes(b"".join(map(self.units.__getitem__, rest)))
        return ids

    def decode(self, ids: array) -> bytes:
        return b"".join(map(self.ranks.bytes_of.__getitem__, ids))

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def _piece(self, piece: str) -> bytes:
        return array("I", self.backtrack(piece.encode().decode("latin-1"))).tobytes()

    def backtrack(self, letters: str) -> list[int]:
        if (whole := self.ids.get(letters)) is not None:
            return [whole]
        fits, longest, match, size, shorter = self.ranks.pairs, self.ranks.longest, self.match, self.size, self.shorter
        prefix = self.trie.longest_prefix
        tokens: list[int] = []
        closed: set[int] = set()
        at, last, end = 0, NONE, len(letters)
        token = match[letters[: prefix(letters[:longest])]]
        while at < end:
            while token != NONE and (at + size[token] in closed or last != NONE and not fits[last << 20 | token]):
                token = shorter[token]
            if token != NONE:
                tokens.append(token)
                at += size[token]
                last = token
                if at < end:
                    ahead = letters[at : at + longest]
                    token = match[ahead[: prefix(ahead)]]
            else:
                closed.add(at)
                token = tokens.pop()
                at -= size[token]
                token = shorter[token]
                last = tokens[-1] if tokens else NONE
        return tokens


class ColumnEncoder(SpacedUnits):
    """Ids of whole columns of texts: each different unit is encoded once, by an Encoder."""

    def __init__(self, path: str, most: int = COLUMN_UNITS_KEPT):
        super().__init__(most)
        self.own = Encoder(path)
        bytes_of = self.own.ranks.bytes_of
        self.tokens = pa.array([bytes_of.get(i) for i in range(max(bytes_of) + 1)], pa.large_binary())

    def encode(self, text: str) -> array:
        return array("I", self.own._plain(text))

    def text(self, text: str) -> array:
        return self.own.encode(text)

    def learn(self, new: list[str]) -> tuple[list[array], list[int]]:
        """Odd are units that are empty or end in white space: the space after them may belong to their last match."""
        plain, pieces = self.own._plain, self.own.pieces
        # A word of ASCII letters is one match with the space before it.
        ids = [array("I", pieces[" " + u] if u.isascii() and u.isalpha() else plain(" " + u)) for u in new]
        return ids, [int(not u or u[-1].isspace()) for u in new]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[memoryview]:
        """The bytes of each text whose ids end there."""
        taken = self.tokens.take(pa.array(ids))
        _, offsets, data = taken.buffers()
        upto = np.frombuffer(offsets, np.int64)[np.concatenate([[0], ends])].tolist()
        data = memoryview(data or b"")
        return [data[a:b] for a, b in zip(upto, upto[1:], strict=False)]


def of_each(ids: np.ndarray, ends: np.ndarray) -> list[memoryview]:
    """The ids of each text as bytes, little-endian unsigned 32-bit integers."""
    upto = [0, *(4 * ends).tolist()]
    data = memoryview(ids.astype("<u4", copy=False)).cast("B")
    return [data[a:b] for a, b in zip(upto, upto[1:], strict=False)]


# Encoders live as long as a task: idle Python workers would hold them while other code runs.


def encode(docs: DataFrame, name: str = "ids", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Adds the ids of every whole text as little-endian unsigned 32-bit integers.

    A null text counts as empty; an empty text has no ids. All columns stay; one called
    `name` is replaced. Rows are independent, so repeated rows get equal ids.
    """
    path = tokenizer_path(tokenizer)

    @F.pandas_udf("binary")
    def ids(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Encoder(path)
        for column in columns:
            yield column.map(lambda t: own.encode(t).tobytes())

    return docs.withColumn(name, ids(F.coalesce(F.col(text), F.lit(""))))


def decode(docs: DataFrame, name: str = "decoded", ids: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """Adds the bytes that the ids stand for; null ids count as none."""
    path = tokenizer_path(tokenizer)

    @F.pandas_udf("binary")
    def decoded(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bytes_of = {i: token for token, i in read_ranks(path).items()}
        for column in columns:
            yield column.map(lambda data: b"".join(map(bytes_of.__getitem__, array("I", data or b""))))

    return docs.withColumn(name, decoded(F.col(ids)))


def coded(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns of docs with ids and decoded, as from encode and decode, by one Python worker a task."""
    path = tokenizer_path(tokenizer)

    # By single texts: beside other columns and stages, an encoder of columns takes too much memory.
    @F.pandas_udf("ids binary, decoded binary")
    def both(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Encoder(path)
        for column in columns:
            ids = [own.encode(t) for t in column]
            yield pd.DataFrame({"ids": [i.tobytes() for i in ids], "decoded": [own.decode(i) for i in ids]})

    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    name = unused("coded", docs)
    made = docs.select(*kept, both(F.coalesce("text", F.lit(""))).alias(name))
    return made.select(*kept, f"{name}.ids", f"{name}.decoded")


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, in one pass over the texts."""
    path = tokenizer_path(tokenizer)

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = ColumnEncoder(path)
        for column in columns:
            ids, ends = own.column(column)
            made = [
                pa.array(np.diff(ends, prepend=0), pa.int64()),
                pa.array([hashlib.sha256(data).hexdigest() for data in of_each(ids, ends)], pa.string()),
                pa.array([hashlib.sha256(data).hexdigest() for data in own.decode(ids, ends)], pa.string()),
            ]
            yield pa.StructArray.from_arrays(made, ["n_tokens", "ids_sha256", "decoded_sha256"])

    made = docs.select("doc_id", digests(F.coalesce("text", F.lit(""))).alias("made"))
    return made.select("doc_id", "made.*")
