"""Language by unigrams of pieces, summed over all ways to cut a text into pieces."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.shared import held_out, stored, tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
ROWS = 10_000  # texts to learn from, about, dealt over the languages (chosen by a hash of their ids)
LEAST = 50  # texts of a language, or all it has, even where languages are many
ROUNDS = 2  # of expected counts
LONGEST = 12  # letters of a piece
WORDS_KEPT = 300_000
UNDETERMINED = "und"
MARK = "▁"  # begins a word in the vocabulary

_word = re.compile(r"[^\W\d_]+")


def read_pieces(path: str) -> dict[str, int]:
    """The vocabulary's pieces of letters in lower case, by a number each; 0 stands for any other letter."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[str, int] = {"": 0}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).lower()
            if len(piece) <= LONGEST and piece.removeprefix(MARK).isalpha():
                pieces.setdefault(piece, len(pieces))
    return pieces


class Trie:
    """Pieces as ways of letters from node 0, walked by many words at once."""

    def __init__(self, pieces: dict[str, int]):
        nodes: dict[str, int] = {"": 0}
        for piece in pieces:
            for n in range(1, len(piece) + 1):
                nodes.setdefault(piece[:n], len(nodes))
        self.piece = np.full(len(nodes), -1)  # of the way to a node, or -1
        for piece, i in pieces.items():
            self.piece[nodes[piece]] = i
        del nodes[""]
        steps = sorted((nodes.get(way[:-1], 0) << 21 | ord(way[-1]), node) for way, node in nodes.items())
        # From a node by a letter: keys ascending, and a last one that is never met.
        self.keys = np.array([key for key, _ in steps] + [np.iinfo(np.int64).max])
        self.nodes = np.array([node for _, node in steps] + [0])

    def step(self, nodes: np.ndarray | int, letters: np.ndarray) -> np.ndarray:
        """The nodes that letters lead to, 0 where there is none."""
        keys = nodes << 21 | letters
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.nodes[at], 0)


class Pieces(NamedTuple):
    number: dict[str, int]
    trie: Trie

    def __len__(self) -> int:
        return len(self.number)


_pieces: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _pieces:
        number = read_pieces(path)
        _pieces[path] = Pieces(number, Trie(number))
    return _pieces[path]


def arcs(words: list[str], length: int, trie: Trie) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, places of words, their pieces) between places of words of one length, by `to`, then `from`.

    From each place all words go down the trie together; a word stays while pieces go on.
    A single letter that is no piece is piece 0.
    """
    letters = np.array(words, f"U{length}").view(np.uint32).reshape(len(words), length).T.astype(np.int64)
    different, of_word = np.unique(letters, return_inverse=True)
    first = trie.step(0, different)[of_word.reshape(letters.shape)]
    found = []
    for begin in range(length):
        nodes, rows = first[begin], np.arange(len(words))
        found.append((begin, begin + 1, rows, np.maximum(trie.piece[nodes], 0) * (nodes > 0)))
        for to in range(begin + 2, min(begin + LONGEST, length) + 1):
            on = nodes > 0
            rows = rows[on]
            if not len(rows):
                break
            nodes = trie.step(nodes[on], letters[to - 1][rows])
            ids = np.where(nodes > 0, trie.piece[nodes], -1)
            there = ids >= 0
            if there.any():
                found.append((begin, to, rows[there], ids[there]))
    return sorted(found, key=itemgetter(1, 0))


def forward(words: list[str], length: int, chances: np.ndarray, trie: Trie) -> tuple[np.ndarray, np.ndarray, list]:
    """Chances (places, words, languages) of all cuts up to each place, with scales' logs, and the arcs.

    Each place is scaled by its largest chance, so that long words do not run out of range.
    """
    k = chances.shape[1]
    alpha = np.zeros((length + 1, len(words), k))
    alpha[0] = 1
    logs = np.zeros((length + 1, len(words)))
    kept = arcs(words, length, trie)
    for begin, to, rows, ids in kept:
        if begin == to - 1:  # the last arc to a place, and of all words
            alpha[to] += alpha[begin] * chances[ids]
            top = np.maximum(alpha[to].max(axis=1), 1e-300)
            alpha[to] /= top[:, None]
            logs[to] = logs[to - 1] + np.log(top)
        else:
            # Chances at `begin` are in units of exp(logs[begin]); those at `to` are in units of exp(logs[to - 1]).
            unit = np.exp(logs[begin, rows] - logs[to - 1, rows])[:, None]
            alpha[to, rows] += alpha[begin, rows] * chances[ids] * unit
    return alpha, logs, kept


def _trie(pieces: Pieces | dict[str, int]) -> Trie:
    return pieces.trie if isinstance(pieces, Pieces) else Trie(pieces)


def word_logs(words: list[str], chances: np.ndarray, pieces: Pieces | dict[str, int]) -> np.ndarray:
    """Log chance of each word (a mark is put before it) in each language."""
    trie = _trie(pieces)
    out = np.zeros((len(words), chances.shape[1]))
    for length, places in by_length(words).items():
        group = [MARK + words[i] for i in places]
        alpha, logs, _ = forward(group, length + 1, chances, trie)
        out[places] = np.log(np.maximum(alpha[-1], 1e-300)) + logs[-1][:, None]
    return out


def by_length(words: list[str]) -> dict[int, list[int]]:
    places: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        places.setdefault(len(word), []).append(i)
    return places


def expected_counts(words: list[str], times: np.ndarray, chances: np.ndarray, pieces: Pieces | dict[str, int]) -> np.ndarray:
    """How often each piece is expected in words of one language, over all their cuts (forward and backward)."""
    counts = np.zeros(len(chances))
    trie = _trie(pieces)
    for length, places in by_length(words).items():
        group, weight = [MARK + words[i] for i in places], times[places]
        alpha, logs, kept = forward(group, length + 1, chances[:, None], trie)
        alpha = alpha[:, :, 0]
        beta = np.zeros_like(alpha)  # of place i in units of exp(logs[-1] - logs[i])
        beta[-1] = 1 / np.maximum(alpha[-1], 1e-300)
        for begin, to, rows, ids in sorted(kept, key=lambda arc: -arc[1]):
            flow = chances[ids] * np.exp(logs[begin, rows] - logs[to, rows]) * beta[to, rows]
            beta[begin, rows] += flow
            np.add.at(counts, ids, weight[rows] * alpha[begin, rows] * flow)
    return counts


class Model(NamedTuple):
    languages: list[str]
    log_prior: np.ndarray
    chances: np.ndarray  # of pieces by language


def first_guess(pieces: Pieces) -> np.ndarray:
    """Chances that fall with a piece's place in the vocabulary, which is by frequency."""
    guess = 1.0 / (np.arange(len(pieces)) + 50.0)
    guess[0] = 1e-7
    return guess / guess.sum()


def _expect(languages: list[str], chances: np.ndarray, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for batch in batches:
            words: dict[int, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words.setdefault(languages.index(lang), Counter()).update(_word.findall(text.lower()))
            for k, counted in words.items():
                counts = expected_counts(list(counted), np.array(list(counted.values()), float), chances[:, k], pieces)
                used = np.flatnonzero(counts > 1e-9)
                columns = [pa.array(np.full(len(used), k), pa.int32()), pa.array(used, pa.int32()), pa.array(counts[used], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["k", "piece", "n"])

    return run


def quota(counts: list[int], rows: int) -> int:
    """The most rows a language may have, so that all have about `rows` or less; at least LEAST."""
    left, sizes = rows, sorted(counts)
    for i, n in enumerate(sizes):
        share = left // (len(sizes) - i)
        if n > share:
            return max(share, LEAST)
        left -= n
    return max(sizes[-1], LEAST)


def fit(docs: DataFrame, rows: int = ROWS, rounds: int = ROUNDS, vocabulary: str = VOCABULARY) -> Model:
    """Learns every language of the texts with one that are not held out, from about `rows` of these.

    Languages and their priors come from all such texts; a language has a quota of the
    rows, or all its texts where they are fewer. Counts come to the driver once summed: at
    most as many as pieces times languages.
    """
    path = tokenizer_path(vocabulary)
    known = docs.where("lang is not null and text is not null").where(~held_out()).select("doc_id", "lang", "text")
    prior = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    languages, pieces = [r.lang for r in prior], pieces_of(path)
    if not languages:
        return Model([], np.zeros(0), np.zeros((len(pieces), 0)))
    limit = quota([r.n for r in prior], rows)
    shares = [(r.lang, 1 << 40 if r.n <= limit else int(limit / r.n * (1 << 40))) for r in prior]
    shares = docs.sparkSession.createDataFrame(shares, "lang string, share long")
    # By a hash of the id: of a language over its quota, about as many rows as that.
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 40)) < F.col("share")
    known = stored(known.join(F.broadcast(shares), "lang").where(drawn).select("lang", "text"), "language-sample")
    chances = np.repeat(first_guess(pieces)[:, None], len(languages), axis=1)
    for _ in range(rounds):
        found = known.mapInArrow(_expect(languages, chances, path), "k int, piece int, n double")
        counts = np.zeros_like(chances)
        for row in found.groupBy("k", "piece").agg(F.sum("n").alias("n")).collect():
            counts[row.piece, row.k] = row.n
        # A piece not met in a language keeps a little of what it has in all of them.
        pooled = counts.sum(axis=1) + 0.01
        counts += pooled[:, None] / pooled.sum() * np.maximum(counts.sum(axis=0), 1.0) * 0.01
        chances = counts / counts.sum(axis=0)
    n = np.array([r.n for r in prior], float)
    return Model(languages, np.log(n / n.sum()), chances)


class Numbers(dict):
    """A number for each word, in the order they are first met."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Scorer:
    """Log chances of words, remembered while there is room; new words of a batch are scored together."""

    def __init__(self, model: Model, path: str):
        self.model, self.pieces = model, pieces_of(path)
        self.known = Numbers()
        self.logs = np.zeros((0, len(model.languages)))

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        texts = [_word.findall(t.lower()) for t in texts]
        out, at = [], 0
        while at < len(texts):  # some texts at a time, so that their new words are bounded
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to]) <= 200_000):
                size += len(texts[to])
                to += 1
            out += self._some(texts[at:to])
            at = to
        return out

    def _some(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
            self.logs = self.logs[:0]
        number = known.__getitem__
        places = [np.fromiter(map(number, words), np.int64, len(words)) for words in texts]
        if new := list(islice(known, len(self.logs), None)):
            self.logs = np.concatenate([self.logs, word_logs(new, self.model.chances, self.pieces)])
        return [self._one(of_text) for of_text in places]

    def _one(self, places: np.ndarray) -> tuple[str, float]:
        if not len(places) or not self.model.languages:
            return UNDETERMINED, 0.0
        total = self.logs[places].sum(axis=0) + self.model.log_prior
        chances = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.model.languages[best], float(chances[best] / chances.sum())


def predicted(model: Model, text: Column, vocabulary: str = VOCABULARY) -> Column:
    """lang_pred and score (its posterior chance) of a text."""
    path = tokenizer_path(vocabulary)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model, path)
        for column in batches:
            yield pd.DataFrame(scorer.score(column.tolist()), columns=["lang_pred", "score"])

    return run(F.coalesce(text, F.lit("")))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    A null or empty text, or one without a letter, is `und` with score 0, and so is every
    text where nothing was learned. Of equal chances the first language by name wins.
    Repeated rows get equal answers; a null lang is not learned from.
    """
    model = fit(docs)
    made = docs.select("doc_id", held_out().alias("held_out"), predicted(model, F.col("text")).alias("made"))
    return made.select("doc_id", "held_out", "made.*")
