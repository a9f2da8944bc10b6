"""Token counts by a finite-state transducer that is compiled from a BPE vocabulary."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.bpe import Ranks, read_json_ranks
from ridelens.llm.shared import Memo, tokenizer_path, units

TOKENIZER = "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"
BEGIN, NONE = -1, -2  # before the first token; no token can begin here
CHUNK, STATES, UNITS_KEPT = 16_384, 200_000, 400_000


class Transducer:
    """Deterministic: a transition by one byte emits by how many tokens the count changes.

    What follows depends only on the longest end of the bytes read that begins some
    token, and on the last token at each place within it. These make up a state. States
    and transitions are compiled when first met and dropped together when there are too
    many, so that memory is bounded and the result stays the same.
    """

    def __init__(self, ranks: Ranks, most: int = STATES):
        self.ranks, self.most = ranks, most
        self.begins = {t[:n] for t in ranks.ids for n in range(1, len(t))}
        self._reset()

    def _reset(self, key: tuple = (b"", (BEGIN,), (0,))) -> int:
        """Forgets all states but the first and the given one, whose number is returned."""
        # A state: bytes of the window, last token at each place in it, tokens so far
        # at each place less those at its end.
        self.states = [(b"", (BEGIN,), (0,))]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, int] = {}
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def count(self, data: bytes) -> int:
        return self.run(0, data)[1]

    def run(self, state: int, data: bytes) -> tuple[int, int]:
        """The state after some bytes from a state, and by how much the count changes.

        Numbers of states hold until the next call.
        """
        moves, n = self.moves, 0
        for byte in data:
            move = moves.get(state << 8 | byte)
            if move is None:
                if len(self.states) > self.most:  # also within one long piece
                    state = self._reset(self.states[state])
                    moves = self.moves
                move = self._compile(state, byte)
            n += (move & 0xFFFF) - 0x8000
            state = move >> 16
        return state, n

    def _compile(self, state: int, byte: int) -> int:
        window, last, counts = self.states[state]
        window += bytes((byte,))
        ids, fits = self.ranks.ids, self.ranks.fits
        for start in range(len(window)):
            token = ids.get(window[start:])
            if token is None or last[start] == NONE:
                continue
            if last[start] == BEGIN or fits(last[start], token):
                break
        change = counts[start] + 1
        open_ = [i for i in range(len(window)) if window[i:] in self.begins]
        cut = open_[0] if open_ else len(window)
        # Where no token can begin any more, nothing is kept, so that more states are the same.
        kept = {i: (last[i], counts[i] - change) for i in open_}
        at = [kept.get(i, (NONE, 0)) for i in range(cut, len(window))] + [(token, 0)]
        key = (window[cut:], tuple(t for t, _ in at), tuple(n for _, n in at))
        to = self.number.setdefault(key, len(self.states))
        if to == len(self.states):
            self.states.append(key)
        self.moves[state << 8 | byte] = move = to << 16 | (change + 0x8000)
        return move


class Counter:
    """Counts tokens of texts; long texts by chunks whose state maps are composed."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, special: str = SPECIAL, chunk: int = CHUNK):
        self.machine = Transducer(Ranks(read_json_ranks(path)))
        self.find = regex.compile(pattern).finditer
        self.special, self.chunk = special, chunk
        self.units = Memo(lambda unit: self._plain(" " + unit), UNITS_KEPT)

    def count(self, text: str) -> int:
        """A special string is one token and cuts the text, as the library has it by default."""
        parts = text.split(self.special)
        return len(parts) - 1 + sum(map(self._part, parts))

    def _part(self, text: str) -> int:
        if len(text) <= self.chunk:
            return self.tokens(text)
        head, inside, tail = self.total(self.state_map(text[i : i + self.chunk]) for i in range(0, len(text), self.chunk))
        return self.tokens(head) + (inside or 0) + self.tokens(tail)

    def tokens(self, text: str) -> int:
        first, *rest = units(text)
        return self._plain(first) + sum(map(self.units.__getitem__, rest))

    def _plain(self, text: str) -> int:
        """Pieces are found one after another, and a long one is read by chunks from state to state."""
        machine, n = self.machine, 0
        for found in self.find(text):
            first, last = found.span()
            if last - first <= self.chunk:
                n += machine.count(text[first:last].encode())
                continue
            state = 0
            for i in range(first, last, self.chunk):
                state, change = machine.run(state, text[i : min(i + self.chunk, last)].encode())
                n += change
        return n

    def state_map(self, chunk: str) -> tuple[str, int | None, str]:
        """The map from any state at the chunk's begin to its end, by texts that wait for their neighbours.

        At a space after another character every state goes over to the same one. So a
        map is: what is read before the first such place and waits for the state at the
        begin, the tokens from there to the last such place (None if there is none), and
        what is read after it, which stands for the state at the end.
        """
        head, *rest = units(chunk)
        if not rest:
            return chunk, None, ""
        *inside, tail = rest
        return head, sum(map(self.units.__getitem__, inside)), " " + tail

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.tokens(a[2] + b[0]) + b[1], b[2]

    def total(self, maps: Iterable[tuple]) -> tuple:
        """The map of all chunks. Neighbours of equal size are composed as they come, like the
        carries of a binary counter, and only what they make is kept: as much text as all maps hold."""
        kept: list[tuple[int, tuple]] = []
        for made in maps:
            size = 1
            while kept and kept[-1][0] == size:
                made, size = self.compose(kept.pop()[1], made), 2 * size
            kept.append((size, made))
        return reduce(lambda right, left: self.compose(left[1], right), reversed(kept[:-1]), kept[-1][1])


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per Python worker and vocabulary, kept between tasks."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, limit: int = 512, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every row.

    A null text counts as empty, with no bytes and no tokens. Repeated rows, and rows
    with a null id, are each counted; other columns are left out.
    """
    path = tokenizer_path(tokenizer)

    @F.pandas_udf("long")
    def tokens(column: pd.Series) -> pd.Series:
        return column.map(counter(path).count).astype("int64")

    text = F.coalesce("text", F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
