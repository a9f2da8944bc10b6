"""Ranks of a byte-level BPE vocabulary and which two tokens may stand side by side."""

from __future__ import annotations

import base64
import json

from ridelens.llm.shared import Memo


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in JSON vocabularies: a printable byte for itself,
    the others in order from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_json_ranks(path: str) -> dict[bytes, int]:
    """As read_ranks, from the merges and the vocabulary of a JSON file; ids follow merges."""
    with open(path, encoding="utf-8") as file:
        vocab = json.load(file)["model"]["vocab"]
    byte = byte_of_letter()
    return {bytes(byte[c] for c in token): i for token, i in vocab.items() if all(c in byte for c in token)}


class Ranks:
    """A vocabulary whose ids are the order of its merges, single bytes first.

    A row of tokens is what the merges make of its bytes exactly if that holds for every
    two neighbours and for every token by itself. So encoders need only `fits`.
    """

    def __init__(self, ids: dict[bytes, int], memo: int = 150_000):
        self.ids = ids
        self.bytes_of = {i: token for token, i in ids.items()}
        self.longest = max(map(len, ids))
        self.pairs = Memo(self._fits, memo)
        self.halves = Memo(self._halves, len(ids))

    def fits(self, left: int, right: int) -> bool:
        return self.pairs[left << 20 | right]

    def merge(self, data: bytes, down_to: int = 1) -> list[bytes]:
        """The merges one by one, lowest rank first: the plain definition, used on single tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > down_to:
            ranks = [self.ids.get(a + b, -1) for a, b in zip(parts, parts[1:], strict=False)]
            found = [r for r in ranks if r >= 0]
            if not found:
                break
            at = ranks.index(min(found))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one."""
        left, right = self.merge(self.bytes_of[token], 2)
        return self.ids[left], self.ids[right]

    def _fits(self, pair: int) -> bool:
        """Whether no merge ever crosses the line between two tokens.

        Goes back in time: of the two parts beside the line, the one merged later is
        undone. While both stood there, they would have merged with each other if that
        rank came before the undone one; of equal ranks the leftmost comes first.
        """
        left, right = pair >> 20, pair & 0xFFFFF
        before = len(self.ids) + 1
        while True:
            joined = self.ids.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < before:
                return False
            later = max(left, right)
            if len(self.bytes_of[later]) == 1:
                return True
            if right == later:
                before, right = right + 1, self.halves[right][0]
            else:
                before, left = left, self.halves[left][1]
