"""Ids of many texts at once: the units they are cut into are encoded once each, and laid out by numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

AT_ONCE = 8_000_000  # bytes of text that are encoded together


class KnownUnits:
    """Units met before, by their place in an Arrow array, with their ids one after another in a numpy array.

    When there are too many, those not met again since the last time are forgotten. Only
    new units become Python objects.
    """

    def __init__(self, most: int):
        self.most = most
        self.known = pa.array([], pa.large_string())
        self.ids, self.ends, self.odd = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int8)
        self.met = np.zeros(0, bool)

    def learn(self, units: list[str]) -> tuple[list[list[int]], list[int]]:
        """Ids of new units, and marks that say which of them are odd."""
        raise NotImplementedError

    def _forget(self, room: int) -> None:
        """Leaves `room` by dropping the units not met again, or all if that is not enough."""
        keep = self.met if self.met.sum() + room <= self.most else np.zeros(len(self.met), bool)
        sizes = np.diff(self.ends, prepend=0)
        self.ids, self.ends = self.ids[np.repeat(keep, sizes)], np.cumsum(sizes[keep])
        self.known, self.odd, self.met = self.known.filter(pa.array(keep)), self.odd[keep], np.zeros(int(keep.sum()), bool)

    def _learned(self, new: pa.Array) -> None:
        made = new.to_pylist()
        ids, odd = self.learn(made)
        begin = self.ends[-1] if len(self.ends) else 0
        self.known = pa.concat_arrays([self.known, new])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.uint32)])
        self.ends = np.concatenate([self.ends, begin + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        self.met = np.concatenate([self.met, np.zeros(len(made), bool)])
        self.odd = np.concatenate([self.odd, np.array(odd, np.int8)])

    def places(self, coded: pa.DictionaryArray) -> np.ndarray:
        """For each unit of an array its place among the known ones, which the new ones have joined."""
        if len(self.known) + len(coded.dictionary) > self.most:
            self._forget(len(coded.dictionary))
        found = pc.index_in(coded.dictionary, self.known)
        new = found.is_null().to_numpy(zero_copy_only=False)
        place = found.fill_null(0).to_numpy().astype(np.int64)
        self.met[place[~new]] = True
        place[new] = len(self.known) + np.arange(new.sum())
        self._learned(coded.dictionary.filter(pa.array(new)))
        return place[coded.indices.to_numpy()].astype(np.int64)

    def laid_out(self, row: np.ndarray, ends: np.ndarray, own: Iterable[list[int]] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units by their places, and where the ids of each text end, whose units end at `ends`.

        Places from the number of known units on: nothing, then the rows of `own`.
        """
        own = list(own)
        sizes = np.concatenate([np.diff(self.ends, prepend=0), [0], np.fromiter(map(len, own), np.int64, len(own))])
        flat = np.concatenate([self.ids, np.fromiter(chain.from_iterable(own), np.uint32)])
        begins = np.cumsum(sizes) - sizes
        taken = sizes[row]
        upto = np.concatenate([[0], np.cumsum(taken)])
        return flat[np.repeat(begins[row] - upto[:-1], taken) + np.arange(upto[-1])], upto[ends]


class SpacedUnits(KnownUnits):
    """Units between spaces, encoded with the space before them, for texts where no token reaches across such a cut."""

    def encode(self, text: str) -> list[int]:
        """Ids of a text's first unit."""
        raise NotImplementedError

    def text(self, text: str) -> list[int]:
        """Ids of a whole text with odd units."""
        raise NotImplementedError

    def column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text ends."""
        if not len(column):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lists = pc.split_pattern(column.cast(pa.large_string()), " ")
        ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        firsts = np.concatenate([[0], ends[:-1]])
        coded = lists.flatten().dictionary_encode()
        row = self.places(coded)
        odd = self.odd[row]
        odd[ends - 1] &= 2
        whole = np.maximum.reduceat(odd, firsts) > 0  # these texts are encoded by themselves
        first = coded.dictionary.take(coded.indices.take(pa.array(firsts))).to_pylist()
        own = [self.text(column[i].as_py()) if whole[i] else self.encode(first[i]) for i in range(len(column))]
        n = len(self.known)
        row[np.repeat(whole, ends - firsts)] = n  # nothing
        row[firsts] = n + 1 + np.arange(len(own))
        return self.laid_out(row, ends, own)


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches joined, up to AT_ONCE bytes of the second column; empty ones are left out."""
    waiting, size = [], 0
    for batch in batches:
        waiting += [batch] * bool(batch.num_rows)
        size += batch.column(1).nbytes
        if size >= AT_ONCE:
            yield pa.concat_batches(waiting)
            waiting, size = [], 0
    if waiting:
        yield pa.concat_batches(waiting)
