"""Documents packed into sequences of a fixed length, by patterns of lengths fitted to their histogram."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelens.llm.bpe import read_json_ranks
from ridelens.llm.patterns import Slots, plan
from ridelens.llm.shared import stored, texts, tokenizer_path, units
from ridelens.llm.unit_ids import SpacedUnits, together

TOKENIZER, SPECIAL, END, ROOM = "byte_bpe_50k.json", "<|endoftext|>", 2, 1024
UNITS_KEPT = 800_000
PIECES = pa.schema(
    [("part", pa.int32()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
)


class BatchEncoder(SpacedUnits):
    """Ids of whole columns of texts as the tokenizers library gives them.

    A text is cut at spaces that follow another character, where no token reaches
    across, so that each unit is encoded by itself.
    """

    def __init__(self, path: str, most: int = UNITS_KEPT):
        super().__init__(most)
        ranks = {token: i for token, i in read_json_ranks(path).items() if token.decode("latin-1") != SPECIAL}
        self.special = [max(ranks.values()) + 1]
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def text(self, text: str) -> list[int]:
        """A special string is one token and cuts the text, as the library has it by default."""
        ids: list[int] = []
        for n, part in enumerate(text.split(SPECIAL)):
            ids += self.special * (n > 0)
            for k, unit in enumerate(units(part)):
                ids += self.encode(" " * (k > 0) + unit)
        return ids

    def learn(self, new: list[str]) -> tuple[list[list[int]], list[int]]:
        """Units with a space before them. Odd are those that, within a text, do not end where a token
        does (empty, or white space at the end: 1), or may hold a special string (2)."""
        return [self.encode(" " + u) for u in new], [2 if SPECIAL in u else not u or u[-1].isspace() for u in new]


_encoders: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """One per Python worker and vocabulary, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = BatchEncoder(path)
    return _encoders[path]


def cut(ids: np.ndarray, ends: np.ndarray, room: int) -> dict[str, np.ndarray]:
    """Documents (with their end ids) in pieces of at most `room` ids: the first may be shorter, the others are full."""
    sizes = np.diff(ends, prepend=0)
    pieces = -(-sizes // room)
    doc = np.repeat(np.arange(len(sizes)), pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = (sizes - 1) % room + 1
    length = np.where(piece == 0, first[doc], room)
    start = np.where(piece == 0, 0, first[doc] + (piece - 1) * room)
    return {"doc": doc, "piece": piece, "start": start, "length": length}


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, room: int = ROOM) -> DataFrame:
    """The pieces of every whole text (null as empty) with their ids, little-endian unsigned 32-bit integers.

    `part` is the task that made a piece and `nth` its place among that task's pieces of
    equal length. They hold once the table is written: only one attempt of a task is kept.
    """
    path = tokenizer_path(tokenizer)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(room + 1, np.int64)
        for batch in together(batches):
            plain, ends = own.column(batch.column(1))
            ids = np.insert(plain, ends, end).astype("<u4")
            ends = ends + np.arange(1, len(ends) + 1)
            at = cut(ids, ends, room)
            length = at["length"]
            order = np.argsort(length, kind="stable")
            new, begins, counts = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - np.repeat(begins, counts) + np.repeat(seen[new], counts)
            seen[new] += counts
            offsets = np.concatenate([[0], np.cumsum(length)]) * 4
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)])
            columns = [np.full(len(length), part), nth, batch.column(0).take(pa.array(at["doc"])), at["piece"], at["start"], length, kept.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES)

    schema = "part int, nth long, doc_id long, piece int, start long, length long, ids binary"
    return texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(made, schema)


def packed(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, room: int = ROOM, **values: Column) -> DataFrame:
    """doc_id, piece, start, length, sequence_id and offset of every piece, and of its ids what `values` says: by default the ids.

    A null text is empty and gives its end id alone; rows of one id, and rows with a null
    id, are packed each by itself; other columns are left out; without rows there are no
    pieces. Pieces are numbered within their length: by their place in a task, and by the
    pieces of that length in earlier tasks. The plan says which numbers make a sequence.
    Only the histogram, one count for each possible length, goes to the driver, and ids
    stay where they were written.
    """
    made = stored(pieces(docs, tokenizer, end, room), "pieces", compression="zstd")
    counts = stored(made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = np.zeros(room + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row.length] = row.n
    slots = Slots(plan(histogram, room))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = slots.of(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    values = values or {"ids": F.col("ids")}
    kept = made.select("part", "nth", "doc_id", "piece", "start", "length", *(v.alias(c) for c, v in values.items()))
    ranked = kept.join(firsts, ["part", "length"]).withColumn("at", place("length", F.col("first") + F.col("nth")))
    return ranked.select("doc_id", "piece", "start", "length", "at.sequence_id", "at.offset", *values)


def sequences(pieces_packed: DataFrame) -> DataFrame:
    """sequence_id, n_ids and the ids of each whole sequence, from pieces with their ids in the order of their offsets."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = pieces_packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda made, part: F.concat(made, part["ids"]))
    return whole.select("sequence_id", "n_ids", joined.alias("ids"))
