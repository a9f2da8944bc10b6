"""Token ids of documents in files of wavelet matrices, in the order of doc_id."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ridelens.llm.bpe import byte_of_letter
from ridelens.llm.shared import crc, shared_folder, stored, texts, tokenizer_path
from ridelens.llm.unit_ids import KnownUnits, together
from ridelens.llm.wavelet import WaveletMatrix

TOKENIZER, END = "word_bpe_49k.json", 1
SHARD = 2_000_000  # ids of a file, after which the next document begins another
WORDS_KEPT = 600_000
WORD_END = b"\xff"  # stands for the end of a word; UTF-8 has no such byte
FILE = "part int, seq int, n_ids long, doc_ids array<long>, ends array<long>, data binary"


def _merger(path: str):
    """The merges of a vocabulary with word ends as a function from bytes to ranks, and the ids of ranks.

    A word's end is a byte that no text has. Joining it to the byte before comes before
    all merges of the vocabulary, which then follow in their order.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    suffix, byte = model["end_of_word_suffix"], byte_of_letter()
    letter = {b: c for c, b in byte.items()}
    ends = {bytes((b,)) + WORD_END: letter[b] + suffix for b in range(255)}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    merged = {}
    for token in map("".join, pairs):
        plain = token.removesuffix(suffix)
        merged[bytes(byte[c] for c in plain) + WORD_END * (plain != token)] = token
    tokens = ends | merged | {bytes((b,)): c for b, c in letter.items()}
    core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})._core_bpe
    return core.encode_single_piece, [model["vocab"].get(t) for t in tokens.values()]


class WordEncoder(KnownUnits):
    """The library's ids of whole columns of texts; words met before are not sent to it again.

    White space ends every word of the tokenizer and composes with nothing, so what lies
    between is encoded by itself. That is done for texts of Latin letters and common
    marks, where Arrow and the library agree on white space, lower case and letters; the
    library's merges are then made on each part of a word by itself. Other texts go to the library whole,
    and so do those that hold a special string.
    """

    # ASCII, Latin letters that stand for themselves when composed, common marks.
    _PLAIN = r"\A[\t\n\r -~¡-§©-«®-°±¶·»¿-ķĹ-ňŊ-ž–—‘-”•…€]*\z"

    def __init__(self, path: str, most: int = WORDS_KEPT):
        super().__init__(most)
        self.library = Tokenizer.from_file(path)
        split = json.loads(self.library.pre_tokenizer.__getstate__())["pretokenizers"][0]["pattern"]["Regex"]
        # All parts of words but runs of letters get white space around them, which leaves these by themselves.
        self.apart = f"({split.replace('[\\p{L}]+|', '')})"
        if self.apart == f"({split})":
            raise ValueError("The tokenizer does not split words as this encoder does")
        self.merge, self.ids_of = _merger(path)

    def text(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def learn(self, new: list[str]) -> tuple[list[list[int]], list[int]]:
        return [[self.ids_of[i] for i in self.merge(p.encode() + WORD_END)] if p else [] for p in new], [0] * len(new)

    def column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text ends."""
        if not len(column):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        column = column.cast(pa.large_string())
        plain = pc.and_(pc.match_substring_regex(column, self._PLAIN), pc.invert(pc.match_substring(column, "<|")))
        whole = ~plain.to_numpy(zero_copy_only=False)
        lowered = pc.utf8_lower(pc.if_else(plain, column, pa.scalar("", pa.large_string())))
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(lowered, self.apart, r" \1 "))
        ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        row = self.places(lists.flatten().dictionary_encode())
        if not whole.any():
            return self.laid_out(row, ends)
        # A text taken whole stands for the one empty word that was left of it.
        own = [self.text(column[i].as_py()) for i in np.flatnonzero(whole).tolist()]
        row[ends[whole] - 1] = len(self.known) + 1 + np.arange(len(own))
        return self.laid_out(row, ends, own)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker and vocabulary, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def width_of(path: str) -> int:
    """Bits that every id of a vocabulary fits."""
    return max(1, (Tokenizer.from_file(path).get_vocab_size() - 1).bit_length())


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and ids (with the end id) of every row, little-endian, of 16 bits where all ids of the vocabulary fit them, else of 32."""
    path = tokenizer_path(tokenizer)
    kind = np.dtype("<u2" if width_of(path) <= 16 else "<u4")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in together(batches):
            plain, ends = own.column(batch.column(1))
            ids = np.insert(plain, ends, END).astype(kind)
            offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * kind.itemsize
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), data.cast(pa.binary())], ["doc_id", "ids"])

    return texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(made, "doc_id long, ids binary")


def _files(width: int):
    """Files of whole documents, in the order they come; one is closed at SHARD ids."""
    kind = np.dtype("<u2" if width <= 16 else "<u4")
    types = {"part": pa.int32(), "seq": pa.int32(), "n_ids": pa.int64(), "doc_ids": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "data": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids: list = []
        parts: list[np.ndarray] = []
        size, seq, part = 0, 0, 0

        def file() -> pa.RecordBatch:
            ends = np.cumsum([len(p) for p in parts])
            data = WaveletMatrix.pack(np.concatenate(parts), width)
            row = {"part": part, "seq": seq, "n_ids": int(ends[-1]), "doc_ids": doc_ids, "ends": ends.tolist(), "data": data}
            return pa.RecordBatch.from_arrays([pa.array([row[c]], t) for c, t in types.items()], list(types))

        for batch in batches:
            for part, doc_id, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B007
                doc_ids.append(doc_id)
                parts.append(np.frombuffer(data, kind))
                size += len(parts[-1])
                if size >= SHARD:
                    yield file()
                    doc_ids, parts, size, seq = [], [], 0, seq + 1
        if parts:
            yield file()

    return run


def write_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER) -> None:
    """Encodes every whole text (null as empty) and writes files in ascending doc_id order to `path`.

    Partitions are ranges of doc_id, so part and seq order the files; null ids come
    first, rows of one id together in any order.
    """
    made = stored(encoded(docs, tokenizer), "token-ids", compression="zstd")
    ordered = made.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"))
    ordered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "ids")
    ordered.mapInArrow(_files(width_of(tokenizer_path(tokenizer))), FILE).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            ids = WaveletMatrix.from_bytes(row["data"].as_buffer()).all().astype("<u4")
            ends = row["ends"].values.to_numpy()
            starts = np.concatenate([[0], ends[:-1]])
            crcs = [crc(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            columns = [row["doc_ids"].values, starts + row["before"].as_py(), ends - starts, crcs]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names)


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in files.

    A file's place is the sum of ids before it: of its part's earlier files, and of the
    earlier parts, of which there is one row each. Places, a row for each file, are
    written first: their size is then known, and where it is small the files, which are
    large, stay where they are.
    """
    sizes = files.select("part", "seq", "n_ids")
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("whole"))
    earlier = parts.select("part", (F.sum("whole").over(Window.orderBy("part")) - F.col("whole")).alias("earlier"))
    places = sizes.withColumn("inside", inside).join(earlier, "part").select(
        "part", "seq", (F.col("inside") + F.col("earlier")).alias("before")
    )
    rows = files.join(stored(places.coalesce(1), "file-places"), ["part", "seq"]).select("doc_ids", "ends", "data", "before")
    return rows.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Writes the files to the shared folder and reads every document back from them."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_files(docs, path, tokenizer)
    return read_documents(spark.read.schema(FILE).parquet(path))
