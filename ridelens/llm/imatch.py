"""Document fingerprints by I-Match: hashes of the terms of a band of rarity, for several random lexicons."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import islice, pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ridelens.llm.shared import stored, texts, union_all
from ridelens.llm.words import mix

LOWEST, HIGHEST = 3, 0.02  # band of terms: documents that have one at least, and share of documents at most
KEPT = 1 << 20  # terms of the band that are sent to all machines, the most frequent; others are looked up by a join
COUNTED = 1 << 20  # occurrences that are counted together before they leave a task
# Each random lexicon holds a term with this chance: small lexicons for documents of many
# terms, large ones for those of few.
EACH = 6  # lexicons of a size
SHARES = tuple(1 / 2**e for e in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10) for _ in range(EACH))
BLOCKS = 512  # of neighbouring documents, at least; more for larger tables
BLOCK_ROWS = 20_000

# Which code points make terms, as \w has it, and the bytes of ASCII in lower case with spaces for those that do not.
_in_term = np.strings.isalnum(np.arange(0x110000, dtype=np.uint32).view("U1"))
_in_term[ord("_")] = True
_ascii = bytes(ord(chr(i).lower()) if i < 128 and _in_term[i] else ord(" ") for i in range(256))


def _split(text: str) -> list[bytes] | list[str]:
    """The terms of a text in order: longest runs of letters, digits and underscores, in lower case.

    All else becomes spaces at once and the text is cut there, which takes half the time of a pattern.
    """
    if text.isascii():
        return text.encode().translate(_ascii).split()
    data = bytearray(text.lower().encode("utf-32-le", "surrogatepass"))
    points = np.frombuffer(data, "<u4")
    points[~_in_term[points]] = ord(" ")
    return data.decode("utf-32-le").split()


def terms(text: str) -> np.ndarray:
    """Numbers of the distinct terms of a text (in lower case), ascending.

    Hashed each time: texts have so many different terms that it is cheaper than to remember them.
    """
    found = set(_split(text))
    numbers = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    numbers.sort()
    return numbers


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by term, added up over many texts."""

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(parts).view(np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["term", "n"])

    parts, size = [], 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            parts.append(terms(text))
            size += len(parts[-1])
            if size >= COUNTED:
                yield counted(parts)
                parts, size = [], 0
    if parts:
        yield counted(parts)


class Lexicon(NamedTuple):
    """The terms of the band as a table; the most frequent of them, and those too frequent, as sorted numbers.

    Where `whole`, no term of the band is only in the table.
    """

    table: DataFrame
    inside: np.ndarray
    above: np.ndarray
    whole: bool


def _sorted_terms(df: DataFrame) -> np.ndarray:
    numbers = df.select("term").toArrow().column("term").to_numpy().astype(np.int64).view(np.uint64)
    return np.sort(numbers)


def lexicon(docs: DataFrame, lowest: int = LOWEST, highest: float = HIGHEST) -> Lexicon:
    """Document frequencies of all terms over all texts, and the band: `lowest` documents to the share `highest` of them.

    A term above the share is in so many documents that there are few: at most the mean
    number of terms of a document over the share. At most KEPT come to the driver of either kind.
    """
    most = highest * docs.count()
    counts = texts(docs).mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = stored(counts.where(F.col("n") >= lowest), "imatch-terms")
    band, above = counts.where(F.col("n") <= most), counts.where(F.col("n") > most)
    first = (F.desc("n"), "term")
    whole = band.count() <= KEPT
    inside = _sorted_terms(band if whole else band.orderBy(*first).limit(KEPT))
    return Lexicon(band.select("term"), inside, np.zeros(0, np.uint64) if whole else _sorted_terms(above.orderBy(*first).limit(KEPT)), whole)


def among(numbers: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which numbers are among the known ones, which are sorted."""
    if not len(known):
        return np.zeros(len(numbers), bool)
    return known[np.minimum(np.searchsorted(known, numbers), len(known) - 1)] == numbers


# --- fingerprints ---------------------------------------------------------------------
_seeds = mix(np.arange(1, len(SHARES) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_limits = np.array([int(s * 2**64) for s in SHARES], np.uint64)


def fingerprint(numbers: np.ndarray, inside: np.ndarray) -> str:
    """For each random lexicon the hash of the sorted distinct terms of the band in it; dots for none.

    Where no term is in the band, all terms take their place.
    """
    chosen = numbers[among(numbers, inside)]
    return printed(chosen if len(chosen) else numbers)


def printed(chosen: np.ndarray) -> str:
    n = len(chosen)
    member = np.flatnonzero(mix(chosen ^ _seeds[:, None]) < _limits[:, None])  # lexicon after lexicon
    own = chosen[member % max(n, 1)].tobytes()
    ends = (8 * np.searchsorted(member, np.arange(len(SHARES) + 1) * n)).tolist()
    return "".join(xxhash.xxh3_64_hexdigest(own[a:b])[:6] if b > a else "......" for a, b in pairwise(ends))


def likeness(a: str, b: str) -> float:
    """Share of equal hashes among the lexicons in which either has a term; 1 for equal fingerprints.

    Only sizes of lexicon count of which some is empty for one of the two, if there are
    any: these hold about one term of a text, so that their hashes are equal about as
    often as terms are shared. Larger ones hold many, and differ with any of them.
    """
    if a == b:
        return 1.0
    pairs = [(a[i : i + 6], b[i : i + 6]) for i in range(0, len(a), 6)]
    sizes = [pairs[i : i + EACH] for i in range(0, len(pairs), EACH)]
    small = [size for size in sizes if any("......" in pair for pair in size)]
    told = [x == y for size in small or sizes for x, y in size if (x, y) != ("......", "......")]
    return sum(told) / len(told) if told else 0.0


# --- edited texts ---------------------------------------------------------------------
def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many first ones of the following text, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame) -> DataFrame:
    """block, extra, doc_id and text, so that in each block, by descending doc_id, a row's next document follows.

    Ranges of ids make blocks. The first document of each block is sent to the block
    before it as well, as its last and `extra` row; that of the first block to the last.
    Only ids and one row for each block come to the driver.
    """
    rows = texts(docs.where("doc_id is not null"))
    ids = rows.select("doc_id")
    n = ids.count()
    blocks = min(max(BLOCKS, math.ceil(n / BLOCK_ROWS)), max(n // 16, 1), 50_000)
    cuts = ids.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], 10 * blocks)).first()[0] if blocks > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    # Block i holds ids down to cuts[i], the last one the rest.
    heads = ids.select(_block(cuts).alias("block"), "doc_id").groupBy("block").agg(F.max("doc_id").alias("head")).collect()
    heads = sorted((r.block, r.head) for r in heads)
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    spark = docs.sparkSession
    sent = spark.createDataFrame(sorted(before.items()), "doc_id long, block int")
    extra = rows.join(F.broadcast(sent), "doc_id").groupBy("block", "doc_id").agg(F.max("text").alias("text"))
    own = rows.select(_block(cuts).alias("block"), F.lit(False).alias("extra"), "doc_id", "text")
    return own.unionByName(extra.select("block", F.lit(True).alias("extra"), "doc_id", "text"))


def _block(cuts: list[int]):
    """Number of cuts above an id."""
    ascending = np.array(sorted(cuts), np.int64)

    @F.pandas_udf(IntegerType())
    def block(ids: pd.Series) -> pd.Series:
        return pd.Series(len(ascending) - np.searchsorted(ascending, ids.to_numpy(), side="right"), dtype="int32")

    return block("doc_id")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], types: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, 500)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types.values(), strict=True)], list(types))


def _print(known: Broadcast):
    def pairs(rows: Iterator[tuple]) -> Iterator[tuple]:
        """Each document with the next one; the last row of a block only follows others."""
        held = None
        for block, extra, doc_id, text in rows:
            if held is not None and held[0] == block:
                yield held[1], held[2], text
            held = None if extra else (block, doc_id, text)

    def told(rows: Iterator[tuple]) -> Iterator[tuple]:
        inside = known.value[0]
        last: tuple[str, str] | None = None
        for doc_id, text, following in pairs(rows):
            changed = edited(text, following)
            own = last[1] if last and last[0] == text else fingerprint(terms(text), inside)
            other = fingerprint(terms(changed), inside)
            last = (following, fingerprint(terms(following), inside))
            yield doc_id, len(text), _digest(changed), own, other, likeness(own, other), likeness(own, last[1])

    return lambda batches: _batches(told(_rows(batches)), NAMES)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


# --- where the lexicon does not fit one machine ----------------------------------------
PLACED = {
    "block": pa.int32(), "at": pa.int64(), "extra": pa.bool_(), "doc_id": pa.int64(), "n_chars": pa.int64(), "digest": pa.string(),
    "own": pa.binary(), "own_inside": pa.bool_(), "other": pa.binary(), "other_inside": pa.bool_(),
    "asked": pa.list_(pa.int64()), "asked_other": pa.list_(pa.int64()),
}
PLACED_SCHEMA = """block int, at long, extra boolean, doc_id long, n_chars long, digest string, own binary, own_inside boolean,
other binary, other_inside boolean, asked array<long>, asked_other array<long>"""


def _place(known: Broadcast):
    """Each row by its place in its block, with terms of the band that are known (all terms where none is), and those to ask for."""

    def split(text: str) -> tuple[bytes, bool, list[int]]:
        inside, above = known.value
        numbers = terms(text)
        found = among(numbers, inside)
        asked = numbers[~found & ~among(numbers, above)]
        return (numbers[found] if found.any() else numbers).tobytes(), bool(found.any()), asked.view(np.int64).tolist()

    def placed(rows: Iterator[tuple]) -> Iterator[tuple]:
        at, held = 0, None
        for block, extra, doc_id, text in rows:
            if held is not None and held[0] == block:
                yield made(*held, text)
                at += 1
            elif held is not None:
                yield made(*held, None)
            if held is None or held[0] != block:
                at = 0
            held = (block, at, extra, doc_id, text)
        if held is not None:
            yield made(*held, None)

    def made(block: int, at: int, extra: bool, doc_id: int, text: str, following: str | None) -> tuple:
        changed = edited(text, following or "")
        own, inside, asked = split(text)
        other, other_inside, asked_other = (b"", True, []) if extra else split(changed)
        return block, at, extra, doc_id, len(text), _digest(changed), own, inside, other, other_inside, asked, asked_other

    return lambda batches: _batches(placed(_rows(batches)), PLACED)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def whole(data: bytes, inside: bool, asked: list[int] | None) -> str:
        found = np.array(asked or [], np.int64).view(np.uint64)
        known = np.frombuffer(data, np.uint64)
        return printed(np.sort(np.concatenate([known, found])) if inside else np.sort(found) if len(found) else known)

    def told(rows: Iterator[tuple]) -> Iterator[tuple]:
        held = None
        for block, extra, doc_id, n_chars, digest, own, own_inside, other, other_inside, asked, asked_other in rows:
            mine = whole(own, own_inside, asked)
            if held is not None and held[0] == block:
                yield *held[1], likeness(held[1][3], mine)
            held = None
            if not extra:
                changed = whole(other, other_inside, asked_other)
                held = (block, (doc_id, n_chars, digest, mine, changed, likeness(mine, changed)))

    return _batches(told(_rows(batches)), NAMES)


def _joined(dealt: DataFrame, words: Lexicon, known: Broadcast) -> DataFrame:
    """The same fingerprints, where terms that are not sent to all machines are joined to the lexicon's table."""
    placed = stored(dealt.mapInArrow(_place(known), PLACED_SCHEMA), "imatch-placed")
    asked = [placed.select("block", "at", F.lit(i).alias("other"), F.explode(c).alias("term")) for i, c in enumerate(("asked", "asked_other"))]
    found = union_all(asked).join(words.table, "term").groupBy("block", "at")
    found = found.agg(*(F.collect_list(F.when(F.col("other") == i, F.col("term"))).alias(c) for i, c in enumerate(("asked", "asked_other"))))
    whole = placed.drop("asked", "asked_other").join(found, ["block", "at"], "left").repartition("block").sortWithinPartitions("block", "at")
    return whole.select(*(c for c in PLACED if c != "at")).mapInArrow(_finish, RESULT)


NAMES = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(),
}
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likenesses.

    A null text counts as empty; texts without a term have a fingerprint of dots, and
    are alike only to one another. The document with the largest id follows the one with
    the smallest, so a table of one row is followed by itself. Rows with a null id have
    no place in the order and are left out; rows of one id follow each other in the
    order of their texts.
    """
    words = lexicon(docs)
    rows = with_next(docs)
    dealt = rows.repartition("block").sortWithinPartitions("block", "extra", F.desc("doc_id"), "text")
    dealt = dealt.select("block", "extra", "doc_id", "text")
    known = docs.sparkSession.sparkContext.broadcast((words.inside, words.above))
    return dealt.mapInArrow(_print(known), RESULT) if words.whole else _joined(dealt, words, known)
