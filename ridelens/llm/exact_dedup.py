"""Exact duplicates by an exchange of Golomb-coded fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.shared import stored, union_all

BITS = 48  # of a fingerprint: among n texts, one in 2**48 / n is suspected without cause
BATCH = 8  # rows to a batch; the exchange moves a hundred batches at a time
OWNERS, OWNED = 65_536, 100_000  # owners at most, rows for each; no more owners than partitions

MARKED = "doc_id long, text_sha256 string, suspect binary"


def normalised(text: bytes) -> bytes:
    """UTF-8 with A-Z in lower case and nothing else changed."""
    return text.lower()


def fingerprint(text: bytes, bits: int = BITS) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 64 - bits


# --- sorted numbers as Golomb code ----------------------------------------------------


def golomb_encode(values: np.ndarray, top: int) -> tuple[int, int, bytes, bytes]:
    """Count, width, quotients and remainders of the gaps of ascending values below `top`.

    The divisor is the power of two next to the mean gap. Quotients are unary (each ends
    with a 1), remainders have `width` bits each; two streams, so that both are read at once.
    """
    n = len(values)
    width = max(int(top // max(n, 1)).bit_length() - 1, 0)
    gaps = np.diff(values, prepend=np.uint64(0))
    ends = np.cumsum((gaps >> np.uint64(width)).astype(np.int64) + 1)
    unary = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    unary[ends - 1] = 1
    places = np.arange(width, dtype=np.uint64)
    rest = (gaps[:, None] >> places & np.uint64(1)).astype(np.uint8)
    return n, width, np.packbits(unary).tobytes(), np.packbits(rest.ravel()).tobytes()


def golomb_decode(code: tuple[int, int, bytes, bytes]) -> np.ndarray:
    n, width, unary, rest = code
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
    places = np.arange(width, dtype=np.uint64)
    bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * width).reshape(n, width).astype(np.uint64)
    return np.cumsum((quotients << np.uint64(width)) + (bits << places).sum(axis=1, dtype=np.uint64), dtype=np.uint64)


# --- the exchange ---------------------------------------------------------------------


def _batches(rows: Iterator) -> Iterator[list]:
    """doc_id, normalised text and fingerprint of each row, some rows at a time."""
    made = ((doc_id, own := normalised(bytes(text)), fingerprint(own)) for doc_id, text in rows)
    while batch := list(islice(made, BATCH)):
        yield batch


def _send(sender: int, rows: Iterator, owners: int) -> Iterator[tuple]:
    """To each owner of a range of fingerprints the sender's own ones: each once, in order, with a bit for more than once."""
    hashes: list[np.ndarray] = []
    for batch in _batches(rows):
        hashes.append(np.array([h for _, _, h in batch], np.uint64))
    if not hashes:
        return
    values, counts = np.unique(np.concatenate(hashes), return_counts=True)
    bounds = np.searchsorted(values, np.array([_lowest(i, owners) for i in range(owners + 1)], np.uint64))
    for owner in np.flatnonzero(np.diff(bounds)).tolist():
        part = slice(bounds[owner], bounds[owner + 1])
        lowest = _lowest(owner, owners)
        code = golomb_encode(values[part] - np.uint64(lowest), _lowest(owner + 1, owners) - lowest)
        yield owner, (sender, len(hashes), lowest, code, np.packbits(counts[part] > 1).tobytes())


def _lowest(owner: int, owners: int) -> int:
    """The least fingerprint of an owner's range."""
    return -(-(owner << BITS) // owners)


def _answer(messages: Iterator[tuple]) -> Iterator[tuple]:
    """Each message back with a bitmap: which of its fingerprints occur more than once, here or elsewhere.

    All messages of a partition are one owner's.
    """
    got = [message for _, message in messages]
    if not got:
        return
    values = [golomb_decode(code) for *_, code, _ in got]
    seen, senders = np.unique(np.concatenate(values), return_counts=True)
    common = senders > 1
    for own, (sender, batches, lowest, code, twice) in zip(values, got, strict=True):
        shared = common[np.searchsorted(seen, own)]
        several = np.unpackbits(np.frombuffer(twice, np.uint8), count=len(own)).astype(bool)
        yield sender, (batches, lowest, code, np.packbits(shared | several).tobytes())


def _inbox(replies: Iterator[tuple]) -> Iterator[np.ndarray | None]:
    """The suspected fingerprints, then a None for each further batch of the sender's."""
    batches, found = 0, []
    for _, (batches, lowest, code, bitmap) in replies:  # noqa: B007
        values = golomb_decode(code)
        bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(values)).astype(bool)
        found.append(values[bits] + np.uint64(lowest))
    if batches:
        yield np.concatenate(found)
        yield from repeat(None, batches - 1)


def _mark(pairs: Iterator[tuple]) -> Iterator[tuple]:
    """Every row's digest, and the text as well where its fingerprint is suspected."""
    suspects: set[int] = set()
    for batch, found in pairs:
        if found is not None:
            suspects = set(found.tolist())
        for doc_id, text, own in batch:
            yield doc_id, hashlib.sha256(text).hexdigest(), text if own in suspects else None


def marked(docs: DataFrame, owners: int = OWNERS) -> DataFrame:
    """doc_id, text_sha256, and in `suspect` the normalised text of rows that may have equals.

    Two passes over the partitions of one RDD. Its partitions are laid out once, so a
    sender finds its own rows again, also when an executor was lost and another one
    reads them.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary")).rdd
    senders = rows.getNumPartitions()
    owners = max(1, min(owners, senders, -(-docs.count() // OWNED)))
    messages = rows.mapPartitionsWithIndex(lambda i, part: _send(i, part, owners))
    replies = messages.partitionBy(owners, int).mapPartitions(_answer)
    inbox = replies.partitionBy(max(senders, 1), int).mapPartitions(_inbox)
    batches = rows.mapPartitions(_batches)
    if (more := inbox.getNumPartitions() - senders) > 0:
        batches = batches.union(spark.sparkContext.parallelize([], more))
    pairs = batches.zip(inbox).mapPartitions(_mark)
    return spark.createDataFrame(pairs, MARKED, verifySchema=False)


def exact_duplicates(docs: DataFrame, owners: int = OWNERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Texts are equal if they are after lower-casing A-Z; null counts as empty. The row
    with the largest doc_id stays; a null id is smaller than any other. Repeated rows of
    that id are all kept, and every row counts in group_size. Only texts whose
    fingerprint occurs twice are shuffled, and grouped by all their bytes: one row for
    each task and text, however many copies there are.
    """
    rows = stored(marked(docs, owners), "exact-dedup")
    alone = rows.where("suspect is null").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256"
    )
    groups = rows.where("suspect is not null").groupBy("suspect").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    groups = groups.select(F.sha2("suspect", 256).alias("text_sha256"), "keep_id", "group_size")
    copies = rows.where("suspect is not null").select("doc_id", "text_sha256").join(groups, "text_sha256")
    return union_all([alone, copies.select(*alone.columns)]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
