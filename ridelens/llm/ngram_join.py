"""Near duplicates: an n-gram Jaccard join with Bayesian pruning of candidates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from math import comb
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.components import components
from ridelens.llm.shared import stored, texts
from ridelens.llm.words import fold, mix, shingles

SIZE, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 5  # a pair at the threshold shares no band once in eight million
STEP, TOLERANCE = 20, 1e-9  # values compared at a time; least posterior to go on
BLOCK = 256  # members of a candidate group compared at once
COLUMNS = 4096  # shingles of a block multiplied at once


# --- MinHash --------------------------------------------------------------------------
def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = np.arange(1, n + 1, dtype=np.uint64)
    return mix(seeds * np.uint64(0xD1342543DE82EF95)) | np.uint64(1), mix(seeds * np.uint64(0xA0761D6478BD642F))


_FACTORS = _factors(BANDS * ROWS)


_SCRATCH = np.empty((256, BANDS * ROWS), np.uint64)  # one for all texts, as large memory is given back when freed


def minhash(rows: np.ndarray) -> np.ndarray:
    """The least value of each hash function; long sets in blocks that stay in a processor's cache."""
    times, plus = _FACTORS
    least = np.full(len(times), np.iinfo(np.uint64).max)
    for i in range(0, len(rows), len(_SCRATCH)):
        block = rows[i : i + len(_SCRATCH), None]
        values = np.multiply(block, times, out=_SCRATCH[: len(block)])
        values += plus
        np.minimum(least, values.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(values: np.ndarray) -> np.ndarray:
    """A key for each band of each row of MinHash values; equal values of different bands have different keys."""
    bands = values.reshape(-1, BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2])
    for i in range(ROWS):
        keys = fold(keys, bands[:, :, i])
    return keys.view(np.int64)


def least_agreeing(compared: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest agreeing values of so many with which a pair may still reach the threshold.

    From a uniform prior, the posterior chance that the similarity reaches t after m of n
    values agree is that of at most m successes in n + 1 trials of chance t.
    """
    chance = 0.0
    for m in range(compared + 1):
        chance += comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if chance >= tolerance:
            return m
    return compared


# --- candidates -----------------------------------------------------------------------
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets, values = [], []
        for text in batch.column("text").to_pylist():
            own = shingles(text, SIZE)
            sets.append(xxhash.xxh3_128_digest(own) if len(own) else None)
            if len(own):
                values.append(minhash(own))
        sets = pa.array(sets, pa.binary())
        keys = band_keys(np.array(values, np.uint32).reshape(-1, BANDS * ROWS))
        none = sets.is_null()
        ends = np.cumsum(~none.to_numpy(zero_copy_only=False)) * BANDS
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        bands = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()), mask=none)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sets, bands], ["doc_id", "own_set", "bands"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, a digest of its set of shingles (null without words), and its band keys."""
    return texts(docs).mapInArrow(_sketch, "doc_id long, own_set binary, bands array<long>")


def candidate_groups(sets: DataFrame) -> DataFrame:
    """node and component for every set that shares a band key with another; sets: node, bands.

    Each set is tied to the least one with the same key instead of to all others. Of its
    least ones, at most one for each band, the very least is its hub: the set and the
    others are tied to that, so that a large group has few ties for each set.
    """
    keys = sets.select("node", F.explode("bands").alias("key"))
    least = keys.groupBy("key").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "b")
    ties = keys.join(least, "key").groupBy("node").agg(F.collect_set("b").alias("least"), F.min("b").alias("b"))
    ties = ties.select(F.explode(F.array_union("least", F.array("node"))).alias("a"), "b").where("a != b").distinct()
    return components(ties)


# --- comparison -----------------------------------------------------------------------
def similar_pairs(left: list[np.ndarray], right: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs that reach the threshold; with right None, pairs i < j of left.

    MinHash values are compared some at a time. A pair goes on while its posterior chance
    to reach the threshold is not below the tolerance; what is left is counted exactly.
    """
    a = np.stack([minhash(s) for s in left])
    b = a if right is None else np.stack([minhash(s) for s in right])
    sizes_a = np.array([len(s) for s in left])
    sizes_b = sizes_a if right is None else np.array([len(s) for s in right])
    # A pair of too different sizes cannot reach the threshold.
    ratio = np.minimum(sizes_a[:, None], sizes_b) / np.maximum(sizes_a[:, None], sizes_b)
    alive = ratio >= THRESHOLD - 1e-12
    if right is None:
        alive &= np.tri(len(a), k=-1, dtype=bool).T
    i, j = np.nonzero(alive)
    agreeing = np.zeros(len(i), np.int64)
    for start in range(0, a.shape[1], STEP):
        part = slice(start, start + STEP)
        agreeing += (a[i, part] == b[j, part]).sum(axis=1)
        on = agreeing >= _LEAST[start // STEP]
        i, j, agreeing = i[on], j[on], agreeing[on]
    if not len(i):
        return i, j
    common = shared_counts([left[k] for k in np.unique(i)], [(left if right is None else right)[k] for k in np.unique(j)])
    common = common[np.searchsorted(np.unique(i), i), np.searchsorted(np.unique(j), j)]
    reach = common >= THRESHOLD * (sizes_a[i] + sizes_b[j] - common) - 1e-9
    return i[reach], j[reach]


_LEAST = [least_agreeing(n) for n in range(STEP, BANDS * ROWS + 1, STEP)]


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of left shares with each of right, as products of 0/1 matrices."""
    known, of_left = np.unique(np.concatenate(left), return_inverse=True)
    flat = np.concatenate(right)
    of_right = np.searchsorted(known, flat)
    found = known[np.minimum(of_right, len(known) - 1)] == flat
    row_l = np.repeat(np.arange(len(left)), [len(s) for s in left])
    row_r = np.repeat(np.arange(len(right)), [len(s) for s in right])[found]
    of_right = of_right[found]
    # Only shingles of both sides count: they get the matrix' columns.
    used, of_right = np.unique(of_right, return_inverse=True)
    place = np.searchsorted(used, of_left)
    keep = used[np.minimum(place, len(used) - 1)] == of_left if len(used) else np.zeros(len(of_left), bool)
    row_l, of_left = row_l[keep], place[keep]
    counts = np.zeros((len(left), len(right)), np.float64)
    for start in range(0, len(used), COLUMNS):
        x = np.zeros((len(left), COLUMNS), np.float32)
        y = np.zeros((len(right), COLUMNS), np.float32)
        for matrix, rows, columns in ((x, row_l, of_left), (y, row_r, of_right)):
            inside = (columns >= start) & (columns < start + COLUMNS)
            matrix[rows[inside], columns[inside] - start] = 1
        counts += x @ y.T
    return counts.astype(np.int64)


def _links(key: tuple, members: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int, int]]:
    """(node, a linked node, number of links) for members (side, node, shingles) of two blocks or one.

    For each node one partner is enough to tie it to its class: of each tree of linked
    members, ties lead to one root.
    """
    first = [m for m in members if m[0] == key[1]]
    second = [m for m in members if m[0] == key[2]] if key[1] != key[2] else None
    if not first or second == [] or second is None and len(first) < 2:
        return
    i, j = similar_pairs([m[2] for m in first], None if second is None else [m[2] for m in second])
    nodes = [m[1] for m in first] + [m[1] for m in second or ()]
    j = j if second is None else j + len(first)
    degree = np.bincount(np.concatenate([i, j]), minlength=len(nodes))
    root = np.arange(len(nodes))
    while len(i):  # least places spread along the pairs found until nothing changes
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (before == root).all():
            break
    for k in np.flatnonzero(degree).tolist():
        yield nodes[k], nodes[root[k]], int(degree[k])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, group in groupby(rows, itemgetter(0, 1, 2)):
        # Repeated rows of a document are one member.
        different = dict.fromkeys((side, node, data) for *_, side, node, data in group)
        members = [(side, node, np.frombuffer(data, np.uint64)) for side, node, data in different]
        if found := list(_links(key, members)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b", "n"])


def _shingle_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text replaced by its shingles; other columns stay."""
    for batch in batches:
        data = [shingles(text, SIZE).tobytes() for text in batch.column("text").to_pylist()]
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "data", pa.array(data, pa.binary()))


def links(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b, n: sets of a group that reach the threshold with others, n times in a pair of blocks.

    sets: node and text of one document for each set. A large group is cut into blocks by
    a hash; every pair of blocks is a unit of work of its own, so that no group meets in
    one task, and only counts and ties leave it, not pairs.
    """
    size = groups.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    placed = groups.join(size, "component").select(
        "node", "component", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("side")
    )
    # The chosen sets grow with the corpus: they are never sent to all machines.
    chosen = placed.hint("merge").join(sets, "node").select("component", "node", "side", "blocks", "text")
    data = chosen.mapInArrow(_shingle_bytes, "component long, node long, side int, blocks int, data binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = data.select("component", "node", "side", "data", other)
    keys = ["component", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")]
    units = units.select(*keys, "side", "node", "data")
    dealt = units.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return dealt.mapInArrow(_compare, "a long, b long, n long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, n_links and n_copies of every row.

    Similarity is Jaccard's of the sets of five-word shingles (words in lower case, cut
    at white space; a text of fewer words is one shingle); pairs from 0.8 on are linked.
    Documents with equal sets are copies: they share one class and its links, and n_links
    counts the linked sets other than their own. A class holds what links join, and is
    named by its largest doc_id. A text without words, null among them, is linked to
    nothing. Rows with a null id are left out, as links are told by ids; a repeated id
    counts as one document, whose texts all count.
    """
    own = stored(sketches(docs.where("doc_id is not null")), "sketches")
    sets = own.where("own_set is not null").groupBy("own_set").agg(
        F.max("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands")
    )
    sets = stored(sets, "sets")
    groups = candidate_groups(sets)
    text = texts(docs).withColumnRenamed("doc_id", "node")
    found = stored(links(text, groups), "links")
    classes = components(found)
    degrees = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    by_set = (
        sets.select("own_set", "node", "copies")
        .join(classes, "node", "left")
        .join(degrees, "node", "left")
        .select("own_set", "node", "copies", F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    names = by_set.groupBy("component").agg(F.max("node").alias("class_id"), F.sum("copies").alias("class_size"))
    by_set = by_set.join(names, "component").select("own_set", "class_id", "class_size", "n_links", F.col("copies").alias("n_copies"))
    return own.select("doc_id", "own_set").join(by_set, "own_set", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
    )
