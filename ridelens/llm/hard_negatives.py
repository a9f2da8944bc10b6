"""Hard negatives: rows of another label that score just below an anchor's best rows of its own label."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelens.llm.shared import stored
from ridelens.llm.strassen import product

ANCHORS, CANDIDATES = 1024, 2048  # rows of a tile
SCALE, LARGEST = 256, 2.0**56  # of scores, so that a hundred times one is an int64


def vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label and the whole-numbered vector q of the rows that take part.

    Left out are rows with a null id, label or vector, or a null or non-finite component.
    Shorter vectors are padded with zeros. Exact repeats of a row are one row, and of
    different rows of one id the least by label and vector stays. A vector so long
    that scores might not fit raises an error.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    q = F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")).cast("long"))
    size = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(SCALE * x.cast("double") + 1, 2))
    fits = F.when(size < LARGEST, F.lit(True)).otherwise(F.raise_error(F.lit("A vector is too long for scores in 64 bits")))
    taking = rows.where("vec_id is not null and label is not null and embedding is not null").where(whole).where(fits)
    ids = taking.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), q.alias("q"))
    ids = stored(ids.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("row")).select("vec_id", "row.*"), "vectors")
    widest = ids.agg(F.max(F.size("q"))).scalar()
    return ids.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("long"), widest - F.size("q"))))


@dataclass
class Heap:
    """The best `k` of each key: highest score first, then smallest id. Two heaps merge to one."""

    k: int
    key: np.ndarray
    score: np.ndarray
    vec_id: np.ndarray

    @classmethod
    def empty(cls, k: int) -> Heap:
        return cls(k, *(np.zeros(0, np.int64) for _ in range(3)))

    def merge(self, key: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        key, score, vec_id = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.vec_id, vec_id)))
        order = np.lexsort((vec_id, -score, key))
        key = key[order]
        first = np.searchsorted(key, key, "left")
        order = order[np.arange(len(key)) - first < self.k]
        self.key, self.score, self.vec_id = np.sort(key[np.arange(len(key)) - first < self.k]), score[order], vec_id[order]

    def least(self, n: int) -> np.ndarray:
        """For keys 0 to n - 1, the score a row needs to come in; the lowest of all where there is room."""
        made = np.full(n, np.iinfo(np.int64).min)
        full, counts = np.unique(self.key, return_counts=True)
        last = np.searchsorted(self.key, full, "right") - 1
        made[full[counts == self.k]] = self.score[last[counts == self.k]]
        return made


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    q = batch.column("q")
    return q.flatten().to_numpy().reshape(len(q), -1)


@dataclass
class Tile:
    """Rows that stand in one matrix."""

    vec_id: np.ndarray
    label: np.ndarray
    q: np.ndarray
    positives: list

    @classmethod
    def of(cls, batches: list[pa.RecordBatch]) -> Tile:
        whole = pa.concat_batches(batches)
        return cls(whole.column("vec_id").to_numpy(), whole.column("label").to_numpy(), _matrix(whole), whole.column("positives").to_pylist())


def _positives(k: int):
    """Heaps of the best rows of the anchor's own label, the anchor itself left out."""

    def start(anchors: Tile) -> Heap:
        return Heap.empty(k)

    def add(heap: Heap, anchors: Tile, rows: Tile, scores: np.ndarray) -> None:
        hit = (anchors.label[:, None] == rows.label) & (anchors.vec_id[:, None] != rows.vec_id) & (scores >= heap.least(len(scores))[:, None])
        i, j = np.nonzero(hit)
        heap.merge(i, scores[i, j], rows.vec_id[j])

    def end(heap: Heap, anchors: Tile) -> dict:
        return {"anchor_id": anchors.vec_id[heap.key], "vec_id": heap.vec_id, "score": heap.score}

    return start, add, end


def _negatives(k: int, most: int, low: int, high: int):
    """Heaps of rows of another label by anchor and positive, in the window below the positive's score.

    The key is the anchor's row times `most` plus the positive's place.
    """

    def start(anchors: Tile) -> Heap:
        heap = Heap.empty(k)
        heap.wanted = np.array([(i, p, row["score"]) for i, own in enumerate(anchors.positives) for p, row in enumerate(own)], np.int64).reshape(-1, 3)
        lowest, highest = np.full(len(anchors.vec_id), np.iinfo(np.int64).max), np.full(len(anchors.vec_id), np.iinfo(np.int64).min)
        np.minimum.at(lowest, heap.wanted[:, 0], -(-low * heap.wanted[:, 2] // high))
        np.maximum.at(highest, heap.wanted[:, 0], heap.wanted[:, 2])
        heap.window = lowest, highest
        return heap

    def add(heap: Heap, anchors: Tile, rows: Tile, scores: np.ndarray) -> None:
        lowest, highest = heap.window
        i, j = np.nonzero((anchors.label[:, None] != rows.label) & (scores >= lowest[:, None]) & (scores <= highest[:, None]))
        found = scores[i, j]
        for p in range(most):
            wanted = np.full(len(anchors.vec_id), -1, np.int64)  # no score lies between 0.8 of it and itself
            at = heap.wanted[heap.wanted[:, 1] == p]
            wanted[at[:, 0]] = at[:, 2]
            hit = (low * wanted[i] <= high * found) & (found <= wanted[i])
            heap.merge(i[hit] * most + p, found[hit], rows.vec_id[j[hit]])

    def end(heap: Heap, anchors: Tile) -> dict:
        own = [anchors.positives[key // most][key % most] for key in heap.key.tolist()]
        return {
            "anchor_id": anchors.vec_id[heap.key // most],
            "positive_id": [p["vec_id"] for p in own],
            "positive_score": [p["score"] for p in own],
            "vec_id": heap.vec_id,
            "score": heap.score,
        }

    return start, add, end


def _streamed(heaps: tuple[Callable, Callable, Callable]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come by cell of the grid, anchors before candidates; one tile of each and a cell's heap are held."""
    start, add, end = heaps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, anchors, heap = None, {True: [], False: []}, None, None

        def multiply():
            nonlocal anchors, heap
            if waiting[True]:
                anchors, waiting[True] = Tile.of(waiting[True]), []
                heap = start(anchors)
            if waiting[False]:
                rows, waiting[False] = Tile.of(waiting[False]), []
                if anchors is not None:
                    add(heap, anchors, rows, product(anchors.q, np.ascontiguousarray(rows.q.T)))

        def made():
            multiply()
            if anchors is not None and len(heap.key):
                yield pa.RecordBatch.from_pydict({name: pa.array(values, pa.int64()) for name, values in end(heap, anchors).items()})

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("tile", "part")] + [batch.column("is_anchor").to_numpy(zero_copy_only=False)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                here, is_anchor = tuple(keys[:2, a].tolist()), bool(keys[2, a])
                if here != cell:
                    yield from made()
                    cell, anchors, heap = here, None, None
                waiting[is_anchor].append(batch.slice(a, b - a))
                if not is_anchor and sum(w.num_rows for w in waiting[False]) >= CANDIDATES:
                    multiply()
        yield from made()

    return run


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _on_grid(anchors: DataFrame, rows: DataFrame, tiles: int, parts: int) -> DataFrame:
    """Every anchor tile meets every row once: rows go to all tiles, tiles to all parts of the rows."""
    columns = ("vec_id", "label", "q", "positives")
    left = anchors.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).alias("tile"), _each(parts).alias("part"), F.lit(True).alias("is_anchor"), *columns
    )
    right = rows.withColumn("positives", F.array().cast("array<struct<vec_id:bigint,score:bigint>>")).select(
        _each(tiles).alias("tile"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part"), F.lit(False).alias("is_anchor"), *columns
    )
    return left.unionByName(right).repartition("tile", "part").sortWithinPartitions("tile", "part", F.desc("is_anchor"))


def hard_negatives(
    embeddings: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows whose id `every` divides. They stand in tiles of about ANCHORS
    rows; each tile is multiplied with all rows, a tile of CANDIDATES at a time, in parts
    that different tasks work on. A part's heap is merged as its tiles come, and the
    heaps of the parts are merged by a window. This is done once for positives and,
    with their scores known, once for negatives with low * positive <= high * negative
    <= high * positive. Ties go to the smaller id; anchors without positives, and
    positives without negatives, have no rows.
    """
    rows = vectors(embeddings)
    anchors = rows.where(F.col("vec_id") % every == 0)
    n = anchors.count()
    tiles = max(1, -(-n // ANCHORS))
    parts = max(1, -(-2 * embeddings.sparkSession.sparkContext.defaultParallelism // tiles))

    nothing = F.array().cast("array<struct<vec_id:bigint,score:bigint>>")
    found = _on_grid(anchors.withColumn("positives", nothing), rows, tiles, parts).mapInArrow(
        _streamed(_positives(n_positives)), "anchor_id long, vec_id long, score long"
    )
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("place", place).where(F.col("place") <= n_positives)
    lists = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("own"))
    lists = stored(lists.select("anchor_id", F.transform("own", lambda p: F.struct(p["vec_id"], p["score"])).alias("positives")), "positives")

    with_positives = anchors.join(lists.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    found = _on_grid(with_positives, rows, tiles, parts).mapInArrow(
        _streamed(_negatives(n_negatives, n_positives, low, high)), "anchor_id long, positive_id long, positive_score long, vec_id long, score long"
    )
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n_negatives).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
