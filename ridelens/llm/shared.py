"""What the operators share: the tables, written intermediate tables, memos."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

tokenizer_path = public_tokenizers.path


BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20  # that go to Python at once: texts may be long, and two tasks share an executor's memory


# Python workers give freed memory back at once: idle ones stay beside those at work.
LEAN = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_TRIM_THRESHOLD_": "1048576"}


def prepare(spark: SparkSession) -> None:
    """Keeps batches for Python small, and lets Python workers on this machine import the package.

    On a cluster the package is installed or sent along (``--py-files``).
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    # As RDD code has it: Python workers are shared only among code with equal settings,
    # and idle ones of another kind hold memory.
    spark.conf.set("spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled", "false")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name, value in (("PYTHONPATH", root), *LEAN.items()):
        spark.sparkContext.environment.setdefault(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text, null as empty; every other column is left out."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share, as the session names it.

    A session on one machine may name none and gets a local one; any other would lose rows
    that machines write where others do not see them, so it has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The same rows from a table written to the shared folder: what comes next does not depend on their lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(name: str, df: DataFrame) -> str:
    """A column name like the given one that a table does not have, however it spells its own."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(doc_id: str = "doc_id"):
    """Rows no model learns from: crc32 of the id as text leaves 2 by 4. A null id is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Memo(dict):
    """Values by key, each made once; emptied when full, so that its memory is bounded."""

    def __init__(self, make: Callable, most: int, longest: int = 64):
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if not isinstance(key, str | bytes) or len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


_after_space = re.compile(r" (?<=\s )")
_cut = re.compile(r"(?<=\S) ")


def units(text: str) -> list[str]:
    """Cuts a text at every space that follows a character that is no space.

    The space itself is left out: every unit but the first stands for itself with a
    space before it. A space after another character always begins a match of the
    pattern of byte-level tokenizers, so that no match reaches across a cut.
    """
    return _cut.split(text) if _after_space.search(text) else text.split(" ")


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    first, *rest = frames
    for df in rest:
        first = first.unionByName(df)
    return first
