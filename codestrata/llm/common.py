"""Helpers shared by the corpus operators: lineage cuts, collision-free column names, word hashing over Arrow batches."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only a purely local session that names none gets a folder of its own; anywhere else that is an error, since
    a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there; its lineage ends here."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that a job wrote, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files and checkpoints of the rounds that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that clash with no column of ``df``, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def unit_hash(*columns: str) -> "F.Column":
    """A deterministic pseudo-random BIGINT of the columns, for bounded samples that every engine run repeats."""
    return F.xxhash64(*[F.col(c) for c in columns])


class WordHashes(dict):
    """bytes -> 64-bit hash, filled on demand and emptied when it has grown past ``limit`` words."""

    def __init__(self, limit: int = 1_000_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, over an array of uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: ASCII punctuation becomes a blank, capitals lose their case; bytes of other characters stay.
_FOLD = bytes(
    32 if (c < 128 and not chr(c).isalnum()) else ord(chr(c).lower()) if c < 128 else c for c in range(256)
)


def folded_words(text: str) -> list[bytes]:
    """Lower-cased words without ASCII punctuation, as UTF-8."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of one slice hold about ``most`` bytes; a longer text gets a slice of its own."""
    text = batch.column(batch.schema.get_field_index(column))
    sizes = np.zeros(len(text), np.int64)
    if len(text):
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(text), 0).to_numpy(zero_copy_only=False), np.int64)
    at, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += size
    if at < len(text):
        yield batch.slice(at)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType, nulls: np.ndarray | None = None) -> pa.Array:
    """A list array whose row i holds the next ``counts[i]`` of ``values``; null where ``nulls`` says so."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    mask = None if nulls is None or not nulls.any() else pa.array(nulls)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind), mask=mask)
