"""What the corpus operators share: tables, scratch tables, words and hashes.

Conventions of every operator in this subpackage:

* ids are integers; a row without an id keeps its own values and takes no part
  in any matching;
* rows that repeat an id with the same text are one document: each of them gets
  the same result;
* a null text has no words, lines or letters, just like an empty one;
* columns that an operator does not name pass through it untouched, whatever
  they are called; columns that it adds replace columns of the same name.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
_A, _B = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; one of our own only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="quillsift-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/quillsift/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "t") -> DataFrame:
    """Writes df as a table in the shared folder and reads it: later jobs neither recompute it nor depend on any executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table made by cut() that nothing reads any more."""
    spark = df.sparkSession
    base = f"{shared_folder(spark)}/quillsift/"
    for f in df.inputFiles()[:1]:
        folder = f.rsplit("/", 1)[0]
        if "/quillsift/" in folder and base.split("://")[-1].lstrip("/") in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Has the driver drop what nothing refers to any more: the shuffle files of finished jobs stay on disk until it collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of a batch that goes to Python: texts are long, and a batch is held several times over on either side.
BATCH = 500


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows a batch, which bounds what an executor and its Python workers hold; a lower setting is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH:
        spark.conf.set(key, str(BATCH))


def same(a, b):
    return a.eqNullSafe(b)


def arrow_rows(df: DataFrame, schema: str, make: Callable[[list], Iterator[list]], flush: int = 400_000) -> DataFrame:
    """mapInArrow with plain code: make(rows of one batch) yields (weight, columns) pieces.

    make gets the batch's columns as Python lists and yields tuples of equally long
    sequences, one per column of schema; pieces are joined up to about flush rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def batch(held: list) -> pa.RecordBatch:
        cols = []
        for k, field in enumerate(out):
            parts = [p[k] for p in held]
            if isinstance(parts[0], np.ndarray):
                cols.append(pa.array(np.concatenate(parts), type=field.type))
            else:
                cols.append(pa.array([x for p in parts for x in p], type=field.type))
        return pa.RecordBatch.from_arrays(cols, schema=out)

    def run(batches):
        held, n = [], 0
        for b in batches:
            for piece in make([c.to_pylist() for c in b.columns]):
                if not len(piece[0]):
                    continue
                held.append(piece)
                n += len(piece[0])
                if n >= flush:
                    yield batch(held)
                    held, n = [], 0
        if held:
            yield batch(held)

    return df.mapInArrow(run, schema)


def text_bytes(name: str):
    """The whole text in UTF-8, as Python takes it without decoding."""
    return F.col(name).cast("string").cast("binary")


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype=">u8").astype(U)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * _A
    x = (x ^ (x >> U(29))) * _B
    return x ^ (x >> U(32))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; with fewer words, of the whole sequence; empty without words."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, U)
    h, k = word_hashes(words), min(k, n)
    acc = mixed(h[: n - k + 1] + U(k))
    for j in range(1, k):
        acc = mixed(acc * _A + h[j : n - k + 1 + j])
    return np.unique(acc)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U, copy=False).view(np.int64)


def fresh(df: DataFrame) -> str:
    """A prefix that no column of df has."""
    p = "__"
    while any(c.lower().startswith(p) for c in df.columns):
        p += "_"
    return p


def replaced(docs: DataFrame, text_col: str, chars_col: str | None, p: str) -> list:
    """The columns of docs, with p's new for the text and, where the text changed, its length for chars_col."""
    new, cols = F.col(p + "new"), []
    for c in docs.columns:
        if c == text_col:
            cols.append(new.alias(c))
        elif c == chars_col:
            cols.append(F.when(new.eqNullSafe(F.col(text_col)), F.col(c)).otherwise(F.length(new).cast(docs.schema[c].dataType)).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return cols
