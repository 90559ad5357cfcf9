"""Token counts kept as delta-maintained rollups.

A rollup is additive totals (documents, tokens) by source, language and tokenizer version. Each
batch adds signed rows: an insert adds a document's counts, a delete takes them back, a revision
does both. A batch is summed by key before it is written, to a folder of the attempt, which is
renamed to the batch's name when it is whole and not if that is there: of two writers of a batch
one wins, on stores whose rename is atomic; elsewhere a batch must have one writer. Committing
an id that counts is a no-op, so a batch may be sent again after any failure, and an attempt that
failed half way never counts. totals() sums the committed batches; compact(), of which one may
run at a time, folds them into a snapshot that names the batches it holds, so a batch is never
counted twice. Only batch ids and markers pass through the driver.

Defined results: null sources, languages and versions are keys of their own; a null text has no
tokens but is a document; keys whose documents and tokens are all taken back vanish; repeated
rows count as often as they are sent; an empty batch commits and changes nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
#: Bytes of a tokenizer's vocabulary that may be broadcast.
MAX_VOCABULARY = 1 << 26
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

#: Tokenizer versions that are plain expressions: runs of non-blanks; runs of digits, a-z and characters beyond ASCII.
EXPRESSIONS: dict[str, Callable[[Column], Column]] = {
    "blank-1": lambda text: F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")),
    "alnum-1": lambda text: F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")),
}


def byte_bpe(spark: SparkSession, path: str, pattern: str) -> Callable[[Column], Column]:
    """Counts of a byte-level BPE whose ranks (base64 token, rank) are in the file at path, in any store that Spark reads; MAX_VOCABULARY bytes at most are broadcast."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    if size > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of {size} bytes is over the {MAX_VOCABULARY} that are broadcast")
    shared = spark.sparkContext.broadcast([bytes(r[0]) for r in spark.read.format("binaryFile").load(path).select("content").collect()])
    held: dict = {}

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if not held:
            import base64

            import tiktoken

            lines = [x.split() for content in shared.value for x in content.splitlines()]
            held["t"] = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})
        return pd.Series([0 if x is None else len(held["t"].encode_ordinary(x)) for x in texts], dtype="int64")

    return count


def counted(docs: DataFrame, version: str, tokenizer: Callable[[Column], Column] | None = None, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """One row per document: source, lang, tokenizer, n_docs = 1, n_tokens."""
    text = F.col(text_col).cast("string")
    n = (tokenizer or EXPRESSIONS[version])(text)
    return docs.select(F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.lit(version).alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"), F.coalesce(n, F.lit(0)).cast("long").alias("n_tokens"))


def counted_each(docs: DataFrame, versions: dict[str, Callable[[Column], Column] | None], text_col: str = "text", source_col: str = "source", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, source, lang, n (tokens by version); one pass over the texts counts for all later batches."""
    text = F.col(text_col).cast("string")
    n = [F.coalesce((tokenizer or EXPRESSIONS[version])(text), F.lit(0)).cast("long").alias(version) for version, tokenizer in versions.items()]
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.struct(*n).alias("n"))


def of_version(counts: DataFrame, version: str) -> DataFrame:
    """The rows of counted_each as counted gives them."""
    return counts.select("source", "lang", F.lit(version).alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"), F.col(f"n.`{version}`").alias("n_tokens"))


def inserted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, "n_docs", "n_tokens")


def deleted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    return deleted(before).unionByName(inserted(after))


class TokenRollup:
    """The rollup kept under path, in any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _committed(self, kind: str) -> list[str]:
        p, fs = self._fs(f"{self.path}/{kind}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n for n in names if self._is_committed(f"{self.path}/{kind}/{n}"))

    def _is_committed(self, folder: str) -> bool:
        p, fs = self._fs(f"{folder}/_SUCCESS")
        return bool(fs.exists(p))

    def batches(self) -> list[str]:
        return [n.removeprefix("b-") for n in self._committed("batches")]

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Adds the signed rows of deltas once; False if the batch had been committed."""
        if not re.fullmatch(r"[\w.-]{1,200}", batch_id):
            raise ValueError(f"a batch id is 1 to 200 letters, digits, '.', '_' and '-', not {batch_id!r}")
        folder = f"{self.path}/batches/b-{batch_id}"
        if self._is_committed(folder):
            return False
        attempt = f"{self.path}/attempts/{batch_id}-{uuid.uuid4().hex}"
        self._sums(deltas).write.parquet(attempt)
        p, fs = self._fs(f"{attempt}/_SUCCESS")
        if not fs.exists(p):  # where the writer is set not to mark
            fs.create(p).close()
        return self._put(attempt, folder)

    def _put(self, attempt: str, folder: str) -> bool:
        """Renames attempt to folder unless that is there: of two writers of one batch, one wins."""
        (src, fs), (dst, _) = self._fs(attempt), self._fs(folder)
        fs.mkdirs(dst.getParent())
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(src).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(fs.makeQualified(src), fs.makeQualified(dst), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError:
            if not self._is_committed(folder):
                raise
            fs.delete(src, True)
            return False
        return True

    def _sums(self, rows: DataFrame) -> DataFrame:
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def _held(self) -> tuple[list[str], set[str]]:
        """Folders that make the totals, and the batches in them."""
        snapshots, done = self._committed("snapshots"), set()
        folders = []
        if snapshots:
            last = f"{self.path}/snapshots/{snapshots[-1]}"
            done = {r[0] for r in self.spark.read.parquet(f"{self.path}/manifests/{snapshots[-1]}").collect()}
            folders.append(last)
        more = [b for b in self.batches() if b not in done]
        return folders + [f"{self.path}/batches/b-{b}" for b in more], done | set(more)

    def totals(self) -> DataFrame:
        return self._total(self._held()[0])

    def _total(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self._sums(self.spark.read.schema(SCHEMA).parquet(*folders))

    def compact(self) -> None:
        """Folds all that is committed into a new snapshot; its manifest is written first, so a snapshot that counts has one."""
        folders, held = self._held()
        if not folders:
            return
        name = f"s-{len(self._committed('snapshots')):09d}"
        rows = self._total(folders)  # of the batches that the manifest names, and of no later ones
        self.spark.createDataFrame([(b,) for b in sorted(held)], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{name}")
        rows.write.mode("overwrite").parquet(f"{self.path}/snapshots/{name}")
