"""Line dedup by overlapping three-line windows.

Lines are what newlines part; blanks, tabs and carriage returns at a line's ends do not count.
Every three consecutive lines are a window, hashed to 128 bits, unless all three are empty.
The first occurrence of a window is the one with the smallest (id, line number); all lines that
any later occurrence covers are removed, each once, whatever number of windows covers it.
Windows are judged on the input. The global step is one minimum per window hash, combined
before the shuffle, so a window that a third of all documents hold costs one row a task.

Defined results: documents of fewer than three lines, empty or null texts and rows without id
are unchanged; repeated rows are one document; an empty table gives an empty table.
"""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import arrow_rows, cut, fresh, replaced, same, text_bytes


def _windows(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, h, at, w1, w2): hash of the text, position and hash of each window."""

    def make(cols):
        import numpy as np

        for doc, h, text in zip(*cols, strict=True):
            lines = [x.strip(b" \t\r") for x in (text or b"").split(b"\n")]
            n = len(lines) - size + 1
            if n < 1:
                continue
            sums = b"".join([xxhash.xxh3_128_digest(x) for x in lines])
            filled = np.convolve([bool(x) for x in lines], np.ones(size, int), "valid") > 0
            both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(sums[16 * i : 16 * (i + size)]) for i in range(n)]), np.int64).reshape(-1, 2)
            at = np.flatnonzero(filled)
            yield np.full(len(at), doc), np.full(len(at), h), at.astype(np.int32), both[at, 0], both[at, 1]

    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")), text_bytes(text_col))
    return arrow_rows(base, "id long, h long, at int, w1 long, w2 long", make)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, h, at): per document with removed lines, the sorted starts of windows that occurred before."""
    windows = cut(_windows(docs, id_col, text_col, size), "windows")
    place = F.struct("id", "h", "at")
    first = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("w1", "w2", "first")
    later = windows.join(first, ["w1", "w2"]).where(place > F.col("first"))
    return later.groupBy("id", "h").agg(F.array_sort(F.collect_set("at")).alias("at"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", size: int = 3, counts: bool = False) -> DataFrame:
    """docs with the texts that are left; chars_col follows the text. counts: n_lines and n_removed are added.

    Documents stay even if all their lines go (with an empty text).
    """
    p = fresh(docs)

    @F.pandas_udf("text string, n_removed long")
    def clean(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for text, at in zip(texts, starts, strict=True):
            if text is None or at is None:
                out.append((text, 0))
                continue
            lines = text.split("\n")
            keep = [True] * len(lines)
            for a in at:
                keep[a : a + size] = [False] * size
            out.append(("\n".join(x for x, k in zip(lines, keep, strict=True) if k), len(lines) - sum(keep)))
        return pd.DataFrame(out, columns=["text", "n_removed"])

    gone = repeated_lines(docs, id_col, text_col, size).select(F.col("id").alias(p + "id"), F.col("h").alias(p + "h"), F.col("at").alias(p + "at"))
    rows = docs.withColumn(p + "h0", F.xxhash64(F.col(text_col).cast("string")))
    joined = rows.join(gone, same(rows[id_col].cast("long"), F.col(p + "id")) & (F.col(p + "h0") == F.col(p + "h")), "left")
    hit = F.col(p + "at").isNotNull()
    joined = joined.withColumn(p + "done", clean(F.when(hit, F.col(text_col)), p + "at"))
    joined = joined.withColumn(p + "new", F.when(hit, F.col(p + "done.text")).otherwise(F.col(text_col)))
    n_lines = F.when(F.length(text_col) > 0, F.length(text_col) - F.length(F.translate(F.col(text_col), "\n", "")) + 1).otherwise(0)
    joined = joined.withColumn(p + "n_lines", F.coalesce(n_lines, F.lit(0)).cast("long"))
    if not counts:
        return joined.select(*replaced(docs, text_col, chars_col, p))
    rest = docs.drop("n_lines", "n_removed")
    added = F.col(p + "n_lines").alias("n_lines"), F.coalesce(p + "done.n_removed", F.lit(0)).cast("long").alias("n_removed")
    return joined.select(*replaced(rest, text_col, chars_col, p), *added)
