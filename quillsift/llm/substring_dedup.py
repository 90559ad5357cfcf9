"""Substring dedup by anchor phrases and window hashes against hash-partitioned reference blocks.

This stands in for relative Lempel-Ziv parsing: no longest match is sought or extended.

The reference is the whole corpus in order of document id. Its index is made of phrases, dealt
by hash to blocks: a phrase is the run of words in which one anchor (the least hash of eight
words within a window, so equal windows have equal anchors) is the anchor of every window.
Each phrase of a document is looked up in the block that would hold it, and where an earlier
document has it, its words, a window or more, are duplicates. Where a phrase is new but its
anchor has been seen with other surroundings, it is checked window by window, against the
windows of every first phrase with that anchor. The first holder of a window holds it in a phrase that no earlier document has,
so it is among those, and the result is exact: a word goes if and only if a window of `window`
words that covers it starts in a document with a smaller id.

Both lookups keep one minimum per hash and are combined before the shuffle, so copies and
common passages of any number cost one row a task; no block is ever held as a group. Phrases
and windows are hashed to 128 bits.

Defined results: texts that are null or shorter than the window lose nothing; repeats within
one document stay; rows without id are unchanged and no reference for others; repeated rows
are one document (rows with one id and different texts never remove from each other); an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import U, arrow_rows, cut, discard, fresh, mixed, same, signed, text_bytes, word_hashes

#: Words of an anchor.
ANCHOR = 8
_MASK = U(0xFFFFFFFFFF000000)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n + 1, base, U)
    p[0] = 1
    return np.cumprod(p, dtype=U)


class _Rolling:
    """Two independent 64-bit hashes of any word range, from prefix sums modulo 2^64."""

    def __init__(self, h: np.ndarray):
        self.sums, self.inverse = [], []
        for k, base in enumerate(_BASES):
            x = mixed(h + U(k * 0x5851F42D4C957F2D + 1))
            self.sums.append(np.concatenate([np.zeros(1, U), np.cumsum(x * _powers(base, len(h))[:-1], dtype=U)]))
            self.inverse.append(_powers(pow(base, -1, 1 << 64), len(h)))

    def ranges(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        length = (b - a).astype(U)
        return [signed(mixed((s[b] - s[a]) * inv[a] + length)) for s, inv in zip(self.sums, self.inverse, strict=True)]


def phrases(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, a, b): for each maximal run of windows with one anchor position, its hash and the range [a, b) of the windows' starts."""
    n = len(h) - window + 1
    k = min(ANCHOR, window)
    acc = mixed(h[: len(h) - k + 1])
    for j in range(1, k):
        acc = mixed(acc + h[j : len(h) - k + 1 + j] * U(2 * j + 1))
    least = (acc & _MASK) | np.arange(len(acc), dtype=U) if len(acc) < 1 << 24 else None
    if least is None:  # longer texts in pieces that overlap by a window
        parts = [(s, phrases(h[s : s + (1 << 23) + window - 1], window)) for s in range(0, n, 1 << 23)]
        return tuple(np.concatenate([x[i] + (s if i else U(0)) for s, x in parts]) for i in range(3))
    span, width = 1, window - k + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: n], least[width - span : width - span + n])
    at = (least[:n] & ~_MASK).astype(np.int64)
    a = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return acc[at[a]], a, np.append(a[1:], n)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), text_bytes(text_col).alias("text"))


def _phrase_table(docs: DataFrame, window: int) -> DataFrame:
    def make(cols):
        for doc, key, text in zip(*cols, strict=True):
            words = (text or b"").split()
            if len(words) < window:
                continue
            h = word_hashes(words)
            anchor, a, b = phrases(h, window)
            p1, _ = _Rolling(h).ranges(a, b + (window - 1))
            yield np.full(len(a), doc), np.full(len(a), key), a.astype(np.int32), (b - a).astype(np.int32), signed(anchor), p1

    return arrow_rows(docs, "id long, h long, a int, n int, anchor long, phrase long", make)


def _window_table(places: DataFrame, window: int) -> DataFrame:
    """(id, h, a, w1, w2): the windows that start in the given ranges; places: id, h, text, ranges."""

    def make(cols):
        for doc, key, text, ranges in zip(*cols, strict=True):
            words = text.split()
            a = np.unique(np.concatenate([np.arange(r["a"], r["a"] + r["n"]) for r in ranges]))
            w1, w2 = _Rolling(word_hashes(words)).ranges(a, a + window)
            yield np.full(len(a), doc), np.full(len(a), key), a.astype(np.int32), w1, w2

    return arrow_rows(places, "id long, h long, a int, w1 long, w2 long", make)


def duplicate_ranges(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, ranges): per document with duplicate words, ranges of window starts (a, n), h the text's hash."""
    base = _rows(docs, id_col, text_col)
    table = cut(_phrase_table(base, window), "phrases")
    first = table.groupBy("anchor", "phrase").agg(F.min("id").alias("src"), F.max("id").alias("last"))
    first = cut(first, "index")
    several = first.groupBy("anchor").agg(F.min("phrase").alias("lo"), F.max("phrase").alias("hi"), F.min("src").alias("d0"), F.max("src").alias("d1"))
    several = several.where("lo <> hi and d0 <> d1").select("anchor", F.lit(True).alias("broken"))
    index = first.join(several, "anchor", "left").where("src < last or broken").drop("last")
    found = cut(table.join(index, ["anchor", "phrase"]).where("id > src or broken").select("id", "h", "a", "n", "src"), "found")
    discard(table)
    discard(first)
    whole = found.where("id > src").select("id", "h", "a", "n")
    edges = found.where("id = src").select("id", "h", F.struct("a", "n").alias("r"))
    edges = edges.groupBy("id", "h").agg(F.collect_list("r").alias("ranges"))
    texts = edges.join(base.withColumnRenamed("text", "t"), ["id", "h"]).select("id", "h", F.col("t").alias("text"), "ranges")
    windows = cut(_window_table(texts, window), "edges")
    source = windows.groupBy("w1", "w2").agg(F.min("id").alias("src"), F.max("id").alias("last")).where("src < last").select("w1", "w2", "src")
    single = windows.join(source, ["w1", "w2"]).where("id > src").select("id", "h", "a", F.lit(1).alias("n"))
    return whole.union(single).groupBy("id", "h").agg(F.array_distinct(F.collect_list(F.struct("a", "n"))).alias("ranges"))


def _covered(n: int, ranges, window: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    for r in ranges:
        step[r["a"]] += 1
        step[r["a"] + r["n"] + window - 1] -= 1
    return np.cumsum(step[:n]) > 0


def dedup_substrings(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with kept_text (the words left, joined by one space; null for a null text), n_words and n_removed added."""
    p = fresh(docs)

    @F.pandas_udf("kept string, n_words long, n_removed long")
    def clean(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        out = []
        for text, found in zip(texts, ranges, strict=True):
            words = (text or "").encode().split()
            n, gone = len(words), 0
            if found is not None and len(found):
                covered = _covered(n, found, window)
                gone = int(covered.sum())
                words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            out.append((None if text is None else b" ".join(words).decode(), n, gone))
        return pd.DataFrame(out, columns=["kept", "n_words", "n_removed"])

    found = duplicate_ranges(docs, window, id_col, text_col).select(F.col("id").alias(p + "id"), F.col("h").alias(p + "h"), F.col("ranges").alias(p + "ranges"))
    rows = docs.withColumn(p + "h0", F.xxhash64(F.col(text_col).cast("string")))
    joined = rows.join(found, same(rows[id_col].cast("long"), F.col(p + "id")) & (F.col(p + "h0") == F.col(p + "h")), "left")
    joined = joined.withColumn(p + "done", clean(F.col(text_col).cast("string"), p + "ranges"))
    rest = [c for c in docs.columns if c not in ("kept_text", "n_words", "n_removed")]
    return joined.select(*rest, F.col(p + "done.kept").alias("kept_text"), F.col(p + "done.n_words").alias("n_words"), F.col(p + "done.n_removed").alias("n_removed"))

