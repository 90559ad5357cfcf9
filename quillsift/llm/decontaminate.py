"""Benchmark decontamination with a generalised suffix automaton over words.

The normalised benchmark items (lower-cased A-Z, runs of digits, a-z and non-ASCII
characters) make one automaton, whose states stand for sets of word sequences with the same
ends. A document's words are streamed through it once; the longest match that ends at each
word is tracked, and where it reaches the window (or a whole shorter item) the words are hit
and the state tells which items hold them. The automaton is broadcast; its size is bounded by
MAX_WORDS benchmark words, and a larger benchmark is cut into several automata whose hits are
merged per document and joined back to its rows, so no result depends on the bound.

Defined results: null or wordless texts are not contaminated; items without id or words are
left out; an item of fewer words than the window is one window; items with equal texts are all
reported; repeated rows get the same result; an empty benchmark hits nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.common import arrow_rows, cut, fresh, replaced, same, text_bytes

#: Benchmark words in one automaton.
MAX_WORDS = 200_000

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_SPAN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def norm_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD).split()


class SuffixAutomaton:
    """A generalised suffix automaton of several word sequences.

    windows[v]: items that hold the window-long sequence ending in state v; short[v]: (length,
    item) of whole items shorter than the window; below[v]: the nearest state at or above v on
    the suffix path that has such items, or -1.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.vocab = window, {}
        self.next, self.link, self.len = [{}], [-1], [0]
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for name, words in items]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._add(last, c)
        self.windows: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        self.least = min([window, *(len(seq) for _, seq in coded)])
        for name, seq in coded:
            v = 0
            for p, c in enumerate(seq):
                v = self.next[v][c]
                if p + 1 >= window:
                    self.windows.setdefault(self._at(v, window), set()).add(name)
            if 0 < len(seq) < window:
                self.short.setdefault(self._at(v, len(seq)), []).append((len(seq), name))
        self.below = [-1] * len(self.len)
        if self.short:
            for v in sorted(range(len(self.len)), key=self.len.__getitem__):
                self.below[v] = v if v in self.short else self.below[self.link[v]] if v else -1

    def _new(self, length: int, nexts: dict, link: int) -> int:
        self.next.append(nexts)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the sequences that p followed by c stands for."""
        copy = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        cur, p = self._new(self.len[last] + 1, {}, 0), last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return cur

    def _at(self, v: int, length: int) -> int:
        while v and self.len[self.link[v]] >= length:
            v = self.link[v]
        return v

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Covered spans [start, end) of word positions, merged, and the items with occurring windows."""
        n, found, spans = len(words), set(), []
        if not self.vocab or n < self.least:
            return spans, found
        codes = np.fromiter(map(self.vocab.get, words, [-1] * n), np.int64, n)
        known = np.flatnonzero(np.diff(np.concatenate([[False], codes >= 0, [False]]).astype(np.int8)))
        nexts, link, length, window = self.next, self.link, self.len, self.window
        for a, b in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if b - a < self.least:
                continue
            v = m = 0
            for p, c in enumerate(codes[a:b].tolist(), a):
                while v and c not in nexts[v]:
                    v = link[v]
                    m = length[v]
                if c in nexts[v]:
                    v = nexts[v][c]
                    m += 1
                if m >= window:
                    found |= self.windows.get(self._at(v, window), set())
                    spans.append((p + 1 - window, p + 1))
                if self.short:
                    u = self.below[v]
                    while u > 0:
                        for size, item in self.short[u]:
                            if size <= m:
                                found.add(item)
                                spans.append((p + 1 - size, p + 1))
                        u = self.below[link[u]]
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, found


def _parts(benchmark: DataFrame, id_col: str, text_col: str, max_words: int):
    """Lists of (item, words) of at most max_words words each (one item at least)."""
    held, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("string"), text_bytes(text_col)).where(F.col(id_col).isNotNull())
    for name, text in rows.toLocalIterator():
        words = norm_words(bytes(text) if text is not None else None)
        if held and size + len(words) > max_words:
            yield held
            held, size = [], 0
        if words:
            held.append((name, words))
            size += len(words)
    yield held


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """(id, h, n_words, spans array<struct<a,b>>, items array<string>), h the text's hash; a row per row of docs."""
    spark: SparkSession = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), text_bytes(text_col).alias("t"))
    schema = "id long, h long, n_words long, spans array<struct<a:int,b:int>>, items array<string>"

    def hits(part):
        shared = spark.sparkContext.broadcast(SuffixAutomaton(part, window))

        def make(cols):
            automaton = shared.value
            for doc, h, text in zip(*cols, strict=True):
                words = norm_words(text)
                spans, items = automaton.hits(words)
                yield [doc], [h], [len(words)], [[{"a": a, "b": b} for a, b in spans]], [sorted(items)]

        return arrow_rows(base, schema, make, flush=20_000)

    out, parts = None, _parts(benchmark, item_col, item_text, max_words)
    for part in parts:
        got = hits(part)
        if out is not None or sum(len(w) for _, w in part) * 2 > max_words:
            got = cut(got, "hits")
        out = got if out is None else out.union(got)
        several = out is not got
    if several:
        out = out.groupBy("id", "h").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))

        def merge(cols):
            for doc, h, n, spans, items in zip(*cols, strict=True):
                covered = np.zeros(n + 1, bool)
                for s in spans:
                    covered[s["a"] : s["b"]] = True
                edges = np.flatnonzero(np.diff(np.concatenate([[False], covered]).astype(np.int8))).tolist()
                yield [doc], [h], [n], [[{"a": a, "b": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]], [sorted(items)]

        merged = cut(arrow_rows(out, schema, merge, flush=20_000), "merged")
        found = merged.select(F.col("id").alias("id2"), F.col("h").alias("h2"), "n_words", "spans", "items")
        rows = base.select("id", "h")
        out = rows.join(found, same(rows["id"], found["id2"]) & (rows["h"] == found["h2"])).select("id", "h", "n_words", "spans", "items")
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: id_col, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = benchmark_hits(docs, benchmark, window, id_col, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["b"] - x["a"]))
    return hits.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the characters from the first to the last word of each span."""
    ends, out, at = [(m.start(), m.end()) for m in _SPAN.finditer(text)], [], 0
    for a, b in spans:
        out.append(text[at : ends[a][0]])
        at = ends[b - 1][1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, min_span: int = 10, max_coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """docs without contaminated spans.

    A span of min_span hit words or more, or any span of an item shorter than the window, is cut
    out of the text; a document with more than max_coverage of its words hit goes altogether.
    Other documents and columns are unchanged; chars_col, if there is such a column, follows the text.
    """
    p = fresh(docs)
    hits = benchmark_hits(docs, benchmark, window, id_col, text_col, **options).where(F.size("spans") > 0)
    hits = cut(hits.select(F.col("id").alias(p + "id"), F.col("h").alias(p + "h"), F.col("n_words").alias(p + "n"), F.col("spans").alias(p + "spans")).dropDuplicates([p + "id", p + "h"]), "hits")

    @F.pandas_udf("string")
    def clean(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, s in zip(texts, spans, strict=True):
            if text is None or s is None or len(s) == 0:
                out.append(text)
            else:
                out.append(without_words(text.encode(), [(x["a"], x["b"]) for x in s if x["b"] - x["a"] >= min_span or x["b"] - x["a"] < window]).decode())
        return pd.Series(out, dtype=object)

    rows = docs.withColumn(p + "h0", F.xxhash64(F.col(text_col).cast("string")))

    joined = rows.join(hits, same(rows[id_col].cast("long"), F.col(p + "id")) & (F.col(p + "h0") == F.col(p + "h")), "left")
    n_hit = F.aggregate(p + "spans", F.lit(0).cast("long"), lambda s, x: s + (x["b"] - x["a"]))
    kept = joined.where(F.col(p + "spans").isNull() | (n_hit <= F.col(p + "n") * max_coverage))
    text = F.when(F.col(p + "spans").isNull(), F.col(text_col)).otherwise(clean(F.when(F.col(p + "spans").isNotNull(), F.col(text_col)), p + "spans"))
    return kept.withColumn(p + "new", text).select(*replaced(docs, text_col, chars_col, p))
