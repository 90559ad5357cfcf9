"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

The n-grams are the one to three letter sequences of lower-cased words, with word boundaries.
A language's profile is the order of its PROFILE most frequent n-grams; a document gets the
language whose profile its own most frequent n-grams, of the whole text, are least out of
place with. An n-gram that a profile lacks is out of place by PROFILE.

Profiles are learned from labelled rows: about TRAIN_DOCS documents of every language, chosen
by hash of the id, or all where there are fewer (all of them with train_docs None, as in the
pipeline); this is the only bound, it does not touch the documents that are classified, and the
profiles (at most MAX_LANGS languages) are the only thing collected or broadcast.

Defined results: a text that is null or has no letter is `und` with score 0, as is every text
if nothing could be learned; ties go to the language that sorts first; repeated rows get the
same result; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import U, arrow_rows, cut, fresh, small_batches

PROFILE, TRAIN_DOCS, MAX_LANGS = 400, 4_000, 5_000
UNKNOWN = "und"
#: Distinct n-grams that a task counts before it hands on its counts.
COUNTED = 2_000_000
#: What rejects a text in `rejecting`: the part of a language's learned documents that may lie below, what is left of
#: their bound for clean texts unlike them, and the fewest learned documents that give a language bounds of its own.
REJECT, LOOSE, JUDGED = 0.01, 0.5, 100
#: Steps to which scores and shares are cut for their percentiles, so that these need a count a step and not a value a document.
STEPS = 10_000


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> np.ndarray:
    """Codes (21 bits a letter, 1 for a boundary, so that an n-gram with one is no shorter n-gram's code) of all n-grams, with repeats; empty without a letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    c = np.where(_letters()[c], c, U(0))
    c = np.concatenate([np.zeros(1, U), c, np.zeros(1, U)])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
    if len(c) < 3:
        return np.empty(0, U)
    letter, c = c != 0, np.maximum(c, U(1))
    two = c[:-1] | c[1:] << U(21)
    return np.concatenate([c[letter], two, (two[:-1] | c[2:] << U(42))[letter[1:-1]]])


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The top codes by falling count, then by code; codes are sorted."""
    if len(codes) > 4 * top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.argsort(-counts, kind="stable")[:top]]


class Profiles:
    """Rank tables of all languages over the union of their n-grams."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int):
        self.langs, self.top = sorted(profiles), top
        self.codes = np.unique(np.concatenate([np.empty(0, U), *profiles.values()]))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = ngrams(text)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        own = ranked(*np.unique(codes, return_counts=True), self.top)
        at = np.searchsorted(self.codes, own)
        known = np.append(self.codes, U(0))[at] == own
        ranks = self.ranks[np.where(known, at, len(self.codes))]
        out = np.where(ranks < 0, self.top, np.minimum(np.abs(ranks - np.arange(len(own))[:, None]), self.top)).sum(axis=0)
        best = int(np.argmin(out))
        return self.langs[best], 1.0 - float(out[best]) / (self.top * len(own))


def _chosen(docs: DataFrame, train: Column, train_docs: int | None, id_col: str, text_col: str, lang_col: str) -> DataFrame | None:
    """(lang, text) of the rows that profiles are learned from, all with train_docs None; None without any."""
    p = fresh(docs)
    spark = docs.sparkSession
    rows = docs.where(train & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    langs = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).count().limit(MAX_LANGS + 1).collect()
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not langs:
        return None
    if train_docs is None:
        return rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    share = spark.createDataFrame([(r["lang"], min(1.0, train_docs / r["count"])) for r in langs], f"{p}lang string, {p}share double")
    draw = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(share), rows[lang_col].cast("string") == F.col(p + "lang")).where(draw < F.col(p + "share"))
    return chosen.select(F.col(p + "lang").alias("lang"), F.col(text_col).cast("string").alias("text"))


def learn(docs: DataFrame, train: Column, top: int = PROFILE, train_docs: int | None = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from the rows of docs where train holds, with a text and a language."""
    chosen = _chosen(docs, train, train_docs, id_col, text_col, lang_col)
    if chosen is None:
        return Profiles({}, top)

    def run(batches):
        import pyarrow as pa

        held: dict[str, list] = {}
        size = 0

        def merged():
            for lang, parts in held.items():
                codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                yield lang, codes, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def out():
            for lang, codes, counts in merged():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)], names=["lang", "code", "count"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                codes, counts = np.unique(ngrams(text), return_counts=True)
                held.setdefault(lang, []).append((codes, counts))
                size += len(codes)
            if size >= COUNTED:
                held = {lang: [(codes, counts)] for lang, codes, counts in merged()}
                size = sum(len(p[0][0]) for p in held.values())
                if size >= COUNTED // 2:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    small_batches(docs.sparkSession)
    counts = chosen.mapInArrow(run, "lang string, code long, count long")
    counts = cut(counts.groupBy("lang", "code").agg(F.sum("count").alias("count")), "ngrams")
    from pyspark.sql import Window

    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "code"))).where(F.col("rank") <= top)
    got: dict[str, list] = {}
    for lang, code, rank in best.select("lang", "code", "rank").collect():
        got.setdefault(lang, []).append((rank, code))
    return Profiles({lang: np.array([code for _, code in sorted(x)], np.int64).view(U) for lang, x in got.items()}, top)


def letter_share(text: str | None) -> float:
    """The part of a text's characters, blanks left out, that are letters."""
    c = np.frombuffer("".join((text or "").split()).encode("utf-32-le", "surrogatepass"), np.uint32)
    return float(_letters()[c].mean()) if len(c) else 0.0


def rejecting(docs: DataFrame, profiles: Profiles, train: Column, train_docs: int | None = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str | None, tuple[float, float]]:
    """(score, letter share) by language below which a text is not of it: LOOSE times what all but the lowest REJECT of its learned documents reach.

    Both are needed: the score tells foreign words, but a text of few letters scores as high as any, and
    there the share of letters tells symbols, numbers and markup. Under None stand the least bounds of all,
    for languages of fewer than JUDGED learned documents; without any others, nothing is rejected.
    """
    chosen = _chosen(docs, train, train_docs, id_col, text_col, lang_col)
    if chosen is None:
        return {None: (0.0, 0.0)}
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def make(cols):
        known = shared.value
        for lang, text in zip(*cols, strict=True):
            found, score = known.predict(text)
            if found != UNKNOWN:
                yield [lang] * 2, [0, 1], [int(score * STEPS), int(letter_share(text) * STEPS)]

    seen = arrow_rows(chosen, "lang string, what int, step int", make, flush=20_000).groupBy("lang", "what", "step").agg(F.count("*").alias("n"))
    low = seen.groupBy("lang", "what").agg(F.sum("n").alias("n"), F.percentile("step", F.lit(REJECT), F.col("n")).alias("step")).where(F.col("n") >= JUDGED)
    found = {(r["lang"], r["what"]): LOOSE * r["step"] / STEPS for r in low.collect()}
    bounds = {lang: (found[lang, 0], found[lang, 1]) for lang, what in found if not what}
    return bounds | {None: tuple(map(min, zip(*bounds.values(), strict=True))) if bounds else (0.0, 0.0)}


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, h (hash of the text), lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def make(cols):
        known = shared.value
        for doc, h, text in zip(*cols, strict=True):
            lang, score = known.predict(text)
            yield [doc], [h], [lang], [score]

    base = docs.select(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")), F.col(text_col).cast("string"))
    return arrow_rows(base, f"`{id_col}` long, h long, lang_pred string, score double", make, flush=20_000)


def keep_identified(docs: DataFrame, profiles: Profiles, accepted: list[str] | None = None, min_score: float = 0.0, text_col: str = "text", bounds: dict[str | None, tuple[float, float]] | None = None) -> DataFrame:
    """The rows of docs whose language is known (and accepted, and scored min_score or more, and within the bounds of `rejecting`)."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        known, out = shared.value, []
        for text in texts:
            lang, score = known.predict(text)
            fits = lang != UNKNOWN and score >= min_score and (accepted is None or lang in accepted)
            if fits and bounds is not None:
                least, letters = bounds.get(lang, bounds[None])
                fits = score >= least and letter_share(text) >= letters
            out.append(fits)
        return pd.Series(out, dtype=bool)

    return docs.where(good(F.col(text_col).cast("string")))
