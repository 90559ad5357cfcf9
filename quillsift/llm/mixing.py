"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

With T_s the tokens of source s, weights are w_s = T_s^a / sum T^a. The exponent a is bisected
on [0, 1]: the weights' entropy falls and the repetition of the smallest source eases as a
rises, so the result is the exponent that meets the target entropy, raised if the repetition
limit asks for more. The budget is given in tokens, or is the least that leaves no source
short of one pass.

Source s gets b_s = budget * w_s tokens: whole passes over its documents, then one partial
pass. A pass is a seeded permutation of the source's blocks and, within a block, of its
documents. The partial pass takes whole blocks in permuted order while they fit; the first
that does not fit is cut into sub-blocks, taken the same way, and the first of those that does
not fit gives its documents in order while they fit. Only that sub-block, about 1/65536 of
the source, is ranked document by document, so a source with any share of all rows needs no
group of its own in one task: totals are summed per block before the shuffle.

Defined results: tokens are runs of non-blanks; null and empty texts have none and come along
with every pass; a source without tokens gets one pass; a null source is a source; repeated
rows are one unit of their tokens' sum; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm.common import cut, fresh, same

#: Blocks of a source and sub-blocks of a block.
BLOCKS = 256
#: Sources whose totals may come to the driver (16 bytes each).
MAX_SOURCES = 2_000_000
WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def weights(tokens: np.ndarray, exponent: float) -> np.ndarray:
    x = np.exp(exponent * (np.log(tokens) - np.log(tokens.max())))
    return x / x.sum()


def entropy(w: np.ndarray) -> float:
    return float(-(w[w > 0] * np.log(w[w > 0])).sum())


def _bisect(good, steps: int = 60) -> float:
    """The least exponent in [0, 1] for which good holds; 1 if none does. good(a) implies good(a') for a' > a."""
    if good(0.0):
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if good(mid) else (mid, hi)
    return hi


def exponent_for(tokens: np.ndarray, entropy_share: float | None = None, max_repeats: float | None = None, budget: int | None = None) -> float:
    """tokens: positive totals of the sources. entropy_share: of the logarithm of their number."""
    a = 0.0
    if entropy_share is not None:
        target = entropy_share * math.log(len(tokens)) if len(tokens) > 1 else 0.0
        a = max(a, _bisect(lambda x: entropy(weights(tokens, x)) <= target))
    if max_repeats is not None:
        a = max(a, _bisect(lambda x: repeats(tokens, x, budget).max() <= max_repeats))
    return a


def repeats(tokens: np.ndarray, exponent: float, budget: int | None) -> np.ndarray:
    w = weights(tokens, exponent)
    return (budget or (tokens / w).max()) * w / tokens


def _take(units: DataFrame, keys: list[str], block: Column, seed: int) -> tuple[DataFrame, DataFrame]:
    """units (…, n, room) of each group of keys: rows of whole blocks that fit in room, and rows of the first block that does not, with the room left."""
    dealt = units.withColumn("blk", block)
    totals = dealt.groupBy(*keys, "blk").agg(F.sum("n").alias("t"), F.first("room").alias("room"))
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *keys, "blk"), "blk").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumn("end", F.sum("t").over(order))
    part = totals.where("end - t < room or (end <= room)").select(*[F.col(k).alias("k_" + k) for k in [*keys, "blk"]], (F.col("end") <= F.col("room")).alias("fits"), (F.col("room") - F.col("end") + F.col("t")).alias("left"))
    cond = [same(dealt[k], part["k_" + k]) for k in [*keys, "blk"]]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    got = dealt.join(part, on)
    return got.where("fits"), got.where("not fits").withColumn("room", F.col("left"))


def _partial(units: DataFrame, seed: int) -> DataFrame:
    """(id, h, s): the units of the partial pass."""
    cols = ["id", "h", "s", "n", "room"]
    here = [F.xxhash64(F.lit(seed + k), F.col("id"), F.col("h")) for k in (1, 2, 3)]
    one, rest = _take(units.select(*cols), ["s"], F.pmod(here[0], F.lit(BLOCKS)), seed)
    rest = rest.select(*cols, F.col("blk").alias("b1"))
    two, rest = _take(rest, ["s", "b1"], F.pmod(here[1], F.lit(BLOCKS)), seed)
    order = Window.partitionBy("s", "b1", "blk").orderBy(here[2], "id", "h").rowsBetween(Window.unboundedPreceding, 0)
    last = rest.select(*cols, "b1", "blk").withColumn("end", F.sum("n").over(order)).where("end <= room")
    return one.select("id", "h", "s").union(two.select("id", "h", "s")).union(last.select("id", "h", "s"))


def mixing_plan(units: DataFrame, entropy_share: float | None, max_repeats: float | None, budget: int | None) -> tuple[DataFrame, float]:
    """Per source: s, tokens, weight, passes, room (tokens of the partial pass); and the exponent."""
    totals = cut(units.groupBy("s").agg(F.sum("n").alias("tokens")), "totals")
    if totals.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    t = np.array([r[0] for r in totals.where("tokens > 0").select("tokens").collect()], dtype=np.float64)
    if not len(t):
        return totals.select("s", "tokens", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("passes"), F.lit(0).cast("long").alias("room")), 1.0
    t.sort()
    a = exponent_for(t, entropy_share, max_repeats, budget)
    total = float(budget or (t / weights(t, a)).max())
    scale, top = float(np.exp(a * (np.log(t) - np.log(t.max()))).sum()), float(t.max())
    w = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(top), F.lit(a)) / F.lit(scale)).otherwise(0.0)
    plan = totals.withColumn("weight", w).withColumn("b", F.round(F.col("weight") * F.lit(total)).cast("long"))
    passes = F.when(F.col("tokens") > 0, F.expr("b div tokens")).otherwise(1)
    return plan.select("s", "tokens", "weight", passes.cast("long").alias("passes"), F.when(F.col("tokens") > 0, F.expr("b % tokens")).otherwise(0).cast("long").alias("room")), a


def mixing_schedule(docs: DataFrame, entropy_share: float | None = 0.95, max_repeats: float | None = 4.0, budget: int | None = None, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: id, h (hash of the text), s, n (tokens), weight of its source, passes it is in."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(source_col).cast("string").alias("s"), n_tokens(text_col).alias("n"))
    units = cut(rows.groupBy("id", "h", "s").agg(F.sum("n").alias("n")), "units")
    plan, _ = mixing_plan(units, entropy_share, max_repeats, budget)
    plan = cut(plan, "plan").withColumnRenamed("s", "s2")
    units = units.join(plan, same(F.col("s"), F.col("s2")))
    extra = _partial(units.where("room > 0 and n > 0"), seed)
    extra = extra.select(F.col("id").alias("id2"), F.col("h").alias("h2"), F.col("s").alias("s3"), F.lit(1).alias("more"))
    out = units.join(extra, same(F.col("id"), F.col("id2")) & (F.col("h") == F.col("h2")) & same(F.col("s"), F.col("s3")), "left")
    return out.select("id", "h", "s", "n", "weight", (F.col("passes") + F.coalesce("more", F.lit(0))).alias("passes"))


def mix_sources(docs: DataFrame, entropy_share: float | None = 0.95, max_repeats: float | None = 4.0, budget: int | None = None, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs, each row once for every pass that it is in, with mix_weight, mix_pass, mix_block and mix_rank.

    Ordered by (mix_pass, mix_block, mix_rank), the rows are the training order; nothing is sorted here.
    """
    p = fresh(docs)
    plan = mixing_schedule(docs, entropy_share, max_repeats, budget, seed, id_col, text_col, source_col)
    plan = plan.select(F.col("id").alias(p + "id"), F.col("h").alias(p + "h"), F.col("s").alias(p + "s"), F.col("weight").alias(p + "w"), F.col("passes").alias(p + "p")).where(F.col(p + "p") > 0)
    rows = docs.withColumn(p + "h0", F.xxhash64(F.col(text_col).cast("string")))
    on = same(rows[id_col].cast("long"), F.col(p + "id")) & (F.col(p + "h0") == F.col(p + "h")) & same(rows[source_col].cast("string"), F.col(p + "s"))
    rest = [c for c in docs.columns if c not in ("mix_weight", "mix_pass", "mix_block", "mix_rank")]
    out = rows.join(plan, on).withColumn(p + "pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col(p + "p") - 1)))
    block = F.xxhash64(F.lit(seed), p + "pass", p + "s", F.pmod(F.xxhash64(F.lit(seed + 1), p + "id", p + "h"), F.lit(BLOCKS)))
    return out.select(*rest, F.col(p + "w").alias("mix_weight"), F.col(p + "pass").alias("mix_pass"), block.alias("mix_block"), F.xxhash64(F.lit(seed + 3), p + "pass", p + "id", p + "h").alias("mix_rank"))
