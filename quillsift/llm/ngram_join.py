"""N-gram Jaccard join by token-combination prefixes.

A document is its set of word shingles (64-bit hashes). All sets share one order of tokens, by
rising count: every token is counted, over all documents, in one of COUNTERS counters that its
hash picks, so the order and the class of a token (frequent from a count on) are the same however
the rows lie, and the table that all tasks hold has the same size for any corpus. A counter that
rare tokens share with a frequent one makes them frequent too; order and classes decide on speed
only. A set's prefix is extended until it cannot lose all its signatures: with t tokens that a
partner may lack, the prefix ends when  rare tokens + sum over buckets of (frequent tokens in the
bucket - 1)  exceeds t. Its signatures are its single rare tokens and, for the frequent class, the
2-token combinations within a bucket. Of two linked sets, take the one whose prefix ends first: it
loses at most t tokens, so one rare token or two frequent ones of a bucket are left, and the
other's prefix holds them too. Buckets (about one per eight tokens of the set) keep the number of
combinations in proportion to the prefix; sets near a power of two emit for both bucketings.

Equal sets are one class (128-bit hash) from the start, so copies cost one signature set. The
classes that share a signature are a group; groups are counted exactly by a shuffle. In a group of
FEW classes or less all pairs are candidates; those whose prefixes have too few signatures in common
are dropped and the others are verified on whole sets with integer arithmetic. A larger group is a
common token or near copies of each other. All its members are verified against one, the hub, and
then a signature is lengthened by a token: members stay together only if they share one of the
rarest tokens in which they differ from the hub (see `_spokes`). These smaller groups are handled
alike, LENGTHS times. Of what is left then, as of all groups of differences, only those pairs are
made for which the common token can be the first of enough common ones and which the parities of
their differences do not tell apart.

The threshold must be above 1/2: linked sizes then span two bucketings at most, and a set of
one token links with its equals only. Others are refused.

Defined results: a set without words is linked with nothing; repeated rows share one class;
a row without id gets its set size and no component; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import U, arrow_rows, cut, discard, fresh, mixed, shingle_set, signed, small_batches, sweep, text_bytes
from quillsift.llm.components import connected_components

#: Counters of tokens (one byte each in the table that tasks hold) and the slices in which they are added up.
COUNTERS, SLICES = 1 << 24, 1024
#: A token is frequent if its counter is over the mean by LEAST or more, and by NOISE times what rare tokens scatter about it.
LEAST, NOISE = 12, 4
#: Tokens that a task holds before it counts them.
COUNTED = 250_000
#: Classes of a group up to which all its pairs are made; where only some pairs count, twice the pairs for every row.
FEW = 16
#: The same for the groups of single rare tokens, times FEW: on a large corpus most of them are chance, and their members have nothing in common with a hub.
CHANCE = 8
#: How often the groups beyond FEW are parted by another token.
LENGTHS = 1
#: 64-bit words of the parities of a difference, at most; more of them only part the differences of larger sets more sharply.
PARITIES = 64
#: Ids that may be broadcast to pick rows of a larger table (24 bytes each); beyond that both sides are shuffled.
BROADCAST_IDS = 1_000_000


def scatter(mean: float) -> float:
    """How far a counter of rare tokens alone lies from the mean (Poisson)."""
    return float(np.sqrt(mean + 1.0))


def level(counts: np.ndarray, mean: float = 0.0) -> np.ndarray:
    """A byte that rises with the counts: sixteenths of their scatter up to six times that over the mean, then sixths of the logarithm to base 2.

    On a large corpus all counters are near the mean, and only steps finer than the scatter still tell rare tokens from common ones.
    """
    over = (counts - mean) / scatter(mean)
    return np.clip(np.where(over < 6, 64 + 16 * over, 160 + 6 * np.log2(np.maximum(over, 6) / 6)), 0, 255).astype(np.uint8)


class Ranks:
    """The order of tokens: by level of their counter, then by hash; frequent from level `often` on."""

    def __init__(self, levels: np.ndarray, often: int):
        self.levels, self.often = levels, often

    def of(self, u: np.ndarray) -> np.ndarray:
        return self.levels[(u >> U(20)) % U(len(self.levels))]

    def sort(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens from the rarest on, and their levels."""
        rank = self.of(u)
        by = np.lexsort((u, rank))
        return u[by], rank[by]


def _counters(docs: DataFrame, k: int) -> DataFrame:
    """(part, counts): for each task and slice of the counters, what the task saw, compressed; the slice of no part."""

    small_batches(docs.sparkSession)

    def run(batches):
        total, held, n = np.zeros(COUNTERS, np.uint32), [], 0

        def count(held):
            at, c = np.unique((np.concatenate(held) >> U(20)) % U(COUNTERS), return_counts=True)
            total[at] += c.astype(np.uint32)

        for b in batches:
            for text in b.column(0):
                held.append(shingle_set(text.as_py(), k))
                n += len(held[-1])
                if n >= COUNTED:
                    count(held)
                    held, n = [], 0
        if n:
            count(held)
        if total.any():
            parts = [zlib.compress(x.astype("<u4" if x.max() > 255 else "u1").tobytes(), 1) for x in total.reshape(SLICES, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])

    return docs.select("text").mapInArrow(run, "part int, counts binary")


def _ranks(docs: DataFrame, k: int) -> Ranks:
    width = COUNTERS // SLICES

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = zlib.decompress(counts.as_py())
                x = np.frombuffer(x, "u1" if len(x) == width else "<u4")
                if part in sums:
                    sums[part] += x
                else:
                    sums[part] = x.astype(np.int64)
        if sums:
            packed = [zlib.compress(x.tobytes(), 1) for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array(packed, pa.binary()), pa.array([int(x.sum()) for x in sums.values()], pa.int64())], names=["part", "counts", "total"])

    summed = cut(_counters(docs, k).repartition("part").mapInArrow(add, "part int, counts binary, total long"), "counters")
    mean = (summed.agg(F.sum("total")).first()[0] or 0) / COUNTERS

    def rate(batches):
        for b in batches:
            levels = [level(np.frombuffer(zlib.decompress(x.as_py()), np.int64), mean).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(levels, pa.binary())], names=["part", "levels"])

    levels = np.full((SLICES, width), level(np.zeros(1), mean), np.uint8)
    for r in summed.select("part", "counts").mapInArrow(rate, "part int, levels binary").toLocalIterator():
        levels[r["part"]] = np.frombuffer(r["levels"], np.uint8)
    discard(summed)
    return Ranks(levels.reshape(-1), int(level(np.array(mean + max(LEAST, NOISE * scatter(mean))), mean)))


def buckets(n: int) -> int:
    return max(1, (1 << (n.bit_length() - 1)) >> 3)


def signatures(u: np.ndarray, ranks: Ranks, num: int, den: int) -> tuple[np.ndarray, int]:
    """Signatures of the set u, single tokens with lowest bit 0, combinations 1; and the tokens beyond the prefix, or -1 less all frequent tokens if some are in it."""
    n = len(u)
    need = n - -(-num * n // den) + 1
    if n < 2:
        return mixed(u) & ~U(1), -1
    u, rank = ranks.sort(u)
    rare = u[rank < ranks.often]
    if len(rare) >= need:
        return np.unique(mixed(rare[:need]) & ~U(1)), n - need
    tokens = u[len(rare) :]
    out, sizes = [mixed(rare) & ~U(1)], {buckets(n), buckets(max(1, -(-num * n // den)))}
    for b in sizes:
        bucket = (mixed(tokens) >> U(8)) % U(b)
        by = np.argsort(bucket, kind="stable")
        first = np.ones(len(by), bool)
        first[1:] = bucket[by][1:] != bucket[by][:-1]
        gains = np.ones(len(tokens), np.int64)
        gains[by[first]] = 0
        end = int(np.searchsorted(np.cumsum(gains), need - len(rare))) + 1
        by = by[by < end]
        group, tok = bucket[by], tokens[by]
        for step in range(1, len(by)):
            near = group[step:] == group[:-step]
            if not near.any():
                break
            x, y = tok[:-step][near], tok[step:][near]
            out.append(mixed(mixed(np.minimum(x, y)) + np.maximum(x, y)) | U(1))
    return np.unique(np.concatenate(out)), -1 - len(tokens)


def set_class(u: np.ndarray) -> tuple[int, int] | tuple[None, None]:
    """The class of sets equal to u, a 128-bit hash in two signed halves; nulls for the empty set."""
    if not len(u):
        return None, None
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(u.tobytes()), np.int64).tolist())


def _signed_docs(docs: DataFrame, k: int, num: int, den: int, shared) -> DataFrame:
    """(id, h, n, f, g, beyond, sigs): hash of the text, set size, class of equal sets (null without words), tokens beyond the prefix, signatures."""

    def make(cols):
        ranks = shared.value
        for doc, h, text in zip(*cols, strict=True):
            u = shingle_set(text, k)
            sigs, beyond = signatures(u, ranks, num, den) if len(u) else (None, -1)
            f, g = set_class(u)
            yield [doc], [h], [len(u)], [f], [g], [beyond], [signed(sigs) if len(u) else None]

    return arrow_rows(docs, "id long, h long, n long, f long, g long, beyond long, sigs array<long>", make, flush=2_000)


def _close(num: int, den: int) -> Column:
    """Two set sizes that may be linked."""
    a, b = F.col("n"), F.col("n2")
    return F.greatest(a, b) * num <= F.least(a, b) * den


def _pairs(rows: DataFrame, num: int, den: int, more: Column) -> DataFrame:
    """Pairs of members of one group that are in two components and may be linked; more is asked of a pair, whose second member's columns end in 2."""
    both = rows.join(rows.select("sig", *[F.col(c).alias(c + "2") for c in rows.columns if c != "sig"]), "sig")
    return both.where((F.col("node") < F.col("node2")) & (F.col("comp") != F.col("comp2")) & _close(num, den) & more)


def _prefix_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pairs that have the single tokens in common that linked sets must have.

    All common tokens up to the end of the prefix that ends first show as signatures if they are
    rare. Beyond it the overlap cannot grow by more than that set has left; where both prefixes
    reach the frequent class, so that all rare tokens are in them, not by more than the frequent
    tokens of either set; and by the tokens whose groups are too large to be here, `hot` of a set.
    """
    b, b2 = F.col("beyond"), F.col("beyond2")
    rest = F.when((b < 0) & (b2 < 0), -1 - F.greatest(b, b2)).otherwise(F.greatest(b, b2)) + F.least("hot", "hot2")
    bound = F.ceil((F.col("n") + F.col("n2")) * num / (num + den)) - rest
    found = _pairs(rows, num, den, F.lit(True)).select(F.col("node").alias("a"), F.col("node2").alias("b"), (1 - F.expr("sig & 1")).alias("single"), bound.alias("bound"))
    return found.groupBy("a", "b").agg(F.sum("single").alias("common"), F.max("bound").alias("bound")).where("common >= bound").select("a", "b")


def _spokes(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(hub, node, off, n, k, d, linked, short, bits): of the k tokens in which node differs from its hub the first, d, as many as are to be compared, and whether they link; bits are the parities of all k.

    Let Dx be the tokens in which x and the hub p differ and r = (den - num) / (den + num): x and y
    link if |x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy| <= r (|x| + |y|). Of a link between components at
    least one end, x, is not linked to p, so |Dx| > r (|x| + |p|) and |Dx & Dy| >
    (|Dy| + r (|p| - |y|)) / 2: so many first tokens of Dy have one of Dx. The same holds for x
    if y is not linked to p either. Of any two, linked to p or not, |Dx & Dy| <= |Dy| also gives
    |Dx & Dy| >= |Dx| - r (|x| + |y|) >= |Dx| - |x| (den - num) / num, and at least one token,
    which for members far from their hub says more. `short` is the lesser of the two numbers.
    All D of a hub have one order: tokens that the hub lacks, rarest first, then those that it has, most frequent first: what is
    rare and in the hub is in nearly every D.
    """
    one, hub = sets.select(F.col("f").alias("node"), F.col("s").alias("x")), sets.select(F.col("f").alias("hub"), F.col("s").alias("y"))
    both = rows.join(one, "node").join(hub, "hub")
    diff = F.concat(F.array_except("x", "y"), F.reverse(F.array_except("y", "x")))
    both = both.select("hub", "node", "off", F.size("x").cast("long").alias("n"), F.size("y").cast("long").alias("m"), diff.alias("d")).withColumn("k", F.size("d").cast("long"))
    linked = F.col("k") * (num + den) <= (F.col("n") + F.col("m")) * (den - num)
    short = F.col("k") - F.floor((F.col("k") * (num + den) + (F.col("m") - F.col("n")) * (den - num)) / (2 * (num + den)))
    full = F.col("k") + 1 - F.greatest(F.lit(1), F.ceil((F.col("k") * num - F.col("n") * (den - num)) / num))
    both = both.withColumns({"linked": linked, "full": full}).withColumn("short", F.least(short, "full"))
    both = both.withColumn("words", F.least(F.lit(PARITIES), F.ceil(F.col("m") / 32)).cast("int"))
    bits = F.expr("transform(sequence(0, words - 1), w -> aggregate(filter(d, t -> pmod(shiftright(t, 6), words) = w), 0L, (x, t) -> x ^ shiftleft(1L, cast(t & 63 as int))))")
    kept = F.slice("d", F.lit(1), F.greatest(F.when(F.col("linked"), F.col("short")).otherwise(F.col("full")), F.lit(0)).cast("int"))
    return both.select("hub", "node", "off", "n", "k", kept.alias("d"), "linked", "short", bits.alias("bits"))


def _open(spokes: DataFrame) -> DataFrame:
    """The spokes of hubs that have members of two components or more."""
    more = spokes.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("hub")
    return spokes.join(more, "hub", "left_semi")


def _longer(spokes: DataFrame) -> DataFrame:
    """(sig, node, comp, off, n, k, bits, at, role): the groups of the members of a hub that share a token of their prefixes, at place `at` of the k in which the member differs.

    Role a: not linked to the hub, token among the first `short`; b: linked; c: not linked, another token. Only a with a, and b with a or c, may be new links.
    """
    rows = spokes.select("hub", "node", "comp", "off", "n", "k", "linked", "short", "bits", F.posexplode("d").alias("at", "token"))
    role = F.when(F.col("linked"), "b").when(F.col("at") < F.col("short"), "a").otherwise("c")
    return rows.select(F.xxhash64("hub", "token").alias("sig"), "node", "comp", "off", "n", "k", "bits", "at", role.alias("role"))


def _token_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pairs for which a common token can be the first of as many as linked sets must have in common of what they differ in from their hub.

    Two sets differ in the tokens in which their differences from the hub do, |x ^ y| = |Dx ^ Dy|, and every such token turns
    one parity: sets whose parities differ in more places than linked sets in tokens are no link.
    """
    roles = F.concat("role", "role2").isin("aa", "ab", "ba", "bc", "cb")
    left = F.least(F.col("k") - F.col("at"), F.col("k2") - F.col("at2"))
    enough = (F.col("k") + F.col("k2") - 2 * left) * (num + den) <= (F.col("n") + F.col("n2")) * (den - num)
    apart = F.expr("aggregate(zip_with(bits, bits2, (x, y) -> bit_count(x ^ y)), 0, (s, c) -> s + c)")
    near = apart * (num + den) <= (F.col("n") + F.col("n2")) * (den - num)
    return _pairs(rows, num, den, roles & enough & near).select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): the pairs whose whole sets reach num/den."""
    left = sets.select(F.col("f").alias("a"), F.col("s").alias("x"))
    right = sets.select(F.col("f").alias("b"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(both * den >= (F.size("x") + F.size("y") - both) * num).select("a", "b")


def _bounded(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _labelled(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """rows with comp, the component of their node."""
    if comps is None:
        return rows.withColumn("comp", F.col("node"))
    comps = comps.select(F.col("node").alias("node0"), "component")
    return rows.join(comps, F.col("node") == F.col("node0"), "left").withColumn("comp", F.coalesce("component", "node")).drop("node0", "component")


def _unsettled(rows: DataFrame) -> DataFrame:
    """The rows of groups that may hold a link between two components; c: twice the pairs to be looked at for every row."""
    a, b, c = (F.count_if(F.col("role") == x) for x in "abc")
    more = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), (a * (a - 1) + 2 * (a + c) * b).alias("pairs"), F.count("*").alias("rows"))
    return rows.join(more.where("lo <> hi and pairs > 0").select("sig", (F.col("pairs") / F.col("rows")).alias("c")), "sig")


def jaccard_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (smallest id reachable by links of Jaccard num/den or more)."""
    return _grouped(docs, k, num, den, id_col, text_col, F.lit(None).cast("long")).select(F.col("id").alias(id_col), "n_shingles", "component_id")


def _links(shared: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame | None:
    """Components of the linked classes, (node, component); None without any. shared: (sig, node, n, beyond, off, c, comp), the groups of c classes, two or more.

    The hub is the member with the least `off`: with g rare tokens that common ones of the group replaced and l lost, a near
    copy of m tokens has g + l - m = 2 g - n, so that the least is the nearest to what the group has in common.
    """
    comps, rows = None, shared
    for k in range(LENGTHS + 1):
        sweep(shared.sparkSession)
        if k:
            rows = cut(_unsettled(rows), "rows")
            if rows.isEmpty():
                break
        few = F.lit(FEW) if k else F.when(F.expr("sig & 1 = 0"), FEW * CHANCE).otherwise(FEW)
        small, large = rows.where(F.col("c") <= few), rows.where(F.col("c") > few)
        if not k:
            hot = large.where("sig & 1 = 0").groupBy(F.col("node").alias("node0")).agg(F.count("*").alias("hot"))
            small = small.join(hot, F.col("node") == F.col("node0"), "left").drop("node0").withColumn("hot", F.coalesce("hot", F.lit(0)))
        pairs = cut(_token_pairs(rows if k == LENGTHS else small, num, den) if k else _prefix_pairs(small, num, den), "pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("f"))
        if k < LENGTHS:
            hub = F.min(F.struct("off", F.xxhash64("node").alias("r"), "node"))["node"]
            spokes = large.join(large.groupBy("sig").agg(hub.alias("hub")), "sig").where("node <> hub").select("hub", "node", "off").distinct()
            spokes = cut(spokes, "spokes")
            ids = ids.union(spokes.select(F.explode(F.array("hub", "node"))))
        sets = sets_of(ids)
        found = _verified(pairs, sets, num, den)
        if k < LENGTHS:
            spokes = cut(_spokes(spokes, sets, num, den), "spokes")
            found = found.union(spokes.where("linked").select("hub", "node"))
        found = cut(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        discard(sets)
        if not found.isEmpty():
            edges = found if comps is None else found.union(comps.where("node <> component").select("node", "component"))
            comps = cut(connected_components(edges), "comps")
        discard(found)
        if k < LENGTHS:
            rows = _longer(_open(_labelled(spokes, comps)))
    return comps


def _grouped(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str, key: Column) -> DataFrame:
    """One row per row of docs: id, h (key, which tells the texts of one id apart), n_shingles, component_id.

    A class of equal sets is the node (its smallest id, half of its hash).
    """
    if not den < 2 * num <= 2 * den:
        raise ValueError(f"the threshold must be above 1/2 and at most 1, not {num}/{den}: below, linked sets may share no signature")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("h"), text_bytes(text_col).alias("text"))
    order = docs.sparkSession.sparkContext.broadcast(_ranks(docs, k))
    signed_docs = cut(_signed_docs(docs, k, num, den, order), "signed")
    member = cut(signed_docs.select("id", "h", "n", "f", "g"), "member")
    usable = signed_docs.where("id is not null and f is not null")
    classes = usable.groupBy("f", "g").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("beyond").alias("beyond"), F.first("sigs").alias("sigs"))
    classes = cut(classes, "classes")
    discard(signed_docs)
    sweep(docs.sparkSession)
    index = classes.select(F.explode("sigs").alias("sig"), "id")
    common = index.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1")
    rare = F.when(F.col("beyond") < 0, F.col("n") + F.col("beyond") + 1).otherwise(F.col("n"))
    about = classes.select("id", F.struct("id", "f").alias("node"), "n", "beyond", (2 * rare - F.col("n")).alias("off"))
    shared = cut(index.join(common, "sig").join(about, "id").select("sig", "node", "n", "beyond", "off", "c", F.col("node").alias("comp")), "shared")

    def make(cols):
        ranks = order.value
        for doc, f, text in zip(*cols, strict=True):
            u = shingle_set(text, k)
            if set_class(u)[0] == f:
                yield [{"id": doc, "f": f}], [signed(ranks.sort(u)[0])]

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = cut(nodes.distinct().select("f.id", "f.f"), "wanted")
        return cut(arrow_rows(docs.join(_bounded(wanted), "id").select("id", "f", "text"), "f struct<id:long,f:long>, s array<long>", make, flush=2_000), "sets")

    comps = _links(shared, sets_of, num, den)
    home = classes.select("f", "g", F.struct("id", "f").alias("node"))
    home = _labelled(home, comps).select(F.col("f").alias("f2"), F.col("g").alias("g2"), F.col("comp.id").alias("component_id"))
    out = member.join(home, (member.f == home.f2) & (member.g == home.g2), "left")
    return out.select("id", "h", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def dedup_ngrams(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those that a document with a smaller id stands for; rows without id stay, and the texts of one id are judged each by itself."""
    p, key = fresh(docs), F.xxhash64(F.col(text_col).cast("string"))
    found = _grouped(docs, k, num, den, id_col, text_col, key)
    gone = found.where("id <> component_id").select(F.col("id").alias(p + "id"), F.col("h").alias(p + "h")).distinct()
    return docs.join(gone, (F.col(id_col).cast("long") == F.col(p + "id")) & (key == F.col(p + "h")), "left_anti")
