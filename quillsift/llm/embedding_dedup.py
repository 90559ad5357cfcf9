"""Embedding near-dedup: int8 tile products with a rigorous error bound for every vector.

A unit vector x is s*q + e with q in -127..127 and eps = |e| measured, not estimated. For two
vectors  |cos - s_x s_y (q_x . q_y)| <= |s_x q_x| eps_y + eps_x |s_y q_y| + eps_x eps_y.  The
integer product of a tile is a float32 matrix product, exact while 127*127*dimensions < 2^24
(longer vectors are cut into exact pieces summed in double precision). Pairs that the bound
puts below the threshold are dropped, pairs that it puts above are links, and only the rest
is recomputed in double precision from the full vectors.

Identical vectors are one class with a multiplicity before any tile is made. Classes are dealt
by hash to blocks of about BLOCK vectors; every unordered pair of blocks is one tile, a task's
unit of work, which returns link counts per vector and a spanning forest of its links -
never the pairs. The work is quadratic in the number of distinct vectors, as any exact method
without structure in the data is; memory is bounded by the tile.

Defined results: vectors that are null, empty, zero or hold a null, NaN or infinite component
link with nothing; vectors of different lengths link with nothing; a row without id has no
links and a null component; repeated ids with equal vectors are one vector, with
different ones several; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import cut, fresh
from quillsift.llm.components import connected_components

#: Vectors in a block and components in a block at most, and rows of a tile that are multiplied at once.
BLOCK, CELLS, ROWS = 8192, 1 << 22, 1024
#: For the rounding of the double precision arithmetic on either side of a comparison.
SLACK = 1e-9


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit rows x: int8 codes, scales, norms of the decoded rows, and norms of the errors (rounded up)."""
    s = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / s[:, None])
    back = q * s[:, None]
    return q.astype(np.int8), s, np.linalg.norm(back, axis=1) * (1 + 1e-12), np.linalg.norm(x - back, axis=1) * (1 + 1e-9) + 1e-15


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tile_links(xq, yq, x_full, y_full, threshold: float, diagonal: bool):
    """Yields (rows, columns) of linked pairs; on the diagonal only rows < columns."""
    (qx, sx, ax, ex), (qy, sy, ay, ey) = xq, yq
    d, piece = qx.shape[1], 1000
    fy = qy.astype(np.float32)
    top_s, top_a, top_e = sy.max(), ay.max(), ey.max()
    for at in range(0, len(qx), ROWS):
        part = slice(at, at + ROWS)
        fx = qx[part].astype(np.float32)
        if d <= piece:
            dots = fx @ fy.T
        else:
            dots = sum((fx[:, k : k + piece] @ fy[:, k : k + piece].T).astype(np.float64) for k in range(0, d, piece))
        loose = (threshold - SLACK - ax[part] * top_e - ex[part] * top_a - ex[part] * top_e) / (sx[part] * top_s)
        r, c = np.nonzero(dots >= (loose - np.abs(loose) * 1e-6 - 1e-6).astype(dots.dtype)[:, None])
        v = dots[r, c].astype(np.float64)
        r = r + at
        if diagonal:
            below = r < c
            r, c, v = r[below], c[below], v[below]
        near, err = v * sx[r] * sy[c], ax[r] * ey[c] + ex[r] * ay[c] + ex[r] * ey[c] + SLACK
        sure, maybe = near - err >= threshold, (near - err < threshold) & (near + err >= threshold)
        r1, c1 = r[maybe], c[maybe]
        for k in range(0, len(r1), 200_000):
            rr, cc = r1[k : k + 200_000], c1[k : k + 200_000]
            good = np.einsum("ij,ij->i", x_full[rr], y_full[cc]) >= threshold
            yield rr[good], cc[good]
        yield r[sure], c[sure]


def joined(label: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Merges the label trees of linked positions; label[i] is a root at return."""
    while len(r):
        a, b = label[r], label[c]
        differ = a != b
        if not differ.any():
            break
        r, c, a, b = r[differ], c[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, label[label]):
            label = label[label]
    return label


def _blocks(classes: DataFrame, n_blocks: int) -> DataFrame:
    """One row per (dim, block): ids, multiplicities and full vectors as bytes."""

    def pack(key, t):
        full = t.column("emb").combine_chunks()
        full = np.asarray(full.flatten() if isinstance(full, pa.ListArray) else full.values, dtype=np.float64)
        row = [key[0].as_py(), key[1].as_py(), t.column("rep").to_numpy().astype(np.int64).tobytes(), t.column("m").to_numpy().astype(np.int64).tobytes()]
        if np.array_equal(full.astype(np.float32).astype(np.float64), full):
            row += [full.astype(np.float32).tobytes(), True]
        else:
            row += [full.tobytes(), False]
        return pa.table({n: pa.array([v]) for n, v in zip(("dim", "block", "ids", "ms", "full", "single"), row, strict=True)}).cast(
            pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("ms", pa.binary()), ("full", pa.binary()), ("single", pa.bool_())])
        )

    dealt = classes.withColumn("dim", F.size("emb")).withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(n_blocks)).cast("int"))
    return dealt.groupBy("dim", "block").applyInArrow(pack, "dim int, block int, ids binary, ms binary, full binary, single boolean")


def _tiles(blocks: DataFrame, n_blocks: int, threshold: float) -> DataFrame:
    """(a, b, links): b null: links more for a; else a and b are joined."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                sides = []
                for k in "12":
                    full = np.frombuffer(r["full" + k], np.float32 if r["single" + k] else np.float64).astype(np.float64)
                    full = unit(full.reshape(-1, r["dim"]))
                    sides.append((np.frombuffer(r["ids" + k], np.int64), np.frombuffer(r["ms" + k], np.int64), full, quantised(full)))
                (ix, mx, fx, qx), (iy, my, fy, qy) = sides
                diagonal = r["i"] == r["j"]
                nx, ny = np.zeros(len(ix), np.int64), np.zeros(len(iy), np.int64)
                label = np.arange(len(ix) + (0 if diagonal else len(iy)))
                off = 0 if diagonal else len(ix)
                for rr, cc in tile_links(qx, qy, fx, fy, threshold, diagonal):
                    nx += np.bincount(rr, my[cc], len(ix)).astype(np.int64)
                    ny += np.bincount(cc, mx[rr], len(iy)).astype(np.int64)
                    label = joined(label, rr, cc + off)
                ids, links = (ix, nx + ny) if diagonal else (np.concatenate([ix, iy]), np.concatenate([nx, ny]))
                has, tied = links > 0, label != np.arange(len(label))
                a = np.concatenate([ids[has], ids[tied]])
                to = np.concatenate([np.zeros(has.sum(), np.int64), ids[label[tied]]])
                null = np.concatenate([np.ones(has.sum(), bool), np.zeros(tied.sum(), bool)])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(to, mask=null), pa.array(np.concatenate([links[has], np.zeros(tied.sum(), np.int64)]))], names=["a", "b", "links"])

    spark = blocks.sparkSession
    plan = spark.range(n_blocks * n_blocks, numPartitions=1).select((F.col("id") % n_blocks).cast("int").alias("i"), F.expr(f"id div {n_blocks}").cast("int").alias("j")).where("i <= j")
    one = blocks.select("dim", F.col("block").alias("i"), *[F.col(c).alias(c + "1") for c in ("ids", "ms", "full", "single")])
    two = blocks.select(F.col("dim").alias("dim2"), F.col("block").alias("j"), *[F.col(c).alias(c + "2") for c in ("ids", "ms", "full", "single")])
    tiles = plan.join(one, "i").join(two, "j").where("dim = dim2")
    tiles = tiles.repartition(max(1, n_blocks * (n_blocks + 1) // 2), "i", "j")
    return tiles.mapInArrow(run, "a long, b long, links long")


def embedding_links(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", emb_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept."""
    return _linked(vectors, threshold, id_col, emb_col, block).select(F.col("id").alias(id_col), "n_links", "component_id", "kept")


def _linked(vectors: DataFrame, threshold: float, id_col: str, emb_col: str, block: int) -> DataFrame:
    """One row per row of vectors: id, emb, n_links, component_id, kept."""
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(emb_col).cast("array<double>").alias("emb"))
    fit = F.exists("emb", lambda x: x != 0) & F.forall("emb", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    base = base.withColumn("fit", F.coalesce(fit & F.col("id").isNotNull(), F.lit(False)))
    classes = base.where("fit").select("id", "emb").distinct().groupBy("emb").agg(F.min("id").alias("first"), F.count("*").alias("m"))
    classes = cut(classes.withColumn("rep", F.xxhash64("emb")), "classes")  # the vector names the class, for an id may have several
    n, width = classes.agg(F.count("*"), F.max(F.size("emb"))).first()
    n_blocks = max(1, -(-n // max(1, min(block, CELLS // (width or 1)))))
    found = cut(_tiles(cut(_blocks(classes, n_blocks), "blocks"), n_blocks, threshold), "links")
    comps = connected_components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    home = classes.join(comps, classes.rep == comps.node, "left").withColumn("component", F.coalesce("component", "rep"))
    least = home.groupBy("component").agg(F.min("first").alias("component_id"))
    done = home.join(links, home.rep == links.a, "left").join(least, "component")
    done = done.select(F.col("emb").alias("emb2"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    out = base.join(done, base.fit & (F.col("emb") == F.col("emb2")), "left")
    comp = F.coalesce("component_id", "id")
    return out.select("id", "emb", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def dedup_embeddings(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", emb_col: str = "embedding") -> DataFrame:
    """The rows of vectors without those that a vector with a smaller id stands for; the vectors of one id are judged each by itself."""
    p = fresh(vectors)
    gone = _linked(vectors, threshold, id_col, emb_col, BLOCK).where("not kept").select(F.col("id").alias(p + "id"), F.xxhash64("emb").alias(p + "h")).distinct()
    key = F.xxhash64(F.col(emb_col).cast("array<double>"))
    return vectors.join(gone, (F.col(id_col).cast("long") == F.col(p + "id")) & (key == F.col(p + "h")), "left_anti")
