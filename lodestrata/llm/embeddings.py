"""Embedding near-dedup by PCA-ordered tiled comparison with suffix-norm bounds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, settle, stars
from .shared import Workspace

THRESHOLD = 0.95
TILE = 4096
#: Numbers in a tile's vectors, so that long vectors make tiles of fewer rows; tiles in a strip, which a task reads as a whole.
TILE_NUMBERS = 1 << 18
STRIP = 16
#: Rows of one block of a tile, so that a block of products holds BLOCK * BLOCK numbers.
BLOCK = 512
#: Vectors, and numbers in them, from which the driver makes axes.
SAMPLE = 20_000
SAMPLE_NUMBERS = 1 << 21
BOX = 12
#: Share of a block's pairs above which its products are made as a whole and not pair by pair.
DENSE = 0.05
#: Edges of a task that are reduced at a time.
EDGES = 1 << 20
#: Slack of the bounds, well above rounding; what passes is decided in double precision on the vectors as given.
SLACK = 1e-4


def rotation(sample: np.ndarray) -> np.ndarray:
    """Principal axes of unit vectors, leading ones first. Any rotation gives right results, this one early decisions."""
    _, axes = np.linalg.eigh(np.cov(sample.T) if len(sample) > 1 else np.eye(sample.shape[1]))
    return np.atleast_2d(axes)[:, ::-1]


def stages(dims: int) -> list[int]:
    """Where the accumulation of dimensions stops to look at the bounds."""
    return sorted({min(dims, max(1, dims // 4)), min(dims, max(1, dims // 2)), dims})


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    scale = np.abs(v).max(1, keepdims=True)
    v = v / scale
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def turned(vectors: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unit vectors, what they are along the axes, the norms of their remainders after each stage, and the first stage with its remainder."""
    x = (vectors @ axes).astype(np.float32)
    sq = x.astype(np.float64) ** 2
    tails = np.sqrt(np.stack([sq[:, k:].sum(1) for k in stages(x.shape[1])], 1)).astype(np.float32)
    return vectors, x, tails, np.concatenate([x[:, : stages(x.shape[1])[0]], tails[:, :1]], 1)


def reached(products: np.ndarray, need: np.float32) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero(products >= need), eight at a time where there are few."""
    hit = np.zeros(-(-products.size // 8) * 8, bool)
    np.greater_equal(products, need, out=hit[: products.size].reshape(products.shape))
    at = (np.flatnonzero(hit.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.divmod(at[hit[at]], products.shape[1])


def links(one: np.ndarray, other: np.ndarray, axes: np.ndarray, threshold: float):
    """Index pairs of rows of two tiles (unit vectors) whose cosine is at least threshold, block by block."""
    return _links(turned(one, axes), turned(other, axes), threshold)


def _links(one: tuple[np.ndarray, ...], other: tuple[np.ndarray, ...], threshold: float):
    """links() of tiles that are turned already.

    Dimensions are accumulated in PCA order; after each stage a pair lives on only if what it has so far plus the
    product of the norms of the two remainders can still reach the threshold. In the first stage the remainder is one
    more dimension.
    """
    (u, x, tx, fx), (v, y, ty, fy) = one, other
    cuts, need = stages(x.shape[1]), np.float32(threshold - SLACK)
    for i in range(0, len(x), BLOCK):
        for j in range(0, len(y), BLOCK):
            acc = fx[i : i + BLOCK] @ fy[j : j + BLOCK].T
            p, q = reached(acc, need)
            if len(p) > DENSE * acc.size:
                # so many pairs live on that the block's product is made as a whole
                p, q = reached(x[i : i + BLOCK] @ y[j : j + BLOCK].T, need)
            else:
                part = acc[p, q] - tx[i + p, 0] * ty[j + q, 0]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False), 1):
                    part = part + np.einsum("ij,ij->i", x[i + p, lo:hi], y[j + q, lo:hi])
                    ok = part + tx[i + p, k] * ty[j + q, k] >= need
                    p, q, part = p[ok], q[ok], part[ok]
            if len(p):
                ok = decide(u[i : i + BLOCK], v[j : j + BLOCK], p, q, threshold)
                p, q = p[ok], q[ok]
            yield i + p, j + q


def decide(one: np.ndarray, other: np.ndarray, p: np.ndarray, q: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the products of rows p and q, summed in double precision in one way, reach the threshold. Of many pairs
    a product of matrices settles those that lie further from it than any order of summing can matter."""
    exact = lambda k: np.einsum("ij,ij->i", one[p[k]], other[q[k]]) >= threshold
    if len(p) <= DENSE * len(one) * len(other):
        return exact(slice(None))
    product = (one @ other.T)[p, q]
    ok = product >= threshold
    for k in np.array_split(close := np.flatnonzero(np.abs(product - threshold) < 1e-9), len(close) // 65536 + 1):
        ok[k] = exact(k)
    return ok


def near_vectors(vectors: DataFrame, workspace: Workspace, threshold: float = THRESHOLD, tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different length. Equal vectors are one row of the comparison, with their number as its weight, so a third of all
    rows being one vector costs one row; rows find theirs by 128 bits of hash. The others are sorted along the first
    principal axis into tiles; pairs of tiles are compared if their boxes along the leading axes are near enough for
    the threshold. Tiles are written once and read by the tasks that compare them, so that disk follows the rows and
    only the comparisons their square; a task returns numbers of links and a spanning forest, never pairs. The axes
    come from at most `sample` vectors, which changes the work but not the result. Rows with null vec_id keep
    n_links 0, a null component and kept false.
    """
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("embedding", lambda x: x != 0)
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    valid = base.where(good & F.col("vec_id").isNotNull())
    heads = valid.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))
    heads = workspace.save(heads.withColumn("dims", F.size("embedding")), "heads")
    prints = [F.xxhash64(*seed, "embedding").alias(f"print{k}") for k, seed in enumerate(((), (F.lit(1),)))]
    member = workspace.save(valid.select("vec_id", *prints).join(heads.select("node", *prints), ["print0", "print1"]).select("vec_id", "node"), "members")
    counts, forests = [], []
    for k, (dims, total) in enumerate(heads.groupBy("dims").count().orderBy("dims").collect()):
        own = heads.where(F.col("dims") == dims)
        few = np.array([r[0] for r in own.select("embedding").limit(min(sample, max(2 * dims, SAMPLE_NUMBERS // dims))).collect()], np.float64)
        axes = rotation(unit(few))
        done = workspace.save(_compare(own, axes, total, threshold, min(tile, max(BLOCK, TILE_NUMBERS // dims)), workspace, k), f"compared-{k}")
        counts.append(done.where("other IS NULL").select("node", "n"))
        forests.append(done.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    if not counts:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    count, forest = counts[0], forests[0]
    for c, f in zip(counts[1:], forests[1:], strict=True):
        count, forest = count.union(c), forest.union(f)
    parts = components(forest, workspace)
    count = count.groupBy("node").agg(F.sum("n").alias("far"))
    per_head = heads.select("node", "n").join(count, "node", "left").join(parts, "node", "left").select("node", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = member.join(per_head, "node").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = base.select("vec_id").join(linked, "vec_id", "left")
    part = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), part.alias("component_id"), F.coalesce(F.col("vec_id") == part, F.lit(False)).alias("kept"))


def _compare(heads: DataFrame, axes: np.ndarray, total: int, threshold: float, tile: int, workspace: Workspace, k: int) -> DataFrame:
    """node, other, n: the weighted number of links found of node (other null), or an edge of a forest (n null)."""
    lead, dims = axes[:, 0].tolist(), len(axes)
    kind = np.float32 if heads.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    first = F.aggregate(F.arrays_zip(F.col("embedding").alias("x"), F.array(*map(F.lit, lead)).alias("w")), F.lit(0.0), lambda s, z: s + z["x"] * z["w"]) / norm
    tiles = max(1, math.ceil(total / tile))
    dealt = heads.select("node", "n", "embedding", first.alias("lead")).repartitionByRange(tiles, "lead", "node")
    box = min(BOX, dims)

    def cut(batches):
        number, held, own, at = 0, 0, [], TaskContext.get().partitionId()

        def tables(least):
            nonlocal number, held, own
            while held >= least:
                ids, weights, v = (np.concatenate(x) for x in zip(*own, strict=True))
                low, high = ((f((unit(v[:tile]) @ axes)[:, :box], 0)).tolist() for f in (np.min, np.max))
                yield pa.RecordBatch.from_arrays([pa.array([at * 1_000_000 + number], pa.int64()), *(pa.array([x], pa.list_(pa.float64())) for x in (low, high)), *(pa.array([x[:tile].tobytes()], pa.binary()) for x in (ids, weights, v))], names=["tile", "low", "high", "ids", "weights", "vectors"])
                number, held, own = number + 1, max(0, held - tile), [(ids[tile:], weights[tile:], v[tile:])]

        for batch in batches:
            own.append((batch.column("node").to_numpy(), batch.column("n").to_numpy(), batch.column("embedding").flatten().to_numpy().reshape(-1, dims)))
            held += batch.num_rows
            yield from tables(tile)
        yield from tables(1)

    made = workspace.save(dealt.sortWithinPartitions("lead", "node").select("node", "n", "embedding").mapInArrow(cut, "tile long, low array<double>, high array<double>, ids binary, weights binary, vectors binary"), f"tiles-{k}")
    # unit vectors at this cosine lie within `reach` of each other
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    # every strip of tiles meets every other without a shuffle; of the two orders of a pair of tiles one counts, by a bit of each, so that all tasks have work
    strips = made.withColumn("bit", F.pmod(F.xxhash64("tile"), F.lit(2))).coalesce(max(STRIP, math.ceil(tiles / STRIP)))
    a, b = (strips.select([F.col(c).alias(f"{c}_{side}") for c in strips.columns]) for side in "ab")
    gaps = F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    once = (F.col("tile_a") == F.col("tile_b")) | ((F.col("tile_a") < F.col("tile_b")) == (F.col("bit_a") == F.col("bit_b"))) & (F.col("tile_a") != F.col("tile_b"))
    pairs = a.hint("shuffle_replicate_nl").join(b, once & (apart <= reach * reach)).select([f"{c}_{side}" for side in "ab" for c in ("tile", "ids", "weights", "vectors")])

    def run(batches):
        known, found, edges, size = {}, {}, [], 0

        def side(batch, r, s):
            at = batch.column(f"tile_{s}")[r].as_py()
            if at not in known:
                if len(known) > 4 * STRIP:
                    known.clear()
                get = lambda c, kind: np.frombuffer(batch.column(f"{c}_{s}")[r].as_py(), kind)
                ids = get("ids", np.int64)
                known[at] = ids, get("weights", np.int64), turned(unit(get("vectors", kind).reshape(-1, dims)), axes)
                found.setdefault(at, (ids, np.zeros(len(ids), np.int64)))
            return at, *known[at]

        for batch in batches:
            for r in range(batch.num_rows):
                (ta, ia, wa, va), (tb, ib, wb, vb) = side(batch, r, "a"), side(batch, r, "b")
                nodes = ia if ta == tb else np.concatenate([ia, ib])
                order = np.argsort(nodes, kind="stable")
                spot = np.empty(len(nodes), np.int64)
                spot[order] = np.arange(len(nodes))
                label = np.arange(len(nodes))
                for p, q in _links(va, vb, threshold):
                    if ta == tb:
                        ok = p != q
                        p, q = p[ok], q[ok]
                    else:
                        np.add.at(found[tb][1], q, wa[p])
                    np.add.at(found[ta][1], p, wb[q])
                    settle(label, spot[p], spot[q if ta == tb else q + len(ia)])
                leaf = np.flatnonzero(label != np.arange(len(nodes)))
                edges.append((nodes[order][leaf], nodes[order][label[leaf]]))
                size += len(leaf)
                if size > EDGES:
                    edges = [stars(*map(np.concatenate, zip(*edges, strict=True)))]
                    size = len(edges[0][0])
        for ids, n in found.values():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.nulls(len(some), pa.int64()), pa.array(n[some])], names=["node", "other", "n"])
        if size:
            one, other = stars(*map(np.concatenate, zip(*edges, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(other), pa.nulls(len(one), pa.int64())], names=["node", "other", "n"])

    return pairs.mapInArrow(run, "node long, other long, n long")


def op2_pca_tiled_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Workspace(spark, "op2"))
