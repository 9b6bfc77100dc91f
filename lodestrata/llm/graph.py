"""Near-duplicate graphs from buckets: candidate pairs, exact links, and connected components, none of it on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import MASK, Workspace, buffers, slices


#: Edges of a partition that are reduced at a time.
FOREST = 1 << 20


def _forest(batches):
    """A spanning forest of the edges of a partition, as stars; of more than FOREST edges, one forest for each part."""
    a = b = np.zeros(0, np.int64)

    def table():
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        a, b = (np.concatenate([x, batch.column(c).to_numpy()]) for c, x in (("a", a), ("b", b)))
        if len(a) >= FOREST:
            a, b = stars(a, b)
            if 2 * len(a) > FOREST:
                yield table()
                a = b = a[:0]
    a, b = stars(a, b)
    yield table()


def components(links: DataFrame, workspace: Workspace, name: str = "cc", rounds: int = 40) -> DataFrame:
    """node, component (the smallest node reachable) of every node that has a link; links are rows a, b of longs.

    Each task first replaces its edges by a star forest. Then large-star and small-star steps alternate until no edge
    changes: every node is joined to its smallest neighbour, in O(log^2) rounds. Steps are joins on minima, never a
    list of a node's neighbours, so a hub is a skewed join that Spark splits. Each round's edges are a written table.
    """
    edges = workspace.save(links.where("a <> b").select("a", "b").mapInArrow(_forest, "a long, b long"), f"{name}-0")
    for k in range(1, rounds + 1):
        # large star: larger neighbours go to the smallest of neighbours and self
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours and self go to the smallest neighbour; a > b holds in every edge
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, large["a"] == least["u"]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        after = workspace.save(small.select("e.a", "e.b").where("a <> b").distinct(), f"{name}-{k}")
        # stars: no node is both a leaf and a centre, and no leaf has two centres
        ends = after.select(F.col("a").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(after.select("b", F.lit(0), F.lit(1)))
        settled = ends.groupBy("x").agg(F.sum("leaf").alias("n"), F.max("centre").alias("c")).where("n > 1 OR n = 1 AND c = 1").isEmpty()
        workspace.drop(f"{name}-{k - 1}")
        edges = after
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())


#: Entries of buckets that one task sorts, members of a bucket compared pair by pair, members and bytes of a block.
ENTRIES = 1 << 19
FEW = 12
BLOCK = 512
BLOCK_BYTES = 1 << 20
#: Columns of one step of a block's product.
COLUMNS = 1 << 12


def listed(batch) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their nodes, of rows with a node and a list of its buckets (null: none)."""
    column = batch.column("buckets").drop_null()
    node = batch.column("node").filter(batch.column("buckets").is_valid()).to_numpy()
    return column.flatten().to_numpy(), np.repeat(node, np.diff(column.offsets.to_numpy()))


def shared_buckets(found: DataFrame, entries: int, workspace: Workspace, flat: Callable = listed, step: int = 1 << 14) -> DataFrame:
    """bucket, node, leader of every bucket with two nodes or more; flat makes buckets and nodes of `step` rows of
    found, and entries says how many there are.

    Of the nodes that share a bucket within these rows only the smallest travels on, as their leader, packed with 12
    bytes to the task of the bucket's leading bits; the others are rows with this leader at once. So a bucket that a
    third of all nodes share sends one entry from each step. Among leaders of one bucket the smallest leads.
    """
    bits = max(6, int(np.ceil(np.log2(max(1, entries / ENTRIES)))))

    def packed(batches):
        task = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(batch.slice(i, step) for batch in batches for i in range(0, batch.num_rows, step)):
            bucket, node = flat(batch)
            if not len(bucket):
                continue
            # 32 bits beyond the leading ones tell a task's buckets apart but for one in some thousand, which verification sorts out
            bucket = bucket.view(np.uint64) >> np.uint64(32 - bits)
            order = np.argsort(bucket)
            bucket, node = bucket[order], node[order]
            head = np.flatnonzero(starts(bucket))
            size = np.diff(np.append(head, len(bucket)))
            low, many = node[head], np.zeros(len(head), bool)
            several = np.flatnonzero(np.repeat(size > 1, size))
            if len(several):
                b, n = bucket[several], node[several]
                order = np.lexsort((n, b))
                b, n = b[order], n[order]
                new = starts(b)
                lead = n[np.maximum.accumulate(np.where(new, np.arange(len(n)), 0))]
                low[size > 1] = n[new]
                own = ~new & (n != lead) & np.concatenate([[True], (b[1:] != b[:-1]) | (n[1:] != n[:-1])])
                many[np.searchsorted(bucket[head], b[own])] = True
                if own.any():
                    yield pa.RecordBatch.from_arrays([pa.array([-1 - (task + number)]), *(pa.array([x[own].astype(np.int64).tobytes()], pa.binary()) for x in (b, n, lead))], names=["lead", "keys", "nodes", "more"])
            bucket = bucket[head]
            lead = (bucket >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(starts(lead))
            ends = np.append(cuts[1:], len(lead))
            yield pa.RecordBatch.from_arrays([pa.array(lead[cuts]), *(pa.array([y(x[i:j]).tobytes() for i, j in zip(cuts, ends, strict=True)], pa.binary()) for x, y in ((bucket.astype(np.uint32), np.asarray), (low, np.asarray), (many, np.packbits)))], names=["lead", "keys", "nodes", "more"])

    def gathered(table: pa.Table) -> pa.Table:
        key = table.column("lead")[0].as_py()
        bucket, node, more = ([np.frombuffer(x.as_py(), kind) for x in table.column(c)] for c, kind in zip(("keys", "nodes", "more"), (np.int64,) * 3 if key < 0 else (np.uint32, np.int64, np.uint8), strict=True))
        if key < 0:
            return pa.table({"bucket": np.concatenate(bucket), "node": np.concatenate(node), "leader": np.concatenate(more)})
        more = np.concatenate([np.unpackbits(x, count=len(n)) for x, n in zip(more, node, strict=True)])
        bucket, node = np.concatenate(bucket), np.concatenate(node)
        order = np.argsort(bucket)
        bucket, more = bucket[order], more[order]
        size = np.diff(np.append(np.flatnonzero(starts(bucket)), len(bucket)))
        some = np.flatnonzero(np.repeat(size > 1, size) | (more > 0))
        bucket, node, more = bucket[some], node[order[some]], more[some]
        order = np.lexsort((node, bucket))
        bucket, node, more = bucket[order], node[order], more[order]
        head = np.flatnonzero(starts(bucket))
        size = np.diff(np.append(head, len(bucket)))
        new = starts(bucket)
        new[1:] |= node[1:] != node[:-1]
        keep = new & np.repeat((node[head] != node[head + size - 1]) | (np.maximum.reduceat(more, head) > 0), size) if len(head) else new
        return pa.table({"bucket": (key << 32) | bucket[keep].astype(np.int64), "node": node[keep], "leader": np.repeat(node[head], size)[keep]})

    sent = found.mapInArrow(packed, "lead long, keys binary, nodes binary, more binary")
    rows = sent.repartition(min(1 << bits, 20_000), "lead").groupBy("lead").applyInArrow(gathered, "bucket long, node long, leader long")
    return workspace.save(rows, "buckets")


def linked(rows: DataFrame, texts: DataFrame, flat: Callable, percent: int, workspace: Workspace, sizes: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """node, component for the nodes that links join: pairs of one bucket with 100 * intersection >= percent * union.

    rows: what shared_buckets() gives; texts: node, t of the nodes in it; flat: hashes of the shingles of each text of an
    Arrow column, one text after another, and where each text's begin; sizes: node, n, the sizes of the sets, to spare
    pairs that differ too much; known: a, b, links that need no comparison.
    Nodes are representatives of exact copies. In a bucket every node is first compared with its leader and leaders with
    the smallest, so that a group of n near copies costs n comparisons and not n^2. Buckets whose nodes are then still in
    several components are compared in full, those with the same nodes once: small ones as pairs, larger ones in blocks
    of at most about BLOCK members and BLOCK_BYTES bytes against one another, each a product of 0/1 matrices of which a
    spanning forest of the links leaves the task. So every pair that shares a bucket is either compared or already
    joined, and no link between components is lost.
    """

    def compare(batches):
        for batch in batches:
            one, other = batch.column("ta"), batch.column("tb")
            keep = [similar(*flat(one.slice(i, j - i)), *flat(other.slice(i, j - i)), percent) for i, j in slices(buffers(one)[1] + buffers(other)[1])]
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(np.concatenate(keep)))

    def verify(pairs: DataFrame) -> DataFrame:
        if sizes is not None:
            pairs = pairs.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
            pairs = pairs.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b")
        both = pairs.join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a")
        return both.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long")

    def block(table: pa.Table) -> pa.Table:
        node, part, side = (table.column(c).to_numpy() for c in ("node", "part", "side"))
        a = b = np.zeros(0, np.int64)
        if len(part) and part.min() < part.max():
            p, q = block_links(*flat(table.column("t").combine_chunks()), part, np.flatnonzero((side & 1) > 0), np.flatnonzero((side & 2) > 0), percent)
            a, b = stars(node[p], node[q])
        return pa.table({"a": a, "b": b})

    texts = workspace.save(texts.withColumn("w", F.octet_length("t")), "texts")
    star = rows.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    first = workspace.save(verify(star) if known is None else verify(star).union(known), "links-1")
    parts = components(first, workspace, "cc1")
    whole = workspace.save(rows.select("bucket", "node").join(parts, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("part")), "whole")
    mixed = whole.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("n")).where("p < q AND n > 2").select("bucket")
    every = workspace.save(whole.join(mixed, "bucket", "left_semi").distinct().join(texts.select("node", "w"), "node"), "open")
    sums = every.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("w").alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("alike"))
    rest = every.join(sums.dropDuplicates(["members", "alike"]).where("members > 2"), "bucket")
    small = rest.where(f"members <= {FEW}")
    left, right = small.select("bucket", F.col("node").alias("a"), F.col("part").alias("pa")), small.select("bucket", F.col("node").alias("b"), F.col("part").alias("pb"))
    cross = left.join(right, "bucket").where("a < b AND pa <> pb").select("a", "b").distinct()
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    dealt = rest.where(f"members > {FEW}").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # side 1: rows of a block's matrix, 2: its columns, 3: both, in a block of members against themselves
    side = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("int")
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "part", side.alias("side"))
    joined = dealt.join(texts.select("node", "t"), "node").groupBy("bucket", "i", "j").applyInArrow(block, "a long, b long")
    second = workspace.save(verify(cross).union(joined), "links-2")
    if second.isEmpty():
        return parts
    return components(parts.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")).union(second), workspace, "cc2")


def starts(x: np.ndarray) -> np.ndarray:
    """True where a number differs from the one before."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers."""
    x = np.sort(x)
    return x if len(x) < 2 else x[np.concatenate([[True], x[1:] != x[:-1]])]


def keyed(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and hashes of the distinct hashes of each row, in order of both. Row numbers take the bits they need of 64."""
    n = len(at) - 1
    bits = np.uint64(max(1, (n - 1).bit_length()))
    key = distinct((np.repeat(np.arange(n, dtype=np.uint64), np.diff(at)) << (np.uint64(64) - bits)) | (hashes >> bits))
    row = key >> (np.uint64(64) - bits)
    return row.astype(np.int64), key


def similar(one: np.ndarray, one_at: np.ndarray, other: np.ndarray, other_at: np.ndarray, percent: int) -> np.ndarray:
    """Of two rows of sets each: 100 * intersection >= percent * union, neither being empty. Sets are told apart on the
    bits that row numbers leave, but one."""
    n = len(one_at) - 1
    bits = max(1, (n - 1).bit_length())
    up, down = np.uint64(64 - bits), np.uint64(bits)
    keys = []
    for side, (hashes, at) in enumerate(((one, one_at), (other, other_at))):
        key = (hashes >> down) & np.uint64(MASK - 1)
        key |= np.repeat((np.arange(n, dtype=np.uint64) << up) | np.uint64(side), np.diff(at))
        keys.append(key)
    key = distinct(np.concatenate(keys))
    row = (key >> up).astype(np.int64)
    both = np.bincount(row[1:][(key[1:] ^ key[:-1]) == 1], minlength=n)
    every = np.bincount(row, minlength=n) - both
    return (both > 0) & (100 * both >= percent * every)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of edges a, b as edges from the smallest node of each to its others."""
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(names))
    settle(label, place[: len(a)], place[len(a) :])
    leaf = np.flatnonzero(label != np.arange(len(names)))
    return names[label[leaf]], names[leaf]


def settle(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Joins the components of p and q in label, an array of smallest members, in place."""
    while len(p):
        lp, lq = label[p], label[q]
        ok = lp != lq
        if not ok.any():
            return
        p, q, lp, lq = p[ok], q[ok], lp[ok], lq[ok]
        np.minimum.at(label, np.maximum(lp, lq), np.minimum(lp, lq))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def block_links(hashes: np.ndarray, at: np.ndarray, part: np.ndarray, rows: np.ndarray, columns: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows and columns in different parts whose sets are similar enough, each pair once in a square block."""
    n = len(at) - 1
    of, key = keyed(hashes, at)
    size = np.bincount(of, minlength=n)
    value = key << np.uint64(max(1, (n - 1).bit_length()))
    order = np.argsort(value)
    of, new = of[order], starts(value[order])
    count = np.diff(np.append(np.flatnonzero(new), len(new)))
    of, number = of[np.repeat(count > 1, count)], np.repeat(np.arange((count > 1).sum()), count[count > 1])
    both = np.zeros((len(rows), len(columns)), np.float32)
    row, column = np.full(n, -1), np.full(n, -1)
    row[rows], column[columns] = np.arange(len(rows)), np.arange(len(columns))
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        lo, hi = np.searchsorted(number, [at, at + COLUMNS])
        o, k = of[lo:hi], number[lo:hi] - at
        a, b = np.zeros((len(rows), int(k.max()) + 1), np.float32), np.zeros((len(columns), int(k.max()) + 1), np.float32)
        a[row[o][row[o] >= 0], k[row[o] >= 0]] = 1
        b[column[o][column[o] >= 0], k[column[o] >= 0]] = 1
        both += a @ b.T
    union = size[rows][:, None] + size[columns][None, :] - both
    p, q = np.nonzero((100 * both >= percent * union) & (both > 0) & (part[rows][:, None] != part[columns][None, :]))
    return rows[p], columns[q]
