"""Minimum-cost-flow resharding: the block transfers that give new shards their capacities while moving the fewest bytes."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, shelter, sheltered

#: Blocks of an old shard. Their sums are what the driver sees: old shards times BLOCKS numbers, whatever the rows.
BLOCKS = 256
#: Rows of a shard that rewrite() gives to one task.
FILE_ROWS = 4096


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Units from each source to each sink at the least total of units times cost(i, j), by successive shortest paths with potentials."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new capacities are less than what there is")
    price, flow = [0] * (n + m), {}
    left, room = list(supply), list(capacity)
    while any(left):
        dist, back, heap = [None] * (n + m), {}, []
        for i in range(n):
            if left[i]:
                dist[i] = 0
                heap.append((0, i))
        heapq.heapify(heap)
        done, best = set(), None
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            if u >= n and room[u - n]:
                best = u
                break
            edges = ((n + j, cost(u, j)) for j in range(m)) if u < n else ((i, -cost(i, u - n)) for i in range(n) if flow.get((i, u - n)))
            for v, c in edges:
                if v not in done and (dist[v] is None or d + c + price[u] - price[v] < dist[v]):
                    dist[v] = d + c + price[u] - price[v]
                    back[v] = u
                    heapq.heappush(heap, (dist[v], v))
        for v in range(n + m):
            price[v] += dist[v] if v in done else dist[best]
        path, v = [], best
        while v in back:
            path.append((back[v], v))
            v = back[v]
        push = min(left[v], room[best - n], *(flow[(b, a - n)] for a, b in path if a >= n))
        for a, b in path:
            if a < n:
                flow[(a, b - n)] = flow.get((a, b - n), 0) + push
            else:
                flow[(b, a - n)] -= push
        left[v] -= push
        room[best - n] -= push
    return {k: x for k, x in flow.items() if x}


def capacities(total: int, shards: int) -> list[int]:
    """Capacities that differ by one byte at most and sum to total."""
    return [total * (j + 1) // shards - total * j // shards for j in range(shards)]


def plan(blocks: list[tuple[int, int, int]], shards: int, capacity: list[int] | None = None) -> list[tuple[int, int, int, int, int]]:
    """Cuts of the old shards' bytes: (old shard, block, first byte within the block, byte after the last, new shard).

    blocks: (old shard, block, bytes). A byte costs 1 where it changes its shard's number and 0 where it stays, so the
    flow keeps all that fits. What stays comes first in an old shard's bytes, then what goes, by new shard.
    """
    old = sorted({b[0] for b in blocks})
    size = {s: sum(b[2] for b in blocks if b[0] == s) for s in old}
    capacity = capacity or capacities(sum(size.values()), shards)
    flow = min_cost_flow([size[s] for s in old], capacity, lambda i, j: int(old[i] != j))
    cuts = []
    for i, s in enumerate(old):
        parts = sorted(((j, x) for (k, j), x in flow.items() if k == i), key=lambda p: (p[0] != s, p[0]))
        own = sorted((b[1], b[2]) for b in blocks if b[0] == s)
        at = 0
        for block, amount in own:
            if not amount:
                continue
            begin = 0
            while begin < amount:
                j, x = parts[at]
                take = min(x, amount - begin)
                cuts.append((s, block, begin, begin + take, j))
                begin += take
                parts[at] = (j, x - take)
                if take == x:
                    at += 1
    return cuts


def sized(docs: DataFrame, old_shards: int, old: str | None = None, blocks: int = BLOCKS) -> DataFrame:
    """docs with size (UTF-8 bytes of text, null none, plus 8), old_shard, and the block and place of a row in it.

    old names the column with a row's present shard; null: rows lie in `old_shards` shards by a hash of doc_id (null
    ids: of the text). Blocks hold half-octaves of size in falling order, 64 at most, cut further by the hash.
    """
    docs = docs.drop("size", "block", "place", *(["old_shard"] if old is None else []))
    spot = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    rows = docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).withColumn("place", spot)
    rows = rows.withColumn("old_shard", F.pmod("place", F.lit(old_shards)).cast("int") if old is None else F.col(old).cast("int"))
    rank = F.lit(63) - F.least(F.floor(F.log2(F.col("size").cast("double")) * 2), F.lit(63))
    each = max(1, blocks // 64)
    return rows.withColumn("block", (rank * each + F.pmod(F.shiftright("place", 20), F.lit(each))).cast("int"))


def place(rows: DataFrame, shards: int, workspace: Workspace, capacity: list[int] | None = None) -> DataFrame:
    """Rows of sized() with shard and slot (gapless from 0 in each shard) instead of block and place.

    A new shard's size differs from its capacity by less than the largest boundary row of its transfers; an old
    shard's large rows come first, so that the cuts fall among small ones. Rows are ranked only within a block of one
    old shard, so no task sees a whole shard; the driver sees sums by block. Repeated rows are placed one by one. An
    empty table gives an empty one.
    """
    kept = [c for c in rows.columns if c not in ("block", "place", "shard", "slot")]
    rows = workspace.save(rows, "sized")
    sums = [(r[0], r[1], r[2]) for r in rows.groupBy("old_shard", "block").agg(F.sum("size")).collect()]
    table = rows.sparkSession.createDataFrame(plan(sums, shards, capacity) if sums else [], "cut_old int, cut_block int, cut_begin long, cut_end long, shard int")
    w = Window.partitionBy("old_shard", "block").orderBy(F.desc("size"), "place", *(["doc_id"] if "doc_id" in kept else []))
    run = F.struct(F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"), F.row_number().over(w).alias("i"))
    inner = rows.withColumn("run", run).withColumn("middle", F.col("run.begin") + F.floor(F.col("size") / 2)).withColumn("i", F.col("run.i")).drop("run")
    spot = (F.col("old_shard") == F.col("cut_old")) & (F.col("block") == F.col("cut_block"))
    placed = inner.drop("shard").join(F.broadcast(table), spot & (F.col("middle") >= F.col("cut_begin")) & (F.col("middle") < F.col("cut_end")))
    placed = workspace.save(placed.select(*(F.col(f"`{c}`") for c in kept), "block", "shard", "i"), "placed")
    workspace.drop("sized")
    # a cut takes rows that follow one another in their block, so a slot is the row's place there plus one number per cut
    cuts = placed.groupBy("shard", "old_shard", "block").agg(F.count("*").alias("n"), F.min("i").alias("i0"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1))
    first = cuts.select(F.col("shard").alias("f_shard"), F.col("old_shard").alias("f_old"), F.col("block").alias("f_block"), (F.coalesce(before, F.lit(0)) - F.col("i0")).alias("shift"))
    out = placed.join(F.broadcast(first), (F.col("shard") == F.col("f_shard")) & (F.col("old_shard") == F.col("f_old")) & (F.col("block") == F.col("f_block")))
    return out.select(*(F.col(f"`{c}`") for c in kept), "shard", (F.col("shift") + F.col("i")).cast("long").alias("slot"))


def reshard(docs: DataFrame, old_shards: int, shards: int, workspace: Workspace, old: str | None = None, capacity: list[int] | None = None) -> DataFrame:
    """docs with size, old_shard, shard and slot; what sized() and place() say holds. Columns of docs with the names of
    the results are replaced, all others kept."""
    columns, used = docs.columns, ("doc_id", "text")
    if old is not None:
        docs = docs.withColumns({"old_shard": F.col(old)})
    own = sized(shelter(docs, *used, "old_shard"), old_shards, "old_shard" if old is not None else None)
    return sheltered(place(own, shards, workspace, capacity), columns, used, "size", "old_shard", "shard", "slot")


def rewrite(placed: DataFrame, path: str, first: bool = False) -> None:
    """Makes the files below path, shard=K/ each, those of the new shards: writes every shard that gains or loses rows
    anew and removes folders of shards that are left without rows; the files of all others stay as they are. first: the
    old shards do not lie below path yet, so all are written.

    placed must not be read from the files below path (place() gives a written table). Columns are those of placed
    but old_shard. Runs of FILE_ROWS slots go to a task each, so that a large shard is several sorted files.
    """
    spark = placed.sparkSession
    moves = [(r[0], r[1]) for r in placed.select("old_shard", "shard").distinct().collect()]
    touched = sorted({s for a, b in moves if first or a != b for s in (a, b)})
    rows = placed.where(F.col("shard").isin(touched)).drop("old_shard")
    dealt = rows.repartition("shard", F.floor(F.col("slot") / FILE_ROWS)).sortWithinPartitions("shard", "slot")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("shard").parquet(path)
    for s in sorted(set(touched) - {b for _, b in moves}):
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={s}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def op6_min_cost_flow_resharding(spark, sf_dir: str) -> DataFrame:
    row = (F.col("_metadata.file_path").alias("row_file"), F.col("_metadata.row_index").alias("row_at"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *row)
    workspace = Workspace(spark, "op6")
    # sizes are taken from the texts at once; what is placed and numbered is then a few numbers per document
    placed = place(sized(docs, 16).drop("text"), 24, workspace)
    spots = workspace.save(placed.select("row_file", "row_at", "old_shard", "shard", "slot"), "spots")
    workspace.drop("placed")
    path = f"{workspace.root}/shards"
    rewrite(docs.join(spots.hint("shuffle_hash"), ["row_file", "row_at"]).drop("row_file", "row_at"), path, first=True)  # the given table is one file: its 16 shards are hashes
    written = spark.read.schema("doc_id long, text string, slot long, shard int").parquet(path)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    return written.select("doc_id", size, crc, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
