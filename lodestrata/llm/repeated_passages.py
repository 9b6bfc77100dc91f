"""Suffix-array dedup of passages: external induced sorting of the places that documents may share.

A string of LENGTH bytes has one anchor, the least of its hashed grams of GRAM bytes, wherever it stands. So two
documents that share a string share its anchor, and only what stands around anchors of several documents has to be
sorted. Shards of such places are sorted by induced_sorting.py; neighbours in suffix order that have LENGTH bytes in
common form a group, and all but those of the smallest document are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .induced_sorting import repeated_strings
from .shared import Workspace, buffers, inverses, mix, prefix, slices, span

LENGTH = 50
GRAM = 26
#: Windows hashed at a time (a place must fit the low 20 bits of a key), bytes of a block of documents and of a shard.
WINDOWS = 1 << 17
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 2 << 20
#: An anchor with more bytes of different places than this is not sorted in one shard; its strings are compared one by one.
HOT_BYTES = 8 << 20
#: Bytes by which the surroundings of an anchor are told apart before places are sorted.
STEP = 5
_LOW = np.uint64((1 << 20) - 1)


def places(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Of documents that lie one after another: for each anchor the document's number, the first byte and length of the
    place (all strings of `length` bytes that have this anchor), the anchor's hash and a fingerprint of the place."""
    width = length - gram + 1
    parts = []
    ends = offsets[1:]
    for i, j in slices(offsets, WINDOWS):
        begin, stop = int(offsets[i]), int(offsets[j])
        at = begin
        while at + length <= stop:
            to = min(stop, at + WINDOWS + length - 1)
            d = data[at:to]
            n = len(d) - gram + 1
            sums = prefix(d)
            h = mix((sums[gram:] - sums[:n]) * inverses(n))
            low = (h & ~_LOW) | np.arange(n, dtype=np.uint64)
            step, rest = 1, width
            while step * 2 <= rest:
                low = np.minimum(low[:-step], low[step:])
                step *= 2
            if rest > step:
                low = np.minimum(low[: len(low) - (rest - step)], low[rest - step :])
            anchor = (low & _LOW).astype(np.int64)
            # of each string the document, and whether it ends in it
            until = np.clip(ends[i:j] - at, 0, len(anchor))
            count = np.diff(until, prepend=0)
            doc = np.repeat(np.arange(i, j), count)
            start = np.flatnonzero(np.arange(length, length + len(doc)) <= np.repeat(ends[i:j] - at, count))
            anchor, doc = anchor[start], doc[start]
            if len(start):
                new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(start)) - 1
                a, s = anchor[first], start[first]
                size = start[last] - s + length
                mark = mix(span(sums, s, s + size) + (a - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64))
                parts.append((doc[first], at + s, size, h[a], mark))
            at += WINDOWS
            if to == stop:
                break
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def meeting(data: np.ndarray, offsets: np.ndarray, owners: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Of places that lie one after another: whether another one of a different owner may share a string of `length` bytes.

    Such a string is the anchor, with length - gram bytes to its left and right together. Whatever it has to the left,
    rounded down to a multiple of STEP, and to the right, less than STEP more, stands in both places alike; a place
    whose surroundings of all these kinds are found nowhere else shares none. The others are sorted, which decides.
    """
    rest = length - gram
    sides = [(a, max(0, rest - a - STEP + 1)) for a in range(0, rest + 1, STEP)]
    keep = np.zeros(len(owners), bool)
    own, keys = [], []
    for i, j in slices(offsets, WINDOWS):
        d, begin, end = data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i]
        if j - i == 1 and len(d) > 2 * WINDOWS:
            keep[i] = True  # longer than the low bits of a key can tell
            continue
        sums = prefix(d)
        n = len(d) - gram + 1
        low = (mix((sums[gram:] - sums[:n]) * inverses(n)) & ~_LOW) | np.arange(n, dtype=np.uint64)
        # grams of each place; those between places are left out by the odd ranges of reduceat
        at = (np.minimum.reduceat(low, np.stack([begin, end - gram + 1], 1).ravel()[:-1])[::2] & _LOW).astype(np.int64)
        for side, (left, right) in enumerate(sides):
            a, b = at - left, at + gram + right
            ok = np.flatnonzero((a >= begin) & (b <= end))
            own.append(ok + i)
            keys.append(mix(span(sums, a[ok], b[ok]) + np.uint64(side)))
    if keys:
        own, keys = np.concatenate(own), np.concatenate(keys)
        order = np.argsort(keys)
        own, keys = own[order], keys[order]
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        if len(head):
            many = np.minimum.reduceat(owners[own], head) < np.maximum.reduceat(owners[own], head)
            keep[own[np.repeat(many, np.diff(np.append(head, len(own))))]] = True
    return keep


def _blocks(batches):
    """Documents in blocks of about BLOCK_BYTES: block, ids, offsets, data. A longer document is a block of its own."""
    first, count = TaskContext.get().partitionId() << 24, 0
    ids, texts, size = [], [], 0

    def table():
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([first + count], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([offsets.tobytes()], pa.binary()), pa.array([b"".join(texts)], pa.binary())], names=["block", "ids", "offsets", "data"])

    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            t = (t.as_py() or "").encode()
            if texts and size + len(t) > BLOCK_BYTES:
                yield table()
                count += 1
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if texts:
        yield table()


def _read(batch, r):
    return np.array(batch.column("ids")[r].as_py(), np.int64), np.frombuffer(batch.column("offsets")[r].as_py(), np.int64), np.frombuffer(batch.column("data")[r].as_buffer(), np.uint8)


def _merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Unions of ranges by document."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    out = []
    for d, s, e in zip(doc.tolist(), start.tolist(), stop.tolist(), strict=True):
        if out and out[-1][0] == d and s <= out[-1][2]:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([d, s, e])
    return out


def repeated(docs: DataFrame, workspace: Workspace, length: int = LENGTH, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """gone_id, spans: of each document the ranges [from, to) of UTF-8 bytes that are covered by strings of `length`
    bytes which also start in a document with a smaller doc_id. Ranges may overlap; documents without any are missing.

    Whole texts count; null and empty ones hold nothing, nor do rows with null doc_id; rows that share a doc_id are
    one document. Steps: texts equal to one of a smaller doc_id are removed whole; the others are written in blocks;
    anchors of each block travel as packed 32-bit numbers to the task of their leading bits, which names those that
    stand in several documents; the places of these are dealt by anchor, equal places being one with their smallest
    document; places that differ are sorted in shards, and what stands in several of them goes. An anchor with more
    than hot_bytes of different places would make a large shard: each string of its places is a row by itself, and the
    smallest document of equal ones is a grouped minimum, which needs no task to hold them all.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(f"doc_id IS NOT NULL AND octet_length(text) >= {length}")
    prints = rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("print"), F.octet_length("text").alias("n"))
    least = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    marked = workspace.save(prints.join(least, "print").select("doc_id", "n", (F.col("doc_id") > F.col("least")).alias("copy")), "prints")
    total = marked.where("NOT copy").agg(F.sum("n")).first()[0] or 0
    whole = marked.where("copy").select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("stop"))
    first = marked.where("NOT copy").select("doc_id").distinct()
    blocks = workspace.save(rows.join(first, "doc_id").mapInArrow(_blocks, "block long, ids array<long>, offsets binary, data binary"), "blocks")
    # leading bits: a task gets about 2^18 anchors, and anchors differ in 32 bits more
    bits = max(6, int(np.ceil(np.log2(max(1, total / (13 * (1 << 18)))))))

    def hints(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, offsets, data = _read(batch, r)
                doc, _, _, h, _ = places(data, offsets, length)
                key, owner = h >> np.uint64(32 - bits), ids[doc]
                order = np.lexsort((owner, key))
                key, owner = key[order], owner[order]
                if not len(key):
                    continue
                head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                twice = np.minimum.reduceat(owner, head) != np.maximum.reduceat(owner, head)
                key = key[head]
                lead = (key >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]]))
                low = key.astype(np.uint32)
                ends = np.append(cuts[1:], len(key))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("block")[r].as_py()] * len(cuts), pa.int64()), pa.array(lead[cuts]), pa.array([low[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()), pa.array([low[a:b][twice[a:b]].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())], names=["block", "lead", "keys", "twice"])

    def several(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("keys")]
        kinds, n = np.unique(np.concatenate(keys), return_counts=True)
        known = np.unique(np.concatenate([kinds[n > 1], *(np.frombuffer(x.as_py(), np.uint32) for x in table.column("twice"))]))
        hits = [np.intersect1d(k, known, assume_unique=True).tobytes() for k in keys]
        return pa.table({"block": table.column("block"), "lead": table.column("lead"), "hits": pa.array([h or None for h in hits], pa.binary())})

    wide = max(6, min(1 << bits, 20_000))
    named = blocks.select("block", "ids", "offsets", "data").mapInArrow(hints, "block long, lead long, keys binary, twice binary").repartition(wide, "lead").groupBy("lead").applyInArrow(several, "block long, lead long, hits binary")
    hits = workspace.save(named.where("hits IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("lead", "hits")).alias("hits")), "hits")

    def found(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, offsets, data = _read(batch, r)
                known = np.sort(np.concatenate([(np.uint64(x["lead"]) << np.uint64(32)) | np.frombuffer(x["hits"], np.uint32).astype(np.uint64) for x in batch.column("hits")[r].as_py()]))
                doc, at, size, h, mark = places(data, offsets, length)
                key = h >> np.uint64(32 - bits)
                k = np.searchsorted(known, key)
                k[k == len(known)] = 0
                ok = known[k] == key
                doc, at, size, h, mark = doc[ok], at[ok], size[ok], h[ok], mark[ok]
                owner = ids[doc]
                order = np.lexsort((owner, mark, h))
                doc, at, size, h, mark, owner = (x[order] for x in (doc, at, size, h, mark, owner))
                if not len(doc):
                    continue
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (mark[1:] != mark[:-1])])
                head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                later = owner > owner[head]
                start = at - offsets[doc]
                done = _merged(owner[later], start[later], (start + size)[later])
                n, block = int((~later).sum()), batch.column("block")[r].as_py()
                own = ~later
                one = pa.RecordBatch.from_arrays([pa.array(owner[own]), pa.array(start[own]), pa.array((start + size)[own]), pa.array([block] * n, pa.int64()), pa.array(at[own]), pa.array(h[own].view(np.int64)), pa.array(mark[own].view(np.int64))], names=["doc_id", "start", "stop", "block", "at", "anchor", "mark"])
                yield one
                if done:
                    none = pa.nulls(len(done), pa.int64())
                    yield pa.RecordBatch.from_arrays([*(pa.array([x[c] for x in done], pa.int64()) for c in range(3)), none, none, none, none], names=one.schema.names)

    spots = workspace.save(blocks.join(hits, "block").mapInArrow(found, "doc_id long, start long, stop long, block long, at long, anchor long, mark long"), "spots")
    workspace.drop("hits")
    # grouped minima, which tasks combine before they travel: one anchor may have any share of all places
    kinds = spots.where("anchor IS NOT NULL").groupBy("anchor", "mark").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    kinds = workspace.save(kinds, "kinds")
    mixed = kinds.groupBy("anchor").agg((F.min("mark") < F.max("mark")).alias("mixed"))
    # a place that stands once and alone at its anchor needs no look
    seen = kinds.join(mixed, "anchor").where("mixed OR n > 1").select("anchor", "mark", "least", "mixed")
    settled = spots.where("anchor IS NOT NULL").join(seen, ["anchor", "mark"]).where("doc_id > least OR mixed").select("doc_id", "start", "stop", F.when(F.col("doc_id") == F.col("least"), F.struct("block", "at", "anchor")).alias("open"))
    judged = workspace.save(settled.union(spots.where("anchor IS NULL").select("doc_id", "start", "stop", F.lit(None).cast("struct<block:bigint,at:bigint,anchor:bigint>"))), "judged")
    workspace.drop("spots")
    workspace.drop("kinds")
    shards = max(6, int(judged.where("open IS NOT NULL").agg(F.sum(F.col("stop") - F.col("start"))).first()[0] or 0) // SHARD_BYTES)
    opened = judged.where("open IS NOT NULL").select("open.block", "open.at", "open.anchor", "doc_id", "start", "stop")
    hot = workspace.save(opened.groupBy("anchor").agg(F.sum(F.col("stop") - F.col("start")).alias("n")).where(F.col("n") > hot_bytes).select("anchor"), "hot")
    any_hot = not hot.isEmpty()

    def wanted(places: DataFrame) -> DataFrame:
        return places.select("block", F.struct("at", "anchor", "doc_id", "start", "stop").alias("w")).groupBy("block").agg(F.collect_list("w").alias("wants"))

    def cut(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                data = batch.column("data")[r].as_buffer()
                w = batch.column("wants")[r].values if hasattr(batch.column("wants")[r], "values") else batch.column("wants")[r]
                at, begin, end = (w.field(c).to_numpy() for c in ("at", "start", "stop"))
                pieces = [bytes(data[a : a + n]) for a, n in zip(at.tolist(), (end - begin).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([w.field("anchor"), w.field("doc_id"), w.field("start"), pa.array(pieces, pa.binary())], names=["anchor", "doc_id", "start", "piece"])

    def pieces(places: DataFrame) -> DataFrame:
        return wanted(places).join(blocks.select("block", "data"), "block").select("data", "wants").mapInArrow(cut, "anchor long, doc_id long, start long, piece binary")

    def sort(table: pa.Table) -> pa.Table:
        owner, start = table.column("doc_id").to_numpy(), table.column("start").to_numpy()
        keep = np.flatnonzero(meeting(*buffers(table.column("piece")), owner, length))
        owner, start = owner[keep], start[keep]
        gone = repeated_strings(table.column("piece").take(pa.array(keep)).to_pylist(), owner, length)
        k = np.array([g[0] for g in gone], np.int64)
        lo, hi = np.array([g[1] for g in gone], np.int64), np.array([g[2] for g in gone], np.int64)
        return pa.table({"doc_id": owner[k], "start": start[k] + lo, "stop": start[k] + hi})

    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    cold = pieces(opened.join(hot, "anchor", "left_anti") if any_hot else opened)
    ranged = cold.select(shard, "doc_id", "start", "piece").repartition(shards, "shard").groupBy("shard").applyInArrow(sort, "doc_id long, start long, stop long")
    ranged = workspace.save(ranged, "sorted")
    if any_hot:
        own = pieces(opened.join(hot, "anchor", "left_semi")).withColumn("k", F.explode(F.sequence(F.lit(0), F.octet_length("piece") - length)))
        own = own.select("doc_id", (F.col("start") + F.col("k")).alias("start"), F.md5(F.substring(F.col("piece"), F.col("k") + 1, F.lit(length))).alias("string"))
        own = workspace.save(own, "strings")
        first = own.groupBy("string").agg(F.min("doc_id").alias("least"))
        again = own.join(first, "string").where("doc_id > least").select("doc_id", "start", (F.col("start") + length).alias("stop"))
        ranged = ranged.union(workspace.save(again, "again"))
        workspace.drop("strings")
    workspace.drop("blocks")
    every = whole.union(judged.where("open IS NULL").select("doc_id", "start", "stop")).union(ranged)
    return every.groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def remove(docs: DataFrame, spans: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the other bytes) of every row of docs."""

    def run(batches):
        for batch in batches:
            sizes, gone, runs, kept = [], [], [], []
            for t, s in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = (t.as_py() or "").encode()
                merged = []
                if s.is_valid:
                    w = s.values
                    lo, hi = w.field("start").to_numpy(), w.field("stop").to_numpy()
                    order = np.argsort(lo, kind="stable")
                    lo, hi = lo[order], np.maximum.accumulate(np.minimum(hi[order], len(raw)))
                    new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
                    merged = list(zip(lo[new].tolist(), hi[np.append(new[1:], len(lo)) - 1].tolist(), strict=True))
                at, rest = 0, []
                for a, b in merged:
                    rest.append(raw[at:a])
                    at = b
                rest.append(raw[at:])
                sizes.append(len(raw))
                gone.append(sum(b - a for a, b in merged))
                runs.append(len(merged))
                kept.append(b"".join(rest))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, gone, runs)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.join(spans, rows["doc_id"] == spans["gone_id"], "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op7_external_induced_sorting(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove(docs, repeated(docs, Workspace(spark, "op7")))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
