"""Near duplicates of documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import linked, shared_buckets
from .shared import Workspace, buffers, mix, shingles, slices, windows, word_hashes

SHINGLE = 5
PERCENT = 85
#: A pair at Jaccard 0.85 shares one of 24 bands of 6 coordinates with probability 1 - (1 - 0.85^6)^24 > 0.99998.
BANDS, ROWS = 24, 6
_BLOCK = 1 << 16


def permute(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Circulant MinHash: a first permutation scatters a set over the circle of 32-bit numbers; coordinate k is the
    smallest value of a second permutation turned by k steps of a fixed odd stride. Two permutations make all coordinates."""
    out = np.empty((len(sets), size), np.uint32)
    k = 0
    while k < len(sets):
        j, n = k, 0
        while j < len(sets) and (j == k or n + len(sets[j]) <= _BLOCK):
            n += len(sets[j])
            j += 1
        own = sets[k:j]
        first = (mix(np.concatenate(own)) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in own[:-1])])
        for c in range(size):
            out[k:j, c] = np.minimum.reduceat(permute(first + np.uint32((c * 0x9E3779B1) & 0xFFFFFFFF)), starts)
        k = j
    return out


def bands(sets: list[np.ndarray], n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Bucket numbers of each set, one per band; the number of the band is part of them."""
    if not sets:
        return np.zeros((0, n), np.int64)
    sig = signatures(sets, n * rows).astype(np.uint64)
    out = np.empty((len(sets), n), np.uint64)
    for b in range(n):
        h = np.full(len(sets), b + 1, np.uint64)
        for r in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
        out[:, b] = h
    return out.view(np.int64)


def document_sets(column, size: int):
    """Shingle sets of a column of texts, folded to lower case (A-Z), whole texts."""
    data, offsets = buffers(column)
    for i, j in slices(offsets):
        words, at = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], fold=True)
        for r in range(j - i):
            yield shingles(words[at[r] : at[r + 1]], size)


def document_shingles(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of a column of texts, folded as above, one text after another, and where each text's begin."""
    data, offsets = buffers(column)
    words, at = word_hashes(data, offsets, fold=True)
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, n > 0)
    out = np.concatenate([[0], np.cumsum(count)])
    place = np.repeat(at[:-1] - out[:-1], count) + np.arange(out[-1])
    hashes = np.resize(windows(words, size) + np.uint64(size), len(words))[place] if len(words) >= size else np.zeros(out[-1], np.uint64)
    for r in np.flatnonzero((n > 0) & (n < size)).tolist():
        hashes[out[r]] = shingles(words[at[r] : at[r + 1]], size)[0]
    return hashes, out


def sketch(docs: DataFrame, size: int = SHINGLE, rows_per_band: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_key (a 128-bit fingerprint of the set; null if empty) and the set's buckets, as a map."""

    def run(batches):
        for batch in batches:
            ids, held = batch.column("doc_id"), []
            counts, keys, places = [], [], []
            for s in document_sets(batch.column("text"), size):
                counts.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    held.append(s)
                if len(held) >= 512:
                    places.append(bands(held, rows=rows_per_band))
                    held = []
            places = np.concatenate([*places, bands(held, rows=rows_per_band)])
            rows, k = [], 0
            for n in counts:
                rows.append(places[k] if n else None)
                k += bool(n)
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "buckets"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, buckets array<long>")


def near_duplicates(docs: DataFrame, workspace: Workspace, percent: int = PERCENT, size: int = SHINGLE, rows_per_band: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Texts are folded (A-Z) and cut into words; a set is the distinct shingles of `size` words, one for shorter texts,
    none for null texts and texts without words, which link with nothing. Documents with the same set are one node,
    the smallest doc_id, so copies cost nothing more; nodes go to linked(). Rows that share a doc_id are one node.
    Rows with null doc_id get their count, a null component and kept false. Other columns of docs play no part.
    """
    found = workspace.save(sketch(docs, size, rows_per_band), "sketch")
    some = found.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    groups = some.groupBy("set_key").agg(F.min("doc_id").alias("node"))
    node = workspace.save(some.select("doc_id", "n_shingles", "set_key").join(groups, "set_key"), "nodes").drop("set_key")
    heads = node.where("doc_id = node").select("node", "n_shingles").distinct()
    own = some.join(heads, (some["doc_id"] == heads["node"]) & (some["n_shingles"] == heads["n_shingles"]), "left_semi").select(F.col("doc_id").alias("node"), "buckets")
    entries = found.agg(F.sum(F.size("buckets").cast("long")).alias("n")).first()["n"] or 0
    rows = shared_buckets(own, entries, workspace)
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").alias("t")).join(rows.select("node").distinct().hint("merge"), "node")
    parts = linked(rows, texts, lambda column: document_shingles(column, size), percent, workspace, heads.select("node", F.col("n_shingles").alias("n")))
    copies = node.where("doc_id <> node").select(F.col("doc_id").alias("leaf"), "node").distinct()
    member = copies.join(parts, "node", "left").select("leaf", F.coalesce("component", "node").alias("component")).union(parts.join(copies, parts["node"] == copies["leaf"], "left_anti"))
    member = member.groupBy("leaf").agg(F.min("component").alias("component"))
    out = found.select("doc_id", "n_shingles").join(member, found["doc_id"] == member["leaf"], "left")
    part = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", part.alias("component_id"), F.coalesce(F.col("doc_id") == part, F.lit(False)).alias("kept"))


def op9_circulant_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "op9"))
