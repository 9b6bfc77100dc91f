"""Line dedup: fuzzy lines by MinHash of character shingles, exact Jaccard verification, one line kept per component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import linked, shared_buckets
from .shared import _IS_SEP, CHUNK, Workspace, buffers, mix, prefix, shelter, sheltered, span

#: Characters of a shingle of lines under LONG characters, and of lines of BOTH or more; lines between are compared by either.
#: One changed character inside a line costs as many shingles as a shingle has, which a line of 29 or of 79 can bear.
SHORT_SHINGLE, SHINGLE = 3, 8
BOTH, LONG = 96, 128
PERCENT = 80
#: A shorter line is one shingle as a whole: it goes where it equals an earlier line. No other line of its length with a
#: changed character could reach 0.8. Blank lines stay.
WHOLE = 11
#: A pair at Jaccard 0.8 shares one of 15 bands of 4 coordinates with probability 1 - (1 - 0.8^4)^15 > 0.9996. Sets of
#: short shingles have 0.13 in common by chance alone: 43 bands of 8, with probability 1 - (1 - 0.8^8)^43 > 0.9996 at 0.8
#: and 0.000004 at 0.13.
BANDS, ROWS = 15, 4
SHORT_BANDS, SHORT_ROWS = 43, 8
#: Shingles of a matrix, and of lines that wait to be signed.
_BLOCK = 1 << 16
HELD = 1 << 21
#: Masks of the first bytes of a number of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MULTIPLY = (np.random.default_rng(91).integers(0, 1 << 31, SHORT_BANDS * SHORT_ROWS, dtype=np.uint32) * np.uint32(2)) | np.uint32(1)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number, first byte and last byte + 1 of every line of texts that lie one after another."""
    ends = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets, ends, "right") - 1
    starts = np.concatenate([offsets[:-1], ends + 1])
    rows = np.concatenate([np.arange(len(offsets) - 1), row])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    first = np.searchsorted(rows, np.arange(len(offsets) - 1))
    stops = np.empty(len(starts), np.int64)
    stops[:-1] = starts[1:] - 1
    stops[-1:] = offsets[-1]
    last = np.append(first[1:] - 1, len(starts) - 1)
    stops[last] = offsets[1:]
    return rows, np.arange(len(starts)) - first[rows], starts, stops


class Characters:
    """Texts that lie one after another, by characters: hashes of any run of them."""

    def __init__(self, data: np.ndarray):
        self.data, self._sums = data, None
        inner = (data & 0xC0) == 0x80
        self.at = np.append(np.flatnonzero(~inner), len(data)) if inner.any() else None
        # the 8 bytes from each place on, as a number
        self.eight = np.ndarray((len(data),), "<u8", data.tobytes() + bytes(8), 0, (1,))

    @property
    def sums(self) -> np.ndarray:
        if self._sums is None:
            self._sums = prefix(self.data)
        return self._sums

    def number(self, places: np.ndarray) -> np.ndarray:
        """How many characters begin before each byte."""
        return places if self.at is None else np.searchsorted(self.at, places)

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of ranges of bytes. Up to 8 bytes have different ones."""
        size = end - begin
        wide = np.flatnonzero(size > 8)
        out = self.eight[begin]
        if size.min(initial=8) < 8:
            size[wide] = 8
            out &= _FIRST[size]
        out[wide] = span(self.sums, begin[wide], end[wide])
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xC4CEB9FE1A85EC53)
        return out

    def shingles(self, first: np.ndarray, last: np.ndarray, sizes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles of lines of characters first to last - 1, of `sizes` characters (one number or one a
        line, no more than the line has), and where each line's begin."""
        n = last - first - sizes + 1
        at = np.concatenate([[0], np.cumsum(n)])
        begin = np.repeat(first - at[:-1], n) + np.arange(at[-1])
        places = np.arange(len(self.data) + 1) if self.at is None else self.at
        if np.isscalar(sizes) and 2 * at[-1] > len(places):
            return self.hashes(places[:-sizes], places[sizes:])[begin], at
        return self.hashes(places[begin], places[begin + (sizes if np.isscalar(sizes) else np.repeat(sizes, n))]), at


def line_bands(small: np.ndarray, n: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Bucket numbers of each line, one per band, of the 32-bit hashes of the shingles of lines that have n each. Odd
    factors permute 32-bit numbers; those of shingles are spread already. Short lines of like sizes are columns of one
    matrix, filled up with their last shingle, and minima are taken over its rows; long lines lie one after another."""
    at = np.cumsum(n) - n
    sig = np.empty((bands * rows, len(n)), np.uint32)
    brief = len(small) < 128 * len(n)
    order = np.argsort(n, kind="stable") if brief else np.arange(len(n))
    size, k = n[order], 0
    while k < len(n):
        if brief:
            # the longest line of a matrix has at most a half more shingles than the shortest
            j = int(np.searchsorted(size, size[k] * 3 // 2, "right"))
            j = max(k + 1, min(j, int(np.searchsorted(size[k:j] * np.arange(1, j - k + 1), _BLOCK, "right")) + k))
            own = order[k:j]
            block = small[at[own][None, :] + np.minimum(np.arange(size[j - 1])[:, None], n[own] - 1)]
        else:
            j = max(k + 1, int(np.searchsorted(at, at[k] + _BLOCK, "right")) - 1)
            own, begin = slice(k, j), at[k:j] - at[k]
            block = small[at[k] : at[j - 1] + n[j - 1]]
        turned = np.empty_like(block)
        for c in range(bands * rows):
            np.multiply(block, _MULTIPLY[c], out=turned)
            sig[c, own] = turned.min(0) if brief else np.minimum.reduceat(turned, begin)
        k = j
    out = np.empty((len(n), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(n), 256 * rows + b + 1, np.uint64)
        for r in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[b * rows + r].astype(np.uint64))
        out[:, b] = h
    return out.view(np.int64)


class _Held:
    """Lines of one kind whose shingles wait to be signed together."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.nodes, self.small, self.counts, self.size = bands, rows, [], [], [], 0

    def add(self, nodes: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> None:
        self.nodes.append(nodes)
        self.small.append((hashes >> np.uint64(32)).astype(np.uint32))
        self.counts.append(np.diff(at))
        self.size += len(hashes)

    def signed(self):
        """nodes and buckets of what was added, at most 1024 lines at a time."""
        if self.nodes:
            nodes, buckets = np.concatenate(self.nodes), line_bands(np.concatenate(self.small), np.concatenate(self.counts), self.bands, self.rows)
            self.nodes, self.small, self.counts, self.size = [], [], [], 0
            for k in range(0, len(nodes), 1024):
                yield nodes[k : k + 1024], buckets[k : k + 1024]


def runs(starts: np.ndarray, stops: np.ndarray):
    """Ranges of lines that lie within CHUNK bytes; a longer line is a range of its own."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + CHUNK, "right")))
        yield i, j
        i = j


def sketch(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: doc_id, line_no, node (a fingerprint of the line, even) of each line that is not blank; and
    nodes and buckets of some lines, which flat() reads.

    Lines of WHOLE characters or more have buckets: short ones of short shingles, others of long ones; those of BOTH to
    LONG characters also have buckets of long shingles, which belong to the node + 1. A line seen before in the same
    batch has no buckets, since one of a kind is enough. Lines differ in fingerprint with probability 2^-63 a
    pair; what is joined is verified on the lines themselves.
    """
    names = ["doc_id", "line_no", "node", "nodes", "buckets"]

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            rows, number, starts, stops = line_spans(data, offsets)
            some = stops > starts
            rows, number, starts, stops = rows[some], number[some], starts[some], stops[some]
            seen: set[int] = set()
            short, long = _Held(SHORT_BANDS, SHORT_ROWS), _Held(BANDS, ROWS)
            for i, j in runs(starts, stops):
                base = int(starts[i])
                d, s, e = data[base : stops[j - 1]], starts[i:j] - base, stops[i:j] - base
                own = np.flatnonzero(np.logical_or.reduceat(~_IS_SEP[d], s))
                if not len(own):
                    continue
                s, e, size = s[own], e[own], (e - s)[own]
                text = Characters(d)
                nodes = mix(span(text.sums, s, e) + size.astype(np.uint64)).view(np.int64) & -2
                first, last = text.number(s), text.number(e)
                chars = last - first
                fresh = chars >= WHOLE
                for k in np.flatnonzero(fresh).tolist():
                    if (x := int(nodes[k])) in seen:
                        fresh[k] = False
                    else:
                        seen.add(x)
                none = pa.nulls(len(own), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows[i:j][own]], pa.int64()), pa.array(number[i:j][own], pa.int64()), pa.array(nodes), none, none], names=names)
                for kind, held, shingle in ((fresh & (chars < LONG), short, SHORT_SHINGLE), (fresh & (chars >= BOTH), long, SHINGLE)):
                    k = np.flatnonzero(kind)
                    if len(k):
                        held.add(nodes[k] + (chars[k] < LONG) * (held is long), *text.shingles(first[k], last[k], shingle))
                    if held.size >= HELD:
                        yield from entries(held)
            yield from entries(short)
            yield from entries(long)

    def entries(held: _Held):
        null = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64())]
        for some, buckets in held.signed():
            yield pa.RecordBatch.from_arrays([*null, *(pa.array([x.tobytes()], pa.binary()) for x in (some, buckets))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, line_no long, node long, nodes binary, buckets binary")


def flat(batch) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their nodes, of the second kind of rows that sketch() makes."""
    nodes, buckets = ([np.frombuffer(x.as_py(), np.int64) for x in batch.column(c)] for c in ("nodes", "buckets"))
    z = np.zeros(0, np.int64)
    return np.concatenate([z, *buckets]), np.concatenate([z, *(np.repeat(n, len(b) // len(n)) for n, b in zip(nodes, buckets, strict=True))])


def line_shingles(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of a column of lines, one line after another, and where each line's begin; lines that
    dedup_lines() marks with a line feed are cut into long ones."""
    data, offsets = buffers(column)
    text = Characters(data)
    twin = data[offsets[:-1]] == 10
    first, last = text.number(offsets[:-1] + twin), text.number(offsets[1:])
    return text.shingles(first, last, np.where(twin | (last - first >= LONG), SHINGLE, SHORT_SHINGLE))


def fetch(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, t: the lines that nodes (node, doc_id, line_no) name; those of odd nodes begin with a line feed."""
    places = nodes.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "node")).alias("want"))  # lines of one document
    lines = docs.join(places.hint("merge"), "doc_id").withColumn("lines", F.split("text", "\n"))
    return lines.select(F.explode(F.transform("want", lambda w: F.struct(w["node"].alias("node"), F.concat(F.when(w["node"] % 2 == 0, "").otherwise("\n"), F.get("lines", w["line_no"].cast("int"))).alias("t")))).alias("e")).select("e.node", "e.t").where("t IS NOT NULL")


def dedup_lines(docs: DataFrame, workspace: Workspace, percent: int = PERCENT) -> DataFrame:
    """docs with text without its repeated lines, and with n_lines, n_removed_lines (long) and removed_lines (numbers from 0).

    Lines are what \\n separates. Those that are not blank and equal are linked, and those of 11 characters or more
    whose sets of shingles have a Jaccard similarity of percent / 100 or more: sets of 3-character shingles if both lines
    have under 128 characters, of 8-character shingles if both have 96 or more. Of each component of linked lines the
    first by (doc_id, line number) stays and all others go, within and across documents. Equal lines are one node, so
    a line that a third of all documents hold is one row of the graph. Null and empty texts have no line to remove;
    null texts stay null. Rows with null doc_id take no part and stay as they are. Rows that share a doc_id count as
    one document: what goes from one goes by number from all. Other columns are kept; those with the names of the
    results are replaced.
    """
    columns, used = docs.columns, ("doc_id", "text")
    docs = shelter(docs, *used)
    sketched = workspace.save(sketch(docs), "sketch")
    found = workspace.save(sketched.where("node IS NOT NULL").select("doc_id", "line_no", "node"), "lines")
    place = F.struct("doc_id", "line_no")
    nodes = workspace.save(found.groupBy("node").agg(F.min(place).alias("first"), F.count("*").alias("n")).select("node", "first.doc_id", "first.line_no", "n"), "line-nodes")
    entries = nodes.count() * (SHORT_BANDS + BANDS) // 2
    rows = shared_buckets(sketched.where("buckets IS NOT NULL").select("nodes", "buckets"), entries, workspace, flat, 24)
    workspace.drop("sketch")
    even = F.col("node").bitwiseAND(F.lit(-2).cast("long"))
    named = rows.select("node").distinct().select(F.col("node").alias("name"), even.alias("node"))
    lines = fetch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), nodes.join(named, "node").select(F.col("name").alias("node"), "doc_id", "line_no"))
    twins = named.where("name <> node").select(F.col("node").alias("a"), F.col("name").alias("b"))
    parts = linked(rows, lines, line_shingles, percent, workspace, known=twins)
    where = workspace.save(parts.join(nodes, "node"), "line-parts")
    heads = where.groupBy("component").agg(F.min(place).alias("head"))
    alone = nodes.where("n > 1").join(parts.select("node"), "node", "left_anti").select("node", F.struct("doc_id", "line_no").alias("head"))
    keep = where.join(heads, "component").select("node", "head").union(alone)
    gone = found.select("doc_id", "line_no", "node").join(keep, "node").where((F.col("doc_id") != F.col("head.doc_id")) | (F.col("line_no") != F.col("head.line_no")))
    gone = workspace.save(gone.groupBy(F.col("doc_id").alias("gone_id")).agg(F.sort_array(F.collect_set("line_no")).alias("removed_lines")), "gone")  # lines of one document
    out = docs.join(gone.hint("merge"), docs["doc_id"] == gone["gone_id"], "left").drop("gone_id").withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<bigint>")))
    pieces = F.split("text", "\n")
    text = F.when(F.size("removed_lines") == 0, F.col("text")).otherwise(F.array_join(F.filter(pieces, lambda x, i: ~F.array_contains("removed_lines", i.cast("long"))), "\n"))
    feeds = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    out = out.withColumn("n_lines", F.coalesce(feeds + 1, F.lit(0)).cast("long")).withColumn("n_removed_lines", F.size("removed_lines").cast("long")).withColumn("text", text)
    return sheltered(out, columns, used, "n_lines", "n_removed_lines", "removed_lines")


def op8_fuzzy_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), Workspace(spark, "op8"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.array_join("removed_lines", ",").alias("removed_lines"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
