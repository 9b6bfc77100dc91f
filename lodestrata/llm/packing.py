"""Vector bin packing of tokenised documents, by the dot product of what a bin has left and what an item needs."""

from __future__ import annotations

import base64
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE_TOKENS = 1024
MAX_SEGMENTS = 128
#: Documents and tokens held back for packing in one task; full sequences are given out at once.
WINDOW_ITEMS = 4096
WINDOW_TOKENS = 1 << 21
END = 0


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""

    tokens: int = SEQUENCE_TOKENS
    segments: int = MAX_SEGMENTS
    loss: int = SEQUENCE_TOKENS


def pack(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> list[list[int]]:
    """Bins of item numbers. Each item fits a bin by itself.

    A bin takes, again and again, the item that fits and whose need (tokens, one segment, loss tokens, each over its
    limit) has the largest dot product with what the bin has left. Items alike in both sizes share a heap, so that a
    choice looks at the distinct sizes that are left and not at the items.
    """
    order = np.lexsort((np.arange(len(tokens)), loss, tokens))
    kinds: dict[tuple[int, int], list[int]] = {}
    for i in order[::-1].tolist():
        kinds.setdefault((int(tokens[i]), int(loss[i])), []).append(i)
    keys = np.array(list(kinds), np.int64).reshape(-1, 2)
    stacks = list(kinds.values())
    left = np.array([len(s) for s in stacks], np.int64)
    need = np.column_stack([keys[:, 0] / limits.tokens, np.full(len(keys), 1 / limits.segments), keys[:, 1] / max(1, limits.loss)])
    bins = []
    while len(keys):
        room, spare, own = limits.tokens, limits.loss, []
        while len(own) < limits.segments:
            ok = (left > 0) & (keys[:, 0] <= room) & (keys[:, 1] <= spare)
            if not ok.any():
                break
            rest = np.array([room / limits.tokens, 1 - len(own) / limits.segments, spare / max(1, limits.loss)])
            k = int(np.argmax(np.where(ok, need @ rest, -1.0)))
            own.append(stacks[k].pop())
            left[k] -= 1
            room -= int(keys[k, 0])
            spare -= int(keys[k, 1])
        bins.append(own)
        if (gone := left == 0).any():
            at = np.flatnonzero(~gone)
            keys, need, left, stacks = keys[at], need[at], left[at], [stacks[x] for x in at]
    return bins


def fill(bins: list[list[tuple]], limits: Limits) -> list[list[tuple]]:
    """Cuts the pieces of the emptiest bins into the room that the fullest have left. A piece is (document, start, length, loss prefix)."""
    used = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda k: -used[k])
    rooms = [[limits.tokens - used[k], limits.segments - len(bins[k]), limits.loss - sum(p[3](p[1], p[2]) for p in bins[k])] for k in range(len(bins))]
    hi, lo = 0, len(order) - 1
    while hi < lo:
        to, frm = order[hi], order[lo]
        if rooms[to][0] <= 0 or rooms[to][1] <= 0 or rooms[to][2] <= 0:
            hi += 1
            continue
        if not bins[frm]:
            lo -= 1
            continue
        doc, start, length, loss = bins[frm].pop()
        take = min(length, rooms[to][0])
        while take and loss(start, take) > rooms[to][2]:
            take -= loss(start, take) - rooms[to][2]
        if take <= 0:
            bins[frm].append((doc, start, length, loss))
            hi += 1
            continue
        bins[to].append((doc, start, take, loss))
        rooms[to] = [rooms[to][0] - take, rooms[to][1] - 1, rooms[to][2] - loss(start, take)]
        if take < length:
            bins[frm].append((doc, start + take, length - take, loss))
    return [b for b in bins if b]


def encoder(path: str):
    """Texts to ids by the vocabulary file. Ids are those of the tokenizers library without added special tokens; a .json
    file of byte-level BPE with a .tiktoken twin beside it is encoded through the twin, four times faster, but for texts
    that hold the string of a special token, which is one id."""
    from pathlib import Path

    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    whole = lambda text: model.encode(text, add_special_tokens=False).ids
    twin = Path(path).with_suffix(".tiktoken")
    if twin.exists():
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, twin.open("rb"))}
        plain = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        special = [t.content for t in model.get_added_tokens_decoder().values()]
        return lambda text: whole(text) if any(s in text for s in special) else plain(text)
    return whole


def pack_documents(docs: DataFrame, vocabulary: str, limits: Limits = Limits(), loss: str | None = None, with_ids: bool = True, window_items: int = WINDOW_ITEMS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset and, if with_ids, ids.

    A document is its ids followed by id 0; null and empty texts are that id alone. Documents longer than a sequence
    are cut into full ones, what is left over goes to windows of at most `window_items` pieces which pack() places and
    fill() evens out; the last bins of a task may stay short. `loss` names a column with the number of leading tokens
    that bear no loss (a prompt); null: all tokens bear loss. Each task works on what it reads, without a shuffle, in
    bounded memory; a retried task gives the same pieces, as long as docs comes from files and not from a shuffle.
    Repeated rows are packed as often as they occur, null doc_ids as null.
    """
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, loss_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.col(loss).cast("long") if loss else F.lit(0).cast("long")).alias("free"))
    full = min(limits.tokens, limits.loss)

    def run(batches):
        encode = encoder(vocabulary)
        first = TaskContext.get().partitionId() << 40
        count, window, held, rows = 0, [], 0, []

        def out(own):
            nonlocal count
            at = 0
            for (doc_id, ids, free), start, length, bears in own:
                part = ids[start : start + length]
                rows.append((doc_id, start, length, zlib.crc32(part.astype("<u4").tobytes()), len(ids), bears(start, length), first + count, at, *([part.astype(np.int32)] if with_ids else [])))
                at += length
            count += 1

        def flush():
            nonlocal window, held
            size = np.array([w[2] for w in window], np.int64)
            bears = np.array([w[3](w[1], w[2]) for w in window], np.int64)
            for own in fill([[window[i] for i in b] for b in pack(size, bears, limits)], limits):
                out(own)
            window, held = [], 0

        def table():
            made = [pa.array([r[k] for r in rows], pa.list_(pa.int32()) if n == "ids" else pa.int64()) for k, n in enumerate(names)]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, names=names)

        for batch in batches:
            for doc_id, text, free in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("free").to_pylist(), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END], np.uint32)
                free = min(max(free or 0, 0), len(ids))
                doc, start = (doc_id, ids, free), 0
                bears = lambda s, n, f=free: max(0, s + n - max(s, f))
                while len(ids) - start >= full:
                    out([(doc, start, full, bears)])
                    start += full
                if start < len(ids):
                    window.append((doc, start, len(ids) - start, bears))
                    held += len(ids)
                if len(window) >= window_items or held >= WINDOW_TOKENS:
                    flush()
                if len(rows) >= 20_000:
                    yield table()
        if window:
            flush()
        if rows:
            yield table()

    return source.mapInArrow(run, schema)


def op3_vector_bin_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
