"""Quality classifier: a second-order factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import held_out
from .shared import WORD, buffers, slices, word_hashes  # noqa: F401

BUCKETS = 1 << 16
RANK = 8
SAMPLE_DOCUMENTS = 6000
SAMPLE_BYTES = 24 << 20
THRESHOLD = 0.3
#: Rows scored at a time.
SLICE = 256

#: Names of the dense features, in order; metadata is the length of the text, the only metadata that a score may use.
DENSE = ("log_bytes", "log_words", "bytes_per_word", "distinct_share", "top_share", "lines_per_word", "upper_share", "digit_share", "punctuation_share", "symbol_share", "high_byte_share", "space_share", "short_share", "repeat_share", "bar_share", "capital_words")

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>@^~{}[]\\_=+"))
_PUNCT = np.isin(np.arange(256), list(b".,;:!?'\"()-"))


def _share(mask: np.ndarray, offsets: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]) / size


def features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of texts: sparse indices, values and row starts of the hashed words (weights sum to at most 1 in square), and the dense matrix.

    Null and empty texts have no words and zeros in the matrix. Whole texts count, in pieces of bounded size.
    """
    data, offsets = buffers(column)
    index, value, starts, dense = [], [], [0], []
    for i, j in slices(offsets):
        d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        words, at = word_hashes(d, o)
        size, n = np.maximum(np.diff(o), 1), np.diff(at)
        some = np.maximum(n, 1)
        upper, digit, space = (d >= 65) & (d <= 90), (d >= 48) & (d <= 57), (d == 32) | ((d >= 9) & (d <= 13))
        lines = _share(d == 10, o, some)
        shares = [_share(m, o, size) for m in (upper, digit, _PUNCT[d], _SYMBOL[d], d >= 128, space)]
        bars = _share(d == 124, o, some)
        capital = upper.copy()
        capital[1:] &= space[:-1]
        capitals = _share(capital, o, some)
        distinct, top, short, repeat = np.zeros(j - i), np.zeros(j - i), np.zeros(j - i), np.zeros(j - i)
        for r in range(j - i):
            own = words[at[r] : at[r + 1]]
            if not len(own):
                starts.append(starts[-1])
                continue
            kinds, counts = np.unique(own, return_counts=True)
            distinct[r], top[r] = len(kinds) / len(own), counts.max() / len(own)
            repeat[r] = float((own[1:] == own[:-1]).sum()) / len(own)
            short[r] = min(1.0, 20 / len(own))
            w = 1 + np.log(counts)
            w /= np.sqrt((w * w).sum())
            index.append((kinds & np.uint64(BUCKETS - 1)).astype(np.int32))
            value.append(w.astype(np.float32))
            starts.append(starts[-1] + len(kinds))
        dense.append(np.column_stack([np.log1p(np.diff(o)) / 10, np.log1p(n) / 8, np.minimum(size / some, 40) / 10, distinct, top, np.minimum(lines, 1), *shares, short, repeat, np.minimum(bars, 1), np.minimum(capitals, 1)]))
    return (np.concatenate(index) if index else np.zeros(0, np.int32), np.concatenate(value) if value else np.zeros(0, np.float32), np.array(starts, np.int64), np.concatenate(dense).astype(np.float32) if dense else np.zeros((0, len(DENSE)), np.float32))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows, empty runs being 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


class FactorisationMachine:
    """score = sigmoid(b + w.x + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), linear in the number of features."""

    def __init__(self, buckets: int = BUCKETS, rank: int = RANK, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.buckets, self.bias = buckets, 0.0
        self.linear = np.zeros(buckets + len(DENSE), np.float32)
        self.factors = rng.normal(0, 0.05, (buckets + len(DENSE), rank)).astype(np.float32)
        self.mean, self.scale = np.zeros(len(DENSE), np.float32), np.ones(len(DENSE), np.float32)

    def _rows(self, x):
        index, value, starts, dense = x
        return index, value, starts, np.clip((dense - self.mean) / self.scale, -4, 4) / 2

    def raw(self, x, rows=False):
        index, value, starts, dense = self._rows(x)
        nd = np.arange(self.buckets, self.buckets + len(DENSE))
        vx = self.factors[index] * value[:, None]
        inner = _sums(vx, starts) + dense @ self.factors[nd]
        square = _sums(vx * vx, starts) + (dense**2) @ (self.factors[nd] ** 2)
        out = self.bias + _sums(self.linear[index] * value, starts) + dense @ self.linear[nd] + 0.5 * (inner**2 - square).sum(1)
        return (out, inner, dense, index, value, starts) if rows else out

    def score(self, x) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))

    def fit(self, x, labels: np.ndarray, epochs: int = 14, batch: int = 128, rate: float = 0.08, decay: float = 1e-5, seed: int = 7):
        """AdaGrad on the log loss, both labels weighing the same."""
        if not len(labels):
            return self
        self.mean, self.scale = x[3].mean(0), x[3].std(0) + 1e-3
        share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
        weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
        gl, gv, gb = np.full_like(self.linear, 1e-6), np.full_like(self.factors, 1e-6), 1e-6
        rng, nd = np.random.default_rng(seed), np.arange(self.buckets, self.buckets + len(DENSE))
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for k in range(0, len(order), batch):
                rows = order[k : k + batch]
                raw, inner, dense, index, value, starts = self.raw(take(x, rows), rows=True)
                g = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
                of = np.repeat(np.arange(len(rows)), np.diff(starts))
                gx = g[of] * value
                uniq, back = np.unique(index, return_inverse=True)
                dl = np.bincount(back, gx, len(uniq)).astype(np.float32) + decay * self.linear[uniq]
                dv = np.empty((len(uniq), self.factors.shape[1]), np.float32)
                full = gx[:, None] * (inner[of] - self.factors[index] * value[:, None])
                for f in range(dv.shape[1]):
                    dv[:, f] = np.bincount(back, full[:, f], len(uniq))
                dv += decay * self.factors[uniq]
                dld = g @ dense
                dvd = dense.T @ (g[:, None] * inner) - self.factors[nd] * ((dense**2).T @ g)[:, None]
                for at, a, b in ((uniq, dl, dv), (nd, dld, dvd)):
                    gl[at] += a * a
                    gv[at] += b * b
                    self.linear[at] -= rate * a / np.sqrt(gl[at])
                    self.factors[at] -= 0.3 * rate * b / np.sqrt(gv[at])
                db = float(g.sum())
                gb += db * db
                self.bias -= rate * db / np.sqrt(gb)
        return self


def take(x, rows: np.ndarray):
    index, value, starts, dense = x
    n = starts[rows + 1] - starts[rows]
    to = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(starts[rows] - to[:-1], n) + np.arange(to[-1])
    return index[at], value[at], to, dense[rows]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE_DOCUMENTS, sample_bytes: int = SAMPLE_BYTES) -> FactorisationMachine:
    """Learns from a bounded sample of labelled rows: of the `sample` documents with the smallest hash of their id, those
    that fit into `sample_bytes` of text one after another in order of the hash; one that does not fit is left out and
    the next ones are tried. Without labelled rows every score is 0.5."""
    own = labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    # sizes and hashes are taken below the join, so that of the first query no text travels, and of the second few texts
    sized = docs.select(F.xxhash64("doc_id", F.lit(1)).alias("h"), "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    some, size = [], 0
    for h, doc_id, n in sized.select("h", "doc_id", "n").join(own, "doc_id").select("h", "doc_id", "n").orderBy("h", "doc_id", "n").limit(sample).collect():
        if size + n <= sample_bytes:
            some.append((h, doc_id, n))
            size += n
    if not some:
        return FactorisationMachine()
    spark = docs.sparkSession
    picked = spark.createDataFrame(some, "h long, doc_id long, n int").distinct()  # bounded by `sample`
    texts = sized.where(F.col("h") <= max(h for h, _, _ in some)).join(F.broadcast(picked), ["h", "doc_id", "n"], "left_semi")
    taken = texts.join(own, "doc_id")
    taken = sorted(((r["h"], r["text"] or "", r["y"]) for r in taken.collect()))[:sample]
    texts, marks = [t for _, t, _ in taken], [y for _, _, y in taken]
    return FactorisationMachine().fit(features(pa.array(texts, pa.string())), np.array(marks, np.float64))


def score(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and predicted to docs, as a map without shuffle. Null and empty texts are scored as a text without words.
    Columns named score or predicted are replaced, all others kept."""
    base = docs.drop("score", "predicted")
    keep = base.columns

    def run(batches):
        for batch in batches:
            # some hundred rows at a time: the factors of all words of a slice are held at once
            parts = [model.score(features(batch.column("text").slice(k, SLICE))) for k in range(0, batch.num_rows, SLICE)]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields), "score double", "predicted int"])
    return base.mapInArrow(run, schema)


def op1_factorisation_machine_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    test = held_out(0, 5)
    model = fit(docs.where(~test), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text", F.coalesce(test, F.lit(False)).alias("held_out")), model).drop("text")
