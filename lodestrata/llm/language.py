"""Language identification by compression: the language whose zstandard dictionary makes a text smallest."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of raw text in a dictionary, bytes that one document may give to it, and documents read for it per language.
DICTIONARY_BYTES = 64 * 1024
SHARE_BYTES = 400
SAMPLE_DOCUMENTS = 200
#: From level 6 zstandard looks for matches lazily, which syllable-sized likeness needs.
LEVEL = 6


def fit(docs: DataFrame, per_language: int = SAMPLE_DOCUMENTS, share: int = SHARE_BYTES, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Raw-content dictionaries by language.

    Learns from a bounded sample: the `per_language` documents of each language with the smallest hash of their
    text, `share` bytes of each from a place that its hash picks anywhere in the whole text, `size` bytes in all. Rows with null lang or null or empty text teach nothing. The
    languages of the table are a small closed set; what reaches the driver is bounded by their number times `size`.
    """
    one = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", F.xxhash64("text").alias("h"), F.lower(F.substring("text", F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - share + 1, F.lit(1))).cast("int") + 1, F.lit(share))).alias("t"))
    salted = one.withColumn("salt", F.pmod("h", F.lit(64)))
    first = salted.withColumn("n", F.row_number().over(Window.partitionBy("lang", "salt").orderBy("h", "t"))).where(F.col("n") <= max(1, per_language // 16))
    one = first.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))).where(F.col("n") <= per_language).select("lang", "h", "t")
    out: dict[str, list[bytes]] = {}
    for lang, _, text in sorted((r["lang"], r["h"], r["t"]) for r in one.collect()):
        out.setdefault(lang, []).append(text.encode()[:share])
    return {lang: b"\n".join(parts)[-size:] for lang, parts in out.items()}


def identify(docs: DataFrame, model: dict[str, bytes], margin: float = 0.02, level: int = LEVEL) -> DataFrame:
    """Adds lang_pred, score and lang_rejected to each row of docs (which needs a text column), as a map without shuffle.

    The whole text, in lower case, is compressed with each dictionary and the smallest wins (ties: the first name in order). score is
    1 - best / second best, 0 with one language. lang_rejected is true if score < margin, if the text is null or has
    no letter (lang_pred `und`, score 0), or if no language was learned (`und`). Columns of docs with the names of the
    results are replaced; all others are kept as they are.
    """
    names = sorted(model)
    schema = docs.drop("lang_pred", "score", "lang_rejected")
    keep = schema.columns

    def run(batches):
        packs = []
        for name in names:
            d = zstandard.ZstdCompressionDict(model[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            packs.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False))
        for batch in batches:
            pred, score, bad = [], [], []
            for text in batch.column("text"):
                s = text.as_py()
                if not packs or not s or not any(map(str.isalpha, s)):
                    pred.append("und")
                    score.append(0.0)
                    bad.append(True)
                    continue
                raw = s.lower().encode()
                sizes = [len(c.compress(raw)) for c in packs]
                best = min(range(len(sizes)), key=sizes.__getitem__)
                rest = min((x for k, x in enumerate(sizes) if k != best), default=sizes[best])
                gap = 1.0 - sizes[best] / rest
                pred.append(names[best])
                score.append(gap)
                bad.append(gap < margin)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(bad, pa.bool_())], names=[*keep, "lang_pred", "score", "lang_rejected"])

    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields), "lang_pred string", "score double", "lang_rejected boolean"])
    return schema.mapInArrow(run, out)


def held_out(remainder: int, of: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of)) == remainder


def op10_compression_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(1, 3)))
    return identify(docs.select("doc_id", "text", F.coalesce(held_out(1, 3), F.lit(False)).alias("held_out")), model).drop("text")
