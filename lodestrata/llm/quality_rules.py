"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source, DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, Workspace, shelter, sheltered

WINDOW = 8
SEPARATOR = r"[\x20\x09-\x0D]+"

#: Signals, each in parts per 1000 of its whole, high being bad.
SIGNALS = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "long_words": ("word_chars", "n_words"),
}


@dataclass(frozen=True)
class Rules:
    """Fixed base cutoffs, and how far beyond its group's median a document may lie. tails: signal, high, spread, least
    distance: the larger of `spread` times the distance from the median to the quantile `high`, and the least distance,
    which only matters where the two quantiles nearly meet. Repeats are rare in clean texts, so their quantile lies far
    out; symbols and long words may mark a tenth of a group as junk, so theirs does not. A group's
    limit is drawn towards that over all documents as if `prior` documents had it, so that small groups borrow."""

    min_words: int = 20
    repeat_percent: int = 30
    prior: int = 20
    tails: tuple[tuple[str, float, float, int], ...] = (("symbols", 0.75, 6.0, 10), ("dup_lines", 0.98, 2.0, 10), ("repeats", 0.98, 2.0, 10), ("long_words", 0.75, 8.0, 100))


def bind(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def covered(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found at least twice in the array."""
    keys = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(F.slice(words, i + 1, WINDOW)))

    def of(keys: Column) -> Column:
        ranked = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def places(r: Column) -> Column:
            n = F.size(r)
            twice = F.filter(r, lambda x, j: (F.get(r, j - 1)["k"] == x["k"]) | ((j + 1 < n) & (F.get(r, j + 1)["k"] == x["k"])))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def length(at: Column) -> Column:
            start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(at, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")), lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), 0).otherwise(bind(bind(ranked, places), length))

    return F.when(F.size(words) <= WINDOW, 0).otherwise(bind(keys, of)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """docs, which has none of these columns, with n_words, word_chars, n_symbols, n_lines, n_dup_lines and
    n_repeat_words of each whole text; null: none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("rule_words", F.array_remove(F.split(text, SEPARATOR), "")).withColumn("rule_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    return out.select(
        *docs.columns,
        F.size("rule_words").cast("long").alias("n_words"),
        F.length(F.array_join("rule_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("rule_lines").cast("long").alias("n_lines"),
        (F.size("rule_lines") - F.size(F.array_distinct("rule_lines"))).cast("long").alias("n_dup_lines"),
        covered(F.col("rule_words")).alias("n_repeat_words"),
    )


def signal(name: str) -> Column:
    part, whole = SIGNALS[name]
    return F.when(F.col(whole) > 0, F.floor(F.col(part) * 1000 / F.col(whole))).otherwise(0).cast("long")


#: Cells of the sketch: exact below 2^CELL_BITS, then 2^(CELL_BITS-1) cells to each doubling, an error below 1 / 256.
CELL_BITS = 9


def cell(x: Column) -> Column:
    """The smallest value of the sketch cell that x lies in: x with all but its first CELL_BITS binary digits cleared."""
    shift = F.greatest(F.length(F.bin(x)) - CELL_BITS, F.lit(0))
    power = F.pow(F.lit(2.0), shift).cast("long")
    return x - F.pmod(x, power)


def sketches(measured: DataFrame) -> DataFrame:
    """Mergeable quantile sketches as rows: sketch_lang, sketch_source, signal, cell, n.

    Counts of log-spaced cells add up in any order, so the sketch of a union is the sum of sketches, retries and other
    orders give the same result, and a group has at most some thousand cells whatever its number of documents. The sums
    begin in each task, so a group with a third of all rows is at most that many rows of shuffle from each task.
    """
    some = F.array(*(F.struct(F.lit(k).alias("signal"), cell(signal(k)).alias("cell")) for k in SIGNALS))
    one = measured.where("NOT base_failed").select(F.col("lang").alias("sketch_lang"), F.col("source").alias("sketch_source"), F.explode(some).alias("s"))
    return one.groupBy("sketch_lang", "sketch_source", F.col("s.signal").alias("signal"), F.col("s.cell").alias("cell")).agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, rules: Rules = Rules(), by: tuple[str, ...] = ("sketch_lang", "sketch_source")) -> DataFrame:
    """One row per group: its number of documents and the largest allowed value of each signal, as max_<signal>.

    The quantile of a cell table is the first cell whose cumulative count reaches it; the window runs over the cells
    of one group and signal, which are few.
    """
    cells = sketch.groupBy(*by, "signal", "cell").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "signal")
    run = cells.withColumn("upto", F.sum("n").over(w.orderBy("cell"))).withColumn("all_n", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all_n"), F.col("cell")))
    tail = lambda k: F.create_map(*(F.lit(x) for t in rules.tails for x in (t[0], t[k])))[F.col("signal")]
    limit = run.groupBy(*by, "signal").agg(at(0.5).alias("mid"), at(tail(1)).alias("top"), F.max("all_n").alias("group_n"))
    limit = limit.withColumn("most", F.col("mid") + F.greatest((tail(2) * (F.col("top") - F.col("mid"))).cast("long"), tail(3).cast("long")))
    return limit.groupBy(*by).agg(F.max("group_n").alias("group_n"), *(F.max(F.when(F.col("signal") == k, F.col("most"))).alias(f"max_{k}") for k in SIGNALS))


def judge(docs: DataFrame, rules: Rules = Rules(), workspace=None) -> DataFrame:
    """docs with the counts of measure(), base_failed, failed_signals (sorted, comma-separated) and kept.

    Null lang or source is a group of its own. A text without words fails the base rule. An empty table gives an empty
    table. Groups' thresholds are joined on (lang, source); Spark broadcasts that table only if it is small. If a
    workspace is given, what measure() gives is written to it first, so that texts are split once and not twice.
    Columns of docs with the names of the results are replaced, all others kept.
    """
    columns, used = docs.columns, ("text", "lang", "source")
    measured = measure(shelter(docs, *used))
    measured = measured.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words")))
    if workspace is not None:
        measured = workspace.save(measured, "measured")
    sketch = sketches(measured)
    own = thresholds(sketch, rules)
    every = thresholds(sketch.withColumn("all_groups", F.lit(1)), rules, ("all_groups",)).select(*(F.col(f"max_{k}").alias(f"all_{k}") for k in SIGNALS))
    joined = measured.join(own, F.col("lang").eqNullSafe(F.col("sketch_lang")) & F.col("source").eqNullSafe(F.col("sketch_source")), "left").join(F.broadcast(every), how="left")
    # without any document that keeps to the base rules there are no limits
    most = lambda k: F.coalesce(F.floor((F.col("group_n") * F.col(f"max_{k}") + rules.prior * F.col(f"all_{k}")) / (F.col("group_n") + rules.prior)), F.col(f"all_{k}"))
    failed = F.array_compact(F.array(*(F.when(signal(k) > most(k), F.lit(k)) for k in sorted(SIGNALS))))
    out = joined.withColumn("failed_signals", F.array_join(failed, ",")).withColumn("kept", ~F.col("base_failed") & (F.col("failed_signals") == ""))
    columns = [c for c in columns if c not in used or c in measured.columns]
    return sheltered(out, columns, used, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "failed_signals", "kept")


def op5_adaptive_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    # the digest needs no texts after the counts: the workspace holds a few numbers per document
    slim = _Slim(spark, "op5")
    return judge(docs, workspace=slim).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_signals", "kept")


class _Slim(Workspace):
    def save(self, df: DataFrame, name: str) -> DataFrame:
        return super().save(df.drop("text"), name)


#: The same in DuckDB, for tables without repeated doc_ids.
OP5_SQL = """
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, source, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
v AS (SELECT doc_id, lang, source, base_failed, unnest([{'s': 'symbols', 'a': n_symbols, 'b': word_chars}, {'s': 'dup_lines', 'a': n_dup_lines, 'b': n_lines},
  {'s': 'repeats', 'a': n_repeat_words, 'b': n_words}, {'s': 'long_words', 'a': word_chars, 'b': n_words}], recursive := true) FROM b),
x AS (SELECT *, CASE WHEN b > 0 THEN 1000 * a // b ELSE 0 END AS value FROM v),
c AS (SELECT lang, source, s, value - value % (2 ** greatest(length(bin(value)) - 9, 0))::BIGINT AS cell FROM x WHERE NOT base_failed),
own AS (SELECT lang, source, s, cell, count(*) AS n FROM c GROUP BY ALL),
tails(s, high, spread, least) AS (VALUES ('symbols', 0.75, 6.0, 10), ('dup_lines', 0.98, 2.0, 10), ('repeats', 0.98, 2.0, 10), ('long_words', 0.75, 8.0, 100)),
r AS (SELECT lang, source, s, cell, sum(n) OVER (PARTITION BY lang, source, s ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY lang, source, s) AS total FROM own),
g AS (SELECT lang, source, s, max(total) AS n, min(cell) FILTER (upto >= 0.5 * total) AS mid, min(cell) FILTER (upto >= high * total) AS top, any_value(spread) AS spread, any_value(least) AS least
  FROM r JOIN tails USING (s) GROUP BY lang, source, s),
alls AS (SELECT s, cell, sum(n) AS n FROM own GROUP BY s, cell),
ra AS (SELECT s, cell, sum(n) OVER (PARTITION BY s ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY s) AS total FROM alls),
ga AS (SELECT s, min(cell) FILTER (upto >= 0.5 * total) AS mid, min(cell) FILTER (upto >= high * total) AS top, any_value(spread) AS spread, any_value(least) AS least FROM ra JOIN tails USING (s) GROUP BY s),
la AS (SELECT s, mid + greatest(trunc(spread * (top - mid)), least) AS most FROM ga),
lg AS (SELECT lang, source, s, n, mid + greatest(trunc(spread * (top - mid)), least) AS most FROM g),
f AS (SELECT x.doc_id, string_agg(x.s, ',' ORDER BY x.s) AS failed FROM x JOIN la USING (s)
  LEFT JOIN lg ON x.s = lg.s AND x.lang IS NOT DISTINCT FROM lg.lang AND x.source IS NOT DISTINCT FROM lg.source
  WHERE x.value > coalesce(floor((lg.n * lg.most + 20 * la.most) / (lg.n + 20)), la.most) GROUP BY x.doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(failed, '') AS failed_signals, NOT base_failed AND failed IS NULL AS kept
FROM b LEFT JOIN f USING (doc_id)
"""
