"""The ten operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import embeddings, graph, induced_sorting, language, line_dedup, mixing, near_duplicates, packing, quality_model, quality_rules, registry, repeated_passages, resharding
from lodestrata.llm.shared import Workspace, shingles, word_hashes
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, node long"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, rng.randrange(30, 120)) for _ in range(12)]
    texts = [None, "", " \n\t", "short", "a b c d", *base]
    for t in base[:6]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts += [t, " ".join(w), t.upper(), t + "\n" + base[7][:90] + "\n" + base[8][:90]]
    texts += [base[0] + " " + words(rng, 40_000), "é日本" * 40, "x" * 3000, "rep eat " * 300]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), None, "s", "k", 1) for i, t in enumerate(texts)]
    return [*out, out[7], (None, base[3], "en", "a", 1, "s", "k", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_word_hashes_and_shingles():
    t = [b"a  b\tc", b"", b" ", b"a b c d e f", b"\xc2\xa0x y"]
    data, offsets = np.frombuffer(b"".join(t), np.uint8), np.cumsum([0, *map(len, t)])
    h, at = word_hashes(data, offsets)
    assert np.diff(at).tolist() == [len(x.split()) for x in t]
    assert h[0] == h[at[3]] and len(shingles(h[at[3] :  at[4]], 5)) == 2 and len(shingles(h[:2], 5)) == 1


def test_op9_near_duplicates(spark, docs, rows, empty):
    got = near_duplicates.near_duplicates(docs, Workspace(spark, "t9")).collect()
    assert near_duplicates.near_duplicates(empty, Workspace(spark, "t9")).count() == 0
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(parent, a), find(parent, b)))
                parent[y] = x
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        assert tuple(r) == ((i, len(sets[i]), find(parent, i), find(parent, i) == i) if i is not None else (None, len(sets[None]), None, False))


def test_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = words(rng, 80).split()
    own = []
    for i in range(700):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(80)] = words(rng, 1)
        own.append((i, " ".join(w), *[None] * 6))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(spark.createDataFrame(own, SCHEMA), Workspace(spark, "t9b")).collect()}
    sets = [frozenset(tuple(r[1].split()[k : k + 5]) for k in range(76)) for r in own]
    parent = list(range(700))
    for a in range(700):
        for b in range(a + 1, 700):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(parent, a), find(parent, b)))
                parent[y] = x
    assert all(got[i] == find(parent, i) for i in range(700))


def test_op8_lines(spark, docs, rows, empty):
    got = line_dedup.dedup_lines(docs, Workspace(spark, "t8")).collect()
    assert line_dedup.dedup_lines(empty, Workspace(spark, "t8")).count() == 0
    lines = sorted({(i, k, x) for i, t, *_ in rows if i is not None for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\v\f\r")})
    parent = linked_lines([x for _, _, x in lines])
    gone = {(lines[k][0], lines[k][1]) for k in range(len(lines)) if find(parent, k) != k}
    assert len(got) == len(rows)
    for r in got:
        t = next(x[1] for x in rows if x[0] == r["doc_id"])
        keep = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (r["doc_id"], k) not in gone)
        assert r["text"] == keep and r["score"] == "s" and r["node"] == 1


def line_set(x, k):
    return {x[i : i + k] for i in range(len(x) - k + 1)}


def linked_lines(lines):
    """Brute force: equal lines, and those of 11 characters or more by shingles of 3 characters (both under 128) or 8 (both from 96)."""
    parent, sets = list(range(len(lines))), [(line_set(x, 3), line_set(x, 8)) for x in lines]
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    for b, y in enumerate(lines):
        for a, x in enumerate(lines[:b]):
            if x == y or min(len(x), len(y)) >= 11 and (max(len(x), len(y)) < 128 and near(sets[a][0], sets[b][0]) or min(len(x), len(y)) >= 96 and near(sets[a][1], sets[b][1])):
                p, q = sorted((find(parent, a), find(parent, b)))
                parent[q] = p
    return parent


def removed(spark, texts, name):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {(r["doc_id"], k) for r in line_dedup.dedup_lines(docs, Workspace(spark, name)).collect() for k in r["removed_lines"]}


def test_op8_short_lines_by_equality(spark):
    """Lines of any length that are not blank go where an earlier line is equal; blank ones and others stay."""
    texts = ["Released under the MIT License.\n\n \t\n}\n版权所有\nChapter 1", "own\n\n}\nReleased under the MIT License.", "版权所有\n \t\nChapter 2\nabc\nabc"]
    assert removed(spark, texts, "t8s") == {(1, 2), (1, 3), (2, 0), (2, 4)}


def test_op8_one_changed_character(spark):
    """Lines of 12 to 200 characters in one-byte and three-byte letters with changed characters, against brute force; of
    32 characters or more one change inside links."""
    rng, texts = random.Random(12), ["Thwhesnd esator whshing and hewh.", "Thwhesnd, esator whshing and hewh."]
    for size in [32, 33, 40, 60, 78, 79, 95, 96, 127, 128, 131, 200] * 2 + [12, 20]:
        for letters in (None, str.maketrans("abcdefgh", "日本語文字列検索")):
            x = words(rng, 80)[:size]
            own = [x, x[: size // 2] + "7" + x[size // 2 + 1 :], x[: size // 3] + "8, " + x[size // 3 :], x[: size // 3] + "99" + x[size // 3 + 2 : -9] + "wwwwwwwww", x[:-1] + "!"]
            texts += own if letters is None else [y.translate(letters) for y in own]
    parent = linked_lines(texts)
    got = removed(spark, texts, "t8c")
    assert got == {(k, 0) for k in range(len(texts)) if find(parent, k) != k}
    assert (1, 0) in got and all((k, 0) in got for k in range(3, 242, 5))


def test_buckets_of_many_batches(spark):
    """Every bucket that two nodes share comes with all its nodes and leaders that join them, however rows are dealt."""
    rng = random.Random(3)
    rows = [(n, [rng.randrange(60) << 50 for _ in range(3)] + [rng.randrange(-(1 << 63), 1 << 63), 7 << 40]) for n in range(-400, 400)] + [(5, [7 << 40]), (9, None)]
    df = spark.createDataFrame(rows, "node long, buckets array<long>").repartition(7)
    got = {}
    for r in graph.shared_buckets(df, 4000, Workspace(spark, "tb")).collect():
        got.setdefault(r["bucket"], set()).add((r["node"], r["leader"]))
    want = {}
    for n, b in rows:
        for x in b or []:
            want.setdefault(x, set()).add(n)
    assert sorted(sorted({n for n, _ in v}) for v in got.values()) == sorted(sorted(v) for v in want.values() if len(v) > 1)
    for pairs in got.values():
        lead = dict(sorted(pairs, reverse=True))
        up = {n: min(m for k, m in pairs if k == n) for n in lead}
        root = lambda n: n if up[n] == n else root(up[n])
        assert {root(n) for n in up} == {min(up)}


@pytest.mark.parametrize("hot_bytes", [repeated_passages.HOT_BYTES, 200, 0])
def test_op7_passages(spark, docs, rows, empty, hot_bytes):
    got = repeated_passages.remove(docs, repeated_passages.repeated(docs, Workspace(spark, "t7"), hot_bytes=hot_bytes)).collect()
    assert repeated_passages.remove(empty, repeated_passages.repeated(empty, Workspace(spark, "t7"))).count() == 0
    seen = {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            seen.setdefault(b[p : p + 50], i)
    for r in got:
        b = (next(x[1] for x in rows if x[0] == r["doc_id"]) or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if r["doc_id"] is not None and seen[b[p : p + 50]] < r["doc_id"]:
                gone[p : p + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (len(b), int(gone.sum()), runs, kept)


@pytest.mark.parametrize("limit", [induced_sorting.QUEUE_BYTES, 64])
def test_suffix_order_and_common_prefixes(monkeypatch, limit):
    monkeypatch.setattr(induced_sorting, "QUEUE_BYTES", limit)
    rng = random.Random(9)
    for letters in (b"a", b"ab", b"abcd", bytes(range(256))):
        for _ in range(40):
            base = bytes(rng.choices(letters, k=200))
            own = [bytes(rng.choices(letters, k=rng.randrange(0, 60))) for _ in range(rng.randrange(1, 9))]
            own += [base[a : a + rng.randrange(60)] for a in (rng.randrange(200) for _ in range(5))]
            text = np.array([x for s in own for x in [*(b + 1 for b in s), 0]], np.int32)
            order, shared = induced_sorting.suffix_order(text)
            plain = text.tolist()
            found = [plain[i : plain.index(0, i)] for i in order]
            assert sorted(order.tolist()) == list(range(len(text))) and found == sorted(found)
            for one, other, n in zip(found[:-1], found[1:], shared[1:].tolist(), strict=True):
                assert one[:n] == other[:n] and (n == min(len(one), len(other)) or one[n] != other[n])


def test_op7_only_places_that_meet_are_sorted():
    """Every place that shares a string with another owner's is kept, and most of those that share none are not."""
    rng = random.Random(8)
    word = lambda n: bytes(rng.choices(b"abcdefgh ", k=n))
    common = [word(rng.randrange(26, 90)) for _ in range(60)]
    texts = [b"".join(x for _ in range(12) for x in (rng.choice(common), word(rng.randrange(40)))) for _ in range(60)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    doc, at, size, _, _ = repeated_passages.places(data, offsets)
    pieces = [bytes(data[a : a + n]) for a, n in zip(at.tolist(), size.tolist(), strict=True)]
    ends = np.concatenate([[0], np.cumsum(size)])
    keep = repeated_passages.meeting(np.frombuffer(b"".join(pieces), np.uint8), ends, doc)
    owners = defaultdict(set)
    for p, d in zip(pieces, doc.tolist(), strict=True):
        for i in range(len(p) - 49):
            owners[p[i : i + 50]].add(d)
    shares = np.array([any(len(owners[p[i : i + 50]]) > 1 for i in range(len(p) - 49)) for p in pieces])
    assert shares.any() and keep[shares].all() and keep[~shares].mean() < 0.2
    found = lambda k: {(int(k[x]), y, z) for x, y, z in induced_sorting.repeated_strings([pieces[i] for i in k], doc[k], 50)}
    assert found(np.flatnonzero(keep)) == found(np.arange(len(pieces)))


def test_op2_embeddings(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 12))
    v[100:200] = v[:100] + rng.normal(size=(100, 12)) * 0.2
    v[200:230] = v[5]
    own = [(i, x.tolist()) for i, x in enumerate(v)]
    own += [(300, None), (301, []), (302, [0.0] * 12), (303, [float("nan")] * 12), (304, [1.0, None]), (305, [1.0, 2.0]), (306, [2.0, 4.0]), (307, [float("inf")] + [1.0] * 11), (5, v[5].tolist())]
    df = spark.createDataFrame([(*r, 0) for r in own], "vec_id long, embedding array<double>, label int")
    got = embeddings.near_vectors(df, Workspace(spark, "t2"), tile=64).collect()
    assert embeddings.near_vectors(df.limit(0), Workspace(spark, "t2")).count() == 0
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = (u @ u.T >= 0.95) & ~np.eye(300, dtype=bool)
    parent = list(range(300))
    for a, b in zip(*np.nonzero(near)):
        x, y = sorted((find(parent, a), find(parent, b)))
        parent[y] = x
    assert len(got) == len(own)
    for r in got:
        if r["vec_id"] < 300:
            assert r["component_id"] == find(parent, r["vec_id"]) and r["n_links"] == near[r["vec_id"]].sum() + near[r["vec_id"], 5] + (r["vec_id"] in (5, *range(200, 230)) and not near[r["vec_id"], 5])
        else:
            assert (r["n_links"], r["component_id"]) == ((1, 305) if r["vec_id"] in (305, 306) else (0, r["vec_id"]))


def test_op2_dense_blocks():
    """Many near vectors, some exactly at the threshold: blocks as a whole and pairs one by one find the same links."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=16) + rng.normal(size=(400, 16)) * 0.12
    v[::7] = np.round(v[::7])
    v[1::7] = 2 * v[::7][: len(v[1::7])]
    u = embeddings.unit(v)
    near = np.einsum("ij,kj->ik", u, u)
    limit = float(np.sort(near.ravel())[near.size // 2])
    found = {(a, b) for p, q in embeddings.links(u, u, embeddings.rotation(u), limit) for a, b in zip(p.tolist(), q.tolist(), strict=True)}
    want = {(a, b) for a in range(400) for b in np.flatnonzero(np.einsum("ij,ij->i", np.repeat(u[a : a + 1], 400, 0), u) >= limit).tolist()}
    assert found == want and 0.4 < len(found) / near.size < 0.6


def test_op2_tiles_without_shuffle(spark):
    """Comparing tiles deals out none of them, so disk does not grow with their pairs; many strips find what brute force finds."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1500, 8)).astype(np.float32)
    v[700:1400] = v[:700] + rng.normal(size=(700, 8)).astype(np.float32) * np.float32(0.1)
    v[1400:] = v[0]
    v[1400:, 3], v[0, 3] = 0.0, -0.0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    heads = df.select(F.col("vec_id").alias("node"), F.lit(1).cast("long").alias("n"), "embedding")
    compared = embeddings._compare(heads, np.eye(8), 1500, 0.95, 32, Workspace(spark, "t2"), 0)
    plan = compared._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    got = {r["vec_id"]: r for r in embeddings.near_vectors(df, Workspace(spark, "t2"), tile=32).collect()}
    u = embeddings.unit(v)
    near = (u @ u.T >= 0.95) & ~np.eye(1500, dtype=bool)
    parent = list(range(1500))
    for a, b in zip(*np.nonzero(near)):
        x, y = sorted((find(parent, a), find(parent, b)))
        parent[y] = x
    assert len(got) == 1500
    assert all((got[k]["n_links"], got[k]["component_id"]) == (near[k].sum(), find(parent, k)) for k in range(1500))


def test_op5_rules(spark, docs, rows, empty):
    got = quality_rules.judge(docs, workspace=Workspace(spark, "t5")).collect()
    assert quality_rules.judge(empty).count() == 0 and len(got) == len(rows)
    for r in got:
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n, cover = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
        for i in range(len(w) - 7):
            if n[tuple(w[i : i + 8])] > 1:
                cover.update(range(i, i + 8))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r["base_failed"] and r["kept"])


def test_op5_verdict(spark):
    """Limits follow the groups' own quantiles, and each signal can fail a document that keeps to the base rules."""
    rng, rules = random.Random(8), quality_rules.Rules()

    def text(group, k):
        w = [["ab", "abc", "abcd"][rng.randrange(3)] * (1 + group) + str(rng.randrange(9999)) for _ in range(64)]
        for at in range(group * rng.randrange(3)):
            w[at] = "#" + w[at]
        out = [" ".join(w[i : i + 8]) for i in range(0, 64, 8)]
        if group == 2 and k % 8 == 0:
            out[1] = out[0]
        return out

    docs = []
    for group in range(3):
        docs += [(len(docs) + k, text(group, k), "en" if group else None, f"s{group}") for k in range(70)]
    odd = [text(0, 1) for _ in range(4)]
    odd[0] = [x.replace(" ", " ##") for x in odd[0]]
    odd[1] += ["one line", "one line", "one line"]
    odd[2] = [*odd[2], "a b c d e f g h", "a b c d e f g h i"]
    odd[3] = [" ".join(x + "wwwwwwwwww" for x in t.split(" ")) for t in odd[3]]
    docs += [(1000 + k, t, None, "s0") for k, t in enumerate(odd)] + [(2000 + k, text(1, k), "de", "few") for k in range(5)] + [(3000, ["too short"], "en", "s1")]
    rows = [(i, "\n".join(t), a, b) for i, t, a, b in docs]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3), workspace=Workspace(spark, "t5v")).collect()}

    def values(r):
        return {k: 1000 * r[a] // r[b] if r[b] else 0 for k, (a, b) in quality_rules.SIGNALS.items()}

    def limits(group):
        out = {}
        for name, high, spread, least in rules.tails:
            cells = sorted(x >> max(0, x.bit_length() - 9) << max(0, x.bit_length() - 9) for x in (values(r)[name] for r in group))
            mid, top = (next(x for j, x in enumerate(cells, 1) if x != (cells[j] if j < len(cells) else None) and j >= q * len(cells)) for q in (0.5, high))
            out[name] = mid + max(int(spread * (top - mid)), least)
        return out

    groups = {}
    for r in got.values():
        if not r["base_failed"]:
            groups.setdefault((r["lang"], r["source"]), []).append(r)
    every = limits([r for g in groups.values() for r in g])
    own = {k: {x: (len(g) * y + rules.prior * every[x]) // (len(g) + rules.prior) for x, y in limits(g).items()} for k, g in groups.items()}
    for r in got.values():
        failed = sorted(k for k, x in values(r).items() if x > own[r["lang"], r["source"]][k])
        assert r["failed_signals"] == ",".join(failed) and r["kept"] == (not r["base_failed"] and not failed), r["doc_id"]
    assert all(k in got[1000 + i]["failed_signals"].split(",") for i, k in enumerate(quality_rules.SIGNALS))
    assert not any(got[1000 + k]["base_failed"] for k in range(4)) and got[3000]["base_failed"]
    assert all(len({x[k] for x in own.values()}) > 1 for k in quality_rules.SIGNALS)


def test_op5_sql(spark):
    compare(spark, quality_rules.op5_adaptive_quality_rules, quality_rules.OP5_SQL, SF)


INNER = sorted({w for m in (graph, line_dedup, mixing, quality_rules, resharding, language, quality_model) for w in re.findall(r"\"([a-z][a-z0-9_]*)\"", open(m.__file__).read())})


@pytest.mark.parametrize("apply", [
    lambda d, s: line_dedup.dedup_lines(d, Workspace(s, "c8")),
    lambda d, s: mixing.mix(d),
    lambda d, s: quality_rules.judge(d, workspace=Workspace(s, "c5")),
    lambda d, s: resharding.reshard(d, 3, 5, Workspace(s, "c6")),
    lambda d, s: language.identify(d, {"en": b"the cat and the dog", "de": b"der hund und die katze"}),
    lambda d, s: quality_model.score(d, quality_model.FactorisationMachine()),
], ids=["lines", "mix", "rules", "reshard", "language", "score"])
def test_clashing_columns(spark, docs, apply):
    """Columns that bear any name which the operators use inside stay as they are, and results are the same."""
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    wide = plain.select("*", *(F.lit(f"own {c}").alias(c) for c in INNER if c not in plain.columns))
    one, other = apply(plain, spark), apply(wide, spark)
    results = [c for c in one.columns if c not in plain.columns]
    key = lambda df: sorted(map(repr, df.select(*one.columns).collect()))
    assert len(INNER) > 100 and key(one) == key(other)
    kept = [c for c in INNER if c not in plain.columns and c not in results]
    for r in other.select(*kept).distinct().collect():
        assert tuple(r) == tuple(f"own {c}" for c in kept)


def test_op4_sql_and_edges(spark, docs, empty):
    compare(spark, mixing.op4_poisson_mixing, mixing.OP4_SQL, SF)
    assert mixing.mix(empty).count() == 0
    out = mixing.mix(docs, {"a": 1.0}, epochs=30.0)
    assert {r["source"] for r in out.select("source").distinct().collect()} == {"a"}
    means = {r["mixed_source"]: r["mean"] for r in mixing.rates(docs, {"a": 1.0, None: 1.0}, 2.0).collect()}
    assert means["b"] == 0.0 and means[None] > 0


def test_op3_round_trip(spark, docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    rows = [*rows, (900, "a <|endoftext|> b<|endoftext|>", None, None, None, None, None, None)]
    docs = docs.union(spark.createDataFrame(rows[-1:], SCHEMA))
    limits = packing.Limits(64, 4, 48)
    for lim in (packing.Limits(), limits):
        got = packing.pack_documents(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).coalesce(1), path, lim).collect()
        by = {}
        for r in got:
            by.setdefault(r["sequence_id"], []).append(r)
        for s in by.values():
            s.sort(key=lambda r: r["offset"])
            assert [r["offset"] for r in s] == np.cumsum([0, *(r["length"] for r in s)])[:-1].tolist()
            assert sum(r["length"] for r in s) <= lim.tokens and len(s) <= lim.segments and sum(r["loss_tokens"] for r in s) <= lim.loss
        for i, t, *_ in rows:
            if i is not None:
                own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
                assert [x for r in own for x in r["ids"]] == [*model.encode(t or "", add_special_tokens=False).ids, 0]
                assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in own)
    assert packing.pack_documents(empty, path).count() == 0


def test_op6_resharding(spark, docs, rows, empty):
    rng = random.Random(4)
    for _ in range(40):
        n, m = rng.randrange(1, 5), rng.randrange(1, 6)
        s = [rng.randrange(0, 40) for _ in range(n)]
        c = resharding.capacities(sum(s), m)
        flow = resharding.min_cost_flow(s, c, lambda i, j: int(i != j))
        assert [sum(x for (i, _), x in flow.items() if i == k) for k in range(n)] == s
        assert sum(x for (i, j), x in flow.items() if i != j) == sum(s) - sum(min(s[k], c[k]) for k in range(min(n, m)))
    got = resharding.reshard(docs, 3, 5, Workspace(spark, "t6")).collect()
    assert len(got) == len(rows) and resharding.reshard(empty, 3, 5, Workspace(spark, "t6")).count() == 0
    for k in {r["shard"] for r in got}:
        own = sorted(r["slot"] for r in got if r["shard"] == k)
        assert own == list(range(len(own))) and 0 <= k < 5
    assert all(r["size"] == len((r["text"] or "").encode()) + 8 for r in got)


def test_op6_rewrites_affected_shards(spark, tmp_path):
    """Of four shards on disk, 3 goes to 0: 0 is written anew, 3 is gone, the files of 1 and 2 are the same as before."""
    rng, path = random.Random(9), f"{tmp_path}/shards"
    rows = [(i, words(rng, rng.randrange(1, 40)), i % 4) for i in range(80)] + [(None, None, 3), (3, "", 3), (3, "", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(2).write.partitionBy("shard").parquet(path)
    files = lambda *keep: {p.relative_to(tmp_path).as_posix(): (p.read_bytes(), p.stat().st_mtime_ns) for k in keep for p in tmp_path.glob(f"shards/shard={k}/*.parquet")}
    before = files(1, 2)
    size = [sum(len((t or "").encode()) + 8 for _, t, k in rows if k == s) for s in range(4)]
    placed = resharding.reshard(spark.read.parquet(path), 4, 3, Workspace(spark, "t6w"), "shard", [size[0] + size[3], size[1], size[2]])
    resharding.rewrite(placed, path)
    assert before and files(1, 2) == before and not (tmp_path / "shards/shard=3").exists()
    got = spark.read.schema("doc_id long, text string, slot long, shard int").parquet(path).collect()
    want = [(i, t, 0 if k == 3 else k) for i, t, k in rows]
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["shard"]) for r in got))) == sorted(map(repr, want))
    assert sorted(r["slot"] for r in got if r["shard"] == 0) == list(range(sum(k in (0, 3) for _, _, k in rows)))


def test_op6_query(spark, tmp_path):
    """The digest is read from written files: every row once, repeated ones and null ids too."""
    rows = [(i // 2 if i else None, None if i == 5 else f"text {i // 4} é", "en") for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = resharding.op6_min_cost_flow_resharding(spark, str(tmp_path))
    assert out.inputFiles() and all("/shard=" in f for f in out.inputFiles())
    got = sorted(repr((r["doc_id"], r["size"], r["text_crc32"])) for r in out.collect())
    assert got == sorted(repr((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))) for i, t, _ in rows)


def test_op10_language(spark, docs, rows, empty):
    model = language.fit(docs)
    got = language.identify(docs, model).collect()
    assert len(got) == len(rows) and language.identify(empty, language.fit(empty)).count() == 0
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or ""))) and 0 <= r["score"] <= 1 for r in got)
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.op10_compression_language_id(spark, "/root/testdata/sf0.01").join(big.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.95


def test_op1_quality(spark, docs, rows, empty):
    model = quality_model.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality"))
    got = quality_model.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["kept"] == "k" for r in got)
    assert quality_model.score(empty, quality_model.fit(empty, empty.selectExpr("doc_id", "1 AS quality"))).count() == 0
    x = quality_model.features(pa.array(["a b b c", None, "d"]))
    index, value, starts, dense = model._rows(x)
    for r in range(3):
        full = np.zeros(model.buckets + len(quality_model.DENSE))
        np.add.at(full, index[starts[r] : starts[r + 1]], value[starts[r] : starts[r + 1]])
        full[model.buckets :] = dense[r]
        at = np.flatnonzero(full)
        pairs = sum(model.factors[i] @ model.factors[j] * full[i] * full[j] for n, i in enumerate(at) for j in at[:n])
        assert abs(model.bias + model.linear @ full + pairs - model.raw(x)[r]) < 1e-3
    out = quality_model.op1_factorisation_machine_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in out]) > 0.9


def test_pipeline(spark, rows, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "mix_sources", "packing"]
    out = corpus_pipeline.run(spark, SF).collect()
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], 0)
        by[r["sequence_id"]] += r["length"]
    assert out and max(by.values()) <= 1024
    for name, own in (("full", rows), ("none", [])):
        df = spark.createDataFrame([r[:5] for r in own], "doc_id long, text string, lang string, source string, n_chars long")
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() >= 0


def test_registry():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert hashlib and set(registry.ORACLE_SQL) <= set(registry.QUERIES)
