"""Exact dedup, embedding whitening and the filter audit against brute force, with odd rows."""

import hashlib
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import audit, exact, whiten

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and repeated ids, and extra columns with names that clash."""
    long = " ".join(f"word{i % 997}" for i in range(20_000))
    rows = [(1, None), (None, "alone"), (None, "both"), (7, "both"), (2, ""), (3, " \n\t"), (4, long), (9, long), (5, "tie # A"), (5, "tie # A"), (5, "other"), (6, "other"), (8, "a " * 300), (None, None), (10, "ABC def")]
    df = spark.createDataFrame([(i, t, None if i == 3 else "EN" if i == 4 else "de", "s", 1) for i, t in rows], DOCS)
    for c in ("digest", "length", "winner", "n_rows", "shard", "block", "keep_id", "group_size", "part", "mask", "first", "good", "n", "words", "step", "in_history"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def brute_dedup(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def decided(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("history", [None, "doc_id <= 4", "true", "false"])
def test_exact_dedup_of_odd_rows(odd, history):
    want = brute_dedup([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert decided(exact.exact_dedup(odd, history and F.expr(history))) == want
    assert exact.exact_dedup(odd.limit(0), history and F.expr(history)).collect() == []


def test_exact_dedup_with_a_hot_text_and_many_shards(spark, monkeypatch):
    monkeypatch.setattr(exact, "SHARD_KEYS", 16)
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.3 else f"text {rng.randrange(700)}") for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert decided(exact.exact_dedup(frame)) == brute_dedup(rows)
    got = exact.exact_dedup(frame, F.col("doc_id") < 500)
    assert decided(got) == brute_dedup(rows) and got.where("in_history").count() == 500


@pytest.mark.parametrize("blocks", [1, 5])
def test_stored_index_tells_members_by_whole_digests(spark, blocks):
    old = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    new = spark.createDataFrame([(1000 + i, f"text {i}") for i in range(200, 600)], "doc_id long, text string")
    known, fresh = (exact.distinct_digests(exact.digests(x)) for x in (old, new))
    found = exact.look_up(fresh, exact.build_index(known, 3), 3, blocks).collect()
    at = {bytes(r["digest"]): (r["keep_id"], r["group_size"], r["member"]) for r in found}
    assert len(found) == len(at) == 600
    want = {hashlib.sha256(f"text {i}".encode()).digest(): (1000 + i if i >= 200 else i, 2 if 200 <= i < 300 else 1, i < 300) for i in range(600)}
    assert at == want


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 1000):
        keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32).view(np.uint64)
        sizes, bits = exact.perfect_hash(keys)
        assert sorted(exact.slots(keys, sizes, bits)) == list(range(n))


VECTORS = "vec_id long, embedding array<float>"


def brute_whiten(rows, k=16):
    x = {i: [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    dev = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in x.items()}
    centred = np.array([[n * c - s for c, s in zip(v, sums, strict=True)] for v in fit], float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    z = {i: (np.array([n * c - s for c, s in zip(w, sums, strict=True)], float) / n) @ v[:, :k] / np.sqrt(np.maximum(e[:k], 1e-30)) for i, w in x.items()}
    return n, dev, z, e


@pytest.mark.parametrize("d,n", [(20, 300), (64, 200), (5, 50)])
def test_whitening_matches_numpy(spark, d, n):
    rng = np.random.default_rng(d)
    base = (rng.normal(size=(n, d)) @ np.diag(np.linspace(0.2, 3, d))).astype(np.float32)
    rows = [(i, list(map(float, base[i % n]))) for i in range(n + n // 2)] + [(1000 + i, list(map(float, base[7]))) for i in range(n)]
    frame = spark.createDataFrame(rows, VECTORS)
    got = whiten.whiten(frame.repartition(5)).collect()
    many, dev, z, e = brute_whiten(rows)
    k = min(16, d)
    assert len(got) == len(rows) * k and {r["n"] for r in got} == {many} and max(r["identity_error"] for r in got) < 1e-9
    signs = {}
    for r in got:
        j = r["component"] - 1
        assert r["deviation"] == dev[r["vec_id"]] and abs(r["explained"] / (e[j] / e.sum()) - 1) < 1e-9
        signs.setdefault(j, set()).add(np.sign(r["whitened"] * z[r["vec_id"]][j]))
        assert abs(abs(r["whitened"]) - abs(z[r["vec_id"]][j])) < 1e-7
    assert all(len(s - {0.0}) == 1 for s in signs.values())


def test_whitening_merges_many_partitions_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whiten, "FAN", 2 * 8 * 16)  # two or so moments a task
    rows = [(i, [float(np.sin(i * k) * k) for k in range(1, 5)]) for i in range(400)]
    frame = spark.createDataFrame(rows, VECTORS).repartition(13)
    m = whiten.moments(whiten.integers(frame).select("x").distinct().repartition(13), 4)
    x = np.array(sorted({tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v) for _, v in rows}))
    assert m.n == len(x) and m.sums() == x.sum(0).tolist()
    assert np.allclose(m.m2 / m.n, np.cov(x.T, bias=True), rtol=1e-12)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    fine = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(9)]
    rows = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 0.0, 0.0]), (104, [0.0, inf, 0.0]), (105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0]), (None, [1.0, 2.0, 1.0]), *fine, (0, [0.0, 0.0, 1.0])]
    frame = spark.createDataFrame(rows, VECTORS)
    for c in ("x", "d", "n", "part", "component"):
        frame = frame.withColumn(c, F.lit("clash"))
    got = whiten.whiten(frame).collect()
    assert len(got) == 11 * 2 and {r["vec_id"] for r in got} == {None, *range(9)}  # the third direction has no variance
    assert {r["n"] for r in got} == {len({(i % 5, i % 3) for i in range(9)} | {(1, 2)})} and {r["component"] for r in got} == {1, 2}
    assert max(r["identity_error"] for r in got) < 1e-9
    for none in (frame.limit(0), frame.where("vec_id = 100"), frame.where("vec_id = 3")):
        assert whiten.whiten(none).collect() == [] and whiten.whiten(none).columns[0] == "vec_id"


def test_whitening_deviation_is_exact_or_an_error():
    x = np.array([[1 << 40, 5], [3, 1 << 39]])
    n, sums = 1000, [123456789 << 20, 77]
    with pytest.raises(OverflowError):
        whiten.deviations(x, n, sums)
    small = x >> 20
    assert whiten.deviations(small, 7, [1, 2])[1].tolist() == [sum((7 * int(c) - s) ** 2 for c, s in zip(row, [1, 2], strict=True)) for row in small]


def test_symmetric_qr():
    rng = np.random.default_rng(3)
    for d in (1, 2, 3, 10, 80):
        a = rng.normal(size=(d, d))
        for m in (a + a.T, a[:, : d // 2] @ a[:, : d // 2].T, np.eye(d), np.zeros((d, d)), np.diag(np.arange(d) * 1.0)):
            e, v = whiten.symmetric_qr(m)
            assert np.allclose(v.T @ v, np.eye(d), atol=1e-12) and np.allclose(m @ v, v * e, atol=1e-11 * max(1, np.abs(m).max()) * d)
            assert np.allclose(e, np.linalg.eigvalsh(m)[::-1], atol=1e-11 * d)


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails, parts = [], {lang or "" for _, _, lang in docs}
    for i, t, lang in docs:
        t = t or ""
        w = t.encode().split()
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}
        fails.append((lang or "", {k for k, v in f.items() if v}, i))
    out = {}
    for order in permutations("ABCDE"):
        for part in parts:
            left = [x for x in fails if x[0] == part]
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                own = [r for r in fails if r[0] == part and x in r[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(own) - len(gone), sum(r[1] == {x} for r in own), sum(r[2] in good for r in gone), sum(r[2] in toxic for r in gone)]
    shapley = {}
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + v[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_matches_brute_force(spark, odd):
    rng = random.Random(9)
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    labels = [(1, 1, 0), (4, None, None), (5, 0, 0), (5, 1, 1), (None, 1, 1), (10, 1, 1), (99, 1, 1)]
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in audit.audit(odd, spark.createDataFrame(labels, LABELS)).collect()}
    assert got == brute_audit(docs, labels) and len(got) == 3 * 600
    docs = [(i, rng.choice([None, "same text here", " ".join(rng.choice(["a", "B", "c#", "ddd", f"w{k}"]) for k in range(rng.randrange(320)))]), rng.choice(["en", "", None, "xx"])) for i in range(120)]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 120, 2)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in audit.audit(frame, spark.createDataFrame(labels, LABELS)).collect()}
    assert got == brute_audit(docs, labels)
    assert audit.audit(odd.limit(0), spark.createDataFrame(labels, LABELS)).collect() == []
    assert audit.audit(odd, spark.createDataFrame([], LABELS)).where("good_lost > 0 or toxic_lost > 0").count() == 0


def test_filter_audit_counts_copies(spark):
    """Filter E fails every copy but that of the least id, across parts."""
    docs = spark.createDataFrame([(1, "one", "en"), (2, "two", "en"), (3, "one", "en"), (4, "one", "de")], "doc_id long, text string, lang string")
    got = {r["part"]: (r["kept"], r["removed"]) for r in audit.audit(docs, spark.createDataFrame([], LABELS)).where("filter_order = 'EABCD' and step = 1").collect()}
    assert got == {"en": (2, 1), "de": (0, 1)}
