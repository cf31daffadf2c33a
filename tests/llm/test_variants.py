"""MinHash near-duplicates, spelling variants and whitening against brute force, and on odd rows."""

import random
import zlib
from collections import Counter
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from quire.llm import jaccard, minhash, spelling, whitening

SF = "/root/testdata/sf0.001"


def brute_components(texts, width, percent):
    sets = {}
    for i, x in texts.items():
        w = (x or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in texts}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def near_copies(seed=1):
    """A large group of near copies, chains of drifting copies, a shared passage, and short texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(4))
    base, texts = [word() for _ in range(80)], []
    for _ in range(120):
        w = list(base)
        for _ in range(r.randrange(0, 3)):
            w[r.randrange(80)] = word()
        texts.append(" ".join(w))
    w = [word() for _ in range(80)]
    for _ in range(25):
        w = list(w)
        w[r.randrange(80)] = word()
        texts.append(" ".join(w).upper())
    passage = [word() for _ in range(40)]
    texts += [" ".join([word() for _ in range(r.randrange(5, 40))] + passage) for _ in range(60)]
    texts += ["a b", "A  b", "a b c d", "a b c d e", "", " ", "a", None]
    return dict(enumerate(texts, 1))


@pytest.mark.parametrize("hot", [jaccard.HOT, 8])
def test_minhash_components_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    texts = near_copies()
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.minhash_components(d).collect()}
    assert got == brute_components(texts, 4, 80)


def test_occurrences_delete_rare_letters():
    runs = dict(spelling.occurrences("7", " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(600))))
    assert any(len(w) == 6 for w in runs) and sum(runs.values()) == 600 and all(len(w) in (6, 7) for w in runs)
    assert dict(spelling.occurrences("", "ABCDEF abcdef Éabcde short x" + "y" * 5)) == {"abcdef": 2, "Éabcde": 1, "xyyyyy": 1}


def test_signatures_estimate_similarity_and_ignore_slices(monkeypatch):
    r = np.random.default_rng(1)
    x = np.unique(r.integers(0, 1 << 63, 4000).astype(np.uint64))
    y = np.unique(np.concatenate([x[:3200], r.integers(0, 1 << 63, 800).astype(np.uint64)]))
    same = [float((minhash.signature(x[i::40]) == minhash.signature(np.setdiff1d(x[i::40], x[i::400]))).mean()) for i in range(40)]
    assert abs(np.mean(same) - 0.9) < 0.03
    whole = minhash.signature(y)
    monkeypatch.setattr(minhash, "SLICE", 7)
    assert (minhash.signature(y) == whole).all()


def brute_spelling(rows, length=6, times=5, factor=5):
    counts = Counter()
    for doc, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
            run = ""
    n = {w: k for w, k in counts.items() if len(w) >= length and k >= times}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by = {w: [o for o in n if near(w, o)] for w in n}
    form = {}
    for w, others in by.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(by[w]), n[form[w]] if form[w] else None)
    return out


def variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_matches_brute_force(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcé") for _ in range(r.randrange(5, 9))) for _ in range(25)] + ["listen", "silent", "enlist", "listens", "ÀÿÀÿÀÿ"]
    rows = []
    for i in range(120):
        words = []
        for _ in range(150):
            w = r.choice(base[: 1 + r.randrange(len(base))])
            if r.random() < 0.3:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abcé") + w[k:], w[:k] + r.choice("abcé") + w[k + 1 :]])
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i if i else None, " ".join(words)))
    rows += [(500, None), (501, ""), (7, rows[7][1])]
    want = brute_spelling(rows)
    assert variants(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == want
    assert sum(v[0] is not None for v in want.values()) > 20 and max(v[3] for v in want.values()) > 3


def test_spelling_forms_lead_to_roots_and_ties(spark):
    """A chain of three forms, ties by code point, anagrams that aren't near, and very long words, in documents whose ids
    delete no letter."""
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "zzzzzz": 5, "zzzzzy": 30, "zzzzzé": 30, "abcdef": 5, "fedcba": 50, "x" * 3000: 5, "x" * 3001: 25}
    ids = [i for i in range(5000) if all(zlib.crc32(f"{i}:{w}".encode()) % spelling.RARE for w in counts)]
    rows = [(i, " ".join(w for w, n in counts.items() if n > k)) for k, i in enumerate(ids[:625])]
    got = variants(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got["aaaaaa"] == ("aaaaab", "aaabbb", 5, 1, 25) and got["aaaaab"][:2] == ("aaaabb", "aaabbb") and got["aaabbb"] == (None, "aaabbb", 625, 1, None)
    assert got["zzzzzz"] == ("zzzzzy", "zzzzzy", 5, 2, 30) and got["abcdef"] == (None, "abcdef", 5, 0, None)
    assert got["x" * 3000][0] == "x" * 3001


def test_anagrams_with_half_of_their_order_apart_do_not_meet(spark):
    """Posts of one set of letters meet only where half of the order agrees."""
    words = spark.createDataFrame([(1, "abcdefgh"), (2, "hgfedcba"), (3, "abcdefgx"), (4, "xbcdefgh"), (5, "abcdefg")], "id long, word string")
    posts = spelling.postings(words).where("kind > 0").collect()
    meet = lambda i: {r["meet"] for r in posts if r["id"] == i and r["kind"] == 2}
    assert not meet(1) & meet(2) and len(meet(1) & meet(3)) == 1 and len(meet(1) & meet(4)) == 1
    assert len(meet(1)) == 16


def brute_whitened(vectors):
    x = [[int(np.floor(1024 * float(c))) + 100000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(dims)]
    y = [[n * a - b for a, b in zip(r, s, strict=True)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(dims)] for i in range(dims)])
    return n, [sum(a * a for a in r) for r in y], v, y


@pytest.mark.parametrize("scale", [1.0, 5e6])
def test_whitening_matches_brute_force(spark, scale, monkeypatch):
    monkeypatch.setattr(whitening, "TOGETHER", 2)
    monkeypatch.setattr(whitening, "BLOCK", 32)
    r = np.random.default_rng(5)
    vectors = [[float(c) for c in scale * (r.normal(size=10) * np.arange(1, 11) + 3)] for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(7)
    got = whitening.whitened(d).toPandas().sort_values(["vec_id", "component"])
    n, dev, v, y = brute_whitened(vectors)
    assert len(got) == 8 * n and set(got["n"]) == {n}
    assert got["deviation"].tolist() == [Decimal(k) for k in dev for _ in range(8)]
    e = np.linalg.eigvalsh(v)[::-1][:8]
    w = got["whitened"].to_numpy().reshape(n, 8)
    assert np.allclose(got["explained"].to_numpy().reshape(n, 8), e / np.trace(v), rtol=1e-9, atol=0)
    assert np.abs(w.T @ w / n - np.eye(8)).max() < 1e-9 and got["identity_error"].max() < 1e-9
    values, axes = np.linalg.eigh(v)
    want = (np.array(y, float) / n) @ axes[:, ::-1][:, :8] / np.sqrt(e)
    assert np.allclose(np.abs(w), np.abs(want), atol=1e-8)


def test_scatter_is_exact(spark):
    r = np.random.default_rng(6)
    vectors = [[float(c) for c in r.normal(size=5) * 1e9] for _ in range(50)]
    d = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(3)
    rows = whitening.remaining(d, "embedding", "vec_id")
    n, sums, span = whitening._sums(rows)
    _, _, _, y = brute_whitened(vectors)
    assert whitening.scatter(rows, n, sums, span) == [[sum(a[i] * a[j] for a in y) for j in range(i, 5)] for i in range(5)]
    p = whitening.primes(1 << 200)
    assert all(q < 1 << 22 and all(q % k for k in range(2, 2048)) for q in p) and len(set(p)) == len(p)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [2.0, 1.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0, 3.0]), (8, []), (9, [1e300, 0.0]), (10, [-0.5, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for c in ("key", "v", "n", "component", "part", "deviation"):
        d = d.withColumn(c, d.vec_id)
    got = whitening.whitened(d).collect()
    assert sorted(str(r["vec_id"]) for r in got) == sorted(["1", "1", "None", "None", "6", "6", "6", "6", "10", "10"]) and {r["n"] for r in got} == {5}
    assert whitening.whitened(d.limit(0)).count() == 0 and whitening.whitened(d.where("vec_id = 8")).count() == 0
    same = whitening.whitened(d.where("vec_id = 6")).collect()
    assert len(same) == 4 and {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(0, None, None, None)}
    line = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")).collect()
    assert {r["whitened"] for r in line if r["component"] == 2} == {None} and all(r["whitened"] is not None for r in line if r["component"] == 1)
