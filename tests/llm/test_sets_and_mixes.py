import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import jaccard, mixing, packing, winnowing

SF = "/root/testdata/sf0.001"


def brute_components(texts):
    sets = {}
    for i, x in texts.items():
        w = (x or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in texts}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed=1):
    """A large group of near copies, chains of drifting copies, a shared passage, and short texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(4))
    base, texts = [word() for _ in range(60)], []
    for _ in range(120):
        w = list(base)
        for _ in range(r.randrange(0, 3)):
            w[r.randrange(60)] = word()
        texts.append(" ".join(w))
    w = [word() for _ in range(80)]
    for _ in range(25):
        w = list(w)
        w[r.randrange(80)] = word()
        texts.append(" ".join(w).upper())
    passage = [word() for _ in range(30)]
    texts += [" ".join([word() for _ in range(r.randrange(5, 60))] + passage) for _ in range(60)]
    texts += ["a b", "A  b", "a b c d", "a b c d e", "", " ", "a"]
    return dict(enumerate(texts, 1))


@pytest.mark.parametrize("hot", [jaccard.HOT, 8])
def test_components_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    texts = near_copies()
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(d).collect()}
    assert got == brute_components(texts)


def test_one_of_each(spark):
    texts = near_copies(2)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {c for _, c in brute_components(texts).values()}
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(d).collect()) == sorted(want)


def test_targets_by_iteration(spark):
    r = random.Random(3)
    for case in range(4):
        sizes = {f"s{i}": r.choice([0, 5, 50, 1000, 40000]) for i in range(2 + 3 * case)}
        sizes[None] = 70
        names = [*sorted(k for k in sizes if k is not None), None]
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        total, capped = sum(sizes.values()), set()
        while True:
            left = total - sum(3 * sizes[s] for s in capped)
            free = [s for s in names if s not in capped]
            target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
            if not (over := {s for s in free if target[s] > 3 * sizes[s]}):
                break
            capped |= over
        got = mixing.source_targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")).collect()
        assert {x["source"]: pytest.approx(x["target"], abs=1e-6) for x in got} == target


def test_mix(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = mixing.mix(d).collect(), mixing.mix(d.repartition(5)).collect()
    assert sorted(a) == sorted(b)
    words = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in d.collect()}
    source = {r["doc_id"]: r["source"] for r in d.collect()}
    taken, target, least = Counter(), {}, {}
    for r in a:
        assert r["size"] == words[r["doc_id"]] and r["taken"] <= 3 * r["size"]
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        least[s] = min(least.get(s, r["size"]), r["size"])
    assert sum(target.values()) == pytest.approx(sum(words.values()))
    # The nearest sum, from above or below: off by at most 1 %, or half of the smallest document.
    assert all(abs(taken[s] - target[s]) <= max(0.01 * target[s], least[s] / 2) for s in target)
    copies = Counter(r["doc_id"] for r in mixing.mixed_documents(d).collect())
    assert all(copies[r["doc_id"]] == r["copies"] for r in a)


def test_mix_of_more_documents_meets_its_targets(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = mixing.mix(d).join(d.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.min("size").alias("least")).collect()
    assert len(m) == 20 and all(abs(r["taken"] - r["target"]) <= max(0.002 * r["target"], r["least"] / 2) for r in m)


def test_filling_comes_nearest(spark):
    """Of sizes with how many there are, largest first, and a last exchange."""
    cases = [([(10, 3), (4, 2), (3, 1)], 17.0, 17), ([(9, 1), (8, 2)], 16.2, 17), ([(5, 1)], 2.0, 0), ([(5, 1)], 3.0, 5), ([(100, 1)], 0.4, 0), ([(7, 2)], -1.0, 0), ([(2, 5)], 30.0, 10)]
    rows = [(i, sizes, gap) for i, (sizes, gap, _) in enumerate(cases)]
    took = mixing.filled(spark.createDataFrame(rows, "k int, sizes array<struct<size:bigint,n:bigint>>, gap double"), ["k"]).collect()
    for i, (sizes, _, want) in enumerate(cases):
        mine = [r for r in took if r["k"] == i]
        assert sum(r["size"] * r["n"] for r in mine) == want and all(0 < r["n"] <= dict(sizes)[r["size"]] for r in mine) and len({r["size"] for r in mine}) == len(mine)


def test_samples_follow_their_probabilities(spark):
    """Equal sizes, and texts that repeat their words or don't: a stratum's sample is that of the lowest
    Pareto ranks, of fixed size, and the texts that repeat theirs are taken less often."""
    text = lambda i: " ".join([f"w{i}x{k}" for k in range(8)] if i % 2 else [f"w{i}"] * 8)
    d = spark.createDataFrame([(i, text(i), "a" if i % 4 < 2 else "b") for i in range(2000)], "doc_id long, text string, source string")
    by = defaultdict(list)
    for r in mixing.mix(d).collect():
        by[r["doc_id"] % 4 < 2].append(r)
    drawn = Counter()
    for rows in by.values():
        whole, target, words = min(r["copies"] for r in rows), rows[0]["target"], rows[0]["source_size"]
        rest = target / words - int(target / words)
        if rest < 0.01:
            continue
        assert len({round(r["p"], 9) for r in rows}) == 2
        assert sum(r["p"] for r in rows) == pytest.approx(rest * len(rows))
        assert sum(r["copies"] - whole for r in rows) == round((target - whole * words) / 8)  # the nearest
        rank = sorted(rows, key=lambda r: r["u"] / (1 - r["u"]) * (1 - r["p"]) / r["p"])
        copies = [r["copies"] for r in rank]
        assert copies == sorted(copies, reverse=True)
        drawn.update({r["doc_id"] % 2: r["copies"] - whole for r in rows for _ in [0]})
        odd, even = (sum(r["copies"] - whole for r in rows if r["doc_id"] % 2 == k) for k in (1, 0))
        assert odd > even


def test_repeated_rows_are_taken_together(spark):
    d = spark.createDataFrame([(1, "a b c", "s")] * 60 + [(i, f"w{i} x y", "s") for i in range(2, 90)] + [(200, "t u v", "t")] * 30, "doc_id long, text string, source string")
    rows = mixing.mix(d).collect()
    assert len({r["copies"] for r in rows if r["doc_id"] == 1}) == 1
    assert sum(r["taken"] for r in rows if r["source_size"] == 444) <= max(r["target"] for r in rows if r["source_size"] == 444)
    assert Counter(r["doc_id"] for r in mixing.mixed_documents(d).collect()) == Counter({i: n for i, n in sum((Counter({r["doc_id"]: r["copies"]}) for r in rows), Counter()).items() if n})


def test_inclusion_is_by_pareto_rank(spark):
    """Equal sizes: the documents taken once more are those of the lowest ranks."""
    d = spark.createDataFrame([(i, f"w{i} x", "a" if i % 4 else "b") for i in range(400)], "doc_id long, text string, source string")
    by = defaultdict(list)
    for r in mixing.mix(d).collect():
        by[r["source_size"]].append((r["u"], r["copies"]))
    for rows in by.values():
        copies = [c for _, c in sorted(rows)]
        assert copies == sorted(copies, reverse=True)


def test_packing(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as public
    import zlib

    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    d = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, "<|endoftext|> ok"), (-2, None), (-3, "😀 " * 3000)], "doc_id long, text string")
    docs = {r["doc_id"]: r["text"] or "" for r in d.select("doc_id", "text").unionByName(odd).collect()}
    pieces = packing.packed(d.select("doc_id", "text").unionByName(odd)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for i, text in docs.items():
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    room = used = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.LENGTH
        used, room = used + at, room + (2 ** int(np.ceil(np.log2(at))) if at <= 1024 else 2048)
    assert 1 - used / room < 0.03


def test_packing_query_gives_the_librarys_ids(spark, tmp_path):
    """Added tokens and long white space, against the tokenizer as it is loaded."""
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as public
    import zlib

    from quire.llm.queries import QUERIES

    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|> ok", "a<|endoftext|><|endoftext|>  b", "x" + " " * 1_200_000 + "y", "\n\t" * 60_000, "plain  text", "<|endoftext|"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = defaultdict(dict)
    for r in QUERIES["op7_packing"](spark, str(tmp_path)).collect():
        got[r["doc_id"]][r["start"]] = (r["length"], r["ids_crc32"], r["doc_tokens"])
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4")
        parts = {at: ids[at : at + 2048] for at in range(0, len(ids), 2048)}
        assert got[i] == {at: (len(p), zlib.crc32(p.tobytes()), len(ids)) for at, p in parts.items()}


@pytest.mark.parametrize("words", [1, 2, 9, 17])
def test_packing_of_short_texts_has_little_padding(spark, words):
    d = spark.createDataFrame([(i, " a" * (words + i % 2)) for i in range(6000)], "doc_id long, text string")
    rows = packing.packed(d).collect()
    by_sequence = Counter()
    for p in rows:
        by_sequence[p["sequence_id"]] += p["length"]
    total = sum(p["length"] for p in rows)
    assert total == sum(words + i % 2 + 1 for i in range(6000)) and max(by_sequence.values()) <= packing.LENGTH
    assert len(by_sequence) <= -(-total // packing.LENGTH) + 1


def test_column_generation_is_exact():
    r = np.random.default_rng(0)
    for n in (1, 7, 300, 20000):
        sizes, demand = np.unique(r.integers(1, 257, n), return_counts=True)
        got = packing.patterns(sizes, demand.astype(np.int64), 256)
        assert (sum(p * k for p, k in got) == demand).all()
        assert all(0 < (p * sizes).sum() <= 256 for p, _ in got)
        if n == 20000:
            assert sum(k for _, k in got) <= 1.02 * np.ceil((sizes * demand).sum() / 256)


def brute_winnow(text, hash_of):
    import re

    words = [hash_of[w] for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower())]
    m, b, k, w = winnowing.MODULUS, winnowing.BASE, winnowing.K, winnowing.W
    grams = [sum(x * pow(b, k - 1 - j, m) for j, x in enumerate(words[i : i + k])) % m for i in range(len(words) - k + 1)]
    out = []
    for i in range(max(1, len(grams) - w + 1) if grams else 0):
        window = grams[i : i + w]
        low = min(window)
        at = i + max(j for j, x in enumerate(window) if x == low)
        if (low, at) not in out:
            out.append((low, at))
    return " ".join(f"{h:x}@{at}" for h, at in out)


def test_winnowing(spark):
    import re

    texts = ["a b a b a b a b a b a b a b a b", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "Tab\tand\nLINE breaks here é ü 😀 x y z", "four words are here", "x y"]
    words = sorted({w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t.lower())})
    h = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(winnowing.MODULUS)).alias("h"))
    hash_of = {r["w"]: r["h"] for r in h.collect()}
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in winnowing.edited_fingerprints(d).collect()}
    for i, x in enumerate(texts[:4]):
        assert got[i]["fingerprint"] == brute_winnow(x, hash_of)
    assert len(got[4]["fingerprint"].split()) == 1
    for i, x in enumerate(texts):
        after = texts[i - 1] if i else texts[-1]
        n = len(x) // 3
        assert got[i]["edited_sha256"] == hashlib.sha256((x[: len(x) - n] + after[:n]).encode()).hexdigest()


def test_edited_texts_match_brute_force(spark, tmp_path):
    """Every column of the query, over real texts and odd ones."""
    import re

    from quire.llm.queries import QUERIES

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()}
    docs |= {-1: "", -2: None, -3: "one two", -4: "same words here again and again " * 3, -5: "same words here again and again " * 3}
    text = {i: t or "" for i, t in docs.items()}
    order = sorted(text, reverse=True)
    edited = {}
    for n, i in enumerate(order):
        cut, after = len(text[i]) // 3, text[order[(n + 1) % len(order)]]
        edited[i] = text[i][: len(text[i]) - cut] + after[:cut]
    words = sorted({w for t in [*text.values(), *edited.values()] for w in re.findall(r"[^\x20\x09-\x0D]+", t.lower())})
    h = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(winnowing.MODULUS)).alias("h"))
    hash_of = {r["w"]: r["h"] for r in h.collect()}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op9_winnowing"](spark, str(tmp_path)).collect()}
    print_of = lambda t: brute_winnow(t, hash_of)
    hashes = lambda fp: {x.split("@")[0] for x in fp.split()}
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    assert set(got) == set(text)
    for n, i in enumerate(order):
        r, after = got[i], order[(n + 1) % len(order)]
        assert r["n_chars"] == len(text[i]) and r["edited_sha256"] == hashlib.sha256(edited[i].encode()).hexdigest()
        if min(len(t.split()) for t in (text[i], edited[i], text[after])) < winnowing.K:
            continue  # shorter texts are one k-gram, hashed whole
        assert r["fingerprint"] == print_of(text[i]) and r["edited_fingerprint"] == print_of(edited[i])
        assert r["near_edited"] == pytest.approx(like(hashes(print_of(text[i])), hashes(print_of(edited[i]))))
        assert r["near_next"] == pytest.approx(like(hashes(print_of(text[i])), hashes(print_of(text[after]))))
    assert got[-4]["fingerprint"] == got[-5]["fingerprint"] and got[-1]["near_edited"] == 1.0


def test_texts_without_spaces_are_winnowed(spark):
    r = random.Random(6)
    han = lambda n: "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(n))
    b64 = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    for make in (han, b64):
        shared = make(600)
        d = spark.createDataFrame([(0, make(7) + shared), (1, shared + make(300)), (2, make(900))], "doc_id long, text string")
        got = {r["doc_id"]: r for r in winnowing.edited_fingerprints(d).collect()}
        assert all(x["near_edited"] > 0.4 for x in got.values())
        assert got[1]["near_next"] > 0.4 and got[2]["near_next"] < 0.1


def test_shared_runs_are_found(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    run = [word() for _ in range(winnowing.K + winnowing.W - 1)]
    texts = [" ".join([word() for _ in range(r.randrange(40))] + run + [word() for _ in range(r.randrange(40))]) for _ in range(20)]
    d = winnowing.fingerprint(spark.createDataFrame([(x,) for x in texts], "text string"), "text", "fp")
    sets = [{h >> 31 for h in r["fp"]} for r in d.collect()]
    assert all(a & b for a in sets for b in sets)


def test_block_sizes_never_lose_a_link():
    r = np.random.default_rng(4)
    for _ in range(300):
        pool = r.integers(0, 1 << 63, r.integers(2, 400), dtype=np.uint64)
        x, y = (np.unique(r.choice(pool, r.integers(1, len(pool) + 1))) for _ in range(2))
        if jaccard._do_link(x.tobytes(), y.tobytes()):
            assert jaccard._may_link(jaccard._block_sizes(x), jaccard._block_sizes(y))
        both = len(np.intersect1d(x, y))
        assert jaccard._do_link(x.tobytes(), y.tobytes()) == (100 * both >= 75 * (len(x) + len(y) - both))


def test_small_batches_of_numbers_are_gathered():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 1000))], ["x"]) for i in range(0, 70_000, 1000)]
    got = list(jaccard._gathered(iter(batches)))
    assert [b.num_rows for b in got] == [33_000, 33_000, 4000]
    assert pa.concat_batches(got).column(0).to_pylist() == list(range(70_000))
    assert not list(jaccard._gathered(iter([])))
