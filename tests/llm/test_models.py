import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import lm, media, quality

SF = "/root/testdata/sf0.01"


def test_machine_identity():
    """The sum-of-squares identity against all pairs."""
    r = np.random.default_rng(0)
    width = quality.SLOTS + len(quality.STATISTICS)
    m = quality.Machine(0.3, r.normal(size=width), r.normal(size=(width, quality.RANK)), np.zeros(len(quality.STATISTICS)), np.ones(len(quality.STATISTICS)))
    rows = [quality.features(t, None) for t in ("a b c a", "", "Some OTHER words | here.\nand more!")]
    index, value, starts = m.inputs([(i, x.copy()) for i, x in rows])
    got = m.logits(index, value, starts)
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(index)], strict=True)):
        i, x = index[a:b], value[a:b]
        want = 0.3 + (m.linear[i] * x).sum() + sum((m.factors[i[p]] @ m.factors[i[q]]) * x[p] * x[q] for p in range(len(i)) for q in range(p))
        assert got[k] == pytest.approx(want)


def test_held_out_quality(spark):
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    again = {r["doc_id"]: r["score"] for r in quality.quality_scores(d.repartition(3), labels.repartition(2)).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], abs=1e-9) for r in rows)


def test_quality_against_all_pairs(spark):
    """The query's scores from the fitted machine, every pair of inputs by itself."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    m = quality.classifier(d, labels)
    got = {r["doc_id"]: r for r in quality.quality_scores(d, labels).collect()}
    rows = d.collect()
    assert len(got) == len(rows)
    for r in rows[::7]:
        i, x, _ = m.inputs([quality.features(r["text"], r["n_chars"])])
        vx = m.factors[i] * x[:, None]
        gram = vx @ vx.T
        z = m.bias + (m.linear[i] * x).sum() + np.triu(gram, 1).sum()
        s = got[r["doc_id"]]
        assert s["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-9)
        assert s["predicted"] == (s["score"] >= 0.5) and s["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_metadata_counts(spark):
    """n_chars by itself can tell the classes; a table without it is scored too, and repeated ids send no more."""
    rows = [(i, "the same words here", 10 if i % 2 else 100_000) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(d, labels).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got)
    assert quality.quality_scores(d.drop("n_chars"), labels).count() == 400
    again = d.where("doc_id = 7").crossJoin(spark.range(500).select())
    rows, _, times = quality.training_rows(again, labels.join(again.select("doc_id").distinct(), "doc_id", "left_semi"), 50)
    assert len(rows) == 1 and times.tolist() == [500]


def test_labels_of_one_class(spark):
    d = spark.createDataFrame([(i, f"text {i}", 6) for i in range(9)], "doc_id long, text string, n_chars long")
    out = quality.quality_scores(d, spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")).collect()
    assert all(r["score"] > 0.99 for r in out)


def test_lm_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 3000)  # most words take the joined path
    d = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b""] for r in d.collect()}
    counts = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in lm.lm_scores(d).collect()}
    model = base = 0.0
    for i, t in texts.items():
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0) and r["n_tokens"] == len(t) and r["train_tokens"] == n
        assert r["n_known"] == sum(counts[w] > 0 for w in t)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9)
        if r["held_out"]:
            model, base = model + r["score"], base + r["base_score"]
    assert model > base * 0.9  # both negative: the model is better
    again = {r["doc_id"]: r["score"] for r in lm.lm_scores(d.repartition(16)).collect()}
    assert all(again[i] == pytest.approx(r["score"], rel=1e-6) for i, r in got.items())


def test_lm_is_trained_alike_at_any_size(spark, monkeypatch):
    """As many rounds where the corpus is a small part of a shard as where it is several."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lex = lm.lexicon(lm.token_counts(d))
    rows, rounds, averaged = lm.encoded(d, lex), [], lm._averaged

    def counted(sums, first, parts):
        rounds.append(parts)
        return averaged(sums, first, parts)

    monkeypatch.setattr(lm, "_averaged", counted)
    lm.trained(rows, lex)
    small = len(rounds)
    monkeypatch.setattr(lm, "SHARD", lex.tokens // 4)
    lm.trained(rows, lex)
    assert small == len(lm.ROUNDS) and len(rounds) == 2 * small and max(rounds) > 1


@pytest.mark.parametrize("known", [3000, 0])
def test_lm_of_one_long_text(spark, monkeypatch, known):
    """More words than the model's have a higher count than the end."""
    monkeypatch.setattr(lm, "KNOWN", known)
    words = [f"w{i}" for i in range(4000)] * 2
    d = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    assert zlib.crc32(b"1") % 10
    lex = lm.lexicon(lm.token_counts(d), known=known)
    assert lex.symbols[lex.index[lm.END]] < lex.words and lex.counts[lex.index[lm.END]] == 1
    r = lm.lm_scores(d).first()
    v = 4001
    assert r["n_tokens"] == r["n_known"] == 8001 and np.isfinite(r["score"])
    assert r["base_score"] == pytest.approx(sum(np.log10((c + 0.1) / (8001 + 0.1 * (v + 1))) for c in [1] + [2] * 8000), rel=1e-9)


def test_lm_scores_by_definition(spark, monkeypatch):
    """Scores from the parameters alone: both softmaxes written out over all symbols and all words of a class."""
    monkeypatch.setattr(lm, "KNOWN", 6000)
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = lm.token_counts(d)
    lex = lm.lexicon(counts, known=6000)
    assert lex.tail > 2000 and lex.distinct > lex.tail + lex.words + 1000  # some words are joined
    m = lm.trained(lm.encoded(d, lex), lex)
    count = {r["token"].encode(): r["c"] for r in counts.collect()}
    once, tokens = Counter(), Counter()
    head = set(list(lex.index)[: lex.words])
    for w, c in count.items():
        if w not in head:
            tokens[lm.shape(w)] += c
            once[lm.shape(w)] += c == 1
    members = {c: [] for c in range(lm.SHAPES)}
    for w, i in lex.index.items():
        if i >= lex.words:
            members[lm.shape(w)].append(w)
    places = {c: np.array([lex.index[x] - lex.words for x in members[c]], int) for c in members}
    unknown = {c: min(max(once[c], 0.1) / tokens[c], 1 - 1e-9) if tokens[c] else 1.0 for c in range(lm.SHAPES)}

    def probability(w, one, two, last):
        r = m.context[one] * m.place[0] + m.context[two] * m.place[1]
        z = np.exp((m.target @ r + m.bias).astype(float))
        i = lex.index.get(w, -1)
        if 0 <= i < lex.words:
            return z[i] / z.sum(), i
        c = lm.shape(w)
        p = z[lex.words + c] / z.sum()
        if i < 0:
            return p * ((1 - unknown[c]) * count[w] / tokens[c] if w in count else unknown[c]), lex.words + c
        inner = np.exp((m.inner[places[c]] @ m.last[last] + m.inner_bias[places[c]]).astype(float))
        own = np.exp(float(m.inner[i - lex.words] @ m.last[last] + m.inner_bias[i - lex.words]))
        return p * known(c) * own / inner.sum(), lex.words + c

    def known(c):
        return (1 - unknown[c]) * sum(count[x] for x in members[c]) / tokens[c]

    got = {r["doc_id"]: r["score"] for r in lm.lm_scores(d).collect()}
    for r in [r for r in d.collect() if len(r["text"] or "") < 2500][::20]:
        one = two = lex.size
        last, total = lex.words, 0.0
        for w in [*(r["text"] or "").encode().lower().split(), b""]:
            p, s = probability(w, one, two, last)
            total += np.log10(p)
            one, two, last = s, one, s if s < lex.words else last
        assert got[r["doc_id"]] == pytest.approx(total, rel=1e-4)
    # All words and the unknown symbols of the classes come to 1: within a class its known words (whose softmax does),
    # the others by their counts, and the unknown symbol.
    for c in range(lm.SHAPES):
        if tokens[c]:
            others = sum(n for w, n in count.items() if lm.shape(w) == c and w not in head and w not in lex.index)
            assert known(c) + (1 - unknown[c]) * others / tokens[c] + unknown[c] == pytest.approx(1)
    z = np.exp((m.target @ (m.context[3] * m.place[0] + m.context[5] * m.place[1]) + m.bias).astype(float))
    one, two, norm = m.tables()
    assert z.sum() == pytest.approx(np.exp(norm[3, 5]), rel=1e-4) and one.shape == two.shape == (lex.size + 1, lex.size)


def payloads():
    r = np.random.default_rng(1)
    some = [r.integers(0, 256, 64 * n, dtype=np.uint8).tobytes() for n in (1, 2, 3, 10, 50, 257)]  # all bytes, FF too
    runs = (b"\x80" * 20 + b"a" + b"\x80" * 43) * 7  # runs of zeros, ends of blocks
    return [*some, bytes(64), b"\x80" * 640, runs, b"\xff" * 128, media.padded("plain words, ünd more. " * 40)[0]]


def slow_blocks(p):
    """The coefficients of a file of one component, bit by bit."""
    _, dc, ac = p["scan_components"][0]
    codes = [{(n, c): s for s, c, n in p["huffman"][k].listed()} for k in (dc, 16 + ac)]
    out = []
    for part in re.split(rb"\xff[\xd0-\xd7]", p["scan"]):
        bits, at, before = "".join(f"{b:08b}" for b in part.replace(b"\xff\x00", b"\xff")), 0, 0
        for _ in range(min(p["restart"], p["width"] * p["height"] // 64 - len(out))):
            block, k = [0] * 64, 0
            while k < 64:
                n = next(n for n in range(1, 17) if (n, int(bits[at : at + n], 2)) in codes[k > 0])
                symbol = codes[k > 0][n, int(bits[at : at + n], 2)]
                at += n
                size, run = symbol & 15, symbol >> 4
                v = int(bits[at : at + size] or "0", 2)
                at += size
                v = v if not size or v >> (size - 1) else v - (1 << size) + 1
                if k == 0:
                    before += v
                    block[0] = before
                elif symbol == 0:
                    break
                else:
                    k += run
                    block[k] = v
                k += 1
            out.append(block)
    return np.array(out)


def test_jpeg_round_trip():
    parsed = [media.parse(x) for x in media.encode_payloads(payloads())]
    for want, p, c in zip(payloads(), parsed, media.decoded(parsed), strict=True):
        assert media.payload_of(p, c) == want and p["width"] == 8 * c.shape[1]
        assert (slow_blocks(p) == c.reshape(-1, 64)).all()
        assert (media.decode(media.encode_payloads([want])[0])[1] == c).all()  # alone as in a group


def test_media_rows(spark):
    """The query's columns, each computed by itself."""
    texts = [None, "", "a", "x" * 64, "Grüße 😀 " * 500, "same", "same"]
    got = {r["doc_id"]: r for r in media.media_features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = media.encode_payloads([payload])[0]
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        p = media.parse(stored)
        thumb = np.clip(128 + slow_blocks(p)[:, 0].reshape(p["height"] // 8, p["width"] // 8) / 8, 0, 255)
        assert r["feature"] == f"{p['width']}x{p['height']}:{media.thumbnail_hash(thumb)}:{zlib.crc32(np.rint(thumb * 8).astype(np.uint16).tobytes()):08x}"
    assert got[5]["media_sha256"] == got[6]["media_sha256"]


def test_every_byte_moves_the_thumbnail():
    text = "some words of a text that fills a block of the file and a bit more of it all, twice or so."
    look = lambda t: media.feature(*media.decode(media.encode_payloads([media.padded(t)[0]])[0]))
    assert all(look(text[:i] + chr(ord(text[i]) ^ 16) + text[i + 1 :]) != look(text) for i in range(len(text)))


def test_huffman_codes_are_prefix_free_and_leave_ones():
    for t in media.tables():
        codes = [f"{c:0{n}b}" for _, c, n in t.listed()]
        assert not any(a != b and b.startswith(a) for a in codes for b in codes) and all("0" in c for c in codes)


def test_general_baseline_decoder():
    """A file with longer codes, runs, end-of-block codes and differences, encoded here bit by bit."""
    dc, ac = (bytes([0, 2, 1] + [0] * 13), bytes([0, 3, 5])), (bytes([0, 2, 1] + [0] * 13), bytes([0x00, 0x12, 0xF0]))
    code = lambda t, s: {t[1][0]: "00", t[1][1]: "01", t[1][2]: "100"}[s]
    bits = code(dc, 5) + "11000" + code(ac, 0x12) + "10" + code(ac, 0x00)  # DC 24; one zero, then 2; end
    bits += code(dc, 3) + "011" + code(ac, 0xF0) + code(ac, 0x12) + "01" + code(ac, 0x00)  # DC 24 - 4; 16 zeros, one zero, then -2
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = media._segment
    data = (
        bytes((0xFF, media.SOI)) + seg(media.DQT, b"\x00" + bytes([16] * 64)) + seg(media.SOF0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
        + seg(media.DHT, b"\x00" + dc[0] + dc[1]) + seg(media.DHT, b"\x10" + ac[0] + ac[1]) + seg(media.SOS, bytes((1, 1, 0, 0, 63, 0))) + scan + bytes((0xFF, media.EOI))
    )
    p, c = media.decode(data)
    assert c.shape == (1, 2, 64) and c[0, 0, 0] == 24 and c[0, 0, 2] == 2 and c[0, 1, 0] == 20 and c[0, 1, 18] == -2
    assert media.thumbnail(p, c).tolist() == [[128 + 24 * 2, 128 + 20 * 2]]


def test_zigzag():
    assert media.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(media.zigzag()) == list(range(64))
