"""Every operator on nulls, empty and long texts, ties, repeated rows, no rows, and clashing columns."""

import pytest

import corpus_pipeline
from quire.llm import jaccard, licences, lm, media, minhash, mixing, packing, pii, quality, secrets, spelling, winnowing

LONG = "word " * 3000 + "x" * 30000 + " 1" * 3000
ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, LONG, None, None, len(LONG)), (4, "one two", "en", "b", 7), (4, "one two", "en", "b", 7), (None, "some words with no number at all", "en", None, None),
    (None, None, None, None, None), (5, "  \n\t ", "en", "a", 5), (6, "Grüße 😀 token = abcdef123 a@b.co +1 (234) 567-8901 Licensed under the MIT License.", "de", "a", 80), (7, "one two", "en", "b", 7),
]
EXTRA = ["row", "hash", "id", "size", "n", "cls", "found", "u", "key_id", "bucket", "score", "token", "part", "start", "rank", "labelled_id", "h", "quality"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
OPERATORS = {
    "lm": lambda d, l: lm.lm_scores(d), "secrets": lambda d, l: secrets.secret_spans(d), "redacted": lambda d, l: secrets.redacted(d), "jaccard": lambda d, l: jaccard.jaccard_components(d), "one_of_each": lambda d, l: jaccard.one_of_each(d),
    "quality": quality.quality_scores, "licences": lambda d, l: licences.license_spans(d), "mix": lambda d, l: mixing.mix(d), "mixed": lambda d, l: mixing.mixed_documents(d), "packing": lambda d, l: packing.packed(d),
    "pii": lambda d, l: pii.personal_spans(d), "sanitised": lambda d, l: pii.sanitised(d), "winnowing": lambda d, l: winnowing.edited_fingerprints(d), "media": lambda d, l: media.media_features(d),
    "minhash": lambda d, l: minhash.minhash_components(d), "spelling": lambda d, l: spelling.spelling_variants(d),
}
PER_ROW = {"lm", "secrets", "redacted", "jaccard", "quality", "licences", "mix", "pii", "sanitised", "winnowing", "media", "minhash"}


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    for c in EXTRA:
        d = d.withColumn(c, d.doc_id)
    return d, spark.createDataFrame([(4, 1, 0), (6, 0, 1), (9, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, name):
    out = OPERATORS[name](*odd).collect()
    if name in PER_ROW:
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, odd, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA), odd[1].limit(0)).count() == 0


def test_null_ids_and_texts(odd):
    d, _ = odd
    got = {r["doc_id"]: r for r in jaccard.jaccard_components(d).where("doc_id in (1, 2, 4, 5, 7)").collect()}
    assert got[7]["component_id"] == 4 and got[1]["n_shingles"] == got[2]["n_shingles"] == got[5]["n_shingles"] == 0
    packed = packing.packed(d).where("doc_id = 1").collect()
    assert [(r["start"], r["length"], r["doc_tokens"]) for r in packed] == [(0, 1, 1)]


def test_values_of_odd_rows(odd):
    """What each operator says of the rows without words, the long one, and repeated ones."""
    d, labels = odd
    by = lambda df: {(r["doc_id"], i): r for i, r in enumerate(sorted(df.collect(), key=str))}
    for r in lm.lm_scores(d).collect():
        assert r["n_tokens"] >= 1 and r["score"] < 0 and (r["doc_id"] not in (1, 2, 5) or r["n_tokens"] == 1)
    for df, column in ((secrets.secret_spans(d), "spans"), (licences.license_spans(d), "spans"), (pii.personal_spans(d), "spans")):
        got = {r["doc_id"]: r[column] for r in df.collect()}
        assert got[1] == got[2] == got[5] == "" and got[6] != ""
    assert {r["n_bytes"] for r in media.media_features(d).where("doc_id in (1, 2)").collect()} == {0}
    m = [r for r in mixing.mix(d).collect() if r["doc_id"] == 4]
    assert len(m) == 2 and m[0]["taken"] == m[1]["taken"] and all(r["taken"] == 0 for r in mixing.mix(d).where("doc_id in (1, 2, 5)").collect())
    s = [r["score"] for r in quality.quality_scores(d, labels).collect() if r["doc_id"] == 4]
    assert s[0] == s[1]
    w = {r["doc_id"]: r for r in winnowing.edited_fingerprints(d).collect()}
    assert w[1]["fingerprint"] == w[5]["fingerprint"] == "" and w[3]["n_chars"] == len(LONG)
    assert len(by(pii.sanitised(d))) == len(ROWS)


def test_stages_keep_columns(spark, odd, tmp_path):
    """Clashing columns go in, the columns of documents come out; no rows and odd rows end well."""
    docs, labels = odd
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for d in (spark.read.parquet(f"{tmp_path}/documents.parquet"), docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, d, str(tmp_path)).columns == corpus_pipeline.COLUMNS
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} <= {r[0] for r in ROWS} and all(r["length"] > 0 for r in rows)


def test_pipeline_against_brute_force(spark):
    """Each stage of a run over the smallest table, from its predecessor's rows."""
    import zlib
    from collections import Counter

    import numpy as np
    import public_tokenizers as public
    from tokenizers import Tokenizer

    from .test_sets_and_mixes import brute_components
    from .test_text_scans import SECRETS, brute_secrets

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality classifier"](spark, docs, sf)
    machine = quality.classifier(docs, labels)
    features = [quality.features(r["text"], r["n_chars"]) for r in rows.values()]
    want = {i for i, s in zip(rows, machine.score(features), strict=True) if s >= 0.5}
    assert {r["doc_id"] for r in good.collect()} == want and 0 < len(want)
    one = stage["n-gram Jaccard join"](spark, good, sf)
    least = {c for _, c in brute_components({i: rows[i]["text"] for i in want}).values()}
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(least)
    masked = {r["doc_id"]: r for r in stage["secret scans"](spark, one, sf).collect()}
    assert set(masked) == least
    for i, r in masked.items():
        found = brute_secrets(rows[i]["text"])
        assert r["n_chars"] == len(r["text"])
        for kind, at, end in (x.split(":") for x in found):
            assert rows[i]["text"][int(at) : int(end)] not in r["text"] or len(SECRETS) == 0
        if "[SECRET]" not in r["text"]:
            assert r["text"] == rows[i]["text"] and not found
    clean = spark.createDataFrame([tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in masked.values()], docs.select(*corpus_pipeline.COLUMNS).schema)
    mixed = stage["mixing sources"](spark, clean, sf)
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect() if r["size"] and r["copies"]})
    packed = stage["packing"](spark, mixed, sf).collect()
    tokenizer, sequences = Tokenizer.from_file(public.path("byte_bpe_50k.json")), Counter()
    seen = Counter()
    for p in packed:
        ids = np.array([*tokenizer.encode(masked[p["doc_id"]]["text"], add_special_tokens=False).ids, 1], "<u4")
        assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) and p["doc_tokens"] == len(ids)
        sequences[p["sequence_id"]] += p["length"]
        seen[p["doc_id"], p["start"]] += 1
    assert max(sequences.values()) <= 2048 and all(n == copies[i] for (i, _), n in seen.items()) and {i for i, _ in seen} == set(copies)
