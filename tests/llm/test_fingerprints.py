import hashlib

from conftest import DOCS
from pyspark.sql import functions as F

from fourthtick.llm import fingerprints as fp


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edits_follow_the_next_document(spark):
    texts = {i * 7: f"{'word' * (i % 5)} text {i} " + "é😀z " * (i % 11) for i in range(500)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for per_bucket in (4000, 20):
        fp.ROWS_PER_BUCKET = per_bucket
        found = {r["doc_id"]: r for r in fp.fingerprint_edits(docs.repartition(4)).collect()}
        fp.ROWS_PER_BUCKET = 4000
        ids = sorted(texts)
        assert sorted(found) == ids
        for at, i in enumerate(ids):
            text, following = texts[i], texts[ids[(at + 1) % len(ids)]]
            half = len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            assert found[i]["n_chars"] == len(text)
            assert found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_likeness_estimates_jaccard(spark):
    texts = [" ".join(f"w{(i * i + j * (1 + i // 3)) % 4001}" for j in range(800)) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    errors = []
    for r in fp.fingerprint_edits(docs).collect():
        text, following = texts[r["doc_id"]], texts[(r["doc_id"] + 1) % 12]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        errors.append(abs(r["near_edited"] - jaccard(shingles(text), shingles(edited))))
        assert abs(r["near_next"] - jaccard(shingles(text), shingles(following))) < 0.12
    assert max(errors) < 0.15


def test_merge_is_the_sketch_of_the_whole(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(900))
    rows = spark.createDataFrame([(a, b)], "a string, b string")
    rows = fp.with_sketch(fp.with_sketch(rows, "a", "x"), "b", "y")
    r = rows.select(
        "x",
        "y",
        fp.merge("x", "y").alias("both"),
        fp.containment("x", fp.merge("x", "y")).alias("in_both"),
        fp.likeness("x", "y").alias("alike"),
    ).first()
    assert r["both"] == sorted({*r["x"], *r["y"]})
    assert r["in_both"] == 1.0 and r["alike"] == 0.0


def test_edge_cases(docs, no_docs):
    rows = fp.fingerprint_edits(docs).collect()
    assert len(rows) == len(DOCS)
    by_text = {}
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert by_text[1] == by_text[2] and by_text[7] == by_text[8] != {""}
    assert by_text[4] == by_text[5] == by_text[11] == {""}
    assert fp.fingerprint_edits(no_docs).count() == 0
    nameless = docs.where(F.col("doc_id").isNull())
    assert fp.fingerprint_edits(nameless).count() == 2
    assert fp.fingerprint_edits(docs.where("doc_id = 1")).first()["near_next"] == 1.0
