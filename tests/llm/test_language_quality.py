import math
import zlib

import pytest
from conftest import DOCS

from fourthtick.llm import common, language, quality
from fourthtick.llm.common import read_table

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_languages(spark):
    docs = read_table(spark, SF_DIR, "documents")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = language.identify_languages(docs).collect()
    held_out = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held_out} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    right = sum(truth[r["doc_id"]] == r["lang_pred"] for r in held_out)
    assert right / len(held_out) >= 0.98


def test_backs_off_to_shorter_grams(spark):
    rows = [(i, "the thing with that", "en") for i in range(20)]
    rows += [(100 + i, "der und über größe", "de") for i in range(20)]
    model = language.fit_language_model(
        spark.createDataFrame(rows, "doc_id long, text string, lang string")
    )
    assert model.predict("the")[0] == "en" and model.predict("thingwith")[0] == "en"
    assert model.predict("größer")[0] == "de" and model.predict("ß")[0] == "de"
    assert model.predict("123 ...") == ("und", 0.0) and model.predict(None) == ("und", 0.0)
    assert {model.predict(t) for t in ("½", "² ³", "Ⅷ", "1½ _")} == {("und", 0.0)}
    assert model.predict("the½thing")[0] == "en"


def test_sample_is_a_share_of_each_language(spark):
    rows = [(i, f"alpha beta {i}", "en") for i in range(2000)] + [(i, "gamma", "de") for i in range(30)]
    frame = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string")
    model = language.fit_language_model(frame, sample_per_language=200)
    # About one in ten of the numbered texts was read, each once; all of the rare language.
    assert model.languages == ["de", "en"] and {"alpha", "gamma"} <= model.words.keys()
    few = language.fit_language_model(frame.where("lang = 'en'"), sample_per_language=1)
    assert few.languages in ([], ["en"])


def test_the_model_reaches_the_driver_in_columns(spark, monkeypatch):
    rows = [(1, "alpha alpha beta", "x"), (2, "beta gamma", "y"), (3, "alpha", "y")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def refused(*_):
        raise AssertionError("a Python object for every word and n-gram")

    monkeypatch.setattr(type(labelled), "collect", refused)
    model = language.fit_language_model(labelled)
    assert model.languages == ["x", "y"] and set(model.words) == {"alpha", "beta", "gamma"}
    for word, times in (("alpha", (2.5, 1.5)), ("beta", (1.5, 1.5)), ("gamma", (0.5, 1.5))):
        expected = [math.log(t / 4.5) for t in times]
        assert model.word_scores[model.words[word]].tolist() == pytest.approx(expected)


def test_language_edge_cases(spark, docs, no_docs):
    rows = language.identify_languages(docs).collect()
    assert len(rows) == len(DOCS)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[4]["lang_pred"] == by_id[5]["lang_pred"] == by_id[11]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language.identify_languages(no_docs).count() == 0
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {4, 5, 11}.isdisjoint({r["doc_id"] for r in kept.collect()})
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) AS lang")
    assert {r["lang_pred"] for r in language.identify_languages(unlabelled).collect()} == {"und"}
    assert language.keep_identified(unlabelled).count() == len([d for d in DOCS if d[1] and any(c.isalpha() for c in d[1])])


def test_whole_rows_do_not_meet_the_prediction(spark):
    """Texts go to Python once and no row waits for its answer; what is kept is read without Python."""
    english, german = "the thing with that", "der und über größe"
    rows = [(i, english, "en", "a") for i in range(20)] + [(100 + i, german, "de", "b") for i in range(20)]
    # One id with several texts, a null id and repeated rows: each row is judged by its own text.
    odd = [(1, "123 ...", "en", "c"), (1, None, None, "d"), (None, "½", "en", "e"), (None, english, "en", "f")]
    docs = spark.createDataFrame(rows + odd + odd, "doc_id long, text string, lang string, row string")

    def plan(frame):
        return frame._jdf.queryExecution().executedPlan().toString()

    predicted = plan(language.identify_languages(docs))
    assert "MapInArrow" in predicted and "EvalPython" not in predicted
    kept = language.keep_identified(docs)
    assert "InArrow" not in plan(kept) and "EvalPython" not in plan(kept)
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([*rows, odd[3], odd[3]], key=repr)


def test_workers_give_unused_memory_back(monkeypatch):
    """What tasks before and the task itself leave in the Arrow pool does not stay with the worker."""
    calls = []

    class Pool:
        def release_unused(self):
            calls.append("released")

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    batch = common.pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b"]})
    for cut in common.by_bytes(iter([batch, batch]), 0, limit=10):
        calls.append(cut.num_rows)
    assert calls == ["released", 2, 1, 2, 1, "released"]


def test_held_out_quality(spark):
    docs, labels = (read_table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.classify_quality(docs, labels).where("held_out").collect()
    known = [(r["score"], truth[r["doc_id"]]) for r in rows if r["doc_id"] in truth]
    good = [s for s, q in known if q == 1]
    bad = [s for s, q in known if q == 0]
    wins = sum((g > b) + (g == b) / 2 for g in good for b in bad)
    assert wins / (len(good) * len(bad)) >= 0.98
    assert sum((s >= 0.3) == q for s, q in known) / len(known) >= 0.95


def test_predicted_on_few_labels(spark):
    docs, labels = (read_table(spark, SF_DIR, t) for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.classify_quality(docs, labels).where("held_out").collect()
    known = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["doc_id"] in truth]
    assert sum(p == q for p, q in known) / len(known) >= 0.95
    bad = [p for p, q in known if q == 0]
    assert sum(p == 0 for p in bad) >= 0.7 * len(bad)


def test_leader_equals_the_plain_formula():
    """FTRL-proximal written out for one feature at a time."""
    import math

    import numpy as np

    draw = np.random.default_rng(4)
    examples = [
        (np.append(np.sort(draw.choice(16, 3, replace=False)), 16), np.append(draw.random(3), 1.0), float(draw.random() < 0.6))
        for _ in range(50)
    ]
    alpha, beta, l1, l2 = 0.7, 1.0, 0.05, 0.1
    z, n = [0.0] * 17, [0.0] * 17

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for index, values, label in examples:
            w = [weight(i) for i in index]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, values))))
            for i, a, v in zip(index, w, values):
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * a
                n[i] += g * g
    got = quality.follow_the_leader(examples, bits=4, epochs=3, alpha=alpha, beta=beta, l1=l1, l2=l2)
    assert np.allclose(got, [weight(i) for i in range(17)])


def test_several_leaders_count_by_their_rows(spark):
    rows = [(i, "good words" if i % 3 else "bad noise", float(i % 3 > 0)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality double")
    for shards in (1, 7):
        weights = quality.fit_quality(docs, docs, shards=shards)
        scored = quality.score_quality(docs, weights, ["doc_id"]).collect()
        assert all((r["score"] > 0.5) == (r["doc_id"] % 3 > 0) for r in scored)


def test_leader_separates_and_stays_sparse():
    bad = [quality.features(f"!! noise{i} !!") for i in range(50)]
    good = [quality.features(f"calm words number{i}") for i in range(50)]
    examples = [(*x, y) for pair in zip(bad, good, strict=True) for x, y in zip(pair, (0.0, 1.0), strict=True)]
    w = quality.follow_the_leader(examples, epochs=3)
    margin = [w[i] @ v for i, v in (quality.features("!! other !!"), quality.features("calm words here"))]
    assert margin[0] < 0 < margin[1]
    assert (w != 0).sum() < 400


def test_quality_edge_cases(spark, docs, no_docs):
    labels = spark.createDataFrame(
        [(1, 1), (1, 1), (3, 0), (None, 1), (9, None)], "doc_id long, quality int"
    )
    rows = quality.classify_quality(docs, labels).collect()
    assert len(rows) == len(DOCS)
    scores = {r["doc_id"]: r["score"] for r in rows}
    assert scores[4] == scores[5] and scores[1] == scores[2]
    none = labels.where("false")
    assert all(
        r["score"] == pytest.approx(0.5) for r in quality.classify_quality(docs, none).collect()
    )
    assert quality.classify_quality(no_docs, labels).count() == 0
