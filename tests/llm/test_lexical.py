import math
import random
import re
from collections import Counter

from conftest import DOCS

from fourthtick.llm import lexical

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(FOLD))


def brute(docs, items, top=50):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, b, b.total()) for i, b in bags if b]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, b, _ in held for t in b)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in wanted.items():
        scored = []
        for i, bag, n in held:
            m = 50 + 50 * n * n_docs // length
            score = 0
            for t in words & bag.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for k, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1):
            out.append((item, k, i, -s))
    return sorted(out, key=repr)


def rows_of(frame):
    assert frame.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def corpus(seed, n):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "ünd", "10", "Ab"]
    docs = [(i, " ".join(draw.choices(words, k=draw.randrange(1, 40)))) for i in range(n)]
    # Copies, also with other words around them that no item asks for, and one class beyond a list.
    docs += [(n + i, docs[i % 7][1].upper() if i % 2 else docs[i % 7][1]) for i in range(90)]
    docs += [(5000 + i, "w1 w2 w3") for i in range(70)] + [(0, "w1"), (0, "w1"), (None, "w1 w2 w3")]
    items = [(i, " ".join(draw.choices(words[:24], k=draw.randrange(12)))) for i in range(20)]
    return docs, items + [(3, "w5 w6"), (None, "w1, W1; w2"), (77, None), (78, "unheard of")]


def test_matches_brute_force(spark):
    docs, items = corpus(1, 300)
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    right = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(lexical.search(left, right)) == brute(docs, items)


def test_blocks_of_items_and_steps_within_a_task(spark, monkeypatch):
    monkeypatch.setattr(lexical, "_PAIRS", 50)
    monkeypatch.setattr(lexical, "_HELD", 20)
    docs, items = corpus(2, 150)
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(lexical.search(left, right, top=3, block_pairs=30)) == brute(docs, items, 3)


def test_odd_rows_and_clashing_columns(spark, docs, no_docs):
    items = [(1, "quick brown FOX", 1), (2, "one word977 word3", 2), (3, "renard rivière çødé", 3), (4, "", 4)]
    right = spark.createDataFrame(items, "item_id long, text string, number int")
    got = rows_of(lexical.search(docs.withColumn("h", docs["doc_id"]), right))
    assert got == brute([d[:2] for d in DOCS], [i[:2] for i in items])
    assert got
    assert rows_of(lexical.search(no_docs, right)) == []
    assert rows_of(lexical.search(docs, right.limit(0))) == []
    assert rows_of(lexical.search(docs, right.where("item_id = 4"))) == []


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical, "_PIECE", 10)
    text = "alpha  beta,gamma " * 9 + "x" * 50 + " end"
    pieces = list(lexical.term_lists(text.encode()))
    assert len(pieces) > 3
    assert [t.decode() for p in pieces for t in p] == terms(text)


def test_equal_bags_are_one_class(spark):
    rows = [(1, "a b b c"), (2, "b a c b"), (3, "A, b: b! z"), (4, "a b"), (5, "q r s t")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bags = lexical.bags_of(frame, {b"a": 0, b"b": 1})
    classes = lexical.classes_of(bags, 5, 18).groupBy("h", "m", "bag").count()
    assert sorted(r["count"] for r in classes.collect()) == [1, 3]
