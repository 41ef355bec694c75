import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from conftest import DOCS
from tokenizers import Tokenizer

from fourthtick.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_remembered_words_give_the_same_ids(tokenizer):
    draw = random.Random(2)
    parts = ["The", "it's", "don't", "ÉCOLE", "straße", "###", "a1b2", "9", "!!", "'ll", "Σίσυφος", "İ",
             "́", "é", " ", "\x1c", "\n\t", "<|endoftext|>", "<|x", "日本", "😀", "'s'", "ǅ", "ﬁ"]
    encoder = packing.Encoder(PATH)
    for _ in range(3000):
        text = "".join(draw.choice(parts) + draw.choice(["", " ", "  "]) for _ in range(8))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == struct.pack(f"<{len(ids)}I", *ids), text


def test_every_latin_letter_has_the_ids_of_the_tokenizer(tokenizer):
    encoder = packing.Encoder(PATH)
    letters = sorted({c for k in range(ord(packing.LAST_LATIN) + 9) for c in chr(k).lower() if c.isalpha()})
    draw = random.Random(5)
    words = [*letters, *(c + d for c in letters for d in "aß" + letters[-10])]
    words += ["".join(draw.choices(letters, k=draw.randrange(3, 30))) for _ in range(4000)]
    words += ["".join(draw.choices("etaoinshr", k=draw.randrange(1, 400))) for _ in range(500)]
    for word in words:
        ids = tokenizer.encode(word, add_special_tokens=False).ids
        assert encoder.encode(word) == struct.pack(f"<{len(ids)}I", *ids), word


def test_frequent_runs_are_cut_once_however_many_follow(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CHUNKS_KEPT", 20)
    encoder, calls = packing.Encoder(PATH), []
    cut = encoder._cut
    monkeypatch.setattr(encoder, "_cut", lambda chunk: calls.append(chunk) or cut(chunk))
    text = " ".join(f"often, rare{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400))
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert b"".join(encoder.encode(t) for t in text.split(" ")) == struct.pack(f"<{len(ids)}I", *ids)
    assert calls.count("often,") == calls.count("often") == 1
    assert len(encoder.chunks) <= 20 and len(encoder.older) <= 20


def places(plan):
    """sequence -> [(offset, length)] of a plan."""
    bins = defaultdict(list)
    for length, lo, hi, first, per, offset in plan:
        for n in range(hi - lo):
            bins[first + n // per].append((offset + n % per * length, length))
    return bins


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(100, None, None), (100, 4, None), (100, 7, 4000)])
def test_plan_keeps_every_capacity(score, limits):
    draw = random.Random(str((score, limits)))
    tokens, documents, attention = limits
    top = 100 if attention is None else 63
    for _ in range(15):
        histogram = {draw.randint(1, top): draw.randint(1, 60) for _ in range(draw.randint(1, 25))}
        plan = packing.best_fit_plan(histogram, tokens, documents, attention, score=score)
        seen = defaultdict(int)
        for length, lo, hi, *_ in plan:
            assert lo == seen[length]
            seen[length] = hi
        assert dict(seen) == histogram
        bins = places(plan)
        assert sorted(bins) == list(range(len(bins)))
        for pieces in bins.values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end
                end += length
            assert end <= tokens and len(pieces) <= (documents or tokens)
            assert sum(n * n for _, n in pieces) <= (attention or tokens**2)
        if limits == (100, None, None) and score == "norm":
            used = sum(length * n for length, n in histogram.items())
            assert len(bins) <= 11 / 9 * -(-used // 100) + 1 or len(bins) <= sum(
                n for length, n in histogram.items() if length > 50
            )


def test_too_long_a_piece_is_refused():
    with pytest.raises(ValueError):
        packing.best_fit_plan({11: 1}, 10)


def test_packs_whole_documents(spark, docs, no_docs, tokenizer):
    rows = packing.pack_documents(docs, PATH, max_tokens=512).collect()
    expected = []
    for doc_id, text, *_ in DOCS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            expected.append((doc_id, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r[:5]) for r in rows], key=key) == sorted(expected, key=key)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 512
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // 512) + 1
    assert packing.pack_documents(no_docs, PATH).count() == 0


def test_every_limit_binds_in_the_limited_query(spark):
    from collections import defaultdict

    from fourthtick.llm.queries import op6_limited_packing

    rows = op6_limited_packing(spark, "/root/testdata/sf0.01").collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    tokens = [sum(n for _, n in s) for s in sequences.values()]
    counts = [len(s) for s in sequences.values()]
    costs = [sum(n * n for _, n in s) for s in sequences.values()]
    assert max(tokens) <= 4096 and max(counts) <= 8 and max(costs) <= 5_000_000
    assert max(tokens) > 4000 and max(counts) == 8 and max(costs) > 4_500_000
    # Tokens alone would need far fewer sequences than documents and attention allow.
    assert sum(t < 3500 for t in tokens) > len(tokens) / 4
    for s in sequences.values():
        places = sorted(s)
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
