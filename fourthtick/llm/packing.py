"""Packing documents into token sequences by vector best fit.

A sequence has three capacities: tokens, documents and attention cost (the sum of
squared piece lengths). Pieces of equal length are interchangeable, so best fit
decreasing runs on the histogram of lengths, which has at most ``max_tokens``
entries however large the corpus is, and on classes of equally filled sequences.
The plan it returns says, per length, which ranks of pieces go to which sequences;
every piece then looks up its place in parallel.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fourthtick.llm.common import documents_of, released, small_batches
from fourthtick.sources.storage import stage

MAX_TOKENS = 4096
END_ID = 1
SALTS = 64
#: Runs kept at least; twice as many at most, which is about 30 MB.
CHUNKS_KEPT = 100_000
#: Letters up to this one are single characters in every normal form that the tokenizer makes.
LAST_LATIN = "\u024f"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> str:
    """The character that stands for each byte in the vocabulary: itself where it can be seen."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return "".join(chr(b if b in seen else next(others)) for b in range(256))


_BYTE_LETTERS = _byte_letters()


class Encoder:
    """Token ids of a text as little-endian 32-bit bytes, remembered run by run.

    This vocabulary never joins tokens across white space or across the pieces of
    its splitting pattern, so ids of runs can be kept and put together. Texts whose
    normalisation is not per character go to the tokenizer whole. Of the runs seen,
    those since the last ``CHUNKS_KEPT`` new ones stay: what is frequent is never forgotten.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def direct(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def letters(self, word: str) -> bytes:
        """A word of Latin letters in lower case is one piece, which the model takes as it is."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        ids = [token.id for token in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def chunk(self, chunk: str) -> bytes:
        """A run without white space."""
        if (ids := self.chunks.get(chunk)) is None:
            if (ids := self.older.get(chunk)) is None:
                ids = self._cut(chunk)
            if len(self.chunks) >= CHUNKS_KEPT:
                self.older, self.chunks = self.chunks, {}
            self.chunks[chunk] = ids
        return ids

    def _cut(self, chunk: str) -> bytes:
        """Letters are cut off only where that is certain to be a cut."""
        letters = len(chunk)
        while letters and not chunk[letters - 1].isalpha():
            letters -= 1
        head = chunk[:letters]
        if not head.isalpha():
            return self.direct(chunk)
        if letters == len(chunk):
            return self.letters(chunk) if max(chunk) <= LAST_LATIN else self.direct(chunk)
        if "'" in chunk or "<" in chunk:
            return self.direct(chunk)
        return self.chunk(head) + self.chunk(chunk[letters:])

    def encode(self, text: str) -> bytes:
        lower = text.lower()
        if (
            "Σ" in text
            or not unicodedata.is_normalized("NFC", text)
            or not unicodedata.is_normalized("NFC", lower)
            or "<|" in text
            or _ODD_SPACE.search(text)
        ):
            return self.direct(text)
        found = self.chunks.get
        chunks = lower.split()
        parts = [found(c) for c in chunks]
        if None in parts:
            parts = [p if p is not None else self.chunk(c) for c, p in zip(chunks, parts, strict=True)]
        return b"".join(parts)


# Control characters that count as white space for one of str.split and \s but not the other.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85]")


@cache
def encoder(path: str) -> Encoder:
    """One encoder per Python worker, kept between tasks."""
    return Encoder(path)


def tokenize_pieces(
    docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID
) -> DataFrame:
    """Pieces of each document's token ids: doc_id, piece, start, length, ids_crc32.

    A document's ids end with ``end_id``; null text counts as empty, so every
    document has a piece. Longer ones are cut every ``max_tokens`` ids.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        width = 4 * max_tokens
        for batch in released(batches):
            ids, number, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encode(text.as_py() or "") + struct.pack("<I", end_id)
                for k, at in enumerate(range(0, len(data), width)):
                    part = data[at : at + width]
                    ids.append(doc_id)
                    number.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return documents_of(docs, "doc_id", "text").mapInArrow(pieces, PIECES)


def best_fit_plan(
    histogram: dict[int, int],
    max_tokens: int = MAX_TOKENS,
    max_documents: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3),
    score: str = "norm",
) -> list[tuple[int, int, int, int, int, int]]:
    """Vector best fit decreasing over (length, how many pieces have it).

    Returns rows (length, first rank, end rank, first sequence, pieces of this
    length per sequence, offset of the first). Of the sequences with room in every
    capacity, ``score`` picks by the smallest weighted norm of what would be left
    ("norm") or the largest weighted dot product of piece and room ("dot"); the
    rest of a piece's kind goes on filling the sequence it has just entered. A new
    sequence is opened only when none has room. Pieces must fit an empty sequence.
    """
    capacity = np.array(
        [
            max_tokens,
            max_tokens if max_documents is None else max_documents,
            max_tokens**2 if max_attention is None else max_attention,
        ],
        dtype=np.int64,
    )
    weight = np.array(weights)
    room = np.empty((64, 3), dtype=np.int64)
    count = np.zeros(64, dtype=np.int64)
    first = np.zeros(64, dtype=np.int64)
    used = opened = 0
    plan = []

    def add(left: np.ndarray, n: int, start: int) -> None:
        nonlocal room, count, first, used
        if used == len(count):  # forget full and empty classes before growing
            alive = np.flatnonzero((count > 0) & (room > 0).all(axis=1))
            room[: len(alive)], count[: len(alive)], first[: len(alive)] = (
                room[alive],
                count[alive],
                first[alive],
            )
            used = len(alive)
            count[used:] = 0
            if used > len(count) // 2:
                room = np.concatenate([room, np.empty_like(room)])
                count = np.concatenate([count, np.zeros_like(count)])
                first = np.concatenate([first, np.zeros_like(first)])
        room[used], count[used], first[used] = left, n, start
        used += 1

    for length in sorted(histogram, reverse=True):
        need = np.array([length, 1, length**2], dtype=np.int64)
        if (need > capacity).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        left, rank = histogram[length], 0
        while left:
            fits = np.flatnonzero((room[:used] >= need).all(axis=1) & (count[:used] > 0))
            if len(fits):
                if score == "dot":
                    value = -((room[fits] / capacity) * (need / capacity) * weight).sum(axis=1)
                else:
                    value = ((((room[fits] - need) / capacity) ** 2) * weight).sum(axis=1)
                at = fits[np.argmin(value)]
                have, n, start = room[at].copy(), int(count[at]), int(first[at])
                offset = max_tokens - int(have[0])
            else:
                at, have, start, offset = None, capacity, opened, 0
                n = left
            per = int((have // need).min())
            whole = min(n, left // per)
            if whole:
                plan.append((length, rank, rank + whole * per, start, per, offset))
                rank, left = rank + whole * per, left - whole * per
            rest = min(left, per) if whole < n and left < per else 0
            if rest:
                plan.append((length, rank, rank + rest, start + whole, rest, offset))
                rank, left = rank + rest, left - rest
            taken = whole + bool(rest)
            if at is None:
                opened += taken
            else:
                count[at], first[at] = n - taken, start + taken
            if whole:
                add(have - per * need, whole, start)
            if rest:
                add(have - rest * need, 1, start + whole)
    return plan


def pack_pieces(
    pieces: DataFrame,
    max_tokens: int = MAX_TOKENS,
    max_documents: int | None = None,
    max_attention: int | None = None,
    score: str = "norm",
) -> DataFrame:
    """``pieces`` (as from ``tokenize_pieces``) with sequence_id and offset.

    Sequences are filled without gaps from offset 0. The pieces are read twice
    (histogram, places), so they are staged first. Pieces of one length are ranked
    in salted groups, so a length that many documents share is no single task.
    """
    spark = pieces.sparkSession
    pieces = stage(pieces, "pieces").withColumn(
        "_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SALTS))
    )
    counts = stage(
        pieces.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "piece-lengths"
    )
    # At most max_tokens rows, whatever the number of pieces.
    lengths = counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()
    plan: dict[int, list] = {}
    for length, *place in best_fit_plan(
        {r["length"]: r["n"] for r in lengths}, max_tokens, max_documents, max_attention, score=score
    ):
        plan.setdefault(length, []).append(place)
    places = spark.createDataFrame(
        list(plan.items()),
        "length long, _places array<struct<lo:long,hi:long,first:long,per:long,offset:long>>",
    )
    before = Window.partitionBy("length").orderBy("_salt")
    starts = counts.select(
        "length", "_salt", (F.sum("_n").over(before) - F.col("_n")).alias("_start")
    )
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        pieces.withColumn("_row", F.row_number().over(within))
        .join(starts, ["length", "_salt"])
        .withColumn("_rank", F.col("_start") + F.col("_row") - 1)
    )
    rank = F.col("_rank")
    placed = ranked.join(F.broadcast(places), "length").withColumn(
        "_at", F.filter("_places", lambda p: (p["lo"] <= rank) & (rank < p["hi"]))[0]
    )
    nth = rank - F.col("_at.lo")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("_at.first") + F.floor(nth / F.col("_at.per"))).cast("long").alias("sequence_id"),
        (F.col("_at.offset") + (nth % F.col("_at.per")) * F.col("length"))
        .cast("long")
        .alias("offset"),
    )


def pack_documents(
    docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, **limits
) -> DataFrame:
    """Tokenise whole texts, cut only what is longer than a sequence, and pack.

    Null texts are empty documents of one token (the end id); repeated rows are
    packed as often as they occur; an empty table gives no rows. Only doc_id and
    text are read of the input.
    """
    with small_batches(docs.sparkSession):
        return pack_pieces(
            tokenize_pieces(docs, tokenizer_path, max_tokens, end_id), max_tokens, **limits
        )
