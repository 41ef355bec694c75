"""Language identification by words first, backing off to ever shorter character n-grams.

A known word adds its log frequency per language. An unseen word is scored by its
longest character n-grams of which the model knows any: five letters, then four,
down to one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from fourthtick.llm.common import (
    bounded,
    by_bytes,
    crc_bucket,
    own_columns,
    released,
    small_batches,
    without_texts,
)
from fourthtick.sources.storage import stage

LONGEST = 5
#: Bounds of the fit: labelled documents per language, and words and n-grams kept per language.
SAMPLE_PER_LANGUAGE = 3000
WORDS_PER_LANGUAGE = 40_000
GRAMS_PER_LANGUAGE = 40_000
#: A document counts as at most this many independent words when its score is worked out.
EVIDENCE_WORDS = 20
UNDETERMINED = "und"
#: Text whose n-grams a task counts at once.
SAMPLE_BYTES = 1 << 20

_WORD = re.compile(r"[^\W\d_]+")
_MEMO = 100_000
_PREDICTED = StructType().add("lang_pred", StringType()).add("score", DoubleType())


def words_of(text: str) -> Counter[str]:
    """Runs of letters in lower case with their counts; numerals such as one half are no letters."""
    counts = Counter(_WORD.findall(text.lower()))
    for word in [w for w in counts if not w.isalpha()]:
        times = counts.pop(word)
        for part in "".join(c if c.isalpha() else " " for c in word).split():
            counts[part] += times
    return counts


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between marks for its start and end; marks alone are none."""
    marked = f"^{word}$"
    if n == 1:
        return list(word)
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if len(marked) >= n else []


@dataclass
class LanguageModel:
    """Log probabilities per language of words and n-grams; ``languages`` is sorted."""

    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray
    memo: dict[str, np.ndarray] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "memo": {}}

    def unseen(self, word: str) -> np.ndarray:
        """Mean n-gram scores of an unseen word at the longest length with a known one."""
        if (score := self.memo.get(word)) is None:
            score = np.zeros(len(self.languages))
            for n in range(LONGEST, 0, -1):
                if rows := [r for g in grams(word, n) if (r := self.grams.get(g)) is not None]:
                    score = self.gram_scores[rows].mean(axis=0)
                    break
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            self.memo[word] = score
        return score

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its probability; no letters or no model: undetermined, 0."""
        counts = words_of(text) if text else None
        if not counts or not self.languages:
            return UNDETERMINED, 0.0
        known, times, score, total = [], [], np.zeros(len(self.languages)), 0
        row_of = self.words.get
        for word, n in counts.items():
            total += n
            if (row := row_of(word)) is None:
                score += n * self.unseen(word)
            else:
                known.append(row)
                times.append(n)
        if known:
            score += np.array(times) @ self.word_scores[known]
        score *= min(total, EVIDENCE_WORDS) / total
        likely = np.exp(score - score.max())
        best = int(likely.argmax())
        return self.languages[best], float(likely[best] / likely.sum())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, item, count) of each batch: words have n = 0, n-grams their length."""
    for batch in by_bytes(batches, 1, SAMPLE_BYTES):
        found: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for word, times in words_of(text.as_py() or "").items():
                found[lang, 0, word] += times
                for n in range(1, LONGEST + 1):
                    for gram in grams(word, n):
                        found[lang, n, gram] += times
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.int32()),
                pa.array([k[2] for k in keys], pa.string()),
                pa.array(found.values(), pa.int64()),
            ],
            names=["lang", "n", "item", "times"],
        )


def fit_language_model(
    labelled: DataFrame,
    sample_per_language: int = SAMPLE_PER_LANGUAGE,
    words_per_language: int = WORDS_PER_LANGUAGE,
    grams_per_language: int = GRAMS_PER_LANGUAGE,
) -> LanguageModel:
    """Fit on doc_id, text, lang; rows without a language or text are left out.

    Per language about ``sample_per_language`` different documents are read, those with
    the smallest hashes of doc_id and text: of all hashes the share that gives as many
    on average, found by counting, so no text travels for it. The most frequent words
    and n-grams become the model, so what reaches the driver is bounded by these
    parameters per language.
    """
    rows = labelled.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    share = rows.groupBy("lang").agg(
        F.least(F.lit(1.0), F.lit(float(sample_per_language)) / F.count(F.lit(1))).alias("_share")
    )
    share = share.withColumnRenamed("lang", "_lang")
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("_key"))
    # The hash as a number from 0 to 1.
    place = F.col("_key") / F.lit(2.0**64) + F.lit(0.5)
    sample = (
        rows.join(bounded(stage(share, "language-shares")), F.col("lang") == F.col("_lang"))
        .where(place <= F.col("_share"))
        .dropDuplicates(["lang", "_key"])
    )
    counts = (
        sample.select("lang", "text")
        .mapInArrow(_counts, "lang string, n int, item string, times long")
        .groupBy("lang", "n", "item")
        .agg(F.sum("times").alias("times"))
    )
    often = Window.partitionBy("lang", F.col("n") == 0).orderBy(F.desc("times"), "item")
    kept = (
        counts.withColumn("_rank", F.row_number().over(often))
        .where(
            F.col("_rank")
            <= F.when(F.col("n") == 0, words_per_language).otherwise(grams_per_language)
        )
        .select("lang", "n", "item", "times")
        .toArrow()
    )
    # Columns, not rows: the driver holds no Python object for each of them but the items' texts.
    languages = sorted(pc.unique(kept["lang"]).to_pylist())
    tables: dict[bool, tuple[dict[str, int], np.ndarray]] = {}
    for is_word in (True, False):
        chosen = kept.filter(pc.equal(pc.equal(kept["n"], 0), is_word)).combine_chunks()
        items = chosen["item"].combine_chunks().dictionary_encode()
        row = items.indices.to_numpy()
        index = {item: k for k, item in enumerate(items.dictionary.to_pylist())}
        table = np.zeros((len(index), len(languages)))
        column = pc.index_in(chosen["lang"], pa.array(languages, pa.string())).to_numpy()
        table[row, column] = chosen["times"].to_numpy()
        size = np.zeros(len(index), dtype=np.int64)
        size[row] = chosen["n"].to_numpy()
        for n in set(size.tolist()):  # each length is a distribution of its own
            rows_n = size == n
            part = table[rows_n] + 0.5
            table[rows_n] = np.log(part / part.sum(axis=0))
        tables[is_word] = index, table
    return LanguageModel(languages, *tables[True], *tables[False])


def predict_language(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id by default) with lang_pred and score of every whole text.

    The text goes to Python once and does not come back; no row waits for its prediction.
    """
    rows = docs.select(*(keep or ["doc_id"]), F.col("text").alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*rows.schema.fields[:-1], *_PREDICTED.fields])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One text at a time: a batch's texts stand in memory once, as they came.
        predict_one = sent.value.predict
        for batch in released(batches):
            *kept, texts = batch.columns
            found = [predict_one(t.as_py()) for t in texts]
            lang = pa.array([f[0] for f in found], pa.string())
            score = pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*kept, lang, score], names=schema.names)

    return rows.mapInArrow(predict, schema)


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    The model learns from the documents that are not held out (crc32 of the id
    modulo 5 is 0). Null texts and texts without a letter are ``und`` with score
    0, as is everything when no document has a language. Repeated rows are each
    scored; ties go to the language first in the alphabet; other columns are not read.
    """
    docs = docs.select("doc_id", "text", "lang")
    held_out = crc_bucket() == 0
    model = fit_language_model(docs.where(~held_out))
    return predict_language(
        docs.select("doc_id", "text", held_out.alias("held_out")), model, ["doc_id", "held_out"]
    )


def keep_identified(docs: DataFrame, least_score: float = 0.4) -> DataFrame:
    """The documents, with their own columns, whose language the model can tell.

    Texts that are null or have no letter go, and so do those whose likeliest
    language has a probability under ``least_score``. If no document has a language
    to learn from, nothing can be told and only texts without a letter go. Repeated rows
    are each judged, and an empty table stays empty.
    """
    # Only keys of what goes are written: no caller's column travels to Python.
    with small_batches(docs.sparkSession):
        model = fit_language_model(docs.where(crc_bucket() != 0))
        if not model.languages:
            return docs.where(F.col("text").rlike(r"\p{L}"))
        keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
        told = predict_language(keyed, model, ["doc_id", "text_key"])
        unsure = told.where((F.col("lang_pred") == UNDETERMINED) | (F.col("score") < least_score))
        gone = stage(unsure.select("doc_id", "text_key").distinct(), "unidentified")
    return own_columns(without_texts(docs, gone), docs)
