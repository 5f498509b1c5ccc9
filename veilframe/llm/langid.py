"""Language identification: known words first, then ever shorter character n-grams.

A known word is scored by its smoothed log frequency in each language. A word
that was not learned falls back to its longest character n-grams that were
learned; if none of that length is known, to the next shorter length. Each
word's scores are taken relative to their mean over languages, so that all
words weigh by the evidence they carry.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, written

#: Documents learned from at most (in expectation), and words and n-grams kept. Bounds of the model, not of what is classified.
SAMPLE, WORDS, GRAMS = 20_000, 60_000, 60_000
LONGEST = 4
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; digits of any script and number signs are no letters."""
    found = _LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def grams_of(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text is divisible by 5; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _count(batches):
    words: Counter = Counter()
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            words.update((lang, w) for w in words_of(text))
    grams: Counter = Counter()
    for (lang, w), c in words.items():
        for n in range(1, LONGEST + 1):
            for g in grams_of(w, n):
                grams[lang, n, g] += c
    rows = [(lang, 0, w, c) for (lang, w), c in words.items()] + [(*k, c) for k, c in grams.items()]
    for i in range(0, len(rows), 50_000):
        lang, n, g, c = zip(*rows[i : i + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(n, pa.int32()), pa.array(g), pa.array(c, pa.int64())], names=["lang", "n", "gram", "c"])


class Model:
    """Scores of words and n-grams for each language: a row of a matrix for each."""

    def __init__(self, langs: list[str], words: tuple[list[str], np.ndarray], grams: tuple[list[str], np.ndarray]):
        self.langs = langs
        self.words, self.word_scores = {w: i for i, w in enumerate(words[0])}, words[1]
        self.grams, self.gram_scores = {g: i for i, g in enumerate(grams[0])}, grams[1]

    def word(self, w: str) -> np.ndarray:
        if (found := self.words.get(w)) is not None:
            return self.word_scores[found]
        get = self.grams.get
        for n in range(LONGEST, 0, -1):
            if known := [i for g in grams_of(w, n) if (i := get(f"{n}{g}")) is not None]:
                return self.gram_scores[known].sum(0) / len(known)
        return np.zeros(len(self.langs))


def fit(docs: DataFrame, sample: int = SAMPLE, words: int = WORDS, grams: int = GRAMS) -> Model | None:
    """Learn from the labelled documents that are not held out; None if there are none.

    The sample is drawn by a hash of doc_id; where the labelled documents are
    fewer than sample, all are used. What reaches the driver is bounded by words
    and grams.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    n = labelled.count()
    if n > sample:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    langs = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())
    if not langs:
        return None
    counts = labelled.select("lang", "text").mapInArrow(_count, "lang string, n int, gram string, c long")
    place = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1
    by = counts.groupBy("n", "gram", place.alias("lang")).agg(F.sum("c").alias("c")).groupBy("n", "gram").agg(F.sum("c").alias("total"), F.collect_list(F.struct("lang", "c")).alias("by"))
    by = written(by, "counts")

    def scores(cond, k):
        # as Arrow columns: rows of Python objects would be several times as large
        top = by.where(cond).orderBy(F.desc("total"), "n", "gram").limit(k).select("n", "gram", F.col("by.lang").alias("lang"), F.col("by.c").alias("c")).toArrow().combine_chunks()
        n, lang, c = (top.column(x).combine_chunks() for x in ("n", "lang", "c"))
        v = np.full((top.num_rows, len(langs)), 0.1)
        row = np.repeat(np.arange(top.num_rows), np.diff(lang.offsets.to_numpy()))
        v[row, lang.flatten().to_numpy().astype(np.int64)] += c.flatten().to_numpy()
        n = n.to_numpy()
        for own in np.unique(n):
            v[n == own] /= v[n == own].sum(0)
        v = np.log(v)
        return [g if not m else f"{m}{g}" for m, g in zip(n.tolist(), top.column("gram").to_pylist(), strict=True)], (v - v.mean(1, keepdims=True)).astype(np.float32)

    return Model(langs, scores(F.col("n") == 0, words), scores(F.col("n") > 0, grams))


def _predictor(shared, most: int = 400_000):
    def run(batches):
        model = shared.value
        k = len(model.langs)
        table = np.zeros((1 << 14, k), np.float32)
        index: dict[str, int] = {}

        def learned(ws):
            """Rows of the table for ws, with new ones for words not seen before."""
            nonlocal table
            if new := [w for w in set(ws) if w not in index]:
                if len(index) + len(new) > most:
                    index.clear()
                    new = list(set(ws))
                while len(index) + len(new) > len(table):
                    table = np.concatenate([table, np.zeros_like(table)])
                for w in new:
                    table[len(index)] = model.word(w)
                    index[w] = len(index)
            return table[np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))]

        for b in batches:
            langs, scores = [], []
            for text in b.column("text"):
                ws = words_of(text.as_py()) if text.is_valid else []
                if not ws:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                total = np.zeros(k)
                for i in range(0, len(ws), 50_000):
                    total += learned(ws[i : i + 50_000]).sum(0, dtype=np.float64)
                p = np.exp(total - total.max())
                best = int(total.argmax())
                langs.append(model.langs[best])
                scores.append(float(p[best] / p.sum()))
            kept = [b.column(i) for i in range(b.num_columns - 1)]
            names = b.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return run


def predict(texts: DataFrame, model: Model | None) -> DataFrame:
    """texts has a column text, and any others, which are kept; adds lang_pred and score.

    'und' with score 0 if the text is null or holds no letter, or nothing was learned.
    """
    others = [c for c in texts.columns if c != "text"]
    if model is None:
        return texts.select(*others, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    spark = texts.sparkSession
    shared = Shared(spark, model)  # bounded by WORDS and GRAMS
    ordered = texts.select(*others, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema if f.name != "text")
    return ordered.mapInArrow(_predictor(shared), f"{fields + ', ' if fields else ''}lang_pred string, score double")
