"""Benchmark decontamination: BM25 over test items with block-max pruning.

Items are cut into parts of at most PASSAGE words and held in an inverted index
whose impacts are BM25 weights divided by the part's score against itself, so
that one threshold serves all. Parts stand in blocks; each term has its largest
impact in each block. A training document is read in overlapping passages, of one
and a half parts so that any part lies whole in one, each a query: blocks whose summed maxima stay below the threshold are skipped, in the
others the lists of the passage's terms are walked in the WAND manner. All parts
above the threshold are verified against the words around the passage: enough of
the question's and of the answer's word 5-grams must be there.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, id_key, row_tag

PASSAGE, BLOCK = 64, 4
THRESHOLD, OVERLAP, SHINGLE = 0.5, 0.5, 5
#: Parts of the items of one index; more are searched in further indexes.
SHARD = 4000
_WORDS = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence is the answer, what stands before it the question; of one sentence, its last third."""
    parts = [w for p in re.split(r"(?<=[.!?])\s+", text.strip()) if (w := words_of(p))]
    if not parts:
        return [], []
    if len(parts) == 1:
        cut = max(1, len(parts[0]) * 2 // 3)
        return parts[0][:cut], parts[0][cut:]
    return [w for p in parts[:-1] for w in p], parts[-1]


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    if not words:
        return set()
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


class Index:
    def __init__(self, items: list[tuple[int, str]], k1: float = 1.2, b: float = 0.75):
        self.checks = {i: tuple(shingles(x) for x in question_and_answer(t)) for i, t in items}
        self.lengths = {i: len(words_of(t)) for i, t in items}
        parts = [(i, w[j : j + PASSAGE]) for i, t in items if (w := words_of(t)) for j in range(0, len(w), PASSAGE)]
        df = Counter(t for _, w in parts for t in set(w))
        mean = sum(len(w) for _, w in parts) / max(1, len(parts))
        self.items = [i for i, _ in parts]
        self.terms = {t: n for n, t in enumerate(sorted(df))}
        idf = {t: np.log1p((len(parts) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
        self.blocks = -(-len(parts) // BLOCK)
        self.block_max = np.zeros((len(df) + 1, self.blocks), np.float32)
        self.lists: list[list[tuple[int, float]]] = [[] for _ in df]
        for p, (_, w) in enumerate(parts):
            tf = Counter(w)
            score = {t: idf[t] * n * (k1 + 1) / (n + k1 * (1 - b + b * len(w) / mean)) for t, n in tf.items()}
            whole = sum(score.values())
            for t, s in score.items():
                n = self.terms[t]
                self.lists[n].append((p, s / whole))
                self.block_max[n, p // BLOCK] = max(self.block_max[n, p // BLOCK], s / whole)

    def wand(self, terms: list[int], block: int, threshold: float) -> list[int]:
        """Parts of the block whose summed impacts over terms reach the threshold."""
        low, high = block * BLOCK, (block + 1) * BLOCK
        lists = []
        for t in terms:
            if self.block_max[t, block] > 0 and (own := [x for x in self.lists[t] if low <= x[0] < high]):
                lists.append([0, own, max(s for _, s in own)])
        found = []
        while lists:
            lists.sort(key=lambda x: x[1][x[0]][0])
            bound, pivot = 0.0, None
            for x in lists:
                bound += x[2]
                if bound >= threshold:
                    pivot = x[1][x[0]][0]
                    break
            if pivot is None:
                break
            if lists[0][1][lists[0][0]][0] == pivot:
                score = 0.0
                for x in lists:
                    if x[1][x[0]][0] == pivot:
                        score += x[1][x[0]][1]
                        x[0] += 1
                if score >= threshold:
                    found.append(pivot)
            else:
                for x in lists:
                    while x[0] < len(x[1]) and x[1][x[0]][0] < pivot:
                        x[0] += 1
            lists = [x for x in lists if x[0] < len(x[1])]
        return found

    def search(self, words: list[str], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
        """(part, first word of the passage) of all parts that reach the threshold in some passage."""
        if not self.blocks:
            return []
        half, none = PASSAGE // 2, len(self.terms)
        get = self.terms.get
        ids = np.fromiter((get(w, none) for w in words), np.int64, len(words))
        known = np.flatnonzero(ids < none)
        if not len(known):
            return []
        # each term once in each half passage
        keys = np.unique((known // half) * none + ids[known])
        seg, term = keys // none, keys % none
        starts = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        out = []
        bounds = np.zeros((int(seg[-1]) + 3, self.blocks), np.float32)
        for a in range(0, len(starts), 512):
            rows = starts[a : a + 512]
            stop = starts[a + 512] if a + 512 < len(starts) else len(seg)
            bounds[seg[rows]] = np.add.reduceat(self.block_max[term[rows[0] : stop]], rows - rows[0], axis=0)
        hits, blocks = np.nonzero(bounds[:-2] + bounds[1:-1] + bounds[2:] >= threshold - 1e-4)
        for s, block in zip(hits.tolist(), blocks.tolist(), strict=True):
            terms = np.unique(term[np.searchsorted(seg, s) : np.searchsorted(seg, s + 3)]).tolist()
            out += [(p, s * half) for p in self.wand(terms, block, threshold - 1e-9)]
        return out

    def verified(self, words: list[str], overlap: float = OVERLAP, threshold: float = THRESHOLD) -> dict[int, tuple[float, float]]:
        """Items found in the document, with the part of the question's and of the answer's shingles that is there."""
        out: dict[int, tuple[float, float]] = {}
        for part, at in self.search(words, threshold):
            item = self.items[part]
            reach = max(PASSAGE, self.lengths[item])
            near = words[max(0, at - reach) : at + 2 * PASSAGE + reach]
            shares = []
            for wanted in self.checks[item]:
                n = len(next(iter(wanted))) if wanted else 0
                have = {tuple(near[i : i + n]) for i in range(len(near) - n + 1)} if n else set()
                shares.append(len(wanted & have) / len(wanted) if wanted else 1.0)
            if min(shares) >= overlap:
                out[item] = max(out.get(item, (0.0, 0.0)), tuple(shares))
        return out


def indexes(items: DataFrame):
    """Indexes of texts of at most SHARD parts together (or of one longer text), built one after the other on the driver.

    The test items are the small, given side; null and empty texts are left out.
    Each row is indexed under a number of its own; ids has the item_id, which
    may be null or stand in several rows. Items of fewer than SHINGLE words,
    which any text may hold, are in whole alone: words to ids.
    """
    held: list[tuple] = []
    size = 0

    def index():
        out = Index([(n, t) for n, (_, t) in enumerate(held) if len(words_of(t)) >= SHINGLE])
        out.ids = [item for item, _ in held]
        out.whole = {}
        for item, t in held:
            if 0 < len(w := words_of(t)) < SHINGLE:
                out.whole.setdefault(tuple(w), []).append(item)
        return out

    for r in items.where(F.col("text").isNotNull()).select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        parts = 1 + len(r["text"]) // (4 * PASSAGE)
        if held and size + parts > SHARD:
            yield index()
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += parts
    if held:
        yield index()


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc, tag, item_id, question_overlap, answer_overlap: one row for each item that a document holds.

    Of several texts with one item_id the best found counts; null is one item_id.
    An item of fewer than SHINGLE words is found in documents that hold these
    words and no others. Null and empty texts hold none. Rows of one doc_id, or of
    none, and different texts are told apart by tag.
    """
    spark = docs.sparkSession
    # each index is bounded by SHARD parts; a worker holds one of them at a time
    shared = [Shared(spark, x) for x in indexes(items)]

    def run(batches):
        only = shared[0].value if len(shared) == 1 else None
        for b in batches:
            texts = [words_of(t.as_py()) if t.is_valid else [] for t in b.column("text")]
            best: dict = {}
            for s in shared:
                index = only or s.value
                for i, words in enumerate(texts):
                    found = [(index.ids[n], shares) for n, shares in index.verified(words).items()]
                    if words and len(words) < SHINGLE:
                        found += [(item, (1.0, 1.0)) for item in index.whole.get(tuple(words), ())]
                    for item, shares in found:
                        best[i, item] = max(best.get((i, item), (0.0, 0.0)), shares)
            at = pa.array([i for i, _ in best], pa.int64())
            cols = [[item for _, item in best], [q for q, _ in best.values()], [a for _, a in best.values()]]
            yield pa.RecordBatch.from_arrays([b.column("doc").take(at), b.column("tag").take(at), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.float64()), strict=True))], names=["doc", "tag", "item_id", "question_overlap", "answer_overlap"])

    texts = docs.select(id_key().alias("doc"), row_tag(docs).alias("tag"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc long, tag long, item_id long, question_overlap double, answer_overlap double")


def brute_force(docs, items):
    """(doc_id, item_id) by comparing every item with every document, for tests."""
    out = set()
    for doc, text in docs:
        words = words_of(text or "")
        for item, t in items:
            q, a = (shingles(x) for x in question_and_answer(t or ""))
            have = {n: {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} for n in range(1, SHINGLE + 1)}
            share = lambda s: len([x for x in s if x in have[len(x)]]) / len(s) if s else 1.0  # noqa: E731, B023
            if len(words_of(t or "")) < SHINGLE:
                if words and words == words_of(t or ""):
                    out.add((doc, item))
            elif (q or a) and min(share(q), share(a)) >= OVERLAP:
                out.add((doc, item))
    return out
