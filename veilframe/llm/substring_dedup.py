"""Substring dedup over words with suffix automata of reference shards.

Documents are cut into pieces (windows.py). Pieces whose anchor is unique hold
no repeated window. Of equal pieces only the first can hold a new window, so
the later copies are settled by their hash. The different pieces of one anchor
form a reference shard: a suffix automaton of the shard's earlier pieces is
kept, each next piece is streamed through it for its matching statistics, and
where these reach the window length the window has occurred earlier.

An automaton of the whole reference would grow with the corpus and could not be
broadcast; here each shard's automaton lives in the one task to which the shuffle
brings every piece that could match it, and is bounded by one anchor's texts.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as w
from .common import back_to_id, id_key, row_tag

#: Words in an anchor.
K = 8


class WordHashes(dict):
    """64-bit hash of each word; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class SuffixAutomaton:
    """Suffix automaton of several sequences (Blumer et al. 1985)."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]

    def extend(self, last: int, c) -> int:
        """The state of the sequence that ends in last, lengthened by c."""
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def add(self, seq) -> None:
        state = 0
        for c in seq:
            state = self.extend(state, c)

    def matching_statistics(self, seq) -> list[int]:
        """For each position, the length of the longest suffix ending there that occurs here."""
        nxt, link, length = self.next, self.link, self.len
        state, n, out = 0, 0, []
        for c in seq:
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                n += 1
            out.append(n)
        return out


def matched_spans(automaton: SuffixAutomaton, seq, length: int) -> list[tuple[int, int]]:
    """Maximal runs (start, number) of windows of seq that occur in the automaton."""
    runs: list[tuple[int, int]] = []
    for end, m in enumerate(automaton.matching_statistics(seq)):
        if m >= length:
            at = end - length + 1
            if runs and sum(runs[-1]) == at:
                runs[-1] = runs[-1][0], runs[-1][1] + 1
            else:
                runs.append((at, 1))
    return runs


def _symbols(texts):
    hashes = WordHashes()
    for doc, t in texts:
        yield doc, hashes.of(t.split())


def _cut(text: bytes):
    words = text.split()
    return lambda start, end: b" ".join(words[start:end])


def _stream_shards(length: int):
    def run(batches):
        anchor, automaton = None, SuffixAutomaton()
        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            for a, doc, tag, start, content in zip(*(b.column(c).to_pylist() for c in ("anchor", "doc", "tag", "start", "content")), strict=True):
                seq = content.split()
                if a != anchor:
                    anchor, automaton = a, SuffixAutomaton()
                else:
                    out += [(doc, tag, start + at, n) for at, n in matched_spans(automaton, seq, length)]
                automaton.add(seq)
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 3 else pa.int64()) for i, c in enumerate(cols)], names=["doc", "tag", "start", "n"])

    return run


def repeated_spans(docs: DataFrame, length: int = 20) -> tuple[DataFrame, DataFrame]:
    """Texts and, for each document with any, its windows that occurred earlier.

    Returns (doc, tag, text) and (doc, tag, spans: array of start and number of windows).
    Earlier means a smaller doc_id, null last, or the same document and an earlier
    start; rows of one doc_id, or of none, and different texts are documents of their
    own, in an order of their texts' hashes. Rows that repeat both are the same
    document. Null texts have no window.
    """
    texts = docs.select(id_key().alias("doc"), row_tag(docs).alias("tag"), F.col("text").cast("binary").alias("text"))
    return w.repeated_spans(texts, _symbols, _cut, _stream_shards(length), length, K, first_stays=True)


def remove_repeats(docs: DataFrame, length: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: each document without its repeated windows, see repeated_spans().

    Null or empty texts: no words, an empty kept text.
    """
    keyed, spans = repeated_spans(docs, length)

    def run(batches):
        for b in batches:
            rows = [[], [], []]
            for t, s in zip(b.column("text"), b.column("spans"), strict=True):
                words = (t.as_py() or b"").split()
                gone = 0
                if s.is_valid and words:
                    v = s.values.flatten()
                    cover = w.covered((v[0].to_numpy(), v[1].to_numpy()), len(words), length - 1)
                    gone = int(cover.sum())
                    kept = b" ".join(compress(words, (~cover).tolist()))
                else:
                    kept = b" ".join(words)
                for r, x in zip(rows, (len(words), gone, kept), strict=True):
                    r.append(x)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], names=["doc", "n_words", "n_removed", "kept"])

    out = keyed.join(spans, ["doc", "tag"], "left").select("doc", "text", "spans").mapInArrow(run, "doc long, n_words long, n_removed long, kept binary")
    return out.select(back_to_id("doc").alias("doc_id"), "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))


def brute_force(rows, length: int = 20):
    """The same by a scan of (doc_id, text) in order, for tests: doc_id -> (n_words, n_removed, sha256)."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            win = tuple(words[i : i + length])
            if win in seen:
                gone[i : i + length] = [True] * length
            seen.add(win)
        kept = b" ".join(x for x, g in zip(words, gone, strict=True) if not g)
        out[doc] = len(words), sum(gone), hashlib.sha256(kept).hexdigest()
    return out
