"""Substring dedup over bytes with suffix arrays built by induced sorting.

Documents are cut into pieces (windows.py). Pieces that other documents hold
unchanged are settled by their hash; the different pieces of one anchor are
concatenated to a shard text. Its suffix array is built by SA-IS (Nong, Zhang
and Chan 2009): classify suffixes, sort the leftmost S-type (LMS) substrings
by inducing, name them, recurse where names repeat, induce the whole array. The
permuted common prefixes (Karkkainen, Manzini and Puglisi 2009) then tell for
each byte position how long a string from it occurs elsewhere in the shard.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as w
from .common import back_to_id, id_key, row_tag

#: Bytes in an anchor.
K = 200
#: Bytes in a symbol of a shard text.
BLOCK = 8
#: Bytes of pieces that a shard holds at least before its array is built.
SHARD = 1 << 20
#: Fills the block that ends a piece; never a byte of UTF-8.
STOP = b"\xff"


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is S-type; the last symbol is the sentinel."""
    n = len(t)
    rise = np.empty(n, np.int8)
    rise[-1] = 1
    rise[:-1] = np.sign(np.diff(t.astype(np.int64)))
    at = np.where(rise != 0, np.arange(n), n)
    return rise[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array that the LMS suffixes, in the order given, induce.

    Each bucket is read in waves: what a wave induces in its own bucket is the
    next wave, so that the scan is the sequential one in vector steps.
    """
    n = len(t)
    size = np.bincount(t, minlength=sigma)
    tail = np.cumsum(size)
    head = tail - size
    chars = np.flatnonzero(size)
    sa = np.full(n, -1, np.int64)
    by = np.argsort(t[lms], kind="stable")
    placed = lms[by]
    number = np.bincount(t[lms], minlength=sigma)
    begin = np.cumsum(number) - number
    sa_lms = {c: placed[begin[c] : begin[c] + number[c]] for c in np.flatnonzero(number)}
    ptr = head.copy()
    is_l = ~s_type

    def put(block, down):
        j = block[block > 0] - 1
        j = j[s_type[j] if down else is_l[j]]
        if not len(j):
            return
        ch = t[j]
        order = np.argsort(ch, kind="stable")
        ch, j = ch[order], j[order]
        group = np.append(True, ch[1:] != ch[:-1])
        starts = np.flatnonzero(group)
        counts = np.diff(np.append(starts, len(ch)))
        rank = np.arange(len(ch)) - np.repeat(starts, counts)
        if down:
            sa[ptr[ch] - 1 - rank] = j
            ptr[ch[starts]] -= counts
        else:
            sa[ptr[ch] + rank] = j
            ptr[ch[starts]] += counts

    for c in chars:
        at = head[c]
        while at < ptr[c]:
            block, at = sa[at : ptr[c]], ptr[c]
            put(block, False)
        if c in sa_lms:
            put(sa_lms[c], False)
    l_end = ptr
    ptr = tail.copy()
    for c in chars[::-1]:
        if c == t[-1]:  # the sentinel is no one's predecessor's goal
            sa[head[c]] = n - 1
            put(sa[head[c] : head[c] + 1], True)
            continue
        at = tail[c]
        while ptr[c] < at:
            block, at = sa[ptr[c] : at][::-1], ptr[c]
            put(block, True)
        put(sa[head[c] : l_end[c]][::-1], True)
    return sa


def _induce_list(t: list[int], s_type: list[bool], lms: list[int], sigma: int) -> list[int]:
    """_induce for large alphabets, symbol by symbol."""
    n = len(t)
    size = [0] * sigma
    for c in t:
        size[c] += 1
    head, tail, total = [0] * sigma, [0] * sigma, 0
    for c in range(sigma):
        head[c] = total
        total += size[c]
        tail[c] = total
    sa = [-1] * n
    ptr = tail[:]
    for i in reversed(lms):
        c = t[i]
        ptr[c] -= 1
        sa[ptr[c]] = i
    ptr = head
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not s_type[j]:
            c = t[j]
            sa[ptr[c]] = j
            ptr[c] += 1
    ptr = tail
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and s_type[j]:
            c = t[j]
            ptr[c] -= 1
            sa[ptr[c]] = j
    return sa


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Order of the suffixes of t, whose last symbol is its only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    s_type = _types(t)
    is_lms = np.append(False, s_type[1:] & ~s_type[:-1])
    lms = np.flatnonzero(is_lms)
    narrow = n > 50 * sigma

    def induce(order):
        if narrow:
            return _induce(t, s_type, order, sigma)
        return np.array(_induce_list(t.tolist(), s_type.tolist(), order.tolist(), sigma), np.int64)

    if len(lms) > 1:
        sa = induce(lms)
        found = sa[is_lms[sa]]
        end = np.full(n, n - 1)
        end[lms[:-1]] = lms[1:]
        # equal substrings: as long, and equal up to the next LMS symbol
        width = end[found] - found + 1
        data, step = np.ascontiguousarray(t).tobytes(), t.itemsize
        a, b = (found * step).tolist(), ((found + width) * step).tolist()
        parts = [data[x:y] for x, y in zip(a, b, strict=True)]
        new = [1, *(x != y for x, y in zip(parts[1:], parts[:-1], strict=True))]
        names = np.cumsum(new) - 1
        if names[-1] + 1 == len(lms):
            lms = found
        else:
            name_at = np.empty(n, np.int64)
            name_at[found] = names
            lms = lms[suffix_array(name_at[lms], int(names[-1]) + 1)]
    return induce(lms)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, also: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position, the common prefix with the suffix before it in sa, and that suffix.

    Where the preceding symbols are equal the value is one less than the last
    one, so only the other (irreducible) positions, and those in also, are
    compared. Values of at least most count as most from there.
    """
    n = len(t)
    prev = np.empty(n, np.int64)
    prev[sa[1:]] = sa[:-1]
    prev[sa[0]] = -1
    own = np.ones(n, bool)
    own[1:] = (prev[1:] <= 0) | (t[:-1] != t[prev[1:] - 1])
    own[also] = True
    at = np.flatnonzero(own)
    value = np.zeros(len(at), np.int64)
    padded = np.append(t, np.zeros(most + 1, t.dtype))
    live = np.flatnonzero(prev[at] >= 0)
    a, b = at[live], prev[at[live]]
    done = 0
    while len(live) and done < most:
        same = padded[a + done] == padded[b + done]
        live, a, b = live[same], a[same], b[same]
        done += 1
        value[live] = done
    last = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    full = np.zeros(n, np.int64)
    full[at] = value
    return np.maximum(full[last] - (np.arange(n) - last), 0), prev


def repeated_in(parts: list[bytes], offsets: list[int], length: int) -> list[np.ndarray]:
    """For each part, which of its windows of length bytes also start elsewhere in parts.

    offsets tell where each part's anchor stands. Equal windows hold the same
    anchor at the same offset, so blocks counted from it fall alike in both,
    and the array is built over blocks, whose order is that of their bytes.
    It settles the windows that start with a block, and by them most others.
    Of the few at the edges of a match, which begin inside a block, the whole
    window's hash decides.
    """
    heads = np.array(offsets) % BLOCK
    sizes = np.array([len(p) for p in parts])
    texts = [p[h:] + STOP * (BLOCK - (len(p) - h) % BLOCK) for p, h in zip(parts, heads.tolist(), strict=True)]
    counts = np.array([len(x) // BLOCK for x in texts])
    first = np.cumsum(counts) - counts
    blocks = np.frombuffer(b"".join(texts), ">u8").astype(np.uint64)
    _, t = np.unique(blocks, return_inverse=True)
    t = np.append(t + 1, 0)
    sa = suffix_array(t, int(t.max()) + 1)
    plcp, prev = permuted_lcp(t, sa, first, 2 * length // BLOCK + 1)
    # in bytes: the blocks that differ may begin alike
    after = np.append(blocks, np.zeros(2 * length // BLOCK + 3, np.uint64))
    at = np.arange(len(blocks))
    diff = after[at + plcp[:-1]] ^ after[np.maximum(prev[:-1], 0) + plcp[:-1]]
    alike = np.zeros(len(at), np.int64)
    for i in range(1, BLOCK):
        alike += (diff >> np.uint64(8 * (BLOCK - i))) == 0
    common = np.append(plcp[:-1] * BLOCK + alike, 0)
    best = common.copy()
    best[sa[:-1]] = np.maximum(best[sa[:-1]], common[sa[1:]])
    # windows by byte
    windows = np.maximum(sizes - length + 1, 0)
    part = np.repeat(np.arange(len(parts)), windows)
    begin = np.cumsum(windows) - windows
    s = np.arange(len(part)) - begin[part]
    rel = s - heads[part]
    low, inside = rel // BLOCK, rel % BLOCK
    before = np.where(low >= 0, best[first[part] + np.maximum(low, 0)], 0)
    flags = before >= length + inside
    nxt = best[np.minimum(first[part] + low + 1, len(best) - 1)]
    open_ = ~flags & (inside > 0) & (nxt >= length - (BLOCK - inside))
    if open_.any():
        place = np.repeat(np.cumsum(sizes) - sizes, windows) + s
        raw = _BYTES[np.frombuffer(b"".join(parts), np.uint8)]
        up, down = w.powers(len(raw) + 1)
        prefix = np.append(np.zeros(1, np.uint64), np.cumsum(raw * up[: len(raw)]))
        hashes = w.mix((prefix[place + length] - prefix[place]) * down[place])
        _, which, number = np.unique(hashes[np.isin(hashes, hashes[open_])], return_inverse=True, return_counts=True)
        same = np.isin(hashes, hashes[open_])
        twice = np.zeros(len(hashes), bool)
        twice[same] = number[which] > 1
        flags |= open_ & twice
    return np.split(flags, begin[1:])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2] - edge[::2]


_BYTES = w.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _symbols(texts):
    for doc, t in texts:
        yield doc, _BYTES[np.frombuffer(t, np.uint8)]


def _cut(text: bytes):
    return lambda start, end: text[start:end]


def _compare_shards(length: int):
    def shard(rows):
        out = [[], [], [], []]
        for (doc, tag, start, _, state, _), flags in zip(rows, repeated_in([r[5] for r in rows], [r[3] >> 16 for r in rows], length), strict=True):
            if state == w.OPEN:
                at, n = runs(flags)
                for o, x in zip(out, ([doc] * len(at), [tag] * len(at), (at + start).tolist(), n.tolist()), strict=True):
                    o += x
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 3 else pa.int64()) for i, c in enumerate(out)], names=["doc", "tag", "start", "n"])

    def run(batches):
        rows, size, last = [], 0, None
        for b in batches:
            cols = (b.column(c).to_pylist() for c in ("anchor", "doc", "tag", "start", "n", "state", "content"))
            for anchor, *row in zip(*cols, strict=True):
                if size >= SHARD and anchor != last:
                    yield shard(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[-1])
                last = anchor
        if rows:
            yield shard(rows)

    return run


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: each document without its repeated windows.

    A window of length bytes is removed if it also starts at any other place,
    same document included. Null texts count as empty. Rows of one doc_id, or of
    none, and different texts are documents of their own; rows that repeat both
    are the same document. kept is binary: a removed span may end inside a character.
    """
    texts = docs.select(id_key().alias("doc"), row_tag(docs).alias("tag"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    keyed, spans = w.repeated_spans(texts, _symbols, _cut, _compare_shards(length), length, K, first_stays=False)

    def run(batches):
        for b in batches:
            rows = [[], [], [], []]
            for t, s in zip(b.column("text"), b.column("spans"), strict=True):
                text, gone, number = t.as_py(), 0, 0
                kept = text
                if s.is_valid and text:
                    v = s.values.flatten()
                    cover = w.covered((v[0].to_numpy(), v[1].to_numpy()), len(text), length - 1)
                    gone, number = int(cover.sum()), len(runs(cover)[0])
                    kept = np.frombuffer(text, np.uint8)[~cover].tobytes()
                for r, x in zip(rows, (len(text), gone, number, kept), strict=True):
                    r.append(x)
            yield pa.RecordBatch.from_arrays([b.column("doc"), *(pa.array(r, pa.binary() if i == 3 else pa.int64()) for i, r in enumerate(rows))], names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    out = keyed.join(spans, ["doc", "tag"], "left").select("doc", "text", "spans").mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(back_to_id("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def brute_force(rows, length: int = 400):
    """The same by counting every window, for tests: doc_id -> (n_bytes, n_removed, n_spans, sha256)."""
    count: dict[bytes, int] = {}
    for _, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            h = hashlib.blake2b(data[i : i + length], digest_size=12).digest()
            count[h] = count.get(h, 0) + 1
    out = {}
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if count[hashlib.blake2b(data[i : i + length], digest_size=12).digest()] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(data, gone.tolist(), strict=True) if not g)
        out[doc] = len(data), int(gone.sum()), len(runs(gone)[0]), hashlib.sha256(kept).hexdigest()
    return out
