"""Cut symbol sequences into pieces that meet wherever a window repeats.

A window is L consecutive symbols. Its anchor is the k-gram inside it with the
smallest hash, the last one among equals, so equal windows have equal anchors
at equal offsets (winnowing, Schleimer et al. 2003). Consecutive windows with
the same anchor occurrence form a piece. Each window lies in exactly one
piece, and two equal windows lie in pieces of the same anchor. About two
pieces come from L - k + 1 symbols, so that what is shuffled is a small part
of the input, whatever the input repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, written

POS_BITS = 24
POS_MASK = np.uint64((1 << POS_BITS) - 1)
#: Windows that one vectorised step handles; bounds a worker's memory.
STEP = 1 << 19
_A = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """A**i and A**-i modulo 2**64 for i < n."""
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _A, np.uint64), np.full(size, pow(_A, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def pieces(sym: np.ndarray, bounds: np.ndarray, length: int, k: int):
    """Pieces of the sequences sym[bounds[i]:bounds[i+1]].

    Returns arrays: sequence, start in sym, number of windows (low 16 bits)
    with the anchor's offset (high bits), hash of the anchor, hash of the
    piece's symbols.
    """
    assert length - k < 1 << 15
    n = len(sym)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    assert n <= int(POS_MASK)
    up, down = powers(n + 1)
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(sym * up[:n], out=prefix[1:])
    grams = mix((prefix[k:] - prefix[:-k]) * down[: n - k + 1])
    least = (grams & ~POS_MASK) | (POS_MASK - np.arange(len(grams), dtype=np.uint64))
    span, wide = 1, length - k + 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    anchor = least & POS_MASK  # as complement
    many = n - length + 1
    change = np.zeros(many + 1, np.int8)
    first, last = bounds[:-1], bounds[1:] - length + 1
    real = last > first
    np.add.at(change, first[real], 1)
    np.add.at(change, last[real], -1)
    valid = np.cumsum(change[:many], dtype=np.int8).astype(bool)
    new = np.empty(many, bool)
    new[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
    new[1:] |= ~valid[:-1]
    starts = np.flatnonzero(new & valid)
    stop = np.append(new[1:] | ~valid[1:], True)
    ends = np.flatnonzero(stop & valid) + 1
    at = (POS_MASK - anchor[starts]).astype(np.int64)
    whole = mix((prefix[ends + length - 1] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return np.searchsorted(bounds, starts, "right") - 1, starts, ends - starts + (at - starts << 16), grams[at], whole


def stepped(docs, length: int):
    """Group (key, symbols), a key being doc and tag, into steps of about STEP symbols.

    Yields keys, offsets, symbols, bounds; a long sequence comes in slices
    that overlap by length - 1 symbols, so that no window is lost or doubled.
    """
    keys, offsets, parts, size = [], [], [], 0
    for key, sym in docs:
        at = 0
        while len(sym) - at >= length:
            part = sym[at : at + STEP + length - 1]
            keys.append(key)
            offsets.append(at)
            parts.append(part)
            size += len(part)
            at += STEP
            if size >= STEP:
                yield keys, offsets, np.concatenate(parts), np.cumsum([0, *map(len, parts)])
                keys, offsets, parts, size = [], [], [], 0
    if parts:
        yield keys, offsets, np.concatenate(parts), np.cumsum([0, *map(len, parts)])


PIECE_SCHEMA = "k long, seen int, anchor long, piece long, doc long, tag long, start long, n int"


def piece_batches(docs, length: int, k: int):
    """Arrow batches of PIECE_SCHEMA from ((doc, tag), symbols).

    Copies of a piece within a step are settled here, before the shuffle: one
    row goes to the anchor's group, with seen = 2 if there were copies; the
    others leave with seen = -1 and a key of their own, to no single task.
    """
    schema = pa.schema([("k", pa.int64()), ("seen", pa.int32()), ("anchor", pa.int64()), ("piece", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("n", pa.int32())])
    for keys, offsets, sym, bounds in stepped(docs, length):
        seq, at, n, anchor, piece = pieces(sym, bounds, length, k)
        if not len(seq):
            continue
        doc, tag = np.asarray(keys, np.int64).reshape(-1, 2)[seq].T
        start = at - bounds[seq] + np.asarray(offsets, np.int64)[seq]
        order = np.lexsort((start, tag, doc, piece, anchor))
        doc, tag, start, n, anchor, piece = doc[order], tag[order], start[order], n[order], anchor[order].view(np.int64), piece[order].view(np.int64)
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]))
        head = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        first = head[group]
        other = (doc != doc[first]) | (tag != tag[first]) | (start != start[first])
        copies = np.logical_or.reduceat(other, head)
        seen = np.where(new, np.where(copies[group], 2, 1), -1).astype(np.int32)
        keep = new | other
        own = mix((doc.astype(np.uint64) << np.uint64(20)) ^ tag.astype(np.uint64) ^ start.astype(np.uint64)).view(np.int64)
        key = np.where(new, anchor, own)
        cols = [key, seen, anchor, piece, doc, tag, start, n.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], schema=schema)


VERDICT_SCHEMA = "doc long, tag long, start long, n int, anchor long, state int"
#: All windows of the piece repeat; to be compared; both.
REPEATED, OPEN, REPEATED_OPEN = 1, 2, 3
#: Part of a row's n that is the number of windows.
NUMBER = (1 << 16) - 1
_VERDICT = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("anchor", pa.int64()), ("state", pa.int32())])


def settle(batches, first_stays: bool, least: int = 100_000):
    """From rows of PIECE_SCHEMA sorted by anchor, piece, doc, tag and start, verdicts.

    Of the copies of a piece, all are repeated, or all but the first if
    first_stays. If an anchor has other pieces, one copy of each is OPEN.
    One row is carried from step to step, however large a group is.
    """
    carry = None  # seen, anchor, piece, doc, tag, start, n; whether its anchor had a piece before
    before = False

    def step(rows, final):
        nonlocal carry, before
        seen, anchor, piece, doc, tag, start, n = rows
        done = seen < 0
        if done.any():
            yield doc[done], tag[done], start[done], n[done], anchor[done], np.full(done.sum(), REPEATED)
        seen, anchor, piece, doc, tag, start, n = (x[~done] for x in rows)
        had = False
        if carry is not None:
            seen, anchor, piece, doc, tag, start, n = (np.append(c, x) for c, x in zip(carry, (seen, anchor, piece, doc, tag, start, n), strict=True))
            had, carry = before, None
        if not len(seen):
            return
        fresh = np.append(True, anchor[1:] != anchor[:-1])
        new = fresh | np.append(True, piece[1:] != piece[:-1])
        head = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        first = head[group]
        other = (doc != doc[first]) | (tag != tag[first]) | (start != start[first])
        copies = np.logical_or.reduceat(other | (seen > 1), head)
        opens = fresh[head]
        multi = ~opens
        multi[0] |= had
        multi[:-1] |= ~opens[1:]
        yield doc[other], tag[other], start[other], n[other], anchor[other], np.full(other.sum(), REPEATED)
        ready = np.ones(len(head), bool)
        if not final:
            ready[-1] = False
            i = head[-1]
            carry = np.int32(2 if copies[-1] else 1), anchor[i], piece[i], doc[i], tag[i], start[i], n[i]
            before = bool(had if len(head) == 1 else not opens[-1])
        state = np.where(multi, OPEN, 0) + (0 if first_stays else np.where(copies, REPEATED, 0))
        use = ready & (state > 0)
        h = head[use]
        yield doc[h], tag[h], start[h], n[h], anchor[h], state[use]

    def out(parts):
        for doc, tag, start, n, anchor, state in parts:
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tag), pa.array(start), pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(state.astype(np.int32))], schema=_VERDICT)

    held, size = [], 0
    for b in batches:
        held.append([b.column(c).to_numpy(zero_copy_only=False) for c in ("seen", "anchor", "piece", "doc", "tag", "start", "n")])
        size += b.num_rows
        if size >= least:
            yield from out(step([np.concatenate(x) for x in zip(*held, strict=True)], False))
            held, size = [], 0
    rows = [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.zeros(0, np.int64)] * 7
    yield from out(step(rows, True))


def covered(spans, limit: int, extra: int) -> np.ndarray:
    """Which of limit symbols the windows in spans (start, n) cover; extra = L - 1."""
    change = np.zeros(limit + 1, np.int32)
    if len(spans[0]):
        start = np.minimum(np.asarray(spans[0], np.int64), limit)
        end = np.minimum(start + np.asarray(spans[1], np.int64) + extra, limit)
        np.add.at(change, start, 1)
        np.add.at(change, end, -1)
    return np.cumsum(change[:limit]) > 0


def texts_of(batches):
    """((doc, tag), bytes) of the rows whose text is not null."""
    for b in batches:
        for doc, tag, t in zip(b.column("doc").to_pylist(), b.column("tag").to_pylist(), b.column("text"), strict=True):
            if t.is_valid:
                yield (doc, tag), t.as_py()


def _open_contents(cut, length: int):
    """Rows (anchor, doc, tag, start, n, state, content) of the pieces that are to be compared."""
    schema = pa.schema([("anchor", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("state", pa.int32()), ("content", pa.binary())])

    def run(batches):
        for b in batches:
            rows = []
            for doc, tag, t, items in zip(b.column("doc").to_pylist(), b.column("tag").to_pylist(), b.column("text"), b.column("open"), strict=True):
                if items.is_valid and t.is_valid:
                    part = cut(t.as_py())
                    rows += [(x["anchor"], doc, tag, x["start"], x["n"], x["state"], part(x["start"], x["start"] + (x["n"] & NUMBER) + length - 1)) for x in items.as_py()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def repeated_spans(texts: DataFrame, symbols, cut, compare, length: int, k: int, first_stays: bool) -> tuple[DataFrame, DataFrame]:
    """Windows of texts (doc long, tag long, text binary) that repeat.

    symbols turns an iterator of (key, bytes) to (key, uint64 symbols); cut gives
    a function that takes symbols from a text; compare is an Arrow function over
    the sorted contents of each anchor that yields doc, tag, start, n of further
    repeated windows. Returns texts by doc and tag, and (doc, tag, spans: array of start, n).
    """
    spark = texts.sparkSession
    found = texts.mapInArrow(lambda bs: piece_batches(symbols(texts_of(bs)), length, k), PIECE_SCHEMA)
    found = found.repartition(partitions(spark), "k").sortWithinPartitions("anchor", "piece", "doc", "tag", "start")
    verdicts = written(found.mapInArrow(lambda bs: settle(bs, first_stays), VERDICT_SCHEMA), "windows")
    keyed = texts.repartition(partitions(spark), "doc", "tag")
    todo = verdicts.where(F.col("state") >= OPEN).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n", "anchor", "state")).alias("open"))
    content = keyed.join(todo, ["doc", "tag"], "left").select("doc", "tag", "text", "open").mapInArrow(_open_contents(cut, length), "anchor long, doc long, tag long, start long, n int, state int, content binary")
    content = content.repartition(partitions(spark), "anchor").sortWithinPartitions("anchor", "doc", "tag", "start")
    more = content.mapInArrow(compare, "doc long, tag long, start long, n int")
    known = verdicts.where(F.col("state") != OPEN).select("doc", "tag", "start", F.col("n").bitwiseAND(NUMBER).alias("n"))
    spans = known.unionByName(more)
    return keyed, spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
