"""Near-duplicate documents with an LSH forest over MinHash signatures.

A signature is read in several orders, each from another place. Documents with
the same first DEPTH values in an order form a region; a region of more than
LARGE rows is read one value deeper. Within a region all pairs are estimated; if
it is still too large, its rows are taken as neighbours in the order. What hangs
together by estimates forms a cluster; links stay within clusters. There they
are found exactly on the full sets: all intersections at once where a cluster
fits a task, by shared rare shingles (prefix filter) where it does not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import windows as w
from .common import back_to_id, id_key, looked_up, partitions, row_tag, written
from .components import components
from .substring_dedup import WordHashes

SHINGLE = 5
ORDERS, DEPTH = 24, 4
VALUES = ORDERS * DEPTH
#: Rows are taken for near if their estimate is at most ERRORS standard errors under the threshold.
ERRORS = 4.1
#: Rows of a region that are compared pair by pair; rows and shingles of a cluster that one task holds.
LARGE, CLUSTER_ROWS, CLUSTER_SHINGLES = 1024, 4096, 1 << 22
_MULT = (w.mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1))[None, :]
_COEF = w.mix(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of the text's words, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    if len(h) < SHINGLE:
        return w.mix((h * _COEF[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    n = len(h) - SHINGLE + 1
    total = h[:n] * _COEF[0]
    for i in range(1, SHINGLE):
        total += h[i : i + n] * _COEF[i]
    return np.unique(w.mix(total))


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(out, (s[i : i + 2048, None] * _MULT).min(0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def region_keys(sig: np.ndarray) -> np.ndarray:
    """For each order a hash of its first values; the low five bits tell the order."""
    v = sig.reshape(-1, ORDERS, DEPTH).astype(np.uint64)
    h = np.zeros(v.shape[:2], np.uint64)
    for i in range(DEPTH):
        h = w.mix(h * np.uint64(0x9E3779B97F4A7C15) + v[:, :, i] + np.uint64(i + 1))
    return (h & ~np.uint64(31)) | np.arange(ORDERS, dtype=np.uint64)


def _signed(batches):
    hashes = WordHashes()
    for b in batches:
        sizes, sums, sigs = [], [], []
        for t in b.column("text"):
            s = shingle_set(t.as_py() or b"", hashes)
            sizes.append(len(s))
            sums.append(int(w.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()) if len(s) else 0)
            sigs.append(signature(s))
        sig = np.array(sigs, np.uint32).reshape(-1, VALUES)
        keys = region_keys(sig).view(np.int64)
        short = sig.astype(np.uint8)  # values that agree by chance, one in 256, only add candidates
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("tag"), pa.array(sizes, pa.int64()), pa.array(np.array(sums, np.uint64).view(np.int64)), pa.array([r.tobytes() for r in short], pa.binary()), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, ORDERS, dtype=np.int32), pa.array(keys.ravel()))], names=["doc", "tag", "n", "whole", "sig", "keys"])


def least_estimate(percent: int) -> float:
    j = percent / 100
    return j - ERRORS * (j * (1 - j) / VALUES) ** 0.5


def _groups(linked, m: int) -> np.ndarray:
    """Least row number that each of m rows hangs together with; linked(rows) gives these rows of the link matrix."""
    root = np.full(m, -1)
    for i in range(m):
        if root[i] >= 0:
            continue
        root[i] = i
        edge = np.array([i])
        while len(edge):
            new = np.zeros(m, bool)
            for a in range(0, len(edge), 64):
                new |= linked(edge[a : a + 64]).any(0)
            edge = np.flatnonzero(new & (root < 0))
            root[edge] = i
    return root


def region_groups(sig: np.ndarray, maybe: float) -> np.ndarray:
    """Groups of the rows of a region that hang together by estimates."""
    return _groups(lambda rows: (sig[rows][:, None, :] == sig[None, :, :]).mean(2) >= maybe, len(sig))


def cluster_groups(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Groups of sets that hang together by 100 * intersection >= percent * union, all intersections counted."""
    m, n = len(sets), np.array([len(s) for s in sets])
    if m <= 16:
        both = np.zeros((m, m))
        for i in range(m):
            for j in range(i):
                if 100 * min(n[i], n[j]) >= percent * max(n[i], n[j]):
                    both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(m), n)
        keep = count[which] > 1  # what one set alone holds is in no intersection
        number = np.cumsum(count > 1) - 1
        row, column = row[keep], number[which[keep]]
        by = np.argsort(column, kind="stable")
        row, column = row[by], column[by]
        both = np.zeros((m, m), np.float32)
        step = 2048
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, step):
            x, y = np.searchsorted(column, [a, a + step])
            part = np.zeros((m, step), np.float32)
            part[row[x:y], column[x:y] - a] = 1
            both += part @ part.T
    return _groups(lambda rows: 100 * both[rows] >= percent * (n[rows][:, None] + n[None, :] - both[rows]), m)


def _by_key(batches, names: list[str], work):
    """work(columns) for the rows of each key of sorted batches; rows of one key are held together."""
    held: list = []

    def whole(parts):
        cols = [np.concatenate([p[i] for p in parts]) for i in range(len(names))]
        edge = np.append(np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1])), len(cols[0]))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            yield from work([c[a:b] for c in cols])

    for b in batches:
        cols = [b.column(n).to_numpy(zero_copy_only=False) for n in names]
        if not len(cols[0]):
            continue
        last = len(cols[0]) - int((cols[0] == cols[0][-1]).sum())
        if held and (last or held[-1][0][-1] != cols[0][0]):
            same = int((cols[0] == held[-1][0][-1]).sum())
            yield from whole([*held, [c[:same] for c in cols]])
            held = []
            if same < last:
                yield from whole([[c[same:last] for c in cols]])
        elif last:
            yield from whole([[c[:last] for c in cols]])
        held.append([c[last:] for c in cols])
    if held:
        yield from whole(held)


_EDGES = "u_doc long, u_tag long, v_doc long, v_tag long"


def _region_edges(maybe: float):
    def work(cols):
        _, doc, tag, sig = cols
        root = region_groups(np.frombuffer(b"".join(sig), np.uint8).reshape(-1, VALUES), maybe)
        i = np.flatnonzero(root != np.arange(len(root)))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[i], tag[i], doc[root[i]], tag[root[i]])], names=["u_doc", "u_tag", "v_doc", "v_tag"])

    return lambda batches: _by_key(batches, ["key", "doc", "tag", "sig"], work)


def _sets(batches):
    hashes = WordHashes()
    for b in batches:
        sets = [shingle_set(t.as_py() or b"", hashes).tobytes() for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("cluster"), b.column("doc"), b.column("tag"), pa.array(sets, pa.binary())], names=["cluster", "doc", "tag", "shingles"])


def _cluster_edges(percent: int):
    def work(cols):
        _, doc, tag, shingles = cols
        root = cluster_groups([np.frombuffer(s, np.uint64) for s in shingles], percent)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, tag, doc[root], tag[root])], names=["u_doc", "u_tag", "v_doc", "v_tag"])

    return lambda batches: _by_key(batches, ["cluster", "doc", "tag", "shingles"], work)


def _tokens(batches):
    for b in batches:
        for doc, tag, shingles in zip(b.column("doc").to_pylist(), b.column("tag").to_pylist(), b.column("shingles"), strict=True):
            s = np.frombuffer(shingles.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), doc)), pa.array(np.full(len(s), tag)), pa.array(np.full(len(s), len(s))), pa.array(s)], names=["doc", "tag", "n", "token"])


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("su"), b.column("sv"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("u_doc", "u_tag", "v_doc", "v_tag")], names=["u_doc", "u_tag", "v_doc", "v_tag"]).filter(pa.array(keep, pa.bool_()))

    return run


def _ends(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    at = lambda x: F.struct(F.col(f"{x}_doc").alias("doc"), F.col(f"{x}_tag").alias("tag"))
    return edges.select(at("u").alias(u), at("v").alias(v))


def large_links(sets: DataFrame, percent: int) -> DataFrame:
    """u, v: links among sets (doc, tag, shingles) of clusters of any size, enough of them to connect all that hangs together.

    Two sets of this similarity share one of each one's n - ceil(n * percent / 100) + 1
    rarest shingles. Rows that share one meet the first of these rows; of those that
    this leaves in other groups than most of its rows, each meets all rows.
    """
    tokens = sets.mapInArrow(_tokens, "doc long, tag long, n long, token long")
    counts = tokens.groupBy("token").count().where("count > 1")
    ranked = tokens.join(counts.hint("merge"), "token").groupBy("doc", "tag", "n").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("t"))
    # shingles that stand nowhere else come first and meet nothing
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("t"))
    met = ranked.select(F.struct("doc", "tag").alias("at"), "n", F.explode(F.slice("t", F.lit(1), F.greatest(length, F.lit(0)).cast("int"))).alias("t")).select("at", "n", F.col("t.token").alias("token"))
    met = written(met, "tokens")
    near = lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)
    first = met.groupBy("token").agg(F.min("at").alias("v"))
    star = met.join(first.hint("merge"), "token").where(F.col("at") != F.col("v")).select(F.col("at").alias("u"), "v").distinct()
    links = written(_confirmed(sets, star, percent), "links")
    group = components(links).withColumnRenamed("node", "at")
    known = written(met.join(group.hint("merge"), "at", "left").select("token", "at", "n", F.coalesce("component", "at").alias("group")), "known")
    most = known.groupBy("token", "group").count().groupBy("token").agg(F.max_by("group", F.struct("count", "group")).alias("most"), F.count("*").alias("groups")).where("groups > 1")
    few = known.join(most.hint("merge"), "token").where(F.col("group") != F.col("most")).select("token", F.col("at").alias("u"), F.col("n").alias("nu"), F.col("group").alias("gu"))
    all_ = known.select("token", F.col("at").alias("v"), F.col("n").alias("nv"), F.col("group").alias("gv"))
    rest = few.join(all_.hint("merge"), (few["token"] == all_["token"]) & (F.col("gu") != F.col("gv")) & near(F.col("nu"), F.col("nv")))
    rest = written(rest.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "pairs")
    return links.unionByName(_confirmed(sets, rest, percent))


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs u, v that are near copies by their full sets."""
    u = sets.select(F.col("doc").alias("u_doc"), F.col("tag").alias("u_tag"), F.col("shingles").alias("su"))
    v = sets.select(F.col("doc").alias("v_doc"), F.col("tag").alias("v_tag"), F.col("shingles").alias("sv"))
    pairs = pairs.select(F.col("u.doc").alias("u_doc"), F.col("u.tag").alias("u_tag"), F.col("v.doc").alias("v_doc"), F.col("v.tag").alias("v_tag"))
    both = pairs.join(u.hint("merge"), ["u_doc", "u_tag"]).join(v.hint("merge"), ["v_doc", "v_tag"])
    return _ends(both.mapInArrow(_confirm(percent), _EDGES))


def candidate_clusters(heads: DataFrame, maybe: float) -> DataFrame:
    """doc, tag, cluster (a node) of the rows of heads (doc, tag, sig, keys) that may be linked to another."""
    spark = heads.sparkSession
    rows = heads.select("doc", "tag", F.explode("keys").alias("key"))
    beside = Window.partitionBy("key").orderBy("doc", "tag")
    rows = rows.withColumn("other", F.coalesce(F.lag("doc").over(beside), F.lead("doc").over(beside))).where("other IS NOT NULL").drop("other")
    rows = written(rows.join(heads.select("doc", "tag", "sig").hint("merge"), ["doc", "tag"]), "shared")
    # regions that are crowded go one value deeper: its place in the signature follows from the order
    crowded = rows.groupBy("key").count().where(F.col("count") > LARGE)
    order = F.col("key").bitwiseAND(F.lit(31))
    deeper = F.xxhash64("key", F.substring("sig", ((order * DEPTH + DEPTH) % VALUES + 1).cast("int"), F.lit(1)))
    total = rows.count()
    rows = looked_up(rows, crowded.withColumn("held", F.col("count")), ["key"], "held", total, "left").withColumn("key", F.when(F.col("count") > LARGE, deeper).otherwise(F.col("key"))).withColumn("deep", F.col("count").isNotNull()).drop("count")
    rows = written(rows, "regions")
    many = rows.where("deep").groupBy("key").agg(F.count("*").alias("count"), F.min(F.struct("doc", "tag")).alias("v")).where(F.col("count") > LARGE)
    named = looked_up(rows, many.withColumnRenamed("count", "held"), ["key"], "held", total, "left")
    chained = named.where("v IS NOT NULL").select(F.struct("doc", "tag").alias("u"), "v")
    rest = named.where("v IS NULL").select("doc", "tag", "key", "sig")
    rest = rest.repartition(partitions(spark), "key").sortWithinPartitions("key", "doc", "tag")
    edges = _ends(rest.mapInArrow(_region_edges(maybe), _EDGES))
    found = components(edges.unionByName(chained))
    return found.select("node.doc", "node.tag", F.col("component").alias("cluster"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc, tag, n_shingles, component (doc, tag) for each row of docs (doc_id, text).

    Documents whose shingle sets have 100 * intersection >= percent * union are
    linked; component is the smallest doc_id reachable. Null texts and those
    without words have no shingles and are linked with nothing. Rows of one
    doc_id, or of none, and different texts are documents of their own (tag tells
    them apart; null ids come last); rows that repeat both are one. Documents
    with equal sets are one in all stages after the first.
    """
    texts = docs.select(id_key().alias("doc"), row_tag(docs).alias("tag"), F.col("text").cast("binary").alias("text"))
    signed = written(texts.mapInArrow(_signed, "doc long, tag long, n long, whole long, sig binary, keys array<long>"), "signatures")
    some, total = signed.where(F.col("n") > 0), signed.count()
    heads = written(some.groupBy("n", "whole").agg(F.min(F.struct("doc", "tag")).alias("head"), F.count("*").alias("held")), "heads")
    first = heads.select("head.doc", "head.tag")
    own = written(some.select("doc", "tag", "sig", "keys").join(first.hint("merge"), ["doc", "tag"]).dropDuplicates(["doc", "tag"]), "own")
    clusters = candidate_clusters(own, least_estimate(percent))
    # what grows with the corpus is shuffled, never broadcast, at any size
    sets = texts.join(clusters.withColumn("cluster", F.xxhash64("cluster.doc", "cluster.tag")).hint("merge"), ["doc", "tag"]).dropDuplicates(["doc", "tag"])
    sets = written(sets.select("cluster", "doc", "tag", "text").mapInArrow(_sets, "cluster long, doc long, tag long, shingles binary"), "sets")
    weight = sets.groupBy("cluster").agg(F.count("*").alias("rows"), F.sum(F.octet_length("shingles") / 8).alias("shingles_in"))
    large = weight.where((F.col("rows") > CLUSTER_ROWS) | ((F.col("rows") > 16) & (F.col("shingles_in") > CLUSTER_SHINGLES))).select("cluster")
    large = written(large, "large")
    spark = docs.sparkSession
    fits = sets.join(large.hint("merge"), "cluster", "left_anti").repartition(partitions(spark), "cluster").sortWithinPartitions("cluster", "doc", "tag")
    found = _ends(fits.mapInArrow(_cluster_edges(percent), _EDGES), "head", "component")
    if large.limit(1).count():
        big = written(sets.join(large.hint("merge"), "cluster", "left_semi").drop("cluster"), "large_sets")
        found = found.unionByName(components(written(large_links(big, percent), "links")).select(F.col("node").alias("head"), "component"))
    known = heads.join(found.hint("merge"), "head", "left").select("n", "whole", "held", F.coalesce("component", "head").alias("component"))
    out = looked_up(some.select("doc", "tag", "n", "whole"), written(known, "known"), ["n", "whole"], "held", total)
    none = signed.where(F.col("n") == 0).select("doc", "tag", F.col("n").alias("n_shingles"), F.struct("doc", "tag").alias("component"))
    return out.select("doc", "tag", F.col("n").alias("n_shingles"), "component").unionByName(none)


def op6(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs; nulls and repeats as near_duplicates() has them."""
    out = near_duplicates(docs)
    return out.select(back_to_id("doc").alias("doc_id"), "n_shingles", back_to_id("component.doc").alias("component_id"), (F.col("doc") == F.col("component.doc")).alias("kept"))


def brute_force(rows, percent: int = 85):
    """doc_id -> (n_shingles, component_id) by comparing all pairs, for tests."""
    import re

    def shingles(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        x = re.findall(r"[^\x20\x09-\x0D]+", lower)
        return {tuple(x[i : i + SHINGLE]) for i in range(max(1, len(x) - SHINGLE + 1))} if x else set()

    sets = {d: shingles(t) for d, t in rows}
    where: dict = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for d, s in sets.items():
        shared: dict = {}
        for x in s:
            for e in where[x]:
                if e < d:
                    shared[e] = shared.get(e, 0) + 1
        for e, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[e]) - k):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}
