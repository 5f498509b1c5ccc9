import hashlib
import random
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import ann, chat, components, decontam, langid, line_dedup, minhash_forest, mixing, queries, substring_dedup, suffix_dedup, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, doc string, k int"


def corpus(seed=1):
    """Small texts with copies, near copies, nulls, blanks, repeats and columns whose names clash."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 5)))
    text = lambda n: " ".join(word() + rng.choice(["", "", ",", ".\n"]) for _ in range(n))
    rows = [text(rng.randint(1, 120)) for _ in range(25)]
    base = text(150)
    for _ in range(12):
        w = base.split(" ")
        w[rng.randrange(len(w))] = word()
        rows.append(" ".join(w))
    rows += [rows[0], rows[0], base, base, None, "", "   \n\t", "a a a " * 90, text(3000), "x", "12 34"]
    return [(i, t, None if t is None else rng.choice(["en", "fr"]), rng.choice(["s1", "s2", None]), 0, "clash", i) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows + rows[:3], DOCS).repartition(3)


def test_substrings_against_brute_force(spark, docs, rows):
    wanted = substring_dedup.brute_force([r[:2] for r in rows], 20)
    for r in substring_dedup.remove_repeats(docs, 20).collect():
        assert (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) == wanted[r.doc_id]


def test_suffix_automaton():
    a = substring_dedup.SuffixAutomaton()
    for s in ("abcbc", "bca"):
        a.add(s)
    assert a.matching_statistics("xbcbca") == [0, 1, 2, 3, 4, 3]
    assert substring_dedup.matched_spans(a, "zbcbz", 2) == [(1, 2)]


@pytest.mark.parametrize("length", [50, 400])
def test_suffix_spans_against_brute_force(spark, docs, rows, length, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "K", length // 2)
    wanted = suffix_dedup.brute_force([r[:2] for r in rows], length)
    for r in suffix_dedup.remove_repeats(docs, length).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) == wanted[r.doc_id]


def test_suffix_array_sorts():
    rng = random.Random(2)
    for sigma, n in [(1, 30), (2, 300), (4, 900), (26, 2000), (200, 800)]:
        t = np.append(np.array([rng.randint(1, sigma) for _ in range(n)], np.uint8), np.uint8(0))
        s = t.tobytes()
        assert suffix_dedup.suffix_array(t, sigma + 1).tolist() == sorted(range(n + 1), key=lambda i: s[i:])


def test_near_duplicates_against_brute_force(spark, docs, rows):
    wanted = minhash_forest.brute_force([r[:2] for r in rows])
    for r in minhash_forest.op6(docs).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (*wanted[r.doc_id], r.doc_id == wanted[r.doc_id][1])


@pytest.mark.parametrize("limits", [{}, {"LARGE": 8}, {"LARGE": 8, "CLUSTER_ROWS": 8, "CLUSTER_SHINGLES": 1}])
def test_crowded_regions_and_large_clusters(spark, docs, rows, limits, monkeypatch):
    for k, v in limits.items():
        monkeypatch.setattr(minhash_forest, k, v)
    wanted = minhash_forest.brute_force([r[:2] for r in rows])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_forest.op6(docs).collect()} == wanted


@pytest.mark.parametrize("limit", [4096, 50])
def test_twins_in_a_crowd(spark, limit, monkeypatch):
    monkeypatch.setattr(minhash_forest, "CLUSTER_ROWS", limit)
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**9)}"
    core = [word() for _ in range(1004)]
    texts = []
    for _ in range(60):  # all share the core; only twins pass the threshold
        pair = [word() for _ in range(9)]
        texts += [" ".join(core + pair + [word() for _ in range(85)]) for _ in range(2)]
    wanted = minhash_forest.brute_force(list(enumerate(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_forest.op6(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == wanted and len({c for _, c in got.values()}) == 60


def test_cluster_groups_are_exact():
    rng = np.random.default_rng(3)
    for m in (5, 40):
        base = rng.integers(0, 400, 200)
        sets = [np.unique(np.where(rng.random(200) < 0.08, rng.integers(0, 400, 200), base)).astype(np.uint64) for _ in range(m)]
        got = minhash_forest.cluster_groups(sets, 80)
        near = [[100 * len(set(x.tolist()) & set(y.tolist())) >= 80 * len(set(x.tolist()) | set(y.tolist())) for y in sets] for x in sets]
        root = list(range(m))
        for _ in range(m):
            root = [min(root[j] for j in range(m) if near[i][j]) for i in range(m)]
        assert got.tolist() == root


def test_rows_of_one_id_or_none_are_documents_of_their_own(spark):
    rng = random.Random(13)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, c = text(120), text(120), text(120)
    for rows in ([(1, a), (None, a), (None, b), (None, c)], [(1, a), (2, a), (2, b), (2, c)]):
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert sorted(r.n_removed for r in substring_dedup.remove_repeats(d).collect()) == [0, 0, 0, 120]
        assert sorted(r.n_removed > 0 for r in suffix_dedup.remove_repeats(d).collect()) == [False, False, True, True]
        near = minhash_forest.near_duplicates(d, 80)
        assert near.where(F.struct("doc", "tag") == F.col("component")).count() == 3
        assert {r.text for r in line_dedup.dedup_lines(d).collect()} == {a, b, c, ""}
        items = spark.createDataFrame([(7, b)], "item_id long, text string")
        assert decontam.contaminated(d, items).count() == 1


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    root = list(range(200))
    for _ in range(200):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: root[n] for e in edges for n in e if e[0] != e[1]} | {n: got[n] for n in got if n not in {x for e in edges if e[0] != e[1] for x in e}}


def test_lines_against_brute_force(spark, docs, rows):
    gone = {(r.doc, r.line_no): (r.kept_doc, r.kept_line) for r in line_dedup.removed_lines(docs).collect()}
    lines = {(r[0], i): " ".join(x.split()).lower() for r in rows if r[1] is not None for i, x in enumerate(r[1].split("\n")) if x.strip()}
    first: dict = {}
    for at in sorted(lines):
        first.setdefault(lines[at], at)
    for at, norm in lines.items():  # equal lines: all but one go
        if first[norm] != at:
            assert at in gone
    for at, kept in gone.items():
        assert kept < at and kept not in gone
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_chat_tree_and_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "\\<|im_end|>\\\\[\\INST]", "", None, "a\nb<|im_sep|>"]
    rows = [(1, 1, None, "user", hard[0], 1.0), (1, 2, 1, "assistant", hard[1], 5.0), (1, 3, 1, "assistant", "worse", 0.0), (1, 4, 2, "user", hard[4], 1.0), (1, 5, 4, "assistant", hard[2], 1.0), (2, 1, 99, None, hard[3], None), (3, 1, 2, "user", "loop", 1.0), (3, 2, 1, "user", "loop", 1.0)]
    df = spark.createDataFrame(rows, "conv long, node long, parent long, role string, text string, score double")
    paths = chat.branches(df, top=2)
    got = {}
    for r in paths.collect():
        got.setdefault((r.conv, r.rank), []).append((-r.step, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {(1, 1): [1, 2, 4, 5], (1, 2): [1, 3], (2, 1): [1]}
    out = {(r.conv, r["rank"]): r for r in chat.read_back(chat.formatted(paths, df)).collect()}
    assert [(t.role, t.text) for t in out[1, 1].turns] == [("user", hard[0]), ("assistant", hard[1]), ("user", hard[4]), ("assistant", "")]
    assert out[1, 1].loss_text == hard[1] and out[1, 2].loss_text == "worse" and [tuple(t) for t in out[2, 1].turns] == [("", "")]
    body = re.sub(r"<\|im_(start|sep|end)\|>", "", out[1, 1].formatted)
    assert "[INST]" not in body and "</s>" not in body


def test_neighbours_recall(spark, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    extra = spark.createDataFrame([(10_000, None), (10_001, [0.0] * 64), (10_002, [float("nan")] * 64), (10_003, [None] * 64), (10_004, [1.0])], "id long, v array<float>")
    rows = [(r.id, r.v) for r in v.collect()]
    wanted = {(a, b): s for a, _, b, s in ann.brute_force(rows, {i for i, _ in rows if i % 100 == 0})}
    got = ann.search(v.unionByName(extra), v.where("id % 100 = 0"), 10).collect()
    hit = [r for r in got if (r.query_id, r.vec_id) in wanted]
    assert len(got) == len(wanted) and len(hit) >= 0.9 * len(wanted)
    assert all(abs(r.score - wanted[r.query_id, r.vec_id]) < 1e-12 for r in hit)


def test_language_backs_off_and_rejects(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog are in the house", "en"), ("der hund und die katze sind im haus", "de")] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    tests = spark.createDataFrame([(1, None), (2, "12 ... 34"), (3, "THE HOUSE"), (4, "hunde"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(tests, model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5)] == ["und", "und", "en", "de", "und"] and all(0 <= s <= 1 for _, s in got.values())
    assert langid.fit(docs.where("lang is null")) is None


def test_mixture_targets(spark, docs):
    got = mixing.mix(docs).collect()
    total = sum(r.size for r in got)
    assert len(got) == docs.count() and all(r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6
    for v in by.values():
        assert v[0].target <= 3 * v[0].source_size and abs(sum(r.taken for r in v) - v[0].target) <= max(r.size for r in v)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_decontamination_against_brute_force(spark, docs, rows):
    item = "one two three four five six. seven eight nine ten eleven twelve."
    items = [(1, item), (2, None), (3, ""), (4, "ab cd ee"), (5, "only words that stand nowhere else at all here")]
    own = [*rows, (900, "zz " * 70 + item + " yy" * 50, "en", "s", 0, "", 0), (901, item[:30], "en", "s", 0, "", 0)]
    df = spark.createDataFrame(own, DOCS)
    got = {(r.doc, r.item_id) for r in decontam.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == decontam.brute_force([r[:2] for r in own], items) and (900, 1) in got and (901, 1) not in got


class _Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")

    def handle_data(self, text):
        if not self.skip:
            self.out.append(text)


def test_warc_records(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = warc.derivatives(pages).collect()
    assert len(got) == 2 * len(html)
    for r in got:
        (head, block), = warc.parse(bytes(r.record))
        assert head["WARC-Type"] == r.kind and head["WARC-Refers-To"] == r.refers_to and int(head["Content-Length"]) == len(block) == r.content_length
        assert head["WARC-Block-Digest"] == warc.digest(block) and r.source_digest == warc.digest(html[r.page_id].encode())
        if r.kind == "conversion":
            p = _Plain()
            p.feed(html[r.page_id])
            assert "".join(block.decode().split()) == "".join("".join(p.out).split())
    odd = spark.createDataFrame([(1, None, None), (None, "u", "<p>a&amp;b<script>x</script>")], "page_id long, url string, html string")
    assert {bytes(r.record).endswith(b"a&b\r\n\r\n") for r in warc.derivatives(odd).where("kind = 'conversion'").collect()} == {True, False}


def test_hidden_parts_of_pages_in_one_scan():
    plain = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>", re.S | re.I)
    rng = random.Random(14)
    bits = ["<script>", "</script>", "<STYLE a=b>", "</style >", "<!--", "-->", "<", ">", "x", " ", "<p>", "</Script", "<template"]
    for _ in range(3000):
        page = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        assert warc.without_hidden(page) == plain.sub("", page), page
    for bit in ("<script>x ", "<a ", "<script ", "<!-- "):
        begun = time.time()
        warc.plain_text(bit * 40_000)
        assert time.time() - begun < 5


@pytest.mark.parametrize("f", [lambda d: substring_dedup.remove_repeats(d), lambda d: suffix_dedup.remove_repeats(d), minhash_forest.op6, lambda d: line_dedup.removed_lines(d), lambda d: langid.predict(d.select("doc_id", "text"), langid.fit(d))])
def test_empty_table(docs, f):
    assert f(docs.limit(0)).count() == 0


def test_null_id(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in minhash_forest.op6(d).collect()} == {(3, 3, True), (None, 3, False)}


def test_sql_exists_where_it_can():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_edit_distances_of_lines(spark):
    rnd = random.Random(1)
    pairs = []
    for i in range(200):
        x = [rnd.choice("abé ß") for _ in range([0, 1, 5, 30, 100, 700, 1500][i % 7])]
        y = list(x)
        for _ in range(rnd.choice([0, 1, 3, len(x) // 5, len(x) // 3])):
            k = rnd.randrange(len(y) + 1)
            y[k : k + rnd.randrange(2)] = rnd.choice(["", "q", "éé"])
        pairs.append(("".join(x), "".join(y)))
    df = spark.createDataFrame(pairs, "x string, y string")
    found = df.select(F.levenshtein("x", "y").alias("exact"), line_dedup.trimmed(F.col("x"), F.col("y")).alias("d"), line_dedup.word_edits(F.col("x"), F.col("y")).alias("words")).collect()
    assert all(r.exact == r.d == r.words for r in found)


def test_recall_of_near_lines_against_all_pairs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(400)
    gone = {(r.doc, r.line_no): (r.kept_doc, r.kept_line) for r in line_dedup.removed_lines(rows).collect()}
    first: dict = {}
    for r in rows.collect():
        for i, x in enumerate((r.text or "").split("\n")):
            if n := " ".join(x.split()).lower():
                first[n] = min(first.get(n, (r.doc_id, i)), (r.doc_id, i))
    short = sorted(n for n in first if len(n) <= 160)
    pairs = []
    for i, x in enumerate(short):
        for y in short[:i]:
            if abs(len(x) - len(y)) <= max(len(x), len(y)) // 5 and len(set(x) & set(y)) >= 0.7 * min(len(set(x)), len(set(y))) and (set(x.split()) & set(y.split()) or len(x) < 30):
                pairs.append((x, y))
    df = spark.createDataFrame(pairs, "x string, y string").repartition(8)
    near = df.where(F.levenshtein("x", "y") <= F.floor(F.greatest(F.char_length("x"), F.char_length("y")) * 0.2)).collect()
    kept = lambda n: gone.get(first[n], first[n])
    found = sum(kept(r.x) == kept(r.y) for r in near)
    lost = [(r.x, r.y) for r in near if kept(r.x) != kept(r.y)]
    assert len(near) >= 10 and found >= 0.9 * len(near), lost


def test_near_lines_are_found_without_simhash(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(3, 8)))
    texts = []
    for n in [1, 2, 3, 8, 12, 20, 40] * 8:  # one word, or a letter, replaced in lines of any length
        x = [word() + word() if n < 3 else word() for _ in range(n)]
        y = list(x)
        at = rnd.randrange(n)
        y[at] = word() if n >= 8 else y[at][:-1] + "é"
        if distance(" ".join(x), " ".join(y)) <= max(len(" ".join(x)), len(" ".join(y))) // 5:
            texts += [" ".join(x), " ".join(y)]
    gone = {r.doc: r.kept_doc for r in line_dedup.removed_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = sum(gone.get(i + 1) == i for i in range(0, len(texts), 2))
    assert len(texts) > 90 and found >= 0.97 * len(texts) / 2


def test_large_bucket_is_compared_in_full(spark):
    rnd = random.Random(6)
    head = "".join(rnd.choices("abcdefgh ", k=60))
    tails = ["".join(rnd.choices("ijklmnopqrstuvw ", k=60)) for _ in range(40)]
    texts = [head + t for t in tails] + [head + t[:-1] + "é" for t in tails]  # all share keys, only twins are near
    gone = {r.doc: r.kept_doc for r in line_dedup.removed_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert gone == {i + 40: i for i in range(40)}


def bridged(spark, copies, families):
    rng = random.Random(11)
    rows, tests = [], []
    for f in range(families):
        x = [f"{f}w{rng.randrange(10**6)}" for _ in range(700)]
        base = len(rows)
        rows.append(" ".join(x))
        for _ in range(copies):
            y = list(x)
            y[rng.randrange(700)] = f"n{rng.randrange(10**9)}"
            rows.append(" ".join(y))
        # d is near c and the full text, c is near d only
        rows += [" ".join(x[:693]), " ".join(x[:592])]
        tests.append((base, len(rows) - 1))
    out = {r.doc_id: r.component_id for r in minhash_forest.op6(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    return [out[a] == out[b] for a, b in tests]


def test_link_that_bypasses_the_hub(spark):
    assert all(bridged(spark, 60, 10))


def test_every_text_of_an_item_id_is_found(spark):
    rnd = random.Random(8)
    texts = [" ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(n)) for n in (20, 30, 25, 22)]
    items = spark.createDataFrame(list(zip([1, 1, None, 2], texts, strict=True)), "item_id long, text string")
    docs = spark.createDataFrame([(i, "some words " + t + " and more") for i, t in enumerate(texts)], "doc_id long, text string")
    assert {(r.doc, r.item_id) for r in decontam.contaminated(docs, items).collect()} == {(0, 1), (1, 1), (2, None), (3, 2)}


def test_lines_of_one_word_set_and_very_long_lines(spark):
    rnd = random.Random(9)
    w = ["".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(12)]
    a, b = " ".join(sorted(w)), " ".join(sorted(w, reverse=True))
    c = " ".join([*sorted(w, reverse=True)[:-2], *sorted(w)[:2]])  # the words of a and b, near b only
    long_ = [f"w{rnd.randrange(10**6)}" for _ in range(9000)]
    other = [*long_[:4000], "changed", *long_[4001:]]
    docs = spark.createDataFrame([(0, a), (1, b), (2, c), (3, " ".join(long_)), (4, " ".join(other))], "doc_id long, text string")
    assert {(r.doc, r.kept_doc) for r in line_dedup.removed_lines(docs).collect()} == {(2, 1), (4, 3)}


def test_items_of_few_words_are_whole_texts(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "The!"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the"), (2, None), (3, "")], "item_id long, text string")
    assert [(r.doc, r.item_id) for r in decontam.contaminated(docs, items).collect()] == [(2, 1)]
    assert decontam.contaminated(docs, items.limit(0)).count() == 0 == decontam.contaminated(docs.limit(0), items).count()


def test_number_signs_are_no_letters():
    assert langid.words_of("² ½ ① 12 _") == [] and langid.words_of("Aé²b Ωm") == ["aé", "b", "ωm"]


def test_very_long_lines_are_near_by_characters(spark):
    rnd = random.Random(12)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(900)]
    other = [w if i < 630 else w[:2] + "z" + w[3:] for i, w in enumerate(words)]  # 30% of the words, 5% of the characters
    far = [w if i < 630 else "".join(rnd.choices("qrstuvwxyz", k=6)) for i, w in enumerate(words)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([words, other, far])], "doc_id long, text string")
    assert {(r.doc, r.kept_doc) for r in line_dedup.removed_lines(docs).collect()} == {(1, 0)}


def test_distances_within_a_limit(spark):
    pairs = [("abcdefghij" * 3, "abcdefghij" * 2 + "abXdefghYj"), ("abcdefghij" * 3, "zyxwvutsrq" * 3), ("é" * 20, "é" * 16), ("a b" * 2000, "a c" * 2000)]
    df = spark.createDataFrame(pairs, "x string, y string")
    found = df.select(F.levenshtein("x", "y").alias("exact"), F.floor(F.length("x") * 0.2).cast("int").alias("lim"), line_dedup.trimmed(F.col("x"), F.col("y"), F.floor(F.length("x") * 0.2).cast("int")).alias("d")).collect()
    assert all(r.d == (r.exact if r.exact <= r.lim else -1) for r in found)


def test_candidates_that_meet_the_threshold_are_linked(spark):
    rnd = random.Random(13)
    texts = []
    for _ in range(40):
        words = ["".join(rnd.choices("abcdefghijklmnop", k=7)) for _ in range(36)]
        texts += [" ".join(words), " ".join(w[:3] + "z" + w[4:] if i % 5 < 3 else w for i, w in enumerate(words))]  # 60% of the words, 8% of the characters
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sketches = {r.doc: set(r.sketch) for r in line_dedup.lines(docs).collect()}
    candidates = [i for i in range(0, 80, 2) if len(sketches[i] & sketches[i + 1]) > 1 and distance(texts[i], texts[i + 1]) <= max(len(texts[i]), len(texts[i + 1])) // 5]
    gone = {r.doc: r.kept_doc for r in line_dedup.removed_lines(docs).collect()}
    assert candidates and all(gone.get(i + 1) == i for i in candidates)


def test_counts_of_characters_rule_out_only_what_is_far(spark):
    rnd = random.Random(14)
    pairs = []
    for i in range(300):
        x = [rnd.choice(["ab ", "etaoin srh.", "жé漢b "][i % 3]) for _ in range([0, 1, 30, 100, 400][i % 5])]
        y = list(x)
        for _ in range(rnd.choice([0, 1, 3, len(x) // 5, len(x)])):
            k = rnd.randrange(len(y) + 1)
            y[k : k + rnd.randrange(2)] = rnd.choice(["", "q", "漢e"])
        pairs.append(("".join(x), "".join(y)))
    pairs += [("a" * 3000, "a" * 2500), ("a" * 3000, "e" * 3000), ("e" * 64, "t" * 64), ("t" * 64, "e" * 60)]
    df = spark.createDataFrame(pairs, "x string, y string").select("x", "y", line_dedup.bag(F.col("x")).alias("b"), line_dedup.bag(F.col("y")).alias("c"))
    found = df.select(F.levenshtein("x", "y").alias("exact"), line_dedup.least_edits(F.col("b"), F.col("c"), F.char_length("x"), F.char_length("y")).alias("least")).collect()
    assert all(0 <= r.least <= r.exact for r in found)
    assert [r.least for r in found[-4:]] == [0, 2047, 64, 64] and sum(r.least == r.exact for r in found) > 60


def test_crowded_buckets_are_dealt_in_full_and_carry_little(spark, monkeypatch):
    rnd = random.Random(6)
    head = "".join(rnd.choices("abcdefgh ", k=60))
    texts = [head + "".join(rnd.choices("ijklmnopqrstuvw ", k=60)) for _ in range(40)]
    texts += [t[:-1] + "é" for t in texts]  # all share keys, only twins are near
    tables = {}
    written, deal = line_dedup.written, line_dedup.dealt
    monkeypatch.setattr(line_dedup, "written", lambda df, name: tables.setdefault(name, (df[0] if isinstance(df, list) else df).columns) and written(df, name))
    monkeypatch.setattr(line_dedup, "dealt", lambda groups, tasks: deal(groups, tasks).withColumn("rows", F.lit(3)).withColumn("cols", F.lit(2)))
    gone = {r.doc: r.kept_doc for r in line_dedup.removed_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert gone == {i + 40: i for i in range(40)}
    # neither sketches of all lines nor texts of each bucket are put on disk
    assert not {"sketch", "keys", "norm"} & {*tables["lines"]} and not {"norm", "bag", "k"} & {*tables["mixed"]}
    # lines are carried to the root of so many tasks, in a bucket ten times as large to no more
    for n in (20_000, 200_000):
        r = deal(spark.createDataFrame([(1, 2, n, n // 2, 2e4 * n * n)], "key long, most long, n long, few long, cells double"), 32).collect()[0]
        assert r.rows * r.cols >= 32 and n * r.rows + n // 2 * r.cols <= 10 * n
