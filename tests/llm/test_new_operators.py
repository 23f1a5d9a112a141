"""The prefix trie, min-max hashing and fill-in-middle against SQL and brute force, and on awkward tables."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketloom.llm import common, decontamination, fill_in_middle, minmax_dedup, prefix_trie, registry

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def sql_rows(name, sf_dir, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    return sorted((dict(zip(columns, r, strict=True)) for r in got.fetchall()), key=str)


def rows_of(frame, columns):
    return sorted(({c: r[c] for c in columns} for r in frame.collect()), key=str)


def fim_by_hand(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_fill_in_middle_is_its_sql(spark, sf_dir):
    want = sql_rows("op13_fill_in_middle", sf_dir, "documents")
    assert rows_of(registry.queries()["op13_fill_in_middle"](spark, sf_dir), want[0]) == want


def test_fill_in_middle_of_awkward_texts(spark):
    texts = ["", None, "a", "<P> held", "x<M>", "<S", "äöü 𝒳𝒴 ab", "\n\n\t", "<P", "word " * 50_000, "ß" * 999, "a<b>c <<S", "日本語 text", "\x00\x01"]
    rows = [(i if i != 5 else None, t) for i in range(40) for t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as form", "2 as output", "3 as pieces", "4 as `x.y`")
    got = fill_in_middle.fill_in_middle(docs).collect()
    assert len(got) == len(rows)
    want = sorted(((i, *fim_by_hand(i, t), t or "") for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, None) for r in got), key=str) == sorted(((*w[:-1], None) for w in want), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted((str(r.doc_id), r.output_sha256, r.restored_sha256) for r in got) == sorted((str(w[0]), sha(w[5]), sha(w[6])) for w in want)
    assert fill_in_middle.fill_in_middle(docs.filter("doc_id = -1")).count() == 0


def test_pieces_cut_arrange_and_restore():
    text, marks = "prefix and middle and suffix".encode(), tuple(m.encode() for m in fill_in_middle.SENTINELS)
    for a in range(len(text) + 1):
        for b in range(a, len(text) + 1):
            parts = fill_in_middle.cut([fill_in_middle.Piece(fill_in_middle.TEXT, 0, len(text))], a)
            parts = [parts[0], *fill_in_middle.cut(parts[1:], b - a)]
            for form in fill_in_middle.ORDERS:
                made = b"".join(fill_in_middle.stream(fill_in_middle.arrange(parts, form, (3, 3, 3)), (text, *marks)))
                assert len(made) == len(text) + 9
                assert b"".join(fill_in_middle.stream(fill_in_middle.restore(made, form, marks), (made,))) == text


def trie_by_hand(rows):
    """Nodes of a trie over rebuilt conversations, from plain dictionaries."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    found = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            node = found.setdefault(whole[:d], [set(), []])
            node[0].add(c)
            if d == len(whole):
                node[1].append(c)
    kids = {p: sum(1 for q in found if len(q) == len(p) + 1 and q[: len(p)] == p) for p in found}
    out = []
    for p, (held, ends) in found.items():
        below = [q for q in found if q[: len(p)] == p]
        saved = sum((len(found[q][0]) - 1) * len(q[-1][1]) for q in below if q)
        sha = hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest()
        out.append((min(held), len(p), min(found[p[:-1]][0]) if p else None, len(held), kids[p], sum(not kids[q] for q in below), saved, sha))
    return sorted(out, key=str)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_prefix_trie_is_its_sql(spark, sf_dir):
    want = sql_rows("op11_prefix_trie", sf_dir, "conversations")
    assert rows_of(registry.queries()["op11_prefix_trie"](spark, sf_dir), want[0]) == want


@pytest.mark.parametrize("size", [1, 2, 3, 7, 16_384])
def test_prefix_trie_over_any_blocks(spark, size):
    """Few different turns, so that prefixes are shared at all depths and leave their blocks; any block size gives the same."""
    rng = np.random.default_rng(size)
    rows = []
    for c in rng.choice(1_000, 150, replace=False).tolist():
        for t in range(int(rng.integers(1, 8))):
            rows.append((c, t, ["user", "assistant", None][int(rng.integers(3)) if rng.random() < 0.1 else t % 2], f"text {rng.integers(2)}"))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r[c] for c in TRIE) for r in prefix_trie.prefix_trie(frame, size).collect()), key=str)
    assert got == trie_by_hand(rows)


def test_prefix_trie_of_awkward_rows(spark):
    rows = [(5, None, None, None), (5, None, None, None), (5, 1, "user", ""), (7, 0, "user", "a"), (7, 0, "user", "a"), (None, 0, "user", "x"), (-3, 2, "user", "b"), (200, 0, "u", "c" * 5000)]
    rows += [(201, 0, "u", "d"), (202, 0, "u", "d"), (203, 0, "u", "d"), (204, 0, "u", "d"), (100, 0, "ab", "c"), (101, 0, "a", "bc")] + [(300, t, "u", f"{t}") for t in range(300)]
    rows += [(c, 0, "user", "hot") for c in range(1_000, 1_400)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as n", "2 as block", "3 as h", "4 as p", "5 as `x.y`")
    want = trie_by_hand([r for r in rows if r[0] is None or r[0] >= 0])
    got = prefix_trie.prefix_trie(frame.filter("conv_id is null or conv_id >= 0"), 50)
    assert sorted((tuple(r[c] for c in TRIE) for r in got.collect()), key=str) == want
    assert prefix_trie.prefix_trie(frame.filter("conv_id = -3")).filter("depth = 0").count() == 1
    assert prefix_trie.prefix_trie(frame.filter("conv_id = -7")).count() == 0


def test_members_are_hashed_in_order_over_many_texts(spark):
    ids = spark.range(1_000, 3_000).withColumn("k", F.col("id") % 3).select(F.col("k").alias("k1"), F.col("k").alias("k2"), F.col("id").alias("conv_id"))
    for r in prefix_trie.members(ids, 7).collect():
        held = [i for i in range(1_000, 3_000) if i % 3 == r.k1]
        assert (r.least, r.n) == (held[0], len(held)) and r.sha == hashlib.sha256(",".join(map(str, held)).encode()).hexdigest()


WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(common.UPPER, common.UPPER.lower())


def sets_of(texts, k=3):
    for text in texts:
        found = WORD.findall((text or "").translate(LOWER))
        yield {tuple(found[i : i + k]) for i in range(max(1, len(found) - k + 1))} if found else set()


def classes_by_hand(ids, sets, percent=85):
    least = list(range(len(ids)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x, y = root(i), root(j)
                least[max(x, y)] = min(x, y)
    named = {}
    for i, doc_id in enumerate(ids):
        named.setdefault(root(i), []).append(doc_id)
    return [min((d for d in named[root(i)] if d is not None), default=None) if sets[i] else ids[i] for i in range(len(ids))]


@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_minmax_dedup_is_brute_force(spark, sf_dir):
    rows = common.table(spark, sf_dir, "documents").orderBy("doc_id").collect()
    ids, sets = [r.doc_id for r in rows], list(sets_of(r.text for r in rows))
    want = classes_by_hand(ids, sets)
    got = sorted(tuple(r) for r in registry.queries()["op12_minmax_dedup"](spark, sf_dir).collect())
    assert got == [(i, len(s), c, i == c) for i, s, c in zip(ids, sets, want, strict=True)]


def test_minmax_dedup_around_the_threshold(spark):
    """Hundreds of variants in one band each, links at and under 85 percent, chains of links, and a passage that all share."""
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(90)]
    texts = []
    for _ in range(320):
        changed = list(base)
        for at in rng.choice(90, rng.integers(0, 4), replace=False):
            changed[at] = f"r{rng.integers(1e9)}"
        texts.append(" ".join(changed))
    for _ in range(40):  # chains: each differs a little from the one before
        changed = [f"c{rng.integers(1e9)}" for _ in range(60)]
        for _ in range(6):
            changed[int(rng.integers(60))] = f"r{rng.integers(1e9)}"
            texts.append(" ".join(changed))
    texts += [" ".join(base[:45] + [f"u{rng.integers(1e9)}" for _ in range(int(rng.integers(5, 40)))]) for _ in range(80)]
    sets = list(sets_of(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minmax_dedup.near_duplicates(docs).collect()}
    assert got == dict(enumerate(classes_by_hand(list(range(len(texts))), sets)))


def test_minmax_values_agree_as_often_as_sets_are_similar():
    """Both the minima and the maxima estimate the similarity without bias, and together better than the minima alone."""
    rng = np.random.default_rng(7)
    a, b = minmax_dedup.permutations(64)
    errors = {"min": [], "both": []}
    for _ in range(200):
        s = rng.integers(0, 2**64, 150, np.uint64)
        x, y = (minmax_dedup.min_max(t, a, b) for t in (s[:120], s[30:]))
        same = (x == y).reshape(-1, 2)
        errors["min"].append(same[:, 0].mean() - 0.6)
        errors["both"].append(same.mean() - 0.6)
    assert abs(np.mean(errors["min"])) < 0.02 and abs(np.mean(errors["both"])) < 0.015
    assert np.std(errors["both"]) < 0.85 * np.std(errors["min"])


def test_minmax_dedup_of_awkward_rows(spark):
    long_text = " ".join(f"w{i % 977}" for i in range(40_000))
    texts = ["", None, "one", "ONE", "one two", "one two three four", "one two three four", long_text, long_text + " more", " \n\t", "a b c d e f g h i j"]
    rows = list(enumerate(texts)) + [(None, "one two"), (None, None), (None, "alone without an id"), (3, "one two three four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as n", "3 as row", "4 as bands", "5 as `x.y`")
    sets = list(sets_of(t for _, t in rows))
    want = [(i, len(s), c, i == c) for (i, _), s, c in zip(rows, sets, classes_by_hand([i for i, _ in rows], sets), strict=True)]
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minmax_dedup.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert minmax_dedup.near_duplicates(docs.filter("doc_id = -1")).count() == 0


def test_decontamination_doesn_t_depend_on_blocks_of_items(spark, monkeypatch):
    """The same rows, scores and passages with one block of items and with many; repeated document rows stay rows."""
    docs = common.table(spark, SMALL, "documents").select("doc_id", "text")
    items = common.table(spark, SMALL, "benchmark")
    docs = docs.unionByName(docs.filter("doc_id < 5")).unionByName(items.limit(3).select(F.lit(7_000).cast("long").alias("doc_id"), "text")).withColumn("x.y", F.lit(1))
    key = lambda r: (r.doc_id, r.row, r.n_passages, tuple(r.item_ids), round(r.best, 9))
    want = sorted(map(key, decontamination.find_contaminated(docs, items).collect()))
    clean = sorted(map(tuple, decontamination.drop_contaminated(docs, items).collect()))
    assert any(w[3] for w in want) and len(want) == docs.count()
    monkeypatch.setattr(decontamination, "ITEMS", 10)
    assert sorted(map(key, decontamination.find_contaminated(docs, items).collect())) == want
    assert sorted(map(tuple, decontamination.drop_contaminated(docs, items).collect())) == clean


def test_pipeline_stages_take_columns_with_points_in_their_names(spark):
    docs = common.table(spark, SMALL, "documents").limit(60).withColumn("x.y", F.col("doc_id") * 2).withColumn("a`b", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SMALL)
        assert got.columns == docs.columns and all(r["x.y"] == 2 * r.doc_id for r in got.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()
