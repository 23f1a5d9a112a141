"""Every corpus operator against brute force, SQL or held-out labels, and on awkward tables."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketloom.llm import (
    common, decontamination, line_dedup, lm_scoring, mixing, neighbours, ngram_join, quality, registry, sharding, span_dedup, toxicity,
)

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(common.UPPER, common.UPPER.lower())
CLASHING = ["key", "n", "row", "size", "token", "component", "label", "h", "cell", "id", "copies", "_id", "_copies", "a"]


@pytest.fixture(scope="module")
def small(spark):
    return {r.doc_id: r for r in common.table(spark, SMALL, "documents").collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows and names that operators use themselves."""
    long_text = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "", "x"), (2, None, "x"), (None, "a text without an id, said at length, twice", None), (None, None, None),
        (3, "one two three four five six seven eight", "y"), (3, "one two three four five six seven eight", "y"),
        (4, "one two three four five six seven eight", None), (5, " \n\t\n ", "y"), (6, long_text, "x"), (7, long_text, "x"), (8, "one", "z"), (9, "ONE", "z"),
    ]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(7).alias(c) for c in CLASHING])


def empty_like(docs):
    return docs.filter("doc_id = -1").repartition(2)


def components(ids, linked):
    least = {i: i for i in ids}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in linked:
        x, y = root(a), root(b)
        least[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def shingles(text):
    found = WORD.findall((text or "").translate(LOWER))
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def auc(pairs):
    good = [s for s, y in pairs if y]
    bad = [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_ngram_join_is_brute_force(spark, small):
    sets = {i: shingles(r.text) for i, r in small.items()}
    ids = sorted(sets)
    linked = [
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    want = components(ids, linked)
    got = registry.queries()["op2_ngram_join"](spark, SMALL).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(sets[i]), want[i]) for i in ids}


def test_ngram_join_finds_every_link_around_the_threshold(spark):
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(60)]
    texts = []
    for _ in range(160):  # variants with one to four words changed, and a passage that unlike texts share
        words = list(base)
        for at in rng.choice(60, rng.integers(1, 5), replace=False):
            words[at] = f"r{rng.integers(1e9)}"
        texts.append(" ".join(words))
    texts += [" ".join(base[:30] + [f"u{rng.integers(1e9)}" for _ in range(int(rng.integers(6, 40)))]) for _ in range(80)]
    sets = [shingles(t) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = components(range(len(sets)), linked)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.join_similar(docs).collect()} == want


def test_line_dedup_is_its_sql(spark):
    got = registry.queries()["op3_line_dedup"](spark, SMALL).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(line_dedup.ORACLE_SQL).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_neighbours_recall_and_scores(spark):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in common.table(spark, MIDDLE, "embeddings").collect()}
    ids = np.array(sorted(vectors))
    matrix = np.stack([vectors[i] for i in ids])
    got = registry.queries()["op4_neighbours"](spark, MIDDLE).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        scores = matrix @ vectors[q]
        scores[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]]
        rows = sorted(found[q], key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, 21))
        assert all(abs(r.score - vectors[r.vec_id] @ vectors[q]) < 1e-9 for r in rows)
        hits, total = hits + len({r.vec_id for r in rows} & set(best)), total + 20
    assert hits >= 0.9 * total


def test_neighbours_with_repeated_rows_and_ids(spark):
    """Repeats of one row, one id with several vectors, ties, and columns that clash with names of the operator's own."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 8)).round(3).tolist()
    rows = [(0, x[0])] * 3 + [(1, x[1])] * 40 + [(i, x[i]) for i in range(2, 40)] + [(2, x[3]), (50, x[39]), (51, x[39])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2.0 as score", "3 as v", "4 as part")
    got = neighbours.nearest(frame).orderBy("query_id", "rank").collect()
    for q in (0, 20):
        best: dict = {}
        for i, v in rows:
            if i != q:
                best[i] = max(best.get(i, -9e9), float(np.dot(x[q], v)))
        due = sorted(((round(-s, 12), i) for i, s in best.items()))[:20]
        mine = [(r.rank, r.vec_id) for r in got if r.query_id == q]
        assert [m[0] for m in mine] == list(range(1, 21))
        found = [m[1] for m in mine]
        assert len(set(found) & {i for _, i in due}) >= 17 and len(set(found)) == 20
        assert found == [i for _, i in sorted((round(-best[i], 12), i) for i in found)]


def test_neighbours_visit_less_of_a_larger_table():
    """Recall and the share of vectors met, on clustered vectors of two sizes."""
    shares = []
    for n in (2000, 40_000):
        rng = np.random.default_rng(n)
        x = rng.standard_normal((n // 50, 32))[rng.integers(0, n // 50, n)] + 0.4 * rng.standard_normal((n, 32))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        hasher = neighbours.Hasher(32, 1.0 + 1e-9, neighbours._reach(x[:4096], 1.0, 20, n), n)
        slots, q = hasher.slots(x), np.arange(200)
        logp, cuts = hasher.chances(x[q])
        inner = x[q] @ x.T
        inner[q, q] = -9
        true = np.argsort(-inner, axis=1)[:, :20]
        found, met = [set() for _ in q], 0
        for t in range(neighbours.TABLES):
            split = neighbours.Split([{"ids": np.arange(n).tobytes(), "vectors": x.tobytes(), "hashed": np.ascontiguousarray(slots[:, t]).tobytes()}], 32, hasher.hashes)
            chances = np.concatenate((logp[:, t].reshape(len(q), -1), cuts[:, t, None]), axis=1).astype(np.float32)
            who, ids, _, some = split.search(q, x[q], chances, 20)
            met += some
            for i, j in zip(who.tolist(), ids.tolist()):
                found[i].add(j)
        assert np.mean([len(found[i] & set(true[i].tolist())) / 20 for i in q]) >= 0.9
        shares.append(met / neighbours.TABLES / len(q) / n)
    assert shares[1] < 0.2 and shares[1] < 0.7 * shares[0]


def test_neighbours_leave_unusable_vectors_out(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [0.5, 0.5]), (20, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(vectors).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 6), (0, 3, 20), (20, 1, 1), (20, 2, 6), (20, 3, 0)]
    assert neighbours.nearest(vectors.filter("vec_id = 2")).count() == 0


def test_span_dedup_removes_a_long_sentence_between_other_sentences(spark):
    passage = " ".join(["ends here with five words."] + [" ".join(f"shared{i}" for i in range(50)) + "."] + ["And then begins so"])
    texts = [f"Text {i} says alpha{i} beta{i} and {passage} gamma{i} until delta{i} comes. The last one is of text {i}." for i in range(3)]
    docs = spark.createDataFrame([*enumerate(texts), (3, passage.split(". ")[0] + ". Short one.")], "doc_id long, text string")
    got = {r.doc_id: r for r in span_dedup.dedup_spans(docs).collect()}
    assert got[0].text == texts[0] and got[3].n_removed == 0
    for i in (1, 2):
        assert got[i].n_removed == 1 and "shared" not in got[i].text and f"alpha{i}" in got[i].text and f"gamma{i}" in got[i].text


def test_sharding_has_the_smallest_capacity(spark, small):
    got = sharding.shard(common.table(spark, SMALL, "documents")).collect()
    by_hash = Counter()
    for r in got:
        by_hash[r.h] += r.size
        assert (r.size, r.text_crc32) == (len((small[r.doc_id].text or "").encode()) + 1, zlib.crc32((small[r.doc_id].text or "").encode()))
    assert len({(r.h, r.shard) for r in got}) == len(by_hash)
    load, slots = Counter(), {}
    for r in got:
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [by_hash[h] for h in sorted(by_hash)]

    def needs(capacity):
        n, held = 1, 0
        for s in sizes:
            n, held = (n, held + s) if held + s <= capacity else (n + 1, s)
        return n

    assert needs(max(load.values())) <= 8 and needs(max(max(sizes), max(load.values()) - 1)) > 8 - (max(load.values()) == max(sizes))


def test_mixing_comes_near_its_targets(spark, small):
    got = mixing.mix(common.table(spark, SMALL, "documents")).collect()
    again = mixing.mix(common.table(spark, SMALL, "documents").repartition(3)).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)
    taken, target, largest = Counter(), {}, Counter()
    for r in got:
        assert r.size == len(WORD.findall(small[r.doc_id].text or "")) and 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    assert abs(sum(target.values()) - sum(r.size for r in got)) < 1e-6 * sum(target.values())
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)


def test_language_model_counts_and_gain(spark, small):
    tokens = {i: [*WORD.findall((r.text or "").translate(LOWER)), None] for i, r in small.items()}
    counts = Counter(t for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 10 for t in ts)
    n, v = sum(counts.values()), len(counts)
    got = registry.queries()["op8_lm_scoring"](spark, SMALL).collect()
    assert len(got) == len(small)
    for r in got:
        base = sum(log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens[r.doc_id])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0, len(tokens[r.doc_id]), n)
        assert r.n_known == sum(t in counts for t in tokens[r.doc_id]) and abs(r.base_score - base) < 1e-6 * abs(base) + 1e-6
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_language_model_does_not_depend_on_batches(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in np.minimum(rng.zipf(1.5, 60), 200))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.doc_id: r.score for r in lm_scoring.score_texts(docs.coalesce(1)).collect()}
    many = {r.doc_id: r.score for r in lm_scoring.score_texts(docs.repartition(32)).collect()}
    gaps = [(many[i] - one[i]) / 61 for i in range(600)]
    assert len(one) == len(many) == 600
    assert abs(np.mean(gaps)) < 0.001 and max(map(abs, gaps)) < 0.02


@pytest.mark.parametrize("name, column, least, table", [("op1_toxicity", "toxic", 0.9, MIDDLE), ("op1_toxicity", "toxic", 0.9, LARGE), ("op9_quality", "quality", 0.7, MIDDLE)])
def test_held_out_labels_are_told_apart(spark, name, column, least, table):
    labels = {r.doc_id: r[column] for r in common.table(spark, table, "labels").collect()}
    got = registry.queries()[name](spark, table).collect()
    assert len(got) == common.table(spark, table, "documents").count() and all(0 <= r.score <= 1 for r in got)
    assert auc([(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]) >= least


def test_block_max_search_is_exact():
    """Against all cosines, with terms in the matrix and in posting lists, and with one example left out."""
    rng = np.random.default_rng(3)
    n, terms = 700, 400
    dense = np.where(rng.random((n, terms)) < np.where(np.arange(terms) < 6, 0.5, 0.02), rng.random((n, terms)), 0)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    index = toxicity.BlockMaxIndex(*np.nonzero(dense), dense[np.nonzero(dense)], n, terms)
    assert 0 < index.matrix.shape[1] < 20
    for a in range(0, n, 100):
        skip = np.arange(a, a + 100)
        some = dense[skip]
        near, cosine = index.nearest(*np.nonzero(some), some[np.nonzero(some)], 100, 9, skip)
        want = some @ dense.T
        want[np.arange(100), skip] = -1
        best = np.sort(want, axis=1)[:, ::-1][:, :9]
        assert np.allclose(cosine, np.maximum(best, 0), atol=1e-9)
        assert np.allclose(np.where(near >= 0, np.take_along_axis(want, near, axis=1), 0), cosine, atol=1e-9)


def test_toxicity_is_brute_force(spark, small):
    """Scores of whole texts against dense vectors over all terms; a text that shares only rare words finds its example."""
    labels = {r.doc_id: int(r.toxic == 1) for r in common.table(spark, SMALL, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    docs = common.table(spark, SMALL, "documents")
    model = toxicity.fitted(spark, SMALL, docs)
    texts = {i: Counter(re.findall(r"[^\W\d_]+", (r.text or "").translate(LOWER))) for i, r in small.items()}
    df = Counter(t for c in texts.values() for t in c)
    examples = sorted((y, i) for i, y in labels.items() if i in texts)
    n, rate = len(examples), np.mean([y for y, _ in examples])
    held, hits = Counter(t for _, i in examples for t in texts[i]), Counter(t for y, i in examples if y for t in texts[i])
    weight = {}
    for t, a in held.items():
        z = 0 if a == n else abs(hits[t] - a * rate) / max(a * rate * (1 - rate) * (1 - a / n), 1e-9) ** 0.5
        weight[t] = (np.log((1 + len(texts)) / (1 + df[t])) + 1) * (0.3 + max(z - 3, 0))
    vector = lambda c: {t: (1 + np.log(f)) * weight[t] for t, f in c.items() if t in weight}
    unit = lambda v: {t: x / sum(y * y for y in v.values()) ** 0.5 for t, x in v.items()}
    known = [unit(vector(texts[i])) for _, i in examples]
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i, c in texts.items():
        q = unit(vector(c))
        cosines = sorted(((round(sum(x * e.get(t, 0) for t, x in q.items()), 11), -j) for j, e in enumerate(known)), reverse=True)[:15]
        votes = [(1 / (1 - min(s, 1) + 0.05), examples[-j][0]) for s, j in cosines if s > 0]
        raw = (sum(w * y for w, y in votes) + rate) / (sum(w for w, _ in votes) + 1)
        step = model.values[min(int(np.searchsorted(model.ends, raw - 1e-8)), len(model.values) - 1)]
        assert abs(got[i].score - step) < 1e-9
        assert got[i].nearest[:1] == [examples[-cosines[0][1]][1]] or cosines[0][0] - cosines[1][0] < 1e-9
    rare = min((t for t in held if held[t] == 1), key=lambda t: df[t])
    only = spark.createDataFrame([(1, rare)], "doc_id long, text string")
    assert toxicity.score(only, model).first().nearest == [i for _, i in examples if rare in texts[i]]


def test_decontamination_finds_planted_items_and_nothing_else(spark):
    items = common.table(spark, SMALL, "benchmark")
    texts = [r.text for r in items.orderBy("item_id").limit(5).collect()]
    filler = " ".join(f"word{i}" for i in range(700))
    rows = [(i, f"{filler} {t} {filler}") for i, t in enumerate(texts)] + [(100, filler), (101, None), (102, ""), (103, texts[0].split()[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.item_ids for r in decontamination.find_contaminated(docs, items).collect()}
    assert all(found[i] for i in range(5)) and not any(found[i] for i in range(100, 104))
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(docs, items).collect()) == [100, 101, 102, 103]


def test_decontamination_finds_long_marked_and_one_word_items(spark):
    long_item = " ".join(f"q{i}" for i in range(1500))
    items = spark.createDataFrame([(1, long_item), (2, "aa + bb = cc - dd * ee"), (3, "zyzzogeton")], "item_id long, text string")
    other = " ".join(f"other{i}" for i in range(700))
    rows = [(0, f"{other} {long_item} {other}"), (1, f"{other} aa + bb = cc - dd * ee {other}"), (2, f"{other} zyzzogeton, {other}"), (3, f"{other} - {other}"), (4, "- - -")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontamination.find_contaminated(docs, items).collect()}
    assert got == {0: [1], 1: [2], 2: [3], 3: [], 4: []}


def test_wand_retrieves_what_a_full_scan_does(spark):
    items = [(r.item_id, r.text) for r in common.table(spark, SMALL, "benchmark").collect()]
    index = decontamination.BenchmarkIndex(items)
    rng = np.random.default_rng(1)
    for _ in range(50):
        terms = np.unique(rng.integers(0, len(index.known), int(rng.integers(1, 200))))
        every = decontamination._summed(index.postings, terms, index.n)
        assert {i for i, _ in index.retrieve(terms, 0.2)} == set(np.flatnonzero(every >= 0.2 - 1e-9).tolist())


def test_awkward_rows_have_their_defined_results(spark, awkward):
    n = awkward.count()
    joined = ngram_join.join_similar(awkward).collect()
    assert len(joined) == n
    of = {r.doc_id: r.component_id for r in joined if r.doc_id is not None}
    assert (of[1], of[2], of[4], of[5], of[7], of[9]) == (1, 2, 3, 5, 6, 8)
    lines = line_dedup.dedup_lines(awkward).collect()
    assert len(lines) == n and {r.doc_id: r.n_dropped for r in lines if r.doc_id}[4] == 1
    for result in (
        sharding.shard(awkward), mixing.mix(awkward), span_dedup.dedup_spans(awkward), lm_scoring.score_texts(awkward),
        decontamination.find_contaminated(awkward, common.table(spark, SMALL, "benchmark")),
    ):
        assert result.count() == n
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, None), (99, 1), (None, 1)], "doc_id long, label int")
    scores = toxicity.score(awkward, toxicity.fit(awkward, labels)).collect()
    assert len(scores) == n and all(0 <= r.score <= 1 for r in scores)
    assert len(quality.score(awkward, quality.fit(awkward, labels)).collect()) == n


def test_stages_keep_columns_on_awkward_and_empty_tables(spark, awkward):
    for docs in (awkward, empty_like(awkward)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            assert name == "sharding" or out.columns == docs.columns
            assert out.count() <= 3 * docs.count()


def test_empty_tables_give_no_rows(spark, awkward):
    none = empty_like(awkward)
    labels = spark.createDataFrame([], "doc_id long, label int")
    for result in (
        ngram_join.join_similar(none), line_dedup.dedup_lines(none), sharding.shard(none), mixing.mix(none), span_dedup.dedup_spans(none),
        lm_scoring.score_texts(none), toxicity.score(none, toxicity.fit(none, labels)), quality.score(none, quality.fit(none, labels)),
        decontamination.find_contaminated(none, common.table(spark, SMALL, "benchmark")),
    ):
        assert result.count() == 0


def test_pipeline_keeps_one_of_each_group_and_places_every_row(spark):
    got = corpus_pipeline.run(spark, SMALL).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert got and all(sorted(s) == list(range(len(s))) for s in slots.values())
    kept = {r.doc_id for r in got}
    of = {r.doc_id: r.component_id for r in registry.queries()["op2_ngram_join"](spark, SMALL).collect()}
    bad = {r.doc_id for r in registry.queries()["op10_decontamination"](spark, SMALL).collect() if r.contaminated}
    toxic = {r.doc_id for r in registry.queries()["op1_toxicity"](spark, SMALL).collect() if r.predicted}
    assert not kept & bad and not kept & toxic
    assert not any(i != of[i] and of[i] in kept for i in kept)


def test_near_duplicate_stage_keeps_one_row_of_equal_and_null_ids(spark):
    same, other = "a b c d e f g h i j k l m n o p", "quite another text that is not like the first one at all"
    rows = [(1, same), (1, same), (None, same), (3, same), (1, other), (None, None), (None, None), (5, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _id int")
    got = sorted(corpus_pipeline.near_duplicate_stage(spark, docs, SMALL).collect(), key=str)
    assert got == sorted([(1, same, 1), (1, other, 1), (None, None, 1), (None, None, 1), (5, "", 1)], key=str)


def test_span_dedup_is_brute_force_with_long_sentences(spark, small):
    """The rule as the operator states it: runs of two sentences, and single ones that are long (or the whole text)."""
    seen, want = set(), {}
    for i in sorted(small):
        parts = span_dedup.sentences((small[i].text or "").encode())
        texts = [tuple(p.lower().split()) for p in parts]
        least = span_dedup.LONG if len(parts) >= span_dedup.SPAN else span_dedup.LEAST_WORDS
        runs = [(at, at + 2, (texts[at], texts[at + 1])) for at in range(len(parts) - 1) if len(texts[at] + texts[at + 1]) >= span_dedup.LEAST_WORDS]
        runs += [(at, at + 1, texts[at]) for at in range(len(parts)) if len(texts[at]) >= least]
        gone = set()
        for a, b, name in runs:
            gone.update(range(a, b) if name in seen else ())
            seen.add(name)
        want[i] = (len(parts), len(gone), hashlib.sha256(b"".join(p for n, p in enumerate(parts) if n not in gone)).hexdigest())
    got = registry.queries()["op5_span_dedup"](spark, SMALL).collect()
    assert {r.doc_id: (r.n_sentences, r.n_removed, r.kept_sha256) for r in got} == want
