"""Findings of the third review on the corpus operators."""

import numpy as np

from marketloom.llm import common, components, lm_scoring, toxicity


def small_texts(spark, rows=600):
    rng = np.random.default_rng(7)
    return spark.createDataFrame([(i, " ".join(f"w{x}" for x in np.minimum(rng.zipf(1.5, 60), 200))) for i in range(rows)], "doc_id long, text string")


def test_language_model_of_a_small_table_sends_few_messages(spark, monkeypatch):
    sent, write = [], common.materialize

    def counted(df, tag):
        back = write(df, tag)
        sent.append(back.count())
        return back

    monkeypatch.setattr(common, "materialize", counted)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = lm_scoring.score_texts(small_texts(spark).repartition(4)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 600 and sum(sent) < 40**2


def test_language_model_does_not_depend_on_its_partitions(spark, monkeypatch):
    docs = small_texts(spark).repartition(4)
    one = {r.doc_id: r for r in lm_scoring.score_texts(docs).collect()}
    monkeypatch.setattr(lm_scoring, "PART_BYTES", 1000)
    many = {r.doc_id: r for r in lm_scoring.score_texts(docs).collect()}
    assert all(abs(one[i].base_score - many[i].base_score) < 1e-9 for i in range(600))
    gaps = [(many[i].score - one[i].score) / 61 for i in range(600)]
    assert abs(np.mean(gaps)) < 0.001 and max(map(abs, gaps)) < 0.02


def test_toxicity_looks_up_a_bounded_number_of_entries_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{a}{b}" for a, b in zip(rng.choice(list("abcdefgh"), n), rng.choice(list("xyzuvw"), n))).encode() for n in rng.integers(0, 60, 200)]
    place, hashes, n = toxicity.Terms().counts(texts)
    model = toxicity.Model(np.arange(200), rng.integers(0, 2, 200), place, hashes, n)
    monkeypatch.setattr(toxicity, "LONG", 1)  # one column is in half of the texts or more
    model.complete(np.bincount(model.term, minlength=len(model.known)), 200)
    whole = np.concatenate([s for s, _ in toxicity._scored(model, toxicity.Terms(model.known), texts)])
    sizes, score = [], model.score
    monkeypatch.setattr(model, "score", lambda p, t, n, texts: sizes.append((int(model.entries(p, t, texts).sum()), texts)) or score(p, t, n, texts))
    most = int(model.entries(*toxicity.Terms(model.known).counts(texts)[:2], len(texts)).max())
    monkeypatch.setattr(toxicity, "ENTRIES", 2 * most)
    parts = np.concatenate([s for s, _ in toxicity._scored(model, toxicity.Terms(model.known), texts)])
    assert most > 0 and sum(t for _, t in sizes) == 200 and max(e for e, _ in sizes) <= 2 * most
    assert np.allclose(whole, parts)


def test_a_text_with_more_entries_than_the_limit_is_scored_alone():
    assert list(toxicity.together(np.array([1, 10**9, 0, 2]))) == [(0, 1), (1, 2), (2, 4)] and not list(toxicity.together(np.zeros(0, np.int64)))


def test_components_found_before_take_no_more_rounds(spark, monkeypatch):
    written, write = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, tag: written.append(tag) or write(df, tag))
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (101, 102), (5, 5)], "a long, b long")
    found = components.connected_components(chain)
    assert {r.node: r.component for r in found.collect()} == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 104), 100)}
    assert len(written) > 1
    written.clear()
    again = components.connected_components(found.select(found.node.alias("a"), found.component.alias("b")))
    assert written == ["edges"] and sorted(again.collect()) == sorted(found.collect())
    empty = components.connected_components(chain.limit(0))
    assert empty.count() == 0 and written == ["edges"] * 2
