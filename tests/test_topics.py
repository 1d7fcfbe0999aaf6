import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgraph.operators import topics as T


def docs_of(spark, texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "Record_ID string, text string")
    return T.tokens(df, stop_words=["the"], min_length=1)


def test_tokens(spark):
    rows = docs_of(spark, ["The Cat's 2 hats, été!", None]).orderBy("Record_ID").collect()
    assert rows[0].tokens == ["cat", "s", "hats", "été"] and rows[1].tokens == []


def test_vocabulary_bounds_and_ties(spark):
    docs = docs_of(spark, ["a b b c", "a b d", "a c", "a"])
    got = [tuple(r) for r in T.vocabulary(docs, 2, 0.75, 2).orderBy("index").collect()]
    assert got == [("b", 2, 0), ("c", 2, 1)]
    matrix = {(r.Record_ID, r["index"]): r.n for r in T.doc_term_matrix(docs, T.vocabulary(docs, 2, 0.75, 2)).collect()}
    assert matrix == {("0", 0): 2, ("0", 1): 1, ("1", 0): 1, ("2", 1): 1}
    vectors = {r.Record_ID: r.features.toArray().tolist() for r in T.term_vectors(docs, ["b", "c"]).collect()}
    assert vectors["0"] == [2.0, 1.0] and vectors["3"] == [0.0, 0.0]


def windows(tokens, size):
    return [set(tokens[i:i + size]) for i in range(max(len(tokens) - size, 0) + 1)] if tokens else []


@pytest.mark.parametrize("size", [1, 3, 5, 50])
def test_coherence_equals_window_enumeration(spark, size):
    texts = ["a x b y a z c", "b c", "", "x y z a a a b x c x x b", "a", "z z z z z z a z z z z z b"]
    topics = {0: ["a", "b", "c"], 1: ["x", "a", "never"]}
    every = [w for t in texts for w in windows(t.split(), size)]
    total = len(every)

    def p(*terms):
        return sum(all(t in w for t in terms) for w in every) / total

    def npmi(a, b):
        if not p(a) or not p(b):
            return 0.0
        both = p(a, b)
        return math.log((both + 1e-12) / (p(a) * p(b))) / -math.log(both + 1e-12) if both < 1 else 1.0

    def cosine(u, v):
        n = math.sqrt(sum(x * x for x in u)) * math.sqrt(sum(x * x for x in v))
        return sum(x * y for x, y in zip(u, v)) / n if n else 0.0

    got = {r.topic: r.coherence for r in T.coherence_cv(docs_of(spark, texts), topics, size).collect()}
    assert T.total_windows(docs_of(spark, texts), size) == total
    for topic, terms in topics.items():
        m = [[npmi(a, b) for b in terms] for a in terms]
        whole = [sum(c) for c in zip(*m)]
        assert got[topic] == pytest.approx(sum(cosine(r, whole) for r in m) / len(terms), abs=1e-9)


def test_lda_separates_two_subjects(spark):
    texts = ["ball goal team ball match " * 4, "vote law court vote bill " * 4] * 30
    docs = docs_of(spark, texts)
    terms = ["ball", "goal", "team", "match", "vote", "law", "court", "bill"]
    table, model = T.select_k(docs, terms, [2, 3], top=4, iterations=30)
    assert [r.chosen for r in table.orderBy("k").collect()].count(True) == 1
    model = T.fit_lda(T.term_vectors(docs, terms), 2, 30)
    rows = T.dominant_topic(model, T.term_vectors(docs, terms)).collect()
    assert all(r.total == pytest.approx(1.0) for r in rows)
    sides = [{r.Topic_Label for r in rows if int(r.Record_ID) % 2 == s} for s in (0, 1)]
    assert len(sides[0]) == len(sides[1]) == 1 and sides[0] != sides[1]
    tops = T.topic_top_terms(model, terms, 4).groupBy("topic").agg(F.collect_set("term").alias("t")).collect()
    assert {frozenset(r.t) for r in tops} == {frozenset(terms[:4]), frozenset(terms[4:])}


def test_lda_equals_a_document_by_document_fit(spark):
    texts = ["ball goal team ball", "vote law court vote bill", "ball law", "team goal goal", "none of them", "bill"] * 3
    docs = docs_of(spark, texts).repartition(4)
    terms = ["ball", "goal", "team", "vote", "law", "court", "bill"]
    k, passes, inner = 2, 4, 3
    model = T.fit_lda(T.term_vectors(docs, terms), k, passes, inner=inner, tolerance=0.0)

    def slope(x, h=1e-5):  # of the log-gamma function
        return (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)

    counts = T.first_counts(k, len(terms), 42).tolist()
    for _ in range(passes):
        topics = [[math.exp(slope(c) - slope(sum(row))) for c in row] for row in counts]
        after = [[1 / k] * len(terms) for _ in range(k)]
        for text in texts:
            words = [terms.index(w) for w in text.split() if w in terms]
            gamma = [1 / k + len(words) / k] * k
            for step in range(inner + 1):
                theta = [math.exp(slope(g) - slope(sum(gamma))) for g in gamma]
                share = [[theta[t] * topics[t][w] for t in range(k)] for w in words]
                share = [[x / sum(row) for x in row] for row in share]
                if step < inner:
                    gamma = [1 / k + sum(row[t] for row in share) for t in range(k)]
            for w, row in zip(words, share):
                for t in range(k):
                    after[t][w] += row[t]
        counts = after
    assert model.counts == pytest.approx(np.array(counts), rel=1e-5)
    assert T.digamma(np.array([0.1, 1.0, 50.0])) == pytest.approx([slope(x) for x in (0.1, 1.0, 50.0)], rel=1e-6)
    assert T.log_gamma(np.array([0.1, 1.0, 50.0])) == pytest.approx([math.lgamma(x) for x in (0.1, 1.0, 50.0)], abs=1e-9)


def test_lda_bound_never_falls(spark):
    rng = random.Random(1)
    groups = [[f"{g}{x}" for x in "abcdefgh"] for g in "pqr"]
    texts = [" ".join(rng.choices(groups[i % 3], k=25) + rng.choices(sum(groups, []), k=3)) for i in range(120)]
    docs = docs_of(spark, texts)
    terms = sorted({t for r in docs.collect() for t in r.tokens})
    model = T.fit_lda(T.term_vectors(docs, terms), 3, 15, inner=200, tolerance=1e-9)
    assert len(model.bounds) == 15
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(model.bounds, model.bounds[1:]))


def test_documents_without_terms_keep_a_row(spark):
    docs = docs_of(spark, ["ball goal ball", "vote law vote", "unknown words", ""] * 5)
    terms = ["ball", "goal", "vote", "law"]
    vectors = T.term_vectors(docs, terms)
    rows = T.dominant_topic(T.fit_lda(vectors, 2, 10), vectors).collect()
    assert len(rows) == 20
    assert [(r.Topic_Label is None, r.share is None, r.total == 0) for r in rows] == [
        (int(r.Record_ID) % 4 > 1,) * 3 for r in rows]


def test_best_k_prefers_the_smaller_on_ties():
    assert T.best_k([(2, 0.5), (3, 0.5000000000001), (5, 0.4)]) == 2
    assert T.best_k([(2, float("nan")), (4, -0.9), (3, None)]) == 4


def test_lemmas(spark):
    docs = docs_of(spark, ["cats sit cats", ""])
    lemmas = spark.createDataFrame([("cats", "cat"), ("cats", "feline")], "form string, lemma string")
    rows = T.lemmatise(docs, lemmas).orderBy("Record_ID").collect()
    assert [r.tokens for r in rows] == [["cat", "sit", "cat"], []]


def test_models_of_several_sizes_share_one_pass_each(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{x}" for x in range(30)], k=rng.randint(0, 60))) for _ in range(200)]
    vectors = T.term_vectors(docs_of(spark, texts), [f"w{x}" for x in range(30)]).persist()
    runs, fit = [], T._sufficient
    T._sufficient = lambda models: runs.append(len(models)) or fit(models)
    try:
        together = T.fit_models(vectors, [2, 5], 3)
    finally:
        T._sufficient = fit
        vectors.unpersist()
    assert runs == [2, 2, 2]
    for k, model in zip((2, 5), together):
        alone = T.fit_lda(T.term_vectors(docs_of(spark, texts), [f"w{x}" for x in range(30)]), k, 3)
        assert model.counts == pytest.approx(alone.counts) and model.bounds == pytest.approx(alone.bounds)


def test_documents_settle_alike_in_any_company():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 90, 400)
    terms = np.concatenate([rng.choice(200, n, replace=False) for n in lengths])
    n = rng.integers(1, 6, len(terms)).astype(float)
    counts = rng.gamma(0.3, 50, (4, 200)) + 0.25
    model = T.TopicModel(counts, 0.25, 50, 1e-3)
    topics = np.exp(T._expected_logs(counts))
    got = T._settle(lengths, terms, n, topics, model)
    ends = np.cumsum(lengths)
    for d in range(0, 400, 7):
        own, number = terms[ends[d] - lengths[d]:ends[d]], n[ends[d] - lengths[d]:ends[d]]
        gamma = np.full(4, 0.25 + number.sum() / 4)
        for _ in range(50):
            mass = topics[:, own] * np.exp(T.digamma(gamma) - T.digamma(gamma.sum()))[:, None]
            step = 0.25 + (mass / mass.sum(axis=0) * number).sum(axis=1)
            moved, gamma = np.abs(step - gamma).mean(), step
            if moved < 1e-3:
                break
        assert got[d] == pytest.approx(gamma, rel=1e-9)
    x = np.array([0.01, 0.2, 1.0, 7.5, 1e4])
    assert T.exp_digamma(x) == pytest.approx(np.exp(T.digamma(x)), rel=1e-12, abs=1e-300)


def test_window_counts_shuffle_no_occurrences(spark):
    docs = docs_of(spark, ["a x b y a z c", "b c", "", "x a a b"])
    groups = spark.createDataFrame([("a", "a"), ("a b", "a"), ("a b", "b"), ("none", "never")], "group string, term string")
    counts = T.window_counts(docs, groups, 3)
    assert {r["group"]: r.windows for r in counts.collect()} == {"a": 6, "a b": 8}
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "posexplode" not in plan


def test_window_counts_of_rows_that_share_a_key(spark):
    rows = [("1", ["a", "b", "c", "a"]), ("1", ["a", "b", "c", "a"]), (None, ["a"]), (None, ["c", "c", "a"]), ("2", ["a", "c"])]
    docs = spark.createDataFrame(rows, "Record_ID string, tokens array<string>")
    groups = spark.createDataFrame([("a", "a"), ("a c", "a"), ("a c", "c")], "group string, term string")
    # rows of one key count as one document, as they lie over each other
    got = {r["group"]: r.windows for r in T.window_counts(docs, groups, 2).collect()}
    hits = T._shared_windows(docs, groups, 2, "Record_ID").groupBy("group").sum("added").collect()
    assert got == {r["group"]: r[1] for r in hits}
