import itertools
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from matterloom.llm import toxicity as t

from .helpers import frame, texts


def brute_segments(scores):
    """Ruzzo and Tompa's definition: take the best segment, then go on left and right of it."""
    best, at = 0, None
    for b, e in itertools.combinations(range(len(scores) + 1), 2):
        s = sum(scores[b:e])
        if s > best or at and s == best and (e - b) < at[1] - at[0] and at[0] <= b and e <= at[1]:
            best, at = s, (b, e)
    if at is None:
        return []
    b, e = at
    return brute_segments(scores[:b]) + [best] + brute_segments(scores[e:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=14))
def test_segments_are_the_maximal_ones(scores):
    got = t.maximal_segments([float(s) for s in scores])
    assert all(sum(scores[b:e]) == s for b, e, s in got)
    assert sorted(s for *_, s in got) == sorted(brute_segments(scores))


def test_chance_law():
    assert abs(t.chance_law(np.array([1.0, -1.0]), np.array([1e9, 3e9])) - np.log(3)) < 1e-4
    assert t.chance_law(np.array([1.0, -1.0]), np.array([3e9, 1e9])) < 1e-3 and t.chance_law(np.array([]), np.array([])) == 1.0


def test_chance_constant_is_that_of_drawn_scores():
    r = np.random.default_rng(5)
    lam, k = 0.8, 0.05
    m = r.integers(20, 400, 40_000)
    s = np.maximum(0, (np.log(k * m) - np.log(-np.log(r.random(len(m))))) / lam)
    parts = {v: (int((on := (s > 0) == bool(v)).sum()), float((m * np.exp(-lam * s))[on].sum())) for v in (0, 1)}
    assert abs(t.chance_constant(parts) - k) < 0.002
    # No other constant makes them likelier.
    likely = lambda c: np.where(s > 0, np.log(c * m * lam) - lam * s - c * m * np.exp(-lam * s), -c * m).sum()
    assert likely(t.chance_constant(parts)) >= max(likely(k * 0.9), likely(k * 1.1))


def test_log_odds_have_two_sides():
    got = t.log_odds(np.array([40.0, 0.0, 10.0]), np.array([0.0, 400.0, 90.0]), 100, 900)
    assert got[0] > 1 and got[1] < -0.5 and got[2] == 0
    by_hand = np.log((40 + 0.12) / (103 - 40.12 + 1)) - np.log(1.08 / (927 - 1.08 + 1)) - 3 * np.sqrt(1 / 40.12 + 1 / 1.2)
    assert abs(got[0] - by_hand) < 1e-9


def test_evidence_is_the_sum_over_significant_segments():
    r = random.Random(2)
    model = t.Model({f"w{i}": r.choice([-1.0, 0.0, 2.5, 4.0]) for i in range(30)}, lam=1.3, k=0.1, slope=1.0, bias=-2.0)
    for _ in range(40):
        words = [f"w{r.randrange(60)}" for _ in range(r.randint(0, 60))]
        scores = [t.DRIFT + model.words.get(w, 0.0) for w in words]
        logs = [np.log(0.1 * len(words)) - 1.3 * s for s in brute_segments(scores)]
        want = -sum(x for x in logs if x < np.log(t.SIGNIFICANT))
        got = model.evidence(model.segments(words))
        assert abs(got - want) < 1e-6
        assert abs(model.probability(got) - 1 / (1 + np.exp(2 - np.log1p(got)))) < 1e-9
    # One word is a passage too.
    strong = t.Model({"x": 30.0}, lam=1.0, k=0.1, slope=3.0, bias=-3.0)
    assert strong.probability(strong.evidence(strong.segments(["a"] * 20 + ["x"]))) > 0.99


def test_curve_is_the_likeliest():
    x, y, n = np.array([0.0, 1.0, 2.0, 3.0]), np.array([0.0, 0.0, 1.0, 1.0]), np.array([90.0, 20.0, 15.0, 30.0])
    x, y, n = np.r_[x, x], np.r_[y, 1 - y], np.r_[n, 3.0, 6.0, 4.0, 1.0]
    cost = lambda a, b: -(n @ np.where(y > 0, np.log(1 / (1 + np.exp(-a * x - b))), np.log(1 - 1 / (1 + np.exp(-a * x - b))))) + 0.025 * a * a + 0.0005 * b * b
    a, b = t.curve(x, y, n)
    assert all(cost(a, b) <= cost(a + da, b + db) for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))


def corpus(n=700, seed=3):
    r = random.Random(seed)
    plain = ["".join(r.choice(["ta", "ri", "mo", "len", "su", "ka"]) for _ in range(r.randint(2, 5))) for _ in range(3000)]
    bad = [f"grux{x}" for x in ("a", "e", "in", "or", "us", "et")] + ["vile", "filth"]
    rows = []
    for i in range(n):
        words, toxic = r.choices(plain, k=r.randint(20, 200)), int(r.random() < 0.2)
        for _ in range(max(2, len(words) // 25) if toxic else 0):
            words.insert(r.randint(0, len(words)), r.choice(bad).title())
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    more = list(enumerate(texts(10), 10_000))
    docs = frame(spark, [x[1] for x in rows] + [x[1] for x in more] + ["a", "a"], [x[0] for x in rows] + [x[0] for x in more] + [None, None])
    labels = spark.createDataFrame([(i, y, None) for i, _, y in rows] + [(1, None, None), (None, 1, None), (10_000, 0, None)], "doc_id long, toxic int, text string")
    got = t.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    want = {i: y for i, _, y in rows}
    held = [r for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {r.doc_id for r in got if r.held_out} == {r.doc_id for r in held}
    right = [r.predicted == want[r.doc_id] for r in held if r.doc_id in want]
    assert len(right) > 100 and np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    model = t.fit(docs, labels)
    found = t.passages(docs, model).collect()
    by_id = {r[0]: r[1] for r in rows}
    assert found and all(by_id[r.doc_id][r.start : r.end] == r.passage for r in found)
    kept = t.score_documents(docs, model, keep=True)
    assert kept.columns == [*docs.columns, "predicted"]


def test_labels_of_one_kind_and_empty_tables(spark):
    docs = frame(spark, ["a b", None])
    labels = spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, toxic int")
    assert {(r.score < 1e-9, r.predicted) for r in t.toxicity(docs, labels).collect()} == {(True, 0)}
    assert t.toxicity(docs, labels.limit(0)).count() == 2 and t.toxicity(docs.limit(0), labels).collect() == []


def test_sample_is_bounded(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('w', id) as text")
    labels = spark.range(4000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    assert 300 < t.labelled(docs, labels, "doc_id", "text", "toxic", most=500).count() < 700


def held_out_hits(spark, rows):
    """Shares of toxic and of clean held-out texts that are told right."""
    got = t.toxicity(frame(spark, [x for _, x, _ in rows], [i for i, _, _ in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    hits = {0: [], 1: []}
    want = {i: y for i, _, y in rows}
    for r in got.where("held_out").collect():
        hits[want[r.doc_id]].append(r.predicted == want[r.doc_id])
    assert min(len(x) for x in hits.values()) > 20
    return np.mean(hits[1]), np.mean(hits[0])


def test_copies_of_clean_texts_do_not_make_common_words_toxic(spark):
    # Each clean text has five copies that differ in their last word; words that all texts have must stay without a lean.
    r = random.Random(8)
    common = ["the", "and", "of", "to", "in", "that"] * 3
    rows = []
    for _, text, y in corpus(500, 4):
        words = text.split() + common
        r.shuffle(words)
        rows += [(" ".join([*words, f"end{c}"]), y) for c in range(1 if y else 5)]
    rows = [(i, x, y) for i, (x, y) in enumerate(rows)]
    toxic, clean = held_out_hits(spark, rows)
    assert toxic > 0.95 and clean > 0.97


def test_longer_toxic_texts_do_not_make_chance_rise(spark):
    # Any word is likelier in a longer text, so words without a meaning lean to toxic, and clean text would rise.
    r = random.Random(9)
    plain = [f"{a}{b}" for a in ("ta", "ri", "mo", "len", "su", "ka", "bo") for b in ("ni", "sel", "pu", "da", "er")]
    rows = []
    for i in range(1500):
        y = int(r.random() < 0.3)
        rows.append((i, " ".join(r.choices(plain, k=r.randint(40, 60) if y else r.randint(15, 30)) + ["grux", "vile"] * y), y))
    docs, labels = frame(spark, [x for _, x, _ in rows], [i for i, _, _ in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = t.fit(docs, labels)
    scores = [s for _, x, y in rows if not y for s in model.scores(x.split())]
    assert np.mean(scores) < 0.9 * t.DRIFT and model.lam > 0.1
    toxic, clean = held_out_hits(spark, rows)
    assert toxic > 0.95 and clean > 0.97


def test_fall_is_at_least_the_drift():
    assert t.fall(np.array([1.0, -0.5]), np.array([1.0, 1.0])) == t.DRIFT - 0.25
    assert t.fall(np.array([1.0, -0.5]), np.array([1.0, 9.0])) == 0 and t.fall(np.array([]), np.array([])) == 0


def test_every_labelled_text_teaches_and_a_family_weighs_one(spark):
    texts_ = ["a b c d x1", "a b c d x2", "a b c d x3", "q r s t"]
    families = [t.family(x.split()) for x in texts_]
    families = [families[0]] * 3 + families[3:]
    train = spark.createDataFrame([(x, 1, f) for x, f in zip(texts_, families, strict=True)] + [("only clean", 0, families[0])], "text string, toxic int, family long")
    got = {r.feature: (r.toxic, r.clean) for r in t.count_features(t.weighed(train, t.families_of(train))).collect()}
    assert {f: round(got[f][0], 5) for f in ("a", "x1", "x2", "x3", "q")} == {"a": 1, "x1": 0.33333, "x2": 0.33333, "x3": 0.33333, "q": 1}
    assert got["only"] == (0, 1) and got["a"][1] == 0
