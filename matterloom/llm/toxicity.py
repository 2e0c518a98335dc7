"""Toxicity by maximum-scoring segments.

Every word gets the log-odds of standing in toxic rather than other text, with an informative Dirichlet prior in proportion
to how often it occurs at all, drawn towards 0 by three standard errors; words that lean to clean text get negative ones.
The beginnings of a word count if they are higher. A negative drift is added to every word, ``DRIFT`` or as much more as makes the words of
labelled clean text fall by ``DRIFT`` on average: without a fall there is no law of chance segments. All labelled texts teach, but near copies
of one label share the weight of one text, in the counts of words and in those of texts alike; they are told by the least hash of their
three-word shingles. A linear-time scan finds all maximal-scoring segments of a document's words.
A segment's score becomes an expectation under the extreme-value law of chance segments: lambda solves
``E[exp(lambda s)] = 1`` over the words of labelled clean text, and K is the one under which the best segments of that
text's documents are likeliest. The evidence of a document's significant segments, added up, becomes a probability by a
logistic curve. Words are scored on one part of the labelled texts (by a hash of the family of near copies), and lambda, K and the curve
are fitted on the other (one in ``CALIBRATE``), so that the curve is not fooled by scores that fit their own texts.

Plan: labels are drawn up to ``SAMPLE`` rows by hash (all, if there are no more) and broadcast, so the labelled texts
are found by a join that shuffles no text; they are written once, and joined to the weights of families of several texts, which are
broadcast. Words are counted by documents with partial sums; at most
``WORDS`` words of either kind and as many beginnings, those with most evidence, come to the driver. Law and curve are fitted
to sums and counts. Scoring is a map over all documents.

Defined results: null or empty text has no words and gets the score of no evidence; without labels of both kinds
every score is 0; a doc_id with several labels is toxic if one says so; null doc_ids are never learned from and are
never held out; repeated rows keep one result row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, strings, written

#: Labelled rows that are learned from at most.
SAMPLE = 200_000
#: Words, and beginnings of words, that a model holds at most.
WORDS = 1 << 16
PRIOR = 0.03
ERRORS = 3.0
DRIFT = -0.1
#: One in so many families of labelled texts calibrates what the others have taught.
CALIBRATE = 8
BEGINNINGS = (6, 5, 4)
#: A segment counts if fewer than this many as good are expected by chance in a document.
SIGNIFICANT = 0.05
THRESHOLD = 0.3
HELD = 200_000
#: Weights are whole numbers of this part of a text, so that their sums do not depend on their order.
UNIT = 1 << 20

WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(words: set[str]) -> set[str]:
    """The words, and their beginnings, marked by a star."""
    out = set(words)
    for n in BEGINNINGS:
        out.update(w[:n] + "*" for w in words if len(w) >= n)
    return out


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-odds with a Dirichlet prior of mass ``PRIOR`` times the number of documents, drawn towards 0 by ``ERRORS`` standard errors."""
    prior = PRIOR * (toxic + clean)
    t, c = toxic + prior * n_toxic / (n_toxic + n_clean), clean + prior * n_clean / (n_toxic + n_clean)
    delta = np.log(t / (n_toxic * (1 + PRIOR) - t + 1)) - np.log(c / (n_clean * (1 + PRIOR) - c + 1))
    few = np.where(delta > 0, clean + prior, toxic + prior)
    many = np.where(delta > 0, t, c)
    return np.sign(delta) * np.maximum(0, np.abs(delta) - ERRORS * np.sqrt(1 / many + 1 / few))


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, score) in one linear scan."""
    found: list[list] = []  # begin, end, sum before, sum up to its end, index of the last candidate with a smaller sum before
    total = 0.0
    for k, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        begin, left, right = k, before, total
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append([begin, k + 1, left, right, j])
                break
            begin, left = found[j][0], found[j][2]
            nxt = found[j][4]
            del found[j:]
            j = nxt
    return [(b, e, r - x) for b, e, x, r, _ in found]


@dataclass
class Model:
    """Word scores, the extreme-value law's parameters, and the curve from evidence to probability."""

    words: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 0.1
    slope: float = 0.0
    bias: float = -50.0
    drift: float = DRIFT

    def scores(self, words: list[str]) -> list[float]:
        get = self.words.get
        known: dict[str, float] = {}
        for w in set(words):
            known[w] = self.drift + max(get(w, 0.0), *(get(w[:n] + "*", -math.inf) for n in BEGINNINGS if len(w) >= n), -math.inf)
        return [known[w] for w in words]

    def maximal(self, words: list[str]) -> list[tuple[int, int, float]]:
        """(begin, end, score) of all maximal-scoring segments, in words."""
        scores = np.array(self.scores(words))
        if not len(scores) or scores.max() <= 0:
            return []
        # Runs of one sign first: a maximal segment never cuts one.
        edge = np.flatnonzero(np.r_[True, (scores[1:] > 0) != (scores[:-1] > 0)])
        runs = np.add.reduceat(scores, edge).tolist()
        ends = np.r_[edge[1:], len(scores)]
        return [(int(edge[b]), int(ends[e - 1]), s) for b, e, s in maximal_segments(runs)]

    def segments(self, words: list[str]) -> list[tuple[int, int, float, float]]:
        """(begin, end, score, logarithm of the expectation) of the significant segments, in words."""
        if not words:
            return []
        chance = math.log(self.k * len(words))
        found = [(b, e, s, chance - self.lam * s) for b, e, s in self.maximal(words)]
        return [x for x in found if x[3] < math.log(SIGNIFICANT)]

    def evidence(self, segments: list[tuple[int, int, float, float]]) -> float:
        """What the significant segments come to: minus the sum of the logarithms of their expectations."""
        return -sum(x[3] for x in segments)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.slope * math.log1p(evidence) + self.bias))))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int = SAMPLE) -> DataFrame:
    """(text, toxic, family) of the labelled documents that are not held out; of the labels, at most about ``most`` rows by hash."""
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(~held_out(F.col("doc_id")))
    total = rows.count()
    if total > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / total))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            families = pa.array([family(words_of(t)) for t in strings(batch.column("text"))], pa.int64())
            yield pa.record_batch([batch.column("text"), batch.column("toxic"), families], ["text", "toxic", "family"])

    # At most about ``most`` rows of two numbers are broadcast.
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(rows), "doc_id").select("text", "toxic")
    return found.mapInArrow(tell, "text string, toxic int, family long")


def family(words: list[str]) -> int:
    """The least hash of the words' three-word shingles; near copies mostly share it."""
    return min(zlib.crc32(" ".join(x).encode()) for x in zip(words, words[1:] or [""], words[2:] or [""], strict=False)) if words else 0


def calibrates(family) -> F.Column:
    return F.pmod(F.xxhash64(family), F.lit(CALIBRATE)) == 0


def families_of(train: DataFrame) -> DataFrame:
    """(family, toxic, n, weight): families of each kind, their texts, and what each of these weighs in ``UNIT``."""
    rows = train.groupBy("family", (F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n"))
    return rows.withColumn("weight", F.expr(f"{UNIT} div n"))


def weighed(train: DataFrame, families: DataFrame) -> DataFrame:
    """``train`` with its weights. Families of several texts are broadcast: at most about ``SAMPLE / 2`` rows of three numbers."""
    rows = families.where("n > 1").select(F.col("family").alias("of"), F.col("toxic").alias("kind"), "weight")
    found = train.join(F.broadcast(rows), (F.col("family") == F.col("of")) & ((F.col("toxic") > 0) == F.col("kind")), "left")
    return found.select("text", "toxic", "family", F.coalesce("weight", F.lit(UNIT)).alias("weight"))


def count_features(train: DataFrame) -> DataFrame:
    """(feature, toxic, clean): weights of the labelled documents of each kind whose text has the word or beginning, summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[tuple[bool, int], Counter] = defaultdict(Counter)

        def send() -> Iterator[pa.RecordBatch]:
            for (toxic, n), found in held.items():
                sums, none = pa.array([n * k for k in found.values()], pa.int64()), pa.array([0] * len(found), pa.int64())
                yield pa.record_batch([pa.array(list(found), pa.string()), *((none, sums) if toxic else (sums, none))], ["feature", "clean", "toxic"])
            held.clear()

        for batch in slices(batches, "text"):
            for t, y, n in zip(*teaching(batch), strict=True):
                held[y > 0, n].update(features(set(words_of(t))))
                if sum(map(len, held.values())) > HELD:
                    yield from send()
        yield from send()

    counts = train.select("text", "toxic", "weight").mapInArrow(run, "feature string, clean long, toxic long")
    return counts.groupBy("feature").agg((F.sum("toxic") / UNIT).alias("toxic"), (F.sum("clean") / UNIT).alias("clean"))


def teaching(batch: pa.RecordBatch) -> tuple[list[str], list[int], list[int]]:
    """Texts, labels and weights."""
    return strings(batch.column("text")), batch.column("toxic").to_pylist(), batch.column("weight").to_pylist()


def _mapped(texts: DataFrame, model: Model, make) -> DataFrame:
    """(toxic, value, n, weight): sums over what ``make`` adds up for each text, as often as the text weighs."""
    known = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        weights: Counter = Counter()
        for batch in slices(batches, "text"):
            for t, y, n in zip(*teaching(batch), strict=True):
                make(known.value, words_of(t), y, n, held, weights)
        yield pa.record_batch(
            [pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.int64()), pa.array(list(held.values()), pa.int64()), pa.array([weights[k] for k in held], pa.float64())],
            ["toxic", "value", "n", "weight"],
        )

    sums = texts.select("text", "toxic", "weight").mapInArrow(run, "toxic long, value long, n long, weight double")
    return sums.groupBy("toxic", "value").agg((F.sum("n") / UNIT).alias("n"), (F.sum("weight") / UNIT).alias("weight"))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE) -> Model:
    """Learn word scores, the law of chance segments, and the curve from the labelled documents that are not held out."""
    train = written(labelled(docs, labels, doc_id, text, label, most), "labelled")
    families = written(families_of(train), "families")
    sizes = {(r.toxic, r.calibrates): r.n / UNIT for r in families.groupBy("toxic", calibrates("family").alias("calibrates")).agg(F.sum(F.col("n") * F.col("weight")).alias("n")).collect()}
    if len({y for y, _ in sizes}) < 2:
        return Model()
    train = weighed(train, families).withColumn("calibrates", calibrates("family"))
    # With too few texts for two parts, the same ones teach and calibrate.
    teach, test = (train.where("NOT calibrates"), train.where("calibrates")) if len(sizes) == 4 else (train, train)
    counts = written(count_features(teach), "features")
    n = {y: sum(v for (x, c), v in sizes.items() if x == y and not (c and len(sizes) == 4)) for y in (True, False)}
    words: dict[str, float] = {}
    share = n[True] / (n[True] + n[False])
    excess = F.col("toxic") - share * (F.col("toxic") + F.col("clean"))
    beginning = F.col("feature").endswith("*")
    for kind in (~beginning & (excess > 0) & (F.col("toxic") > 1), ~beginning & (excess < 0), beginning & (excess > 0) & (F.col("toxic") > 1)):
        top = counts.where(kind).orderBy(F.desc(F.abs(excess) / F.sqrt(F.col("toxic") + F.col("clean"))), "feature").limit(WORDS).collect()
        if top:
            scores = log_odds(np.array([r.toxic for r in top], float), np.array([r.clean for r in top], float), n[True], n[False])
            words |= {r.feature: float(s) for r, s in zip(top, scores, strict=True) if s}
    model = Model(words)
    if not any(s > -DRIFT for s in words.values()):
        return model

    def tally(m: Model, ws: list[str], y: int, n: int, held: Counter, weights: Counter) -> None:
        if y <= 0:
            for s, k in Counter(round(100 * s) for s in m.scores(ws)).items():
                held[0, s] += n * k

    chance = _mapped(test, model, tally).collect()
    scores, often = np.array([r.value / 100 for r in chance]), np.array([r.n for r in chance], float)
    more = fall(scores, often)
    model.drift += more
    model.lam = chance_law(scores + more, often)

    def longest(m: Model, ws: list[str], y: int, n: int, held: Counter, weights: Counter) -> None:
        if y <= 0 and ws:
            high = max((x[2] for x in m.maximal(ws)), default=0.0)
            held[0, int(high > 0)] += n
            weights[0, int(high > 0)] += n * len(ws) * math.exp(-m.lam * high)

    model.k = chance_constant({r.value: (r.n, r.weight) for r in _mapped(test, model, longest).collect()})

    def weigh(m: Model, ws: list[str], y: int, n: int, held: Counter, weights: Counter) -> None:
        held[int(y > 0), round(50 * math.log1p(m.evidence(m.segments(ws))))] += n

    seen = _mapped(test, model, weigh).collect()
    model.slope, model.bias = curve(np.array([r.value / 50 for r in seen]), np.array([r.toxic for r in seen], float), np.array([r.n for r in seen], float))
    return model


def fall(scores: np.ndarray, n: np.ndarray) -> float:
    """What is to be added to the scores of clean text, 0 at most, so that they fall by ``DRIFT`` on average."""
    return min(0.0, DRIFT - float(n @ scores / n.sum())) if n.sum() else 0.0


def chance_law(scores: np.ndarray, n: np.ndarray) -> float:
    """Lambda of the extreme-value law for independent draws from the given scores."""
    if not len(scores):
        return 1.0
    # One draw of a positive score is added, so that a chance above 0 is always there; where the scores of clean text do
    # not fall on average, there is no law of chance segments, and lambda is next to 0.
    s, p = np.r_[scores, max(scores.max(), 1.0)], np.r_[n, 1.0] / (n.sum() + 1)
    lo, hi = 1e-6, 1.0
    while p @ np.exp(hi * s) < 1 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if p @ np.exp(mid * s) < 1 else (lo, mid)
    return lo


def chance_constant(best: dict[int, tuple[int, float]]) -> float:
    """K, under which the best segments of clean documents are likeliest, given their number and the sum of ``m exp(-lambda s)``
    (m: words, s: best score) for documents with (1) and without (0) a positive word. Of the latter it is known that s is not above 0."""
    with_, total = best.get(1, (0, 0.0))[0], sum(w for _, w in best.values())
    return (with_ + 0.5) / (total + 1.0)


def curve(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope (0 at least) and bias of a logistic curve by damped Newton steps, with a little ridge."""
    a, b = 0.0, math.log((n @ y + 0.5) / (n @ (1 - y) + 0.5))
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        g = np.array([n @ ((y - q) * x) - 0.05 * a, n @ (y - q) - 0.001 * b])
        w = n * q * (1 - q)
        h = np.array([[w @ (x * x) + 0.05, w @ x], [w @ x, w.sum() + 0.001]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 0.0), b


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages; with ``keep``, the columns of ``docs`` and ``predicted``."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != "predicted"] if keep else [doc_id, text]
    rows = docs.select(*dict.fromkeys(names))
    results = [] if keep else ["score double"]
    kept = [f for f in rows.schema if keep or f.name == doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in slices(batches, text):
            found = [m.segments(words_of(t)) for t in strings(batch.column(text))]
            score = [m.probability(m.evidence(x)) for x in found]
            columns = {f.name: batch.column(f.name) for f in kept}
            if not keep:
                columns |= {"score": pa.array(score, pa.float64())}
            columns |= {"predicted": pa.array([int(s >= THRESHOLD) for s in score], pa.int32())}
            if not keep:
                columns |= {"n_passages": pa.array([len(x) for x in found], pa.int64())}
            yield pa.record_batch(list(columns.values()), list(columns))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + results + ["predicted int"] + ([] if keep else ["n_passages long"]))
    out = rows.mapInArrow(run, schema)
    return out if keep else out.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), "score", "predicted", "n_passages")


def passages(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, score, expected, passage): every significant segment with its place in the text, in characters."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for i, t in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text")), strict=True):
                places = [m.span() for m in WORD.finditer(t)]
                for b, e, s, expected in known.value.segments([t[x:y].lower() for x, y in places]):
                    start, end = places[b][0], places[e - 1][1]
                    rows.append((i, start, end, s, math.exp(expected), t[start:end]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "end", "score", "expected", "passage"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {id_type}, start long, end long, score double, expected double, passage string")


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Fit to the labels and score every document."""
    return score_documents(docs, fit(docs, labels, doc_id, text, label), doc_id, text)
