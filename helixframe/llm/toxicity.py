"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - weights . x): one weight per feature for all thresholds, which
are kept in order. The answer is the expected grade; a document is toxic if P(grade >= 1) is a half
or more. Features are a text's words and the first letters of its words, present or not.

The labels tell toxic or not. Grades above 1 come from held-out evidence: the labelled rows are dealt
over two folds by a hash, a plain two-grade model of each fold weighs the other fold's texts, and toxic
texts get grades 1, 2 and 3 by thirds of that weight. The ordinal model is then fitted on all of them.

The model is fitted on at most SAMPLE labelled rows of each label, chosen by a hash of doc_id; all
that the driver holds is bounded by SAMPLE and FEATURES. Scoring reads whole texts of all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from helixframe.llm.common import kept, prepare, scratch

#: Most labelled rows of each label, most features, fewest toxic texts of a feature, least lower bound of its odds.
SAMPLE, FEATURES, LEAST_TEXTS = 6000, 3000, 3
PREFIXES = (4, 5)
#: Clean, and toxic by thirds of the held-out evidence.
GRADES = 4
SEED = 5
RIDGE, STEPS, RATE = 2e-4, 400, 0.1
Z = 1.64

COUNTED = pa.schema([("feature", pa.string()), ("bad", pa.int64()), ("n", pa.int64())])
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(words: set[str]) -> set[str]:
    """Words, and ^ with their first letters where more follow."""
    out = set(words)
    for n in PREFIXES:
        out.update({"^" + w[:n] for w in words if len(w) > n})
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def score(self, text: str | None) -> tuple[float, float, int, bool]:
        """Expected grade, P(grade >= 1), likeliest grade, toxic."""
        words = words_of(text)
        x = sum(self.weights[f] for f in features_of(words) & self.weights.keys())
        return self.of_sum(x)

    def of_sum(self, x: float) -> tuple[float, float, int, bool]:
        below = [1 / (1 + np.exp(min(max(x - t, -60.0), 60.0))) for t in self.thresholds]
        p = np.diff([0.0, *below, 1.0])
        return float(p @ np.arange(len(p))), float(1 - below[0]), int(p.argmax()), bool(1 - below[0] >= 0.5)


def fit(rows: list[list[int]], grades: np.ndarray, weights: np.ndarray, n_features: int, levels: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and thresholds of the least ridge-penalised negative log-likelihood, by Adam from fixed starts.

    rows: indices of each document's features; weights: how much each document counts; levels: number of grades.
    """
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([i for r in rows for i in r], np.int64)
    k = levels - 1
    w, first, gaps = np.zeros(n_features), np.zeros(1), np.zeros(k - 1)
    share = weights / weights.sum()
    m = v = 0.0
    for step in range(1, STEPS + 1):
        thresholds = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        x = np.bincount(doc, w[col], len(rows))
        upper = np.append(thresholds, np.inf)[grades]
        lower = np.insert(thresholds, 0, -np.inf)[grades]
        su, sl = (1 / (1 + np.exp(-np.clip(b - x, -40, 40))) for b in (upper, lower))
        su, sl = np.where(np.isinf(upper), 1.0, su), np.where(np.isinf(lower), 0.0, sl)
        p = np.maximum(su - sl, 1e-12)
        du, dl = su * (1 - su) / p * share, sl * (1 - sl) / p * share
        g_w = np.bincount(col, (du - dl)[doc], n_features) + 2 * RIDGE * w
        g_t = np.zeros(k)
        np.add.at(g_t, grades[grades < k], -du[grades < k])
        np.add.at(g_t, grades[grades > 0] - 1, dl[grades > 0])
        tails = np.cumsum(g_t[::-1])[::-1]
        g = np.concatenate([g_w, tails[:1], tails[1:] * np.exp(gaps)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, first, gaps = w - move[:n_features], first - move[n_features : n_features + 1], gaps - move[n_features + 1 :]
    return w, np.concatenate([first, first + np.cumsum(np.exp(gaps))])


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """text, toxic, fold of at most most documents of each label, chosen by a hash of doc_id; fold is 0 or 1 by another.

    Labels that are null or neither 0 nor 1 aren't used; of a document's repeated labels the larger
    counts; of rows with the same id one takes part, that whose text has the least hash, so that rows that repeat change nothing.
    """
    one = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64(F.lit(SEED), F.col("doc_id"))
    chosen = [one.filter(F.col("toxic") == y).withColumn("o", order).orderBy("o", "doc_id").limit(most).drop("o") for y in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * most rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(ids, "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return rows.select("text", "toxic", F.pmod(F.xxhash64(F.lit(SEED + 1), F.col("doc_id")), F.lit(2)).cast("int").alias("fold"))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """A model from labelled documents; without any toxic or any clean one it finds nothing toxic."""
    prepare(docs.sparkSession)
    with scratch(docs.sparkSession, "toxicity") as under:
        return fitted(kept(sample(docs, labels, most), "sample", under))


def graded(rows: list[list[int]], toxic: np.ndarray, fold: np.ndarray, n_features: int) -> np.ndarray:
    """Grades of labelled rows: 0 for clean ones, toxic ones by thirds of the other fold's evidence (all 1 if a fold lacks a label)."""
    evidence = np.zeros(len(rows))
    for f in (0, 1):
        part = [r for r, g in zip(rows, fold) if g != f]
        y = toxic[fold != f]
        if not 0 < y.sum() < len(y):
            return toxic.astype(int)
        w, t = fit(part, y, np.ones(len(part)), n_features, 2)
        for i in np.flatnonzero(fold == f):
            evidence[i] = w[rows[i]].sum() - t[0]
    cuts = np.quantile(evidence[toxic == 1], [i / (GRADES - 1) for i in range(1, GRADES - 1)])
    return np.where(toxic == 1, 1 + np.searchsorted(cuts, evidence, side="left"), 0)


def fitted(chosen: DataFrame) -> Model:
    """train() of sample()'s rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, all_, texts = Counter(), Counter(), [0, 0]
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = features_of(words_of(t))
                all_.update(f)
                texts[y] += 1
                if y:
                    bad.update(f)
        keys = list(all_)
        yield pa.RecordBatch.from_pydict({"feature": ["", *keys], "bad": [texts[1], *(bad[f] for f in keys)], "n": [sum(texts), *(all_[f] for f in keys)]}, COUNTED)

    counts = chosen.mapInArrow(count, "feature string, bad long, n long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    total = counts.filter("feature = ''").first()
    if total is None or not 0 < total["bad"] < total["n"]:
        return Model({}, tuple(float(60 + i) for i in range(GRADES - 1)))
    base = total["bad"] / total["n"]
    p, n = F.col("bad") / F.col("n"), F.col("n")
    bound = (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)  # Wilson's lower bound
    good = counts.filter((F.col("feature") != "") & (F.col("bad") >= LEAST_TEXTS)).withColumn("bound", bound).filter(F.col("bound") >= (1 + base) / 2)
    picked = good.orderBy(F.desc("bound"), F.desc("n"), "feature").limit(FEATURES).collect()  # FEATURES rows at most
    names = [r["feature"] for r in picked]
    index = {f: i for i, f in enumerate(names)}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = [sorted(index[f] for f in features_of(words_of(t)) & index.keys()) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.int32())), b.column(1), b.column(2)], names=["x", "toxic", "fold"])

    rows = chosen.mapInArrow(sparse, "x array<int>, toxic int, fold int").orderBy("toxic", "fold", "x").toPandas()  # 2 * most rows at most
    grades = graded([list(x) for x in rows.x], rows.toxic.to_numpy(), rows.fold.to_numpy(), len(names))
    w, thresholds = fit([list(x) for x in rows.x], grades, np.ones(len(rows)), len(names))
    return Model({f: float(round(x, 9)) for f, x in zip(names, w)}, tuple(float(round(t, 9)) for t in thresholds))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with expected_severity, p_toxic, grade, toxic (these names are replaced if docs has them).

    Null and empty texts have no features: they get the grade of a text without any, which is 0.
    All columns and rows stay, repeated ones too.
    """
    spark = docs.sparkSession
    prepare(spark)
    weights = model.weights
    words = frozenset(f for f in weights if not f.startswith("^"))
    starts = [(n, frozenset(f[1:] for f in weights if f.startswith("^") and len(f) == n + 1)) for n in PREFIXES]
    out = [("expected_severity", pa.float64()), ("p_toxic", pa.float64()), ("grade", pa.int32()), ("toxic", pa.bool_())]
    docs = docs.drop(*(n for n, _ in out))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(at):
                w = words_of(t.as_py())
                x = sum(sorted(weights[f] for f in w & words))
                for n, known in starts:
                    if hits := {a[:n] for a in w if len(a) > n} & known:
                        x += sum(sorted(weights["^" + f] for f in hits))
                rows.append(model.of_sum(x))
            cols = list(zip(*rows)) or [[] for _ in out]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(list(c), kind) for c, (_, kind) in zip(cols, out))], names=[*b.schema.names, *(n for n, _ in out)])

    kinds = (DoubleType(), DoubleType(), IntegerType(), BooleanType())
    schema = StructType([*docs.schema.fields, *(StructField(n, k) for (n, _), k in zip(out, kinds))])
    return docs.mapInArrow(run, schema)
