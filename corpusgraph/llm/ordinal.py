"""Toxicity grades by cumulative-link ordinal regression on sparse word features."""

import math
import re
from collections import Counter
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.tasks import lean
from corpusgraph.plans.loops import cut

_WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows that training takes at most (about), and word features.
TRAINING_ROWS = 20_000
FEATURES = 4096
#: Labelled documents that a feature must be in to be tested, the chance that any passes without cause, and lengths of word beginnings.
LEAST_DOCUMENTS = 4
BEGINNINGS = (4, 5, 6)
CHANCE = 0.01


def marks(word: str) -> list[str]:
    """Features of a word: itself, and its first 4, 5 and 6 letters where more follow (``abcd*``)."""
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k)]


def feature(count: int) -> float:
    """1 for a feature that is there once, and more the more often."""
    return 1 + math.log(count)


class _Marked(dict):
    """Numbers of a word's features that a model knows, remembered."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word):
        if len(self) > 100_000:
            self.clear()
        known = self[word] = tuple(self.number[m] for m in marks(word) if m in self.number)
        return known


class OrdinalModel:
    """``P(grade >= k) = logistic(weights . x - borders[k - 1])``: one weight per feature for all borders."""

    def __init__(self, weights: dict[str, float], borders: np.ndarray):
        kept = {w: v for w, v in weights.items() if v > 0}
        self.weights, self.borders = np.array(list(kept.values())), borders
        self._marked = _Marked({w: k for k, w in enumerate(kept)})

    def score(self, text: str) -> float:
        hits = Counter(k for known in map(self._marked.__getitem__, _WORD.findall(text.lower())) if known for k in known)
        return sum(float(self.weights[k]) * feature(c) for k, c in hits.items())

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """Row per score: the probabilities of grade 1 and above, 2 and above, and so on."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.borders[None, :], -40, 40)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int, levels: int,
                penalty: float = 0.05, rounds: int = 3000, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ``levels - 1`` rising borders by gradient steps (Adam) on the penalized cumulative-link likelihood.

    ``rows, columns, values`` are the non-zero features. Weights stay at 0 or above: features are
    chosen as marks of higher grades, so none may excuse another. Borders stay in order because only
    their logarithmic gaps are free.
    """
    n = len(grades)
    weight, free = np.zeros(width), np.concatenate([[2.0], np.zeros(levels - 2)])
    moments = [np.zeros(width + levels - 1) for _ in range(2)]
    for step in range(1, rounds + 1):
        borders = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        score = np.bincount(rows, values * weight[columns], n)
        edge = np.concatenate([[-np.inf], borders, [np.inf]])
        above = 1 / (1 + np.exp(-np.clip(score - edge[grades], -40, 40)))
        below = 1 / (1 + np.exp(-np.clip(score - edge[grades + 1], -40, 40)))
        chance = np.maximum(above - below, 1e-12)
        up, down = above * (1 - above) / chance, below * (1 - below) / chance
        by_score = -(up - down)
        by_border = np.bincount(grades, up, levels + 1)[1:levels] - np.bincount(grades + 1, down, levels + 1)[1:levels]
        tail = np.cumsum(by_border[::-1])[::-1]
        by_free = np.concatenate([tail[:1], tail[1:] * np.exp(free[1:])])
        by_weight = np.bincount(columns, values * by_score[rows], width) + penalty * weight
        slope = np.concatenate([by_weight, by_free]) / n
        moments[0] = 0.9 * moments[0] + 0.1 * slope
        moments[1] = 0.999 * moments[1] + 0.001 * slope**2
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        weight, free = np.maximum(weight - move[:width], 0), free - move[width:]
    return weight, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


@lean
def _counter(batches):
    for batch in batches:
        for low in range(0, batch.num_rows, 64):
            part = batch.slice(low, 64)
            counted = []
            for text in part.column("text").to_pylist():
                own = Counter()
                for word, n in Counter(_WORD.findall(text.lower())).items():
                    for mark in marks(word):
                        own[mark] += n
                counted.append(own)
            yield pa.RecordBatch.from_arrays([
                part.column("key"), part.column("toxic"), pa.array([list(c) for c in counted], pa.list_(pa.string())),
                pa.array([list(c.values()) for c in counted], pa.list_(pa.int64()))], ["key", "toxic", "words", "counts"])


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
          training_rows: int = TRAINING_ROWS) -> OrdinalModel:
    """Fit on the labelled documents, or a seeded share of them that leaves about ``training_rows``.

    Features are the words and word beginnings that toxic documents hold significantly more often (log-likelihood
    ratio, at a level set for the number of words tested), at most ``FEATURES``. The labels only
    say toxic or not; the grade of a toxic row is 2 if it holds such features at least as often as the
    median of the toxic rows that have any, else 1. So there are two ordered borders.

    Rows with a null id, null label or null text do not train; a repeated label row counts
    once. Without toxic and clean rows the model has no words and says 0 for all.
    """
    known = labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("key")).agg(
        F.max(F.col(label_column).cast("int")).alias("toxic"))
    share = min(1.0, training_rows / max(1, known.count()))
    picked = known.filter(F.pmod(F.xxhash64("key", F.lit(91)), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(id_column).alias("key"), F.col(text_column).alias("text")).filter("text IS NOT NULL").join(
        F.broadcast(picked), "key")  # about training_rows rows of two numbers
    kind = rows.schema["key"].dataType.simpleString()
    counted = cut(rows.select("key", "toxic", "text").mapInArrow(
        _counter, f"key {kind}, toxic int, words array<string>, counts array<bigint>"))
    totals = counted.agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("toxic") <= 0).alias("clean")).first()
    a_all, b_all = totals["toxic"], totals["clean"]
    if not a_all or not b_all:
        return OrdinalModel({}, np.array([20.0, 21.0]))
    tested = cut(counted.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.count_if(F.col("toxic") > 0).alias("a"), F.count_if(F.col("toxic") <= 0).alias("b")).filter(
        F.col("a") + F.col("b") >= LEAST_DOCUMENTS))
    level = NormalDist().inv_cdf(1 - CHANCE / max(2, tested.count()))
    held = F.col("a") + F.col("b")
    of_toxic, of_clean = held * a_all / (a_all + b_all), held * b_all / (a_all + b_all)
    ratio = 2 * (F.col("a") * F.log(F.greatest("a", F.lit(1)) / of_toxic) + F.col("b") * F.log(F.greatest("b", F.lit(1)) / of_clean))
    z = F.when(F.col("a") > of_toxic, F.sqrt(F.greatest(ratio, F.lit(0.0)))).otherwise(0.0)
    chosen = [r["word"] for r in tested.withColumn("z", z).filter(F.col("z") > level).orderBy(F.desc("z"), "word").limit(FEATURES).collect()]
    if not chosen:
        return OrdinalModel({}, np.array([20.0, 21.0]))
    number = {w: k for k, w in enumerate(chosen)}
    terms = F.arrays_zip("words", "counts")
    kept = counted.select("toxic", F.filter(terms, lambda t: t["words"].isin(chosen)).alias("hits")).collect()
    order = np.array([r["toxic"] > 0 for r in kept])
    total = np.array([sum(h["counts"] for h in r["hits"]) for r in kept])
    marked = total[order & (total > 0)]
    middle = float(np.median(marked)) if len(marked) else 1.0
    grades = order.astype(np.int64) + (order & (total > 0) & (total >= middle))
    where = [(i, number[h["words"]], feature(h["counts"])) for i, r in enumerate(kept) for h in r["hits"]]
    rows_, columns, values = (np.array(x) for x in zip(*where))
    weight, borders = fit_ordinal(rows_.astype(np.int64), columns.astype(np.int64), values, grades, len(chosen), 3)
    return OrdinalModel(dict(zip(chosen, weight.tolist())), borders)


def _grader(model: OrdinalModel):
    @lean
    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                chance = model.at_least(np.array([model.score(x) for x in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays(
                    [c for n, c in zip(part.schema.names, part.columns) if n != "text"]
                    + [pa.array(chance[:, 0]), pa.array(chance.sum(axis=1)), pa.array((chance >= 0.5).sum(axis=1), pa.int32())],
                    [n for n in part.schema.names if n != "text"] + ["p_toxic", "severity", "grade"])
    return run


def grade(docs: DataFrame, model: OrdinalModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, p_toxic, severity, grade, rejected`` per row: the chance of grade 1 or more, the expected grade, the grade reached
    with a chance of at least one half, and whether that is 1 or more.

    One pass without a shuffle over whole texts; the model, at most ``FEATURES`` words, travels
    with the tasks. A null text is empty and gets the chances of a text without marked words. Null
    and repeated ids are kept. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_grader(model), f"id {kind}, p_toxic double, severity double, grade int").withColumn(
        "rejected", F.col("grade") > 0)


def _keeper(model: OrdinalModel):
    @lean
    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                scores = np.array([model.score(x or "") for x in part.column("text").to_pylist()])
                yield part.filter(pa.array(model.at_least(scores)[:, 0] < 0.5))
    return run


def without_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of ``docs`` whose ``text`` :func:`grade` does not reject, unchanged."""
    return docs.mapInArrow(_keeper(model), docs.schema)
