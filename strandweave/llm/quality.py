"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees over statistics of labelled texts propose rules: each path from
the root of a tree is a conjunction of thresholds. A logistic regression with
an L1 penalty weighs the rules and clipped linear terms; most weights come out
as zero. What is left is compiled into one Spark column expression, so scoring
adds no Python to the pass that takes the statistics.

Defined results: null texts count as empty; an empty text is scored like any
other, from its statistics; a document labelled twice trains with both rows;
null labels are ignored; without labels, or with one kind only, the score is
the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, trimmed, tune
from .trees import boost, sigmoid

#: Labelled rows that train the rules.
SAMPLE_ROWS = 8192
THRESHOLD = 0.7

STATISTICS = (
    "log_words", "word_length", "longest_word", "distinct_words", "top_word", "word_entropy", "letters", "digits", "upper",
    "marks", "spaces", "beyond_ascii", "byte_entropy", "lines", "distinct_lines", "pipes", "odd_marks", "ends_in_mark", "doubled_word", "sentences", "short_words", "pair_repeats",
)


def stat(name: str) -> str:
    """The column of a statistic; the prefix keeps it apart from the table's own columns."""
    return f"__stat_{name}"


_CLASS = np.zeros((256, 8), np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (_b < 128 and _c.isalpha(), 48 <= _b <= 57, 65 <= _b <= 90, 32 < _b < 127 and not _c.isalnum(), _b in (9, 10, 13, 32), _b >= 128, _b == 124, _b < 127 and _c in "#$%&*@^~_=+<>\\{}[]|")


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of ``STATISTICS``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(len(raw), 1)
    shares = counts @ _CLASS / size
    p = counts[counts > 0] / size
    words = raw.split()
    n = max(len(words), 1)
    tally = Counter(words)
    q = np.fromiter(tally.values(), np.float64, len(tally)) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:])))
    return [
        float(np.log1p(len(words))),
        len(b"".join(words)) / n,
        float(np.log1p(max(map(len, words), default=0))),
        len(tally) / n,
        float(q.max()) if len(q) else 0.0,
        float(-(q * np.log(q)).sum() / np.log(n + 1)),
        *map(float, shares[:6]),
        float(-(p * np.log2(p)).sum()),
        len(lines) / n,
        len(set(lines)) / max(len(lines), 1),
        float(shares[6]),
        float(shares[7]),
        sum([w[-1:] in b"#$%&*@^~_=+<>|" for w in words]) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        raw.count(b".") / n,
        sum([len(w) < 3 for w in words]) / n,
        1 - pairs / max(len(words) - 1, 1) if pairs else 0.0,
    ]


def with_statistics(documents: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` (columns of ``documents``) and a double column for each statistic of ``text``."""
    kinds = dict(documents.dtypes)

    def run(batches):
        for batch in batches:
            rows = [statistics(t) for t in batch.column(len(keep)).to_pylist()]
            columns = np.array(rows, np.float64).reshape(-1, len(STATISTICS)).T
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), *map(pa.array, columns)], [*keep, *map(stat, STATISTICS)])

    tune(documents.sparkSession)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{stat(s)} double" for s in STATISTICS)])
    return documents.select(*keep, "text").mapInArrow(trimmed(run), schema)


@dataclass
class Rules:
    """A logistic sum: bias, linear terms (statistic, low, high, weight), rules (conditions, weight)."""

    bias: float
    linear: list[tuple[int, float, float, float]]
    rules: list[tuple[tuple[tuple[int, str, float], ...], float]]

    def column(self) -> Column:
        """The score as one Spark expression over the statistics' columns."""
        terms = [F.lit(self.bias)]
        for s, low, high, w in self.linear:
            terms.append(F.least(F.greatest(F.col(stat(STATISTICS[s])), F.lit(low)), F.lit(high)) * F.lit(w))
        for conditions, w in self.rules:
            holds = reduce(lambda a, b: a & b, [F.col(stat(STATISTICS[s])) <= cut if sign == "<=" else F.col(stat(STATISTICS[s])) > cut for s, sign, cut in conditions])
            terms.append(F.when(holds, F.lit(w)).otherwise(F.lit(0.0)))
        total = reduce(lambda a, b: a + b, terms)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(total, F.lit(-40.0)), F.lit(40.0))))


def _design(x: np.ndarray, rules: list) -> np.ndarray:
    out = np.empty((len(x), len(rules)))
    for k, conditions in enumerate(rules):
        out[:, k] = np.logical_and.reduce([x[:, s] <= c if sign == "<=" else x[:, s] > c for s, sign, c in conditions])
    return out


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """L1-penalised logistic regression by accelerated proximal gradient; the bias isn't penalised."""
    n = len(y)
    norm = np.linalg.norm(x[: min(n, 2000)], 2) ** 2 / min(n, 2000) if n else 1.0
    step = 4 / (norm + 1)
    w, b = np.zeros(x.shape[1]), 0.0
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        r = (sigmoid(x @ v + c) - y) / n
        w1 = v - step * (x.T @ r)
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - step * penalty, 0)
        b1 = c - step * r.sum()
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    return float(b), w


def train(x: np.ndarray, y: np.ndarray, trees: int = 40, penalties: tuple[float, ...] = (0.03, 0.01, 0.003, 0.001)) -> Rules:
    """Rules from trees, weights from the lasso; the penalty is chosen on a third of the rows."""
    if len(y) == 0 or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999))
        return Rules(float(np.log(p / (1 - p))), [], [])
    found = boost(x, y, trees=trees, depth=3, rate=0.15, min_rows=max(3, len(y) // 400))
    rules = list(dict.fromkeys(p for t in found.trees for p in t.paths()))
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    clipped = np.clip(x, low, high)
    middle, spread = clipped.mean(0), clipped.std(0) / 0.4 + 1e-9
    both = np.hstack([(clipped - middle) / spread, _design(x, rules)])
    third = np.arange(len(y)) % 3 == 0

    def loss(p, y):
        return -np.mean(np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-9, 1)))

    best = min(penalties, key=lambda a: (lambda b, w: loss(sigmoid(both[third] @ w + b), y[third]))(*_lasso(both[~third], y[~third], a)))
    b, w = _lasso(both, y, best)
    k = x.shape[1]
    linear = [(s, float(low[s]), float(high[s]), float(w[s] / spread[s])) for s in range(k) if abs(w[s]) > 1e-6]
    b -= sum(w[s] / spread[s] * middle[s] for s in range(k) if abs(w[s]) > 1e-6)
    return Rules(float(b), linear, [(r, float(a)) for r, a in zip(rules, w[k:]) if abs(a) > 1e-6])


def fit(documents: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, rows: int = SAMPLE_ROWS) -> Rules:
    """Train on at most ``rows`` labelled rows outside the held-out fold, chosen by a hash of doc_id."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & (fold("doc_id", folds) != held))
    chosen = bounded_sample(known, "doc_id", rows)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = with_statistics(texts, ["doc_id", "quality"]).orderBy("doc_id", "quality", *map(stat, STATISTICS)).limit(4 * rows).toPandas()
    return train(got[list(map(stat, STATISTICS))].to_numpy(np.float64), got["quality"].to_numpy(np.float64))


def quality(documents: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = THRESHOLD, rules: Rules | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    rules = rules or fit(documents, labels, folds, held)
    scored = with_statistics(documents, ["doc_id"]).select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), rules.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float, rules: Rules | None = None) -> DataFrame:
    """The documents with a score of ``threshold`` or more, with all their columns."""
    rules = rules or fit(documents, labels)
    columns = documents.columns
    return with_statistics(documents, columns).filter(rules.column() >= threshold).select(*columns)
