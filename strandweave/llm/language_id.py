"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in segments of ``SEGMENT`` bytes, one
recurrence from each side, and gives every byte position a distribution over
the languages. A document's probability of a language is the mean over all
its positions, so the whole text counts. Training is plain backpropagation
through time in numpy, on the driver, over a bounded sample of labelled rows.

Defined results: null texts and texts without a letter are ``und`` with score
0; a table without any learnable label gives ``und`` everywhere; rows repeated
are answered each; a null doc_id counts as the empty text in the fold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_sample, fold, tune

SEGMENT = 128
#: Bounds of the training sample: rows in all, rows of a language.
SAMPLE_ROWS, LANGUAGE_ROWS = 3000, 600
#: Segments that run through the recurrence together.
WIDTH = 4096


@dataclass
class Network:
    """Both directions' input tables (256 x 3H, with bias) and recurrent weights (H x 3H), and the output layer."""

    table: np.ndarray
    recur: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    languages: list[str]

    @property
    def width(self) -> int:
        return self.recur.shape[1]


def _new(languages: list[str], hidden: int, rng: np.random.Generator) -> Network:
    scale = 1 / np.sqrt(hidden)
    middle = np.repeat([0.2, 0.2, 1.0], hidden)  # gates start half open
    return Network(
        (rng.normal(0, 0.3, (2, 256, 3 * hidden)) * middle + 0.5 * (middle < 1)).astype(np.float32),
        (rng.uniform(-scale, scale, (2, hidden, 3 * hidden)) * middle).astype(np.float32),
        rng.normal(0, scale, (2 * hidden, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
        languages,
    )


def _recur(table: np.ndarray, recur: np.ndarray, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (T, H, B) of one direction. Gates are clipped sums, the candidate is a tanh."""
    n, batch = recur.shape[0], steps.shape[1]
    columns, across = np.ascontiguousarray(table.T), np.ascontiguousarray(recur.T)
    states = np.empty((len(steps), n, batch), np.float32)
    h = np.zeros((n, batch), np.float32)
    given, back = np.empty((3 * n, batch), np.float32), np.empty((3 * n, batch), np.float32)
    for t, x in enumerate(steps):
        np.take(columns, x, axis=1, out=given, mode="clip")
        np.matmul(across, h, out=back)
        gates = given[: 2 * n]
        gates += back[: 2 * n]
        np.maximum(gates, 0, out=gates)
        np.minimum(gates, 1, out=gates)
        new = given[2 * n :]
        if keep is not None:
            keep.append([h, gates.copy(), None, back[2 * n :].copy()])
        back[2 * n :] *= gates[n:]
        new += back[2 * n :]
        np.tanh(new, out=new)
        if keep is not None:
            keep[-1][2] = new.copy()
        h = np.subtract(h, new, out=states[t])
        h *= gates[:n]
        h += new
    return states


def _softmax(x: np.ndarray) -> np.ndarray:
    """Over the second axis from the end; states lie in [-1, 1], so the sums are small enough for exp."""
    np.exp(x, out=x)
    x /= x.sum(-2, keepdims=True)
    return x


def train(texts: list[str], labels: list[str], hidden: int = 8, steps: int = 400, batch: int = 128, length: int = 64, rate: float = 0.02, seed: int = 7) -> Network | None:
    """Fit the network to segments drawn evenly from the languages, short texts and the ends of texts among them. A
    language whose texts are all empty isn't learned; None without any."""
    cut: dict[str, list[np.ndarray]] = {}
    for text, label in zip(texts, labels):
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        if len(raw):
            cut.setdefault(label, []).extend(raw[i : i + length] for i in range(0, len(raw), length))
    languages = sorted(cut)
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    net = _new(languages, hidden, rng)
    pool = [cut[k] for k in languages]
    params = [net.table, net.recur, net.out, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        want = rng.integers(0, len(languages), batch)
        drawn = [pool[k][rng.integers(len(pool[k]))] for k in want]
        x = np.full((length, batch), 32, np.int64)  # blanks after a short piece; its positions alone count
        there = np.arange(length)[:, None] < np.array([len(d) for d in drawn])
        for i, d in enumerate(drawn):
            x[: len(d), i] = d
        kept: list[list] = [[], []]
        ahead = _recur(net.table[0], net.recur[0], x, kept[0])
        behind = _recur(net.table[1], net.recur[1], x[::-1], kept[1])[::-1]
        both = np.concatenate([ahead, behind], 1)
        error = _softmax(net.out.T @ both + net.bias[:, None])
        error[:, want, np.arange(batch)] -= 1
        error *= (there / there.sum(0) / batch).astype(np.float32)[:, None, :]  # every piece weighs the same
        grads = [np.zeros_like(net.table), np.zeros_like(net.recur), np.einsum("thb,tlb->hl", both, error, optimize=True), error.sum((0, 2))]
        passed = net.out @ error
        for d, order in ((0, x), (1, x[::-1])):
            outer = passed[:, :hidden] if d == 0 else passed[::-1, hidden:]
            carry, given = np.zeros((hidden, batch), np.float32), np.empty((length, 3 * hidden, batch), np.float32)
            for t in range(length - 1, -1, -1):
                h, gates, new, inner = kept[d][t]
                dh = carry + outer[t]
                z, r = gates[:hidden], gates[hidden:]
                dn = dh * (1 - z) * (1 - new * new)
                open_ = (gates > 0) & (gates < 1)
                given[t, :hidden], given[t, hidden : 2 * hidden], given[t, 2 * hidden :] = dh * (h - new) * open_[:hidden], dn * inner * open_[hidden:], dn
                back = np.concatenate([given[t, : 2 * hidden], dn * r])
                grads[1][d] += h @ back.T
                carry = dh * z + net.recur[d] @ back
            seen = order.ravel()
            for c in range(3 * hidden):
                grads[0][d, :, c] = np.bincount(seen, given[:, c].ravel(), 256)
        now = rate * min(1, 20 * step / steps) * (1 - 0.9 * step / steps)
        for p, g, m, v in zip(params, grads, first, second):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def predict(net: Network, texts: list[str | None]) -> np.ndarray:
    """Mean position probabilities, a row for each text; zeros for an empty one."""
    out = np.zeros((len(texts), len(net.languages)))
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    owners = np.repeat(np.arange(len(raws)), [-(-len(r) // SEGMENT) for r in raws])
    if not len(owners):
        return out
    buffer = b"".join(r + b" " * (-len(r) % SEGMENT) for r in raws)
    segments = np.frombuffer(buffer, np.uint8).reshape(-1, SEGMENT)
    last = np.cumsum([-(-len(r) // SEGMENT) for r in raws]) - 1
    size = np.full(len(segments), SEGMENT)
    for r, at in zip(raws, last):
        if r:
            size[at] = (len(r) - 1) % SEGMENT + 1
    half = net.width
    front, rear, bias = np.ascontiguousarray(net.out[:half].T), np.ascontiguousarray(net.out[half:].T), net.bias[:, None]
    for at in range(0, len(segments), WIDTH):
        x = np.ascontiguousarray(segments[at : at + WIDTH].T)
        ahead = _recur(net.table[0], net.recur[0], x)
        behind = _recur(net.table[1], net.recur[1], x[::-1])
        total, sizes = np.zeros((len(net.languages), x.shape[1]), np.float32), size[at : at + WIDTH]
        for t in range(SEGMENT):
            p = front @ ahead[t]
            p += rear @ behind[SEGMENT - 1 - t]
            p += bias
            p = _softmax(p)
            if short := np.flatnonzero(sizes <= t).tolist():
                p[:, short] = 0
            total += p
        np.add.at(out, owners[at : at + WIDTH], total.T)
    return out / np.maximum([len(r) for r in raws], 1)[:, None]


def fit(documents: DataFrame, folds: int = 5, held: int = 0, sample_rows: int = SAMPLE_ROWS, language_rows: int = LANGUAGE_ROWS, **kinds) -> Network | None:
    """Train on labelled rows outside the held-out fold: at most ``language_rows`` of each
    language and ``sample_rows`` in all, chosen by a hash of doc_id."""
    known = documents.select("doc_id", "lang").filter(F.col("lang").isNotNull() & (fold("doc_id", folds) != held))
    few = known.withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    for by in (("lang", "deal"), ("lang",)):  # a common language is no single task
        order = Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id")
        few = few.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= language_rows)
    chosen = bounded_sample(few.select("doc_id"), "doc_id", sample_rows).distinct()
    rows = (
        documents.select("doc_id", "lang", "text")
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .join(F.broadcast(chosen), "doc_id")
        .orderBy("doc_id", "lang", "text")
        .limit(2 * sample_rows)
        .collect()
    )
    return train([r.text for r in rows], [r.lang for r in rows], **kinds)


def identify(documents: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``documents(doc_id, text)``."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            has = [bool(t) and (t[:64].isalpha() or any(map(str.isalpha, t))) for t in texts]
            p = predict(net, texts) if net else np.zeros((len(texts), 1))
            best = p.argmax(1) if len(texts) else []
            names = [net.languages[b] if ok and net else "und" for ok, b in zip(has, best)]
            score = [float(min(1.0, max(0.0, p[i, b]))) if ok and net else 0.0 for i, (ok, b) in enumerate(zip(has, best))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    tune(documents.sparkSession)
    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def language_id(documents: DataFrame, folds: int = 5, held: int = 0, net: Network | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; learns from the rows whose fold isn't ``held`` unless a network is given."""
    net = net or fit(documents, folds, held)
    return identify(documents, net).select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")
