"""Language-model scores by stupid backoff, from n-gram counts of the whole corpus.

Words are lower-cased (A-Z) runs between white space. With order N, a word's
score is c(context, word) / c(context) for the longest context of at most
N - 1 words whose n-gram occurs at least ``LEAST`` times, times ``ALPHA`` for
each shorter context tried; at last c(word) / all words. A document's score is
the mean of its words' log scores.

The work is relational, over packed rows. Each batch of documents is exploded
into its n-grams, as 64-bit hashes, and counted; its rows of the relation
``grams(batch, part, grams, counts)`` hold the distinct ones, dealt by hash.
A part of the count table is the sum by n-gram of all rows of a hash range;
joined back to the rows that asked, it answers every batch with the sums. The
answers meet the batch's documents, which are exploded once more and summed.
An n-gram crosses the network once for each batch that has it and not once for
each occurrence. There is a part for every ``PART_GRAMS`` n-grams of the
corpus, so a part's work is the same at every size, and a frequent n-gram is
at most one entry of each batch; no table of counts is broadcast or collected.
(A row for each n-gram would need twice the bytes: 12 or more after
compression, for about 6 of a packed hash, its count included.)

Defined results: null texts count as empty; a document without a word has
score null and 0 words; equal rows are scored each; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, hash_slices, pack_counts, pack_hashes, pack_texts, stable, text_batches, tune, unpack_counts, unpack_hashes, unpack_texts
from .hashing import K, mix, word_hashes

ORDER, ALPHA, LEAST = 3, 0.4, 2
#: Characters of a batch's texts.
BATCH_CHARS = 12 << 20
#: N-grams that a part counts, about, and the least number of parts.
PART_GRAMS, PARTS = 2 << 20, 16


def ngrams(texts: list[str | None], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sizes, hashes): words of each text; for each order an array of hashes, one for each word
    of all texts: the n-gram that ends there, 0 where the text has too few words before it."""
    words = [word_hashes(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    del words
    starts = np.cumsum(sizes) - sizes
    rows = [mix(flat + np.uint64(1)) | np.uint64(1)]
    for k in range(1, order):
        longer = np.zeros(len(flat), np.uint64)
        # the n-gram one word shorter that ends a word earlier, and this word
        longer[1:] = mix((rows[-1][:-1] * K) ^ flat[1:] + np.uint64(k)) | np.uint64(1)
        for at in range(k):
            longer[starts[sizes > at] + at] = 0
        rows.append(longer)
    return sizes, rows


def distinct_grams(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of all orders, sorted, and how often each is there. One sort in place: a batch's memory counts."""
    h = np.concatenate(rows)
    h.sort()
    h = h[np.searchsorted(h, 1) :]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[new], np.diff(np.append(new, len(h)))


def _looked_up(found: np.ndarray, sums: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The sums of n-grams, 0 for none: looked up in the order of their hashes, which memory likes."""
    out = np.zeros(len(grams), np.int64)
    order = np.argsort(grams)
    order = order[np.searchsorted(grams, 1, sorter=order) :]
    out[order] = sums[np.searchsorted(found, grams[order])]
    return out


def score(documents: DataFrame, order: int = ORDER, alpha: float = ALPHA, least: int = LEAST, batch_chars: int = BATCH_CHARS, part_grams: int = PART_GRAMS) -> DataFrame:
    """``doc_id, n_words, n_backed_off, log_score``: words, words scored by a shorter context than was there, and the mean log score."""
    spark = documents.sparkSession
    tune(spark)
    docs = stable(documents.select("doc_id", "text"), "texts")
    kind, doc_type = dict(docs.dtypes)["doc_id"], arrow_type(docs, "doc_id")
    total = int(docs.select("text").mapInArrow(_count_words, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    parts = max(PARTS, -(-total * order // part_grams))

    def distinct(rows):
        for key, held in text_batches(rows, batch_chars):
            found, counts = distinct_grams(ngrams([t for _, t in held], order)[1])
            cut = hash_slices(found, parts)
            used = np.flatnonzero(np.diff(cut)).tolist()
            for at in range(0, len(used), 16):
                some = used[at : at + 16]
                columns = [[key] * len(some), some, [pack_hashes(found[cut[p] : cut[p + 1]]) for p in some], [pack_counts(counts[cut[p] : cut[p + 1]]) for p in some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.binary(), pa.binary()))], ["batch", "part", "grams", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        asked = [unpack_hashes(x.as_py()) for x in table.column("grams")]
        all_, own = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.concatenate([unpack_counts(x.as_py(), len(a)) for x, a in zip(table.column("counts"), asked)])
        sums = np.bincount(own, counts, len(all_)).astype(np.int64)
        each = np.split(sums[own], np.cumsum([len(a) for a in asked])[:-1])
        sizes = pa.array([len(e) for e in each], pa.int32())
        return pa.table({"batch": table.column("batch"), "part": table.column("part"), "n": sizes, "sums": pa.array(map(pack_counts, each), pa.binary())})

    def packed(rows):
        for key, held in text_batches(rows, batch_chars):
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([[d for d, _ in held]], pa.list_(doc_type)), pa.array([pack_texts([t for _, t in held])], pa.binary())], ["batch", "docs", "texts"])

    grams = docs.mapInArrow(distinct, "batch string, part int, grams binary, counts binary")
    answers = grams.repartition(parts, "part").groupBy("part").applyInArrow(answer, "batch string, part int, n int, sums binary")
    lists = answers.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("part", "n", "sums"))).alias("answers"))

    def scored(rows):
        for batch in rows:
            for key, ids, texts, answers_ in zip(*(batch.column(c).to_pylist() for c in range(4))):
                texts = unpack_texts(texts, len(ids))
                sizes, h = ngrams(texts, order)
                found, _ = distinct_grams(h)
                sums = np.concatenate([unpack_counts(a["sums"], a["n"]) for a in answers_ or []] or [np.zeros(0, np.int64)])
                if len(sums) != len(found):
                    raise RuntimeError(f"batch {key} was cut in another way than its counts; the input isn't stable")
                c = [_looked_up(found, sums, x) for x in h]
                yield _finish(batch.column(1).type.value_type, ids, sizes, h, c)

    def _finish(id_type, ids, sizes, h, c):
        n = len(h[0])
        logs, done, tried = np.zeros(n), np.zeros(n, bool), np.zeros(n, np.int64)
        for k in range(order - 1, 0, -1):
            there = (h[k] != 0) & ~done
            hit = there & (c[k] >= least)
            before = np.flatnonzero(hit)
            logs[before] = np.log(c[k][before]) - np.log(c[k - 1][before - 1]) + np.log(alpha) * tried[before]
            done |= hit
            tried += there & ~hit
        rest = ~done
        logs[rest] = np.log(c[0][rest]) - np.log(max(total, 1)) + np.log(alpha) * tried[rest]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sums = np.bincount(owner, logs, len(sizes))
        backed = np.bincount(owner, tried > 0, len(sizes)).astype(np.int64)
        mean = [float(s / n) if n else None for s, n in zip(sums, sizes)]
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(sizes), pa.array(backed), pa.array(mean, pa.float64())], ["doc_id", "n_words", "n_backed_off", "log_score"])

    met = docs.mapInArrow(packed, f"batch string, docs array<{kind}>, texts binary").join(lists, "batch", "left")
    return met.select("batch", "docs", "texts", "answers").mapInArrow(scored, f"doc_id {kind}, n_words long, n_backed_off long, log_score double")


def _count_words(rows):
    for batch in rows:
        yield pa.RecordBatch.from_arrays([pa.array([sum(len((t or "").encode("utf-8", "surrogatepass").split()) for t in batch.column(0).to_pylist())], pa.int64())], ["n"])


def oracle(alpha: float = ALPHA, least: int = LEAST) -> str:
    """The scores of order 3 in DuckDB SQL."""
    return f"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS c, unnest(list_prepend(NULL, w)[1 : len(w)]) AS b, unnest(list_prepend(NULL, list_prepend(NULL, w))[1 : len(w)]) AS a FROM d),
u AS (SELECT c AS word, count(*) AS n FROM p GROUP BY c), g AS (SELECT b, c, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY b, c), h AS (SELECT a, b, c, count(*) AS n FROM p WHERE a IS NOT NULL GROUP BY a, b, c), n AS (SELECT count(*) AS n FROM p),
s AS (SELECT p.doc_id, p.a IS NOT NULL AND h.n < {least} OR p.b IS NOT NULL AND p.a IS NULL AND g.n < {least} AS backed,
  CASE WHEN h.n >= {least} THEN ln(h.n / gab.n)
    WHEN g.n >= {least} THEN CASE WHEN p.a IS NOT NULL THEN ln({alpha}) ELSE 0 END + ln(g.n / ub.n)
    ELSE (CASE WHEN p.a IS NOT NULL THEN 2 WHEN p.b IS NOT NULL THEN 1 ELSE 0 END) * ln({alpha}) + ln(uc.n / n.n) END AS v
  FROM p LEFT JOIN h ON p.a = h.a AND p.b = h.b AND p.c = h.c LEFT JOIN g ON p.b = g.b AND p.c = g.c LEFT JOIN g gab ON p.a = gab.b AND p.b = gab.c LEFT JOIN u ub ON p.b = ub.word JOIN u uc ON p.c = uc.word CROSS JOIN n)
SELECT d.doc_id, coalesce(x.n_words, 0) AS n_words, coalesce(x.backed, 0) AS n_backed_off, round(x.v, 6) AS log_score
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE backed) AS backed, avg(v) AS v FROM s GROUP BY doc_id) x USING (doc_id)"""
