"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

The size of a document is its number of words. Sources share the words of the
mix by their weights, and none is repeated more than ``repeats`` times: what a
source can't take is shared out by weight again. The shares follow from
Newton's steps on the level at which sources fill up, a few sums over the table
of sources each.

A source whose target holds whole epochs gives every document that often. The
rest is drawn: each document has an exponential key, divided by its quality
weight, from a hash of its id and text, and the documents with the smallest
keys are taken until the budget is spent; of the last one, its first words.

No source is sorted in a task, so one may hold most of all rows: keys are
summed in buckets, the bucket that holds the end of the budget is found, and
again within it, in ``SHIFTS`` steps, so that only the documents of a bucket
2 ** -30 wide are put in order. Everything is DataFrame functions; the only
shuffles are those of sums by source and bucket. What lies in the driver are
sums.

Defined results: null and empty texts have size 0 and are taken 0 times; a null
source is a source, the last in order; sources without words have target 0;
an empty table has no rows; quality weights that are null, not finite or not
positive count as the least weight; equal rows are equally likely, and as many
of them are taken as if they had different ids; reruns agree. Equal rows are
counted before they are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved

BLANK = r"\x20\x09-\x0D"
#: A document's words are taken at most so often.
REPEATS = 3
#: Weights of sources in the order of their names, again from the first after the last.
CYCLE = (1, 2, 3)
#: Keys are whole numbers of 2 ** -FRACTION; each step of the search drops fewer of their bits.
FRACTION, SHIFTS = 40, (34, 22, 10)
#: Quality weights are held within these bounds.
LEAST_WEIGHT, MOST_WEIGHT = 1e-4, 1e4


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("long")


def letters_weight(text: Column) -> Column:
    """A document's quality weight by its text alone: the square of its share of letters, over that of common prose, at most 1."""
    share = F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) / F.greatest(F.length(text), F.lit(1))
    return F.least(F.pow(share / 0.8, F.lit(2.0)), F.lit(1.0))


def sampling_key(weight: Column, seed: int, *of: str) -> Column:
    """The exponential key of a row over its weight, as a whole number: rows with small keys are drawn first."""
    u = (F.shiftrightunsigned(F.xxhash64(*of, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    held = F.when(F.isnan(weight) | weight.isNull() | (weight < LEAST_WEIGHT), LEAST_WEIGHT).otherwise(F.least(weight, F.lit(MOST_WEIGHT)))
    return F.floor(-F.log(u) / held * float(1 << FRACTION)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with their number from 0 in the order of ``source``, null last, without gathering them in a task."""
    ranged = saved(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ranged.withColumn("at", inner - 1).join(F.broadcast(before), "part").withColumn("number", F.col("at") + F.col("before")).drop("part", "at", "before")


def targets(sources: DataFrame, weight: Column, repeats: int = REPEATS, total: int | None = None) -> DataFrame:
    """``sources`` (with ``source_size``) and their ``target``: ``total`` words (default: all there are) shared by ``weight``, at
    most ``repeats`` times a source's size, the rest shared out again. The total is no more than all sources can take."""
    held = saved(sources.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * F.lit(repeats)), "weights")
    all_, most = held.agg(F.sum("source_size"), F.sum("most")).first()
    total = min((all_ or 0) if total is None else total, most or 0)
    level, full = 0.0, -1
    while True:
        is_full = F.col("most") < F.lit(level) * F.col("weight")
        spent, n, rest = held.agg(F.sum(F.when(is_full, F.col("most"))), F.count(F.when(is_full, 1)), F.sum(F.when(~is_full, F.col("weight")))).first()
        if n == full or not rest:
            break
        full, level = n, (total - (spent or 0)) / rest
    return held.withColumn("target", F.when(is_full, F.col("most").cast("double")).otherwise(F.lit(level) * F.col("weight"))).drop("most")


def _ends(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``skey, bucket, rest``: where each source's budget ends: the bucket of keys, at the last shift, and what is left of the
    budget for it."""
    state, inside = plan.filter("rest > 0").select("skey", "rest"), rows
    for step, shift in enumerate(SHIFTS):
        sums = inside.groupBy("skey", F.shiftright("k", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("skey").orderBy("bucket"))
        met = sums.withColumn("upto", upto).join(state.select("skey", "rest"), "skey").filter("upto > rest and upto - words <= rest")
        state = saved(met.select("skey", "bucket", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest")), f"ends-{step}")
        inside = rows.join(state.drop("rest"), "skey").filter(F.shiftright("k", shift) == F.col("bucket")).drop("bucket")
    return state


def _planned(documents: DataFrame, source_weight: Column | None, quality: Column | None, repeats: int, total: int | None, seed: int, also: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows (``also`` of their columns, ``skey, size, k``), and ``skey, source, source_size, target, epochs, bucket, rest``."""
    if repeats < 1 or int(repeats) != repeats:
        raise ValueError("repeats is a whole number from 1")
    skey = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # joins meet null too
    key = sampling_key(letters_weight(F.col("text")) if quality is None else quality, seed, "doc_id", "text")
    rows = documents.select(*also, skey.alias("skey"), "source", n_words(F.col("text")).alias("size"), key.alias("k"))
    narrow = saved(rows.select("doc_id", "skey", "source", "size", "k"), "mix")
    sources = numbered(narrow.groupBy("skey", "source").agg(F.sum("size").alias("source_size")))
    weight = F.get(F.array(*map(F.lit, CYCLE)), F.pmod("number", F.lit(len(CYCLE))).cast("int")) if source_weight is None else source_weight
    budget = F.round("target").cast("long")
    plan = targets(sources, weight, repeats, total).withColumn("epochs", F.expr("cast(round(target) as bigint) div greatest(source_size, 1)"))
    plan = saved(plan.withColumn("rest", budget - F.col("epochs") * F.col("source_size")), "plan")
    plan = saved(plan.drop("rest").join(_ends(narrow, plan), "skey", "left").withColumn("bucket", F.coalesce("bucket", F.lit(-1).cast("long"))), "budgets")
    return (narrow if set(also) <= {"doc_id"} else rows), plan


def _at_end(met: DataFrame) -> DataFrame:
    """Of rows in the bucket where their source's budget ends: distinct ones with their number ``n``, how many of them are
    taken whole, ``whole``, and how many words of the next one, ``part``."""
    each = met.groupBy("skey", "k", "doc_id", "size", "source_size", "target", "epochs", "rest").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("skey").orderBy("k", "doc_id", "size"))
    left = F.greatest(F.least(F.col("rest") - upto + F.col("size") * F.col("n"), F.col("size") * F.col("n")), F.lit(0))
    return each.withColumn("left", left).withColumn("whole", F.expr("left div greatest(size, 1)")).withColumn("part", F.col("left") - F.col("whole") * F.col("size"))


def mix(documents: DataFrame, source_weight: Column | None = None, quality: Column | None = None, repeats: int = REPEATS, total: int | None = None, seed: int = 0) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every document.

    ``source_weight`` is an expression of ``source`` and its ``number`` in order
    (default: 1, 2, 3, repeating), ``quality`` one of the documents' columns
    (default: ``letters_weight`` of the text), ``total`` the words of the mix."""
    rows, plan = _planned(documents, source_weight, quality, repeats, total, seed, ["doc_id"])
    met = rows.select("doc_id", "skey", "size", "k").join(plan.select("skey", "source_size", "target", "epochs", "bucket", "rest"), "skey")
    at = F.shiftright("k", SHIFTS[-1])
    once = F.when(at < F.col("bucket"), F.col("size")).otherwise(F.lit(0))
    out = ["doc_id", "size", "source_size", "target", "taken"]
    clear = met.filter(at != F.col("bucket")).withColumn("taken", F.col("epochs") * F.col("size") + once).select(*out)
    ends = _at_end(met.filter(at == F.col("bucket"))).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    drawn = F.when(F.col("copy") <= F.col("whole"), F.col("size")).when(F.col("copy") == F.col("whole") + 1, F.col("part")).otherwise(F.lit(0))
    return clear.unionByName(ends.withColumn("taken", F.col("epochs") * F.col("size") + drawn).select(*out))


def mixture(documents: DataFrame, source_weight: Column | None = None, quality: Column | None = None, repeats: int = REPEATS, total: int | None = None, seed: int = 0) -> DataFrame:
    """The mix itself: a row of ``documents`` for each time that it is taken, with its ``epoch`` from 0; where only some words
    are taken the text ends with the last of them. ``n_chars``, if there is one, follows a cut text."""
    columns = documents.columns
    own = [f"own_{n}" for n in range(len(columns))]
    held = documents.select("*", *(F.col(f"`{c}`").alias(o) for c, o in zip(columns, own)))
    rows, plan = _planned(held, source_weight, quality, repeats, total, seed, [*own, "doc_id"])
    met = rows.join(plan.select("skey", "source_size", "target", "epochs", "bucket", "rest"), "skey")
    at = F.shiftright("k", SHIFTS[-1])
    once = F.when(at < F.col("bucket"), F.col("size")).otherwise(F.lit(0).cast("long"))
    clear = met.filter(at != F.col("bucket")).withColumn("once", once).select(*own, "size", "epochs", "once")
    last = met.filter(at == F.col("bucket"))
    same = ["skey", "k", "doc_id", "size"]
    ends = last.withColumn("copy", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(1)))).alias("l").join(_at_end(last).select(*same, "whole", "part").alias("e"), F.expr(" and ".join(f"l.{c} <=> e.{c}" for c in same))).drop(*(F.col(f"e.{c}") for c in same))
    ends = ends.withColumn("once", F.when(F.col("copy") <= F.col("whole"), F.col("size")).when(F.col("copy") == F.col("whole") + 1, F.col("part")).otherwise(F.lit(0)))
    every = clear.unionByName(ends.select(*own, "size", "epochs", "once"))
    times = F.col("epochs") + (F.col("once") > 0).cast("long")
    spread = every.filter((F.col("size") > 0) & (times > 0)).withColumn("epoch", F.explode(F.sequence(F.lit(0), times.cast("int") - 1)))
    cut = (F.col("epoch") == F.col("epochs")) & (F.col("once") < F.col("size"))
    text = F.col(f"own_{columns.index('text')}")
    short = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"([{BLANK}]*[^{BLANK}]+)"), 1), F.lit(1), F.col("once").cast("int")), "")
    new = {c: F.col(o) for c, o in zip(columns, own)} | {"text": F.when(cut, short).otherwise(text)}
    if "n_chars" in new:
        new["n_chars"] = F.when(cut, F.length(short)).otherwise(new["n_chars"]).cast(dict(documents.dtypes)["n_chars"])
    return spread.select(*(v.alias(c) for c, v in new.items()), "epoch")
