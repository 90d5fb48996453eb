"""Exact Jaccard join of documents' word n-gram sets, with set-relation skipping.

Documents link when their sets of 4-word shingles have a Jaccard similarity of
at least 85 in 100. The vertices of the join are the distinct sets (by a
128-bit signature): copies are one vertex, and a doc_id whose rows differ in
text has a vertex for each, tied together. The join is a prefix-filtered
inverted index with two kinds of skipping:

* Index skipping. A set's entry in a token's list has the set's size and its
  reach: the largest size of a partner that the entry's position still allows,
  as only what is left of the set from that position on can be shared. Lists
  are cut into blocks by size and reach. Which blocks of a list meet is found
  from the blocks alone; entries of the others are skipped before any pair is
  made. Blocks of many entries are dealt into chunks, so that a hot list is
  many tasks. Lists of one set are dropped.
* Answer skipping. A set that is highly similar to another derives its answers
  from that set's computed ones. Each list first compares its sets with the
  list's leader only, the set of most common tokens; sets that turn out to be linked share their
  component, and lists within one component are done; a few more times, the
  list's leader outside of the first one's component. For what remains, the
  overlap of y and z follows incrementally from the computed overlap of their
  leaders x and w: it is at most |x & w| + |y - x| + |z - w| and at least
  |x & w| - |x - y| - |w - z|. Where either bound decides, the answer is taken
  from the leaders'; only the other pairs are compared, exactly.

Tokens are ordered by how many documents have them (on a logarithmic scale),
then by hash, so that passages which many documents share come last and stay
out of the prefixes, and tokens of one document only are never listed.

Shingles are 64-bit hashes of the words; all counts and overlaps are of
hashes.

Defined results: documents with null text or no word have an empty set and
link with nothing; with fewer words than a shingle, the whole sequence is the
shingle; rows that repeat a doc_id are one vertex, linked with whatever any of
them links with, and each get a row; a null doc_id is its own (null) component
and links nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, hash_slices, pack_counts, pack_hashes, pack_texts, saved, stable, text_batches, trimmed, tune, unpack_counts, unpack_hashes, unpack_texts
from .components import components
from .hashing import run_hashes, word_hashes

WORDS = 4
#: Least similarity, in hundredths.
SHARE = 85
#: Characters of a batch's texts.
BATCH_CHARS = 6 << 20
#: Tokens that a hash partition counts, about, and the least number of partitions.
PART_TOKENS, PARTITIONS = 1 << 20, 16
#: Entries of a block's chunk: no more than its square are compared under one key.
CHUNK = 256
#: Times that lists of several components compare their sets with one more leader, before what remains meets in pairs.
ROUNDS = 2
#: Documents up to which their ids are broadcast to pick their texts; they are joined by a shuffle beyond.
BROADCAST_IDS = 400_000


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The document's set: sorted distinct hashes of its n-word shingles."""
    w = word_hashes(text)
    return np.unique(run_hashes(w, min(n, len(w)))) if len(w) else w


def _signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def prefix_length(n: int, share: int = SHARE) -> int:
    """How many of a set's first tokens hold one that it has in common with any set it links with."""
    return n - (share * n + 99) // 100 + 1


def reach(n, pos, share: int = SHARE):
    """The largest size of a set that a set of n links with if the first token they share is the one at ``pos``."""
    return ((100 + share) * (n - pos) - share * n) // share


def sets_of(documents: DataFrame, kind: str, n: int = WORDS) -> DataFrame:
    """``doc_id, n, mark``: the size and the signature of each document's set."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t, n) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_signature(s) for s in sets], pa.binary())], ["doc_id", "n", "mark"])

    return documents.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, n long, mark binary")


def postings(documents: DataFrame, tokens: int, share: int = SHARE, n: int = WORDS, batch_chars: int = BATCH_CHARS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """``tok, id, n, pos, reach, held``: of each distinct set of a batch, the prefix tokens that other documents have too;
    ``held`` is how many those are. A set that others are copies of has most, as it has no token of its own.

    Tokens are counted as packed relations: a batch of documents sends each
    hash partition its distinct tokens there; the partition adds them up over
    all batches and answers with how common each is; the answers are joined to
    the batch, whose documents then know their rarest tokens. There is a
    partition for every ``part_tokens`` of the corpus' ``tokens``, so a
    partition's work is the same at every size.
    """
    parts = max(PARTITIONS, -(-tokens // part_tokens))
    docs = stable(documents.filter("doc_id is not null").select("text"), "texts")

    def distinct_sets(texts):
        found = {}
        for text in texts:
            s = shingles(text, n)
            if len(s):
                found.setdefault(_signature(s), s)
        return list(found), list(found.values())

    def ask(rows):
        for key, held in text_batches(rows, batch_chars):
            _, sets = distinct_sets(t for (t,) in held)
            found, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            cut = hash_slices(found, parts)
            used = np.flatnonzero(np.diff(cut)).tolist()
            for at in range(0, len(used), 16):
                some = used[at : at + 16]
                columns = [[key] * len(some), some, [pack_hashes(found[cut[p] : cut[p + 1]]) for p in some], [pack_counts(counts[cut[p] : cut[p + 1]]) for p in some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.binary(), pa.binary()))], ["batch", "part", "tokens", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        asked = [unpack_hashes(x.as_py()) for x in table.column("tokens")]
        sizes = [len(a) for a in asked]
        all_, own = np.unique(np.concatenate(asked), return_inverse=True)
        del asked
        counts = np.concatenate([unpack_counts(x.as_py(), n) for x, n in zip(table.column("counts"), sizes)])
        sums = np.bincount(own, counts, len(all_))
        del counts, all_
        level = np.ceil(4 * np.log2(sums)).astype(np.uint8)  # 0 for a token of one document only
        each = np.split(level[own], np.cumsum(sizes)[:-1])
        return pa.table({"batch": table.column("batch"), "part": table.column("part"), "levels": pa.array([zlib.compress(e.tobytes(), 1) for e in each], pa.binary())})

    def packed(rows):
        for key, held in text_batches(rows, batch_chars):
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([len(held)], pa.int64()), pa.array([pack_texts([t for (t,) in held])], pa.binary())], ["batch", "n", "texts"])

    def place(rows):
        for batch in rows:
            for key, count, texts, answers_ in zip(*(batch.column(c).to_pylist() for c in range(4))):
                marks, sets = distinct_sets(unpack_texts(texts, count))
                if not sets:
                    continue
                found, own = np.unique(np.concatenate(sets), return_inverse=True)
                own = own.astype(np.int32)
                levels = np.frombuffer(b"".join(zlib.decompress(a["levels"]) for a in answers_ or []), np.uint8)
                if len(levels) != len(found):
                    raise RuntimeError(f"batch {key} was cut in another way than its counts; the input isn't stable")
                out: list[list] = [[], [], [], [], []]
                for mark, s, level in zip(marks, sets, np.split(levels[own], np.cumsum([len(s) for s in sets])[:-1])):
                    first = np.argsort(level, kind="stable")[: prefix_length(len(s), share)]
                    pos = np.flatnonzero(level[first])
                    if len(pos):
                        for column, v in zip(out, (s[first[pos]].view(np.int64), [mark] * len(pos), np.full(len(pos), len(s)), pos, np.full(len(pos), len(pos)))):
                            column.append(v)
                if out[0]:
                    tok, size, pos, own_ = (np.concatenate(out[c]) for c in (0, 2, 3, 4))
                    ids = [m for x in out[1] for m in x]
                    for at in range(0, len(tok), 1 << 16):
                        to = at + (1 << 16)
                        numbers = (size[at:to], pos[at:to], reach(size[at:to], pos[at:to], share), own_[at:to])
                        yield pa.RecordBatch.from_arrays([pa.array(tok[at:to]), pa.array(ids[at:to], pa.binary()), *(pa.array(c.astype(np.int32)) for c in numbers)], ["tok", "id", "n", "pos", "reach", "held"])

    asked = docs.mapInArrow(trimmed(ask), "batch string, part int, tokens binary, counts binary")
    answers = asked.repartition(parts, "part").groupBy("part").applyInArrow(answer, "batch string, part int, levels binary")
    lists = answers.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("part", "levels"))).alias("answers"))
    met = docs.mapInArrow(trimmed(packed), "batch string, n long, texts binary").join(lists, "batch", "left")
    return met.select("batch", "n", "texts", "answers").mapInArrow(trimmed(place), "tok long, id binary, n int, pos int, reach int, held int")


def overlaps(documents: DataFrame, table: DataFrame, pairs: DataFrame, kind: str, n: int = WORDS) -> DataFrame:
    """``a, b, na, nb, o`` for ``pairs(a, b)`` of sets: their sizes and exact overlaps. Only one text of each set is read
    again. A set that is in many pairs is dealt over as many tasks as its pairs need."""
    marks = saved(pairs.select(F.explode(F.array("a", "b")).alias("mark")).distinct(), "marks")
    ids = saved(table.filter("doc_id is not null").join(marks, "mark", "left_semi").groupBy("mark").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "ids")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS

    def to_sets(batches):
        for batch in batches:
            sets = [shingles(t, n) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_signature(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "set"])

    texts = documents.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("text")
    sets = saved(texts.mapInArrow(trimmed(to_sets), "id binary, set binary").dropDuplicates(["id"]), "sets")

    def compare(batches):
        for batch in batches:
            rows, last, x = [], None, None
            for sa, sb in zip(batch.column(2), batch.column(3)):
                raw = sa.as_py()
                if raw != last:
                    last, x = raw, np.frombuffer(raw, np.uint64)
                y = np.frombuffer(sb.as_buffer(), np.uint64)
                rows.append((len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)], ["a", "b", "na", "nb", "o"])

    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 64).cast("int").alias("shares"))
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa")).join(shares, "a").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    dealt = pairs.select("a", "b").join(shares, "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int")).drop("shares")
    met = dealt.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").join(left, ["a", "share"])
    return met.select("a", "b", "sa", "sb").mapInArrow(trimmed(compare), "a binary, b binary, na long, nb long, o long")


def _reach(share: int, na, nb, o):
    """Whether an overlap of o makes sets of na and nb tokens link."""
    return F.lit(100 + share) * o >= F.lit(share) * (na + nb)


def _linked(share: int):
    return _reach(share, F.col("na"), F.col("nb"), F.col("o"))


def meetings(entries: DataFrame, share: int = SHARE, chunk: int = CHUNK) -> DataFrame:
    """``a, b``: pairs of entries(tok, id, n, reach, comp) of a list that size and reach let link, in different components.

    Blocks are ranges of size and of reach; only blocks that can hold a pair meet."""
    step = float(np.log(100 / share) / 4)
    level = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(1)).cast("double")) / F.lit(step) + F.lit(1e-9)).cast("int")
    placed = entries.withColumns({"size": level("n"), "far": level("reach")})
    blocks = placed.groupBy("tok", "size", "far").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    side = lambda df, s, *own: df.select("tok", *(F.col(c).alias(f"{c}{s}") for c in own))
    met = side(blocks, "1", "size", "far", "chunks").join(side(blocks, "2", "size", "far", "chunks"), "tok").filter("size1 <= size2 and size2 <= far1 and size1 <= far2")
    own = ("id", "n", "reach", "comp", "size", "far")
    # an entry goes to one chunk of its block, and meets every chunk of the other
    deal = lambda s: F.pmod(F.xxhash64(f"id{s}"), F.col(f"chunks{s}")).cast("int")
    left = side(placed, "1", *own).join(met, ["tok", "size1", "far1"]).withColumn("c1", deal("1")).withColumn("c2", F.explode(F.sequence(F.lit(0), F.col("chunks2") - 1))).drop("chunks1", "chunks2")
    right = side(placed, "2", *own).join(met, ["tok", "size2", "far2"]).withColumn("c2", deal("2")).withColumn("c1", F.explode(F.sequence(F.lit(0), F.col("chunks1") - 1))).drop("chunks1", "chunks2")
    pairs = left.join(right, ["tok", "size1", "far1", "size2", "far2", "c1", "c2"])
    smaller = (F.col("n1") < F.col("n2")) | (F.col("n1") == F.col("n2")) & (F.col("id1") < F.col("id2"))
    fits = (F.col("n2") <= F.col("reach1")) & (F.col("n1") <= F.col("reach2"))
    return pairs.filter(smaller & fits & (F.col("comp1") != F.col("comp2"))).select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct()


def similarity_links(documents: DataFrame, table: DataFrame, kind: str, share: int = SHARE, n: int = WORDS) -> DataFrame:
    """Links ``a, b`` between distinct sets (by mark) whose components are those of all links; ``table`` is that of ``sets_of``."""
    tokens = int(table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    every = saved(postings(documents, tokens, share, n).dropDuplicates(["tok", "id"]), "postings")
    common = every.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("tok")
    width = float(np.log(100 / share))
    lists = saved(every.join(common, "tok", "left_semi").withColumn("block", F.floor(F.log(F.col("n").cast("double")) / F.lit(width) + F.lit(1e-9)).cast("int")), "lists")
    drop_table(every)
    fits = lambda x, y: (x("n") <= y("reach")) & (y("n") <= x("reach"))

    # answers of each list's leader in each block of sizes, and of it with the leader of the next block
    lead = F.max_by(F.struct("id", "n", "reach"), F.struct("held", "id"))
    first = lists.groupBy("tok", "block").agg(lead.alias("x"))
    own = lists.join(first, ["tok", "block"]).filter(F.col("x.id") != F.col("id")).filter(fits(lambda c: F.col(f"x.{c}"), F.col)).select(F.col("x.id").alias("a"), F.col("id").alias("b"))
    second = first.select("tok", (F.col("block") - 1).alias("block"), F.col("x").alias("y"))
    across = first.join(second, ["tok", "block"]).filter(F.col("x.id") != F.col("y.id")).filter(fits(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    stars = saved(own.union(across).distinct(), "stars")
    known = saved(overlaps(documents, table, stars, kind, n), "overlaps")

    # lists that still hold more than one component: the leader of those outside of the first one's, a few times
    for left in range(ROUNDS, -1, -1):
        links = known.filter(_linked(share)).select("a", "b")
        comps = components(links)
        placed = lists.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        mixed = placed.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("tok")
        rest = saved(placed.join(mixed, "tok", "left_semi"), "mixed")
        done = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        if not left:
            break
        top = rest.groupBy("tok").agg(F.max_by("comp", F.struct("held", "id")).alias("top"))
        other = rest.join(top, "tok").filter("comp <> top").groupBy("tok").agg(F.max_by(F.struct("id", "n", "reach", "comp"), F.struct("held", "id")).alias("x"))
        more = rest.join(other, "tok").filter((F.col("x.comp") != F.col("comp")) & fits(lambda c: F.col(f"x.{c}"), F.col)).select(F.col("x.id").alias("a"), F.col("id").alias("b")).distinct()
        new = more.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(done.toDF("lo", "hi"), ["lo", "hi"], "left_anti").dropDuplicates(["lo", "hi"])
        new = saved(new.select("a", "b"), "stars")
        if new.isEmpty():
            break
        known = saved(known.unionByName(overlaps(documents, table, new, kind, n)), "overlaps")
    pairs = saved(meetings(rest, share).join(done, ["a", "b"], "left_anti"), "pairs")
    if pairs.isEmpty():
        return links

    # answers of leaders first; those of the sets that follow them are derived where a bound decides
    leads = saved(known.filter(_linked(share)).groupBy(F.col("b").alias("id")).agg(F.max(F.struct("o", "a", "na", "nb")).alias("m")).select("id", F.col("m.a").alias("lead"), (F.col("m.nb") - F.col("m.o")).alias("more"), (F.col("m.na") - F.col("m.o")).alias("less")), "leads")
    of = lambda s: leads.select(F.col("id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("lead", "more", "less")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    led = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("lead_a", "a").alias("p"), F.coalesce("lead_b", "b").alias("q"), (zero("more_a") + zero("more_b")).alias("more"), (zero("less_a") + zero("less_b")).alias("less"))
    led = saved(led.withColumns({"p": F.least("p", "q"), "q": F.greatest("p", "q")}).filter("p <> q"), "led")
    heads = saved(overlaps(documents, table, led.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct(), kind, n), "heads")
    sizes = lists.select("id", "n").distinct()
    size = lambda c, k: sizes.select(F.col("id").alias(c), F.col("n").alias(k))
    followers = led.filter("(a <> p or b <> q) and (a <> q or b <> p)").join(size("a", "sa"), "a").join(size("b", "sb"), "b").join(heads.select(F.col("a").alias("p"), F.col("b").alias("q"), "o"), ["p", "q"])
    derived = saved(followers.withColumns({"yes": _reach(share, F.col("sa"), F.col("sb"), F.col("o") - F.col("less")), "maybe": _reach(share, F.col("sa"), F.col("sb"), F.col("o") + F.col("more"))}).filter("maybe").select("a", "b", "yes"), "derived")
    links = links.union(heads.filter(_linked(share)).select("a", "b")).union(derived.filter("yes").select("a", "b"))
    comps = components(links)
    at = lambda c, k: comps.select(F.col("id").alias(c), F.col("comp").alias(k))
    open_ = derived.filter("not yes").join(at("a", "ca"), "a", "left").join(at("b", "cb"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    open_ = saved(open_.select("a", "b").distinct(), "open")
    if open_.isEmpty():
        return links
    last = saved(overlaps(documents, table, open_, kind, n), "last")
    return links.union(last.filter(_linked(share)).select("a", "b"))


def ngram_join(documents: DataFrame, share: int = SHARE, n: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document."""
    tune(documents.sparkSession)
    kind = dict(documents.dtypes)["doc_id"]
    table = saved(sets_of(documents, kind, n), "sets")
    links = saved(similarity_links(documents, table, kind, share, n), "links")
    held = table.filter("n > 0 and doc_id is not null")
    # the vertices of a doc_id whose rows differ belong together
    ties = held.groupBy("doc_id").agg(F.min("mark").alias("a"), F.max("mark").alias("z")).filter("a <> z").select("doc_id", "a")
    tied = held.join(ties, "doc_id").filter("mark <> a").select("a", F.col("mark").alias("b"))
    comps = components(links.select("a", "b").unionByName(tied))
    firsts = saved(held.groupBy("mark").agg(F.min("doc_id").alias("first")), "firsts")
    grouped = firsts.join(comps.withColumnRenamed("id", "mark"), "mark", "left").withColumn("comp", F.coalesce("comp", "mark"))
    least = grouped.groupBy("comp").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("sets"))
    # sets alone in their component stay with their first document; the others take their component's
    many = grouped.select("mark", "comp").join(least.filter("sets > 1").select("comp", "least"), "comp").select("mark", "least")
    of_set = firsts.join(many, "mark", "left").select("mark", F.coalesce("least", "first").alias("component"))
    copies = held.groupBy("mark").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("mark")
    moved = saved(of_set.join(copies.union(many.select("mark")).distinct(), "mark", "left_semi"), "moved")
    out = table.join(moved, "mark", "left")
    # a document's rows without a word belong to its rows with some
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    blank = table.filter("n = 0 and doc_id is not null").select("doc_id").distinct().join(held.select("doc_id", "mark"), "doc_id").join(moved, "mark").groupBy("doc_id").agg(F.min("component").alias("whole"))
    return out.join(blank, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, alone).otherwise(F.coalesce("whole", "doc_id")).alias("component_id"))


def keep_one(documents: DataFrame, share: int = SHARE, n: int = WORDS) -> DataFrame:
    """The documents that are the smallest doc_id of their component, with all their columns; rows that repeat a kept doc_id all stay."""
    found = ngram_join(documents, share, n)
    gone = saved(found.filter("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return documents.join(F.broadcast(gone) if few else gone, documents["doc_id"] == F.col("__gone"), "left_anti")
