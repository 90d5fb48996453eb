"""Mixture-controlled packing of documents into token sequences.

Each source is a queue of tokens: its documents, one after the other. A
window of 2048 tokens is filled by deficit round-robin: every window adds the
queue's target share to its deficit, the queue gives as many whole tokens as
its deficit allows, what is left of the window goes to the queues with the
largest deficits, and the deficits go on to the next window. The target shares
are a parameter, ``shares``; by default they are the queues' shares of all
tokens, so all queues end together. With other targets a queue ends before the
others; the targets of those left, in proportion, hold from there on. So a run
is a list of phases, in each of which the queues give fixed numbers of tokens
and end together.

A phase's windows are laid out by segments: segment p of P takes the p-th of P
equal parts of *every* queue. A segment starts with the deficits that rounding left
at its boundary (a closed form of the totals), so deficits carry across
segments and partitions as well as across windows, and a task can work out any segment's
schedule from the totals alone. No document is moved between tasks: the task
that tokenised a document cuts it where the schedules of its segments say.

What remains at the end of a segment is cut into sequences whose lengths are
powers of two, so nothing is padded.

Tokens are kept as a table of packed ids in the shared folder between the two
passes (counting, cutting); nothing is tokenised twice.

Defined results: null texts count as empty, and an empty document is its end
token alone; a null source is a queue of its own; repeated rows are packed
each; an empty table gives no pieces. Sources without a target share what the
targets leave of 1, by their tokens; if nothing is left they come last. Sources
named in ``shares``, and up to ``MAX_QUEUES`` others, have queues of their own;
with more, the others share that many queues by hash, which bounds what a task
holds: proportions are then kept for these groups of sources.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, trimmed, tune

WINDOW = 2048
END_ID = 1
MAX_QUEUES = 1024
#: Tokens of a segment, about: 512 windows.
SEGMENT_TOKENS = 512 * WINDOW
#: Rows of the offsets table up to which it is broadcast (24 bytes each); it is joined by a shuffle beyond.
BROADCAST_ROWS = 200_000
#: Entries of a worker's cache of encoded words; later words are encoded each time.
CACHE_WORDS = 300_000
#: The public tokenizers' file that is used where no path is given.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(given: str | None = None) -> str:
    """The file to load: the one given, or that of the installed public tokenizers, wherever this machine has them."""
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Encoder:
    """Token ids of whole texts as packed little-endian integers, word by word through a cache.

    A byte-level tokenizer splits a text at spaces before it merges anything: a
    space belongs to the word after it. So a text's ids are the ids of its
    words, each with its leading space. Only a space between white space, or
    after it at the end, is split otherwise; a text that has one goes to the
    tokenizer whole, and so does one with the string of a special token. The
    texts of a batch are split together, and each of their distinct words is
    looked up once. Those that the cache lacks are encoded in one call, by the
    same vocabulary and merges in a faster library, and parted by the tokens'
    byte lengths.
    """

    SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    WHOLE = f"{SPACE} {SPACE}| $"
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str | None = None, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(path))
        self.kind = packed_kind(self.tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit = cache_words
        self.known, self.known_ids, self.known_sizes = pa.array([], pa.string()), np.empty(0, self.kind), np.empty(0, np.int64)
        self.words = self._word_encoder()

    def _word_encoder(self):
        """The same merges in the faster library, or None where the tokenizer isn't plain byte-level BPE."""
        import json

        import tiktoken

        made = json.loads(self.tokenizer.to_str())
        pre, model = made["pre_tokenizer"] or {}, made["model"]
        if made["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model["type"] != "BPE":
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        bytes_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(bytes_of[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):  # ids must rise in the order of the merges
            return None
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        return tiktoken.Encoding("words", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _new(self, words: pa.Array) -> tuple[np.ndarray, list[int]]:
        """Ids of words, each with its leading space, one word after the other; and how many each has."""
        if not len(words):
            return np.empty(0, self.kind), []
        one = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py()
        ids = self.words.encode_to_numpy(" " + one, disallowed_special=())
        ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
        return ids.astype(self.kind), np.diff(np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1, prepend=0)

    def _found(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words, each with its leading space, the entry in a list of entries; the ids of these, and how many each has."""
        at = pc.index_in(words, value_set=self.known)
        missing = pc.is_null(at)
        # side by side, words with white space at their ends would be split as one
        edged = pc.and_(missing, pc.match_substring_regex(words, f"^{self.SPACE}|{self.SPACE}$"))
        plain = pc.and_not(missing, edged)
        parts = [self._new(words.filter(plain)), *(self._new(words.slice(i, 1)) for i in np.flatnonzero(edged).tolist())]
        where = np.concatenate([np.flatnonzero(plain), np.flatnonzero(edged)])
        entry = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        entry[where] = len(self.known) + np.arange(len(where))
        ids, sizes = (np.concatenate([held, *(x[i] for x in parts)]) for i, held in enumerate((self.known_ids, self.known_sizes)))
        if len(self.known) < self.limit:
            self.known, self.known_ids, self.known_sizes = pa.concat_arrays([self.known, words.filter(plain), words.filter(edged)]), ids, sizes.astype(np.int64)
        return entry, ids, sizes.astype(np.int64)

    def encode_all(self, texts: pa.Array, last: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, each with ``last`` after it; and where each ends."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        whole = pa.array(np.full(n, self.words is None))
        if self.words is not None:
            whole = pc.match_substring_regex(texts, self.WHOLE)
            for special in self.special:
                whole = pc.or_(whole, pc.match_substring(texts, special))
        split = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        bounds, flat, each = split.offsets.to_numpy().astype(np.int64), split.values, np.arange(n)
        bounds = bounds - bounds[0]
        # a text's first word has no space before it; it, or a text that goes whole, is an entry of its own
        follows = np.ones(len(flat), bool)
        follows[bounds[:-1]] = False
        words = flat.filter(pa.array(follows)).dictionary_encode()
        firsts = pc.if_else(whole, texts, flat.take(pa.array(bounds[:-1]))).to_numpy(zero_copy_only=False).tolist()
        entry, ids, sizes = self._found(words.dictionary)
        own = [np.frombuffer(self._whole(t), self.kind) if t else np.empty(0, self.kind) for t in firsts] + [np.array(last, self.kind)]
        ids, sizes, known = np.concatenate([ids, *own]), np.concatenate([sizes, np.fromiter(map(len, own), np.int64, n + 1)]), len(sizes)
        starts = np.cumsum(sizes) - sizes
        # the entries in the texts' order, with a place for the last ids of each
        first, end = bounds[:-1] + each, bounds[1:] + each
        rest = np.ones(len(flat) + n, bool)
        rest[first] = rest[end] = False
        order = np.empty(len(flat) + n, np.int64)
        order[rest], order[first], order[end] = entry[words.indices.to_numpy()], known + each, known + n
        lengths = sizes[order]
        stops = np.cumsum(lengths)
        places = np.repeat(starts[order] - stops + lengths, lengths) + np.arange(stops[-1] if n else 0)
        return ids[places], stops[end]

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()


def packed_kind(tokenizer) -> str:
    return "<u2" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def sequence_sizes(tokens: int, window: int = WINDOW) -> list[int]:
    """Full windows, then the binary digits of the rest."""
    rest = tokens % window
    return [window] * (tokens // window) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def schedule(totals: list[int], segment: int, segments: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Deficit round-robin over one segment.

    Returns (sizes, ends): the sequences' sizes, and for each sequence and
    queue how many of the queue's tokens, counted from the start of its part
    of the segment, the sequences up to and with this one hold. Deficits are
    integers in units of one token over the number of all tokens.
    """
    total = sum(totals)
    start = [t * segment // segments for t in totals]
    left = np.array([t * (segment + 1) // segments - s for t, s in zip(totals, start)], np.int64)
    sizes = sequence_sizes(int(left.sum()), window)
    share = [int(t) for t in totals]
    deficit = [(t * segment % segments) * total // segments for t in totals]
    ends = np.zeros((len(sizes), len(totals)), np.int64)
    have, done = left.tolist(), [0] * len(totals)
    queues = range(len(totals))
    for w, size in enumerate(sizes):
        room, short = size, []
        for q in queues:
            deficit[q] += size * share[q]
            give = min(max(deficit[q] // total, 0), have[q], room)
            have[q] -= give
            done[q] += give
            deficit[q] -= give * total
            room -= give
        while room:
            short = sorted((q for q in queues if have[q]), key=lambda q: (-deficit[q], q))[:room]
            for q in short:
                have[q] -= 1
                done[q] += 1
                deficit[q] -= total
            room -= len(short)
        ends[w] = done
    return np.array(sizes, np.int64), ends


@lru_cache(maxsize=64)
def _plan(totals: tuple[int, ...], segment: int, segments: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    return schedule(list(totals), segment, segments, window)


@lru_cache(maxsize=256)
def _column(totals: tuple[int, ...], segment: int, segments: int, window: int, q: int) -> tuple[list[int], list[int]]:
    """Of each sequence of a segment: the queue's tokens up to its end, and how many tokens in it come from queues before."""
    _, ends = _plan(totals, segment, segments, window)
    return ends[:, q].tolist(), np.diff(ends[:, :q].sum(axis=1), prepend=0).tolist()


def _kind_of(path: str | None) -> str:
    from tokenizers import Tokenizer

    return packed_kind(Tokenizer.from_file(tokenizer_path(path)))


def phases(totals: list[int], targets: list[float], window: int = WINDOW) -> list[tuple[int, ...]]:
    """How many tokens each queue gives in each phase. In a phase the queues with a target give in proportion to it,
    until one of them has no more; queues without a target come when all others have ended. A phase of less than a
    window joins the next."""
    left, out, held = list(totals), [], [0] * len(totals)
    while any(left):
        by = [t if n else 0 for t, n in zip(targets, left)]
        if not any(by):
            by = left
        time = min(n / t for n, t in zip(left, by) if t > 0)
        give = [n if t > 0 and n / t <= time else min(n, int(t * time)) for n, t in zip(left, by)]
        left = [n - g for n, g in zip(left, give)]
        held = [a + g for a, g in zip(held, give)]
        if sum(held) >= window or not any(left):
            out.append(tuple(held))
            held = [0] * len(totals)
    return out


def tokenised(documents: DataFrame, tokenizer: str | None = None, max_queues: int = MAX_QUEUES, own: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, part, queue, start, n, ids``: the packed ids of each document, its queue,
    and how many tokens of that queue come before it in the task ``part``."""
    spark = documents.sparkSession
    tune(spark)
    named = F.coalesce(F.col("source").isin(*own), F.lit(False)) if own else F.lit(False)
    few = documents.filter(~named).select("source").distinct().limit(max_queues + 1).count() <= max_queues
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    queue = source if few else F.when(named, source).otherwise(F.pmod(F.xxhash64(source), F.lit(max_queues)).cast("string"))
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches):
        from pyspark import TaskContext

        global _encoder
        if _encoder is None or _encoder[0] != tokenizer:
            _encoder = (tokenizer, Encoder(tokenizer))
        encoder = _encoder[1]
        width = np.dtype(encoder.kind).itemsize
        part, reached = TaskContext.get().partitionId(), {}
        for batch in batches:
            ids, ends = encoder.encode_all(batch.column(1), (END_ID,))
            counts = np.diff(ends, prepend=0)
            starts, queues = [], batch.column(2).to_pylist()
            for q, n in zip(queues, counts.tolist()):
                starts.append(reached.get(q, 0))
                reached[q] = starts[-1] + n
            offsets = np.concatenate([[0], ends * width]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * len(ends), pa.int32()), batch.column(2), pa.array(starts, pa.int64()), pa.array(counts), packed],
                ["doc_id", "part", "queue", "start", "n", "ids"],
            )

    return documents.select("doc_id", "text", queue.alias("queue")).mapInArrow(trimmed(run), f"doc_id {kind}, part int, queue string, start long, n long, ids binary")


_encoder: tuple[str, Encoder] | None = None


def pack(documents: DataFrame, tokenizer: str | None = None, window: int = WINDOW, segment_tokens: int = SEGMENT_TOKENS, max_queues: int = MAX_QUEUES, shares: dict[str, float] | None = None) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue``; ``shares`` are target
    proportions of sources, from 0 to 1."""
    spark = documents.sparkSession
    if shares and (min(shares.values()) < 0 or sum(shares.values()) > 1 + 1e-9):
        raise ValueError("target proportions are from 0 to 1 and at most 1 together")
    tokens = saved(tokenised(documents, tokenizer, max_queues, tuple(shares or ())), "tokens", "snappy")  # packed ids: cheap to write counts more than small
    parts = tokens.groupBy("part", "queue").agg(F.max(F.col("start") + F.col("n")).alias("tokens"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(parts.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).drop("tokens"), "offsets")
    rows = parts.groupBy("queue").agg(F.sum("tokens").alias("tokens")).orderBy("queue").collect()  # a row for each queue
    names, totals = [r["queue"] for r in rows], [int(r["tokens"]) for r in rows]
    named = {f"={source}": share for source, share in (shares or {}).items()}
    other = sum(t for q, t in zip(names, totals) if q not in named)
    left = max(0.0, 1 - sum(named.values()))
    targets = [named[q] if q in named else left * t / other for q, t in zip(names, totals)] if named else totals
    steps = phases(totals, targets, window)
    cuts = [max(1, -(-sum(step) // segment_tokens)) for step in steps]
    kind = dict(documents.dtypes)["doc_id"]
    number = {q: k for k, q in enumerate(names)}
    small = offsets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = tokens.join(F.broadcast(offsets) if small else offsets, ["part", "queue"])
    id_kind = _kind_of(tokenizer)

    def place(q: int, at: int, stop: int):
        """(from, to, sequence, offset) of the tokens [at, stop) of a queue, by phases."""
        start = segment = 0
        for step, segments in zip(steps, cuts):
            a, b = max(at, start), min(stop, start + step[q])
            if a < b:
                for x, y, sequence, offset in within(step, segments, q, a - start, b - start):
                    yield x + start, y + start, (segment << 20) + sequence, offset
            start += step[q]
            segment += segments

    def within(totals: tuple[int, ...], segments: int, q: int, at: int, stop: int):
        t = totals[q]
        p = at * segments // t
        while t * (p + 1) // segments <= at:
            p += 1
        while p and t * p // segments > at:
            p -= 1
        while at < stop:
            base, edge = t * p // segments, t * (p + 1) // segments
            if edge > at:
                column, others = _column(totals, p, segments, window, q)
                w = bisect_right(column, at - base)
                while at < min(stop, edge):
                    past = column[w - 1] if w else 0
                    to = min(stop, base + column[w])
                    if to > at:
                        yield at, to, (p << 20) + w, others[w] + at - base - past
                        at = to
                    w += 1
            p += 1

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, queue, start, n, before_, ids in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5)):
                raw = np.frombuffer(ids.as_buffer(), id_kind).astype("<u4").tobytes()
                at = before_ + start
                for a, b, sequence, offset in place(number[queue], at, at + n):
                    for column, v in zip(out, (doc, a - at, b - a, zlib.crc32(raw[4 * (a - at) : 4 * (b - at)]), n, sequence, offset, queue)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(0).type), *(pa.array(c, pa.int64()) for c in out[1:7]), pa.array(out[7], pa.string())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"])

    return joined.select("doc_id", "queue", "start", "n", "before", "ids").mapInArrow(trimmed(run), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string")
