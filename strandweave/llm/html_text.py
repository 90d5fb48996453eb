"""Main text of web pages by structure and suffix arrays of a host's pages.

A page is cut into blocks of text, each a stream of words. Blocks inside
elements that never hold the article (navigation, footers, asides, forms,
scripts and the like, by element or role, or by a class or id that says so) go.
Where a page marks its article (``article`` or ``main``), only its blocks are
the text. Names that may say so or not (``class="lead related"``,
``id="notice-period"``) leave a block in doubt.

What else goes, the markup doesn't decide: a task concatenates the token
streams of its pages, words salted by their host, and a suffix array (prefix
doubling) orders the suffixes to the depth of ``RUN`` words; equal neighbours
from distinct pages make repeated substrings of a host. They decide:

* On a page without a marked article, words under repeats are boilerplate. They
  are cut where they make a run within their block, or most of it; unique words
  stay.
* A block in doubt, marked or not, goes if repeats cover most of it, or if
  another page of the host has the same block.
* In a marked article, a passage that pages share is content, on however many
  of them it is: nothing is cut.

No page is moved and no host is a key: a task's array sees the pages that the
task holds, ``CHUNK_CHARS`` at a time, and the arrays exchange hashes of what
they might share. Every window of ``RUN`` words has a fingerprint, its least
hash of ``GRAM`` words, so equal runs have equal fingerprints; only runs next to
fingerprints that two places have are exchanged themselves, and a run (or block
in doubt) that two different streams of a host have is boilerplate wherever it
is. So results don't depend on how pages are dealt. Equal streams count as one
page, so a host of copies keeps its text.

Defined results: null or empty html has the empty text; a page without a block
has the empty text; null urls are a host together; equal rows are answered
each; unclosed elements end with the next article or the page; words are
compared without the case of A-Z.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, hash_slices, pack_hashes, saved, tune, unpack_hashes
from .hashing import mix, run_hashes, word_hashes

#: Words of a run that makes boilerplate when distinct pages share it.
RUN = 16
#: Characters of html that a task's suffix array takes at a time, about.
CHUNK_CHARS = 8 << 20
#: Words of a fingerprint of a run.
GRAM = 6
#: Shared fingerprints, and shared runs, up to which they are broadcast (8 bytes each). Beyond, all runs are exchanged, and joined by a shuffle.
BROADCAST_HASHES = 1 << 22
#: Characters of text for one part that fingerprints are dealt into, and the least number of parts.
PART_CHARS, PARTS = 64 << 20, 16
#: Share of a block's words from which shorter repeats in it are cut too.
COVERED = 0.8
#: Bits of a block's kind: inside a marked article; in doubt.
INSIDE, DOUBT = 1, 2

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>", re.S)
_LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "svg", "math"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_NEVER = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "object", "audio", "video", "canvas"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br"}
#: Names of what isn't the article. Those of the first set say so in a compound with any other word ("comment-body") but those of ``_STATES``; the others only among their like.
_SURE = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "comment", "comments", "disqus", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "pagination", "topbar", "newsletter", "signup"}
_NAMES = _SURE | {"sponsor", "sponsored", "promo", "banner", "footer", "notice", "notices", "subscribe", "share", "sharing", "social", "related", "masthead", "skip", "toolbar", "pager", "disclaimer", "legal", "copyright", "responses", "leaderboard"}
_PLAIN = {"", "a", "area", "article", "articles", "bar", "block", "bottom", "box", "button", "buttons", "col", "container", "content", "desktop", "div", "google", "grid", "group", "head", "header", "icons", "id", "inner", "item", "items", "js", "label", "left", "link", "links", "list", "main", "message", "mobile", "module", "outer", "page", "panel", "post", "posts", "reader", "readers", "right", "row", "section", "site", "slot", "small", "sticky", "stories", "text", "this", "to", "top", "unit", "up", "user", "users", "widget", "wrap", "wrapper"}
#: Words of compounds that tell how a page is laid out, and not what an element is ("has-sidebar", "no-comments").
_STATES = {"has", "no", "non", "not", "with", "without", "hide", "hides", "hidden", "show", "shows", "open", "closed", "enabled", "disabled", "layout", "page", "body", "is", "on", "off", "free", "two", "one", "full", "width"}
#: Words of the header of an article, not of a page.
_OF_ARTICLE = {"article", "entry", "post", "story", "content", "title", "section", "news", "recipe", "paper", "chapter"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}


_ENDS = {name: re.compile(f"</{name}(?![A-Za-z0-9])", re.I | re.A) for name in _RAW}
#: Of these, the rest of a page isn't taken for content if the end is missing.
_LAX = {"svg", "math", "noscript", "template"}


def _by_names(value: str, in_article: bool) -> int:
    """What a class or id says: 2 not the article, 1 doubt, 0 nothing."""
    names = [set(re.split(r"[^a-z]+", name)) for name in value.split()]
    if not in_article and any("header" in name and name <= _PLAIN and not name & _OF_ARTICLE for name in names):
        return 2
    hits = [name for name in names if name & _NAMES]
    if not hits:
        return 0
    pure = [name for name in hits if name <= _NAMES | _PLAIN]
    sure = any(name & _SURE and (name <= _NAMES | _PLAIN or not name & (_STATES - {"body"} if name & {"comment", "comments"} else _STATES)) for name in hits)
    if sure or pure and all(name <= _NAMES | _PLAIN for name in names):
        return 2
    return 1


def _boilerplate(name: str, attributes: str, in_article: bool) -> int:
    """2 if an element isn't the article, 1 if that is in doubt, 0 if nothing says so."""
    if name in _NEVER or name == "header" and not in_article:
        return 2
    worst = 0
    for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "role" and value in _ROLES or key == "aria-hidden" and value == "true":
            return 2
        if key in ("class", "id") and name not in ("html", "body", "main"):
            says = _by_names(value, in_article)
            # an article goes by its class only if it is a comment or an advert
            worst = max(worst, says if name != "article" or says == 2 and set(re.split(r"[^a-z]+", value)) & _SURE else 0)
    return worst


def blocks(page: str | None) -> list[tuple[int, str]]:
    """The page's blocks that markup doesn't rule out, in order: (kind, text)."""
    text = page or ""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    open_: list[tuple[str, int]] = []  # elements that matter: (name, what they say)
    hidden = doubts = articles = at = 0
    last_close = text.rfind(">")
    endless: set[str] = set()  # names of elements whose end isn't in the rest of the page
    opened: Counter = Counter()  # how many of a name are in open_, and how many of these say something
    said: Counter = Counter()

    def flush() -> None:
        if parts:
            words = _html.unescape("".join(parts)).split()
            if words:
                out.append((INSIDE * (articles > 0) | DOUBT * (doubts > 0), " ".join(words)))
            parts.clear()

    def add(a: int, b: int) -> None:
        if b > a and not hidden:
            parts.append(text[a:b])

    while True:
        left = text.find("<", at)
        if left < 0 or left > last_close and not text.startswith("<!--", left):
            tail = left if left >= 0 and re.match(r"<[/!A-Za-z]", text[left : left + 2]) else len(text)
            add(at, tail)
            break
        m = _TAG.match(text, left) or _LOOSE_TAG.match(text, left)
        if m is None:
            add(at, left + 1)
            at = left + 1
            continue
        add(at, left)
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in _RAW and not closing:
            if not m[3].endswith("/") or name not in ("svg", "math"):
                end = None if name in endless else _ENDS[name].search(text, at)
                stop = text.find(">", end.end()) if end else -1
                if stop < 0:
                    endless.add(name)
                at = stop + 1 if stop >= 0 else at if name in _LAX else len(text)
            if name not in ("svg", "math", "script", "style", "template") and not hidden:
                flush()
            continue
        if name in _INLINE:
            if name == "br":
                if not hidden:
                    parts.append(" ")
                continue
            if (closing or name in _VOID or not m[3]) and not (closing and opened[name]):
                continue
        elif not hidden:
            flush()
        if name in _VOID:
            continue
        if closing:
            if opened[name]:
                found = next(k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name)
                if not hidden:
                    flush()
                for n, says in open_[found:]:
                    opened[n] -= 1
                    said[n] -= says > 0
                    hidden -= says == 2
                    doubts -= says == 1
                    articles -= n in ("article", "main") and says < 2
                del open_[found:]
            continue
        says = _boilerplate(name, m[3], articles > 0)
        if name in ("article", "main") and says < 2 and hidden and not articles and not opened["article"]:
            open_ = [(n, 0) for n, _ in open_]  # an unclosed element before the article
            said.clear()
            hidden = doubts = 0
        if says or name in ("article", "main") or said[name]:
            if says and not hidden:
                flush()
            open_.append((name, says))
            opened[name] += 1
            said[name] += says > 0
            hidden += says == 2
            doubts += says == 1
            articles += name in ("article", "main") and says < 2
    flush()
    return out


def salt_of(host: str | None) -> int:
    return xxhash.xxh3_64_intdigest((host or "").encode("utf-8", "surrogatepass"))


class Streams:
    """The token streams of some pages, one after the other: salted word hashes, and where each page's begin."""

    def __init__(self, parsed: list[list[tuple[int, str]]], salts: list[int]):
        texts = [" ".join(b for _, b in page) for page in parsed]
        self.sizes = np.array([t.count(" ") + 1 if t else 0 for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        flat = word_hashes(" ".join(t for t in texts if t))
        self.salts = np.array(salts, np.uint64)
        self.words = mix(flat ^ np.repeat(self.salts, self.sizes))
        self.own = np.repeat(np.arange(len(texts)), self.sizes)
        raw = [self.of(k).tobytes() for k in range(len(texts))]
        self.marks = [xxhash.xxh3_64_intdigest(r) - (1 << 63) for r in raw]

    def of(self, k: int) -> np.ndarray:
        return self.words[self.starts[k] : self.starts[k] + self.sizes[k]]

    def whole(self, run: int) -> np.ndarray:
        """The places where a run starts that ends within its page."""
        at = np.arange(len(self.words))
        return at[at + run <= (self.starts + self.sizes)[self.own]]

    def fingerprints(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of ``whole``, and the fingerprint of the run at each: equal runs have the same one."""
        size = min(GRAM, run)
        at, grams = self.whole(run), mix(run_hashes(self.words, size))
        if not len(at):
            return at, grams[:0]
        return at, np.lib.stride_tricks.sliding_window_view(grams, run - size + 1).min(axis=1)[at]


def repeated(words: list[np.ndarray], run: int = RUN) -> list[np.ndarray]:
    """For each stream of word hashes, whether a word lies under a run of ``run`` words that two different streams have.

    The streams are joined with separators of their own; after each round of
    prefix doubling, ranks order all suffixes by twice as many words.
    """
    distinct: dict[bytes, int] = {}
    own = [distinct.setdefault(w.tobytes(), len(distinct)) for w in words]
    at: dict[int, int] = {}
    for i, k in enumerate(own):
        at.setdefault(k, i)
    first = [words[i] for i in at.values()]
    if not first:
        return []
    sizes = np.array([len(w) + 1 for w in first])
    n = int(sizes.sum())
    ends = np.cumsum(sizes) - 1
    inner = np.ones(n, bool)
    inner[ends] = False
    rank = np.zeros(n, np.int64)
    rank[inner] = np.unique(np.concatenate(first), return_inverse=True)[1] + len(first)
    rank[ends] = np.arange(len(first))
    page, reach = np.repeat(np.arange(len(first)), sizes), 1
    while reach < run:
        step = min(reach, run - reach)
        after = np.full(n, -1, np.int64)
        after[: max(n - step, 0)] = rank[step:]
        rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        reach += step
    order = np.argsort(rank, kind="stable")  # the suffix array, to the depth of a run
    new = np.concatenate([[True], np.diff(rank[order]) > 0])
    starts = np.flatnonzero(new)
    others = new | np.concatenate([[True], np.diff(page[order]) > 0])  # the order is stable, so a run's pages are in order
    shared = np.add.reduceat(others, starts) > 1
    hit = order[shared[np.cumsum(new) - 1]]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, np.minimum(hit + run, n), -1)
    under = np.cumsum(cover)[:n] > 0
    flags = np.split(under, ends[:-1] + 1)
    return [flags[k][:-1] for k in own]


def doubt_hashes(page: list[tuple[int, str]], salt: int) -> list[tuple[int, int]]:
    """(number, hash) of the page's blocks in doubt."""
    return [(k, xxhash.xxh3_64_intdigest(b.lower().encode("utf-8", "surrogatepass"), salt) - (1 << 63)) for k, (kind, b) in enumerate(page) if kind & DOUBT]


def without_repeats(block: str, under: np.ndarray, run: int = RUN, covered: float = COVERED) -> str:
    """The block without its words under repeats. Where repeats cover less than ``covered`` of it, pieces shorter than a
    run stay: they belong to repeats in the blocks around."""
    if not under.any():
        return block
    go = under
    if under.sum() < covered * len(under):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], under.astype(np.int8), [0]])))
        go = np.zeros(len(under), bool)
        for a, b in zip(edges[::2], edges[1::2]):
            go[a:b] = b - a >= run
    return " ".join(w for w, gone in zip(block.split(" "), go) if not gone)


def kept_text(page: list[tuple[int, str]], under: np.ndarray, known: set[int], run: int = RUN, covered: float = COVERED) -> str:
    """The page's main text: ``under`` says which words repeats cover, ``known`` which blocks in doubt another page has."""
    marked = any(kind & INSIDE for kind, _ in page)
    kept, at = [], 0
    for k, (kind, block) in enumerate(page):
        n = block.count(" ") + 1
        here = slice(at, at + n)
        at += n
        if marked and not kind & INSIDE or kind & DOUBT and (k in known or under[here].sum() >= covered * n):
            continue
        left = block if marked else without_repeats(block, under[here], run, covered)
        if left:
            kept.append(left)
    return "\n\n".join(kept)


def main_texts(pages: list[str | None], run: int = RUN, covered: float = COVERED) -> list[str]:
    """The main text of each page of one host, by one suffix array."""
    parsed = [blocks(p) for p in pages]
    streams = Streams(parsed, [0] * len(parsed))
    under = repeated([streams.of(k) for k in range(len(parsed))], run)
    holders: dict[int, set[int]] = {}
    for page, mark in zip(parsed, streams.marks):
        for _, h in doubt_hashes(page, 0):
            holders.setdefault(h, set()).add(mark)
    return [kept_text(page, u, {k for k, h in doubt_hashes(page, 0) if len(holders[h]) > 1}, run, covered) for page, u in zip(parsed, under)]


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _load(batch) -> tuple[list[list[tuple[int, str]]], list[int]]:
    """Parsed pages and salts of rows of ``parsed_pages``."""
    parsed = [list(zip(kinds, text.split("\n"))) if kinds else [] for kinds, text in zip(batch.column("kinds").to_pylist(), batch.column("blocks").to_pylist())]
    return parsed, [s + (1 << 63) for s in batch.column("salt").to_pylist()]


def parsed_pages(pages: DataFrame, run: int = RUN, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``page_id, url, row, salt, stream, kinds, blocks, under, prints``: each page's blocks, and the words that the suffix array
    of its chunk covers. The first page of a chunk carries the chunk's distinct fingerprints; those of two of its streams
    come twice."""
    id_type = arrow_type(pages, "page_id")

    def work(rows, number, part):
        ids, urls, htmls, hosts = zip(*rows)
        parsed = [blocks(h) for h in htmls]
        salts = [salt_of(h) for h in hosts]
        streams = Streams(parsed, salts)
        flags = repeated([streams.of(k) for k in range(len(rows))], run)
        at, prints = streams.fingerprints(run)
        marks = np.array(streams.marks, np.int64)[streams.own[at]]
        order = np.lexsort((marks, prints))
        prints, marks = prints[order], marks[order]
        new = np.concatenate([[True], (prints[1:] != prints[:-1]) | (marks[1:] != marks[:-1])]) if len(prints) else np.zeros(0, bool)
        found, times = np.unique(prints[new], return_counts=True)
        for a in range(0, len(rows), 256):
            z = min(a + 256, len(rows))
            yield _batch({
                "page_id": pa.array(ids[a:z], id_type), "url": pa.array(urls[a:z], pa.string()), "row": pa.array([f"{part}-{number + k}" for k in range(a, z)]), "salt": pa.array([s - (1 << 63) for s in salts[a:z]], pa.int64()), "stream": pa.array(streams.marks[a:z], pa.int64()),
                "kinds": pa.array([bytes(k for k, _ in page) for page in parsed[a:z]], pa.binary()), "blocks": pa.array(["\n".join(b for _, b in page) for page in parsed[a:z]], pa.string()), "under": pa.array([np.packbits(f).tobytes() for f in flags[a:z]], pa.binary()),
                "prints": pa.array([pack_hashes(found) if len(found) and not a and not k else b"" for k in range(z - a)], pa.binary()), "twice": pa.array([np.packbits(times > 1).tobytes() if not a and not k else b"" for k in range(z - a)], pa.binary()),
            })

    def parse(batches):
        from pyspark import TaskContext

        held, chars, done, part = [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(4))):
                held.append(row)
                chars += len(row[2] or "")
                if chars >= chunk_chars:
                    yield from work(held, done, part)
                    held, chars, done = [], 0, done + len(held)
        if held:
            yield from work(held, done, part)

    kind = dict(pages.dtypes)["page_id"]
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    return rows.mapInArrow(parse, f"page_id {kind}, url string, row string, salt long, stream long, kinds binary, blocks string, under binary, prints binary, twice binary")


def shared_fingerprints(parsed: DataFrame) -> DataFrame:
    """``n, prints``: fingerprints that two streams of a chunk, or two chunks, have, packed, a row for each part with some."""
    parts = max(PARTS, -(-int(parsed.agg(F.coalesce(F.sum(F.length("blocks")), F.lit(0))).first()[0]) // PART_CHARS))

    def dealt(batches):
        for batch in batches:
            for packed, twice in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = unpack_hashes(packed)
                times = np.unpackbits(np.frombuffer(twice, np.uint8), count=len(found)).astype(bool)
                cut = hash_slices(found, parts)
                some = [(p, pack_hashes(found[a:z]), np.packbits(times[a:z]).tobytes()) for p, (a, z) in enumerate(zip(cut[:-1], cut[1:])) if z > a]
                yield _batch({name: pa.array(column, t) for name, column, t in zip(("part", "prints", "twice"), zip(*some), (pa.int32(), pa.binary(), pa.binary()))})

    def met(table: pa.Table) -> pa.Table:
        found = [unpack_hashes(x) for x in table.column("prints").to_pylist()]
        twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(f)).astype(np.int64) for x, f in zip(table.column("twice").to_pylist(), found)]
        all_, own = np.unique(np.concatenate(found), return_inverse=True)
        shared = all_[np.bincount(own, 1 + np.concatenate(twice), len(all_)) > 1]
        return pa.table([pa.array([len(shared)] if len(shared) else [], pa.int64()), pa.array([shared.tobytes()] if len(shared) else [], pa.binary())], ["n", "prints"])

    sent = parsed.select("prints", "twice").filter("length(prints) > 0").mapInArrow(dealt, "part int, prints binary, twice binary")
    return sent.repartition(parts, "part").groupBy("part").applyInArrow(met, "n long, prints binary")


def _is_in(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values if len(sorted_) else np.zeros(len(values), bool)


def runs(parsed: DataFrame, run: int = RUN, near=None, where: bool = False) -> DataFrame:
    """``h, stream, salt``: the distinct runs and blocks in doubt of each page, as hashes; with ``near``, a broadcast sorted array
    of fingerprints, only the runs that have one of them. With ``where`` also ``row, at``: places of runs from 0, blocks below."""

    def hashed(batches):
        for batch in batches:
            pages, salts = _load(batch)
            streams = Streams(pages, salts)
            at, prints = streams.fingerprints(run)
            if near is not None:
                at = at[_is_in(near.value, prints)]
            h = run_hashes(streams.words, run)[at].view(np.int64)
            own, at = streams.own[at], at - streams.starts[streams.own[at]]
            extra = [(k, -1 - n, x) for k, (page, salt) in enumerate(zip(pages, salts)) for n, x in doubt_hashes(page, salt)]
            if extra:
                more = np.array(extra, np.int64)
                own, at, h = np.concatenate([own, more[:, 0]]), np.concatenate([at, more[:, 1]]), np.concatenate([h, more[:, 2]])
            marks = np.array(streams.marks, np.int64)[own] if len(own) else own
            hosts = (streams.salts[own] - np.uint64(1 << 63)).view(np.int64) if len(own) else own
            if not where and len(h):
                order = np.lexsort((marks, h))
                h, marks, hosts = h[order], marks[order], hosts[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (marks[1:] != marks[:-1])])
                h, marks, hosts = h[new], marks[new], hosts[new]
            for a in range(0, len(h), 1 << 16):
                z = a + (1 << 16)
                columns = {"h": pa.array(h[a:z]), "stream": pa.array(marks[a:z]), "salt": pa.array(hosts[a:z])}
                if where:
                    columns |= {"row": batch.column("row").take(pa.array(own[a:z])), "at": pa.array(at[a:z].astype(np.int32))}
                yield _batch(columns)

    return parsed.select("row", "salt", "kinds", "blocks").mapInArrow(hashed, "h long, stream long, salt long" + (", row string, at int" if where else ""))


def common_runs(parsed: DataFrame, run: int = RUN, limit: int = BROADCAST_HASHES) -> DataFrame:
    """``h``: the runs and blocks in doubt that two different streams of a host have."""
    spark = parsed.sparkSession
    prints = saved(shared_fingerprints(parsed), "prints")
    near = None
    if (prints.agg(F.sum("n")).first()[0] or 0) <= limit:
        near = spark.sparkContext.broadcast(np.sort(np.frombuffer(b"".join(r.prints for r in prints.select("prints").collect()), np.uint64)))
    every = runs(parsed, run, near).distinct().groupBy("h", "salt").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return saved(every.select("h"), "runs")


def extract(pages: DataFrame, run: int = RUN, chunk_chars: int = CHUNK_CHARS, limit: int = BROADCAST_HASHES) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``."""
    spark = pages.sparkSession
    tune(spark)
    kind = dict(pages.dtypes)["page_id"]
    parsed = saved(parsed_pages(pages.select("page_id", "url", "html"), run, chunk_chars), "pages")
    common = common_runs(parsed, run, limit)
    few = common.limit(limit + 1).count() <= limit
    shared = None
    if few:
        shared = spark.sparkContext.broadcast(common.toArrow().sort_by("h").column("h").to_numpy())
    columns = ["page_id", "url", "row", "salt", "kinds", "blocks", "under"]

    def finish(batches):
        for batch in batches:
            pages_, salts = _load(batch)
            streams = Streams(pages_, salts)
            if shared is not None:
                at = streams.whole(run)
                h = run_hashes(streams.words, run)[at].view(np.int64)
                found = at[_is_in(shared.value, h)]
                extra = [[n for n, x in doubt_hashes(page, salt) if _is_in(shared.value, np.array([x]))[0]] for page, salt in zip(pages_, salts)]
            else:
                places = [x or [] for x in batch.column("places").to_pylist()]
                starts = streams.starts.tolist()
                found = np.array([starts[k] + a for k, x in enumerate(places) for a in x if a >= 0], np.int64)
                extra = [[-1 - a for a in x if a < 0] for x in places]
            cover = np.zeros(len(streams.words) + 1, np.int64)
            np.add.at(cover, found, 1)
            np.add.at(cover, found + run, -1)
            repeats = np.cumsum(cover)[:-1] > 0
            texts = []
            for k, (page, packed) in enumerate(zip(pages_, batch.column("under").to_pylist())):
                here = slice(int(streams.starts[k]), int(streams.starts[k] + streams.sizes[k]))
                under = np.unpackbits(np.frombuffer(packed, np.uint8), count=int(streams.sizes[k])).astype(bool) | repeats[here]
                texts.append(kept_text(page, under, set(extra[k]), run))
            yield _batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})

    schema = f"page_id {kind}, url string, text string, n_chars long"
    if few:
        return parsed.select(*columns).mapInArrow(finish, schema)
    # too many for a broadcast: their places come to the pages by joins
    met = runs(parsed, run, None, True).join(common, "h").groupBy("row").agg(F.collect_list("at").alias("places"))
    return parsed.select(*columns).join(met, "row", "left").select(*columns, "places").mapInArrow(finish, schema)
