"""Personal data by candidates and boosted trees.

Generators propose overlapping spans with high recall: the strict formats, and
loose ones: addresses without a dot or written with "[at]" and "[dot]", IPv6,
runs of 12 to 19 digits with any separators, phone numbers without a plus, and
values after words like "token" or long strings of mixed characters. Boosted
trees judge each candidate by its format and its context; a logistic
calibration turns margins into probabilities, and a threshold for each kind,
set for precision, selects. The trees are trained at the start, on generated
sentences with planted data and look-alikes (versions, dates, prices, order
numbers, digests, identifiers), as the tables carry no labels of personal
data: half of the sentences train the trees, a quarter calibrates, a quarter
sets the thresholds.

Spans of the strict formats are always kept, whatever the trees say. The trees
add spans that don't overlap these, but for secrets that hold strict spans
whole. Added spans that overlap are one span, of the likeliest's kind, so that
all that was selected is masked. No span has a longest length.

Defined results: null texts count as empty; an empty text has no span; equal
rows are answered each.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import trimmed, tune
from .trees import Boosted, boost, sigmoid

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans; the last has no strict format.
EVERY = (*KINDS, "secret")

#: Every match of the numeric formats lies in one run of these characters.
_ZONE = re.compile(r"[0-9 ().+-]{7,}")
_DIGIT = re.compile(r"[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?[\[({]\s?(?:at|AT|@)\s?[\])}]\s?[A-Za-z0-9-]++(?:(?:\s?[\[({]\s?(?:dot|DOT)\s?[\])}]\s?|\.)[A-Za-z0-9-]++)+"),
    "ip": re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ ._/-]{0,2}[0-9]){11,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]\(?[0-9]{2,4}\)?){2,4}(?![0-9]|[.-][0-9])|(?<![0-9+.-])00[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9]|[.-][0-9])"),
}
#: Words with an @ inside, and the parts between their @.
_WITH_AT, _PART = re.compile(r"(?<![^\s@])[^\s@]++(?:@++[^\s@]++)+"), re.compile(r"[^@]+")
_NAMED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_ -]?key|key|auth|bearer|credentials?)[\"']?[ \t]{0,2}(?:[:=]|is)?[ \t]{0,2}[\"'`]?([^\s\"'`]{8,})")
_MIXED = re.compile(r"[A-Za-z0-9_+/=-]{20,}")
_HINTS = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "address", "ping", "login"),
    "card": ("card", "visa", "credit", "pay", "master", "amex"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "sms", "dial"),
    "secret": ("token", "secret", "passw", "pwd", "key", "auth", "bearer", "credential"),
    "other": ("order", "version", "isbn", "invoice", "date", "total", "price", "page", "no.", "id", "serial", "item", "year", "score", "commit", "sha", "digest", "uuid", "hash"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """The strict addresses, found from each @ outwards: linear in the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            out.append((start, free))
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping strict matches of each kind that pass their checks, by start, then kind."""
    out = [(a, b, "email") for a, b in _emails(text)]
    for zone in _ZONE.finditer(text):
        a, b = zone.span()
        if not _DIGIT.search(text, a, b):
            continue
        for m in _IP.finditer(text, a, b):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text, a, b):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        for m in _PHONE.finditer(text, a, b):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Overlapping spans that the looser generators propose."""
    out = []
    if ("[" in text or "(" in text or "{" in text) and re.search(r"[\[({]\s?(?:at|AT|@)", text):
        out += [(*m.span(), "email") for m in _LOOSE["email"].finditer(text)]
    if "@" in text:
        for m in _WITH_AT.finditer(text):
            parts = [p.span() for p in _PART.finditer(text, *m.span())]
            out += [(a, d, "email") for (a, b), (c, d) in zip(parts, parts[1:]) if c == b + 1]
    if text.count(":") > 1:
        out += [(*m.span(), "ip") for m in _LOOSE["ip"].finditer(text) if m.end() - m.start() > 4]
    if _DIGITS.search(text):
        for kind in ("card", "phone"):
            out += [(*m.span(), kind) for m in _LOOSE[kind].finditer(text)]
    named = [m.span(1) for m in _NAMED.finditer(text)]
    out += [(a, b, "secret") for a, b in dict.fromkeys([*named, *(m.span() for m in _MIXED.finditer(text))])]
    return out


_DIGITS = re.compile(r"[0-9]{2,}[ ._/)-]|[0-9]{12}")


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of one candidate."""
    span = text[start:end]
    digits = "".join(c for c in span if c.isdigit() and c.isascii())
    groups = [len(g) for g in re.split(r"[^0-9]+", span) if g] or [0]
    before, after = text[max(0, start - 32) : start].lower(), text[end : end + 12].lower()
    marks = {c for c in span if not c.isalnum()}
    letters = sum(c.isalpha() for c in span)
    return [
        float(EVERY.index(kind)), float(len(span)), float(len(digits)), float(bool(digits) and luhn(digits)), float(len(groups)), float(max(groups)), float(min(groups)), float(groups[0]), float(groups[-1]),
        float(len(marks)), float("." in marks), float("/" in marks), float(" " in marks), float("(" in span), float("-" in marks), float(span.count(":")), float("::" in span),
        *(float(any(h in before for h in _HINTS[k])) for k in ("email", "ip", "card", "phone", "secret", "other")),
        float(before[-1:].isalnum()), float(before[-1:] in "$#=+/" and before != ""), float(after[:1].isalnum()), float(after[:1] in "%/" and after != ""),
        float(sum(map(str.isdigit, before[-16:] + after))), float(digits[:2] in ("19", "20")),
        letters / len(span), len(set(span)) / len(span), float(sum(c in "0123456789abcdefABCDEF" for c in span)) / len(span), float(any(c.isupper() for c in span)), float(span.isascii()),
        float(before[-1:] in "\"'`" and before != ""), float("=" in before[-4:]), float(bool(re.search(r"[A-Za-z]\d|\d[A-Za-z]", span))), float("." in span[span.rfind("@") + 1 : -1]) if "@" in span else -1.0,
    ]


def _sentence(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, str]]]:
    """A generated sentence and the personal data planted in it."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: "".join(pick("an", "the", "re", "lo", "mi", "ta", "in", "su", "ke") for _ in range(rng.integers(1, 4)))

    mixed = lambda n, of="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(of[k] for k in rng.integers(0, len(of), n))
    hexes = lambda n: mixed(n, "0123456789abcdef")

    def secret() -> str:
        quote = pick('"', "'", "")
        long_ = pick(".", "$", ":", "~").join(mixed(int(rng.integers(20, 300))) for _ in range(int(rng.integers(2, 5))))
        value = pick(hexes(40), hexes(32), mixed(24), mixed(36), "sk-" + mixed(32), mixed(20, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), long_)
        return pick("token", "api_key", "secret", "password", "auth key", "access_token", "TOKEN") + pick(" = ", ": ", "=", " is ") + quote, value, quote

    def card() -> str:
        body = pick("4", "5", "37", "6") + d(14)
        body = body[:15]
        full = next(body + str(k) for k in range(10) if luhn(body + str(k)))
        sep = pick(".", "_", "/", "  ")
        return sep.join((full[:4], full[4:8], full[8:12], full[12:]))

    makers = {
        "email": lambda: f"{word()}{pick('', '.', '_')}{word()} {pick('[at]', '(at)', '[AT]', '{at}')} {word()} {pick('[dot]', '(dot)')} {pick('com', 'org', 'net')}",
        "ip": lambda: ":".join("%x" % rng.integers(1, 65536) for _ in range(8)) if rng.random() < 0.7 else "2001:db8::" + ":".join("%x" % rng.integers(1, 65536) for _ in range(int(rng.integers(1, 4)))),
        "card": card,
        "phone": lambda: pick("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "({}) {} {}").format(pick("2", "3", "4", "5", "6", "7", "8", "9") + d(2), pick("5", "2", "7") + d(2), d(4)),
    }
    lookalikes = (
        lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"20{d(2)}-{pick('01', '11')}-{d(2)} 1{d(1)}:{d(2)}:{d(2)}", lambda: f"{d(3)}.{d(3)}.{d(3)}", lambda: f"{d(3)} {d(3)} {d(3)}",
        lambda: f"{d(2)}/{d(4)}/{d(4)}/{d(4)}", lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{d(3)} {d(3)}-{d(3)} {d(3)}", lambda: f"{word()} (at {word()} {word()}", lambda: f"20{d(2)} 20{d(2)} 20{d(2)}", lambda: f"{d(4)}-{d(4)}-{d(4)}-{d(4)}",
        lambda: "-".join(d(4) for _ in range(int(rng.integers(3, 9)))), lambda: f"1{d(1)}:{d(2)}:{d(2)}:{d(2)}:{d(2)}:{d(2)}",
        lambda: d(16), lambda: d(int(rng.integers(12, 20))), lambda: "commit " + hexes(40), lambda: "sha256:" + hexes(64), lambda: "-".join((hexes(8), hexes(4), hexes(4), hexes(4), hexes(12))), lambda: "".join(word() for _ in range(8)), lambda: "-".join(word() for _ in range(7)), lambda: "/" + "/".join(word() for _ in range(6)),
        lambda: f"the {pick('token', 'key', 'secret', 'password')} {word()}{word()}{word()}{word()} {word()}", lambda: f"@{word()}{word()}", lambda: f"{word()}@{word()} {word()}", lambda: f"{word()}::{word()}::{word()}", lambda: "=" * int(rng.integers(20, 40)), lambda: "-" * int(rng.integers(20, 40)), *(8 * [lambda: f"{pick('', '20' + d(2) + '-0' + d(1) + '-' + d(2) + ' ', 'at ')}{d(2)}:{d(2)}:{d(2)}"]), lambda: f"key: {word()}{word()}{word()}{word()}", lambda: mixed(22, "abcdefghijklmnopqrstuvwxyz"),
    )
    text, truth = " ".join(word() for _ in range(rng.integers(1, 6))) + " ", []
    for _ in range(rng.integers(1, 4)):
        kind = pick(*EVERY, *["none"] * 6)
        if kind == "secret":
            name, value, quote = secret()
            truth.append((len(text) + len(name), len(text) + len(name) + len(value), kind))
            text += name + value + quote
        elif kind == "none":
            text += (pick(*_HINTS["other"]) + pick(" ", ": ")) * int(rng.random() < 0.5) + lookalikes[rng.integers(len(lookalikes))]()
        else:
            hinted = rng.random() < (0.97 if kind in ("phone", "card") else 0.6)
            text += (pick(*_HINTS[kind]) + pick(" ", ": ", " me at ")) * int(hinted)
            made = makers[kind]()
            if hinted or kind in ("email", "ip"):
                truth.append((len(text), len(text) + len(made), kind))
            text += made
        text += pick(" ", ", ", ". ") + " ".join(word() for _ in range(rng.integers(1, 5))) + " "
    return text, truth


@dataclass
class Detector:
    """Trees, and for each kind the calibration (slope, shift) and the least probability that selects."""

    trees: Boosted
    slope: np.ndarray
    shift: np.ndarray
    least: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        k = x[:, 0].astype(int)
        return sigmoid(self.trees.margin(x) * self.slope[k] + self.shift[k])


def examples(sentences: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the candidates in generated sentences, whether they are planted data, and their sentence's number."""
    rng = np.random.default_rng(seed)
    x, y, number = [], [], []
    for n in range(sentences):
        text, truth = _sentence(rng)
        for a, b, kind in candidates(text):
            x.append(features(text, a, b, kind))
            y.append(float(any(k == kind and (min(b, d) - max(a, c) >= 0.8 * (max(b, d) - min(a, c)) or kind == "secret" and c <= a and b <= d) for c, d, k in truth)))
            number.append(n)
    return np.array(x), np.array(y), np.array(number)


def train(sentences: int = 8000, precision: float = 0.98, seed: int = 11) -> Detector:
    """Fit trees to half of the generated sentences, calibrate on a quarter, set thresholds on the last quarter."""
    x, y, number = examples(sentences, seed)
    side = np.array([0, 0, 1, 2])[number % 4]
    trees = boost(x[side == 0], y[side == 0], trees=60, depth=4, rate=0.2)
    count = len(EVERY)
    out = Detector(trees, np.ones(count), np.zeros(count), np.full(count, 2.0))
    for k in range(count):
        rows, last = (side == 1) & (x[:, 0] == k), (side == 2) & (x[:, 0] == k)
        m, t = trees.margin(x[rows]), y[rows]
        if len(t) < 20 or t.min() == t.max():
            out.least[k] = 0.5 if len(t) >= 20 and t[0] else 2.0
            continue
        a, b = 1.0, 0.0
        for _ in range(200):
            p = sigmoid(a * m + b)
            a, b = a - 0.05 * np.mean((p - t) * m), b - 0.2 * np.mean(p - t)
        out.slope[k], out.shift[k] = a, b
        p, t = sigmoid(a * trees.margin(x[last]) + b), y[last]
        for cut in np.linspace(0.5, 0.99, 50):
            if (p >= cut).any() and t[p >= cut].mean() >= precision:
                out.least[k] = cut
                break
    return out


def all_spans(texts: list[str], detector: Detector) -> list[tuple[list, list]]:
    """For each text the strict spans, and all spans, by start, then kind."""
    base = [base_spans(t) for t in texts]
    rows, x = [], []
    for i, t in enumerate(texts):
        taken = merged([(a, b) for a, b, _ in base[i]])
        starts = [a for a, _ in taken]
        for a, b, kind in candidates(t):
            first, last = bisect.bisect_right(starts, a) - 1, bisect.bisect_left(starts, b)
            met = taken[first if first >= 0 and taken[first][1] > a else first + 1 : last]
            # a secret may hold strict spans, whole and not all of it
            if not met or kind == "secret" and a <= met[0][0] and met[-1][1] <= b and (a, b) != met[0]:
                rows.append((i, a, b, kind))
                x.append(features(t, a, b, kind))
    full = [list(b) for b in base]
    if rows:
        p = detector.probability(np.array(x))
        chosen = sorted((i, a, b, kind, v) for (i, a, b, kind), v in zip(rows, p.tolist()) if v >= detector.least[EVERY.index(kind)])
        at = 0
        while at < len(chosen):  # overlapping spans are one, of the kind that is likeliest
            i, a, b, kind, best = chosen[at]
            at += 1
            while at < len(chosen) and chosen[at][0] == i and chosen[at][1] < b:
                _, _, d, other, v = chosen[at]
                b, (best, kind) = max(b, d), max((best, kind), (v, other), key=lambda y: y[0])
                at += 1
            full[i].append((a, b, kind))
    return [(b, sorted(f, key=lambda s: (s[0], EVERY.index(s[2])))) for b, f in zip(base, full)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spell(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find(documents: DataFrame, detector: Detector | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` for every document; the first counts are of
    strict spans, ``n_added`` of those that the trees added."""
    detector = detector or train()
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            found = all_spans([t or "" for t in batch.column(1).to_pylist()], detector)
            counts = [pa.array([sum(s[2] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS]
            digests = [hashlib.sha256(spell(b).encode()).hexdigest() for b, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([spell(f) for _, f in found], pa.string()), pa.array([len(f) - len(b) for b, f in found], pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    tune(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one."""
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, detector: Detector | None = None) -> DataFrame:
    """``documents`` with masked texts; ``n_chars``, if there is one, follows the new text."""
    detector = detector or train()
    columns, kinds = documents.columns, dict(documents.dtypes)

    def run(batches):
        for batch in batches:
            texts = batch.column(columns.index("text")).to_pylist()
            new = [mask(t, f) for t, (_, f) in zip(texts, all_spans([t or "" for t in texts], detector))]
            values = dict(zip(columns, batch.columns)) | {"text": pa.array(new, pa.string())}
            if "n_chars" in values:
                values["n_chars"] = pa.array([o if n == t else len(n) for o, n, t in zip(values["n_chars"].to_pylist(), new, texts)], values["n_chars"].type)
            yield pa.RecordBatch.from_arrays([values[c] for c in columns], columns)

    tune(documents.sparkSession)
    return documents.mapInArrow(trimmed(run), ", ".join(f"`{c}` {kinds[c]}" for c in columns))
