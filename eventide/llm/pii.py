"""Personal data: base patterns, and candidates chosen by boosted trees.

The base finds e-mail addresses, IP addresses, card numbers and telephone
numbers by fixed patterns, leftmost and without overlap for each kind; a match
that fails its check (parts up to 255, Luhn, number of digits) is dropped. Base
spans always stay.

The method adds what the patterns miss, as a telephone and a card number that
stand side by side. High-recall generators propose overlapping spans: runs of
digit groups in all groupings, dotted quads, addresses with a written-out sign.
Features describe format (digits, groups, separators, checks) and context (the
characters and words around). Boosted trees score a candidate; per kind, the
threshold is the lowest score from which precision on held-out candidates is at
least ``precision``. Of accepted candidates that overlap the better stays, and
none may overlap a base span.

The trees are fitted on candidates that overlap a base span, those equal to it
being right, on pairs of base spans put side by side, on addresses with their signs
written out and prices that look like them, and on copies of other base spans
spoilt in a way that the kind's rule forbids. They come from about ``TRAIN_DOCS`` documents, the lowest by a hash of
their text; everything else covers all texts.

Defined cases: a null or empty text has no spans; repeated rows are searched
each; an empty table, or one without base spans, fits no trees and adds
nothing; other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from . import words as WD

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS = 3000
TRAIN_PER_DOC = 200  # candidates of a text that the fit uses
PRECISION = 0.995
TREES, DEPTH = 80, 4
CONTEXT = 32  # characters around a span that features look at, at most

Span = tuple[int, int, int]  # kind, start, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by kind, then start. Each search is
    linear in the text: a failed start is never tried again inside its run."""
    out: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        begin = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = begin + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append((1, begin, end))
            begin = end + 1
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


_RUN = re.compile(r"[+(]{0,2}[0-9](?:[\x20().-]{0,3}[0-9])*")
_GROUP = re.compile(r"[+(]*[0-9]+[).-]*(?:[0-9]+[).-]*)*")
_QUAD = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}(?![0-9])")
_WRITTEN = re.compile(r"[A-Za-z0-9._%+-]{1,64}(?: ?\(at\) ?| ?\[at\] ?| @ ?|@ )[A-Za-z0-9-]+"
                      r"(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?)[A-Za-z0-9-]+)+")


def candidates(text: str) -> list[Span]:
    """High-recall proposals of all kinds; they overlap freely."""
    out: set[Span] = {(0, m.start(), m.end()) for m in _WRITTEN.finditer(text)}
    out |= {(1, m.start(), m.end()) for m in _QUAD.finditer(text)}
    for run in _RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        groups = []
        for m in _GROUP.finditer(text, run.start(), run.end()):
            end = m.end()
            while not text[end - 1].isdigit():
                end -= 1
            groups.append((m.start(), end, sum(c.isdigit() for c in m.group())))
        for i, (start, _, _) in enumerate(groups):
            n = 0
            for j in range(i, len(groups)):
                _, end, digits = groups[j]
                n += digits
                if n > 19:
                    break
                if 7 <= n <= 15:
                    out.add((3, start, end))
                if 13 <= n <= 19:
                    out.add((2, start + (text[start] in "(+"), end))
    return sorted(out)


FEATURES = ("kind", "length", "digits", "groups", "first_group", "last_group", "spaces", "dashes", "dots", "parens",
            "plus", "luhn", "largest_part", "letters", "tld", "opens_balanced", "before_digit", "before_letter",
            "before_dot", "after_digit", "after_letter", "after_dot", "word_phone", "word_card", "word_mail", "word_net",
            "lead_digit", "digits_before", "digits_after")
_HINTS = (("tel", "phone", "call", "fax", "mobil"), ("card", "visa", "credit", "konto"), ("mail", "contact"),
          ("ip", "host", "server", "addr"))


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    s = text[start:end]
    digits = _NOT_DIGIT.sub("", s)
    groups = re.findall(r"[0-9]+", s)
    before, after = text[start - 1:start], text[end:end + 1]
    near = text[max(0, start - 24):start].lower()
    tld = re.search(r"[A-Za-z]+$", s)
    return [kind, len(s), len(digits), len(groups), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
            s.count(" "), s.count("-"), s.count("."), s.count("(") + s.count(")"), s.startswith("+"),
            luhn(digits) if len(digits) >= 13 else 0, max((min(int(g[:9]), 999) for g in groups), default=0) if kind == 1 else 0,
            sum(c.isalpha() for c in s), len(tld.group()) if tld else 0, s.count("(") == s.count(")"),
            before.isdigit(), before.isalpha(), before in (".", "-") and before != "", after.isdigit(), after.isalpha(),
            after != "" and after in "-", *[any(w in near for w in hint) for hint in _HINTS],
            int(digits[0]) if digits else -1, sum(c.isdigit() for c in text[max(0, start - 6):start]),
            sum(c.isdigit() for c in text[end:end + 6])]


class Taken:
    """Spans without overlaps, for the question whether another one overlaps them."""

    def __init__(self, spans: list[Span] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in sorted(spans, key=lambda s: s[1]):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def overlaps(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return at > 0 and self.ends[at - 1] > start

    def add(self, start: int, end: int) -> None:
        """A span that overlaps none."""
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


def _replaced(text: str, span: Span, s: str) -> tuple[str, int]:
    """The surroundings of a span with ``s`` in its place, and where that begins."""
    before = text[max(0, span[1] - CONTEXT):span[1]]
    return before + s + text[span[2]:span[2] + CONTEXT], len(before)


def _spoilt(text: str, span: Span, turn: int) -> tuple[str, Span]:
    """A span's surroundings with the span changed so that its kind's rule forbids it."""
    kind, start, end = span
    s = text[start:end]
    if kind == 1:
        parts = s.split(".")
        parts[turn % 4] = str(256 + (turn * 37) % 700)
        s = ".".join(parts)
    elif kind == 2:
        at = len(s) - 1 - turn % 4
        while not s[at].isdigit():
            at -= 1
        s = s[:at] + str((int(s[at]) + 1 + turn % 8) % 10) + s[at + 1:]
    else:
        cut = [i for i, c in enumerate(s) if c.isdigit()]
        s = s[:cut[-4 + turn % 2]] if turn % 3 else s[1:cut[-5]]
    changed, begin = _replaced(text, span, s)
    return changed, (kind, begin, begin + len(s.rstrip(" .(-")))


def _written_out(text: str, span: Span, turn: int) -> list[tuple[str, Span, int]]:
    """(surroundings, span, label): an address with its signs written out, and a
    price or time in its place that looks alike and is none."""
    local, _, domain = text[span[1]:span[2]].rpartition("@")
    forms = (f"{local} (at) {domain.replace('.', ' (dot) ')}", f"{local} [at] {domain.replace('.', ' [dot] ')}",
             f"{local}(at){domain}", f"{local} [at] {domain}", f"{local} @ {domain}", f"{local}@ {domain}")
    others = (f"{local} @ {turn % 90 + 1}.{turn * 7 % 100:02d}", f"{local} (at) {turn % 23}.{turn * 11 % 60:02d}")
    out = []
    for s, label in ((forms[turn % len(forms)], 1), (others[turn % len(others)], 0)):
        changed, begin = _replaced(text, span, s)
        out.append((changed, (0, begin, begin + len(s)), label))
    return out


def training_rows(text: str) -> tuple[list[list[float]], list[int]]:
    """Features and labels of the candidates of a text that base spans judge."""
    x, y = [], []
    base = base_spans(text)
    right, taken = set(base), Taken(base)
    for c in candidates(text) + [b for b in base if b[0] == 0]:
        if c in right:
            x.append(features(text, c))
            y.append(1)
        elif taken.overlaps(c[1], c[2]):
            x.append(features(text, c))
            y.append(0)
    for a, b in zip(base, base[1:]):  # two side by side, where the patterns run over
        s, t = text[a[1]:a[2]], text[b[1]:b[2]]
        both = f"{text[max(0, a[1] - 24):a[1]]}{s} {t} "
        begin = len(both) - len(s) - len(t) - 2
        pair = {(a[0], begin, begin + len(s)), (b[0], begin + len(s) + 1, begin + len(s) + 1 + len(t))}
        for c in candidates(both):
            if c[1] >= begin:
                x.append(features(both, c))
                y.append(int(c in pair))
    for turn, b in enumerate(base):
        # no generator proposes a spoilt address
        made = _written_out(text, b, turn + b[1]) if b[0] == 0 else [(*_spoilt(text, b, turn + b[1]), 0)]
        for changed, span, label in made:
            if span[2] - span[1] > 2:
                x.append(features(changed, span))
                y.append(label)
    return x, y


def _worth(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with four digits or an at sign; no other has a span."""
    digits = WD.per_text((data >= 48) & (data <= 57), offsets)
    signs = WD.per_text(data == 64, offsets) + WD.per_text(data == 40, offsets) + WD.per_text(data == 91, offsets)
    return (digits >= 4) | (signs > 0)


class Redactor:
    """A fitted model with its thresholds; finds all spans of a text."""

    def __init__(self, model: boosting.Model | None, thresholds: tuple[float, ...]):
        self.model, self.thresholds = model, thresholds

    def added(self, text: str, base: list[Span]) -> list[Span]:
        if self.model is None:
            return []
        taken = Taken(base)
        open_ones = [c for c in candidates(text) if not taken.overlaps(c[1], c[2])]
        if not open_ones:
            return []
        margin = self.model.margin(np.array([features(text, c) for c in open_ones], dtype=float))
        out: list[Span] = []
        for i in np.lexsort(([c[1] for c in open_ones], -margin)):
            kind, start, end = open_ones[i]
            if margin[i] >= self.thresholds[kind] and not taken.overlaps(start, end):
                taken.add(start, end)
                out.append(open_ones[i])
        return out


def fit(docs: DataFrame, text: str = "text", train_docs: int = TRAIN_DOCS, precision: float = PRECISION) -> Redactor:
    """Fit the trees on a bounded sample: about ``train_docs`` different texts,
    the lowest by a hash, among those with digits or an at sign."""
    body = docs[f"`{text}`"].cast("string")
    signed = docs.select(body.alias("text")).where(F.col("text").rlike("[0-9]{2}|@"))
    # a share of all texts, by hash, that holds about train_docs of them at any size of the table
    share = train_docs / max(1, signed.count())
    place = F.shiftrightunsigned(F.xxhash64("text"), 11).cast("double") / F.lit(float(1 << 53))
    some = signed.where(place < share).distinct()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                x, y = (v[:TRAIN_PER_DOC] for v in training_rows(t.as_py()))
                if x:
                    yield pa.RecordBatch.from_arrays([pa.array([list(map(float, r)) for r in x], pa.list_(pa.float64())),
                                                      pa.array(y, pa.int64())], names=["x", "y"])

    got = sorted(some.mapInArrow(rows, "x array<double>, y long").collect())  # in one order whatever the partitions
    y = np.array([r["y"] for r in got], dtype=float)
    if len(y) < 20 or y.min() == y.max():
        return Redactor(None, (float("inf"),) * len(KINDS))
    x = np.array([r["x"] for r in got], dtype=float)
    held = np.arange(len(y)) % 4 == 3
    model = boosting.fit(x[~held], y[~held], trees=TREES, depth=DEPTH)
    margin = model.margin(x[held])
    thresholds = []
    for kind in range(len(KINDS)):
        own = x[held][:, 0] == kind
        thresholds.append(max(0.0, boosting.calibrate(margin[own], y[held][own], precision)))
    return Redactor(model, tuple(thresholds))


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _redacted(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if end <= at:
            continue
        if start >= at:
            out.append(text[at:start])
            out.append(f"[{KINDS[kind].upper()}]")
        at = end
    return "".join([*out, text[at:]])


def find(docs: DataFrame, redactor: Redactor, text: str = "text", redacted: str | None = "redacted") -> DataFrame:
    """The documents' columns with n_email, n_ip, n_card, n_phone (base spans),
    base_sha256, spans and, unless ``redacted`` is None, the text with each
    span replaced by its kind (null for a null text)."""
    counts = [f"n_{k}" for k in KINDS]
    new = [*counts, "base_sha256", "spans", *([redacted] if redacted else [])]
    passed = [c for c in docs.columns if c.lower() not in new]
    given = docs.select(*[docs[f"`{c}`"].alias(f"p{i}") for i, c in enumerate(passed)],
                        docs[f"`{text}`"].cast("string").alias("body"))
    model = docs.sparkSession.sparkContext.broadcast(redactor)  # some ten kilobytes
    names = [*given.columns[:-1], *[f"r{i}" for i in range(len(new))]]
    width = len(passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            body = batch.column(width)
            for lo, data, offsets in WD.text_slices(body):
                size = len(offsets) - 1
                part = body.slice(lo, size)
                number = np.zeros((len(KINDS), size), dtype=np.int64)
                sha, every = [nothing] * size, [""] * size
                changed: dict[int, str] = {}
                for i in np.flatnonzero(_worth(data, offsets)).tolist():
                    t = part[i].as_py()
                    base = base_spans(t)
                    spans = sorted(base + model.value.added(t, base))
                    for k, _, _ in base:
                        number[k, i] += 1
                    if base:
                        sha[i] = hashlib.sha256(shown(base).encode()).hexdigest()
                    every[i] = shown(spans)
                    if redacted and spans:
                        changed[i] = _redacted(t, spans)
                cols = [*[pa.array(n) for n in number], pa.array(sha, pa.string()), pa.array(every, pa.string())]
                if redacted:
                    cols.append(pa.array([changed.get(i, t) for i, t in enumerate(part.to_pylist())], pa.string())
                                if changed else part)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(lo, size) for i in range(width)], *cols],
                                                 names=names)

    kinds = ["long"] * len(KINDS) + ["string", "string", "string"]
    schema = ", ".join([f"`p{i}` {given.schema[f'p{i}'].dataType.simpleString()}" for i in range(width)]
                       + [f"r{i} {kinds[i]}" for i in range(len(new))])
    out = given.mapInArrow(run, schema)
    return out.select(*[out[f"p{i}"].alias(c) for i, c in enumerate(passed)],
                      *[out[f"r{i}"].alias(n) for i, n in enumerate(new)])
