"""Personal data: fixed patterns, and boosted trees over spans that high-recall generators propose."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._gbt import BoostedTrees, entropy, fitted
from ._shared import sample_by_hash, sliced

#: The kinds in their order, each with its pattern.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
ADDED = "model"
#: Generators: wide on purpose, and their spans may overlap. The first is what stands around an @.
GENERATORS = [re.compile(r"[^\s@]+@[^\s@]+"), re.compile(r"[+(]?[0-9][0-9 ().\-/]{5,}[0-9]"), re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){2,}")]
#: The same matches as the fixed ip pattern's, each run of digits tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_DOMAIN, _NO_SPACE = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++"), re.compile(r"[^\s@]++")
_LOCAL = "".join(map(chr, range(48, 58))) + "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz._%+-"
#: What no kind of personal data looks like: dates and spans of years.
NEVER = re.compile(r"(19|20)[0-9]{2}[-/. ]{1,3}((19|20)[0-9]{2}|[01]?[0-9][-/. ][0-3]?[0-9])|[0-3]?[0-9][-/. ][01]?[0-9][-/. ](19|20)[0-9]{2}")
#: Bounds of the labelled sample that the trees are fitted on, and the precision that the threshold must reach.
TRAINING_DOCUMENTS, TRAINING_SPANS, PRECISION = 4000, 20_000, 0.98

_DIGIT = re.compile(r"[0-9]")
_CUES = ("mail", "phone", "tel", "call", "card", "ip", "addr", "contact", "id", "no")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _valid(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in found.split(".")))
    digits = _digits(found)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def around_at(text: str, before: Callable[[str], int], after: re.Pattern) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a run, an @ and ``after``, in one pass over the text: ``before`` gives the length of the run at a
    stretch's end. The run's class has no @, so a run fails or succeeds as a whole and is looked at once.
    """
    free, at = 0, text.find("@")
    while at >= 0:
        run = before(text[free:at])
        found = after.match(text, at + 1) if run else None
        if found:
            yield at - run, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def _unspaced(stretch: str) -> int:
    return 0 if not stretch or stretch[-1].isspace() else len(stretch.rsplit(None, 1)[-1])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start: leftmost matches that pass their test. Linear in the text."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in around_at(text, lambda s: len(s) - len(s.rstrip(_LOCAL)), _DOMAIN)]
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _IP), ("card", PATTERNS["card"]), *([("phone", PATTERNS["phone"])] if "+" in text else [])):
            out += [(kind, *m.span()) for m in pattern.finditer(text) if _valid(kind, m[0])]
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that the generators propose. Linear in the text."""
    found = set(around_at(text, _unspaced, _NO_SPACE)) if "@" in text else set()
    if _DIGIT.search(text):
        found |= {m.span() for g in GENERATORS[1:] for m in g.finditer(text)}
    return sorted(found)


def features(text: str, span: tuple[int, int]) -> list[float]:
    """Format of the span and its context: lengths, characters, groups, check digit, cue words before it."""
    a, b = span
    s, digits = text[a:b], _digits(text[a:b])
    n = len(s)
    before = text[max(0, a - 24) : a].lower()
    domain = s.rpartition("@")[2]
    return [
        n, len(digits), len(digits) / n, s.count("@"), s.count("."), s.count("-"), s.count(" "), float(s[0] == "+"), float("(" in s),
        float(len(digits) >= 2 and luhn(digits)), len(re.findall(r"[0-9]+", s)), max((len(x) for x in re.findall(r"[0-9]+", s)), default=0),
        domain.count("."), len(domain), sum(not (c.isascii() and (c.isalnum() or c in ".@+-_% ()")) for c in s) / n, entropy(s),
        float(a > 0 and text[a - 1].isalnum()), float(b < len(text) and text[b].isalnum()), *(float(c in before) for c in _CUES),
    ]


class Covered:
    """The stretches that spans cover, for asking whether another one overlaps them."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()):
        self.parts: list[tuple[int, int]] = []  # disjoint, in order
        for a, b in sorted(spans):
            if self.parts and a < self.parts[-1][1]:
                self.parts[-1] = (self.parts[-1][0], max(b, self.parts[-1][1]))
            else:
                self.parts.append((a, b))

    def overlaps(self, span: tuple[int, int]) -> bool:
        at = bisect_left(self.parts, (span[1],))  # the parts before it start before the span's end
        return at > 0 and self.parts[at - 1][1] > span[0]

    def add(self, span: tuple[int, int]) -> None:
        insort(self.parts, span)


def _covered(base: list[tuple[str, int, int]]) -> Covered:
    return Covered((a, b) for _, a, b in base)


def renderings(kind: str, found: str) -> list[tuple[str, str, str, float]]:
    """(left, shown, right, label): a base match in formats that the fixed patterns do not know (1), and dates, years,
    versions, the digits of an identifier, and a card number with a wrong check digit in its place (0).
    """
    d = _digits(found)
    if kind == "phone":
        n = d[-10:]
        good = [f"{n[:3]}-{n[3:6]}-{n[6:]}", f"({n[:3]}) {n[3:6]}-{n[6:]}", f"{n[:3]}.{n[3:6]}.{n[6:]}", f"{n[:-7]} {n[-7:-4]} {n[-4:]}", n]
    elif kind == "card":
        good = [sep.join(d[i : i + 4] for i in range(0, len(d), 4)) for sep in (".", "/", " - ")]
    elif kind == "ip":
        good = [found.replace(".", sep) for sep in ("-", " . ")]
    else:
        good = []
    x = sum(map(ord, found))
    y, m, t = 1950 + x % 80, 1 + x % 12, 1 + x % 28
    bad = [f"{y}-{m:02}-{t:02}", f"{t:02}/{m:02}/{y}", f"{y}-{y + 1 + x % 9}", f"{x % 30}.{m}.{t}", f"{m}.{x % 900 + 256}.{t}.{x % 7000 + 256}"]
    if kind == "card":
        bad += [found[:-1] + str((int(found[-1]) + k) % 10) for k in (1, 4, 7)] + [d[:-1] + str((int(d[-1]) + k) % 10) for k in (2, 5)]
    letters = chr(97 + x % 26), chr(97 + x // 26 % 26)
    named = [(le, e, ri, 0.0) for e in {d[:7], d[-10:], d} if len(e) > 6 for le, ri in ((letters[0], ""), ("", letters[1]), letters)]
    return [("", g, "", 1.0) for g in good] + [("", b, "", 0.0) for b in bad] + named


def _inside_word(text: str, span: tuple[int, int]) -> bool:
    """Digits with a letter next to them: part of an identifier."""
    a, b = span
    return "@" not in text[a:b] and (text[a - 1 : a].isalpha() or text[b : b + 1].isalpha())


def labelled(text: str) -> list[tuple[list[float], float]]:
    """Features and label of base matches, of their other renderings in place, and of what is never personal (dates, years,
    digits inside identifiers); no others.
    """
    base = base_spans(text)
    known, out = _covered(base), []
    for span in candidates(text):
        if known.overlaps(span):
            out.append((features(text, span), 1.0))
        elif NEVER.fullmatch(text[span[0] : span[1]]) or _inside_word(text, span):
            out.append((features(text, span), 0.0))
    for kind, a, b in base:
        before, after = text[max(0, a - 40) : a], text[b : b + 40]
        for left, shown, right, label in renderings(kind, text[a:b]):
            start = len(before) + len(left)
            around, span = before + left + shown + right + after, (start, start + len(shown))
            if span in candidates(around) and not _covered(base_spans(around)).overlaps(span):
                out.append((features(around, span), label))
    return out


def train(docs: DataFrame, documents: int = TRAINING_DOCUMENTS, spans: int = TRAINING_SPANS) -> BoostedTrees:
    """Trees that tell personal data (1) from dates, years and versions (0), on labels that do not hang on the base's format.

    Base matches count as they are and in other formats; what nothing says about is in neither class. Fitted on the candidates of at most ``documents`` documents with an @ or a digit, ``spans`` at most.
    """
    width = len(features("0", (0, 1)))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x, y = [], []
            for text in batch.column(0).to_pylist():
                for row, is_personal in labelled(text):
                    x.append(row)
                    y.append(is_personal)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.float64())], ["x", "y"])

    likely = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]"))
    rows = sample_by_hash(likely, "doc_id", documents, docs.count(), slack=10).select("text").mapInArrow(label, "x array<double>, y double").limit(spans).collect()
    x = np.array([r["x"] for r in rows]).reshape(-1, width)
    mixed = np.random.default_rng(5).permutation(len(x))  # renderings come in turn, and every fifth row is held out
    return fitted(x[mixed], np.array([r["y"] for r in rows])[mixed], PRECISION)


def find_pii(docs: DataFrame, model: BoostedTrees | None = None) -> DataFrame:
    """doc_id, base, added: arrays of (kind, start, end) by kind, then start, code points, end exclusive.

    ``base`` holds the fixed patterns' valid matches. ``added`` holds candidates that overlap none of them and whose
    probability reaches the calibrated threshold, of kind "model"; where they overlap each other the likelier stays.
    Without labelled rows of both kinds nothing is added.

    Null and empty texts have no spans; whole texts are read; every row, equal ones too, gives a row; null ids stay
    null; other columns are ignored; no rows give none.
    """
    trees = model or train(docs)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            bases = [base_spans(t) for t in texts]
            taken = [_covered(b) for b in bases]
            open_ = [(i, c) for i, t in enumerate(texts) for c in candidates(t) if not taken[i].overlaps(c)]
            added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
            if open_ and trees.threshold <= 1:
                p = trees.probability(np.array([features(texts[i], c) for i, c in open_]))
                for j in np.argsort(-p, kind="stable"):
                    i, c = open_[j]
                    if p[j] >= trees.threshold and not taken[i].overlaps(c):
                        taken[i].add(c)
                        added[i].append((ADDED, *c))
            rows = lambda spans: pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], span)
            yield pa.RecordBatch.from_arrays([batch.column(0), rows(bases), rows([sorted(a) for a in added])], ["doc_id", "base", "added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<kind:string,start:long,end:long>>"
    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, base {spans}, added {spans}")
