"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a classifier decides.

Base spans (e-mail addresses, IP addresses, card and telephone numbers in strict form) always count. Looser
candidates, such as addresses written with ``[at]``, telephone numbers without a country code, IPv6 and short card numbers, are added
when the span classifier accepts them.

Every candidate gets votes (yes, no, none) of the labelers: form (regular expressions), gazetteer
(known top-level domains, calling codes, issuer prefixes, address ranges), context (words before the span that speak
for or against it), edges and make-up. Counts of vote patterns over all texts, of which there is a fixed number,
go to the driver; expectation-maximisation estimates how often each labeler is right for spans
that are personal data and for those that are not, and with that how likely each pattern is. A logistic
regression on votes, kind and length, fitted to these likelihoods weighted by counts, is the final classifier.

Matching is linear in the length of a text: no pattern can back up over a long run, and
starts that must fail are skipped. Texts without any digit, ``@`` or bracketed ``at`` are not scanned.

Edge cases: NULL and empty texts have no spans; where nothing is found the model is the labelers' prior. Added spans never
overlap base spans or each other. Columns are carried in a struct; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices, utf8

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.8
LABELERS = 6

# Fixed values of the gazetteers and context cues.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io co de fr es uk us eu it nl ch at be pt pl se no dk fi ca au jp cn in br mx ru".split())
CALLING = ("1", "7", "20", "27", "3", "4", "5", "6", "8", "9")
SPEAK_FOR = {
    "email": ("mail", "e-mail", "contact", "write", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "adresse", "client", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "pay"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "anruf", "llama"),
}
SPEAK_AGAINST = ("version", "release", "isbn", "token", "serial", "build", "order", "hash", "id", "=", "#")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r" ?[\[(] ?(?:at|AT) ?[\])] ?")
_SPELLED = re.compile(r"[A-Za-z0-9-]++(?:(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?|\.)[A-Za-z0-9-]++)++")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")


def _addresses(text: str, places: Iterator[tuple[int, int]], domain: re.Pattern) -> Iterator[tuple[int, int]]:
    """Addresses around separators at ``places``, leftmost first; runs between separators are read once."""
    floor = 0
    for at, behind in places:
        if at < floor or not (right := domain.match(text, behind)):
            continue
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            floor = right.end()
            yield start, floor


def _marks(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at >= 0:
        yield at, at + 1
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` in strict form, leftmost and without overlaps within a kind."""
    out = [(0, a, b) for a, b in _addresses(text, _marks(text), _DOMAIN)] if "@" in text else []
    out += [(1, *m.span()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    """Further candidates."""
    out = [(0, a, b) for a, b in _addresses(text, (m.span() for m in _AT.finditer(text)), _SPELLED)]
    out += [(1, *m.span()) for m in _IP6.finditer(text)] if text.count(":") >= 7 else []
    out += [(2, *m.span()) for m in _CARD.finditer(text) if len(d := re.sub("[ -]", "", m[0])) == 13 and luhn(d)]
    out += [(3, *m.span()) for m in _LOCAL_PHONE.finditer(text)]
    return out


def votes(text: str, kind: int, start: int, end: int, strict: bool) -> str:
    """One character per labeler (1 yes, 0 no, - none), then a class of length."""
    name, span = KINDS[kind], text[start:end]
    digits = "".join(c for c in span if c.isdigit())
    if kind == 0:
        known = re.split("[^A-Za-z0-9-]+", span)[-1].lower() in TOP_LEVEL
        made = any(map(str.isalpha, span[:2]))
    elif kind == 1:
        known = ":" in span or 0 < int(span.split(".")[0].lstrip("0") or 0) < 224
        made = ":" in span or not any(len(p) > 1 and p[0] == "0" for p in span.split("."))
    else:
        known = digits[0] in "3456" if kind == 2 else digits.startswith(CALLING) if strict else None
        made = len(set(digits)) > 2
    before = text[max(0, start - 32) : start].lower()
    words = set(re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?|[=#]", before))
    around = text[start - 1 : start] + text[end : end + 1]
    given = (
        True if strict else None,
        known,
        True if any(cue in words for cue in SPEAK_FOR[name]) else None,
        False if any(cue in words for cue in SPEAK_AGAINST) else None,
        not any(c.isalnum() or c in "_/=" for c in around),
        made,
    )
    return "".join("-" if v is None else "01"[v] for v in given) + str(min(9, (end - start) // 4))


def candidates(text: str) -> list[tuple[int, int, int, bool, str]]:
    """``(kind, start, end, strict, votes)`` of all base spans and of loose ones clear of them."""
    base = base_spans(text)
    found = [(k, a, b, True, votes(text, k, a, b, True)) for k, a, b in base]
    if loose := loose_spans(text):
        starts, ends = [], []  # of base spans, joined where they overlap
        for a, b in sorted((a, b) for _, a, b in base):
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        floor = 0
        for k, a, b in sorted(loose, key=lambda x: (x[1], -x[2], x[0])):
            before = bisect_left(starts, b)
            if a >= floor and (not before or ends[before - 1] <= a):
                floor = b
                found.append((k, a, b, False, votes(text, k, a, b, False)))
    return found


@dataclass
class SpanModel:
    """``right[y, l]``: how often labeler ``l`` says yes when it votes on spans of class ``y``."""

    right: np.ndarray
    prior: np.ndarray
    weights: np.ndarray

    def accepts(self, kind: int, pattern: str) -> bool:
        return float(1 / (1 + np.exp(-_features(kind, pattern) @ self.weights))) >= ACCEPT


def _features(kind: int, pattern: str) -> np.ndarray:
    x = np.zeros(1 + len(KINDS) + 2 * LABELERS + 10)
    x[0] = x[1 + kind] = 1
    for i, v in enumerate(pattern[:LABELERS]):
        if v != "-":
            x[1 + len(KINDS) + 2 * i + int(v)] = 1
    x[1 + len(KINDS) + 2 * LABELERS + int(pattern[LABELERS])] = 1
    return x


def learn(counts: list[tuple[int, str, int]], rounds: int = 50) -> SpanModel:
    """Reliabilities by expectation-maximisation over vote patterns, and the classifier."""
    right, prior = np.tile([[0.3], [0.8]], LABELERS), np.full(len(KINDS), 0.5)
    kind = np.array([k for k, _, _ in counts], dtype=int)
    vote = np.array([[{"-": -1, "0": 0, "1": 1}[v] for v in p[:LABELERS]] for _, p, _ in counts]).reshape(-1, LABELERS)
    n = np.array([c for _, _, c in counts], dtype=float)
    yes, voted = vote == 1, vote >= 0

    def likely() -> np.ndarray:
        log = [np.where(yes, np.log(right[y]), np.log(1 - right[y])) for y in (0, 1)]
        odds = np.log(prior[kind] / (1 - prior[kind])) + ((log[1] - log[0]) * voted).sum(1)
        return 1 / (1 + np.exp(-odds))

    for _ in range(rounds):
        p = likely()
        for y, share in ((0, (1 - p) * n), (1, p * n)):  # a few imagined votes keep every rate inside (0, 1)
            right[y] = ((share[:, None] * yes).sum(0) + (1, 4)[y]) / ((share[:, None] * voted).sum(0) + 5)
        prior = np.array([((p * n)[kind == k].sum() + 2) / (n[kind == k].sum() + 4) for k in range(len(KINDS))])
    x = np.array([_features(k, p) for k, p, _ in counts]).reshape(-1, 1 + len(KINDS) + 2 * LABELERS + 10)
    return SpanModel(right, prior, _regression(x, likely(), n))


def _regression(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Logistic regression for likelihoods ``y`` of ``n`` spans each, by Newton's method with a ridge."""
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (n * (p - y)) + w
        w = w - np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, slope)
    return w


def fit(docs: DataFrame, text: str = "text") -> SpanModel:
    """A model from the vote patterns of all texts."""
    patterns = docs.select(F.coalesce(text, F.lit("")).alias("text")).mapInArrow(_patterns, "kind bigint, pattern string, n bigint")
    counted = patterns.groupBy("kind", "pattern").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    return learn(sorted((r["kind"], r["pattern"], r["n"]) for r in counted))


def _worth(texts: pa.Array) -> Iterator[tuple[int, str]]:
    """Texts that may hold anything: with a digit, an at sign or a bracket."""
    flat, offsets = utf8(texts)
    mark = ((flat >= 48) & (flat <= 57)) | (flat == 64) | (flat == 91) | (flat == 40)
    some = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(mark)])[offsets]))
    for i in some.tolist():
        yield i, texts[i].as_py()


def _patterns(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally: dict[tuple[int, str], int] = {}
    for part in slices(rows):
        for _, text in _worth(part.column("text")):
            for kind, _, _, _, pattern in candidates(text):
                tally[kind, pattern] = tally.get((kind, pattern), 0) + 1
    if tally:
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in tally]), pa.array([p for _, p in tally]), pa.array(list(tally.values()))],
            names=["kind", "pattern", "n"],
        )


def find_spans(docs: DataFrame, model: SpanModel, carry: Sequence[str] = ("doc_id",), redact: bool = False) -> DataFrame:
    """``row`` (struct of ``carry``), counts of base spans by kind, ``base_sha256, spans``, and the number of
    added spans; with ``redact`` also ``redacted``, the text with every span replaced by its kind.

    Spans are written ``kind:start:end`` (code points, end exclusive), by start, then kind.
    """
    texts = docs.select(F.struct(*carry).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = f"row {texts.schema['row'].dataType.simpleString()}, {_FOUND}" + ", redacted string" * redact
    return texts.mapInArrow(partial(_find, model=shared, redact=redact), kind)


_FOUND = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], s[0])))


def cleaned(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with spans, joined where they overlap, replaced by the name of the first's kind."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], s[0])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _find(rows: Iterator[pa.RecordBatch], model, redact: bool) -> Iterator[pa.RecordBatch]:
    model = model.value
    accepted: dict[tuple[int, str], bool] = {}
    empty = hashlib.sha256(b"").hexdigest()
    for part in slices(rows):
        size = part.num_rows
        counts = np.zeros((5, size), dtype=np.int64)
        digest, spans, new = [empty] * size, [""] * size, {}
        for i, text in _worth(part.column("text")):
            found = candidates(text)
            base = [(k, a, b) for k, a, b, strict, _ in found if strict]
            added = []
            for k, a, b, strict, pattern in found:
                if not strict:
                    if (k, pattern) not in accepted:
                        accepted[k, pattern] = model.accepts(k, pattern)
                    if accepted[k, pattern]:
                        added.append((k, a, b))
            for k, _, _ in base:
                counts[k, i] += 1
            counts[4, i] = len(added)
            digest[i] = hashlib.sha256(_written(base).encode()).hexdigest()
            spans[i] = _written(base + added)
            if redact and (base or added):
                new[i] = cleaned(text, base + added)
        columns = [part.column("row"), *map(pa.array, counts[:4]), pa.array(digest), pa.array(spans), pa.array(counts[4])]
        names = ["row", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
        if redact:
            texts = part.column("text")
            mask = np.zeros(size, dtype=bool)
            mask[list(new)] = True
            columns.append(texts if not new else pc.replace_with_mask(texts, pa.array(mask), pa.array([new[i] for i in sorted(new)], texts.type)))
            names.append("redacted")
        yield pa.RecordBatch.from_arrays(columns, names=names)
