"""Personal data: fixed patterns, and gradient-boosted trees over candidate spans.

The patterns give the base spans. Generators of high recall propose further spans, which may
overlap: spelled-out addresses, long numbers with any separators, grouped identifiers, bank account
numbers, hexadecimal addresses. Trees score each by its format, checksum and context.

They are trained here on the proposals of all documents: rows that are equal are counted once, and each level of a tree is one
pass over them that brings back sums by feature and bin. A proposal is a positive if it is a base span of its kind or
passes its kind's own rule (an account's remainder by 97, eight hexadecimal groups, a spelled-out address whose
last label is letters, a valid identity number beside a word for it), a negative if it fails its format's check, and stays out if it could
be either. As documents may hold few of these forms, each base span is also rewritten, in its place, into the forms that the base
patterns do not take, and into lookalikes of them (clock times, dates, wrong check digits). A threshold for each generator is
set on documents that training left out, the least at which nearly all that pass are positives and nearly none of the
negatives that the documents hold themselves does. What passes is redacted too.
"""

from __future__ import annotations

import ipaddress
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from sitegauge.session import stored

TREES = 40
DEPTH = 3
RATE = 0.3
BINS = 32
#: Share of positives wanted among the set-aside proposals that reach a threshold, and how many there must be.
PRECISION = 0.98
LEAST_PASSED = 20
#: Most of the documents' own negatives that may reach a threshold.
OWN_PASSED = 0.01
#: Cells of a logit's unit in which scores are counted for a threshold.
CELLS = 64
#: Rewritings of each base span.
REWRITINGS = 4

# The base patterns. Look-behinds only spare repeated attempts inside one run.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")

#: Generators: kind, and pattern.
PROPOSERS = tuple(
    (kind, re.compile(pattern))
    for kind, pattern in (
        ("email", r"(?<![\w.+-])[\w.+-]{1,64}(?: ?@ ?| ?[(\[] ?at ?[)\]] ?)[\w-]{1,63}(?: ?(?:\.|[(\[] ?dot ?[)\]]) ?[\w-]{2,63}){1,4}"),
        ("ip", r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![0-9])"),
        ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
        ("card", r"(?<![0-9])[0-9]{4}(?:[ ./-]?[0-9]{2,6}){2,5}(?![0-9])"),
        ("phone", r"(?<![0-9+])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[ ./-]?\(?[0-9]{2,5}\)?){2,5}(?![0-9])"),
        ("account", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])"),
        ("identity", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    )
)
ALL_KINDS = (*KINDS, "account", "identity")
CONTEXT = re.compile(r"(?i)(mail|write|e-?mail)|(\bip\b|host|server)|(card|visa|credit|pay)|(tel|phone|call|mobile|fax)|(iban|account)|(ssn|social|passport|id\b)")

_SPELLED = re.compile(r"[(\[] ?at ?[)\]]")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}(?![0-9])|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}(?![0-9])")
_LABELS = re.compile(r"\.| ?[(\[] ?dot ?[)\]] ?")
EMAIL, IP4, IP6, CARD_NUMBER, PHONE_NUMBER, ACCOUNT, IDENTITY = range(len(PROPOSERS))

Span = tuple[int, int, int]  # first, kind, last


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: an @ with the local part back to the last match, and a domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in LOCAL:
            first -= 1
        domain = DOMAIN.match(text, at + 1) if first < at else None
        if domain:
            yield first, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[Span]:
    """(first, kind, last) of the fixed patterns' spans, by start, then kind."""
    text = text or ""
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = _only_digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_only_digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def proposals(text: str) -> list[tuple[int, int, int, int]]:
    """(first, kind, last, generator) of all generators' spans."""
    found = []
    for number, (kind, pattern) in enumerate(PROPOSERS):
        if kind == "email" and "@" not in text and not _SPELLED.search(text):
            continue
        found += [(m.start(), ALL_KINDS.index(kind), m.end(), number) for m in pattern.finditer(text)]
    return found


def remainder_97(account: str) -> int:
    """Of an account number with its first four characters moved to the end, letters as 10 to 35."""
    letters = account.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in letters[4:] + letters[:4])) % 97


def check(span: str, generator: int) -> bool:
    """Whether a proposal passes the check of its format."""
    digits = _only_digits(span)
    if generator == EMAIL:
        last = _LABELS.split(span)[-1].strip()
        return 2 <= len(last) <= 24 and last.isalpha()
    if generator == IP4:
        return all(int(part) <= 255 for part in span.split("."))
    if generator == IP6:
        try:
            return bool(ipaddress.IPv6Address(span))
        except ValueError:
            return False
    if generator == CARD_NUMBER:
        return 13 <= len(digits) <= 19 and luhn(digits)
    if generator == PHONE_NUMBER:
        return 10 <= len(digits) <= 15 and not _DATE.match(span)
    if generator == ACCOUNT:
        return remainder_97(span) == 1
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def features(text: str, first: int, last: int, generator: int) -> list[int]:
    """Format, check and context of a proposal, as small integers. Reads 24 characters before it and one after."""
    span, before, after = text[first:last], text[max(0, first - 24) : first], text[last : last + 2]
    digits = _only_digits(span)
    groups = re.split(r"[^0-9A-Za-z]+", span.strip("+()"))
    seen = CONTEXT.search(before)
    kind_of = lambda c: 0 if not c else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c.isspace() else 4
    return [
        generator,
        len(span),
        len(digits),
        sum(c.isalpha() for c in span),
        len(groups),
        max(map(len, groups)),
        min(map(len, groups)),
        span.count(" "),
        span.count("-"),
        span.count("."),
        span.count("(") + span.count(")"),
        span.count("@"),
        int(span.startswith("+")),
        int(luhn(digits)) if digits else 2,
        len(set(digits)),
        int(bool(groups) and all(g.isdigit() and len(g) < 4 and int(g) < 256 for g in groups)),
        kind_of(before[-1:]),
        kind_of(after[:1]),
        seen.lastindex if seen else 0,
        int(digits[:1] or 0) if digits else 10,
        int(check(span, generator)),
    ]


@dataclass
class Trees:
    """Boosted trees over features cut at BINS - 1: of each node its feature, cut and value."""

    nodes: list[list[tuple[int, int, float, float]]] = field(default_factory=list)
    start: float = 0.0
    thresholds: dict[int, float] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        x = np.minimum(x, BINS - 1)
        logit = np.full(len(x), self.start)
        for tree in self.nodes:
            logit += np.array([n[2] for n in tree])[_place(x, tree, DEPTH)]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _place(x: np.ndarray, tree: list[tuple[int, int, float, float]], steps: int) -> np.ndarray:
    """The node of every row after so many steps from the root."""
    feature, cut = (np.array([n[k] for n in tree]) for k in (0, 1))
    at = np.zeros(len(x), dtype=np.int64)
    for _ in range(steps):
        right = x[np.arange(len(x)), np.maximum(feature[at], 0)] > cut[at]
        at = np.where(feature[at] >= 0, 2 * at + 1 + right, at)
    return at


def histograms(x: np.ndarray, y: np.ndarray, n: np.ndarray, model: Trees, tree: list, level: int) -> np.ndarray:
    """Sums of slope, curve and rows by node of the level, feature and bin, over rows that stand for ``n`` each."""
    x, width, first = np.minimum(x, BINS - 1).astype(np.int64), x.shape[1], 2**level - 1
    p, at = model.score(x), _place(x, tree, level) - first
    inside = at >= 0
    x, p, y, n, at = x[inside], p[inside], y[inside], n[inside], at[inside]
    flat = (x + BINS * np.arange(width) + BINS * width * at[:, None]).ravel()
    sums = [np.bincount(flat, weights=np.repeat(v * n, width), minlength=BINS * width << level) for v in (y - p, p * (1 - p), np.ones(len(y)))]
    return np.array(sums).reshape(3, 1 << level, width, BINS)


def grow(share: float, sums_of: Callable[[Trees, list, int], np.ndarray]) -> Trees:
    """Trees of DEPTH for the logistic loss, by histograms of the binned features; ``sums_of`` gives those of a level."""
    share = min(max(share, 1e-4), 1 - 1e-4)
    model = Trees(start=float(np.log(share / (1 - share))))
    for _ in range(TREES):
        tree, value_of = [(-1, 0, 0.0, 0.0)] * (2 ** (DEPTH + 1) - 1), {}
        for level in range(DEPTH):
            first, sums = 2**level - 1, sums_of(model, tree, level)
            if not level:
                value_of[0] = sums[:, 0, 0].sum(axis=1)
            for at in range(first, 2 * first + 1):
                if at not in value_of or value_of[at][2] < 10:
                    continue
                total, whole, _rows = value_of[at]
                left, weigh, rows = sums[:, at - first].cumsum(axis=2)
                gain = left**2 / (weigh + 1) + (total - left) ** 2 / (whole - weigh + 1) - total**2 / (whole + 1)
                # the order in which rows are summed must not choose between equal gains
                best = int(np.argmax(np.round(gain[:, :-1], 6)))
                f, cut = divmod(best, BINS - 1)
                if gain[f, cut] < 1e-3:
                    continue
                tree[at] = (f, cut, 0.0, 0.0)
                value_of[2 * at + 1] = np.array([left[f, cut], weigh[f, cut], rows[f, cut]])
                value_of[2 * at + 2] = value_of[at] - value_of[2 * at + 1]
            if not any(node[0] >= 0 for node in tree[first : 2 * first + 1]):
                break
        for at, (slope, curve, rows) in value_of.items():
            if tree[at][0] < 0 and rows:
                tree[at] = (-1, 0, float(RATE * slope / (curve + 1)), 0.0)
        model.nodes.append(tree)
    return model


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """:func:`grow` over rows in memory."""
    n = np.ones(len(y))
    return grow(float(y.mean()), lambda model, tree, level: histograms(x, y, n, model, tree, level))


def _label(text: str, first: int, last: int, generator: int) -> int | None:
    """1 or 0 for a proposal clear of all base spans, None if it could be either."""
    span = text[first:last]
    if not check(span, generator):
        return 0
    seen = CONTEXT.search(text[max(0, first - 24) : first])
    named = seen.lastindex if seen else 0
    if generator in (EMAIL, IP6, ACCOUNT):
        return 1
    if generator == CARD_NUMBER:
        return 1 if named == 3 else None
    if generator == IDENTITY:
        return 1 if named == 6 else None
    # a bare run of digits with no word for a telephone before it is some other number
    return 0 if generator == PHONE_NUMBER and named != 4 and span.isdigit() else None


def _grouped(text: str, size: int, between: str) -> str:
    return between.join(text[k : k + size] for k in range(0, len(text), size))


def _forms(kind: int, span: str, rng: random.Random) -> Iterator[tuple[str, str, int, int]]:
    """(lead, form, generator, label): a base span as forms outside the base patterns, and lookalikes of them."""
    digits = _only_digits(span)
    if kind == 0:
        local, domain = span.split("@", 1)
        at = rng.choice((" (at) ", " [at] ", "(at)", " ( at ) "))
        yield "", local + at + domain.replace(".", rng.choice((".", " (dot) ", " [dot] ", "[dot]"))), EMAIL, 1
        yield "", f"{local}{at}{rng.randrange(1, 13)}.{rng.randrange(10, 60)}", EMAIL, 0
    elif kind == 1:
        yield "", ":".join(f"{rng.randrange(1 << rng.choice((8, 16, 16))):x}" for _ in range(8)), IP6, 1
        yield "", ":".join(f"{rng.randrange(256):02x}" for _ in range(6)), IP6, 0
        yield "", ":".join(f"{rng.randrange(60):02d}" for _ in range(rng.choice((5, 6)))), IP6, 0
    elif kind == 2:
        between = rng.choice("./")
        wrong = digits[:-1] + str((int(digits[-1]) + rng.randrange(1, 10)) % 10)
        yield "", _grouped(digits, 4, between), CARD_NUMBER, 1
        yield "", _grouped(wrong, 4, rng.choice((between, " ", ""))), CARD_NUMBER, 0
        bank = "".join(rng.choice("ABCDEFGHKLMNPRSTUVWXYZ") for _ in range(rng.choice((0, 0, 4))))
        number = bank + digits + "".join(rng.choice("0123456789") for _ in range(rng.choice((0, 2, 4))))
        country = "".join(rng.choice("ABCDEFGHIKLMNPRSTU") for _ in range(2))
        right = 98 - remainder_97(country + "00" + number)
        lead, between = rng.choice(("", "IBAN ", "iban: ", "account ")), rng.choice(("", " "))
        for tail, label in ((right, 1), ((right + rng.randrange(1, 96)) % 97, 0)):
            yield lead, _grouped(f"{country}{tail:02d}{number}", 4, between), ACCOUNT, label
    else:
        bare = span[1:].strip(" .-")
        yield rng.choice(("", "tel ", "call ", "phone: ")), rng.choice(("", "00")) + bare, PHONE_NUMBER, 1
        yield "", f"{rng.choice((19, 20))}{rng.randrange(100):02d}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d} {rng.randrange(24):02d}", PHONE_NUMBER, 0
        yield "", "".join(rng.choice("123456789") for _ in range(rng.randrange(9, 20))), PHONE_NUMBER, 0
        tail = f"-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}"
        word = rng.choice(("SSN ", "SSN: ", "social security ", "passport "))
        yield word, f"{rng.choice([k for k in range(1, 900) if k != 666]):03d}{tail}", IDENTITY, 1
        yield rng.choice((word, "", "part no. ")), f"{rng.choice((0, 666, *range(900, 1000))):03d}{tail}", IDENTITY, 0


def _clear(base: list[Span], proposed: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The proposals that overlap no base span."""
    return [c for c in proposed if not any(a < c[2] and c[0] < b for a, _, b in base)]


def _packed(x: list[int], *more: int) -> bytes:
    return bytes([*(min(v, BINS - 1) for v in x), *more])


def _read(text: str, seed: int) -> tuple[list[Span], list[tuple[int, int, int, int]], list[bytes], list[bytes]]:
    """Base spans, proposals clear of them with their binned features, and the rows to learn from.

    A row has the binned features of a proposal or of a base span's rewritten form, its label, 1 if
    rewritten, and 1 if its document is set aside.
    """
    base, proposed, aside = base_spans(text), proposals(text), seed >> 32 & 1
    spans, open_ = set(base), _clear(base, proposed)
    rows = [_packed(features(text, a, b, g), 1, 0, aside) for a, k, b, g in proposed if (a, k, b) in spans]
    facts = [_packed(features(text, a, b, g)) for a, _, b, g in open_]
    for fact, (first, _, last, generator) in zip(facts, open_):
        label = _label(text, first, last, generator)
        if label is not None:
            rows.append(fact + bytes([label, 0, aside]))
    rng = random.Random(seed)
    for first, kind, last in base:
        for _ in range(REWRITINGS):
            for lead, form, generator, label in _forms(kind, text[first:last], rng):
                # more than the features and the patterns' looks around a span read
                before = text[max(0, first - 40) : first] + lead
                around = before + form + text[last : last + 8]
                place = (len(before), ALL_KINDS.index(PROPOSERS[generator][0]), len(before) + len(form), generator)
                if place in proposals(around):
                    rows.append(_packed(features(around, place[0], place[2], generator), label, 1, aside))
    return base, open_, facts, rows


def _facts(docs: DataFrame) -> DataFrame:
    """doc_id, base and open (places of spans and of proposals, flat), facts (their features) and rows of every document."""
    kinds = {"base": pa.list_(pa.int32()), "open": pa.list_(pa.int32()), "facts": pa.list_(pa.binary()), "rows": pa.list_(pa.binary())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_read(t.as_py() or "", o) for o, t in zip(batch.column("o").to_pylist(), batch.column("text"))]
            flat = [([v for s in base for v in s], [v for c in open_ for v in c], facts, rows) for base, open_, facts, rows in found]
            columns = [pa.array([f[k] for f in flat], kind) for k, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *kinds])

    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("pii"))
    rest = StructType.fromDDL("base array<int>, open array<int>, facts array<binary>, rows array<binary>")
    schema = StructType([docs.schema["doc_id"], *rest.fields])
    return docs.select("doc_id", order.alias("o"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, label, rewritten, set aside, and how many such rows."""
    rows = np.frombuffer(b"".join(batch.column("row").to_pylist()), np.uint8).reshape(batch.num_rows, -1).astype(np.int64)
    return rows[:, :-3], rows[:, -3], rows[:, -2], rows[:, -1], batch.column("n").to_numpy()


def _learn(facts: DataFrame) -> Trees:
    """Trees and thresholds from all rows of :func:`_facts`, equal ones counted once."""
    rows = stored(facts.select(F.explode("rows").alias("row")).groupBy("row").agg(F.count("*").alias("n")), "pii")
    part = rows.select(F.substring("row", -1, 1).alias("aside"), F.substring("row", -3, 1).alias("y"), "n").groupBy("aside", "y")
    counts = {(r["aside"][0], r["y"][0]): r["n"] for r in part.agg(F.sum("n").alias("n")).collect()}
    none, some = (counts.get((0, y), 0) for y in (0, 1))
    if not none or not some:
        return Trees()

    def sums_of(model: Trees, tree: list, level: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                x, y, _, aside, n = _unpacked(batch)
                fit = aside == 0
                found = histograms(x[fit], y[fit], n[fit], model, tree, level)
                total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        parts = rows.mapInArrow(run, "sums binary").toArrow().column("sums").to_pylist()
        return sum(np.frombuffer(p).reshape(3, 1 << level, -1, BINS) for p in parts)

    model = grow(some / (none + some), sums_of)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, made, aside, n = _unpacked(batch)
            p = model.score(x)
            cell = np.floor(CELLS * np.log(p / (1 - p))).astype(np.int64)
            kept = aside == 1
            yield pa.RecordBatch.from_arrays([pa.array(v[kept]) for v in (x[:, 0], cell, y, made, n, p)], ["generator", "cell", "y", "made", "n", "p"])

    cells = rows.mapInArrow(scored, "generator long, cell long, y long, made long, n long, p double").groupBy("generator", "cell", "y", "made")
    got = cells.agg(F.sum("n").alias("n"), F.min("p").alias("p")).toArrow()
    generator, cell, y, made, n, p = (got.column(c).to_numpy() for c in ("generator", "cell", "y", "made", "n", "p"))
    for g in np.unique(generator):
        own = generator == g
        _, of = np.unique(cell[own], return_inverse=True)
        least = np.ones(of.max() + 1)
        np.minimum.at(least, of, p[own])
        limit = _threshold(least[of], y[own], made[own], n[own])
        if limit is not None:
            model.thresholds[int(g)] = limit
    return model


def fit(docs: DataFrame) -> Trees:
    """Trees from the proposals of all documents; a hash of the doc_id sets half of the documents aside for thresholds."""
    return _learn(_facts(docs))


def _threshold(p: np.ndarray, y: np.ndarray, made: np.ndarray, n: np.ndarray | None = None) -> float | None:
    """The least score at which PRECISION of those that reach it are positives and OWN_PASSED of the documents' own negatives do."""
    rank = np.argsort(-p, kind="stable")
    n = (np.ones(len(p), np.int64) if n is None else n)[rank]
    reached = np.cumsum(n)
    own = n * ((y == 0) & (made == 0))[rank]
    fits = (np.cumsum(n * y[rank]) >= PRECISION * reached) & (reached >= LEAST_PASSED) & (np.cumsum(own) <= OWN_PASSED * own.sum())
    # of equal scores all pass or none
    passed = np.flatnonzero(fits & np.append(np.diff(p[rank]) != 0, True))
    return float(p[rank][passed[-1]]) if len(passed) else None


def _passing(base: list[Span], open_: list[tuple[int, int, int, int]], scores: list[float], model: Trees) -> list[Span]:
    """Base spans and the proposals that pass, the most likely of those that overlap."""
    kept: list[Span] = []
    for score, (a, k, b, g) in sorted(zip(scores, open_), key=lambda r: (-r[0], r[1])):
        if g in model.thresholds and score >= model.thresholds[g] and not any(x < b and a < y for x, _, y in kept):
            kept.append((a, k, b))
    return sorted([*base, *kept])


def all_spans(text: str | None, model: Trees) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: with the proposals that pass, the most likely of those that overlap."""
    text = text or ""
    base = base_spans(text)
    open_ = [c for c in _clear(base, proposals(text)) if c[3] in model.thresholds] if model.thresholds else []
    if not open_:
        return base, base
    scores = model.score(np.array([features(text, a, b, g) for a, _, b, g in open_], dtype=np.int64))
    return base, _passing(base, open_, scores.tolist(), model)


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base and spans (kind:start:end) of every row.

    Places are in code points, the end exclusive. A null text counts as empty. Repeated rows stay
    repeated, a null doc_id stays null, an empty table gives an empty result, further columns are ignored.
    """
    found = lambda batch, trees: [all_spans(t.as_py(), trees) for t in batch.column("text")]
    return _span_rows(docs.select("doc_id", F.col("text").cast("string").alias("text")), found, model)


def detect(docs: DataFrame) -> DataFrame:
    """:func:`scan` of ``docs`` by the trees that :func:`fit` learns from the same rows; each text is read once."""
    facts = stored(_facts(docs), "pii")

    def found(batch: pa.RecordBatch, trees: Trees) -> list[tuple[list[Span], list[Span]]]:
        split = lambda flat, width: [tuple(flat[k : k + width]) for k in range(0, len(flat), width)]
        base, open_ = ([split(f, width) for f in batch.column(name).to_pylist()] for name, width in (("base", 3), ("open", 4)))
        packed = b"".join(f for own in batch.column("facts").to_pylist() for f in own)
        scores = iter(())
        if packed and trees.thresholds:
            scores = iter(trees.score(np.frombuffer(packed, np.uint8).reshape(sum(map(len, open_)), -1).astype(np.int64)).tolist())
        return [(b, _passing(b, o, [s for _, s in zip(o, scores)], trees)) for b, o in zip(base, open_)]

    return _span_rows(facts.drop("rows"), found, _learn(facts))


def _span_rows(rows: DataFrame, found: Callable[[pa.RecordBatch, Trees], list[tuple[list[Span], list[Span]]]], model: Trees) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = found(batch, shared.value)
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in spans], pa.int64()) for k in range(len(KINDS))]
            texts = [pa.array([spans_text(s[which]) for s in spans], pa.string()) for which in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, *texts], ["doc_id", *names, "base", "spans"])

    schema = StructType([rows.schema["doc_id"]])
    for name in names:
        schema = schema.add(name, LongType())
    return rows.mapInArrow(run, schema.add("base", StringType()).add("spans", StringType()))
