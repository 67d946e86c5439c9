"""Secret scans with Spark functions only: fixed patterns, and a battery of randomness tests.

The patterns give spans as they stand. Further candidates are long runs of encoding characters.
From its characters a candidate is taken for hexadecimal, base 32 or base 64, and its symbols are tested
against what a random key would show: even use of the alphabet (chi-squared), runs above and
below its middle, and correlation of neighbours. A candidate that the three together (Fisher)
do not reject is random enough. It is a discovery if ordinary text of its length would hardly use
the alphabet as evenly: the chance of that comes from the letter counts of the whole corpus, and
within each encoding and length class the chances are cut by Benjamini and Hochberg's rule, so that
short candidates, which tell little, are held to what their own class supports.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import let
from sitegauge.session import materialize

# The patterns of the base spans, by kind in the order of their names.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE_CHARS = 6
ASSIGN_NEEDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
#: Encodings by alphabet; a candidate belongs to the first whose test it passes.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: A candidate is kept if its three tests together do not reject randomness at this level.
RANDOM_LEVEL = 0.001
#: Share of false discoveries allowed in each encoding and length class.
FALSE_SHARE = 0.01
#: Steps of the base-ten logarithm in which chances are counted.
LOG_STEPS = 4
CHUNK = 256


def _running(lengths: Column) -> Column:
    """Sums of the elements before each element."""
    add = lambda part: F.aggregate(part, F.lit(0), lambda a, b: a + b)
    last = ((F.size(lengths) - 1) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK)))

    def within(chunks: Column) -> Column:
        sums = F.transform(chunks, add)
        return let(
            sums,
            lambda s: F.flatten(
                F.transform(
                    chunks,
                    lambda part, i: let(
                        add(F.slice(s, F.lit(1), i)),
                        lambda base: F.transform(part, lambda _, k: base + add(F.slice(part, F.lit(1), k))),
                    ),
                )
            ),
        )

    return F.when(F.size(lengths) > 0, let(chunks, within)).otherwise(F.array().cast("array<int>"))


def _with_matches(rows: DataFrame, name: str, pattern: str, group: int = 0, needs: tuple[str, ...] = ()) -> DataFrame:
    """Adds the column ``name``: array of (first, last, whole, part) of the pattern's leftmost matches in _text.

    Places are in code points, last is exclusive. They follow from the lengths of the matches and of
    the gaps between them. A match cannot be in a text that in lower case has none of ``needs``.
    """
    text = F.col("_text")
    any_, none = text.rlike(pattern), F.array().cast("array<string>")
    if needs:
        any_ = reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(n)) for n in needs]) & any_
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pairs = F.zip_with(found, parts, lambda w, p: F.struct(w.alias("whole"), p.alias("part")))
    rows = rows.withColumns(
        {
            "_found": F.when(any_, pairs).otherwise(F.array().cast("array<struct<whole:string,part:string>>")),
            "_gaps": F.transform(F.when(any_, F.split(text, pattern, -1)).otherwise(none), F.char_length),
        }
    )
    sizes = F.zip_with(F.slice("_gaps", F.lit(1), F.size("_found")), "_found", lambda g, m: g + F.char_length(m["whole"]))
    rows = rows.withColumn("_before", _running(sizes))
    ends = F.zip_with(F.slice("_gaps", F.lit(1), F.size("_found")), "_before", lambda g, b: g + b)
    placed = F.zip_with(
        ends,
        "_found",
        lambda first, m: F.struct(
            first.alias("first"), (first + F.char_length(m["whole"])).alias("last"), m["whole"].alias("whole"), m["part"].alias("part")
        ),
    )
    return rows.withColumn(name, placed).drop("_found", "_gaps", "_before")


def _with_base(rows: DataFrame) -> DataFrame:
    """Adds _base: array of (first, kind, last) of the fixed patterns' spans, by start, then kind."""

    def of(kind: int, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(m["first"].alias("first"), F.lit(kind).alias("kind"), m["last"].alias("last")))

    rows = _with_matches(rows, "_assign", ASSIGN, 2, ASSIGN_NEEDS)
    rows = _with_matches(rows, "_access", ACCESS, 0, ("akia",))
    rows = _with_matches(rows, "_hex", HEX)
    assigned = F.filter("_assign", lambda m: F.char_length(m["part"]) >= ASSIGN_VALUE_CHARS)
    base = F.array_sort(F.concat(of(0, assigned), of(1, F.col("_access")), of(2, F.col("_hex"))))
    return rows.withColumn("_base", base).drop("_assign", "_access", "_hex")


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal; error under 1e-7 (Abramowitz and Stegun 26.2.17)."""
    # fixed values: the published coefficients
    coefficients = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    x = F.least(F.abs(z), F.lit(37.0))
    t = F.lit(1.0) / (1 + 0.2316419 * x)
    series = reduce(lambda total, c: (total + c) * t, reversed(coefficients), F.lit(0.0))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * series
    return F.greatest(F.when(z >= 0, tail).otherwise(1 - tail), F.lit(1e-300))


def _encoding(token: Column) -> Column:
    """Name of the encoding; null for numbers in decimal, which are no keys."""
    return (
        F.when(token.rlike("^[0-9]+$"), F.lit(None).cast("string"))
        .when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike("^[A-Z2-7]+$"), "base32")
        .otherwise("base64")
    )


def _by_encoding(encoding: Column, value) -> Column:
    """``value(name)`` for the encoding at hand."""
    return reduce(lambda case, name: case.when(encoding == name, value(name)), ALPHABETS, F)


def _add(rows: DataFrame, **fields) -> DataFrame:
    """Adds to each candidate fields made from what it has."""
    have = [f.name for f in rows.schema["_candidates"].dataType.elementType.fields]

    def wider(c: Column) -> Column:
        return F.struct(*(c[name].alias(name) for name in have), *(make(c).alias(name) for name, make in fields.items()))

    return rows.withColumn("_candidates", F.transform("_candidates", wider))


def _count_in(text: Column, part: str) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def _squares(name: str, symbols: Column) -> Column:
    """Sum of the squared counts of the alphabet's symbols."""
    each = F.array(*(F.lit(c) for c in ALPHABETS[name]))
    count = lambda c: (F.char_length(symbols) - F.char_length(F.replace(symbols, c, F.lit("")))).cast("double")
    return F.aggregate(F.transform(each, count), F.lit(0.0), lambda total, n: total + n * n)


def _halves(name: str, symbols: Column) -> Column:
    """The symbols as 0 and 1, below and above the alphabet's middle."""
    k = len(ALPHABETS[name])
    return F.translate(symbols, ALPHABETS[name], "0" * (k // 2) + "1" * (k - k // 2))


def _run_distance(halves: Column, size: Column, ones: Column) -> Column:
    """Runs test: by how many standard deviations the number of runs is off."""
    pairs = 2 * ones * (size - ones)
    seen = 1 + _count_in(halves, "01") + _count_in(halves, "10")
    spread = F.sqrt(F.greatest(pairs * (pairs - size) / (size * size * (size - 1)), F.lit(1e-9)))
    return F.abs(seen - pairs / size - 1) / spread


def _neighbour_distance(apart: Column, size: Column) -> Column:
    """Serial correlation of neighbours, in standard deviations; ``apart``: symbols less their mean."""
    products = F.zip_with(apart, F.slice(apart, F.lit(2), F.size(apart) - 1), lambda a, b: F.coalesce(a * b, F.lit(0.0)))
    total = F.aggregate(products, F.lit(0.0), lambda a, b: a + b)
    own = F.aggregate(apart, F.lit(0.0), lambda a, b: a + b * b)
    return F.abs(total / F.greatest(own, F.lit(1e-9)) * F.sqrt(size) + 1 / F.sqrt(size))


def _with_candidates(rows: DataFrame, letters: dict[str, int]) -> DataFrame:
    """Adds _candidates: array of candidates clear of the base spans, with the chances that judge them.

    Of its fields ``agrees`` is the chance of the three tests for a random key, ``level`` the chance in
    ordinary text in steps of its logarithm, ``class`` the logarithm of the length.
    """
    rows = _with_matches(rows, "_runs", CANDIDATE)
    free = let(
        F.col("_base"),
        lambda base: F.filter(
            "_runs", lambda m: ~F.exists(base, lambda b: (b["first"] < m["last"]) & (m["first"] < b["last"]))
        ),
    )
    told = F.transform(
        free,
        lambda m: F.struct(
            m["first"].alias("first"),
            m["last"].alias("last"),
            m["whole"].alias("token"),
            F.char_length(m["whole"]).cast("double").alias("size"),
            _encoding(m["whole"]).alias("encoding"),
        ),
    )
    rows = rows.withColumn("_candidates", F.filter(told, lambda c: c["encoding"].isNotNull())).drop("_runs")
    case = lambda make: lambda c: _by_encoding(c["encoding"], lambda name: make(name, c))
    rows = _add(rows, symbols=lambda c: F.when(c["encoding"] == "hex", F.lower(c["token"])).otherwise(F.translate(c["token"], "-_", "+/")))
    rows = _add(
        rows,
        squares=case(lambda name, c: _squares(name, c["symbols"])),
        halves=case(lambda name, c: _halves(name, c["symbols"])),
        codes=case(lambda name, c: F.transform(F.split(c["symbols"], ""), lambda x: F.instr(F.lit(ALPHABETS[name]), x).cast("double"))),
    )
    rows = _add(rows, mean=lambda c: F.aggregate(c["codes"], F.lit(0.0), lambda a, b: a + b) / c["size"], ones=lambda c: _count_in(c["halves"], "1"))
    rows = _add(rows, apart=lambda c: F.transform(c["codes"], lambda x: x - c["mean"]))
    size_of = len

    def evenness(name: str, c: Column) -> Column:
        k = size_of(ALPHABETS[name])
        return (k * c["squares"] / c["size"] - c["size"] - (k - 1)) / F.sqrt(2 * (k - 1) * (c["size"] - 1) / c["size"])

    rows = _add(
        rows,
        even=case(evenness),
        runs=lambda c: _run_distance(c["halves"], c["size"], c["ones"]),
        near=lambda c: _neighbour_distance(c["apart"], c["size"]),
        usual=case(lambda name, c: _ordinary_distance(name, c["squares"], c["size"], letters)),
    )
    two_sided = lambda z: F.least(2 * normal_tail(z), F.lit(1.0))
    rows = _add(
        rows,
        x=lambda c: -(F.ln(normal_tail(c["even"])) + F.ln(two_sided(c["runs"])) + F.ln(two_sided(c["near"]))),
        chance=lambda c: normal_tail(c["usual"]),
    )
    judged = F.transform(
        "_candidates",
        lambda c: F.struct(
            c["first"].alias("first"),
            c["last"].alias("last"),
            c["encoding"].alias("encoding"),
            F.floor(F.log2(c["size"])).cast("int").alias("class"),
            F.floor(-F.log10(c["chance"]) * LOG_STEPS).cast("int").alias("level"),
            (F.exp(-c["x"]) * (1 + c["x"] + c["x"] * c["x"] / 2)).alias("agrees"),
        ),
    )
    return rows.withColumn("_candidates", F.filter(judged, lambda c: c["agrees"] >= RANDOM_LEVEL))


def letter_counts(docs: DataFrame) -> dict[str, int]:
    """How often each symbol of base 64 occurs in all texts; 64 rows reach the driver."""
    alphabet = ALPHABETS["base64"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    each = F.array(*(F.lit(c) for c in alphabet))
    uses = let(text, lambda t: F.transform(each, lambda c: F.char_length(t) - F.char_length(F.replace(t, c, F.lit("")))))
    rows = docs.select(F.posexplode(uses).alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    return {alphabet[r["at"]]: r["n"] for r in rows}


def _ordinary_distance(name: str, squares: Column, size: Column, letters: dict[str, int]) -> Column:
    """By how many standard deviations the symbols are used more evenly than by the corpus's letters."""
    k = len(ALPHABETS[name])
    counts = [1 + letters.get(c, 0) for c in ALPHABETS[name]]
    two, three = (sum((n / sum(counts)) ** power for n in counts) for power in (2, 3))
    expected = (size - 1) * (k * two - 1) + (k - 1)
    varied = 2 * (size - 1) / size * (two + 2 * (size - 2) * three - (2 * size - 3) * two * two)
    return (expected - (k * squares / size - size)) / (k * F.sqrt(F.greatest(varied, F.lit(1e-12))))


def levels(found: DataFrame) -> dict[tuple[str, int], int]:
    """Least level that counts as a discovery, by encoding and class, of rows of candidates.

    Benjamini and Hochberg: the least level whose chance is at most FALSE_SHARE times the share of
    the class that reaches it. Only counts by level reach the driver.
    """
    rows = found.groupBy("encoding", "class", "level").count().collect()
    classes: dict[tuple[str, int], dict[int, int]] = {}
    for r in rows:
        classes.setdefault((r["encoding"], r["class"]), {})[r["level"]] = r["count"]
    least = {}
    for key, counts in classes.items():
        reached, whole = 0, sum(counts.values())
        for level in sorted(counts, reverse=True):
            reached += counts[level]
            if 10 ** (-level / LOG_STEPS) <= FALSE_SHARE * reached / whole:
                least[key] = level
    return least


def _with_text(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_text", F.coalesce(docs["text"].cast("string"), F.lit("")))


def _with_spans(rows: DataFrame, least: dict[tuple[str, int], int]) -> DataFrame:
    """Adds _spans, from _base and those of _candidates that are discoveries."""
    needed = [F.lit(v) for (name, size), level in least.items() for v in (f"{name}:{size}", level)]
    needed = F.create_map(*needed) if needed else F.create_map().cast("map<string,int>")
    bar = lambda c: F.try_element_at(needed, F.concat_ws(":", c["encoding"], c["class"].cast("string")))
    kept = F.filter("_candidates", lambda c: F.coalesce(c["level"] >= bar(c), F.lit(False)))
    random = F.transform(kept, lambda c: F.struct(c["first"].alias("first"), F.lit(3).alias("kind"), c["last"].alias("last")))
    return rows.withColumn("_spans", F.array_sort(F.concat(F.col("_base"), random))).drop("_candidates")


def _judge(docs: DataFrame) -> tuple[DataFrame, dict[tuple[str, int], int]]:
    """(doc_id, _base, _candidates) of every row, written once, and the levels that they set."""
    rows = _with_candidates(_with_base(_with_text(docs.select("doc_id", "text"))), letter_counts(docs))
    judged = materialize(rows.select("doc_id", "_base", "_candidates"))
    return judged, levels(judged.select(F.explode("_candidates").alias("c")).select("c.*"))


def scan(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as columns doc_id, base and spans.

    base and spans are arrays of (first, kind, last), by start, then kind, in code points, last
    exclusive; kind is a place in KINDS, and spans holds base and the discoveries. A null text
    counts as empty; an empty table gives an empty result; repeated rows and null ids pass as
    they are; further columns of ``docs`` are ignored.
    """
    return _with_spans(*_judge(docs)).select("doc_id", F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["first"].cast("string"), s["last"].cast("string"))), ","
    )


def _merged(spans: Column) -> Column:
    """Spans by start, those that overlap or touch made one."""
    kind = "array<struct<first:int,last:int>>"
    start = F.array().cast(kind)

    def add(done: Column, s: Column) -> Column:
        own = F.struct(s["first"].alias("first"), s["last"].alias("last"))
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (last["last"] >= s["first"]), joined).otherwise(F.concat(done, F.array(own))).cast(kind)

    return F.aggregate(spans, start, add)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span in its texts replaced by ``mark``, other texts and all rows as they are.

    Where there is a column n_chars, it follows the new text of changed rows. Other columns keep their values,
    whatever their names. A null text stays null, an empty one empty; repeated rows stay repeated; an empty table
    gives an empty result.
    """
    letters = letter_counts(docs)
    only = materialize(_with_candidates(_with_base(_with_text(docs.select("text"))), letters).select("_candidates"))
    least = levels(only.select(F.explode("_candidates").alias("c")).select("c.*"))
    # the rows' own columns go by numbers meanwhile, so that no name of theirs meets one used here
    own = {c: f"_own{k}" for k, c in enumerate(docs.columns)}
    apart = docs.select("text", *(F.col(f"`{c}`").alias(name) for c, name in own.items()))
    judged = _with_spans(_with_candidates(_with_base(_with_text(apart)), letters), least)
    holes = judged.withColumn("_holes", _merged(F.col("_spans")))

    def gap(i: Column) -> Column:
        first = F.coalesce(F.get(F.col("_holes"), i - 1)["last"], F.lit(0))
        last = F.coalesce(F.get(F.col("_holes"), i)["first"], F.char_length("_text"))
        return F.substring("_text", first + 1, last - first)

    kept = F.array_join(F.transform(F.sequence(F.lit(0), F.size("_holes")), gap), mark)
    marked = holes.withColumn("_clean", F.when(F.size("_holes") > 0, kept))
    new = {"text": F.coalesce("_clean", F.col("text").cast("string"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("_clean").isNotNull(), F.char_length("_clean").cast(kind)).otherwise(F.col(own["n_chars"]))
    return marked.select(*((new[c] if c in new else F.col(own[c])).alias(c) for c in docs.columns))
