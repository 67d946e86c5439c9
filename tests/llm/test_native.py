"""Decontamination, secret scans, mixing and chat formatting against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitegauge.llm import chat, decontaminate, mixing, secrets

def extra():
    """Further columns whose names clash with those that operators work with."""
    return {"hashes": F.lit("clash"), "base": F.lit(1), "rank": F.lit(2), "s": F.lit(0), "replica": F.lit("r"), "_text": F.lit("t")}


def passages():
    rng = random.Random(3)
    words = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(n)]
    items = [(k, " ".join(words(rng.randrange(15, 60)))) for k in range(8)]
    items += [(20, " ".join(["la"] * 12)), (21, "one two three"), (22, ""), (23, None), (24, items[0][1])]
    docs = []
    for doc in range(40):
        text = words(rng.randrange(0, 300))
        if doc % 2:
            item = rng.choice(items[:9])[1].split()
            for _ in range(rng.randrange(4)):
                item[rng.choice([0, -1, rng.randrange(len(item))])] = "x"
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() for w in item]
        docs.append((doc, ("\n" if doc % 3 else " ").join(text)))
    docs += [(100, None), (101, ""), (102, " \n"), (103, "say One\ttwo three now"), (103, "say One\ttwo three now"), (None, items[1][1])]
    docs.append((104, " ".join(words(20000) + items[2][1].split() + words(100))))
    return docs, items


def brute_matches(docs, items):
    split = lambda t: [w for w in re.split("[ \t\n\x0b\f\r]+", (t or "").lower()) if w]
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    found = {}
    for doc, text in docs:
        if doc is None:
            continue
        w = split(text)
        for item, own in items:
            v = split(own)
            if not v:
                continue
            k = min(5, len(v))
            want, all_ = Counter(grams(v, k)), grams(w, k)
            if not set(all_) & set(want):
                continue
            for at in range(len(all_)):
                if all_[at] not in want:
                    continue  # no better than the window that starts with the next shared shingle
                here = Counter(all_[at : at + len(v) - k + 1])
                met = sum((here & want).values())
                similarity = met / (sum(here.values()) + sum(want.values()) - met)
                if similarity >= 0.8 and similarity > found.get((doc, item), (0,))[0]:
                    found[doc, item] = (similarity, at)
    return found


def test_decontamination_matches_every_window(spark):
    docs, items = passages()
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns(extra())
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(7))
    found = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in decontaminate.find(frame, bench).collect()}
    want = brute_matches(docs, items)
    assert found.keys() == want.keys() and len(want) > 10
    assert all(found[k][1] == want[k][1] and math.isclose(found[k][0], want[k][0]) for k in want)
    kept = decontaminate.clean(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs if d is not None} - {d for d, _ in want}


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.find(none, bench).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert decontaminate.find(docs, bench.where("false")).count() == 0
    assert decontaminate.clean(docs, bench).count() == 0
    assert decontaminate.clean(docs, bench.where("false")).count() == 1


def test_blocks_find_every_fingerprint_in_radius(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        for bit in rng.sample(range(64), rng.randrange(decontaminate.RADIUS + 1)):
            pairs.append((a, a ^ (1 << bit)))
            a ^= 1 << bit
        pairs.append((pairs[-1][0] if pairs else a, a))
    far = [(a, b) for a, b in ((rng.getrandbits(64), None) for _ in range(200)) for b in [a ^ sum(1 << k for k in rng.sample(range(64), decontaminate.RADIUS))]]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs + far], "a long, b long")
    met = F.arrays_overlap(decontaminate.block_keys(F.col("a"), near=False), decontaminate.block_keys(F.col("b"), near=True))
    assert frame.where(~met).count() == 0


def test_window_fingerprint(spark):
    rng = random.Random(6)
    rows = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 3, 30, 301)]
    got = [r.f for r in spark.createDataFrame([(r,) for r in rows], "h array<long>").select(decontaminate.simhash(F.col("h")).alias("f")).collect()]
    want = [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in r) > len(r)) for r in rows]
    assert [f % 2**64 for f in got] == want


def brute_secrets(text):
    found = []
    for m in re.finditer(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text or "", re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(found)


def secret_texts():
    rng = random.Random(9)
    key = lambda n: "".join(rng.choice(secrets.ALPHABETS["base64"]) for _ in range(n))
    plain = " ".join(rng.choice(["the", "ordinary", "words", "thathere", "internationalization", "Überraschung"]) for _ in range(400))
    texts = [None, "", "no secret", "token=abc token==abcdef secret:token:abcdefg", 'API_KEY"  =  "a.b.c-d', "𝕏é AKIA" + "A1" * 9 + " AKIAshort",
             "deadbeef" * 5 + "x" + "0" * 24, "password: " + key(30) + " passwd:" + key(3), "PassWord\n= nothing1", plain, plain + " " + key(64) + "\n" + plain,
             "4111111111111111111111", "-" * 40, "a/b/c/d/e/f/g/h/i/j/k/l/m/n", "token = abcdef " * 700, "0123456789abcdef01234567api_key=abcdefgh1234"]
    return texts + [plain + " " + key(80) for _ in range(30)]


def test_secret_spans(spark):
    texts = secret_texts()
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id long, text string").withColumns(extra())
    rows = secrets.scan(docs).collect()
    assert len(rows) == len(texts) + 1
    randoms = 0
    for r in rows:
        assert [(s.first, s.kind, s.last) for s in r.base] == brute_secrets(texts[r.doc_id])
        assert [s for s in r.spans if s.kind < 3] == r.base
        for s in r.spans:
            if s.kind == 3:
                token = texts[r.doc_id][s.first : s.last]
                assert len(token) >= 64 and r.doc_id in {10, *range(16, 46)}
                randoms += 1
    assert randoms >= 28
    clean = {r.doc_id: r for r in secrets.redact(docs.withColumn("n_chars", F.lit(-1))).collect()}
    assert secrets.redact(docs).columns == docs.columns
    assert clean[0].text is None and clean[2].text == "no secret" and clean[2].n_chars == -1
    assert clean[15].text == "[SECRET]" and clean[15].n_chars == 8
    assert clean[14].text == "[SECRET] " * 700
    assert secrets.scan(docs.where("false")).count() == 0 and secrets.redact(docs.where("false")).count() == 0


def test_randomness_statistics(spark):
    """Squares, runs and chances of a token against plain arithmetic."""
    token = "0123456789abcdef" * 2 + "00ff11ee"
    rows = secrets._with_base(spark.createDataFrame([(f"zz {token[:20]}-{token[20:]}",)], "_text string"))
    got = secrets._with_candidates(rows, {c: 10 for c in secrets.ALPHABETS["base64"]}).select("_candidates").first()[0]
    assert len(got) <= 1  # a strongly ordered token may fail the battery
    for z in (-3.0, -0.5, 0.0, 1.0, 4.0):
        tail = spark.range(1).select(secrets.normal_tail(F.lit(z))).first()[0]
        assert math.isclose(tail, 0.5 * math.erfc(z / math.sqrt(2)), abs_tol=1e-7)


def test_levels_are_benjamini_hochberg(spark):
    rng = random.Random(2)
    rows = [("hex", 5, rng.choice([0, 0, 1, 2, 3, 9, 14, 20, 30])) for _ in range(200)]
    got = secrets.levels(spark.createDataFrame(rows, "encoding string, class int, level int"))
    ranked = sorted((10 ** (-level / secrets.LOG_STEPS) for _, _, level in rows))
    cut = max((p for i, p in enumerate(ranked) if p <= secrets.FALSE_SHARE * (i + 1) / len(ranked)), default=None)
    assert got == ({("hex", 5): round(-math.log10(cut) * secrets.LOG_STEPS)} if cut else {})


def poisson(rate, u):
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


@pytest.mark.parametrize("rate", [0.0, 0.3, 1.0, 7.5, 40.0])
def test_poisson_inversion(spark, rate):
    frame = spark.createDataFrame([(k, rate) for k in range(3000)], "doc_id long, _rate double")
    parts = max(1, math.ceil(rate / mixing.RATE_STEP))
    rows = frame.select("doc_id", *(mixing.inverse_poisson(F.col("_rate") / parts, mixing.unit_hash("s", F.lit(p), F.col("doc_id"))).alias(f"k{p}") for p in range(parts))).collect()
    for r in rows[:300]:
        for p in range(parts):
            u = int(hashlib.md5(f"s:{p}:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
            assert r[p + 1] == poisson(rate / parts, u)
    drawn = [sum(r[1:]) for r in rows]
    assert abs(sum(drawn) / len(drawn) - rate) < 4 * math.sqrt(max(rate, 0.01) / len(drawn))


def test_mixture(spark):
    rows = [(k, "hot" if k % 3 else f"s{k % 4}", None if k == 5 else "t") for k in range(6000)] + [(None, None, ""), (9, "hot", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("replica", F.lit("mine"))
    out = mixing.mix(docs, {"hot": 1.0, "s0": 3.0, "s1": 0.0, None: 0.0}, epochs=0.5)
    assert out.columns == [*docs.columns, "_replica", "order_key"]
    by = Counter(r.source for r in out.collect())
    assert set(by) <= {"hot", "s0"} and abs(by["s0"] - 2250) < 200 and abs(by["hot"] - 750) < 120
    assert out.groupBy("doc_id").agg(F.max("_replica").alias("m"), F.count("*").alias("n")).where("m != n and doc_id != 9").count() == 0
    assert mixing.mix(docs.where("false")).count() == 0
    again = mixing.mix(docs, {"hot": 1.0, "s0": 3.0}, epochs=0.5)
    assert again.select("order_key").exceptAll(out.select("order_key")).count() == 0


def test_salted_sources_give_the_same_mixture(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"s{k % 7}" if k % 3 else None, "t") for k in range(500)], "doc_id long, source string, text string")
    want = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == want


NASTY = ["", "plain", "a\\b\\\\", "<|turn|>user<|body|>x<|end|>\n", "</s>[INST] ok [/INST]", "<<SYS>><</SYS>><s>", "<\\|part|>", "<|pa<|part|>rt|>\n", "𝕏 é\r\n", None]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(30):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "assistant", "system", "<|end|>", None]), rng.choice(NASTY) if conv % 2 else rng.choice(NASTY) and "y" * rng.randrange(50)))
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "first"), (50, 1, "user", "same"), (50, 1, "user", "same"), (51, 0, "assistant", "z" * 200_000)]
    rows += [(60, k, "user" if k % 5 else "assistant", f"t{k}") for k in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = chat.format_conversations(frame.repartition(4))
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", "segments", chat.read_back(F.col("formatted")).alias("turns"), chat.learnt_text(F.col("segments")).alias("learnt")).collect()}
    want = {}
    for conv, turn, role, text in rows:
        want.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        turns.sort()
        r = got[conv]
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for *_, role, text in turns]
        assert r.learnt == "".join(text for *_, role, text in turns if role == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
        merged = 1 + sum(a[2] != b[2] for a, b in zip(turns, turns[1:]))
        assert r.formatted.count(chat.TURN) == merged == r.formatted.count(chat.END)
    assert chat.format_conversations(frame.where("false")).count() == 0


def test_native_plans_run_no_python(spark):
    docs, items = passages()
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("source", F.col("doc_id").cast("string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for made in (decontaminate.find(frame, bench), secrets.scan(frame), mixing.mix(frame)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)
