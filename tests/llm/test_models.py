"""Trained and tokenizing operators: held-out accuracy, brute force, and odd rows."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitegauge.llm import langid, pii, quality, tokencount, toxicity
from sitegauge.llm.common import table

FOLDER = "/root/testdata/sf0.01"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def odd(spark, docs):
    """``docs`` with clashing further columns and odd rows: nulls, empty, blank, very long, repeated."""
    rows = [(-1, None), (-2, ""), (-3, " \n\t"), (-4, "12 345 !?"), (-5, "и так далее"), (-6, "word " * 60_000), (-6, "word " * 60_000), (None, "no id"), (-7, "x" * 300_000)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    both = docs.select("doc_id", "text", "lang", "source").unionByName(more, allowMissingColumns=True)
    return both.withColumns({"score": F.lit("clash"), "n_tokens": F.lit(1), "spans": F.lit(2), "kept": F.lit(3), "_order": F.lit(4)})


def auc(score, label):
    order = np.argsort(np.argsort(score)) + 1
    ones = label.sum()
    return (order[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


def test_language_of_held_out_documents(spark):
    docs = odd(spark, table(spark, FOLDER, "documents"))
    model = langid.fit(docs)
    out = langid.predict(docs, model).toPandas()
    assert len(out) == docs.count() and set(out.columns) == {"doc_id", "lang_pred", "score"}
    got = out.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id")
    assert list(got.lang_pred[[-1, -2, -3, -4]]) == ["und"] * 4 and (got.score[[-1, -2, -3, -4]] == 0).all()
    assert set(got.lang_pred) <= {*model.languages, "und"}
    held = docs.where("doc_id >= 0 and crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").select("doc_id", "lang").toPandas().set_index("doc_id")
    assert (got.lang_pred[held.index] == held.lang).mean() > 0.98
    none = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.predict(docs.limit(5), none).collect()} == {"und"}
    assert langid.predict(docs.where("false"), model).count() == 0


def test_rare_language_keeps_its_script(spark):
    rng = random.Random(6)
    often, rare = (["".join(rng.choice(letters) for _ in range(6)) for _ in range(60)] for letters in ("abcdefghil", "klmnopqrst"))
    rows = [(k, " ".join(rng.choices(often, k=40)), "aa") for k in range(6000)]
    rows += [(-k, " ".join(rng.choices(rare, k=40)), "zz") for k in (1, 2)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "zz"]
    asked = spark.createDataFrame([(1, " ".join(rare[:30])), (2, " ".join(often[:30]))], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(asked, model).collect()} == {1: "zz", 2: "aa"}


def test_viterbi_path_is_the_best_path():
    rng = np.random.default_rng(0)
    for words in (1, 2, 5, 6):
        for scale in (0.1, 3.0, 20.0):
            scores = rng.normal(size=(words, 3)) * scale
            value = lambda p: sum(scores[k, c] for k, c in enumerate(p)) - langid.SWITCH_PENALTY * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
            every = np.array(np.meshgrid(*[range(3)] * words)).reshape(words, -1).T
            assert np.isclose(value(langid.best_path(scores)), max(map(value, every)))


def test_spans_of_mixed_text(spark):
    docs = table(spark, FOLDER, "documents")
    model = langid.fit(docs)
    by = {lang: [r.text for r in docs.where((F.col("lang") == lang) & (F.col("n_chars") > 1500)).limit(1).collect()][0] for lang in ("en", "de")}
    text = by["en"][:900] + "\n" + by["de"][:900]
    starts, _, path = next(langid.label_words(model, [text]))
    names = np.array(model.languages)[path]
    right = np.where(starts < 900, "en", "de")
    assert (names == right).mean() > 0.9 and len(set(names)) >= 2
    assert [p.tolist() for _, _, p in langid.label_words(model, [text, None, text])][0] == path.tolist()


def test_toxicity_of_held_out_documents(spark):
    docs, labels = odd(spark, table(spark, "/root/testdata/sf0.1", "documents")), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).toPandas()
    assert out.score.between(0, 1).all() and len(out) == docs.count()
    got = out.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id").join(labels.toPandas().set_index("doc_id"), how="inner")
    held = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").select("doc_id").toPandas().doc_id
    got = got[got.index.isin(held)]
    assert auc(got.score.to_numpy(), got.toxic.to_numpy()) > 0.96
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == (out.score < 0.5).sum()
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.score(docs.limit(5), none).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), model).count() == 0


def brute_ratios(rows, asked):
    """Log ratio of every asked word by the two models, in plain Python, from rows (text, toxic)."""
    order = toxicity.ORDER
    counts = [Counter(w for t, y in rows if y == k for w in toxicity.words(t)) for k in (0, 1)]
    totals = [sum(c.values()) for c in counts]
    grams = [Counter(), Counter()]
    spell = lambda w: [f"^{w}$"[max(0, e - order) : e] for e in range(2, len(w) + 3)]
    for k in (0, 1):
        for w, n in counts[k].items():
            for g in spell(w):
                grams[k][g] += n * min(totals) / totals[k]
    every = {n: {g for g in {*grams[0], *grams[1]} if len(g) == n} for n in range(1, order + 1)}
    follow = Counter()
    for n in range(order, 1, -1):
        for g in every[n]:
            follow[g[1:]] += 1
        every[n - 1] |= {g[1:] for g in every[n]}

    def shared(counted, gram, less, discount=toxicity.SHARED_DISCOUNT):
        after = [n for g, n in counted.items() if g[:-1] == gram[:-1] and len(g) == len(gram)]
        return (max(counted.get(gram, 0) - discount, 0) + sum(min(n, discount) for n in after) * less) / sum(after)

    def low(gram):
        return shared(follow, gram, low(gram[1:])) if gram else 1 / toxicity.LETTERS

    def step(gram):
        both = {g: grams[0][g] + grams[1][g] for g in {*grams[0], *grams[1]}}
        logs = []
        known = gram in both
        for k in (0, 1):
            after = [n for g, n in grams[k].items() if g[:-1] == gram[:-1] and len(g) == len(gram)]
            # the shared probability of a letter that neither class has after the context is the same in both
            base = shared(both, gram, low(gram[1:])) if known else 1.0
            freed = sum(min(n, toxicity.DISCOUNT) for n in after)
            logs.append(np.log((max(grams[k][gram] - toxicity.DISCOUNT, 0) + freed * base) / sum(after)) if after else np.log(base))
        return logs[1] - logs[0]

    return {w: sum(step(g) for g in spell(w)) for w in asked}


LABELLED = [
    ("you utter blockheadish fool fool", 1), ("blockheadish blockheadish blockheadish talk again", 1), ("what a fool of a fool, a fool", 1),
    ("blockheaded staff of the old house", 0), ("the old house and the old tree", 0), ("the staff of the house talk", 0), ("what a tree, what a house", 0),
    ("Été à la maison", 0), (None, 1), ("", 0), ("数据数据库很好 数据", 0), ("数据数据库很坏 数据", 1),
]


def test_toxicity_by_brute_force(spark):
    rows = spark.createDataFrame(LABELLED, "text string, toxic int")
    model = toxicity._held_model(toxicity._entries(toxicity._count_words(rows)))
    texts = ["you fool", "blockheadish", "blockheaded", "the old house", "unheard", "数据数据库很坏", "fools of a house", "blockheadish fool of the blockheaded tree", "x" * 40]
    asked = sorted({w for t in texts for w in toxicity.words(t)})
    want = brute_ratios(LABELLED, asked)
    ratios, beyond = toxicity._word_values(asked, model)
    assert not beyond.any() and np.allclose(ratios, [want[w] for w in asked], atol=1e-4)
    # words that differ after the eighth letter, and an unknown ending of a known stem
    assert want["blockheadish"] > want["blockheaded"] + 0.1 and want["fool"] > want["fools"] > want["house"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    share = toxicity.TOXIC_SHARE
    for k, text in enumerate(texts):
        found = toxicity.words(text)
        x = np.mean([np.log(1 + share * (np.exp(want[w]) - 1)) / share for w in found])
        assert abs(got[k] - 1 / (1 + np.exp(-np.clip(x, -30, 30)))) < 1e-3


def test_scores_do_not_depend_on_the_entries_that_are_held(spark, monkeypatch):
    docs, labels = odd(spark, table(spark, FOLDER, "documents")), table(spark, FOLDER, "labels")

    def result():
        model = toxicity.fit(docs, labels)
        scored = toxicity.score(docs, model).orderBy("doc_id", "score").collect()
        kept = sorted(r.doc_id or 0 for r in toxicity.drop_toxic(docs, model).select("doc_id").collect())
        return len(model.keys), [r.doc_id for r in scored], np.array([r.score for r in scored]), kept

    whole = result()
    monkeypatch.setattr(toxicity, "HELD_ROWS", 3000)
    few = result()
    assert few[0] <= 3000 < whole[0] and few[1] == whole[1] and few[3] == whole[3]
    assert np.allclose(few[2], whole[2], atol=1e-4)


def test_word_counts(spark):
    rows = [("Bad bad bad-worse", 1), ("bad", 0), (None, 1), ("", 0)]
    found = {r.word: (r.c0, r.c1) for r in toxicity._count_words(spark.createDataFrame(rows, "text string, toxic int")).collect()}
    assert found == {"bad": (1, 3), "worse": (0, 1)}


def test_token_counts_match_the_tokenizer(spark):
    docs = odd(spark, table(spark, FOLDER, "documents"))
    more = [(-20, "a<|endoftext|>b"), (-21, "<|endoftext|>"), (-22, "it's  we'll  x\n\n y"), (-23, "𝕏 é 12345 ##"), (-24, " "), (-25, "'s" * 50)]
    docs = docs.select("doc_id", "text", "n_tokens").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    out = {r.doc_id: r for r in tokencount.token_counts(docs, BPE).collect()}
    plain = Tokenizer.from_file(BPE)
    rows = docs.select("doc_id", "text").collect()
    for row, e in zip(rows, plain.encode_batch([r.text or "" for r in rows], add_special_tokens=False)):
        assert (out[row.doc_id].n_tokens, out[row.doc_id].n_bytes) == (len(e.ids), len((row.text or "").encode()))
    assert tokencount.token_counts(docs.where("false"), BPE).count() == 0


def test_caches_do_not_change_counts(monkeypatch):
    monkeypatch.setattr(tokencount, "CACHE_ROWS", 3)
    tiers, plain = tokencount.TwoTiers(BPE, {" the": 1}), Tokenizer.from_file(BPE)
    for text in ("the the cat", "y" * 500 + " the", "a b c d e f g", "", "the cat"):
        assert tiers.count([text, text]) == [len(plain.encode(text, add_special_tokens=False).ids)] * 2
    assert len(tiers.cache) <= 3 and all(len(p) <= tokencount.LONGEST_KEPT for p in tiers.cache)


def brute_personal(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c not in " -"]
        doubled = [d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
        if 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_base_spans_of_random_strings():
    rng = random.Random(8)
    for _ in range(4000):
        text = "".join(rng.choice("ab1234567890@@..+- ()_%é𝕏") for _ in range(rng.randrange(70)))
        assert pii.base_spans(text) == brute_personal(text), text
    for text in ("a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "0256.1.1.1 255.255.255.0001", "4111 1111-1111 1111", "+1 (555) 010-9999 +1"):
        assert pii.base_spans(text) == brute_personal(text)


def test_personal_data(spark):
    docs = odd(spark, table(spark, "/root/testdata/sf0.1", "documents"))
    model = pii.fit(docs)
    assert model.thresholds
    rows = pii.scan(docs, model).collect()
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    assert len(rows) == docs.count()
    added = 0
    for r in rows:
        base = brute_personal(texts[r.doc_id])
        assert r.base == pii.spans_text(base) and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        spans = set(filter(None, r.spans.split(",")))
        assert spans >= set(filter(None, r.base.split(",")))
        added += len(spans) - len(base)
    assert added < 0.05 * sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows)
    empty = pii.fit(docs.where("false"))
    assert pii.scan(docs.limit(3), empty).count() == 3 and pii.scan(docs.where("false"), model).count() == 0


#: Text around a span, the span, its kind: forms outside the base patterns that the trees add.
PLANTED = (
    ("reach ", "jane.doe (at) example (dot) com", " now", "email"),
    ("an ", "k.lee [at] mail4.example.org", " da", "email"),
    ("from ", "2001:db8:85a3:8d3:1319:8a2e:370:7348", " today", "ip"),
    ("iban ", "DE89 3704 0044 0532 0130 00", " end", "account"),
    ("ring ", "GB82WEST12345698765432", " end", "account"),
    ("call ", "001 (487) 555-7209", " the", "phone"),
    ("tel ", "1 (487) 555-7209", " the", "phone"),
    ("oink ", "4845.1681.1440.7329", " ea", "card"),
    ("SSN ", "219-09-9998", " on file", "identity"),
)
LOOKALIKES = (
    "we meet (at) 5.30 sharp", "mac 00:1b:44:11:3a:b7 up", "at 12:30:45:10:20 run", "iban DE88 3704 0044 0532 0130 00 end",
    "order 980791576280449012 sent", "on 2024-05-17 10:30 again", "part no. 000-12-3456 here", "oink 4845.1681.1440.7320 ea",
)


def test_added_personal_data(spark):
    model = pii.fit(table(spark, "/root/testdata/sf0.1", "documents"))
    assert set(model.thresholds) == set(range(len(pii.PROPOSERS)))
    for before, span, after, kind in PLANTED:
        base, found = pii.all_spans(before + span + after, model)
        assert not base and pii.spans_text(found) == f"{kind}:{len(before)}:{len(before) + len(span)}", (before, span)
    for text in LOOKALIKES:
        assert pii.all_spans(text, model) == ([], []), text


def test_threshold_takes_equal_scores_together():
    n = pii.LEAST_PASSED
    p, y = np.array([0.9] * n + [0.5] * n), np.array([1] * n + [1] * (n - 1) + [0])
    assert pii._threshold(p, y, np.ones(2 * n)) == (0.5 if 2 * n - 1 >= pii.PRECISION * 2 * n else 0.9)
    assert pii._threshold(p, y, np.zeros(2 * n)) == 0.9  # the one negative is the documents' own
    assert pii._threshold(p[: n - 1], y[: n - 1], np.zeros(n - 1)) is None


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, (3000, 6))
    y = ((x[:, 1] > 10) & (x[:, 4] < 20) | (x[:, 2] == 5)).astype(int)
    model = pii.boost(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97


def brute_facts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(covered)


def test_quality_facts_of_random_strings():
    rng = random.Random(8)
    for _ in range(1500):
        text = "".join(rng.choice("ab  \n\t\r\x0b\x0c \x1c#|é𝕏") for _ in range(rng.randrange(80)))
        assert quality.facts(text) == brute_facts(text)


def test_quality_verdict(spark):
    docs, labels = odd(spark, table(spark, "/root/testdata/sf0.1", "documents")), table(spark, "/root/testdata/sf0.1", "labels")
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    out = quality.judge(docs, model).toPandas()
    assert len(out) == docs.count() and not (out.kept & out.base_failed).any()
    assert (out.base_failed == ((out.n_words < 50) | (100 * out.n_repeat_words > 50 * out.n_words))).all()
    rest = labels.where("doc_id % 2 = 1").toPandas().set_index("doc_id").quality.rename("label")
    got = out.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id").join(rest, how="inner")
    got = got[~got.base_failed]
    assert got.kept[got.label == 1].mean() > 0.99 and got.kept[got.label == 0].mean() < 0.1
    none = quality.fit(docs, labels.where("false"))
    assert {r.quality for r in quality.judge(docs.limit(4), none).collect()} == {1.0}
    assert quality.judge(docs.where("false"), model).count() == 0


def test_batch_scores_match_single_features(spark):
    rng = np.random.default_rng(5)
    model = quality.Model(rng.normal(size=quality.KINDS * quality.BUCKETS).astype(np.float32))
    texts = ["one two two three", None, "", "  x", "é𝕏 é𝕏\n\nab", "a", "ab", "abc"]
    want = []
    for text in texts:
        at, value = quality.sparse(text or "")
        want.append((model.weights[at] * value).sum() if len(at) else 0.0)
    assert np.allclose(quality._sums(model.weights, texts), want, atol=1e-4)


def test_personal_data_is_learnt_from_every_document(spark):
    """Forms that only documents late in the hash order hold get their threshold, behind far more rows of other forms."""
    ids = spark.range(160).withColumn("o", F.xxhash64(F.col("id").cast("string"), F.lit("pii")))
    order = [r["id"] for r in ids.orderBy("o").collect()]
    emails = " ".join(f"write to person{k}@mail{k}.example.org now" for k in range(100))
    cards = " ".join("pay by card 4111 1111 1111 1111 or 5500 0000 0000 0004 today" for _ in range(3))
    docs = spark.createDataFrame([(i, emails if k < 100 else cards) for k, i in enumerate(order)], "doc_id long, text string")
    model = pii.fit(docs)
    assert {pii.EMAIL, pii.CARD_NUMBER, pii.ACCOUNT} <= set(model.thresholds)
    found = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    assert len(found) == 160 and found == {r["doc_id"]: r for r in pii.scan(docs, model).collect()}
