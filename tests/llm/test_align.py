"""Token alignment against decoded bytes, a whole text at a time."""

import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitegauge.llm import align, workers

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FACTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute(texts):
    """The contract's columns from whole texts and byte lengths alone."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    letters = align.byte_alphabet()
    a_names = {i: bytes(letters[c] for c in e if c in letters) for e, i in one.get_vocab().items()}

    def b_name(i):
        return bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()

    aligned = []
    for text in texts:
        ids = (one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)) if text else ([], [])
        parts = [a_names[i] for i in ids[0]], [b_name(i) for i in ids[1]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            aligned.append([])
            continue
        ends = [list(accumulate(map(len, p))) for p in parts]
        groups, done = [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            upto = [ends[k].index(cut) + 1 for k in (0, 1)]
            groups.append(tuple(ids[k][done[k] : upto[k]] for k in (0, 1)))
            done = upto
        aligned.append(groups)
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in aligned]
    held = Counter(pair for found in links for pair in found)
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    rows = []
    for groups, found in zip(aligned, links):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        rows.append((
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(found.values()),
            sum(n for p, n in found.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in found.items()),
            hashlib.sha256(said.encode()).hexdigest() if groups else "",
        ))
    return rows


TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "héllo  wörld 你好 \U0001f9ff x", "\U0001f9ff\U0001f9ff", "naïve space", "tab\tand\nline \n\n end ",
    "<s> </s> <unk> <|endoftext|> [INST]", "<0x41> ▁ ▁▁x", "don't can't I'll", "日本語のテキストです。とても長い", "\x00\x01 control", "é combining",
    "The quick brown fox jumps over the lazy dog", "The quick brown fox jumps over the lazy dog", "жук и Été ῦ ﬁ ½", "1234567890 3.14159 +49-170-1234567", " em space 　wide",
    "word " * 3000, "x" * 20000, "مرحبا بالعالم", "👩‍👩‍👧 family", "a" + "̀" * 40,
]


@pytest.mark.parametrize("head", [align.HEAD_ROWS, 40, 0])
def test_matches_decoded_bytes(spark, monkeypatch, head):
    monkeypatch.setattr(align, "HEAD_ROWS", head)
    monkeypatch.setattr(align.link_scores, "__defaults__", (head,))
    docs = spark.createDataFrame([(k if k else None, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    docs = docs.withColumns({"pairs": F.lit(1), "_row": F.lit(2), "groups": F.lit("clash")})
    out = align.align_corpus(docs, A, B)
    got = sorted((-1 if r.doc_id is None else r.doc_id, *(r[c] for c in FACTS)) for r in out.collect())
    assert got == sorted((k if k else -1, *row) for k, row in enumerate(brute(TEXTS)))


def test_documents_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    out = {r.doc_id: tuple(r[c] for c in FACTS) for r in align.align_corpus(docs, A, B).collect()}
    assert out == {r.doc_id: want for r, want in zip(rows, brute([r.text for r in rows]))}


def test_groups_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "naïve \U0001f9ff")], "doc_id long, text string")
    row = align.align(docs, A, B).first()
    ids = [[list(map(int, side.split(","))) for side in g.split("|")] for g in row.groups.split(";")]
    assert sum((a for a, _ in ids), []) == workers.byte_level(A, True).encode(" naïve \U0001f9ff", add_special_tokens=False).ids
    assert sum((b for _, b in ids), []) == workers.pieces(B).encode("naïve \U0001f9ff")
    assert align.align_corpus(docs.where("false"), A, B).count() == 0


def test_segments_are_kept_in_bounds(monkeypatch):
    monkeypatch.setattr(align, "CACHE_ROWS", 50)
    tool = align.Aligner(A, B)
    texts = [" ".join(f"w{k * j}" for j in range(40)) for k in range(20)] + ["long" * 100]
    assert tool.align(texts)[3][1] == align.Aligner(A, B).align(texts[3:4])[0][1]
    assert len(tool.kept) <= 50 and not any(len(s) > align.LONGEST_KEPT for s in tool.kept)


def test_texts_together_are_as_alone():
    texts = ["one two  three", None, "", "ﬁne café naïve \U0001f9ff x", "long" * 100 + " one", "two one " + "tall" * 90, "\x00 a", "one\ttwo\n three "]
    tool = align.Aligner(A, B)
    alone = [align.Aligner(A, B).align([t])[0] for t in texts]
    plain = lambda rows: [r and (r[0], r[1], r[2].tolist(), r[3].tolist()) for r in rows]
    for order in (range(8), range(7, -1, -1)):
        assert plain(tool.align([texts[k] for k in order])) == plain([alone[k] for k in order])
    assert tool.links.size == tool.counts[:, 3].sum() and len(tool.texts) == len(tool.counts) == len(tool.kept)
