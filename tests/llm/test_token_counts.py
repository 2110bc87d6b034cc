import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sylva.llm import token_counts as C

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOKENIZER.encode_special_tokens = True
TEXTS = [None, "", "\n", "\n\n a\n", "one line", "ünï\n😀😀 x\n\nyz  ", "a b c\n" * 50, "x" * 3000 + "\n" + " " * 50 + "\ny", "tab\there\r\nnext", "<|endoftext|>\nno special"]


def tokens_of(text):
    """(start, end) in bytes of every token, from the other library's tokens."""
    sizes = []
    decoder = {c: b for b, c in byte_alphabet().items()}
    for t in TOKENIZER.encode(text, add_special_tokens=False).tokens:
        sizes.append(len(bytes(decoder[c] for c in t)))
    return np.concatenate([[0], np.cumsum(sizes)]).astype(int) if sizes else np.zeros(1, int)


def byte_alphabet():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def brute(text, starts, rule):
    """Per section: tokens by the rule, one token at a time."""
    at = tokens_of(text)
    cuts = [len(text[:s].encode()) for s in starts] + [len(text.encode())]
    out = [0.0] * len(starts)
    for b, e in zip(at[:-1], at[1:]):
        share = [max(0, min(e, z) - max(b, a)) / (e - b) for a, z in zip(cuts[:-1], cuts[1:])]
        if rule == "share":
            out = [o + s for o, s in zip(out, share)]
        else:
            k = next(i for i, s in enumerate(share) if s) if rule == "first" else share.index(max(share))
            out[k] += 1
    return out


def lines(text):
    return [0] + [i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)]


@pytest.mark.parametrize("rule", C.RULES)
def test_lines(spark, rule):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {}
    for r in C.section_counts(docs, rule=rule).collect():
        got.setdefault(r.doc_id, []).append(r)
    for k, text in enumerate(TEXTS):
        text, rows = text or "", sorted(got[k], key=lambda r: r.section)
        assert [r.start for r in rows] == lines(text) and sum(r.length for r in rows) == len(text)
        assert [r.tokens for r in rows] == pytest.approx(brute(text, lines(text), rule))
        assert sum(r.tokens for r in rows) == pytest.approx(len(tokens_of(text)) - 1)


@pytest.mark.parametrize("rule", C.RULES)
def test_given_sections_cut_tokens(spark, rule):
    text = "internationalisation of ünïcödé 😀😀 text"
    docs = spark.createDataFrame([(1, text, [0, 3, 3, None, 17, 25, 33, 99]), (2, text, None), (3, None, [5])], "doc_id long, text string, sections array<long>")
    rows = sorted((r for r in C.section_counts(docs, rule=rule, sections="sections").collect() if r.doc_id == 1), key=lambda r: r.section)
    assert [r.start for r in rows] == [0, 3, 17, 25, 33]
    assert [r.tokens for r in rows] == pytest.approx(brute(text, [0, 3, 17, 25, 33], rule))
    assert sum(r.n_crossing for r in rows) > 0


def test_documents_and_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sums = {r[0]: r[1] for r in C.op1_token_attribution(spark, sf).groupBy("doc_id").sum("n_tokens").collect()}
    for r in docs.limit(40).collect():
        assert sums[r.doc_id] == len(tokens_of(r.text or "")) - 1
    assert C.section_counts(docs.limit(0)).count() == 0
    twice = C.section_counts(docs.limit(1).union(docs.limit(1)).selectExpr("doc_id", "text", "1 as section", "2 as tokens"))
    assert twice.count() == 2 * C.section_counts(docs.limit(1)).count()
    with pytest.raises(ValueError):
        C.section_counts(docs, rule="other")


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a1", "one line\nanother"), (None, "")], "doc_id string, text string")
    rows = C.section_counts(docs).collect()
    assert sorted((r.doc_id or "", r.section) for r in rows) == [("", 0), ("a1", 0), ("a1", 1)]
