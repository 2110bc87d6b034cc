import hashlib
import math
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sylva.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def check(rows, texts):
    for r in rows:
        want = brute(texts[r.doc_id])
        for kind in PATTERNS:
            assert r[f"n_{kind}"] == sum(w[0] == kind for w in want), (texts[r.doc_id], want, r)
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (texts[r.doc_id], want, r)
        spans = set(filter(None, r.spans.split(",")))
        assert spans >= {f"{k}:{s}:{e}" for k, s, e in want}


ODD = [
    None,
    "",
    "a@b.c_d@e.f g.h@i-j.kl..mn@op.qr",
    "x@y a@@b.c @d.e f@g. h@i.j.",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 000.00.0.255 01.02.03.04",
    "4539 1488 0343 6467 and 4539-1488-0343-6467 4539  1488 0343 6467 45391488034364670000",
    "+1 (555) 555-0100 +1555 +12345678901234567 ++49 30 1234567. + 1 23",
    "😀 mail me: é.x@y.de ü a.b@c.org😀 +33 1 23 45 67 89\n10.0.0.1",
    "token = \"2abc3ff2ca8fb1e4c565a0eb63815530a948bdde\" ssn 123-45-6789",
    "write to bob (at) host (dot) com or call (212) 555-0199",
    "1" * 5000 + " " + "a" * 5000 + " 1.2.3.4 " + "a." * 3000 + "@b" + ".c" * 3000,
]


def test_base_spans_on_odd_texts(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    check(pii.detect(docs).collect(), dict(enumerate(ODD)))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("0123456789.+-() @ab\n", max_size=60), min_size=40, max_size=40))
def test_base_spans_on_random_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(pii.detect(docs).collect(), dict(enumerate(texts)))


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = pii.op5_weak_supervision_pii(spark, sf).collect()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    check(rows, texts)


def test_added_spans_are_found_and_masked(spark):
    rows = [(k, f"Word {k} then token = \"2abc3ff2ca8fb1e4c565a0eb6381{k:04d}\" end, mail: a{k}@mail.example.com.") for k in range(60)]
    docs = spark.createDataFrame([(*r, len(r[1]), "x") for r in rows], "doc_id long, text string, n_chars long, e string")
    spans = {r.doc_id: r.spans for r in pii.detect(docs).collect()}
    assert all("secret:" in s and "email:" in s for s in spans.values())
    out = pii.mask(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        assert r.text == f"Word {r.doc_id} then [SECRET] end, mail: [EMAIL]." and r.n_chars == len(r.text)


WIDE = "|".join([
    r"(?i:token|secret|passw(?:or)?d|api[_-]?key)[\"']? ?[=:] ?[\"']?[A-Za-z0-9+/_-]{16,}[\"']?",
    r"[A-Za-z0-9._%+-]+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,10})+",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    r"(?<![0-9])[0-9]{13,19}(?![0-9])",
])


def votes(kind, m, before):
    """What the four labelers say, in plain Python."""
    digits = re.sub("[^0-9]", "", m)
    strict, other = pii.FORMS[kind]
    yes = lambda test, no=-1: 1 if test else no
    rest = re.sub(" ", "", m[4:] + m[:4]) if kind == "iban" else ""
    check = {
        "email": lambda: yes(not re.search(r"\.\.|^\.|\.@", m)),
        "phone": lambda: yes(9 <= len(digits) <= 15),
        "card": lambda: yes(luhn(digits)),
        "secret": lambda: yes(re.search("[0-9]", m) and re.search("[A-Za-z]", m)),
        "ip": lambda: yes(not re.search(r"(^|\.)0[0-9]", m)),
        "iban": lambda: yes(int("".join(str(int(c, 36)) for c in rest)) % 97 == 1),
        "ssn": lambda: yes(not re.search("^000|-00-|-0000$", m)),
    }[kind]()
    known = {
        "email": lambda: yes(re.search(pii.DOMAINS, m.lower()), 0),
        "phone": lambda: yes(re.search(pii.CALLING, m), 0),
        "card": lambda: yes(re.search(pii.ISSUER, digits)),
        "secret": lambda: 0,
        "ip": lambda: yes(not re.search(pii.RESERVED, m)),
        "iban": lambda: yes(re.search(pii.COUNTRIES, m)),
        "ssn": lambda: yes(not re.search("^(000|666|9)", m)),
    }[kind]()
    words = yes(re.search(pii.SAYS[kind], before.lower()), -1 if re.search(pii.AGAINST, before.lower()) else 0)
    return yes(re.search(strict, m), other), check, known, words


def brute_spans(texts):
    """All spans of every text: candidates, votes, expectation-maximisation and the classifier, row by row."""
    found = []
    for k, text in enumerate(texts):
        text, base = text or "", brute(text)
        own = [(*b, True) for b in base]
        for m in re.finditer(WIDE, text):
            if all(m.end() <= s or e <= m.start() for _, s, e in base):
                kind = next((kind for kind, _, tell in pii.WIDER if re.search(tell, m[0])), "secret")
                own.append((kind, m.start(), m.end(), False))
        ends = {(kind, s): [x.end() for x in re.finditer(PATTERNS.get(kind, "$^"), text) if x.end() <= s] + [0] for kind, s, _, _ in own}
        wide = [x.end() for x in re.finditer(WIDE, text)]
        for kind, s, e, is_base in own:
            start = max(ends[kind, s]) if is_base else max([x for x in wide if x <= s] + [0])
            found.append((k, kind, s, e, is_base, min((e - s) // 8, 4), votes(kind, text[s:e], text[max(start, s - 40) : s])))
    post = [1 / (1 + math.exp(-sum(f[-1]))) for f in found]
    strength = 10 + len(found) * pii.STRENGTH
    for _ in range(60):
        share = {kind: (sum(p for p, f in zip(post, found) if f[1] == kind) + 1) / (sum(f[1] == kind for f in found) + 2) for kind in pii.KINDS}
        says = [[[sum(p if y else 1 - p for p, f in zip(post, found) if f[-1][j] == v) + strength * pii.PRIOR[y][v + 1] for v in (-1, 0, 1)] for j in range(4)] for y in (0, 1)]
        says = [[[x / sum(row) for x in row] for row in one] for one in says]
        post = []
        for f in found:
            odds = math.log(share[f[1]] / (1 - share[f[1]])) + sum(math.log(says[1][j][v + 1] / says[0][j][v + 1]) for j, v in enumerate(f[-1]))
            post.append(1 / (1 + math.exp(-max(-30, min(30, odds)))))
    x = np.array([[*(v == 1 for v in f[-1]), *(v == -1 for v in f[-1]), *(f[1] == kind for kind in pii.KINDS), *(f[5] == n for n in range(5))] for f in found], float)
    w, target = np.zeros(x.shape[1]), np.array(post)
    for _ in range(60_000):  # the same optimum by plain ascent
        w += 0.9 / (len(x) + 1) * (x.T @ (target - 1 / (1 + np.exp(-x @ w))) - w)
    p = 1 / (1 + np.exp(-x @ w))
    assert all(abs(v - 0.5) > 0.01 for v, f in zip(p, found) if not f[4])
    out = [[] for _ in texts]
    for f, v in zip(found, p):
        if f[4] or v >= 0.5:
            out[f[0]].append((pii.KINDS.index(f[1]), f[2], f[3], f[1]))
    return [",".join(f"{kind}:{s}:{e}" for _, s, e, kind in sorted(o)) for o in out]


MORE = [
    "IBAN DE89 3702 0044 0532 0130 00 and GB82WEST12345698765432, not DE89 3702 0044 0532 0130 01 nor XX12 1234 1234 1234 1234",
    "SSN 123-45-6789, 000-12-3456, 666-12-3456, version 123-45-0000; call (212) 555-0199 or 012.345.6789",
    "bob (at) host (dot) com, al.b [at] my-site.org {at} x, q{at}w.ab.cd; secret: aaaaaaaaaaaaaaaaaaaaaaa API_KEY='k3jh4k5j6h7kj8h9k'",
    "4539148803436467, 4539148803436468 and 12345678901234, isbn 9780306406157",
    "a@b.co" + " (at) host.com" * 3 + " 10.0.0.1 1.2.3.4 (at) x.yz",
]


def test_all_spans_against_brute_force(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()] + MORE * 3 + ODD[:-1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.detect(docs).collect()}
    want = brute_spans(texts)
    for k, t in enumerate(texts):
        assert got[k].spans == want[k], (t, got[k].spans, want[k])
        assert got[k].n_spans == len(list(filter(None, want[k].split(","))))


def test_long_texts_of_one_kind(spark):
    """Seconds, and no deep stack, for a megabyte of what repeats in a pattern."""
    n = 1_000_000
    texts = ["me(at)host" + ".ab" * (n // 3), "a@b.co " * (n // 7), "+1 (555) 555-0100 " * (n // 18), "12 " * (n // 3), "x(at)y.zz " * (n // 10), "x(at)" * (n // 5), "1." * (n // 2), "DE89 " * (n // 5), "token=" * (n // 6), "a" * n]
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long").repartition(4)
    began = time.time()
    sizes = {r.doc_id: r.n for r in pii.candidates(docs).selectExpr("doc_id", "size(__pii) as n").collect()}
    assert (sizes[0], sizes[1], sizes[2], sizes[4]) == (1, n // 7, n // 18, n // 10)
    got = {r.doc_id: r for r in pii.detect(docs).select("doc_id", "n_email", "n_phone").collect()}
    assert got[1].n_email == n // 7 and got[2].n_phone == n // 18
    lengths = {r.doc_id: r.n_chars for r in pii.mask(docs).select("doc_id", "n_chars").collect()}
    assert lengths[1] == n // 7 * 8 and lengths[2] == n // 18 * 8 and lengths[9] == n
    assert time.time() - began < 240


def test_masks_of_overlapping_spans_and_odd_columns(spark):
    text = "😀 x token=abcdefghijklmnop1234 y +1 (555) 555-0100 10.0.0.1@b.co é " + "é" * 600 + " a@b.co"
    docs = spark.createDataFrame([(1, text, 5, 6, 7, 8)], "doc_id long, text string, `a.b` int, __pii int, __t int, c0 int")
    spans = [tuple(map(int, x.split(":")[1:])) for x in pii.detect(docs).first().spans.split(",")]
    got = pii.mask(docs)
    assert got.columns == docs.columns and tuple(got.first())[2:] == (5, 6, 7, 8)
    want, at = "", 0
    for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s >= at:
            kind = next(x.split(":")[0] for x in pii.detect(docs).first().spans.split(",") if x.endswith(f":{s}:{e}"))
            want += text[at:s] + f"[{kind.upper()}]"
        at = max(at, e)
    assert got.first().text == want + text[at:]


def test_empty_table_and_repeated_rows(spark):
    assert pii.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a@b.cd")] * 3 + [(None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_email) for r in pii.detect(docs).collect()) == [(0, 0), (1, 1), (1, 1), (1, 1)]


def test_reliabilities_favour_the_labelers_that_agree():
    import numpy as np

    votes = np.array([[1, 1, 1, 1], [-1, -1, -1, 1], [1, 1, 1, -1], [-1, -1, -1, -1]])
    post, table = pii.reliabilities(votes, np.array([50.0, 50, 50, 50]), np.zeros(4, int))
    assert post[0] > 0.9 and post[2] > 0.9 and post[1] < 0.1 and post[3] < 0.1
    assert table[1, 0, 2] > 0.7 and table[1, 0, 2] > table[1, 3, 2] + 0.2


def test_secrets_of_letters_only_are_candidates_without_a_digit_in_the_text(spark):
    says = ["password: abcdefghijklmnopqrst", "my API_KEY='abcdefghijklmnopqrst'", "Token=abcdefghijklmnopqrst", "secret abcdefghijklmnopqrst", "no such word: abcdefghijklmnopqrst"]
    docs = spark.createDataFrame([(2 * k + n, t + end) for k, t in enumerate(says) for n, end in enumerate((" end", " end 7"))], "doc_id long, text string")
    got = {r.doc_id: [(c.kind, c.s, c.e) for c in r["__pii"]] for r in pii.candidates(docs).collect()}
    for k in range(len(says)):
        assert got[2 * k] == got[2 * k + 1]  # an unrelated digit changes nothing
        assert [c[0] for c in got[2 * k]] == (["secret"] if k < 3 else [])
