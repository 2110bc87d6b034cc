r"""Personal data by weak supervision, in DataFrame expressions only.

Candidates are the base matches (email, ip, card, phone, each by its pattern, leftmost and non-overlapping) and the
matches of one wider pattern (spelled-out addresses, national phone numbers, social security numbers, bank account
numbers, secrets after a keyword, long digit runs).  Four labelers vote 1, 0 or -1 on each: a regex of the kind's strict
form, a checksum or range test (Luhn, modulo 97, lengths, numbers never given out), a gazetteer (domains, calling codes,
issuer digits, countries, reserved ranges) and the words before the match.  Counts of votes, a table of bounded size, go
through expectation-maximisation, which estimates how far each labeler can be trusted; its posteriors train a logistic
regression over votes, kind and length, and this span classifier decides on the wider candidates.  Base spans always stay;
a wider candidate that overlaps a base span is dropped.

Everything for one text is an array in its row: no row of texts is ever shuffled.

Patterns: every group that may repeat without bound is possessive, so that no match uses more stack the longer it is; and
the guard (?:(?<![class])|\G) gives the matches of the plain patterns without their quadratic cost on long runs: a match
can only begin where its run begins, or where the last match ended.

Edge cases: null and empty texts have no spans (base_sha256 is that of the empty string); positions count code points;
repeated rows are treated alike; an empty table gives an empty table; other columns, whatever their names, are kept by
mask() and ignored otherwise.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import MOST, apart, cut, let, pieces, running
from .common import materialise, sealed, spread, table

# The base patterns.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

#: Wider candidates: kind, pattern, and what tells the kind from the matched text.
WIDER = (
    ("secret", r"(?i:token|secret|passw(?:or)?d|api[_-]?key)[\"']?\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_-]{16,}+[\"']?", r"^(?i:token|secret|pass|api)"),
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z]{2,10})++", r"at[\])}]"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"^[A-Z]{2}[0-9]{2}"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
    ("phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"),
    ("card", r"(?<![0-9])[0-9]{13,19}+(?![0-9])", r"^[0-9]{13,19}$"),
)
#: What every wider match holds: a digit, a spelled-out at sign, or the keyword of a secret.
WIDER_GUARD = r"[0-9]|[\[({]at[\])}]|(?i:token|secret|passw(?:or)?d|api[_-]?key)[\"']?\x20?[=:]"
KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn")
VOTES = ("v_regex", "v_check", "v_list", "v_words")
PRIOR = np.array([[0.45, 0.4, 0.15], [0.08, 0.32, 0.6]])  # of votes -1, 0 and 1, given class 0 and class 1
STRENGTH = 0.05  # the weight of PRIOR: as many candidates as this share of all, and 10
CONTEXT = 40  # code points before a match that the context labeler sees

# What the labelers know.  Forms: a regex of strict forms, and what is said of all others.
FORMS = {
    "email": (r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+\.)*+[A-Za-z]{2,24}$|[\[({]at[\])}].*[\[(]dot[\])]", 0),
    "ip": (r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$", -1),
    "card": (r"^(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){2,3}(?:[\x20-][0-9]{1,3})?|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$", -1),
    "phone": (r"^\+[1-9][0-9]{0,2}(?:[\x20.-]?\(?[0-9]{1,4}\)?){2,6}$|^\(?[2-9][0-9]{2}\)?[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}$", -1),
    "iban": (r"^[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)$", -1),
    "secret": (r"[=:]\x20?[\x22\x27]?(?:[0-9A-Fa-f]{32,}+|[A-Za-z0-9+/_-]*[0-9][A-Za-z0-9+/_-]*+)[\x22\x27]?$", -1),
    "ssn": (r"^[0-8][0-9]{2}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", -1),
}
DOMAINS = r"[.)\]]\x20?(com|org|net|edu|gov|io|info|biz|fr|de|es|uk|eu|us|ch|at|it|nl|example)$"
CALLING = r"^\+(1|20|27|3[0-46-9]|4[0-13-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])[^0-9]"
ISSUER = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65)"
RESERVED = r"^(0|10|127|255|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
COUNTRIES = r"^(AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"
SAYS = {
    "email": "mail|contact|write|reach",
    "ip": r"\bip\b|address|server|host|login",
    "card": "card|visa|master|payment|credit",
    "phone": "call|phone|tel|mobile|fax|whatsapp",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "secret": "api|auth|login|secret|key",
    "ssn": r"\bssn\b|social|security",
}
AGAINST = r"version|isbn|order|section|page|figure|serial|\bno\.? ?$|#\s*$"


# ---------------------------------------------------------------- candidates


def found(text: str, pattern: str, guard: str | Column) -> tuple[Column, Column]:
    """All matches of a pattern in a column, and the text before each; empty where the guard fails."""
    p = F.lit(pattern)
    hit = F.expr(guard) if isinstance(guard, str) else guard
    return (
        F.when(hit, F.regexp_extract_all(F.col(text), p, F.lit(0))).otherwise(F.array().cast("array<string>")),
        F.when(hit, F.split(F.col(text), pattern, -1)).otherwise(F.array().cast("array<string>")),
    )


def placed(matches: str, gaps: str) -> Column:
    """Structs (s, e, m, before) of each match, from the lengths of the gaps and matches before it."""
    both = f"transform({matches}, (m, i) -> length({gaps}[i]) + length(m))"
    one = f"struct(at[i] + length({gaps}[i]) as s, at[i] + length({gaps}[i]) + length(m) as e, m as m, right({gaps}[i], {CONTEXT}) as before)"
    return F.expr(let("n", both, let("at", running("n"), f"transform({matches}, (m, i) -> {one})")))


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


#: SQL over a match x.m: whether a base match of a kind stands.
STANDS = {
    "email": "true",
    "ip": f"x.m rlike r'^{_OCTET}(?:\\.{_OCTET}){{3}}$'",
    "card": f"length({_digits('x.m')}) between 13 and 19 and luhn_check({_digits('x.m')})",
    "phone": f"length({_digits('x.m')}) between 9 and 15",
}
#: SQL over a match x.m of an account number: the remainder by 97 of its letters and digits, the first four last.
MOD97 = """aggregate(split(regexp_replace(concat(substring(x.m, 5), left(x.m, 4)), ' ', ''), ''), 0,
      (a, c) -> case when c = '' then a when c between '0' and '9' then (a * 10 + int(c)) % 97 else (a * 100 + ascii(c) - 55) % 97 end)"""


def candidates(docs: DataFrame) -> DataFrame:
    """The columns of docs (text, and others without a leading underscore), and `__pii`: structs (kind, s, e, base, len, and
    a vote of each labeler)."""
    df = docs.withColumn("__t", F.coalesce(F.col("text"), F.lit("")))
    wider = "|".join(p for _, p, _ in WIDER)
    digit = "__t rlike '[0-9]'"
    names = []
    for kind, pattern, guard in (
        *((k, p, "contains(__t, '@')" if k == "email" else "contains(__t, '+')" if k == "phone" else digit) for k, p in BASE.items()),
        ("wider", wider, F.col("__t").rlike(WIDER_GUARD)),
    ):
        m, g = found("__t", pattern, guard)
        df = df.withColumn(f"__m_{kind}", m).withColumn(f"__g_{kind}", g)
        names.append(kind)
    df = df.select(
        *docs.columns,
        *[F.when(F.size(f"__m_{k}") > 0, placed(f"__m_{k}", f"__g_{k}")).otherwise(placed_none()).alias(f"__p_{k}") for k in names],
    )
    parts = []
    for kind in BASE:
        parts.append(f"transform(filter(__p_{kind}, x -> {STANDS[kind]}), x -> {_voted(repr(kind), 'true')})")
    which = "case " + " ".join(f"when x.m rlike r'{tell}' then '{kind}'" for kind, _, tell in WIDER) + " else 'secret' end"
    df = df.withColumn("__base", F.expr(f"concat({', '.join(parts)})"))
    df = df.withColumn("__clear", F.expr(apart("__p_wider", "__base")))
    more = f"transform(__clear, x -> {let('kind', which, _voted('kind', 'false'))})"
    return df.withColumn("__pii", F.expr(f"concat(__base, {more})")).select(*docs.columns, "__pii")


def placed_none() -> Column:
    return F.array().cast("array<struct<s: int, e: int, m: string, before: string>>")


def _voted(kind: str, base: str) -> str:
    """SQL of a candidate with its votes, from x and the kind."""
    digits = _digits("x.m")
    strict = f"case {kind} " + " ".join(f"when '{k}' then if(x.m rlike r'{p}', 1, {other})" for k, (p, other) in FORMS.items()) + " else 0 end"
    checked = f"""case {kind}
      when 'email' then if(x.m rlike '[.]{{2}}|^[.]|[.]@', -1, 1)
      when 'phone' then if(length({digits}) between 9 and 15, 1, -1)
      when 'card' then if(luhn_check({digits}), 1, -1)
      when 'secret' then if(x.m rlike '[0-9]' and x.m rlike '[A-Za-z]', 1, -1)
      when 'ip' then if(x.m rlike '(^|[.])0[0-9]', -1, 1)
      when 'iban' then if({MOD97} = 1, 1, -1)
      when 'ssn' then if(x.m rlike '^000|-00-|-0000$', -1, 1)
      else 0 end"""
    listed = f"""case {kind}
      when 'email' then if(lower(x.m) rlike r'{DOMAINS}', 1, 0)
      when 'phone' then if(x.m rlike r'{CALLING}', 1, 0)
      when 'card' then if({digits} rlike r'{ISSUER}', 1, -1)
      when 'ip' then if(x.m rlike r'{RESERVED}', -1, 1)
      when 'iban' then if(x.m rlike r'{COUNTRIES}', 1, -1)
      when 'ssn' then if(x.m rlike '^(000|666|9)', -1, 1)
      else 0 end"""
    says = "case " + kind + " " + " ".join(f"when '{k}' then r'{p}'" for k, p in SAYS.items()) + " end"
    words = f"case when lower(x.before) rlike ({says}) then 1 when lower(x.before) rlike r'{AGAINST}' then -1 else 0 end"
    return (
        f"named_struct('kind', {kind}, 's', x.s, 'e', x.e, 'base', {base}, 'len', least(int(length(x.m) / 8), 4), "
        f"'v_regex', {strict}, 'v_check', {checked}, 'v_list', {listed}, 'v_words', {words})"
    )


# ---------------------------------------------------------------- aggregation and classifier


def reliabilities(votes: np.ndarray, n: np.ndarray, kind: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation on counted vote patterns: each pattern's posterior, and P(vote | class) of each labeler.

    Labelers are independent given the class; the share of class 1 is each kind's own.  PRIOR, with the weight of STRENGTH,
    says that labelers are better than chance: without it the classes can settle on two kinds.
    """
    strength = 10 + n.sum() * STRENGTH
    post = 1 / (1 + np.exp(-votes.sum(axis=1)))
    table_ = np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        weight = np.stack([n * (1 - post), n * post])
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                table_[:, j, v + 1] = weight[:, votes[:, j] == v].sum(axis=1) + strength * PRIOR[:, v + 1]
        table_ /= table_.sum(axis=2, keepdims=True)
        prior = np.array([((n * post)[kind == k].sum() + 1) / (n[kind == k].sum() + 2) for k in range(len(KINDS))])
        odds = np.log(prior / (1 - prior))[kind]
        for j in range(votes.shape[1]):
            odds = odds + np.log(table_[1, j, votes[:, j] + 1] / table_[0, j, votes[:, j] + 1])
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, table_


def design(votes: np.ndarray, kind: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.concatenate(
        [votes == 1, votes == -1, kind[:, None] == np.arange(len(KINDS)), size[:, None] == np.arange(5)], axis=1
    ).astype(float)


def train(rows: list[tuple]) -> np.ndarray:
    """Weights of the span classifier from rows (kind, len, votes..., count)."""
    if not rows:
        return np.zeros(2 * len(VOTES) + len(KINDS) + 5)
    kind = np.array([KINDS.index(r[0]) for r in rows])
    size, votes = np.array([r[1] for r in rows]), np.array([r[2:-1] for r in rows])
    n = np.array([r[-1] for r in rows], float)
    target, _ = reliabilities(votes, n, kind)
    x, w = design(votes, kind, size), np.zeros(2 * len(VOTES) + len(KINDS) + 5)
    for _ in range(30):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (target - p)) - w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w = w + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return w


def probability(w: np.ndarray) -> str:
    """SQL of the classifier's probability for a candidate c."""
    names = [*(f"c.{v} = 1" for v in VOTES), *(f"c.{v} = -1" for v in VOTES), *(f"c.kind = '{k}'" for k in KINDS), *(f"c.len = {k}" for k in range(5))]
    terms = [f"if({test}, {value!r}D, 0D)" for test, value in zip(names, map(float, w)) if math.isfinite(value)]
    return f"1D / (1D + exp(-({' + '.join(terms)})))"


def classified(docs: DataFrame, keep: list[str], threshold: float = 0.5) -> DataFrame:
    """The columns `keep` of docs and `__pii`, the spans that stay: structs (rank of the kind, s, e, kind, base, p)."""
    all_ = materialise(candidates(docs).select(*keep, "__pii"), "candidates")
    votes = all_.select(F.explode("__pii").alias("c")).select("c.kind", "c.len", *[f"c.{v}" for v in VOTES])
    # At most kinds * 5 lengths * 3 ** labelers rows, whatever the corpus.
    rows = votes.groupBy("kind", "len", *VOTES).count().orderBy("kind", "len", *VOTES).collect()
    p = probability(train([tuple(r) for r in rows]))
    rank = "case c.kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS)) + " end"
    kept = f"transform(__pii, c -> struct({rank} as rank, c.s as s, c.e as e, c.kind as kind, c.base as base, {p} as p))"
    return all_.withColumn("__pii", F.expr(f"array_sort(filter({kept}, c -> c.base or c.p >= {threshold}D))"))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base matches, base_sha256, spans, and the number of all spans."""
    spans = classified(docs.select("doc_id", "text"), ["doc_id"])
    said = "concat_ws(',', transform({}, c -> concat(c.kind, ':', c.s, ':', c.e)))"
    return spans.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(__pii, c -> c.base and c.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE],
        F.expr(f"sha2({said.format('filter(__pii, c -> c.base)')}, 256)").alias("base_sha256"),
        F.expr(said.format("__pii")).alias("spans"),
        F.size("__pii").cast("long").alias("n_spans"),
    )


def mask(docs: DataFrame) -> DataFrame:
    """The columns of docs with each span of the text put in place by its kind, as in [EMAIL]; n_chars follows.

    Spans that overlap are masked as one, under the kind of the first.
    """
    plain, undo = sealed(docs, "text", "n_chars")
    ordered = "array_sort(transform(__pii, c -> struct(c.s as s, -c.e as o, c.e as e, c.kind as kind)))"
    # A span that begins before the end of those before it is part of their mask.
    one = f"if(c.s < ended[i], '', concat({cut('cuts', 'ended[i]', 'c.s')}, '[', upper(c.kind), ']'))"
    rest = cut("cuts", "array_max(ends)", "length(text)")
    parts = f"concat(transform(ordered, (c, i) -> {one}), array({rest}))"
    text = let("ordered", ordered, let("ends", "transform(ordered, c -> c.e)", let("ended", running("ends", MOST), let("cuts", pieces("text"), f"array_join({parts}, '')"))))
    spans = classified(plain, plain.columns).withColumn("__masked", F.when(F.size("__pii") > 0, F.expr(text)).otherwise(F.col("text")))
    out = spans.withColumn("text", F.col("__masked"))
    if "n_chars" in plain.columns:
        n = F.length("__masked").cast(plain.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.size("__pii") > 0, n).otherwise(F.col("n_chars")))
    return undo(out)


def op5_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(spread(table(spark, sf_dir, "documents")))
