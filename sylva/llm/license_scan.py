r"""License scans by ordered signature rules, in DataFrame expressions only.

A text becomes its words, lower-cased and joined by single spaces.  A rule is a regex over whole words, with a keyword,
a priority and a confidence.  The rules come from hand-written families (names, identifiers and typical phrases of a
license) times forms of mention; some hundreds in all.  A rule runs on a text only if two plain substrings stand there,
the keyword of its family and a word of its form; texts without a word of any form are passed over at once.

A rule's detections are its leftmost non-overlapping matches.  Overlaps are resolved in order of priority (then of the rules
below): a detection stays if it overlaps none that stays already, so what lies inside or across a detection of higher
priority goes, and one that has gone itself suppresses nothing.  Priorities follow containment: a form or a name that holds
another has the higher one.  The labels of those left are joined to the base labels.

Edge cases: null and empty texts have no words (n_words 0, no labels, score 0); only A-Z are lower-cased, so other letters
never turn into ASCII; repeated rows are treated alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import apart, let, running
from .common import spread, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Rule:
    keyword: str  # a word begins with it
    pattern: str
    label: str
    priority: int
    confidence: float
    form: str = ""  # a second substring; the keyword, if there is none


#: Families: label, keyword (of every mention), a regex of the name, and a regex of versions or None.
FAMILIES = (
    ("apache", "apache", r"apache(?: software)?", r"(?:version )?(?:1 0|1 1|2 0|2)"),
    ("mit", "mit", r"mit(?: x11)?", None),
    ("mit", "expat", r"expat", None),
    ("bsd", "bsd", r"(?:(?:new|revised|modified|simplified|original) )?bsd", r"(?:0|1|2|3|4) clause"),
    ("gpl", "general public", r"(?:gnu )?general public", r"(?:version |v ?)?[123](?: 0)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl(?:v[123])?", r"(?:version |v ?)?[123](?: 0)?"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public", r"(?:version |v ?)?(?:2 1|2|3)(?: 0)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?:v[23])?", r"(?:version |v ?)?(?:2 1|2|3)(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public", r"(?:version |v ?)?[13](?: 0)?"),
    ("agpl", "agpl", r"(?:gnu )?agpl(?:v3)?", r"(?:version |v ?)?[13](?: 0)?"),
    ("mpl", "mozilla", r"mozilla public", r"(?:version )?(?:1 0|1 1|2 0|2)"),
    ("epl", "eclipse", r"eclipse (?:public|distribution)", r"(?:version )?(?:1 0|2 0|2)"),
    ("cddl", "common development", r"common development and distribution", r"(?:version )?1 [01]"),
    ("eupl", "european union", r"european union public", r"(?:version )?1 [0-2]"),
    ("artistic", "artistic", r"(?:perl )?artistic", r"(?:version )?[12](?: 0)?"),
    ("isc", "isc", r"isc", None),
    ("zlib", "zlib", r"zlib(?: libpng)?", None),
    ("boost", "boost", r"boost software", r"(?:version )?1 0"),
    ("unlicense", "unlicense", r"unlicense", None),
    ("wtfpl", "wtfpl", r"wtfpl", r"(?:version )?2"),
    ("ofl", "open font", r"(?:sil )?open font", r"(?:version )?1 1"),
    ("psf", "python software", r"python software foundation", r"(?:version )?2"),
    ("php", "php", r"php", r"(?:version )?3 0(?:1)?"),
    ("ruby", "ruby", r"ruby", None),
    ("openssl", "openssl", r"openssl(?: ssleay)?", None),
    ("ms-pl", "microsoft public", r"microsoft public", None),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal", None),
    ("qpl", "q public", r"q public", r"(?:version )?1 0"),
    ("osl", "open software", r"open software", r"(?:version )?[123] [01]"),
    ("afl", "academic free", r"academic free", r"(?:version )?[123] [01]"),
    ("cecill", "cecill", r"cecill(?: [bc])?", r"(?:version )?[12] [01]"),
    ("odbl", "database", r"open (?:data commons )?(?:open )?database", r"(?:version )?1 0"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation", r"(?:version )?1 [1-3]"),
)
#: Forms of mention: the regex around {name} and {version}, a substring of all matches, priority and confidence.
FORMS = (
    (r"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[cs]e)?(?: {version})?", " under ", 90, 0.98),
    (r"(?:this|the) (?:work|software|program|file|document|project|code) is (?:licen[cs]ed|released|covered) (?:under|by) (?:the )?{name}(?: licen[cs]e)?(?: {version})?", " is ", 95, 0.99),
    (r"{name} licen[cs]e {version}", " licen", 80, 0.95),
    (r"{name} {version} licen[cs]e", " licen", 78, 0.95),
    (r"{name} licen[cs]e", " licen", 70, 0.9),
    (r"under (?:the )?{name} {version}", " under ", 60, 0.8),
    (r"subject to (?:the )?(?:terms of (?:the )?)?{name}(?: licen[cs]e)?", " subject to ", 85, 0.95),
    (r"spdx licen[cs]e identifier {name}(?: {version})?(?: only| or later)?", " spdx ", 99, 1.0),
    (r"see (?:the )?{name} licen[cs]e(?: {version})? for (?:more )?details", " see ", 88, 0.95),
    (r"dual licen[cs]ed under (?:the )?{name}(?: licen[cs]e)?(?: {version})? (?:and|or)", " dual ", 92, 0.98),
)
#: Added to the priority of families whose names hold the name of another.
NARROWER = {"lgpl": 20, "agpl": 20}
#: Rules of their own.
SINGLE = (
    Rule("creative commons", r"creative commons (?:licen[cs]e )?attribution(?: [1-4] 0)?", "cc-by", 70, 0.9),
    Rule("creative commons", r"creative commons attribution share ?alike(?: [1-4] 0)?", "cc-by-sa", 75, 0.95),
    Rule("creative commons", r"creative commons attribution non ?commercial(?: [1-4] 0)?", "cc-by-nc", 75, 0.95),
    Rule("creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?", "cc-by-nc-sa", 80, 0.95),
    Rule("creative commons", r"creative commons attribution no ?deriv(?:s|atives)(?: [1-4] 0)?", "cc-by-nd", 75, 0.95),
    Rule("creative commons", r"creative commons zero(?: 1 0)?", "cc0", 75, 0.95),
    Rule("cc by nc sa", r"cc by nc sa(?: [1-4] 0)?", "cc-by-nc-sa", 86, 0.95),
    Rule("cc by nc nd", r"cc by nc nd(?: [1-4] 0)?", "cc-by-nc-nd", 86, 0.95),
    Rule("cc by nc", r"cc by nc(?: [1-4] 0)?", "cc-by-nc", 84, 0.95),
    Rule("cc by sa", r"cc by sa(?: [1-4] 0)?", "cc-by-sa", 84, 0.95),
    Rule("cc by nd", r"cc by nd(?: [1-4] 0)?", "cc-by-nd", 84, 0.95),
    Rule("cc by", r"cc by(?: [1-4] 0)?", "cc-by", 60, 0.8),
    Rule("cc0", r"cc0(?: 1 0)?", "cc0", 70, 0.9),
    Rule("public domain", r"(?:dedicated to|released into|in) the public domain", "public-domain", 70, 0.85),
    Rule("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", "copyright", 50, 0.7),
    Rule("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: [^ ]+){1,6} all rights reserved", "reserved", 85, 0.95),
    Rule("rights reserved", r"(?:all|some) rights reserved", "reserved", 60, 0.8),
    Rule("proprietary", r"proprietary and confidential", "proprietary", 80, 0.9),
    Rule("without warranty", r"without warranty of any kind", "no-warranty", 40, 0.5),
    Rule("as is", r"provided as is without", "no-warranty", 40, 0.5),
    Rule("permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", "mit", 85, 0.95),
    Rule("redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", "bsd", 85, 0.95),
    Rule("permission to use", r"permission to use copy modify and or distribute this software for any purpose", "isc", 85, 0.95),
)


def rules() -> list[Rule]:
    out = list(SINGLE)
    for (label, keyword, name, version), (form, word, priority, confidence) in product(FAMILIES, FORMS):
        if version is None and form.endswith("{version}") and "(?: {version})" not in form or version is None and "{version} " in form and "(?: {version})" not in form:
            continue
        form = form.replace("(?: {version})?", "") if version is None else form.replace("{version}", version)
        out.append(Rule(keyword, form.replace("{name}", name), label, priority + NARROWER.get(label, 0), confidence, word))
    return sorted(out, key=lambda r: -r.priority)


# ---------------------------------------------------------------- expressions

#: What other letters turn into ASCII when lower-cased: the Kelvin sign, and the capital i with a dot.
TURNING = "Kİ"
_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, joined by single spaces, with a space before and after."""
    text = F.coalesce(text, F.lit(""))
    turning = F.contains(text, F.lit(TURNING[0])) | F.contains(text, F.lit(TURNING[1]))
    # lower() is much the faster; what else it changes is no separator, and in no rule.
    plain = F.regexp_replace(F.when(turning, F.translate(text, _A, _Z)).otherwise(F.lower(text)), SEPARATORS, " ")
    return F.concat(F.lit(" "), F.trim(plain), F.lit(" "))


_spaces = "(length({0}) - length(replace({0}, ' ', '')))".format


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def known() -> str:
    """SQL of all rules, grouped by keyword: structs (keyword, rules), the rules with their place in the order of priority."""
    groups: dict[str, list[str]] = {}
    for k, r in enumerate(rules()):
        # A match begins with the space before its first word and ends before the next space: it has as many spaces as words.
        own = f"named_struct('index', {k}, 'pattern', {_text(f' (?:{r.pattern})(?= )')}, 'form', {_text(r.form or f' {r.keyword}')}, 'label', '{r.label}', 'confidence', {r.confidence}D)"
        groups.setdefault(r.keyword, []).append(own)
    return "array(" + ", ".join(f"named_struct('keyword', ' {keyword}', 'rules', array({', '.join(own)}))" for keyword, own in groups.items()) + ")"


SPAN = "struct<s: int, e: int, label: string, confidence: double>"


def by_rule(words: str) -> str:
    """SQL of structs (index, found) of the rules that match, by priority; found: structs as SPAN, in words from 0."""
    active = f"flatten(transform(filter(__rules, g -> contains({words}, g.keyword)), g -> filter(g.rules, r -> contains({words}, r.form))))"
    matched = f"filter(transform({active}, r -> struct(r.index as index, r as r, regexp_extract_all({words}, r.pattern, 0) as m)), f -> size(f.m) > 0)"
    length = "transform(f.m, (m, i) -> {0} + {1})".format(_spaces("gaps[i]"), _spaces("m"))
    span = f"struct(at[i] + {_spaces('gaps[i]')} as s, at[i] + {_spaces('gaps[i]')} + {_spaces('m')} as e, f.r.label as label, f.r.confidence as confidence)"
    found = let("gaps", f"split({words}, f.r.pattern, -1)", let("n", length, let("at", running("n"), f"transform(f.m, (m, i) -> {span})")))
    return f"array_sort(transform({matched}, f -> struct(f.index as index, {found} as found)))"


def detections(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the number, first and last place of each base phrase, and `found`: the detections that stay, structs
    (s, e, label, confidence) with the place of the first word and of the one after the last, by priority."""
    forms = " or ".join(f"contains(__w, '{form}')" for form in sorted({r.form or f" {r.keyword}" for r in rules()}))
    df = docs.select("doc_id", words_of(F.col("text")).alias("__w"))
    n_words = F.when(F.length("__w") > 2, F.expr(f"{_spaces('__w')} - 1")).otherwise(0)
    # Split before each place: the first piece has a space before each of its words, the last one as many as words.
    pieces = [F.when(F.expr(f"contains(__w, ' {p} ')"), F.split("__w", f" (?={p} )", -1)).otherwise(F.array(F.lit(""))).alias(f"__p{k}") for k, p in enumerate(BASE)]
    df = df.select("doc_id", "__w", n_words.alias("n_words"), F.expr(forms).alias("__hit"), *pieces)
    places = [
        F.expr(f"if(size(__p{k}) > 1, struct(size(__p{k}) - 1 as n, {_spaces(f'__p{k}[0]')} as first, n_words - {_spaces(f'element_at(__p{k}, -1)')} as last), null)").alias(f"base{k}")
        for k in range(len(BASE))
    ]
    df = df.select("doc_id", "n_words", "__w", *places, F.when(F.col("__hit"), F.expr(known())).alias("__rules"))
    df = df.select("doc_id", "n_words", *[f"base{k}" for k in range(len(BASE))], F.when(F.col("__rules").isNotNull(), F.expr(by_rule("__w"))).alias("__all"))
    kept = f"aggregate(__all, cast(array() as array<{SPAN}>), (kept, d) -> concat(kept, {let('own', 'd.found', apart('own', 'kept'))}))"
    none = F.array().cast(f"array<{SPAN}>")
    return df.select("doc_id", "n_words", *[f"base{k}" for k in range(len(BASE))], F.when(F.size("__all") > 0, F.expr(kept)).otherwise(none).alias("found"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row of docs."""
    df = detections(docs)
    bases = [f"base{k}" for k in range(len(BASE))]
    base = F.array_compact(F.array(*[F.when(F.col(b).isNotNull(), F.lit(label)) for b, label in zip(bases, BASE.values())]))
    doubt = F.aggregate(F.col("found"), F.lit(1.0), lambda a, d: a * (1 - d["confidence"] * 0.999))
    doubt = F.when(F.size(base) > 0, doubt * 0.1).otherwise(doubt)
    return df.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        sum((F.coalesce(F.col(b)["n"], F.lit(0)) for b in bases), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[F.col(b)["first"] for b in bases]).cast("long").alias("first_word"),
        F.greatest(*[F.col(b)["last"] for b in bases]).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.expr("transform(found, d -> d.label)")))), ",").alias("labels"),
        (1 - doubt).alias("score"),
    )


def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spread(table(spark, sf_dir, "documents")))


def oracle() -> str:
    """SQL of the same result: every rule at every word of the texts that pass its gates, overlaps resolved one by one."""
    listed = ", ".join(
        f"({i}, ' {r.keyword}', '{r.form or ' ' + r.keyword}', '^(?:{r.pattern}) ', '{r.label}', {r.confidence!r}::double)" for i, r in enumerate(rules())
    )
    phrases = ", ".join(f"({k}, '{p}', '{label}')" for k, (p, label) in enumerate(BASE.items()))
    return f"""
with rules(idx, keyword, form, pattern, label, confidence) as (values {listed}),
base(k, phrase, label) as (values {phrases}),
texts as (
  select row_number() over () as r, doc_id, ' ' || trim(regexp_replace(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')) || ' ' as w
  from documents),
ends as (select r, doc_id, w, case when w = '  ' then [] else string_split(trim(w), ' ') end as words from texts),
places as (
  select r, b.label, unnest(list_filter(range(0, len(words)), lambda i: array_to_string(words[i + 1:i + len(string_split(b.phrase, ' '))], ' ') = b.phrase)) as pos
  from ends, base b where contains(w, ' ' || b.phrase || ' ')),
based as (select r, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list_sort(list(distinct label)) as labels from places group by r),
active as (select e.r, e.words, u.* from ends e join rules u on contains(e.w, u.keyword) and contains(e.w, u.form)),
spots as (select *, unnest(range(0, len(words))) as s from active),
tried as (select *, regexp_extract(array_to_string(words[s + 1:s + 40], ' ') || ' ', pattern) as m from spots),
hits as (select r, idx, label, confidence, s, s + length(m) - length(replace(m, ' ', '')) as e from tried where m <> ''),
own as (
  select r, unnest(list_reduce(list([{{'idx': idx, 's': s, 'e': e, 'label': label, 'confidence': confidence}}] order by s),
    lambda a, x: case when a[-1].e <= x[1].s then list_concat(a, x) else a end)) as d
  from hits group by r, idx),
kept as (
  select r, unnest(list_reduce(list([d] order by d.idx, d.s),
    lambda a, x: case when len(list_filter(a, lambda k: k.s < x[1].e and x[1].s < k.e)) = 0 then list_concat(a, x) else a end)) as d
  from own group by r),
found as (
  select r, list(distinct d.label) as labels, list_reduce(list(1 - d.confidence * 0.999 order by d.idx, d.s), lambda a, b: a * b) as doubt from kept group by r)
select e.doc_id, len(e.words)::bigint as n_words, coalesce(b.n_base, 0)::bigint as n_base, b.first_word::bigint as first_word, b.last_word::bigint as last_word,
  coalesce(array_to_string(b.labels, ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') as labels,
  1 - coalesce(f.doubt, 1.0) * (case when b.r is null then 1.0 else 0.1 end) as score
from ends e left join based b using (r) left join found f using (r)
"""
