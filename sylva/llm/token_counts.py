"""Token counts of a document's sections by offset-mapped attribution.

A document is encoded whole, once, with a byte-level BPE; its tokens are byte spans that tile the text, so their
character spans follow from their lengths.  Sections are the lines of the text, a line with its line end, or spans
given by a `sections` column.  Tokens are joined to sections by interval: a token inside one section is that
section's; a token that crosses a boundary is given by the rule

  first     to the section with its first character,
  largest   to the section with most of its bytes, to the earlier of equals,
  share     to each section, in the share of its bytes.

Edge cases: null and empty texts have one empty section with no tokens; a text's sections always tile it, so their
counts sum to the count of the whole; a text that is not valid UTF-16 has its lone surrogates replaced; repeated rows
are counted alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, spread, table, texts_of

RULES = ("first", "largest", "share")
SCHEMA = "section int, start long, length long, n_tokens long, n_crossing long, tokens double"

_encoders: dict[tuple[str, str], tuple] = {}


def encoder(path: str, pattern: str):
    """(encoding, bytes of each id) of a ranks file; one per Python worker."""
    if (path, pattern) not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            size[i] = len(token)
        encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _encoders[path, pattern] = encoding, size
    return _encoders[path, pattern]


def attribute(tokens: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per section: whole tokens by the rule (its floor for `share`), tokens that cross its start, and the exact count.

    tokens, sections: byte positions at which they begin, and a last entry, the end of the text.
    """
    n = len(sections) - 1
    begin, end = tokens[:-1], tokens[1:]
    first = np.searchsorted(sections[1:-1], begin, side="right")
    last = np.searchsorted(sections[1:-1], end, side="left") if len(begin) else first
    crossing = np.flatnonzero(last > first)
    exact = np.bincount(first[last == first], minlength=n).astype(float)
    crossed = np.zeros(n, np.int64)
    for t in crossing:  # few: pre-tokenisation ends most tokens at line ends
        own = np.arange(first[t], last[t] + 1)
        cut = np.clip(sections[np.append(own, own[-1] + 1)], begin[t], end[t])
        share = np.diff(cut) / (end[t] - begin[t])
        crossed[own[1:]] += 1
        if rule == "share":
            exact[own] += share
        else:
            exact[own[0] if rule == "first" else own[share.argmax()]] += 1
    return np.floor(exact + 1e-9).astype(np.int64), crossed, exact


def section_counts(
    docs: DataFrame, tokenizer_path: str | None = None, pattern: str | None = None, rule: str = "largest", sections: str | None = None
) -> DataFrame:
    """One row for each section of each document.

    sections: a column of arrays of increasing code-point positions at which sections begin; 0 is implied and
    positions outside the text are ignored.  Without it, sections are lines.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        encoding, size = encoder(tokenizer_path, pattern)
        given = b.column("sections").to_pylist() if sections else [None] * b.num_rows
        columns = [[] for _ in range(7)]
        for place, (text, at) in enumerate(zip(texts_of(b), given)):
            raw = text.encode("utf-8", "replace")
            buf = np.frombuffer(raw, np.uint8)
            ids = encoding.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)
            tokens = np.concatenate([[0], np.cumsum(size[ids])])
            chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])  # code points before each byte
            if at is None:
                inner = np.flatnonzero(buf == 10) + 1
            else:
                wanted = np.unique(np.array([p for p in at if p is not None and 0 < p < chars[-1]], np.int64))
                inner = np.searchsorted(chars, wanted + 1) - 1
            cuts = np.concatenate([[0], inner[inner < len(raw)], [len(raw)]]).astype(np.int64)
            whole, crossed, exact = attribute(tokens, cuts, rule)
            where = chars[cuts]
            n = len(cuts) - 1
            for column, values in zip(columns, ([place] * n, range(n), where[:-1], np.diff(where), whole, crossed, exact)):
                column.append(np.asarray(values))
        flat = [b.column("doc_id").take(pa.array(np.concatenate(columns[0]).astype(np.int64)))]
        for c, kind in zip(columns[1:], (pa.int32(), *[pa.int64()] * 4, pa.float64())):
            flat.append(pa.array(np.concatenate(c)).cast(kind))
        return pa.RecordBatch.from_arrays(flat, ["doc_id", *(f.split()[0] for f in SCHEMA.split(", "))])

    wanted = ["doc_id", "text"]
    if sections:
        wanted.append(F.col(sections).cast("array<long>").alias("sections"))
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(SCHEMA)]
    return map_arrow(docs.select(*wanted), count, T.StructType(fields))


def op1_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_counts(spread(table(spark, sf_dir, "documents")))
