"""Offset-mapped token counts: tokens of whole documents, attributed to fields or sections.

Each document is encoded once. The lengths of its tokens' bytes give their offsets, which are mapped to
characters; a token spans every character of which it holds a byte. Token spans are joined to section
spans by interval, with binary searches over the sorted ends, and a token that crosses a boundary is
allocated by one of three rules:

- start: to the section of its first character;
- majority: to the section that holds most of its characters, the earlier one of equals;
- share: to each section the share of its characters that lies there.

Tokens outside every section are counted under a section of their own, numbered -1. By default the
sections are lines, each with the line break that ends it.

Edge cases: a null or empty text has one empty line with no tokens; an empty section has none; ids may be
null or repeat, since each row is encoded by itself; the strings of special tokens are ordinary text; a very long text
is encoded whole, with its long runs of blanks apart, as PATTERN cuts them; where two sections hold equally much of a token the earlier one gets it; other columns, whatever their
names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import in_slices, utf8

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are cut into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of blanks this long are encoded by themselves: the pattern's search for what stands behind them needs a stack as deep
#: as the run. The tokens are the same, as the pattern cuts a run off too: whole at the text's end, else without its last blank.
LONG_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")
RULES = ("start", "majority", "share")
SCHEMA = "doc_id long, section int, start int, end int, tokens double, crossing long"


@lru_cache(maxsize=2)
def _encoder(ranks: bytes, pattern: str, _key: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    sizes = np.zeros(max(table.values()) + 1, np.int64)
    for piece, rank in table.items():
        sizes[rank] = len(piece)
    return tiktoken.Encoding("offsets", pat_str=pattern, mergeable_ranks=table, special_tokens={}), sizes


def encode(encoding, text: str) -> list[int]:
    """The tokens of a text that may hold long runs of blanks."""
    out, at = [], 0
    for run in LONG_RUN.finditer(text):
        out += encoding.encode_ordinary(text[at : run.start()])
        at = run.end() if run.end() == len(text) else run.end() - 1
        out += encoding._encode_single_piece(text[run.start() : at])
    return out + encoding.encode_ordinary(text[at:])


class Encoder:
    """A byte-level BPE vocabulary, read once on the driver and sent with the task (about 1 MB)."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        try:
            with open(path, "rb") as f:
                self.ranks = f.read()
        except OSError as e:
            raise ValueError(f"no vocabulary can be read at {path}: give the path of one in the .tiktoken format") from e
        self.pattern, self.key = pattern, hashlib.sha256(self.ranks).hexdigest()

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Character starts and ends of the tokens."""
        encoding, sizes = _encoder(self.ranks, self.pattern, self.key)
        ids = np.array(encode(encoding, text), np.int64)
        ends = np.cumsum(sizes[ids])
        starts = ends - sizes[ids]
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) == len(text):
            return starts, ends
        lead = (raw & 0xC0) != 0x80
        before = np.concatenate([[0], np.cumsum(lead)])  # characters that begin before each byte
        return before[starts] - ~lead[starts], before[ends]


def line_ends(text: str) -> np.ndarray:
    """Ends of the lines, each with its line break."""
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.nonzero(raw == 10)[0] + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


def allocate(starts: np.ndarray, ends: np.ndarray, sections: list[tuple[int, int]], rule: str = "start") -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens of each section, tokens of each section that cross its edge, and tokens outside all.

    sections: disjoint (start, end) in ascending order."""
    lo, hi = (np.array([s[i] for s in sections], np.int64) for i in (0, 1))
    first = np.searchsorted(hi, starts, side="right")  # the first section that ends after the token's start
    past = np.searchsorted(lo, ends, side="left")  # one past the last section that begins before its end
    counts, crossing, outside = np.zeros(len(lo)), np.zeros(len(lo), np.int64), 0.0
    met = past - first
    whole = (met == 1) & (starts >= lo[np.minimum(first, len(lo) - 1)]) & (ends <= hi[np.minimum(first, len(lo) - 1)])
    counts += np.bincount(first[whole], minlength=len(lo))
    outside += float((met <= 0).sum())
    for t in np.nonzero((met > 0) & ~whole)[0]:
        a, b = starts[t], ends[t]
        held = [(s, int(min(b, hi[s]) - max(a, lo[s]))) for s in range(first[t], past[t])]
        held = [x for x in held if x[1] > 0]
        if not held:  # only empty sections lie there
            outside += 1
            continue
        for s, _ in held:
            crossing[s] += 1
        if rule == "share":
            for s, n in held:
                counts[s] += n / (b - a)
            outside += 1 - sum(n for _, n in held) / (b - a)
        elif rule == "majority":
            counts[max(held, key=lambda x: (x[1], -x[0]))[0]] += 1
        elif lo[held[0][0]] <= a:
            counts[held[0][0]] += 1
        else:
            outside += 1
    return counts, crossing, outside


def attribute(df: DataFrame, rule: str = "start", encoder: Encoder | None = None, sections: str | None = None) -> DataFrame:
    """(doc_id, section, start, end, tokens, crossing) for each section of each row of (doc_id, text).

    sections: the name of an array<struct<start: int, end: int>> column, disjoint and ascending; lines if None."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = df.sparkSession.sparkContext.broadcast(encoder or Encoder())

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            given = batch.column(2) if sections else [None] * batch.num_rows
            for doc_id, data, own in zip(batch.column(0), batch.column(1), given, strict=True):
                text = data.as_py().decode("utf-8", "replace")
                if sections:
                    spans = [(s["start"], s["end"]) for s in own.as_py() or []]
                else:
                    ends = line_ends(text).tolist()
                    spans = list(zip([0, *ends[:-1]], ends, strict=True))
                starts, ends = shared.value.spans(text)
                counts, crossing, outside = allocate(starts, ends, spans, rule) if spans else (np.zeros(0), np.zeros(0, np.int64), float(len(starts)))
                rows = [(i, s, e, float(n), int(c)) for i, ((s, e), n, c) in enumerate(zip(spans, counts, crossing, strict=True))]
                if outside > 1e-9:
                    rows.append((-1, None, None, outside, 0))
                out[0] += [doc_id.as_py()] * len(rows)
                for k in range(5):
                    out[k + 1] += [r[k] for r in rows]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "section", "start", "end", "tokens", "crossing"])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("data"), *([F.col(sections)] if sections else [])]
    return df.select(*columns).transform(in_slices, run, SCHEMA)


def join_fields(df: DataFrame, fields: list[str], separator: str = "\n") -> DataFrame:
    """Adds text, the fields (null: empty) joined by the separator, and field_spans for attribute(sections=...)."""
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    spans, at = [], F.lit(0)
    for v in values:
        end = at + F.char_length(v)
        spans.append(F.struct(at.cast("int").alias("start"), end.cast("int").alias("end")))
        at = end + len(separator)
    return df.withColumn("text", F.concat_ws(separator, *values)).withColumn("field_spans", F.array(*spans))
