"""Operator 4: secret scan with dictionary-primed zstandard novelty.

Three patterns find the usual secrets. Beyond them, every string of 20 or more code
characters that stands in a sensitive context is measured: how many
bytes does zstandard need for it when its dictionary is a list of common identifiers and
the code around it? A string that costs nearly its own length is new to both (a key, not a
name) and is reported as ``novel``. A map over whole texts: nothing is shuffled.

Edge cases: a null text is empty; an empty text has no span; offsets count code points;
rows come back one for one with doc_id as it is; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The patterns of the three kinds, each with its least length and the group that has it.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
KINDS = ("assign", "access", "hex", "novel")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SIDE = re.compile(r"[A-Za-z0-9+/_-]+=*")
SENSITIVE = re.compile(r"pass(?:word|wd|phrase)?|secret|token|key|auth|bearer|credential|private|signature", re.IGNORECASE)
IDENTIFIERS = (
    b"application authorization authentication background callback certificate client configuration connection constructor "
    b"container content controller credentials database default description directory document element encoding environment "
    b"exception expression extension function generator identifier implementation import index information initialize instance "
    b"interface iterator library listener location manager message method middleware namespace notification object operation "
    b"options parameter password performance permission postgres prefix private processor production property protocol provider "
    b"public query reference repository request resource response schema secret security serializer server service session "
    b"settings signature source standard statement storage string subscription template timestamp token transaction transport "
    b"undefined update username validation value variable version workspace abcdefghijklmnopqrstuvwxyz 0123456789 get_ set_ _id _key _name"
)
SPANS = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_spans string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns' matches that are long enough."""
    found = []
    for kind, (_, pattern, group, least) in enumerate(BASE):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def novelty(candidate: str, around: str) -> float:
    """Marginal compressed bytes of ``candidate`` over its length, given the identifiers
    and the text around it. It is measured in equal windows of under 64 characters: from 64
    on zstandard codes literals by their frequency, and a long key would seem less new."""
    import zstandard

    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b" " + around.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    size = lambda s: len(zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False).compress(s))
    data = candidate.encode()
    n = -(-len(data) // 63)
    edges = [len(data) * k // n for k in range(n + 1)]
    none = size(b"")
    return sum(size(data[a:b]) - none for a, b in zip(edges, edges[1:], strict=False)) / len(data)


def pieces(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, start of the candidate) of the sides of each candidate's equals signs
    that are long enough, a side with its padding; of the whole candidate where none is."""
    for m in CANDIDATE.finditer(text):
        sides = [s.span() for s in SIDE.finditer(text, *m.span()) if s.end() - s.start() >= 20]
        yield from ((a, b, m.start()) for a, b in sides or [m.span()])


def novel_spans(text: str, known: list[tuple[int, int, int]], *, context: int, around: int, threshold: float) -> list[tuple[int, int, int]]:
    """Incompressible strings with letters and digits just after a sensitive word, which may
    be the name before their equals sign; of each what is outside the known spans."""
    found = []
    for a, b, first in pieces(text):
        s = text[a:b]
        if not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
            continue
        over = [(x, k, e) for x, k, e in known if a < e and x < b]
        # the name of an assignment that is known, or nothing left to find
        if any(k == 0 and a < x for x, k, _ in over) or not SENSITIVE.search(text, max(0, first - context), a):
            continue
        rest, at = [], a
        for x, _, e in [*over, (b, 3, b)]:
            if x > at and any(c.isalnum() for c in text[at:x]):
                rest.append((at, 3, x))
            at = max(at, e)
        if rest and novelty(s, text[max(0, a - around) : a] + text[b : b + around]) >= threshold:
            found += rest
    return found


def scan(docs: DataFrame, *, context: int = 48, around: int = 512, threshold: float = 0.9) -> DataFrame:
    """Counts and spans (kind:start:end, comma-joined by start, then kind) per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                new = novel_spans(text, base, context=context, around=around, threshold=threshold)
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                say = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
                rows.append((*n, len(new), say(base), say(sorted(base + new))))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            arrays = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_spans", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SPANS)


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (doc_id, text) with every span replaced by its kind in brackets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = {"context": 48, "around": 512, "threshold": 0.9} | options
        for batch in batches:
            out = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                at, parts = 0, []
                for a, k, b in sorted(base + novel_spans(text, base, **o)):
                    if a >= at:
                        parts += [text[at:a], f"[{KINDS[k]}]"]
                        at = b
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, text string")


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
