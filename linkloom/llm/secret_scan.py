"""Secret scans: named patterns, then sliding-window Shannon entropy over candidate strings.

A candidate is a run of 20 or more characters of ``[A-Za-z0-9+/_=-]`` that holds a digit
and a letter. It is a secret if a 20-character window has an entropy above the bound of
the string's character class (hex, alphanumeric, base64). Counts move by one character in
and one out per step. Allow-list patterns and strings that overlap a named pattern are
left out.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import map_arrow, table

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a leftmost maximal run of 32 or more
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ALLOW = (
    re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE),  # UUIDs
    re.compile(r"(?:EXAMPLE|example|xxxx|XXXX|0000000|1234567)"),  # placeholders
    re.compile(r"[A-Za-z]+(?:[-_/][A-Za-z]+)+(?:[-_/]\d+)?"),  # slugs and paths
    re.compile(r"[\d+/_=-]+"),  # numbers and rules
)
WINDOW = 20
BITS = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}
KINDS = ("assign", "access", "hex", "entropy")


def window_entropy(text: str, width: int = WINDOW) -> float:
    """Largest Shannon entropy, in bits, of a window of ``width`` characters."""
    counts: dict[str, int] = {}
    total = 0.0  # sum of c log2 c over the counts
    best = 0.0
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        total += (c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0.0)
        counts[ch] = c + 1
        if i >= width:
            old = text[i - width]
            c = counts[old]
            total -= c * math.log2(c) - ((c - 1) * math.log2(c - 1) if c > 1 else 0.0)
            counts[old] = c - 1
        if i >= width - 1:
            best = max(best, math.log2(width) - total / width)
    return best


def char_class(text: str) -> str:
    if all(c in "0123456789abcdefABCDEF" for c in text):
        return "hex"
    return "alnum" if text.isalnum() else "base64"


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, sorted by start and then kind."""
    text = text or ""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found = list(CANDIDATE.finditer(text))
    if found:  # a hex run of 32 lies within a candidate
        out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    named = list(out)
    for m in found:
        s = m[0]
        if not any(c.isdigit() for c in s) or not any(c.isalpha() for c in s):
            continue
        if any(a < m.end() and m.start() < b for a, b, _ in named):
            continue
        if any(p.fullmatch(s) for p in ALLOW) or ALLOW[1].search(s):
            continue
        if window_entropy(s) >= BITS[char_class(s)]:
            out.append((m.start(), m.end(), 3))
    return [(a, b, KINDS[k]) for a, k, b in sorted((a, k, b) for a, b, k in out)]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``found`` (array of start, end, kind) of every row.

    A null text counts as empty; texts of any length are read whole. Spans of one kind don't overlap, those of different
    kinds may; of spans that begin together the kind listed first comes first. Repeated rows give repeated results, an
    empty table none; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> dict:
        found = [find_spans(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "found": [[{"start": a, "end": b, "kind": k} for a, b, k in f] for f in found]}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, found array<struct<start:int,end:int,kind:string>>")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same rows with every span replaced by ``mark``; touching spans are replaced as one.

    Columns stay as they are but for ``text`` and, if there, ``n_chars``. A null text stays null.
    """

    def clean(text: str | None) -> str | None:
        at, out = 0, []
        for a, b, _ in find_spans(text):
            if b > at:
                if a > at or not out:
                    out += [text[at:a], mark]
                at = b
        return text if not out else "".join(out) + text[at:]

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        return pa.array([clean(t) for t in texts.to_pylist()], pa.string())

    out = docs.withColumn("text", cleaned("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batch: pa.RecordBatch) -> dict:
        ids, found = batch.column(0), batch.column(1).to_pylist()
        text = [[f"{s['kind']}:{s['start']}:{s['end']}" for s in f] for f in found]
        base = [",".join(x for x in t if not x.startswith("entropy")) for t in text]
        return {
            "doc_id": ids,
            **{f"n_{k}": [sum(s["kind"] == k for s in f) for f in found] for k in KINDS},
            "base_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in base],
            "spans": [",".join(t) for t in text],
        }

    found = scan(table(spark, sf_dir, "documents"))
    return map_arrow(found, digest, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")
