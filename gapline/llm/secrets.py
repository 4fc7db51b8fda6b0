"""Secret scans: an Aho-Corasick pass over keywords, anchored patterns only at its hits, then embedded checksums."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.common import col

# The patterns, their least lengths, and the prefixes of tokens that end in a checksum.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
KEYWORDS = ["password", "passwd", "secret", "token", "api_key", "apikey", "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"]
KINDS = ["assign", "access", "hex", "checked"]
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

UPPER = {c: c + 32 for c in range(65, 91)}
RUN = re.compile(r"[0-9a-f]{32}")


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in KEYWORDS:
        a.add_word(w, (len(w), "assign" if w in KEYWORDS[:6] else "access" if w == "akia" else "checked"))
    a.make_automaton()
    return a


def checksum_holds(body: str, check: str) -> bool:
    """Whether check is the CRC-32 of body, in base 62 with leading zeros."""
    n, digits = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        digits = BASE62[r] + digits
    return digits.rjust(6, "0") == check


def spans(text: str, a: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then as KINDS has them."""
    low = text.lower()
    if len(low) != len(text):  # some letters grow when lower-cased
        low = text.translate(UPPER)
    starts: dict[str, list[int]] = {"assign": [], "access": [], "checked": []}
    for end, (n, kind) in a.iter(low):
        starts[kind].append(end - n + 1)
    found = []
    past = -1
    for s in sorted(set(starts["assign"])):
        if s >= past and (m := ASSIGN.match(text, s)):
            past = m.end()
            if len(m[2]) >= 8:
                found.append(("assign", s, past))
    past = -1
    for s in starts["access"]:
        if s >= past and (m := ACCESS.match(text, s)):
            past = m.end()
            if past - s >= 16:
                found.append(("access", s, past))
    at = 0
    while m := RUN.search(text, at):  # the scan's leftmost run of 32; what stands before it in the same run can't be longer
        m = HEX.match(text, m.start())
        found.append(("hex", *m.span()))
        at = m.end()
    past = -1
    for s in sorted(starts["checked"]):
        if s >= past and (s == 0 or not (text[s - 1].isascii() and text[s - 1].isalnum())) and (m := CHECKED.match(text, s)) and checksum_holds(m[1], m[2]):
            past = m.end()
            found.append(("checked", s, past))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_checked, base_sha256, spans) for every row of docs.

    Kinds assign, access and hex are the base; kind checked adds tokens whose last six characters are the CRC-32 of
    the thirty before. Null and empty texts have no spans. Repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in b.column(1).to_pylist():
                found = spans(text or "", a)
                told = [f"{k}:{s}:{e}" for k, s, e in found]
                kinds = [k for k, _, _ in found]
                base = ",".join(x for x, k in zip(told, kinds, strict=True) if k != "checked")
                for to, x in zip(out, (*map(kinds.count, KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(told)), strict=True):
                    to.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out, kinds)], ["doc_id", "n_assign", "n_access", "n_hex", "n_checked", "base_sha256", "spans"])

    kept = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    return kept.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string")
