"""Secret scans with linking of credentials that come in several parts.

Base patterns (assignments, access identifiers, hexadecimal strings) are always
reported. Besides them there are weak candidates: account names, unlabelled random
strings and endpoints. Each has a role (identifier, secret, endpoint); so have the base
spans. A scope is a block of lines without an empty line in it. Complementary parts are
an identifier or an endpoint with a secret; parts that overlap are none. A weak candidate
is reported only if its scope holds a complement, at any distance. An interval join over
sorted starts and ends links each part of a scope with its nearest complement, so a scope
of n parts has n links at most, not all pairs. Cost follows n log n of a document's
candidates, and nothing is shuffled.

Null texts count as empty and give no span. Repeated rows give a row each; ties of start
are ordered by kind, and of two complements at one distance the one before is linked. Columns besides the named ones are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import DataFrame

from .common import map_batches

#: Bits a character from which an unlabelled string counts as random.
ENTROPY = 3.5

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "ident", "random", "endpoint")
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "ident": "identifier", "random": "secret", "endpoint": "endpoint"}
KEYWORD = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)

# Weak candidates.
IDENT = re.compile(r"""(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?|email)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{2,})""", re.IGNORECASE | re.ASCII)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}", re.ASCII)
ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])(?::[0-9]{2,5})?""", re.ASCII)
BREAK = re.compile(r"\n[ \t\r]*\n")


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of kind) of the base patterns."""
    found = []
    if KEYWORD.search(text):
        found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(*m.span(), 2) for m in HEX.finditer(text)]


def weak_spans(text: str) -> list[tuple[int, int, int]]:
    found = []
    if "=" in text or ":" in text:
        found += [(*m.span(), 3) for m in IDENT.finditer(text)]
    found += [(*m.span(), 4) for m in RANDOM.finditer(text) if entropy(m.group()) >= ENTROPY]
    return found + [(*m.span(), 5) for m in ENDPOINT.finditer(text)]


class Intervals:
    """Spans sorted by both ends, for the nearest one beside another and for those that overlap it."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.by_start, self.by_end = sorted(spans), sorted(spans, key=lambda s: (s[1], s[0], s[2]))
        self.starts, self.ends = [s[0] for s in self.by_start], [s[1] for s in self.by_end]

    def nearest(self, p: tuple[int, int, int]) -> tuple[int, int, int] | None:
        """The nearest span that does not overlap p."""
        i, j = bisect_right(self.ends, p[0]), bisect_left(self.starts, p[1])
        before, behind = self.by_end[i - 1] if i else None, self.by_start[j] if j < len(self.starts) else None
        if before is None or behind is None:
            return before or behind
        return before if p[0] - before[1] <= behind[0] - p[1] else behind

    def overlapping(self, p: tuple[int, int, int]) -> list[tuple[int, int, int]]:
        """Spans that overlap p, where no two of the spans overlap each other."""
        return self.by_start[bisect_right(self.ends, p[0]) : bisect_left(self.starts, p[1])]


def role(span: tuple[int, int, int]) -> str:
    return ROLE[KINDS[span[2]]]


def linked(parts: list[tuple[int, int, int]], breaks: list[int]) -> tuple[set, list[tuple]]:
    """The weak parts that have a complement in their scope, and links (secret, other part): each part with its nearest."""
    links = set()
    by_scope: dict[int, tuple[list, list]] = {}
    for p in parts:
        by_scope.setdefault(bisect_left(breaks, p[0]), ([], []))[role(p) != "secret"].append(p)
    for secrets, others in by_scope.values():
        if secrets and others:
            a, b = Intervals(secrets), Intervals(others)
            links |= {(p, q) for p in secrets if (q := b.nearest(p))}
            links |= {(p, q) for q in others if (p := a.nearest(q))}
    return {x for link in links for x in link if x[2] >= 3}, sorted(links)


def find(text: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Base spans, linked weak spans and links of a text."""
    base = base_spans(text)
    weak = weak_spans(text)
    if not weak:
        breaks = [m.start() for m in BREAK.finditer(text)] if len(base) > 1 else []
        return base, [], linked(base, breaks)[1] if len(base) > 1 else []
    # A weak span that a base span covers, or meets in the same role, is that part already; other identifiers and endpoints remain partners.
    of_kind = [Intervals([b for b in base if b[2] == k]) for k in range(3)] if base else []
    same = lambda b, w: role(w) in ("secret", role(b)) or b[0] <= w[0] and w[1] <= b[1]
    weak = [w for w in weak if not any(same(b, w) for x in of_kind for b in x.overlapping(w))]
    kept, links = linked(base + weak, [m.start() for m in BREAK.finditer(text)])
    return base, sorted(kept), links


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_links long, links array<string>"
NAMES = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_links", "links")


def scan(df: DataFrame) -> DataFrame:
    """A row per document: counts of base kinds, all spans and the links between parts."""

    def batch(rows: dict) -> dict:
        out: dict = {c: [] for c in NAMES}
        for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
            base, weak, links = find(text or "")
            n = Counter(k for _, _, k in base)
            for c, v in zip(NAMES, (doc_id, n[0], n[1], n[2], hashlib.sha256(show(base).encode()).hexdigest(), show(base + weak), len(links), [f"{show([a])}~{show([b])}" for a, b in links]), strict=True):
                out[c].append(v)
        return out

    return map_batches(df.select(df["doc_id"].cast("long").alias("doc_id"), df["text"].cast("string").alias("text")), batch, SCHEMA)
