"""Secret scans with multipart credential linking.

Three kinds of spans are reported wherever they stand: assignments to a secret's name, access identifiers and long
hexadecimal strings. Credentials of several parts are weaker evidence: a login name, an unnamed random-looking
string or a service address says little alone. Such *weak* spans are reported only where complementary parts stand
together: an interval join matches every weak span with the parts that lie within ``REACH`` code points of it and
inside the same scope (text between blank lines), and a credential is complete when it has an identifier, a secret
and either of them is not weak, or all three parts (identifier, secret, endpoint) are there. The values of
``key=value`` forms are random-looking strings like any others, whatever their key is called.

Linking stops at ``REACH`` although a scope may be longer: a text without blank lines is one scope, and over its whole
length an identifier at one end would make secrets of random-looking strings (digests, identifiers of files) at the other.

All of a document's spans come from its own text, so documents are scanned where they are read; nothing is shuffled.
Null text counts as empty and has no spans. Repeated rows give repeated results. Input columns named like an added
column are replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from hashlib import sha256

from pyspark.sql import DataFrame

from catchwise.llm.common import map_text

Span = tuple[str, int, int]

#: The kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
REACH = 240

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Any assignment, or any identifier, holds one of these in lower case.
ASSIGN_HINTS = ("passw", "secret", "token", "api")
IDENTIFIER_HINTS = ("user", "login", "account", "client", "key", "asia")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Parts of credentials that count only together.
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9_])(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}|(?<![A-Za-z0-9])ASIA[A-Z0-9]{12,}""", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{4,}|\b(?:host|server|endpoint|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,}""", re.IGNORECASE | re.ASCII)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
SCOPE = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str, lower: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind, without those that are too short."""
    out: list[Span] = []
    if any(h in lower for h in ASSIGN_HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def looks_random(value: str) -> bool:
    """Mixed characters that repeat as little as random ones do."""
    if not (any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= 0.8 * math.log2(min(n, 64))


def joined(left: list[Span], right: list[Span], scopes: list[int]) -> dict[int, list[int]]:
    """Interval join: for each span of ``left``, the spans of ``right`` within ``REACH`` and in its scope.

    ``right`` is ordered by start; a span belongs to the scope in which it starts, so candidates are one slice.
    """
    starts = [s for _, s, _ in right]
    longest = max((e - s for _, s, e in right), default=0)
    out = {}
    for i, (_, start, end) in enumerate(left):
        at = bisect_right(scopes, start)
        low = scopes[at - 1] if at else 0
        high = scopes[at] if at < len(scopes) else end + REACH + 1
        picked = [j for j in range(bisect_left(starts, max(low, start - REACH - longest)), bisect_left(starts, min(high, end + REACH + 1))) if right[j][2] >= start - REACH]
        if picked:
            out[i] = picked
    return out


def weak_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak parts that stand together with their complements."""
    identifiers = [("identifier", *m.span()) for m in IDENTIFIER.finditer(text)]
    strong_ids = [s for s in base if s[0] == "access"]
    endpoints = [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    if not identifiers and not strong_ids:
        return []
    by_start = lambda spans: sorted(spans, key=lambda s: s[1:])
    strong = [s for s in base if s[0] != "access"]
    free = lambda s, taken: all(e <= s[1] or b >= s[2] for _, b, e in taken)
    taken = base + identifiers + endpoints
    secrets = [s for m in RANDOM.finditer(text) if looks_random(m[0]) and free(s := ("secret", *m.span()), taken)]
    ids, keys = by_start(strong_ids + [s for s in identifiers if free(s, base)]), by_start(strong + secrets)
    endpoints = by_start([s for s in endpoints if free(s, base)])
    scopes = [m.end() for m in SCOPE.finditer(text)]
    near_keys, near_ends = joined(ids, keys, scopes), joined(ids, endpoints, scopes)
    found: set[Span] = set()
    for i, picked in near_keys.items():
        ends = [endpoints[j] for j in near_ends.get(i, [])]
        for key in (keys[j] for j in picked):
            if ends or ids[i][0] == "access" or key[0] != "secret":
                found |= {ids[i], key, *ends}
    return list(found - set(base))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan_text(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and those that linking adds."""
    if not text:
        return [], []
    lower = text.lower()
    base = base_spans(text, lower)
    hinted = any(kind == "access" for kind, _, _ in base) or any(h in lower for h in IDENTIFIER_HINTS)
    return base, weak_spans(text, base) if hinted else []


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds counts of the base kinds, the digest of the base spans and all spans as ``kind:start:end``, comma-joined."""

    def run(texts: list[str | None]) -> list:
        rows = []
        for t in texts:
            base, more = scan_text(t)
            n = Counter(k for k, _, _ in base)
            rows.append((n["assign"], n["access"], n["hex"], sha256(listed(base).encode()).hexdigest(), listed(base + more)))
        return list(zip(*rows, strict=True)) if rows else [[]] * 5

    return map_text(df, [text], run, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every secret in ``text`` replaced; other text, null included, stays as it is."""

    def run(texts: list[str | None]) -> list:
        out = []
        for t in texts:
            spans = sum(scan_text(t), [])
            out.append(redacted(t, spans) if spans else t)
        return [out]

    return map_text(df, [text], run, f"`{text}` string").select(*df.columns)
