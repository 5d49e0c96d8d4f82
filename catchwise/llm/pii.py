"""Format-preserving pseudonyms for personal data.

A value is reported only if it is valid: card numbers pass the Luhn test, bank accounts their check digits, social
security and telephone numbers their numbering rules, addresses their ranges, dates the calendar. Every valid value
has a rank among the values of its format; a keyed Feistel network permutes the ranks, and the value of the new rank
is written in the old one's separators, so the text keeps its shape, pseudonyms are valid again, and equal values get
equal pseudonyms in every document under one key. The permutation used is ``P^-1(P(x) + 1)``, which never leaves a
value as it was.

A detector's match that is invalid or overlaps an earlier detector's value hides none: the match is tried again up to
each earlier space, and the search goes on from its next place. Cards may stand among other numbers, so all windows of
digit groups are tried; windows in a layout that cards are printed in come first, then from left to right the longest.
One in ten windows passes the Luhn test by chance, so in other layouts a part of a row of numbers must also begin and be
as long as some issuer's cards; what passes both in a list of numbers is reported like a card.

Documents are rewritten where they are read. Null text stays null and has no spans; repeated rows give repeated
results. Input columns named like an added column are replaced.
"""

from __future__ import annotations

import datetime
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import accumulate

from pyspark.sql import DataFrame

from catchwise.llm.common import map_text

ROUNDS = 8
#: Key of the registered query; production callers pass their own.
DEMO_KEY = b"demonstration key"


def _feistel(x: int, bits: int, key: bytes, tweak: bytes, back: bool) -> int:
    """Balanced Feistel network over ``bits`` (even) bits."""
    half = bits // 2
    mask, size = (1 << half) - 1, (half + 7) // 8
    left, right = x >> half, x & mask
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        fed = left if back else right
        mixed = int.from_bytes(blake2b(fed.to_bytes(size, "big") + bytes([r]) + tweak, key=key[:64], digest_size=max(8, size)).digest(), "big") & mask
        left, right = (right ^ mixed, left) if back else (right, left ^ mixed)
    return left << half | right


def permuted(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 to ``n`` - 1 without fixed points (for ``n`` over 1), by cycle walking and a shifted conjugate."""
    if n < 2:
        return x
    bits = max(2, (n - 1).bit_length() + (n - 1).bit_length() % 2)
    sign = f"{tweak}:{n}".encode()

    def walk(value: int, back: bool) -> int:
        while True:
            value = _feistel(value, bits, key, sign, back)
            if value < n:
                return value

    return walk((walk(x, False) + 1) % n, True)


def luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    return -sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def _refill(shape: str, chars: str) -> str:
    """``shape`` with its letters and digits replaced in order."""
    rest = iter(chars)
    return "".join(next(rest) if c.isalnum() else c for c in shape)


def _digits(shape: str) -> str:
    return re.sub(r"\D", "", shape)


def _card(shape: str, key: bytes) -> str | None:
    d = _digits(shape)
    if not 13 <= len(d) <= 19 or int(d[-1]) != luhn(d[:-1]) or len(set(d)) == 1:
        return None
    body = f"{permuted(int(d[:-1]), 10 ** (len(d) - 1), key, 'card'):0{len(d) - 1}d}"
    return _refill(shape, body + str(luhn(body)))


def _ssn(shape: str, key: bytes) -> str | None:
    area, group, serial = (int(x) for x in shape.split("-"))
    if area in (0, 666) or area >= 900 or group == 0 or serial == 0:
        return None
    areas = [a for a in range(1, 900) if a != 666]
    rank = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
    rank = permuted(rank, len(areas) * 99 * 9999, key, "ssn")
    return f"{areas[rank // (99 * 9999)]:03d}-{rank // 9999 % 99 + 1:02d}-{rank % 9999 + 1:04d}"


def _nanp(shape: str, key: bytes) -> str | None:
    d = _digits(shape)
    lead, own = (d[:-10], d[-10:]) if len(d) in (10, 11) else ("", "")
    if lead not in ("", "1") or len(own) != 10 or own[0] in "01" or own[3] in "01":
        return None
    rank = ((int(own[0]) - 2) * 100 + int(own[1:3])) * 8_000_000 + int(own[3:]) - 2_000_000
    rank = permuted(rank, 800 * 8_000_000, key, "nanp")
    return _refill(shape, f"{lead}{rank // 8_000_000 + 200}{rank % 8_000_000 + 2_000_000}")


def _phone(shape: str, key: bytes) -> str | None:
    d = _digits(shape)
    if not 8 <= len(d) <= 15 or d[0] == "0":
        return None
    head, body = d[:2], d[2:]
    return _refill(shape, head + f"{permuted(int(body), 10 ** len(body), key, 'phone' + head):0{len(body)}d}")


def _ipv4(shape: str, key: bytes) -> str | None:
    octets = [int(x) for x in shape.split(".")]
    if max(octets) > 255:
        return None
    rank = permuted(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "ipv4")
    return ".".join(map(str, rank.to_bytes(4, "big")))


def _alphabet(c: str) -> str:
    return "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _letters(shape: str, key: bytes, tweak: str) -> str:
    """Letters and digits permuted together, each within its class."""
    classes = [_alphabet(c) for c in shape if c.isalnum()]
    n, rank = 1, 0
    for c, alphabet in zip((c for c in shape if c.isalnum()), classes, strict=True):
        n, rank = n * len(alphabet), rank * len(alphabet) + alphabet.index(c)
    rank, out = permuted(rank, n, key, tweak + "".join(a[0] for a in classes)), []
    for alphabet in reversed(classes):
        rank, i = divmod(rank, len(alphabet))
        out.append(alphabet[i])
    return _refill(shape, "".join(reversed(out)))


def _email(shape: str, key: bytes) -> str | None:
    local, _, domain = shape.rpartition("@")
    return f"{_letters(local, key, 'email')}@{domain}" if any(c.isalnum() for c in local) else None


def _iban(shape: str, key: bytes) -> str | None:
    v = re.sub(r"\s", "", shape)
    as_number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(v) <= 34 or as_number(v[4:] + v[:4]) % 97 != 1:
        return None
    body = _letters(v[4:], key, f"iban{v[:2]}")
    return _refill(shape, f"{v[:2]}{98 - as_number(body + v[:2] + '00') % 97:02d}{body}")


FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date(order: str) -> Callable[[str, bytes], str | None]:
    def read(shape: str, key: bytes) -> str | None:
        fields = dict(zip(order, re.split(r"\D", shape), strict=True))
        try:
            day = datetime.date(int(fields["y"]), int(fields["m"]), int(fields["d"])).toordinal()
        except ValueError:
            return None
        if not FIRST <= day <= LAST:
            return None
        new = datetime.date.fromordinal(FIRST + permuted(day - FIRST, LAST - FIRST + 1, key, "date"))
        written = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        separators = re.findall(r"\D", shape)
        return "".join(written[f] + s for f, s in zip(order, [*separators, ""], strict=True))

    return read


_MONTH_FIRST = _date("mdy")
_DAY_FIRST = _date("dmy")

#: Detectors in order of precedence: where spans overlap, the earlier detector's is taken. A hint is a character that any match holds.
DETECTORS: list[tuple[str, str, re.Pattern, Callable[[str, bytes], str | None]]] = [
    ("email", "@", re.compile(r"(?<![\w.+@-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", re.ASCII), _email),
    ("iban", "", re.compile(r"\b[A-Z]{2}\d\d(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", re.ASCII), _iban),
    ("ipv4", ".", re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)", re.ASCII), _ipv4),
    ("date", "-", re.compile(r"(?<![\d/.-])\d{4}-\d\d-\d\d(?![\d-])", re.ASCII), _date("ymd")),
    ("date", "/", re.compile(r"(?<![\d/.-])\d{1,2}/\d{1,2}/\d{4}(?![\d/])", re.ASCII), lambda s, k: _DAY_FIRST(s, k) if int(s.split("/")[0]) > 12 else _MONTH_FIRST(s, k)),
    ("date", ".", re.compile(r"(?<![\d/.-])\d{1,2}\.\d{1,2}\.\d{4}(?!\d|\.\d)", re.ASCII), _DAY_FIRST),
    ("ssn", "-", re.compile(r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])", re.ASCII), _ssn),
    ("card", "", re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,}(?![\w-]|\.\d)", re.ASCII), _card),
    ("phone", "", re.compile(r"(?<![\w+.(-])(?:\+?1[ .-]?)?(?:\([2-9]\d\d\)\x20?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}(?![\w-])", re.ASCII), _nanp),
    ("phone", "+", re.compile(r"(?<![\w+.])\+[1-9]\d{0,2}[ .-]?(?:\(?\d{1,4}\)?[ .-]?){2,5}\d{2,4}(?![\w-])", re.ASCII), _phone),
]
DIGIT = re.compile(r"\d", re.ASCII)
DIGITS = re.compile(r"\d+", re.ASCII)
#: Digit groups of printed cards, besides one group; only these may touch other groups by a hyphen.
CARD_LAYOUTS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 5), (4, 4, 4, 4, 1), (4, 4, 4, 4, 2), (4, 4, 4, 4, 3), (6, 13)}
#: First digits and lengths of issuers: Visa, Mastercard, American Express, Diners Club, JCB, Discover with UnionPay and Maestro, Mir, UATP, RuPay, Troy.
ISSUED = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]\d\d|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11,16}|35\d{14,17}|6\d{12,18}|5[0678]\d{11,17}|220[0-4]\d{12,15}|1\d{14}|8[12]\d{14}|9792\d{12}", re.ASCII)

Found = tuple[int, int, str]


def _spans(pattern: re.Pattern, text: str, free: Callable[[int, int], bool], new: Callable[[str], str | None]) -> Iterator[Found]:
    """Valid free matches from left to right, with what replaces them; where one is refused, it is cut at its spaces, last first."""
    at = 0
    while m := pattern.search(text, at):
        start, end = m.span()
        at = start + 1
        for stop in [end, *(i for i in range(end - 1, start, -1) if text[i] == " ")]:
            if free(start, stop) and (stop == end or pattern.fullmatch(text[start:stop])) and (made := new(text[start:stop])) is not None:
                yield start, stop, made
                at = stop
                break


def _card_spans(pattern: re.Pattern, text: str, free: Callable[[int, int], bool], new: Callable[[str], str | None]) -> Iterator[Found]:
    """Valid free windows of the digit groups of every match."""
    for m in pattern.finditer(text):
        groups = [g.span() for g in DIGITS.finditer(text, *m.span())]
        open_ = [free(s, e) for s, e in groups]
        row = "".join(text[s:e] for s, e in groups)
        sums = [[0], [0]]  # Luhn sums up to each digit, with the digits in even or odd places doubled
        for place, d in enumerate(map(int, row)):
            for odd in (0, 1):
                sums[odd].append(sums[odd][-1] + (d if place % 2 != odd else d * 2 - 9 * (d > 4)))
        first = [0, *accumulate(e - s for s, e in groups)]
        windows = []
        for i, at in enumerate(first[:-1]):
            for j in range(i, len(groups)):
                if not open_[j] or (stop := first[j + 1]) - at > 19:
                    break
                if stop - at < 13 or (sums[stop % 2][stop] - sums[stop % 2][at]) % 10 or row.count(row[at], at, stop) == stop - at:
                    continue
                layout, start, end = tuple(e - s for s, e in groups[i : j + 1]), groups[i][0], groups[j][1]
                printed = len(layout) == 1 or layout in CARD_LAYOUTS
                spaced = (i == 0 or text[start - 1] == " ") and (j == len(groups) - 1 or text[end] == " ")
                if printed or (start, end) == m.span() or spaced and ISSUED.fullmatch(row, at, stop):
                    windows.append((not printed, i, -j))
        used: set[int] = set()
        for _, i, j in sorted(windows):
            own = range(i, 1 - j)
            if used.isdisjoint(own):
                used.update(own)
                start, end = groups[i][0], groups[-j][1]
                yield start, end, new(text[start:end])


def pseudonymised(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The rewritten text, and the spans that were rewritten (places in the text given)."""
    if "@" not in text and not DIGIT.search(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []

    def free(start: int, end: int) -> bool:
        before = bisect_left(found, (end,))  # values found do not overlap
        return before == 0 or found[before - 1][1] <= start

    for kind, hint, pattern, replace in DETECTORS:
        if hint and hint not in text:
            continue
        spans = (_card_spans if kind == "card" else _spans)(pattern, text, free, lambda shape, replace=replace: replace(shape, key))
        found = sorted(found + [(start, end, kind, new) for start, end, new in spans])
    out, at = [], 0
    for start, end, _, new in found:
        out += [text[at:start], new]
        at = end
    return "".join(out) + text[at:], [(k, s, e) for s, e, k, _ in found]


def pseudonymise(df: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``df`` with ``text`` rewritten, the number of values found and their spans (``kind:start:end`` in the text given)."""

    def run(texts: list[str | None]) -> list:
        made = [(t, []) if t is None else pseudonymised(t, key) for t in texts]
        return [[t for t, _ in made], [len(s) for _, s in made], [",".join(f"{k}:{b}:{e}" for k, b, e in s) for _, s in made]]

    return map_text(df, [text], run, f"`{text}` string, n_found long, spans string")
