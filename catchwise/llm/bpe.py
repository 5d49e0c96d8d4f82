"""Byte-level BPE by backtracking over longest matches, and decoding by an offset table.

The text is cut into pieces by the tokenizer's published pattern; added tokens are cut out first. Inside a piece
an Aho-Corasick pass lists the vocabulary entries that start at each byte. The encoder always tries the longest
entry and keeps it when the pair it forms with the token before is *compatible*: merging the two tokens' bytes
would give the same two tokens. If no entry fits, the last token is withdrawn and its start is closed, so every
(position, entry) is tried once and the work is linear in the piece. With compatible neighbours everywhere the
result equals merging by rank.

Null text counts as empty: no tokens, empty decoded text. Equal texts give equal rows; an empty table gives an
empty table. An input column named like an output column is replaced.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from catchwise.llm.common import map_text

#: Fixed value: the pattern of byte-level BPE pre-tokenisation.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Code points that are neither letters nor numbers to the tokenizer, whose character tables are older than
#: those of the pattern engine.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F "
    "12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 "
    "1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
NEWER_SET = "".join("-".join(f"\\U{int(end, 16):08X}" for end in part.split("-")) for part in NEWER.split())

#: Pieces remembered per worker and generation (a speed parameter; it never changes a result).
REMEMBERED = 150_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for themselves, the others follow 255."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


@dataclass
class Vocabulary:
    """Parsed tokenizer file: entries in byte letters, merges by rank, added tokens."""

    entries: dict[str, int]
    merges: list[tuple[str, str]]
    added: dict[str, int]

    @classmethod
    def parse(cls, content: str) -> Vocabulary:
        data = json.loads(content)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        entries = {k: v for k, v in data["model"]["vocab"].items() if k not in added}
        return cls(entries, merges, added)


class Codec:
    """Encoder and decoder of one vocabulary; made once per worker."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick
        import regex

        ids = vocabulary.entries
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: rank of its merge, left part, right part
        for rank, (left, right) in enumerate(vocabulary.merges):
            pair = ids[left], ids[right]
            self.rank[pair] = rank
            self.parts.setdefault(ids[left + right], (rank, *pair))
        self.automaton = ahocorasick.Automaton()
        for entry, token in ids.items():
            self.automaton.add_word(entry, (token, len(entry) - 1))
        self.automaton.make_automaton()
        #: of each token: its bytes, and the longest other entry that it starts with, -1 if none
        self.size, self.shorter = [0] * (max(ids.values()) + 1), [-1] * (max(ids.values()) + 1)
        for entry, token in ids.items():
            self.size[token] = len(entry)
            self.shorter[token] = next((ids[entry[:k]] for k in range(len(entry) - 1, 0, -1) if entry[:k] in ids), -1)
        self.letters = dict(enumerate(byte_letters()))
        self.plain, self.newer = regex.compile(PATTERN).findall, regex.compile(f"[{NEWER_SET}]").search
        older = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:[{NEWER_SET}]|[^\s\p{{L}}\p{{N}}])").replace(r" ?\p{L}+", rf" ?(?:(?![{NEWER_SET}])\p{{L}})+").replace(r" ?\p{N}+", rf" ?(?:(?![{NEWER_SET}])\p{{N}})+")
        self.exact = regex.compile(older).findall
        self.added = vocabulary.added
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.compatible: dict[tuple[int, int], bool] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: offset table: token t is table[offset[t] : offset[t + 1]]
        of_letter = {c: b for b, c in enumerate(byte_letters())}
        spelled = {token: bytes(map(of_letter.__getitem__, entry)) for entry, token in ids.items()} | {token: text.encode() for text, token in self.added.items()}
        size = max(spelled) + 1
        pieces = [spelled.get(t, b"") for t in range(size)]
        self.table = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)

    def pieces(self, text: str) -> list[str]:
        return self.exact(text) if not text.isascii() and self.newer(text) else self.plain(text)

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts of ``token`` that touch its end (side 2) or start (side 1), each with the rank at which it is merged away."""
        if (token, side) not in self.spines:
            out, gone = [], float("inf")
            at = token
            while True:
                out.append((at, gone))
                if at not in self.parts:
                    break
                gone = self.parts[at][0]
                at = self.parts[at][side]
            self.spines[token, side] = out
        return self.spines[token, side]

    def fits(self, left: int, right: int) -> bool:
        """Pair-compatibility table, filled as pairs are met: no merge ever joins the two tokens across their border.

        A merge joins a part of ``left`` that touches the border with one of ``right`` if its rank comes while both
        stand. At equal ranks the pair further left goes first.
        """
        known = self.compatible.get((left, right))
        if known is None:
            rank = self.rank.get
            known = not any(
                (r := rank((a, b))) is not None and r < a_gone and r <= b_gone
                for a, a_gone in self.spine(left, 2) for b, b_gone in self.spine(right, 1)
            )
            if len(self.compatible) >= 4 * REMEMBERED:
                self.compatible.clear()
            self.compatible[left, right] = known
        return known

    def piece(self, piece: str) -> list[int]:
        text = piece.encode().decode("latin-1").translate(self.letters)
        n = len(text)
        longest = [0] * n  # the longest entry that starts here; a byte is always one
        for last, (token, back) in self.automaton.iter(text):
            longest[last - back] = token
        size, shorter, compatible, fits = self.size, self.shorter, self.compatible, self.fits
        closed = set()  # borders found to lead nowhere
        taken: list[int] = []
        at, token, before = 0, longest[0], -1
        while True:
            while token >= 0:
                end = at + size[token]
                if end not in closed and (before < 0 or (fits(before, token) if (known := compatible.get((before, token))) is None else known)):
                    break
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                if end == n:
                    return taken
                at, before, token = end, token, longest[end]
            else:
                closed.add(at)
                token = shorter[taken.pop()]
                at -= size[before]
                before = taken[-1] if taken else -1

    def _known(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = np.array(self.piece(piece), dtype="<u4").tobytes()
        if len(self.memory) >= REMEMBERED:
            self.older, self.memory = self.memory, {}
        if len(piece) <= 64:
            self.memory[piece] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        parts = self.cut.split(text) if self.cut is not None and self.cut.search(text) else [text]
        out = []
        for part in parts:
            if part in self.added:
                out.append(np.array([self.added[part]], dtype="<u4").tobytes())
            elif part:
                for piece in self.pieces(part):
                    found = self.memory.get(piece)
                    out.append(self._known(piece) if found is None else found)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of the tokens; bytes that are no UTF-8 become U+FFFD."""
        tokens = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        start = self.offset[tokens]
        size = self.offset[tokens + 1] - start
        end = np.cumsum(size)
        at = np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)
        return self.table[at].tobytes().decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def codec(content: str) -> Codec:
    """The worker's codec for a tokenizer file's content."""
    key = hash(content)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(Vocabulary.parse(content))
    return _codecs[key]


def tokenizer_path() -> str:
    """Place of the public vocabulary file; ``BPE_TOKENIZER`` overrides it."""
    given = os.environ.get("BPE_TOKENIZER")
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _shared(df: DataFrame, path: str):
    # a vocabulary file of a few MB, read on the driver once
    return df.sparkSession.sparkContext.broadcast(tokenizer_file(path))


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers in a binary)."""
    content = _shared(df, path)

    def run(texts: list[str | None]) -> list:
        made = [codec(content.value).encode(t) for t in texts]
        return [[len(ids) // 4 for ids in made], made]

    return map_text(df, [text], run, "n_tokens long, ids binary")


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of the token ids in ``ids``; null ids count as none."""
    content = _shared(df, path)

    def run(values: list[bytes | None]) -> list:
        return [[codec(content.value).decode(v or b"") for v in values]]

    return map_text(df, [ids], run, "decoded string")


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encode and decode in one pass: adds ``n_tokens``, ``ids`` and ``decoded``; the ids never leave the worker in between."""
    content = _shared(df, path)

    def run(texts: list[str | None]) -> list:
        c = codec(content.value)
        made = [c.encode(t) for t in texts]
        return [[len(ids) // 4 for ids in made], made, [c.decode(ids) for ids in made]]

    return map_text(df, [text], run, "n_tokens long, ids binary, decoded string")
