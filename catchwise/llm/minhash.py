"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct word shingles (the whole sequence as one if it has fewer words). The first
permutation scatters the shingles over ``UNIVERSE`` places; the second gives every place a value. Coordinate ``k`` of
the signature is the smallest value met when the second permutation is shifted circularly by ``k``, so two
permutations give all ``COORDINATES``.

Documents with one word sequence are one *unit*. Units that share a band of ``ROWS`` coordinates meet in a bucket:

1. Every unit is compared with its bucket's smallest unit; links found on the full sets give components.
2. Where a bucket still holds several components, its units are compared block by block inside tasks: first by sizes
   and signature bits, each pair of different components once over all buckets; then the units with a candidate by whole
   sets. Only links that join components leave a task, so no link between components is lost.

Pairs are dropped before verification only if their sizes rule a link out, or if so few of 128 signature bits agree
that a link has odds under one in 10^10. Links are decided on whole sets; the chance that two sets at the threshold
share no band is about 5 in 10^5.

Null and empty texts, and texts of white space, have an empty set and link with nothing. Every row is placed by its own
text: repeated rows agree, rows without an id belong to no component (null) and are kept.
"""

from __future__ import annotations

from hashlib import blake2b, md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwise.llm.common import map_text, side
from catchwise.llm.graph import component_table
from catchwise.runtime import Cut, spread

UNIVERSE, COORDINATES, BANDS, ROWS = 1 << 20, 128, 25, 5
#: Of 128 one-bit coordinates, a pair at the threshold agrees on 115 on average, with a deviation of 3.4.
AGREE = 92
REMEMBERED = 100_000
#: Units and shingles that a block of a bucket is meant to hold at most.
BLOCK_UNITS, BLOCK_SHINGLES = 256, 250_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Shingle sets and signatures in a worker."""

    class Words(dict):
        def __missing__(self, word: bytes) -> int:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
            return value

    def __init__(self, width: int):
        self.width, self.words = width, self.Words()
        rng = np.random.default_rng(20)
        self.first = rng.permutation(UNIVERSE)
        second = rng.permutation(UNIVERSE).astype(np.uint32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: COORDINATES - 1]]), COORDINATES)

    @staticmethod
    def split(text: str | None) -> list[bytes]:
        # bytes.lower() and bytes.split() know ASCII letters and white space only
        return (text or "").encode().lower().split()

    def shingles(self, words: list[bytes]) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles."""
        if not words:
            return np.empty(0, dtype=np.uint64)
        ids = np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=len(words))
        width = min(self.width, len(ids))
        n = len(ids) - width + 1
        out = np.full(n, width, dtype=np.uint64)
        for k in range(width):
            out = (out ^ ids[k : k + n]) * MIX
            out ^= out >> np.uint64(29)
        return np.unique(out)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = self.first[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
        out = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(places), 2048):
            np.minimum(out, self.shifted[places[at : at + 2048]].min(axis=0), out=out)
        return out

    @staticmethod
    def bands(signature: np.ndarray) -> np.ndarray:
        rows = signature[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
        out = np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(ROWS):
            out = (out ^ rows[:, k]) * MIX
            out ^= out >> np.uint64(31)
        return out.view(np.int64)


_shinglers: dict[int, Shingler] = {}


def shingler(width: int) -> Shingler:
    if width not in _shinglers:
        _shinglers[width] = Shingler(width)
    return _shinglers[width]


def marks(df: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, copy, bands, bits): ``copy`` names the word sequence, null if there is no word."""

    def run(texts: list[str | None]) -> list:
        s, out = shingler(width), []
        for t in texts:
            words = s.split(t)
            own = s.shingles(words)
            if len(own):
                sig = s.signature(own)
                bits = np.packbits(sig & 1).view(np.int64)
                out.append((len(own), md5(b" ".join(words)).digest(), s.bands(sig), int(bits[0]), int(bits[1])))
            else:
                out.append((0, None, None, None, None))
        return list(zip(*out, strict=True)) if out else [[]] * 5

    return map_text(df.select("doc_id", "text"), ["text"], run, "n_shingles long, copy binary, bands array<long>, bits0 long, bits1 long").drop("text")


def sets(df: DataFrame, width: int) -> DataFrame:
    """(doc_id, copy, shingles): sorted hashes as unsigned little-endian 64-bit integers."""

    def run(texts: list[str | None]) -> list:
        s = shingler(width)
        words = [s.split(t) for t in texts]
        return [[md5(b" ".join(w)).digest() if w else None for w in words], [s.shingles(w).astype("<u8").tobytes() for w in words]]

    return map_text(df.select("doc_id", "text"), ["text"], run, "copy binary, shingles binary").drop("text")


def _alike(x: str, y: str, percent: int) -> F.Column:
    """What a link needs: near sizes and mostly equal bits."""
    near = (F.least(f"{x}.n", f"{y}.n") * 100 >= F.greatest(f"{x}.n", f"{y}.n") * percent)
    differ = F.bit_count(F.col(f"{x}.bits0").bitwiseXOR(F.col(f"{y}.bits0"))) + F.bit_count(F.col(f"{x}.bits1").bitwiseXOR(F.col(f"{y}.bits1")))
    return near & (differ <= COORDINATES - AGREE)


def _linked(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of units whose whole sets are linked; ``held`` has (unit, shingles)."""

    def run(left: list[bytes], right: list[bytes]) -> list:
        out = []
        for x, y in zip(left, right, strict=True):
            a, b = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return [out]

    # the side that may be shared by many pairs is joined first, while rows are narrow
    met = pairs.join(held.select(F.col("unit").alias("b"), F.col("shingles").alias("set_b")), "b").join(held.select(F.col("unit").alias("a"), F.col("shingles").alias("set_a")), "a")
    return map_text(met, ["set_a", "set_b"], run, "linked boolean").filter("linked").select("a", "b")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: shingles that only one set holds are left out, the others are multiplied in slices."""
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = times > 1
    place = np.cumsum(shared) - 1
    kept = shared[column]
    row, column = row[kept], place[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(shared.sum()), 4096):
        low, high = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((len(sets), 4096), dtype=np.float32)
        part[row[low:high], column[low:high] - at] = 1
        out += part @ part.T
    return out


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` once for every two blocks of their bucket that meet: ``own`` is the row's block, ``i`` and ``j`` are the two."""
    own = F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return rows.withColumn("own", own).withColumn("other", other).select(*rows.columns, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def candidates(pdf: pd.DataFrame, percent: int) -> np.ndarray:
    """Which rows of two blocks may be linked to another one, by what narrow rows tell.

    A pair counts in the first bucket that its units share and in the two blocks that are theirs, so once over all buckets;
    its components differ, its sizes are near and its bits mostly equal.
    """
    root, n, own = (pdf[c].to_numpy() for c in ("root", "n", "own"))
    differ = sum(np.bitwise_count(x[:, None] ^ x[None, :]) for x in (pdf[c].to_numpy().view(np.uint64) for c in ("bits0", "bits1")))
    near = np.minimum(n[:, None], n[None, :]) * 100 >= np.maximum(n[:, None], n[None, :]) * percent
    met = near & (differ <= COORDINATES - AGREE) & (root[:, None] != root[None, :])
    if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
        met &= own[:, None] != own[None, :]
    left, right = np.nonzero(np.triu(met))
    bands = np.stack(pdf["bands"].to_numpy())
    for k in range(np.flatnonzero(bands[0] == pdf["band"].iloc[0])[0]):
        # near sets share most buckets, so few pairs are left after some
        later = bands[left, k] != bands[right, k]
        left, right = left[later], right[later]
    out = np.zeros(len(root), dtype=bool)
    out[left] = out[right] = True
    return out


def _meeting(rows: DataFrame, percent: int) -> DataFrame:
    """(band, i, j, unit, root) of the units that have a candidate in two blocks; no pair and no set leaves a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.loc[candidates(pdf, percent), ["band", "i", "j", "unit", "root"]]

    # narrow rows, but many comparisons: bytes do not tell how many tasks they need
    return spread(_dealt(rows), "band", "i", "j").groupBy("band", "i", "j").applyInPandas(run, "band long, i int, j int, unit long, root long")


def _bridges(meeting: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components, from whole sets.

    The task of two blocks compares the sets exactly and returns a spanning forest of the links that it finds between
    components, so it returns fewer rows than it reads.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        unit, root = pdf["unit"].to_numpy(), pdf["root"].to_numpy()
        sets = [np.frombuffer(x, dtype="<u8") for x in pdf["shingles"]]
        size = np.array([len(s) for s in sets], dtype=np.float64)
        both = overlaps(sets).astype(np.float64)
        alike = root[:, None] == root[None, :]
        near = alike | (100 * both >= percent * (size[:, None] + size[None, :] - both))
        out: list[tuple[int, int]] = []
        fresh = np.ones(len(unit), dtype=bool)
        for start in range(len(unit)):
            queue = [start] if fresh[start] else []
            fresh[start] = False
            while queue:
                at = queue.pop()
                for k in np.flatnonzero(near[at] & fresh):
                    fresh[k] = False
                    queue.append(int(k))
                    if not alike[at, k]:
                        out.append((int(unit[at]), int(unit[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return meeting.join(held, "unit").groupBy("band", "i", "j").applyInPandas(run, "a long, b long")


def groups(df: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``df`` (doc_id, text)."""
    marked = Cut(marks(df, width))
    with_words = marked.df.filter("copy is not null and doc_id is not null")
    # copies agree in all but their id
    units = Cut(with_words.groupBy("copy").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits0").alias("bits0"), F.first("bits1").alias("bits1"))
                .withColumn("unit", F.monotonically_increasing_id()))
    met = units.df.select("unit", "n", "bits0", "bits1", F.explode("bands").alias("band"))
    firsts = met.groupBy("band").agg(F.min(F.struct("unit", "n", "bits0", "bits1")).alias("f"), F.count("*").alias("members")).filter("members > 1").drop("members")
    members = Cut(met.join(firsts, "band").select("band", F.struct("unit", "n", "bits0", "bits1").alias("u"), "f"))
    stars = members.df.filter((F.col("u.unit") != F.col("f.unit")) & _alike("u", "f", percent)).select(F.col("u.unit").alias("a"), F.col("f.unit").alias("b")).distinct()

    pairs = Cut(stars)
    held = _sets_of(df, units.df, pairs.df.select(F.explode(F.array("a", "b")).alias("unit")), width)
    links = Cut(_linked(pairs.df, held.df, percent))
    pairs.drop()
    held.drop()
    roots = component_table(links.df)
    placed = Cut(members.df.select("band", F.col("u.unit").alias("unit"), F.col("u.n").alias("n")).join(roots.df.withColumnRenamed("id", "unit"), "unit", "left")
                 .select("band", "unit", "n", F.coalesce("root", "unit").alias("root")))
    members.drop()
    mixed = placed.df.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("rows"), F.sum("n").alias("load")).filter("least <> most")
    mixed = mixed.select("band", F.ceil(F.greatest(F.col("rows") / BLOCK_UNITS, F.col("load") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    open_rows = placed.df.join(mixed, "band").select("band", "unit", "root", "blocks").join(units.df.select("unit", "n", "bits0", "bits1", "bands"), "unit")
    meeting = Cut(_meeting(open_rows, percent))
    placed.drop()
    if not meeting.df.isEmpty():
        held = _sets_of(df, units.df, meeting.df.select("unit"), width)
        found = Cut(_bridges(meeting.df, held.df, percent))
        held.drop()
        if not found.df.isEmpty():
            roots.drop()
            roots = component_table(links.df.unionByName(found.df))
        found.drop()
    meeting.drop()
    links.drop()

    linked = units.df.select("unit", "copy", "rep").join(roots.df.select(F.col("id").alias("unit"), "root"), "unit", "left").withColumn("root", F.coalesce("root", "unit"))
    linked = Cut(linked)
    units.drop()
    roots.drop()
    smallest = linked.df.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = Cut(linked.df.join(smallest, "root").select("copy", "component_id"))
    linked.drop()
    out = marked.df.select("doc_id", "n_shingles", "copy").join(side(named, 2), "copy", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sets_of(df: DataFrame, units: DataFrame, asked: DataFrame, width: int) -> Cut:
    """(unit, shingles) of the units in ``asked``, from the texts of their first documents."""
    wanted = Cut(units.select("unit", "rep", "copy").join(asked.distinct(), "unit").select("unit", "rep", "copy"))
    ids = Cut(wanted.df.select(F.col("rep").alias("doc_id")).distinct())
    texts = df.join(side(ids), "doc_id", "left_semi")
    made = Cut(sets(texts, width).join(wanted.df.withColumnRenamed("rep", "doc_id"), ["doc_id", "copy"]).groupBy("unit").agg(F.first("shingles").alias("shingles")))
    wanted.drop()
    ids.drop()
    return made


def deduplicate(df: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` that stay: of each component the document with the smallest id, once; rows without an id stay."""
    ids = Cut(groups(df.select("doc_id", "text"), width, percent).filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times")))
    stay = df.join(side(Cut(ids.df.select("doc_id"))), "doc_id", "left_semi").select(*df.columns)
    if not ids.df.filter("times > 1").isEmpty():
        stay = stay.dropDuplicates(["doc_id"])
    return stay.unionByName(df.filter("doc_id is null"))
