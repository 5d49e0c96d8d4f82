"""How quality filters overlap: what each removes, first or later, in every order of application.

The words of all documents become one sparse matrix of documents and words. Tasks that read texts number the words that
they meet and write the counts as CSR shards with a vocabulary of their own; the vocabularies are merged to one
dictionary, whose codes go back to the shards. Only vocabularies are shuffled on words, so a word that every document has
is one row a shard. Row sums and numbers of non-zero entries of the recoded matrix decide filters A and B; C, D and
E (an identical text with a smaller identifier) travel beside the rows.

Documents are then counted by part and pattern of failed filters: at most 32 patterns, four label pairs each, from which
the figures of all 120 orders of five steps follow.

Null and empty texts have no words: they fail A, not B, C or D. A null identifier is not larger than any, so such a row
never fails E, and has no labels; rows with the same identifier and text do not make each other fail E. Repeated rows count
each. A document has a label if any of its rows in ``labels`` says so. A null part is the empty string. A shard is
closed once its texts pass ``SHARD_BYTES``, so a very long text is a shard of its own. Empty tables give no rows. Extra
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import count, permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwise.llm.common import side
from catchwise.runtime import Cut

#: Bytes of texts in one shard, give or take a text.
SHARD_BYTES = 8 * 1024 * 1024
#: Bytes of a row group of the written shards: a few shards, however many a task makes.
BLOCK_BYTES = 16 * 1024 * 1024
#: Words that a task codes before it hands their codes on, shard by shard.
CODED = 500_000
FILTERS = "ABCDE"
#: The characters of filter D and of filter C (fixed values).
SIGNS, CAPITALS = b"#$%&*|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHARD = pa.schema([("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.string())), ("flags", pa.list_(pa.int32())), ("digests", pa.list_(pa.binary())),
                   ("starts", pa.list_(pa.int32())), ("columns", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("words", pa.list_(pa.binary()))])
SHARD_SQL = "shard long, ids array<long>, parts array<string>, flags array<int>, digests array<binary>, starts array<int>, columns array<int>, counts array<int>, words array<binary>"


class _Numbers(dict):
    """word -> its number in order of first sight."""

    def __init__(self):
        self.next = count().__next__

    def __missing__(self, word: bytes) -> int:
        self[word] = number = self.next()
        return number


def shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """CSR shards of ``docs`` (doc_id, part, text) with vocabularies of their own.

    Row ``i`` of a shard has the entries ``starts[i]`` to ``starts[i + 1]`` of ``columns`` (places in ``words``) and ``counts``;
    ``flags`` has 4 and 8 for failed filters C and D, ``digests`` a digest of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        rows, columns, counts, starts, words, load, made = [], [], [], [0], _Numbers(), 0, 0

        def close() -> pa.RecordBatch:
            values = [first + made, *map(list, zip(*rows, strict=True)), starts, np.concatenate(columns), np.concatenate(counts), list(words)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, SHARD.types, strict=True)], schema=SHARD)

        for batch in (whole.slice(at, 64) for whole in batches for at in range(0, len(whole), 64)):
            for doc_id, part, text in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                own = text.encode()
                c = 100 * (len(own) - len(own.translate(None, CAPITALS))) > 10 * len(text)
                d = len(own.translate(None, SIGNS)) < len(own)
                # bytes.split() knows ASCII white space only
                own_counts = Counter(own.split())
                column = np.fromiter(map(words.__getitem__, own_counts), dtype=np.int32, count=len(own_counts))
                order = column.argsort()
                rows.append((doc_id, part, 4 * c + 8 * d, sha256(own).digest()))
                columns.append(column[order])
                counts.append(np.fromiter(own_counts.values(), dtype=np.int32, count=len(own_counts))[order])
                starts.append(starts[-1] + len(column))
                load += len(own) + 100
                if load > shard_bytes:
                    yield close()
                    rows, columns, counts, starts, words, load, made = [], [], [], [0], _Numbers(), 0, made + 1
        if rows:
            yield close()

    return docs.mapInArrow(run, SHARD_SQL)


def coded(made: DataFrame) -> DataFrame:
    """(shard, places, codes): the dictionary's code of every word of every shard, in pieces.

    Equal words of all shards lie side by side after one shuffle, sorted, and a task numbers them in that order. A word has
    one row a shard, however often it occurs.
    """
    words = made.select("shard", F.posexplode("words").alias("place", "word"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, last, waiting = TaskContext.get().partitionId() << 40, None, []

        def hand_on() -> pa.RecordBatch:
            shard, place, codes = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            order = np.argsort(shard, kind="stable")
            shard, place, codes = shard[order], place[order], codes[order]
            starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            ends = pa.array(np.r_[starts, len(shard)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(shard[starts]), pa.ListArray.from_arrays(ends, pa.array(place)), pa.ListArray.from_arrays(ends, pa.array(codes))], names=["shard", "places", "codes"])

        for batch in batches:
            if not len(batch):
                continue
            word = batch.column(2)
            fresh = np.empty(len(word), dtype=bool)
            fresh[0] = last is None or word[0].as_py() != last
            fresh[1:] = pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)
            codes = code + np.cumsum(fresh)
            code, last = int(codes[-1]), word[-1].as_py()
            waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), codes))
            if sum(len(w[0]) for w in waiting) >= CODED:
                yield hand_on()
        if waiting:
            yield hand_on()

    dealt = words.repartition("word").sortWithinPartitions("word")
    return dealt.mapInArrow(run, "shard long, places array<int>, codes array<long>")


def encoded(made: DataFrame) -> DataFrame:
    """The shards with ``codes``, one for each of their columns' places, in ``pieces``."""
    pieces = coded(made).groupBy("shard").agg(F.collect_list(F.struct("places", "codes")).alias("pieces"))
    return made.drop("words").join(pieces, "shard", "left")


def measures(matrix: DataFrame) -> DataFrame:
    """(doc_id, part, flags, digest, total, distinct) of every row of the recoded matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (batch.slice(k, 1) for batch in batches for k in range(len(batch))):
            flat = {c: r.column(c).flatten() for c in ("ids", "parts", "flags", "digests", "starts", "columns", "counts", "pieces")}
            places, codes = (x.flatten().to_numpy() for x in flat["pieces"].flatten())
            code = np.zeros(len(codes), dtype=np.int64)
            code[places] = codes
            n = len(flat["ids"])
            row = np.repeat(np.arange(n), np.diff(flat["starts"].to_numpy()))
            # (row, code) as one number, so that sorting is plain
            known, rank = np.unique(code, return_inverse=True)
            entries = np.sort(row * max(len(known), 1) + rank[flat["columns"].to_numpy()])
            fresh = entries[np.diff(entries, prepend=-1) > 0]
            total, distinct = np.bincount(row, weights=flat["counts"].to_numpy(), minlength=n).astype(np.int64), np.bincount(fresh // max(len(known), 1), minlength=n)
            yield pa.RecordBatch.from_arrays([flat["ids"], flat["parts"], flat["flags"], flat["digests"], pa.array(total), pa.array(distinct.astype(np.int64))], names=["doc_id", "part", "flags", "digest", "total", "distinct"])

    return matrix.mapInArrow(run, "doc_id long, part string, flags int, digest binary, total long, distinct long")


def patterns(docs: DataFrame, labels: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(part, failed, n, good, toxic): documents by part and failed filters, bit ``k`` for letter ``k`` of ``FILTERS``."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    made = Cut(shards(read, shard_bytes), compression="zstd", block_bytes=BLOCK_BYTES)
    rows = Cut(measures(encoded(made.df)))
    made.drop()
    copies = Cut(rows.df.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("digest", "first"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    a, b = F.col("total") < 100, 100 * F.col("distinct") < 80 * F.col("total")
    e = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    failed = F.when(a, 1).otherwise(0) + F.when(b, 2).otherwise(0) + F.col("flags") + F.when(e, 16).otherwise(0)
    held = rows.df.join(side(copies, 3), "digest", "left").select("doc_id", "part", failed.alias("failed"))
    # labels name few documents: counted by document they would meet every row on its identifier
    return held.join(side(Cut(known.filter("good or toxic")), 6), "doc_id", "left").groupBy("part", "failed").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(F.col("toxic"), 1)).alias("toxic"))


def orders(counted: DataFrame) -> DataFrame:
    """One row a part, order and step, from the table of ``patterns``."""
    spark = counted.sparkSession
    steps = [("".join(o), k + 1, 1 << FILTERS.index(o[k]), sum(1 << FILTERS.index(x) for x in o[:k])) for o in permutations(FILTERS) for k in range(5)]
    # 600 rows: every order and step with the bits of its filter and of those before it
    table = spark.createDataFrame(steps, "filter_order string, step int, own int, before int")
    fails, gone = F.col("failed").bitwiseAND(F.col("own")) > 0, F.col("failed").bitwiseAND(F.col("before")) > 0
    total = lambda what, when: F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0)).cast("long")
    each = counted.crossJoin(F.broadcast(table)).groupBy("part", "filter_order", "step", "own").agg(
        total("n", ~gone & ~fails).alias("kept"), total("n", ~gone & fails).alias("removed"), total("n", gone & fails).alias("redundant"),
        total("n", F.col("failed") == F.col("own")).alias("unique_fails"), total("good", ~gone & fails).alias("good_lost"), total("toxic", ~gone & fails).alias("toxic_lost"))
    shares = each.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return each.join(shares, ["part", "own"]).drop("own")


def audit(docs: DataFrame, labels: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    return orders(Cut(patterns(docs, labels, shard_bytes)).df)
