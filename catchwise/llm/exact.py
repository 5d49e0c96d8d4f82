"""Exact deduplication of a growing folder of documents, as a stream with keyed state on disk.

Texts are equal when they agree after lower-casing A-Z. ``ingest`` reads what is new in the folder:

1. A reading task folds equal texts that it meets, comparing their bytes, into one record: digest, largest identifier, that
   row's locator (file and row), and how many rows it stands for. Texts never leave the task, and a text that a third of
   all rows share is one record a task.
2. Records go to keyed state by digest. The state lies in RocksDB and never expires; it retains the digest (its key), the
   identifier and the content locator of the first text met under that digest, however long ago.
3. A record whose digest is known is a hit. Its text and the retained one are fetched by their locators, and all their bytes
   compared, before the batch ends. Digests under which different texts were found are noted.

A repeated batch replaces its own folders, so nothing is counted twice after a lost executor, and a later call with
the same ``work`` folder goes on from the kept state. ``decisions`` joins the documents with the folded records: of
equal texts the row with the largest identifier stays. Noted digests are grouped by their whole texts instead, so results
are exact under any digest.

A null text counts as empty, and empty texts are equal to each other. A null identifier is smaller than any other;
of repeated rows with the same identifier and text the last by locator stays, so exactly one row of a group does. Texts
may have any length: a task holds ``HELD_BYTES`` of texts beyond the one at hand and then starts a new fold. An empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from catchwise.llm.common import map_text, side
from catchwise.runtime import Cut, scratch_root

#: Bytes of texts that a task keeps at hand to fold equal ones.
HELD_BYTES = 32 * 1024 * 1024
#: Bytes of input files of one micro-batch.
BATCH_BYTES = 4 * 1024**3
#: State on disk: many small stores take no space ahead of need, and a batch uploads what it changed (fixed values).
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
RECORD = "digest binary, doc_id long, path string, row long, size long"
SEEN = f"{RECORD}, first_path string, first_row long"
Seen = Row("digest", "doc_id", "path", "row", "size", "first_path", "first_row")
CLASH = "digest binary"

Digest = Callable[[bytes], bytes]


def normal(text: str | None) -> bytes:
    """bytes.lower() knows ASCII letters only."""
    return (text or "").encode().lower()


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _located(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))


def _rank(record: tuple) -> tuple:
    doc_id, path, row = record
    return (doc_id is not None, doc_id or 0, path, row)


def folded(located: DataFrame, digest: Digest, held_bytes: int = HELD_BYTES) -> DataFrame:
    """One record for the equal texts that a task holds at the same time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[list]] = {}  # digest -> [text, (doc_id, path, row), size] of every text under it
        load = 0

        def flush() -> pa.RecordBatch:
            rows = [(d, *best, size) for d, texts in held.items() for _, best, size in texts]
            held.clear()
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["digest", "doc_id", "path", "row", "size"])

        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, len(whole), 256)):
            for doc_id, text, path, row in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                own = normal(text)
                texts = held.setdefault(digest(own), [])
                same = next((t for t in texts if t[0] == own), None)
                if same is None:
                    texts.append([own, (doc_id, path, row), 1])
                    load += len(own) + 200
                else:
                    same[1:] = max(same[1], (doc_id, path, row), key=_rank), same[2] + 1
            if load > held_bytes:
                yield flush()
                load = 0
        yield flush()

    return located.mapInArrow(run, RECORD)


class FirstText(StatefulProcessor):
    """Keeps the first record of a digest for ever; every later one is handed on as a hit beside it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "doc_id long, path string, row long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = self.first.get()
        for r in rows:
            yield Seen(r.digest, r.doc_id, r.path, r.row, r.size, first[1] if first else None, first[2] if first else None)
            if first is None:
                first = (r.doc_id, r.path, r.row)
                self.first.update(first)

    def close(self) -> None:
        pass


def clashes(spark: SparkSession, hits: DataFrame, schema) -> DataFrame:
    """Digests of the hits whose bytes differ from the retained text's, fetched by both locators."""
    retained = F.struct(F.col("first_path").alias("path"), F.col("first_row").alias("row"), F.lit(False).alias("hit"))
    asked = Cut(hits.select("digest", F.explode(F.array(F.struct("path", "row", F.lit(True).alias("hit")), retained)).alias("l")).select("digest", "l.path", "l.row", "l.hit").distinct())
    files = [unquote(r.path) for r in asked.df.select("path").distinct().collect()]  # names of input files, as any scan lists them
    texts = _located(spark.read.schema(schema).parquet(*files)).join(side(asked), ["path", "row"])
    texts = map_text(texts.select("digest", "hit", "text"), ["text"], lambda t: [[normal(x) for x in t]], "own binary", keep_read=False)
    both = texts.filter("hit").join(texts.filter("not hit").select("digest", F.col("own").alias("first")), "digest")
    return both.filter("own <> first").select("digest").distinct()


def ingest(spark: SparkSession, path: str, work: str, digest: Digest = sha256, batch_bytes: int = BATCH_BYTES) -> None:
    """Take in the files of ``path`` that ``work`` has not seen yet, and return when all are taken in.

    ``work`` is a shared folder: it holds the checkpoint with the state, the records (``seen``) and the noted digests (``clash``).
    """
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    path = path.rstrip("/")
    # a pattern, because a stream takes a plain path to be a folder and the table may be a single file
    rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(f"{path[:-1]}[{path[-1]}]")
    hits = folded(_located(rows), digest).groupBy("digest").transformWithState(statefulProcessor=FirstText(), outputStructType=SEEN, outputMode="append", timeMode="None")

    def keep(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        own = f"{work}/seen/batch={number}"
        batch.write.mode("overwrite").parquet(own)
        again = session.read.schema(SEEN).parquet(own).filter("first_path is not null")
        found = session.createDataFrame([], CLASH) if again.isEmpty() else clashes(session, again, schema)
        found.write.mode("overwrite").parquet(f"{work}/clash/batch={number}")

    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        stream = hits.writeStream.outputMode("append").option("checkpointLocation", f"{work}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    stream.awaitTermination()


def _held(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A table of the work folder; empty before its first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
    return spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)


def decisions(spark: SparkSession, path: str, work: str, digest: Digest = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row taken in."""

    def digests(texts: list[str | None]) -> list:
        own = [normal(t) for t in texts]
        return [[digest(t) for t in own], [hashlib.sha256(t).hexdigest() for t in own]]

    last = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"), "path", "row")
    records, noted = _held(spark, f"{work}/seen", SEEN), _held(spark, f"{work}/clash", CLASH).distinct()
    whole = spark.read.parquet(path).select("doc_id", "text").schema
    table = _located(spark.read.schema(whole).parquet(path))
    schema = "digest binary, text_sha256 string"
    groups = records.groupBy("digest").agg(F.max(last).alias("last"), F.sum("size").alias("group_size"))
    plain, odd = map_text(table, ["text"], digests, schema, keep_read=False), None
    if not noted.isEmpty():
        noted = Cut(noted)
        odd = map_text(table, ["text"], digests, schema).join(side(noted), "digest", "left_semi").withColumn("own", F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        alike = odd.groupBy("digest", "own").agg(F.max(last).alias("last"), F.count("*").alias("group_size"))
        odd = odd.join(alike, ["digest", "own"]).drop("text", "own")
        plain = plain.join(side(noted), "digest", "left_anti")
    made = plain.join(side(Cut(groups), 3), "digest")
    made = made if odd is None else made.unionByName(odd)
    return made.select("doc_id", F.col("last.id").alias("keep_id"), "group_size", ((F.col("path") == F.col("last.path")) & (F.col("row") == F.col("last.row"))).alias("kept"), "text_sha256")


def deduplicate(spark: SparkSession, path: str, digest: Digest = sha256, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """All of ``path`` through the stream, in a work folder of its own, and what it decides."""
    work = f"{scratch_root(spark)}/catchwise/{uuid.uuid4().hex}"
    ingest(spark, path, work, digest, batch_bytes)
    made = decisions(spark, path, work, digest)
    folder = spark._jvm.org.apache.hadoop.fs.Path(work)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    return made
