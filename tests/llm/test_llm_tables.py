"""Whitening, exact deduplication as a stream, interaction of filters: against brute force and on odd rows."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchwise.llm import audit, exact, whitening

EMBEDDINGS = "vec_id long, embedding array<float>, n string, x int, at double"


def whitened(spark, vectors, components=8):
    df = spark.createDataFrame([(i, v, "own", 1, 2.0) for i, v in vectors], EMBEDDINGS)
    return whitening.whiten(df, "vec_id", "embedding", components).toPandas()


def brute_whitening(vectors, components=8):
    x = np.floor(np.array(vectors, dtype=np.float32).astype(float) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return deviation, centred @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("rows", [7, 4096])
def test_whitening_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(whitening, "ROWS", rows)
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 12)) * rng.uniform(0.2, 3, 12) + rng.normal(size=12)).astype(np.float32)
    vectors[200:] = vectors[:100]
    got = whitened(spark, [(i, v.tolist()) for i, v in enumerate(vectors)])
    deviation, want, explained = brute_whitening(vectors)
    assert len(got) == 300 * 8 and set(got.n) == {300}
    assert got[got.component == 1].set_index("vec_id").deviation.loc[range(300)].tolist() == deviation
    made = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    signs = np.sign((made * want).sum(axis=0))
    assert np.allclose(made * signs, want, atol=1e-9)
    assert np.allclose(got[got.vec_id == 0].sort_values("component").explained, explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, 2.0]), (2, [1.5, -1.0, 2.0]), (2, [1.5, -1.0, 2.0]), (None, [3.0, 0.25, 2.0]), (5, None), (6, []), (7, [nan, 1.0, 1.0]), (8, [1.0, None, 1.0]), (9, [1.0, -inf, 1.0]), (10, [2.0**45, 0.0, 0.0]), (11, [1.0]), (12, [4.0]), (13, [9.0, 9.0])]
    got = whitened(spark, rows)
    three = got[got.n == 4]
    assert sorted(str(v) for v in three.vec_id) == sorted(str(float(v)) for v in [1, 2, 2] for _ in range(3)) + ["nan"] * 3
    assert three[three.component == 3].whitened.isna().all() and not three[three.component < 3].whitened.isna().any()
    assert (three.identity_error < 1e-9).all()
    two = got[got.vec_id.isin([11, 12])]
    assert sorted(two.whitened.round(9)) == [-1.0, 1.0] and set(two.n) == {2} and set(two.explained) == {1.0}
    lone = got[got.vec_id == 13]
    assert lone.whitened.isna().all() and set(lone.deviation) == {0} and lone.identity_error.isna().all() and lone.explained.isna().all()
    assert whitened(spark, []).empty and list(whitened(spark, []).columns) == list(got.columns)
    large = whitened(spark, [(i, [float(2**38 * (i % 2)), 1.0]) for i in range(4)])
    assert large.deviation.isna().all() and (large[large.component == 1].whitened.abs().round(9) == 1).all()


def brute_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").encode().lower(), []).append(i)
    out = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        out += [(i, best, len(ids), hashlib.sha256(text).hexdigest()) for i in ids]
    return sorted(out, key=str)


def odd_texts(seed=4):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["Same Line", "same line", "SAME LINE", "other", "Ärger", "ärger", "", None, " ", "x" * 9000])) for i in range(400)]
    rows += [(1000 + i, f"text {i // 2}") for i in range(100)] + [(3, "twin"), (3, "Twin"), (None, "nobody"), (None, "NOBODY"), (None, "text 1"), (5000, "long " * 60_000), (5001, "Long " * 60_000), (5002, "long " * 59_999)]
    rnd.shuffle(rows)
    return rows


def write(spark, rows, path, mode="append"):
    spark.createDataFrame([(i, t, "own", b"own", 9) for i, t in rows], "doc_id long, text string, path string, digest binary, row int").coalesce(1).write.mode(mode).parquet(path)


def check(got, rows):
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_groups(rows)
    stay = [r for r in got if r.kept]
    assert len(stay) == len({r.text_sha256 for r in stay}) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in stay)


@pytest.mark.parametrize("bits", [256, 1])
def test_stream_goes_on_from_its_state(spark, tmp_path, bits):
    # the second digest hardly tells texts apart
    digest = exact.sha256 if bits == 256 else lambda text: bytes([hashlib.sha256(text).digest()[0] % 2])
    rows, path, work = odd_texts(), str(tmp_path / "documents.parquet"), str(tmp_path / "work")
    for part in range(3):
        write(spark, rows[part::4], path)
    exact.ingest(spark, path, work, digest, batch_bytes=1)
    check(exact.decisions(spark, path, work, digest).collect(), [r for part in range(3) for r in rows[part::4]])
    write(spark, rows[3::4], path)
    exact.ingest(spark, path, work, digest)
    check(exact.decisions(spark, path, work, digest).collect(), rows)
    seen = spark.read.parquet(f"{work}/seen")
    assert seen.agg(F.sum("size")).first()[0] == len(rows) and seen.select("batch").distinct().count() == 4
    # every digest is met for the first time once, and every later record carries the locator of that text
    first = seen.filter("first_path is null").select("digest", F.col("path").alias("p"), F.col("row").alias("r"))
    assert first.count() == first.select("digest").distinct().count()
    hits = seen.filter("first_path is not null").join(first, "digest")
    assert hits.filter("first_path <> p or first_row <> r").isEmpty() and not hits.isEmpty()
    noted = spark.read.schema(exact.CLASH).parquet(f"{work}/clash").select("digest").distinct().count()
    assert noted == (0 if bits == 256 else 2)
    # nothing new: nothing is counted again
    exact.ingest(spark, path, work, digest)
    check(exact.decisions(spark, path, work, digest).collect(), rows)


def test_stream_of_small_folds_and_empty_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact.folded, "__defaults__", (1,))
    rows, path = odd_texts(5), str(tmp_path / "documents.parquet")
    write(spark, rows, path)
    check(exact.deduplicate(spark, path).collect(), rows)
    write(spark, [], str(tmp_path / "none.parquet"))
    assert exact.deduplicate(spark, str(tmp_path / "none.parquet")).collect() == []


LETTERS = "ABCDE"


def brute_audit(docs, labels):
    failed = []
    for i, text, lang in docs:
        text = text or ""
        words = text.encode().split()
        f = {"A"} if len(words) < 100 else set()
        f |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        f |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else set()
        f |= {"D"} if any(c in "#$%&*|" for c in text) else set()
        f |= {"E"} if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs) else set()
        failed.append((lang or "", f, any(j == i and q == 1 for j, q, _ in labels if i is not None), any(j == i and t == 1 for j, _, t in labels if i is not None)))
    out = {}
    for part in {p for p, *_ in failed}:
        own = [(f, g, t) for p, f, g, t in failed if p == part]
        shares = dict.fromkeys(LETTERS, 0)
        for order in itertools.permutations(LETTERS):
            left = own
            for step, x in enumerate(order, 1):
                gone, stay = [d for d in left if x in d[0]], [d for d in left if x not in d[0]]
                shares[x] += len(gone)
                out[part, "".join(order), step] = [len(stay), len(gone), sum(x in f for f, _, _ in own) - len(gone), sum(f == {x} for f, _, _ in own), sum(g for _, g, _ in gone), sum(t for _, _, t in gone), x]
                left = stay
        for key, row in out.items():
            if key[0] == part:
                row[6] = shares[row[6]] if row[6] in shares else row[6]
    return {k: tuple(v) for k, v in out.items()}


def audit_rows(seed=6):
    rnd = random.Random(seed)
    words = [f"word{i}" for i in range(300)] + ["CAPITAL", "Ünder", "a|b", "5%", "non breaking"]
    rows = []
    for i in range(120):
        text = rnd.choice([" ", "\t", "\x0b"]).join(rnd.choices(words[: rnd.choice([20, 305])], k=rnd.choice([5, 99, 100, 101, 160])))
        rows.append((i, text, rnd.choice(["en", "de", None, ""])))
    rows += [(200 + i, rows[i % 7][1], "fr") for i in range(40)] + [(3, rows[3][1], "en"), (None, rows[0][1], "en"), (None, None, None), (300, "", "en"), (301, None, "en"), (302, "only " * 30_000, "de")]
    return rows, [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in [*range(0, 250, 2), 4, 4, None]]


@pytest.mark.parametrize("shard_bytes", [1, 3000, audit.SHARD_BYTES])
def test_audit_equals_brute_force(spark, shard_bytes):
    rows, labels = audit_rows()
    docs = spark.createDataFrame([(*r, "own", 5, "own") for r in rows], "doc_id long, text string, lang string, part string, flags int, shard string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit.audit(docs, marks, shard_bytes).collect()}
    assert got == brute_audit(rows, labels)
    if shard_bytes == audit.SHARD_BYTES:
        assert audit.audit(docs.limit(0), marks).count() == 0 and audit.audit(docs, marks.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_shards_are_recoded_to_one_dictionary(spark):
    docs = spark.createDataFrame([(i, "", t) for i, t in enumerate(["b a b", "c a", "", "a d d d"])], "doc_id long, part string, text string").coalesce(1)
    made = audit.Cut(audit.shards(docs, 1)).df
    words = {r.shard: r.words for r in made.collect()}
    pairs = {(words[r.shard][p], c) for r in audit.coded(made).collect() for p, c in zip(r.places, r.codes, strict=True)}
    assert sorted(w for w, _ in pairs) == [b"a", b"b", b"c", b"d"] and len({c for _, c in pairs}) == 4
    rows = audit.measures(audit.encoded(made)).orderBy("doc_id").select("total", "distinct").collect()
    assert [tuple(r) for r in rows] == [(3, 2), (2, 2), (0, 0), (4, 2)]


def test_audit_writes_few_shards_to_a_row_group(spark, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    groups = []

    class Watched(audit.Cut):
        def drop(self):
            groups.extend(f.metadata.row_group(k).num_rows for f in map(pq.ParquetFile, glob.glob(f"{self.path.removeprefix('file:')}/*.parquet")) for k in range(f.metadata.num_row_groups))
            super().drop()

    monkeypatch.setattr(audit, "Cut", Watched)
    monkeypatch.setattr(audit, "BLOCK_BYTES", 64 * 1024, raising=False)
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.hash("doc_id", i).cast("string")))
    docs = spark.range(0, 60, 1, 1).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("x").alias("source")).withColumn("text", text)
    marks = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert audit.patterns(docs, marks, 9000).agg(F.sum("n")).first()[0] == 60
    # one task makes about thirty shards, none of which may wait for the others
    assert sum(groups) >= 25 and max(groups) <= 6
