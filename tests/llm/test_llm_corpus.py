"""Operators over whole tables: shards, mixtures, near copies, vectors, nearest neighbours, the pipeline."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from catchwise.llm import forest, graph, hyperplanes, minhash, mixing, quality, queries, secrets, shards

DOCS = "doc_id long, text string, source string, shard string, target double, repeats int, size int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "own", 0.5, 7, 9) for i, t, s in rows], DOCS)


def test_shards_are_whole_and_even(spark):
    rnd = random.Random(3)
    rows = [(i, "x" * rnd.randint(0, 300), "a") for i in range(600)] + [(600 + i, "same text", "b") for i in range(700)] + [(2000, "big" * 3000, None), (2001, None, None), (None, "n", "c"), (5, "twin", "c"), (5, "twin", "c")]
    df = docs(spark, rows)
    out = shards.shards(df, F.col("text"), F.col("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)) + 1, 8)
    got = out.collect()
    assert len(got) == len(rows) and sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t, _ in rows)
    total, most = sum(len(t or "") + 1 for _, t, _ in rows), 0
    for s in range(8):
        own = [r for r in got if r["shard"] == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        most = max(most, sum(len(r.text or "") + 1 for r in own))
    assert most <= total / 8 * 1.02 + 9001
    assert "size" in out.columns and shards.shards(df.limit(0), F.col("text"), F.col("doc_id"), F.lit(1), 8).count() == 0
    few = shards.shards(df.limit(2), F.col("text"), F.col("doc_id"), F.lit(None), 8)
    assert few.count() == 2 and few.filter("shard between 0 and 7").count() == 2


def test_shard_plan_has_no_python(spark, sf):
    plan = queries.QUERIES["op1_sampled_splitters"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def brute_knapsack(lengths, counts, budget):
    reach = {0}
    for length, n in zip(lengths, counts, strict=True):
        reach = {r + k * length for r in reach for k in range(n + 1)}
    return min(reach, key=lambda r: (abs(r - budget), r))


def test_knapsack_is_exact():
    rnd = random.Random(5)
    for _ in range(200):
        lengths = rnd.sample(range(1, 30), rnd.randint(1, 6))
        counts = [rnd.randint(0, 5) for _ in lengths]
        budget = rnd.randint(0, 120)
        took = mixing.knapsack(lengths, counts, budget)
        assert all(took[x] <= n for x, n in zip(lengths, counts, strict=True) if x in took)
        assert sum(k * v for k, v in took.items()) == brute_knapsack(lengths, counts, budget)


@pytest.mark.parametrize(("long", "target"), [
    ({200_000: 1}, 600_000), ({2_000_000: 1}, 900_000), ({2_000_000: 1}, 2_500_000), ({2_000_000: 1}, 1_600_000), ({300_000: 7, 90_000: 2}, 1_000_001), ({5_000_000: 1}, 4_400_000),
])
def test_mixture_beside_very_long_documents(long, target):
    """Short documents of 75 to 124 words fill what no long one fits, and make room for a long one; 995,000 words in all."""
    pairs = sorted([*long.items(), *((n, 200) for n in range(75, 125))], reverse=True)
    lengths, counts = np.array(pairs).T
    repeats, take = mixing.fit(lengths, counts, float(target))
    assert repeats == 0 and ((0 <= take) & (take <= counts)).all()
    sums = {0}
    for length, n in long.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    best = min(max(0, target - s - 995_000, s - target) for s in sums)
    assert abs(int((take * lengths).sum()) - target) == best


def brute_targets(sizes, weights=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 3 * sizes[s]]
        if not over:
            out.update({s: weight[s] * level for s in open_})
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def test_mixture(spark):
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.randint(1, 40), rnd.choice(["a", "b", "é", None])) for i in range(900)] + [(1000 + i, "u v w", "hot") for i in range(2500)]
    rows += [(1, "tiny", "t"), (2, None, "empty"), (3, "  ", "empty"), (None, "one two", "a"), (7, "re peat", "rep")] + [(7, "re peat", "rep")] * 30
    df = docs(spark, rows)
    got = mixing.mix(df, "doc_id", "source", mixing.words("text")).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    wanted = brute_targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]} and all(abs(r.target - wanted[s]) < 1e-6 * (1 + wanted[s]) for r in own)
        taken = sum(r.copies * r["size"] for r in own)
        assert abs(taken - wanted[s]) <= 3, (s, taken, wanted[s])
        assert all(0 <= r.copies <= 3 for r in own)
    again = mixing.mix(df.repartition(5, "text"), "doc_id", "source", mixing.words("text")).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r["size"], r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(df.limit(0), "doc_id", "source", mixing.words("text")).count() == 0


def brute_components(ids, links):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in ids}


def test_components(spark):
    rnd = random.Random(6)
    links = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 150)] + [(rnd.randint(1000, 1300), rnd.randint(1000, 1300)) for _ in range(200)] + [(7, 7), (3, 2), (3, 2)]
    got = dict(graph.components(spark.createDataFrame([*links, (None, 4)], "a long, b long")).collect())
    wanted = brute_components({x for e in links for x in e}, links)
    assert {k: got.get(k, k) for k in wanted} == wanted
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def words_of(text):
    return (text or "").encode().lower().split()


def brute_near(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, brute_components(ids, links)


def corpus(seed=8):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(4))
    base = [[word() for _ in range(rnd.choice([3, 12, 60, 400]))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for b in base:  # copies, near copies, chains of near copies
        texts += [" ".join(b).upper(), "\t".join(b) + "\n"]
        now = list(b)
        for _ in range(6):
            now = list(now)
            now[rnd.randrange(len(now))] = word()
            texts.append(" ".join(now))
    return list(enumerate([*texts, None, "", " \n", "one", "ONE ", " one", "a b c", "a b c d", "É b c d", "é b c d", "zz " * 30000]))


@pytest.mark.parametrize(("width", "percent"), [(4, 80), (5, 80)])
def test_near_copies(spark, width, percent):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "own", True) for i, t in rows], "doc_id long, text string, component_id string, kept boolean")
    got = {r.doc_id: r for r in minhash.groups(df, width, percent).collect()}
    sizes, roots = brute_near(rows, width, percent)
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert {i: r.component_id for i, r in got.items()} == roots
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    left = minhash.deduplicate(df.unionByName(df.limit(3)), width, percent)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted({*roots.values()})


def test_near_copies_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (4, None), (None, None)], "doc_id long, text string")
    got = minhash.groups(df, 4, 80).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("3", "3", True)] * 2 + [("4", "4", True)] + [("None", "None", True)] * 2
    assert minhash.groups(df.limit(0), 4, 80).count() == 0 and minhash.deduplicate(df).count() == 4


def test_circulant_coordinates():
    s = minhash.shingler(4)
    own = s.shingles(s.split("a b c d e f g h"))
    places = s.first[(own & np.uint64(minhash.UNIVERSE - 1)).astype(int)]
    second = s.shifted[:, 0]
    wanted = [min(int(second[(p + k) % minhash.UNIVERSE]) for p in places) for k in range(minhash.COORDINATES)]
    assert s.signature(own).tolist() == wanted


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "own") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, unit string")


def odd_vectors(seed=9):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=16).tolist(), i % 3) for i in range(200)]
    for i in range(60):
        base = np.array(rows[i][1])
        rows.append((300 + i, (base + rng.normal(size=16) * 0.05 * np.linalg.norm(base) / 4).tolist(), rows[i][2]))
        rows.append((400 + i, rows[i][1], rows[i][2]))
        rows.append((500 + i, (2 * base).tolist(), (rows[i][2] + (i % 2)) % 3))
    return [*rows, (900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, None], 1), (903, [float("nan")] * 16, 1), (904, [float("inf")] + [1.0] * 15, 1), (905, [], 1), (906, rows[0][1], None), (None, rows[0][1], 0), (907, [1.0], 1), (908, [2.0], 1)]


def clean(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_near_vectors(spark):
    rows = odd_vectors()
    got = {r.vec_id: r for r in hyperplanes.groups(vectors(spark, rows), "vec_id", "embedding", "label", 0.93).collect() if r.vec_id is not None}
    good = [(i, np.array(v, dtype=np.float32).astype(float), lab) for i, v, lab in rows if i is not None and lab is not None and clean(v)]
    links = [(a, b) for n, (a, u, x) in enumerate(good) for b, w, y in good[n + 1 :] if x == y and len(u) == len(w) and u @ w / math.sqrt((u @ u) * (w @ w)) >= 0.93]
    ids = [i for i, _, _ in rows if i is not None]
    count = {i: 0 for i in ids}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert {i: r.n_links for i, r in got.items()} == count
    assert {i: r.component_id for i, r in got.items()} == brute_components(ids, links)
    empty = vectors(spark, rows).limit(0)
    assert hyperplanes.groups(empty, "vec_id", "embedding", "label", 0.93).count() == 0
    twins = hyperplanes.groups(vectors(spark, [rows[0]] * 3), "vec_id", "embedding", "label", 0.93).collect()
    assert {(r.n_links, r.component_id, r.kept) for r in twins} == {(2, 0, True)}


def test_tables_follow_the_size():
    small, large = hyperplanes.tables_for(1000, 0.93), hyperplanes.tables_for(10**8, 0.93)
    assert large[0] > small[0] and large[1] > small[1] and (1 - small[2] ** small[0]) ** small[1] <= 1e-5 * 1.01


def test_nearest_of_odd_rows(spark):
    rows = odd_vectors()
    df = vectors(spark, rows + rows[:2])
    got = forest.search(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20).collect()
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows if i is not None and clean(v)]
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {i for i, _ in good if i % 20 == 0}
    for q, v in good:
        if q % 20:
            continue
        wanted = sorted(((-float(np.cumsum(v * w)[-1]), i) for i, w in good if i != q and len(w) == len(v)))[:20]
        own = sorted(by[q], key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(wanted) + 1))
        assert [(-r.score, r.vec_id) for r in own] == wanted
    assert forest.search(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20).count() == 0


def test_forest_recall(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAF", 128)
    rng = np.random.default_rng(3)
    data = rng.normal(size=(6000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    got = forest.search(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 20).toPandas()
    exact, hit = data.astype(float), 0
    for q in range(0, 6000, 50):
        s = exact @ exact[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & set(got[got.query_id == q].vec_id))
    assert hit >= 0.9 * 20 * 120 and len(got) == 20 * 120


def test_forest_visits_less_than_all():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32))
    data = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32)) * 0.1
    f = forest.fit(np.arange(4000), data, float(np.linalg.norm(data, axis=1).max()), 4000 * 8, 20)
    assert f.leaves > 80 and f.visits < f.leaves / 4


def small_corpus(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10001, None, None, None, None), (10002, "", "en", "src1", 0), (10003, "token=abcdefgh12 is it of the and", None, None, 5)], table.schema)
    table = table.unionByName(odd).unionByName(table.limit(4)).withColumns({c: F.lit(f"own {c}") for c in ("size", "target", "predicted", "score", "copies")})
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")


def test_pipeline_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    from catchwise.llm import bpe

    sf, now = small_corpus(spark, tmp_path)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        before = [r.asDict() for r in now.collect()]
        after = [r.asDict() for r in out.collect()]
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == now.columns
        if name == "quality":
            net = quality.train(now, spark.read.parquet(f"{sf}/labels.parquet"), "quality", quality.fold("doc_id", 5) != 0)
            good = [p >= quality.THRESHOLD for p in quality.score(net, [r["text"] for r in before])]
            wanted = [r for r, p in zip(before, good, strict=True) if p]
        elif name == "near_duplicates":
            roots = brute_near([(r["doc_id"], r["text"]) for r in before], 5, 80)[1]
            wanted = list({r["doc_id"]: r for r in before if roots[r["doc_id"]] == r["doc_id"]}.values())
        elif name == "secrets":
            clean_text = lambda t: t and secrets.redacted(t, sum(secrets.scan_text(t), []))
            wanted = [r | {"text": clean_text(r["text"]), "n_chars": None if r["text"] is None else len(clean_text(r["text"]))} for r in before]
        elif name == "mixture":
            sizes = {}
            for r in before:
                sizes[r["source"]] = sizes.get(r["source"], 0) + len(words_of(r["text"]))
            goal = brute_targets(sizes)
            for s, n in sizes.items():
                took = sum(len(words_of(r["text"])) for r in after if r["source"] == s)
                assert abs(took - goal[s]) <= max(3, 0.02 * goal[s]) and took <= 3 * n
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
            wanted = after
        else:
            library = Tokenizer.from_file(bpe.tokenizer_path())
            ids = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids for r in before}
            assert len(after) == len(before) and all(r["exact"] and np.frombuffer(r["ids"], "<u4").tolist() == ids[r["doc_id"]] for r in after)
            wanted = after
        assert sorted(map(str, after)) == sorted(map(str, wanted)), name
        out.write.parquet(f"{sf}/{k}.parquet")
        now = spark.read.parquet(f"{sf}/{k}.parquet")


def test_pipeline_runs(spark, tmp_path):
    sf, _ = small_corpus(spark, tmp_path)
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and out.filter("not exact").isEmpty()
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{sf}/none/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(f"{sf}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{sf}/none").count() == 0


def test_registered():
    assert {*queries.QUERIES} >= {"pipeline", *(q for q in queries.QUERIES if q.startswith("op"))} and len(queries.QUERIES) == 11
    assert zlib.crc32(b"1") % 5 in range(5)
