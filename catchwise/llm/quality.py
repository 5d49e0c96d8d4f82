"""Quality score by a byte-level convolutional network in numpy.

The bytes of a text are cut into chunks of ``CHUNK`` positions; a chunk also holds the ``WIDTH`` - 1 bytes that
follow, so neighbouring chunks overlap and every window of the text lies in one. A filter's answer at a position is
the sum of one learned number per offset and byte. Answers are max-pooled in each chunk; the largest and the mean
pooled answers of all chunks are combined by a logistic output into one probability. Texts are scored whole and
where they are read.

The network is fitted on the driver on at most ``SAMPLE`` labelled documents of at most ``SAMPLE_BYTES`` bytes each,
picked by the hash of their id (parameters of the fit only). Null text counts as empty; empty text is one chunk of
padding. Null labels and repeated rows of one id are no further examples. If only one class, or none, is labelled,
every text gets the share of label 1 (one half if none). Input columns named like an added column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchwise.llm.common import map_text

CHUNK, WIDTH, FILTERS = 512, 6, 16
SAMPLE, SAMPLE_BYTES = 3000, 32_768
EPOCHS, BATCH, RATE, DECAY = 10, 32, 0.01, 1e-5
#: Chunks whose answers are held at once.
BLOCK = 64
THRESHOLD = 0.3


@dataclass
class Network:
    table: np.ndarray  # (WIDTH, 257, FILTERS): an offset's number for each byte; 256 is padding
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS,)
    base: float


def chunks(text: str | None) -> np.ndarray:
    """(number of chunks, CHUNK + WIDTH - 1) bytes, 256 beyond the text."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    n = max(1, -(-len(data) // CHUNK))
    padded = np.full(n * CHUNK + WIDTH - 1, 256, dtype=np.int16)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK + WIDTH - 1)[::CHUNK]


def pooled(net: Network, cut: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each chunk's largest answer of each filter, after the bias and a floor at 0; and where it stands."""
    n = len(cut)
    best = np.empty((n, FILTERS), dtype=np.float32)
    where = np.empty((n, FILTERS), dtype=np.int64) if places else None
    for at in range(0, n, BLOCK):
        block = cut[at : at + BLOCK]
        answers = net.table[0][block[:, :CHUNK]]
        for k in range(1, WIDTH):
            answers += net.table[k][block[:, k : k + CHUNK]]
        if where is not None:
            where[at : at + BLOCK] = answers.argmax(axis=1)
        best[at : at + BLOCK] = answers.max(axis=1)
    return np.maximum(best + net.bias, 0), where


def combined(pools: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest and mean pooled answers of each text; ``first`` holds the texts' first chunks."""
    size = np.diff(np.append(first, len(pools)))[:, None]
    return np.hstack([np.maximum.reduceat(pools, first), np.add.reduceat(pools, first) / size])


def probability(net: Network, features: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ net.out + net.base, -30, 30)))


def score(net: Network, texts: list[str | None]) -> list[float]:
    out: list[float] = []
    group: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        first = np.cumsum([0, *map(len, group)])[:-1]
        out.extend(probability(net, combined(pooled(net, np.concatenate(group))[0], first)).astype(float).tolist())

    for t in texts:
        group.append(chunks(t))
        held += len(group[-1])
        if held >= 16 * BLOCK:
            flush()
            group, held = [], 0
    if group:
        flush()
    return out


def fit(texts: list[str | None], labels: list[int], seed: int = 3) -> Network:
    """Adam on the logistic loss; a pooled answer's error goes to the window that gave it."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, dtype=np.float32)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    table = rng.normal(0, 0.15, (WIDTH, 257, FILTERS)).astype(np.float32)
    net = Network(table, np.zeros(FILTERS, dtype=np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), float(np.log(share / (1 - share))))
    if len(set(labels)) < 2:
        net.out[:] = 0
        net.base = float(np.log(share / (1 - share))) if len(y) else 0.0
        return net
    cut = [chunks(t) for t in texts]
    state = [np.zeros_like(v) for v in (net.table, net.table, net.bias, net.bias, net.out, net.out)] + [0.0, 0.0]
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + 0.001
        for rows in np.array_split(rng.permutation(len(cut)), -(-len(cut) // BATCH)):
            own = [cut[i] for i in rows]
            first = np.cumsum([0, *map(len, own)])[:-1]
            size = np.array([len(c) for c in own])
            x = np.concatenate(own)
            pools, where = pooled(net, x, True)
            features = combined(pools, first)
            error = (probability(net, features) - y[rows]).astype(np.float32) / len(rows)
            to_out, to_base = features.T @ error, float(error.sum())
            back = error[:, None] * net.out[None, :]
            doc = np.repeat(np.arange(len(rows)), size)
            to_pool = back[doc, FILTERS:] / size[doc][:, None]
            top = pools == features[doc, :FILTERS]
            to_pool += top * back[doc, :FILTERS] / np.maximum(np.add.reduceat(top, first).astype(np.float32)[doc], 1)
            to_pool *= pools > 0
            grad = np.zeros_like(net.table)
            filters = np.arange(FILTERS)[None, :]
            line = np.arange(len(x))[:, None]
            for k in range(WIDTH):
                np.add.at(grad[k], (x[line, where + k], filters), to_pool)
            step += 1
            for i, (value, g) in enumerate(((net.table, grad + DECAY * net.table), (net.bias, to_pool.sum(axis=0)), (net.out, to_out + DECAY * net.out))):
                m, v = state[2 * i], state[2 * i + 1]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            state[6] += 0.1 * (to_base - state[6])
            state[7] += 0.001 * (to_base**2 - state[7])
            net.base -= rate * state[6] / (1 - 0.9**step) / (np.sqrt(state[7] / (1 - 0.999**step)) + 1e-8)
    return net


def fold(doc_id: str, folds: int) -> Column:
    """Remainder of the CRC-32 of the id written as text."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)).cast("int")


def examples(docs: DataFrame, labels: DataFrame, label: str, keep: Column) -> tuple[list[str | None], list[int]]:
    """At most ``SAMPLE`` labelled texts, picked by the hash of the id; one for an id."""
    marked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.min(label).cast("int").alias("_label"))
    picked = marked.orderBy(F.xxhash64("doc_id", F.lit(10)), "doc_id").limit(SAMPLE)
    texts = docs.filter(F.octet_length(F.coalesce("text", F.lit(""))) <= SAMPLE_BYTES).select("doc_id", "text")
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_label").alias("_label")).orderBy("doc_id").collect()
    return [r["text"] for r in rows], [r["_label"] for r in rows]


def train(docs: DataFrame, labels: DataFrame, label: str, keep: Column) -> Network:
    return fit(*examples(docs, labels, label, keep))


def classify(df: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """Adds ``score`` and ``predicted`` (1 from ``THRESHOLD``)."""
    shared = df.sparkSession.sparkContext.broadcast(net)

    def run(texts: list[str | None]) -> list:
        made = score(shared.value, texts)
        return [made, [int(s >= THRESHOLD) for s in made]]

    return map_text(df, [text], run, "score double, predicted int")
