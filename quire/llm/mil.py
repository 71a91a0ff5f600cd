"""Document quality by multiple-instance learning with gated attention.

A document is a bag of passages of ``PASSAGE`` words. A passage is described by shares of character classes and by
how much its words repeat, and encoded by a small tanh layer. Gated attention (tanh times sigmoid) gives each passage a
weight, the weighted sum of the encodings is the document, and a logistic output scores it. All parts are learned
together from document labels only.

Fitting uses a sample of bounded size: ``TRAIN_DOCS`` labelled documents by hash order, of each at most ``TRAIN_PASSAGES``
evenly spaced passages; about 20 MB on the driver at most, whatever the corpus. Scoring reads every whole text in one
row-local pass over slices of Arrow batches; the model is a few KB.

Defined cases: a null, empty or blank text is one passage without words and gets a score like any other; duplicate labels
of a document count as good only if all are; labels without a document and null labels are ignored; with labels of
one kind or none every score is that kind's share, 0.5 without any; repeated rows score alike. Scores use the text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import broadcast_checked
from quire.llm.words import NOT_SPACE, cut_words, shards
from quire.session import ship_by_value

PASSAGE = 64
TRAIN_DOCS = 4000
TRAIN_PASSAGES = 64
HIDDEN, GATE = 16, 8
EPOCHS, BATCH, RATE, DECAY = 60, 128, 0.01, 1e-4

#: Character classes of bytes: other, lower, upper, digit, beyond ASCII, blank, line end, sentence mark, exclamation, symbol, bar.
CLASSES = np.zeros(256, np.int64)
for _k, _set in enumerate(
    (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b" \t\x0b\x0c\r", b"\n", b".,;:?'\"()-", b"!", b"#$%&*@^~=+_\\/", b"|<>[]{}"), 1
):
    CLASSES[list(_set)] = _k
N_CLASSES = 11
N_FEATURES = N_CLASSES + 8


def passages(data: np.ndarray, offsets: np.ndarray, powers: dict) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a shard in order, and the number of passages per text (at least one)."""
    hashes, starts, stops, counts = cut_words(data, offsets, powers, NOT_SPACE)
    docs = len(counts)
    per_doc = np.maximum(1, -(-counts // PASSAGE))
    base = np.cumsum(per_doc) - per_doc
    first = np.cumsum(counts) - counts
    n = int(per_doc.sum())
    doc = np.repeat(np.arange(docs), counts)
    at = np.arange(len(hashes)) - first[doc]
    passage = base[doc] + at // PASSAGE
    # a passage's bytes run from its first word to the next passage or the end of the text
    begin = np.repeat(offsets[:-1], per_doc).astype(np.int64)
    heads = np.flatnonzero((at % PASSAGE == 0) & (at > 0))
    begin[passage[heads]] = starts[heads]
    size = np.diff(np.append(begin, len(data)))
    chars = np.bincount(np.repeat(np.arange(n), size) * N_CLASSES + CLASSES[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    words = np.bincount(passage, minlength=n)
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, :N_CLASSES] = chars / np.maximum(1, size)[:, None]
    many = np.maximum(1, words)
    same = lambda k: np.concatenate([np.zeros(min(k, len(hashes)), bool), (hashes[k:] == hashes[:-k]) & (doc[k:] == doc[:-k])])
    for j, k in enumerate((1, 2, 3)):
        out[:, N_CLASSES + j] = np.bincount(passage, weights=same(k), minlength=n) / many
    order = np.lexsort((hashes, passage))
    fresh = np.ones(len(hashes), bool)
    if len(hashes):
        h, p = hashes[order], passage[order]
        fresh[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
        out[:, N_CLASSES + 3] = np.bincount(p[fresh], minlength=n) / many
        order = np.lexsort((hashes, doc))
        h, d = hashes[order], doc[order]
        fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        kinds = np.bincount(d[fresh], minlength=docs)
        out[:, N_CLASSES + 4] = np.repeat(np.log1p(kinds) / np.log1p(np.maximum(1, counts)), per_doc)
    out[:, N_CLASSES + 5] = np.log1p(words) / 4
    out[:, N_CLASSES + 6] = np.repeat(np.log1p(counts) / 8, per_doc)
    out[:, N_CLASSES + 7] = np.bincount(passage, weights=stops - starts, minlength=n) / many / 10
    return out, per_doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward(model: dict, x: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Scores of the bags; ``bags`` holds the number of passages of each, none empty."""
    begin = np.cumsum(bags) - bags
    h = np.tanh(((x - model["mean"]) / model["std"]) @ model["W"] + model["b"])
    a, g = np.tanh(h @ model["V"] + model["v"]), _sigmoid(h @ model["U"] + model["u"])
    e = (a * g) @ model["w"]
    weight = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), bags))
    weight /= np.repeat(np.add.reduceat(weight, begin), bags)
    m = np.add.reduceat(weight[:, None] * h, begin)
    return _sigmoid(m @ model["c"] + model["d"]), (h, a, g, weight, m)


def _gradients(model: dict, x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> dict:
    p, (h, a, g, weight, m) = forward(model, x, bags)
    begin = np.cumsum(bags) - bags
    ds = (p - y) / len(y)
    dm = np.repeat(ds[:, None] * model["c"], bags, axis=0)
    dweight = (dm * h).sum(1)
    de = weight * (dweight - np.repeat(np.add.reduceat(weight * dweight, begin), bags))
    dgate = de[:, None] * model["w"]
    da, dg = dgate * g * (1 - a * a), dgate * a * g * (1 - g)
    dz = (weight[:, None] * dm + da @ model["V"].T + dg @ model["U"].T) * (1 - h * h)
    z = (x - model["mean"]) / model["std"]
    out = {"W": z.T @ dz, "b": dz.sum(0), "V": h.T @ da, "v": da.sum(0), "U": h.T @ dg, "u": dg.sum(0), "w": (a * g).T @ de, "c": m.T @ ds, "d": ds.sum(keepdims=True)}
    return {k: v + DECAY * model[k] for k, v in out.items()}


def fit(x: np.ndarray, bags: np.ndarray, y: np.ndarray, seed: int = 7) -> dict:
    """Train on bags of passages with labels 0 or 1 by Adam."""
    rng = np.random.default_rng(seed)
    n = x.shape[1]
    shapes = {"W": (n, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "v": (GATE,), "U": (HIDDEN, GATE), "u": (GATE,), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
    model = {k: rng.normal(0, s[0] ** -0.5, s) if k.isupper() or k in "wc" else np.zeros(s) for k, s in shapes.items()}
    model["mean"], model["std"] = x.mean(0), np.maximum(x.std(0), 1e-3)
    first, second, step = {k: 0.0 for k in shapes}, {k: 0.0 for k in shapes}, 0
    begin = np.cumsum(bags) - bags
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            take = order[k : k + BATCH]
            rows = np.concatenate([np.arange(begin[i], begin[i] + bags[i]) for i in take])
            step += 1
            for key, grad in _gradients(model, x[rows], bags[take], y[take]).items():
                first[key] = 0.9 * first[key] + 0.1 * grad
                second[key] = 0.999 * second[key] + 0.001 * grad * grad
                model[key] = model[key] - rate * (first[key] / (1 - 0.9**step)) / (np.sqrt(second[key] / (1 - 0.999**step)) + 1e-8)
    return model


def _ship() -> None:
    ship_by_value(__name__)
    ship_by_value("quire.llm.words")


def training_bags(docs: DataFrame, good: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, bag sizes and labels of the bounded sample of documents named in ``good`` (``_id``, ``_good``).

    Ids are chosen first, so tasks send ids and no texts; of rows with the same id one text is taken.
    """
    _ship()
    known = docs.select(F.col(key).alias("_id")).join(broadcast_checked(good), "_id").distinct()
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_DOCS)  # a fixed number of rows, so it can be broadcast
    sample = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    sample = sample.groupBy("_id").agg(F.min("_text").alias("_text"), F.first(F.col("_good").cast("int")).alias("_y")).select("_y", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: dict = {}
        for batch in batches:
            for a, b, data, offsets in shards(batch.column(1)):
                x, per = passages(data, offsets, powers)
                begin = np.cumsum(per) - per
                packed = [x[s + np.unique(np.linspace(0, n - 1, min(n, TRAIN_PASSAGES)).round().astype(int))].tobytes() for s, n in zip(begin, per, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(packed, pa.binary())], names=["y", "x"])

    rows = sample.mapInArrow(run, "y int, x binary").collect()
    rows.sort(key=lambda r: (bytes(r["x"]), r["y"]))  # the same model however the sample was dealt out
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    x = np.concatenate(bags).astype(np.float64) if bags else np.zeros((0, N_FEATURES))
    return x, np.array([len(b) for b in bags], np.int64), np.array([r["y"] for r in rows], np.float64)


def train(docs: DataFrame, good: DataFrame, text: str = "text", key: str = "doc_id") -> dict:
    """The fitted model, or a constant where only one kind of label exists."""
    x, bags, y = training_bags(docs, good, text, key)
    if not len(y) or y.min() == y.max():
        return {"constant": float(y[0]) if len(y) else 0.5}
    return fit(x, bags, y)


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` for every row."""
    _ship()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: dict = {}
        for batch in batches:
            for a, b, data, offsets in shards(batch.column(1)):
                x, per = passages(data, offsets, powers)
                fixed = shared.value.get("constant")
                p = np.full(b - a, fixed) if fixed is not None else forward(shared.value, x, per)[0]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(p, pa.float64())], names=["doc_id", "score"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['_doc'].dataType.simpleString()}, score double")


def held_out(doc_id: Column) -> Column:
    """The fold kept from training: checksum of the id as text, remainder 1 modulo 3; a null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op7_quality_mil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document by a model fitted on the labels outside the held-out fold."""
    good = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg((F.min("quality") == 1).alias("_good"))
    )
    return score(docs, train(docs, good)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
