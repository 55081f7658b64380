"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded: rates of character
classes and of pairs of them, word lengths, repetition of words. A gated attention
(Ilse et al., "Attention-based deep multiple instance learning", 2018) gives each
passage of a document a weight; the weighted passage representation is scored. All
is learned from labels of whole documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldlark.llm.words import SpanHasher
from fieldlark.session import cut_lineage

PASSAGE = 100  # words
SAMPLE = 6000  # labelled documents to learn from, at most
PASSAGES = 1 << 18  # passages to learn from, at most, in all of them
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.01, 1e-4
ACCEPT = 0.7

_CLASS_OF = {**{c: 1 for c in b"abcdefghijklmnopqrstuvwxyz"}, **{c: 2 for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"},
             **{c: 3 for c in b"0123456789"}, 32: 4, 10: 5, **{c: 6 for c in b".,;:"}, **{c: 7 for c in b"!?"},
             **{c: 8 for c in b"|"}, **{c: 9 for c in b"#$%&*@^~"}, **{c: 10 for c in b"()[]{}<>\"'`"},
             **{c: 11 for c in b"+-=/\\_"}}
CLASSES = 13
_CLASSES = np.array([12 if b >= 128 else _CLASS_OF.get(b, 0) for b in range(256)], np.int64)
EXTRA = 6
WIDTH = CLASSES + CLASSES * CLASSES + EXTRA


def passages(hasher: SpanHasher, text: str | None) -> np.ndarray:
    """A row of features for every passage of a text; a text without words is one passage of zeros."""
    data = (text or "").encode("utf-8", "replace")
    raw = np.frombuffer(data, np.uint8)
    kind = _CLASSES[raw]
    gap = np.isin(raw, (32, 9, 10, 11, 12, 13))
    begins = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]])) if len(raw) else np.empty(0, int)
    if not len(begins):
        return np.zeros((1, WIDTH), np.float32)
    ends = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1
    n = -(-len(begins) // PASSAGE)
    of_word = np.arange(len(begins)) // PASSAGE
    of_byte = np.zeros(len(raw), np.int64)
    of_byte[begins[PASSAGE::PASSAGE]] = 1
    of_byte = np.cumsum(of_byte)
    out = np.zeros((n, WIDTH))
    size = np.bincount(of_byte, minlength=n)[:, None]
    out[:, :CLASSES] = np.bincount(of_byte * CLASSES + kind, minlength=n * CLASSES).reshape(n, -1) / size
    pair = kind[:-1] * CLASSES + kind[1:]
    out[:, CLASSES: -EXTRA] = np.bincount(
        of_byte[:-1] * CLASSES**2 + pair, minlength=n * CLASSES**2).reshape(n, -1) / size
    words = np.bincount(of_word, minlength=n)
    hasher.grow(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hasher.values[raw] * hasher.powers[: len(raw)])])
    word = hasher.spans(sums, begins, ends)
    order = np.lexsort((word, of_word))
    new = np.concatenate([[True], (word[order][1:] != word[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])])
    distinct = np.bincount(of_word[order], new, minlength=n)
    again = np.concatenate([[False], (word[1:] == word[:-1]) & (of_word[1:] == of_word[:-1])])
    known = np.unique(word)
    lengths = ends - begins
    out[:, -6] = distinct / words
    out[:, -5] = np.bincount(of_word, again, minlength=n) / words
    out[:, -4] = np.bincount(of_word, lengths, minlength=n) / words / 10
    out[:, -3] = np.log1p(words) / np.log1p(PASSAGE)
    out[:, -2] = len(known) / len(word)
    out[:, -1] = np.log1p(len(word)) / 10
    return out.astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    parameters: dict[str, np.ndarray]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def scores(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each bag of rows that begins at *starts*, and the attention of each row."""
        out = _forward(self.parameters, self.encode(x), starts)
        return out["score"], out["attention"]


def _forward(p: dict, x: np.ndarray, starts: np.ndarray) -> dict:
    bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * g) @ p["w"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    attention = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(attention[:, None] * h, starts, axis=0)
    score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
    return {"bag": bag, "h": h, "t": t, "g": g, "attention": attention, "z": z, "score": score}


def _gradients(p: dict, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict:
    f = _forward(p, x, starts)
    bag, h, t, g, a = f["bag"], f["h"], f["t"], f["g"], f["attention"]
    d_out = (f["score"] - y) / len(y)
    d_z = d_out[:, None] * p["c"]
    d_a = (h * d_z[bag]).sum(1)
    d_e = a * (d_a - np.add.reduceat(a * d_a, starts)[bag])
    d_tg = d_e[:, None] * p["w"]
    d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
    d_h = a[:, None] * d_z[bag] + d_t @ p["V"].T + d_g @ p["U"].T
    d_pre = d_h * (1 - h * h)
    return {"W": x.T @ d_pre, "b": d_pre.sum(0), "V": h.T @ d_t, "U": h.T @ d_g, "w": ((t * g) * d_e[:, None]).sum(0),
            "c": f["z"].T @ d_out, "d": d_out.sum(keepdims=True)}


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model | None:
    """Adam on the log loss of document labels; None without bags of both labels."""
    labels = np.asarray(labels, float)
    if not len(bags) or labels.min() == labels.max():
        return None
    rows = np.concatenate(bags).astype(np.float64)
    lengths = np.array([len(b) for b in bags])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    model = Model(rows.mean(0), rows.std(0) + 1e-3, {})
    x = model.encode(rows)
    draw = np.random.Generator(np.random.PCG64(seed))
    p = {"W": draw.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), "b": np.zeros(HIDDEN),
         "V": draw.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)), "U": draw.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)),
         "w": draw.normal(0, 1 / np.sqrt(GATE), GATE), "c": draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "d": np.zeros(1)}
    m, v, step = {k: 0 * q for k, q in p.items()}, {k: 0 * q for k, q in p.items()}, 0
    for epoch in range(EPOCHS):
        order = draw.permutation(len(bags))
        rate = RATE * (1 - epoch / EPOCHS)
        for a in range(0, len(order), BATCH):
            own = order[a: a + BATCH]
            at = np.concatenate([np.arange(first[i], first[i] + lengths[i]) for i in own])
            starts = np.concatenate([[0], np.cumsum(lengths[own])[:-1]])
            step += 1
            for k, g in _gradients(p, x[at], starts, labels[own]).items():
                g = g + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.parameters = p
    return model


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
        label_column: str = "quality", sample: int = SAMPLE, passages_bound: int = PASSAGES) -> Model | None:
    """Learn from the whole texts of at most *sample* labelled documents, drawn by a hash of the id.

    Labels that are null teach nothing; a document labelled more than once has the rounded mean. Of documents that share
    an id the one with the least hash of its text is taken. Drawn documents beyond *passages_bound* passages in all, in
    the order of the draw, teach nothing either. None without documents of both labels.
    """
    spark = docs.sparkSession
    drawn = (
        labels.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label_column}`").cast("double").alias("y"))
        .where("id is not null and y is not null").groupBy("id").agg(F.round(F.avg("y")).alias("y"))
        .orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(sample)
    )
    texts = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))

    def least_so_far(batches):
        least: dict = {}
        for batch in batches:
            own = []
            for i, (known, key) in enumerate(zip(batch.column("id").to_pylist(), batch.column("key").to_pylist())):
                if known not in least or key < least[known]:
                    least[known] = key
                    own.append(i)
            yield batch.take(pa.array(own, pa.int64()))

    def encoded(batches):
        hasher = SpanHasher()
        for batch in batches:
            bags = [passages(hasher, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.string()), batch.column("y"), pa.array([len(b) for b in bags], pa.int64()),
                 pa.array([b.tobytes() for b in bags], pa.binary())], names=["id", "y", "n", "bag"])

    # at most *sample* rows of two numbers go out; a task sends few rows of an id on, however many it has
    rows = texts.withColumn("key", F.xxhash64("text")).join(F.broadcast(drawn), "id")
    rows = rows.mapInArrow(least_so_far, rows.schema).groupBy("id").agg(F.min(F.struct("key", "text", "y")).alias("r"))
    bags = cut_lineage(
        rows.select("id", "r.text", "r.y").mapInArrow(encoded, "id string, y double, n long, bag binary"), "quality-sample")
    taken, total = [], 0
    for known, n in bags.orderBy(F.xxhash64("id"), "id").select("id", "n").collect():
        if total + n <= passages_bound:
            taken.append(known)
            total += n
    seen = bags.where(F.col("id").isin(taken)).collect()
    seen.sort(key=lambda r: (r.id, r.bag))
    return train([np.frombuffer(bytes(r.bag), np.float32).reshape(-1, WIDTH) for r in seen], np.array([r.y for r in seen]))


def score(df: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """*df* with score (0 to 1) and predicted (1 from a score of 0.7 on); columns of these names are replaced.

    Null and empty texts are scored as one passage without words. Without a model every score is 0.5. Whole texts
    count, each row by itself; an empty table stays empty.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        hasher, model = SpanHasher(), sent.value
        for batch in batches:
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "__text"]
            texts, scores = batch.column("__text").to_pylist(), []
            for a in range(0, len(texts), 64):
                bags = [passages(hasher, t) for t in texts[a: a + 64]]
                starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
                scores.append(np.full(len(bags), 0.5) if model is None else model.scores(np.concatenate(bags), starts)[0])
            s = np.concatenate([np.empty(0), *scores])
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(s), pa.array((s >= ACCEPT).astype(np.int32))],
                names=[*(c for c in batch.schema.names if c != "__text"), "score", "predicted"])

    kept = [c for c in df.columns if c not in ("score", "predicted")]
    source = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_column}`").alias("__text"))
    schema = source.drop("__text").schema.add("score", "double").add("predicted", "integer")
    return source.mapInArrow(run, schema)
