"""Operator 6: a quality classifier by attention over passages (multiple-instance learning).

A document is a bag of passages. Every passage is encoded on its own, from shares of its
pairs of character kinds and from learned vectors of its hashed words; gated attention says
how much each passage counts, and the document's score is that of the weighted sum of its
passages' representations. Only documents have labels: what makes a passage matter is
learned from them. The model is fitted on a bounded sample of labelled documents; scoring
reads every whole text, once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import held, masked, text_runs

#: Bytes of a passage; the last one of a text may be shorter.
PASSAGE = 512


def _classes() -> np.ndarray:
    """What kind of character a UTF-8 byte belongs to."""
    kinds = np.full(256, 11, np.uint8)
    for kind, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"'\"()-", b"!?", b"|", b"#$%&*", bytes(range(128, 256)))):
        kinds[list(chars)] = kind
    return kinds


CLASSES = 12
_KIND = _classes()
FEATURES = CLASSES * CLASSES + 2
#: Words are hashed to so many vectors.
BUCKET_BITS = 11


class Bags:
    """Encoded passages of some texts: rows of FEATURES numbers, the buckets of their words, and
    how many words each passage and how many passages each text has."""

    def __init__(self, x: np.ndarray, words: np.ndarray, sizes: np.ndarray, counts: np.ndarray):
        self.x, self.words, self.sizes, self.counts = x, words, sizes, counts

    def some(self, texts: np.ndarray) -> Bags:
        """The bags of these texts, in this order."""
        n, first = self.counts[texts], (np.cumsum(self.counts) - self.counts)[texts]
        rows = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        k, begin = self.sizes[rows], (np.cumsum(self.sizes) - self.sizes)[rows]
        at = np.repeat(begin - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        return Bags(self.x[rows], self.words[at], k, n)


def passages(texts: pa.Array, passage: int = PASSAGE) -> Bags:
    """Encoded passages of all texts.

    A passage's numbers are the shares of its neighbouring pairs of character kinds, the
    logarithm of its length, and the share of its words that it has had before. A text that
    is null or empty has one passage without any pair or word.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.empty(0, np.uint8)
    sizes = np.diff(bounds)
    counts = np.maximum(1, -(-sizes // passage))
    total = int(counts.sum())
    first = np.repeat(bounds[:-1] - bounds[0], counts) + passage * (np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts))
    length = np.minimum(passage, np.repeat(bounds[1:] - bounds[0], counts) - first)
    out, buckets, words = np.zeros((total, FEATURES), np.float32), np.empty(0, np.int32), np.zeros(total, np.int64)
    if len(data):
        kinds = _KIND[data]
        owner = np.repeat(np.arange(total, dtype=np.int32), length)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        cell = owner[inside] * np.int32(CLASSES * CLASSES) + kinds[inside] * np.int32(CLASSES) + kinds[inside + 1]
        pairs = np.bincount(cell, minlength=total * CLASSES * CLASSES).reshape(total, -1)
        out[:, :-2] = pairs / np.maximum(1, length - 1)[:, None]
        # Words are told apart by sums of powers of their bytes, which is enough to count repeats.
        blank = (kinds == 3) | (kinds == 4)
        starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1] | (np.diff(owner) != 0)]))
        weight = _SCATTER[data] * np.where(blank, np.uint64(0), np.uint64(1))
        if len(starts):
            place = np.arange(len(data)) - starts[np.maximum(np.searchsorted(starts, np.arange(len(data)), "right") - 1, 0)]
            word = np.add.reduceat(weight * _POWERS[place % len(_POWERS)], starts)
            of = owner[starts]
            key = np.sort(word << np.uint64(24) | of.astype(np.uint64) & np.uint64(0xFFFFFF))
            again = np.flatnonzero(key[1:] == key[:-1])
            words = np.bincount(of, minlength=total)
            out[:, -1] = np.bincount((key[again] & np.uint64(0xFFFFFF)).astype(np.int64), minlength=total)[:total] / np.maximum(1, words)
            buckets = (word * _ODD >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    out[:, -2] = np.log1p(length)
    return Bags(out, buckets, words, counts)


_DRAW = np.random.default_rng(17)
_SCATTER = _DRAW.integers(1, 1 << 63, 256, np.uint64)
_POWERS = _DRAW.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the rows of each group; groups follow each other and may be empty."""
    out = np.zeros((len(sizes), values.shape[1]), values.dtype)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[full])
    return out


class AttentionModel:
    """h = tanh(x E + mean W[words] + e); weight by softmax of g(tanh(h V) * sigmoid(h U)); score sigmoid(z c + b)."""

    def __init__(self, features: int = FEATURES, hidden: int = 24, gate: int = 12, buckets: int = 1 << BUCKET_BITS, seed: int = 7):
        draw = np.random.default_rng(seed)
        init = lambda *s: draw.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        #: Word vectors start at zero, so that words that no document taught say nothing.
        self.p = {"E": init(features, hidden), "W": np.zeros((buckets, hidden), np.float32), "e": np.zeros(hidden, np.float32), "V": init(hidden, gate), "U": init(hidden, gate), "g": init(gate), "c": init(hidden), "b": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(features, np.float32), np.ones(features, np.float32)

    def _forward(self, bags: Bags) -> dict:
        p, counts = self.p, bags.counts
        starts = np.cumsum(counts) - counts
        x = np.clip((bags.x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["E"] + _sums(p["W"][bags.words], bags.sizes) / np.maximum(1, bags.sizes)[:, None].astype(x.dtype) + p["e"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        logit = (t * s) @ p["g"]
        bag = np.repeat(np.arange(len(counts)), counts)
        raised = np.exp(logit - np.maximum.reduceat(logit, starts)[bag])
        a = raised / np.add.reduceat(raised, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "bag": bag, "starts": starts, "y": _sigmoid(z @ p["c"] + p["b"])}

    def score(self, bags: Bags) -> np.ndarray:
        """A score from 0 to 1 for each bag of passages; every bag has one passage at least."""
        return self._forward(bags)["y"].astype(np.float64) if len(bags.counts) else np.empty(0)

    def attention(self, bags: Bags) -> np.ndarray:
        """The weight of each passage within its bag."""
        return self._forward(bags)["a"]

    def fit(self, bags: Bags, labels: np.ndarray, steps: int = 800, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4, seed: int = 3) -> AttentionModel:
        """About ``steps`` steps of Adam on the cross-entropy of documents' labels (0 to 1)."""
        epochs = max(1, round(steps / max(1, -(-len(labels) // batch))))
        self.mean, self.scale = bags.x.mean(0, dtype=np.float64).astype(np.float32), (bags.x.std(0, dtype=np.float64) + 1e-3).astype(np.float32)
        share = np.clip(labels.mean(), 0.02, 0.98)
        self.p["b"][:] = np.log(share / (1 - share))
        first, second, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        draw = np.random.default_rng(seed)
        for epoch in range(epochs):
            order = draw.permutation(len(labels))
            now = rate * (1 - epoch / epochs)
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                step += 1
                for k, grad in self._gradients(bags.some(some), labels[some]).items():
                    grad = grad + decay * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad * grad
                    self.p[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(self.p[k].dtype)
        return self

    def _gradients(self, bags: Bags, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self._forward(bags)
        error = ((f["y"] - labels) / len(labels)).astype(f["h"].dtype)
        to_z = error[:, None] * p["c"]
        each = to_z[f["bag"]]
        to_a = (each * f["h"]).sum(1)
        to_logit = f["a"] * (to_a - np.add.reduceat(f["a"] * to_a, f["starts"])[f["bag"]])
        to_t = to_logit[:, None] * p["g"] * f["s"] * (1 - f["t"] ** 2)
        to_s = to_logit[:, None] * p["g"] * f["t"] * f["s"] * (1 - f["s"])
        to_h = (f["a"][:, None] * each + to_t @ p["V"].T + to_s @ p["U"].T) * (1 - f["h"] ** 2)
        # A word's vector gets its passages' gradients: sorted by bucket, then summed.
        order = np.argsort(bags.words, kind="stable")
        passage = np.repeat(np.arange(len(bags.sizes)), bags.sizes)[order]
        own = np.bincount(bags.words, minlength=len(p["W"]))
        to_w = _sums((to_h / np.maximum(1, bags.sizes)[:, None].astype(to_h.dtype))[passage], own)
        return {"E": f["x"].T @ to_h, "W": to_w, "e": to_h.sum(0), "V": f["h"].T @ to_t, "U": f["h"].T @ to_s, "g": to_logit @ (f["t"] * f["s"]), "c": f["z"].T @ error, "b": np.array([error.sum()])}


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that no label may be learned from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 4000, sample_bytes: int = 64 << 20) -> AttentionModel | None:
    """Fit a model on at most ``sample`` labelled documents that are not held out.

    The sample is that of the smallest hashes of the id, so it is the same on every run; it
    ends where its texts have ``sample_bytes``, and a longer text is passed over. Labels that
    repeat for a document are averaged; null labels are passed over. Rows that repeat a
    doc_id with other texts are documents of the sample too, equal rows are one. None where the sample does not hold documents of different
    labels, as in empty tables.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(label).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_runs(batch, "text"):
                bags = passages(part.column("text"))
                at = [bags.some(np.array([i])) for i in range(part.num_rows)]
                columns = [[m.x.tobytes() for m in at], [m.words.astype(np.uint16).tobytes() for m in at], [m.sizes.astype(np.int32).tobytes() for m in at]]
                yield pa.record_batch([part.column("doc_id"), part.column("y"), *(pa.array(c, pa.binary()) for c in columns)], names=["doc_id", "y", "x", "words", "sizes"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long"), text.alias("text")).join(F.broadcast(chosen), "doc_id").withColumns({"_digest": F.md5(text.cast("binary")), "_size": F.octet_length("text").cast("long")})
    # Sizes alone meet in one task, for the sample's rows and no more.
    order = (F.xxhash64("doc_id"), F.col("doc_id"), F.col("_digest"))
    sizes = own.where(F.col("_size") <= sample_bytes).select("doc_id", "_digest", "_size").distinct().orderBy(*order).limit(sample)
    whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = sizes.withColumn("_sum", F.sum("_size").over(whole)).where(F.col("_sum") <= sample_bytes).select("doc_id", "_digest")
    own = own.join(F.broadcast(taken), ["doc_id", "_digest"]).dropDuplicates(["doc_id", "_digest"])
    table = own.select("doc_id", "y", "text").mapInArrow(run, "doc_id bigint, y double, x binary, words binary, sizes binary").toArrow().sort_by([("doc_id", "ascending"), ("words", "ascending")])
    y = table.column("y").to_numpy()
    if len(np.unique(y)) < 2:
        return None
    read = lambda c, kind: [np.frombuffer(b, kind) for b in table.column(c).to_pylist()]
    x, words, sizes = read("x", np.float32), read("words", np.uint16), read("sizes", np.int32)
    bags = Bags(np.concatenate(x).reshape(-1, FEATURES), np.concatenate(words).astype(np.int32), np.concatenate(sizes).astype(np.int64), np.array([len(s) for s in sizes]))
    return AttentionModel().fit(bags, y)


def score(docs: DataFrame, model: AttentionModel | None) -> DataFrame:
    """All rows and columns of ``docs`` and ``score``, from 0 to 1 (higher: label 1 likelier).

    A null text is scored as an empty one, a very long one whole; rows that repeat are each
    scored. Without a model, nothing is known against any text and all score 1. An own column
    ``score`` is replaced. An empty table gives an empty table.
    """
    docs = docs.drop("score")
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality")
        for batch in batches:
            for part in text_runs(batch, "text", 1 << 20):
                value = model.score(passages(part.column("text"))) if model else np.ones(part.num_rows)
                yield pa.record_batch([*(part.column(c) for c in columns), pa.array(value, pa.float64())], names=[*columns, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def predicted(threshold: float = 0.7) -> Column:
    return (F.col("score") >= threshold).cast("int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted. Only texts are scored; see :func:`train` and :func:`score`."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted(threshold).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, unchanged; see :func:`train` and :func:`score`."""
    own, named = masked(docs, "text")
    return named(score(own, train(docs, labels)).where(predicted(threshold) == 1))
