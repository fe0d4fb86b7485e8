"""Toxicity by class-conditional Kneser-Ney models over the bytes of lower-cased text.

Two interpolated Kneser-Ney models, one of toxic and one of ordinary labelled documents, give each byte's probability
after the ORDER - 1 bytes before it. Orders from CLASS_ORDER up have counts of their own class (raw at the top,
continuation counts below); lower orders are shared: both classes back off to the same continuation counts, so an
expression rare in both is smoothed alike and says nothing. A document's two log-likelihoods are divided by its length
and compared; a logistic curve fitted on labelled rows that the models haven't seen turns the difference into a score.

The fit takes at most SAMPLE labelled rows of each class (the ones with the smallest hash of their id, one text of an id), which
bounds the model and what is broadcast; they are counted in the executors. Every document is scored over its whole text.

Cases: null and empty texts score the share of toxic labels; with no labels of one class all scores are that share (0
without labels); rows labelled twice are toxic if one label says so; repeated rows are scored
alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, slices, stored

ORDER, CLASS_ORDER, DISCOUNT = 4, 3, 0.75
#: Labelled rows of each class that the fit takes at most.
SAMPLE = 4000
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """The last `size` bytes up to each byte as one number; zeros stand before the text."""
    wide = np.concatenate([np.zeros(size - 1, np.uint64), data.astype(np.uint64)])
    out = np.zeros(len(data), np.uint64)
    for k in range(size):
        out = out << np.uint64(8) | wide[k : k + len(data)]
    return out


def as_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, values, len(found))


class Table:
    """Numbers by 64-bit key: a slot for each key by hash, and a sorted rest for keys whose slot is taken."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, (2 * len(keys)).bit_length()))
        slot = self.slot(keys)
        self.keys = np.full(1 << (64 - int(self.shift)), np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.zeros(len(self.keys), np.float32)
        self.keys[slot], self.values[slot] = keys, values
        rest = self.keys[slot] != keys
        order = np.argsort(keys[rest])
        self.rest, self.rest_values = keys[rest][order], values[rest][order].astype(np.float32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys are there."""
        slot = self.slot(keys)
        found, values = self.keys[slot] == keys, self.values[slot]
        if len(self.rest) and not found.all():
            miss = np.flatnonzero(~found)
            at = np.minimum(np.searchsorted(self.rest, keys[miss]), len(self.rest) - 1)
            here = self.rest[at] == keys[miss]
            found[miss[here]], values[miss[here]] = True, self.rest_values[at[here]]
        return values, found


class Counts:
    """Counts of one order by key, and of each context: their sum and the number of different bytes after it."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        context = keys >> np.uint64(8)
        self.contexts, place = np.unique(context, return_inverse=True)
        self.total = np.bincount(place, counts, len(self.contexts))
        self.kinds = np.bincount(place, None, len(self.contexts)).astype(float)

    def lower(self, size: int) -> Counts:
        """Continuation counts of the next lower order: in how many different bytes' company each shorter key is seen."""
        mask = np.uint64((1 << (8 * (size - 1))) - 1)
        return Counts(*summed(self.keys & mask, np.ones(len(self.keys))))

    @staticmethod
    def look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0.0)

    def smooth(self, wanted: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Interpolated probabilities of the wanted keys; below: those of the next lower order."""
        context = wanted >> np.uint64(8)
        total = self.look(self.contexts, self.total, context)
        own = np.maximum(self.look(self.keys, self.counts, wanted) - DISCOUNT, 0)
        rest = DISCOUNT * self.look(self.contexts, self.kinds, context)
        return np.where(total > 0, (own + rest * below) / np.maximum(total, 1), below)

    def weight(self, contexts: np.ndarray) -> np.ndarray:
        """What a context leaves to the lower order."""
        total = self.look(self.contexts, self.total, contexts)
        return np.where(total > 0, DISCOUNT * self.look(self.contexts, self.kinds, contexts) / np.maximum(total, 1), 1.0)


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of the top order and their counts."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0)
    for at in range(0, len(texts), 200):
        new = [grams(as_bytes(t), ORDER) for t in texts[at : at + 200]]
        more, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *new]), return_counts=True)
        keys, counts = summed(np.concatenate([keys, more]), np.concatenate([counts, n]))
    return keys, counts


class Model:
    """Log-likelihood ratios (toxic over ordinary) of bytes in context, and the curve from their mean to a score."""

    def __init__(self, texts: dict[int, list[str] | tuple[np.ndarray, np.ndarray]]):
        """texts: of each class the texts, or what `counted` makes of them."""
        classes = {}
        for c, own in texts.items():
            classes[c] = {ORDER: Counts(*(own if isinstance(own, tuple) else counted(own)))}
            for size in range(ORDER, CLASS_ORDER, -1):
                classes[c][size - 1] = classes[c][size].lower(size)
        both = Counts(*summed(np.concatenate([classes[c][CLASS_ORDER].keys for c in (0, 1)]), np.ones(sum(len(classes[c][CLASS_ORDER].keys) for c in (0, 1)))))
        shared = {}
        for size in range(CLASS_ORDER, 1, -1):
            both = shared[size - 1] = both.lower(size)
        self.ratios, self.weights = {}, {}

        def chances(wanted: np.ndarray, size: int, c: int) -> np.ndarray:
            if size == 0:
                return np.full(len(wanted), 1 / 256)
            mask = np.uint64((1 << (8 * size)) - 1)
            part = wanted & mask
            return (classes[c] if size >= CLASS_ORDER else {1: classes[c], 0: shared}[0])[size].smooth(part, chances(part, size - 1, c))

        for size in range(CLASS_ORDER, ORDER + 1):
            known = np.union1d(classes[0][size].keys, classes[1][size].keys)
            self.ratios[size] = Table(known, np.log(chances(known, size, 1)) - np.log(chances(known, size, 0)))
            contexts = np.union1d(classes[0][size].contexts, classes[1][size].contexts)
            self.weights[size] = Table(contexts, np.log(classes[1][size].weight(contexts)) - np.log(classes[0][size].weight(contexts)))
        self.slope, self.shift, self.by_length, self.prior = 1.0, 0.0, 0.0, 0.0

    def bytes_ratio(self, data: np.ndarray) -> np.ndarray:
        """The ratio of each byte. An unseen gram falls back to the next order, with the contexts' weights."""
        keys = grams(data, ORDER)
        out, found = self.ratios[ORDER].get(keys)
        out = np.where(found, out, 0).astype(np.float64)
        left, size = np.flatnonzero(~found), ORDER
        while len(left):
            weight, there = self.weights[size].get(keys[left] >> np.uint64(8) & np.uint64((1 << (8 * (size - 1))) - 1))
            out[left] += np.where(there, weight, 0)
            size -= 1
            if size < CLASS_ORDER:  # what follows is shared by both classes
                break
            value, found = self.ratios[size].get(keys[left] & np.uint64((1 << (8 * size)) - 1))
            out[left] += np.where(found, value, 0)
            left = left[~found]
        return out

    def evidence(self, texts: list[str]) -> np.ndarray:
        """(mean ratio, log of the length) of each text. Texts are joined behind zeros, so none sees another."""
        out = np.zeros((len(texts), 2))
        gap = np.zeros(ORDER - 1, np.uint8)
        parts, spans, at = [], [], 0
        for text in texts:
            data = as_bytes(text)
            parts += [gap, data]
            spans.append((at + len(gap), at + len(gap) + len(data)))
            at += len(gap) + len(data)
        if not texts:
            return out
        sums = np.concatenate([[0.0], np.cumsum(self.bytes_ratio(np.concatenate(parts)))])
        for k, (s, e) in enumerate(spans):
            out[k] = ((sums[e] - sums[s]) / (e - s) if e > s else 0.0), np.log1p(e - s)
        return out

    def calibrate(self, texts: list[str], toxic: np.ndarray) -> None:
        self.curve(self.evidence(texts), toxic)

    def curve(self, x: np.ndarray, toxic: np.ndarray) -> None:
        """Logistic fit to evidence by Newton's method with a little ridge."""
        x = np.column_stack([np.ones(len(x)), x])
        scale = np.maximum(x.std(axis=0), 1e-6) * [0, 1, 1] + [1, 0, 0]
        z, w = x / scale, np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(3), z.T @ (toxic - p) - 0.1 * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        self.shift, self.slope, self.by_length = (w / scale).tolist()

    def scores(self, texts: list[str]) -> np.ndarray:
        x = self.evidence(texts)
        curve = 1 / (1 + np.exp(-np.clip(self.shift + self.slope * x[:, 0] + self.by_length * x[:, 1], -500, 500)))
        return np.where(x[:, 1] > 0, curve, self.prior)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | float:
    """A model from at most `sample` labelled rows of each class outside the held-out fold; a number if a class is missing."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT).withColumn("h", F.xxhash64("doc_id"))
    rated = {r.toxic: r.n for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(rated) < 2:
        return 1.0 if 1 in rated else 0.0
    chosen = known.where("toxic > 0").orderBy("h", "doc_id").limit(sample).union(known.where("toxic <= 0").orderBy("h", "doc_id").limit(sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # One row of an id; the texts stay in the executors.
    own = texts.join(F.broadcast(chosen.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = own.join(F.broadcast(chosen), "doc_id").select((F.col("toxic") > 0).cast("int").alias("toxic"), (F.col("h") % 5 == 0).alias("later"), "text")
    rows = stored(rows, "labelled")
    # The sample balances the classes; the curve sees each row of a class for as many as it stands for.
    share = {c: rated[c] / max(1, min(sample, rated[c])) for c in rated}
    there = {(r.toxic, r.later) for r in rows.select("toxic", "later").distinct().collect()}
    if len({c for c, _ in there}) < 2:
        return rated[1] / (rated[0] + rated[1])
    apart = len(there) == 4
    model = Model(class_counts(rows.where("not later") if apart else rows))
    seen = np.array(sorted(tuple(r) for r in evidence(rows.where("later") if apart else rows, model).collect()))  # at most two numbers for each row of the sample
    model.curve(seen[:, 1:], seen[:, 0])
    model.shift += float(np.log(share[1] / share[0]))
    model.prior = rated[1] / (rated[0] + rated[1])
    return model


def class_counts(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """`counted` of each class of rows (toxic, text), counted in the executors. Only the tables come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            toxic = part.column(0).to_numpy()
            for c in (0, 1):
                keys, n = counted([t for t, x in zip(texts, toxic) if x == c])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), c, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["toxic", "key", "n"])

    sums = rows.select("toxic", "text").mapInArrow(run, "toxic int, key long, n long").groupBy("toxic", "key").agg(F.sum("n").alias("n")).toArrow()
    toxic, keys, n = (sums.column(k).to_numpy() for k in range(3))
    out = {}
    for c in (0, 1):
        order = np.argsort(keys[toxic == c])
        out[c] = keys[toxic == c][order].astype(np.uint64), n[toxic == c][order].astype(float)
    return out


def evidence(rows: DataFrame, model: Model) -> DataFrame:
    """(toxic, ratio, length): a model's evidence for rows (toxic, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a few tables of a size that SAMPLE bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            x = shared.value.evidence(texts)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.float64()), pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], ["toxic", "ratio", "length"])

    return rows.select("toxic", "text").mapInArrow(run, "toxic double, ratio double, length double")


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """docs (doc_id, text and more) with score and predicted; columns of those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few tables of a size that SAMPLE bounds
    source = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            own = shared.value
            values = np.full(len(texts), own) if isinstance(own, float) else own.scores(texts)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.float64())], [*part.schema.names, "score"])

    scored = source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType(), False)]))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    done = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return done.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that are predicted toxic."""
    names = docs.columns
    plain = docs.select("text", F.struct(*names).alias("row"))  # own columns, whatever their names, aren't in the way
    return score(plain, fit(docs, labels)).where("predicted = 0").select("row.*")
