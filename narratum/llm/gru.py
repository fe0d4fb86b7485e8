"""Language-model scoring by a gated recurrent network with a class-factored output.

Counts of all words of the training documents come first (a distributed aggregation, as large as the corpus's
vocabulary). The MODEL_WORDS most frequent words are symbols of their own; every other word belongs to one of BUCKETS
symbols by its spelling. The network gives P(symbol | all tokens before) as P(class) * P(symbol | class); a word in a
bucket gets P(bucket) * (c + ALPHA) / (N_b + ALPHA * (V_b + 1)) with the counts of that bucket's words. It is trained in
numpy by truncated backpropagation: gradients stop at a window's start, the state does not. A warm start on SAMPLE documents
is followed by ROUNDS rounds over all training documents, each document in one of them: every task trains a copy of the
network on its share, pool by pool, and the copies are averaged by their numbers of tokens. Scoring carries the state over all windows of a document, so a
log-likelihood is that of the complete text. Documents are packed into parallel streams, with the state reset between.

Counts of the HEAD most frequent words are broadcast (a bound); those of all other words are joined by a shuffle.

Cases: null and empty texts are one end token; an empty table, or one without training documents, leaves every count 0
and the network at its first guess; repeated rows and ids are scored alike, each in its own row; a null doc_id is a
training row and not held out; other columns are ignored.
"""

from __future__ import annotations

import copy
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, pieces, stored

FOLDS, HELD_OUT, ALPHA = 10, 0, 0.1
END = b"\n"  # no word holds white space
MODEL_WORDS, BUCKETS, CLASSES, HIDDEN = 1024, 272, 36, 16
#: Words whose counts are broadcast; training documents of the warm start.
HEAD, SAMPLE = 300_000, 1500
#: Bytes of the longest document of the warm start; the rounds learn all documents, of any length.
LONGEST = 1 << 16
#: Rounds over all training documents, their learning rate, streams, window and longest stretch; pieces in which weights are averaged.
ROUNDS, ROUND_RATE, ROUND_STREAMS, ROUND_WINDOW, STRETCH, PIECES = 2, 0.006, 512, 16, 512, 16
WINDOW, STREAMS, EPOCHS, RATE = 32, 64, 2, 0.004
#: Bytes of text that a task packs into streams at a time, and its streams; bytes and rows whose words are looked up at a time.
POOL_BYTES, POOL_STREAMS, POOL_WINDOW, LOOKUP_BYTES, LOOKUP_ROWS = 12 << 20, 1024, 16, 6 << 20, 4096
#: Copies of a piece that are averaged at a time.
COPIES = 1024
#: Distinct words after which a counting task hands on what it has.
FLUSH = 300_000


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def bucket(word: bytes) -> int:
    """Spelling bucket: by the first two bytes and the last one."""
    return xxhash.xxh32_intdigest(word[:2] + b"|" + word[-1:]) % BUCKETS


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts as one binary array, and where each text's words begin (and the last one's end)."""
    parts = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts.fill_null("")))
    flat = parts.flatten().cast(pa.binary())
    real = pa.compute.greater(pa.compute.binary_length(flat), 0)
    ends = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real), ends[np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy())])]


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, bucket int, c long) over all rows of docs, the end tokens too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(map(bucket, keys), pa.int32()), pa.array(counts.values(), pa.int64())], ["word", "bucket", "n"])
            counts.clear()
            return out

        for part in pieces(batches, LOOKUP_ROWS, LOOKUP_BYTES):
            found = cut(part.column("text"))[0].value_counts()
            for word, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist()):
                counts[word] += n
            counts[END] += part.num_rows
            if len(counts) > FLUSH:
                yield flush()
        if counts:
            yield flush()

    return docs.select("text").mapInArrow(run, "word binary, bucket int, n long").groupBy("word", "bucket").agg(F.sum("n").alias("c"))


class Network:
    """Symbols 0..n-1; symbol s belongs to class s % CLASSES and is its member s // CLASSES.

    gate and state have a block for the update, the reset and the new state each.
    """

    def __init__(self, weights: np.ndarray, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = 7):
        """weights: how often each symbol occurs, for the first guess of the output."""
        rng = np.random.default_rng(seed)
        self.n, self.hidden, self.classes = len(weights), hidden, classes
        self.members = -(-self.n // classes)
        share = np.zeros(self.members * classes)
        share[: self.n] = (weights + 0.5) / (weights + 0.5).sum()
        by_class = np.maximum(share, 1e-30).reshape(self.members, classes)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.p = {
            "gate": small(3, self.n, hidden), "state": small(3, hidden, hidden), "inner": np.zeros(hidden, np.float32),
            "class": np.zeros((hidden, classes), np.float32), "class_bias": np.log(by_class.sum(axis=0)).astype(np.float32),
            "member": np.zeros((classes, hidden, self.members), np.float32), "member_bias": np.maximum(np.log(by_class / by_class.sum(axis=0)), -30).T.astype(np.float32),
        }

    def softmax(self, hs: np.ndarray, weights: np.ndarray, bias: np.ndarray, bounded: bool, want: np.ndarray, d: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-probabilities of the wanted columns and, if d, the gradient of the logits. bounded: exponents need no shift."""
        x, rows = hs @ weights, np.arange(len(hs))
        x += bias
        if not bounded:
            x -= x.max(axis=1, keepdims=True)
        out = x[rows, want]
        np.exp(x, out=x)
        total = x.sum(axis=1)
        out = out - np.log(total)
        if not d:
            return out, None
        x *= (-1 / total)[:, None]
        x[rows, want] += 1
        return out, x

    def output(self, hs: np.ndarray, target: np.ndarray, grads: dict | None = None, real: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of the targets from the states before them; with grads, also their gradient (to be maximised).

        real: which targets the gradient counts (none given: all).
        """
        p, back = self.p, None
        cls, member = target % self.classes, target // self.classes
        size = max(1.0, float(np.abs(hs).max(initial=0)))
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        hs, cls, member = hs[order], cls[order], member[order]
        fine = bool((size * np.abs(p["class"]).sum(axis=0) + np.abs(p["class_bias"])).max() < 60)
        logs, d = self.softmax(hs, p["class"], p["class_bias"], fine, cls, grads is not None)
        if grads is not None:
            if real is not None:
                real = real[order]
                d *= real[:, None]
            grads["class"], grads["class_bias"], back = hs.T @ d, d.sum(axis=0), d @ p["class"].T
            grads["member"], grads["member_bias"] = np.zeros_like(p["member"]), np.zeros_like(p["member_bias"])
        edges = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
        fine = (size * np.abs(p["member"]).sum(axis=1) + np.abs(p["member_bias"])).max(axis=1) < 60
        for c, (s, e) in enumerate(zip(edges[:-1], edges[1:])):
            if s == e:
                continue
            own, d = self.softmax(hs[s:e], p["member"][c], p["member_bias"][c], bool(fine[c]), member[s:e], grads is not None)
            logs[s:e] += own
            if grads is not None:
                if real is not None:
                    d *= real[s:e, None]
                grads["member"][c], grads["member_bias"][c] = hs[s:e].T @ d, d.sum(axis=0)
                back[s:e] += d @ p["member"][c].T
        out = np.empty(len(logs))
        out[order] = logs
        if back is not None:
            sorted_back, back = back, np.empty_like(back)
            back[order] = sorted_back
        return out, back

    def window(self, source: np.ndarray, target: np.ndarray, reset: np.ndarray, h: np.ndarray, grads: dict | None = None, real: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """One window (time, streams): log-probabilities of the targets and the state to carry on.

        reset marks where a document begins: the state before is dropped there. Without grads nothing is kept.
        """
        p, (t, b), size = self.p, source.shape, self.hidden
        kind = p["state"].dtype
        gates = np.take(p["gate"], source, axis=1)  # becomes (update, reset, new state) in place
        hs, before = np.empty((t, b, size), kind), np.empty((t, b, size) if grads is not None else (1, b, size), kind)
        inner = np.empty((t, b, size) if grads is not None else (1, b, size), kind)
        begins, u, drop = reset.any(axis=1).tolist(), np.empty((3, b, size), kind), np.empty((b, size), kind)
        for k in range(t):
            at = k if grads is not None else 0
            old, mid, new, both = before[at], inner[at], gates[2, k], gates[:2, k]
            if begins[k]:
                np.multiply(h, ~reset[k][:, None], out=old)
            else:
                old[:] = h
            np.matmul(old, p["state"], out=u)
            both += u[:2]
            both *= 0.5
            np.tanh(both, out=both)
            both *= 0.5
            both += 0.5
            np.add(u[2], p["inner"], out=mid)
            np.multiply(mid, both[1], out=drop)
            new += drop
            np.tanh(new, out=new)
            h = hs[k]
            np.subtract(old, new, out=h)
            h *= both[0]
            h += new
        logs, back = self.output(hs.reshape(t * b, -1), target.ravel(), grads, None if real is None else real.ravel())
        if grads is not None:
            back, d, d_u, slope = back.reshape(t, b, -1), np.zeros_like(h), np.empty((3, t, b, size), kind), np.empty((b, size), kind)
            d_new = np.empty((t, b, size), kind)
            turned = p["state"].transpose(0, 2, 1)
            for k in range(t - 1, -1, -1):
                d += back[k]
                z, r, new, on = gates[0, k], gates[1, k], gates[2, k], d_new[k]
                dz, dr, dn = d_u[0, k], d_u[1, k], d_u[2, k]
                np.multiply(d, z, out=slope)  # what the state before gets directly
                np.subtract(before[k], new, out=dz)
                dz *= slope
                np.subtract(d, slope, out=on)
                np.multiply(new, new, out=dn)
                np.subtract(1, dn, out=dn)
                on *= dn
                np.subtract(1, z, out=d)
                dz *= d
                np.multiply(on, r, out=dn)
                np.multiply(dn, inner[k], out=dr)
                np.subtract(1, r, out=d)
                dr *= d
                np.matmul(dz, turned[0], out=d)
                slope += d
                np.matmul(dr, turned[1], out=d)
                slope += d
                np.matmul(dn, turned[2], out=d)
                d += slope
                if begins[k]:
                    d *= ~reset[k][:, None]
            flat = before.reshape(t * b, -1).T
            grads["state"], grads["inner"] = np.stack([flat @ x.reshape(t * b, -1) for x in d_u]), d_u[2].sum(axis=(0, 1))
            order = np.argsort(source.ravel().astype(np.uint16) if self.n <= 1 << 16 else source, axis=None, kind="stable")
            ordered = source.ravel()[order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            grads["gate"] = np.zeros_like(p["gate"])
            for own, x in zip(grads["gate"], (d_u[0], d_u[1], d_new)):
                own[ordered[first]] = np.add.reduceat(x.reshape(t * b, -1)[order], first)
        return logs.reshape(t, b), h

    def train(self, docs: list[np.ndarray], start: int, epochs: int = EPOCHS, rate: float = RATE, streams: int = STREAMS, window: int = WINDOW, seed: int = 3, stretch: int | None = None) -> None:
        """Adam on truncated windows. docs: symbols with the end symbol last; start: the symbol before a document.

        stretch: longer documents are learned in stretches of so many symbols, each behind the symbol before it.
        """
        if not docs:
            return
        rng = np.random.default_rng(seed)
        names = list(self.p)
        flat = np.concatenate([self.p[name].ravel() for name in names])
        at = np.cumsum([0, *[self.p[name].size for name in names]])
        self.p = {name: flat[s:e].reshape(self.p[name].shape) for name, s, e in zip(names, at[:-1], at[1:])}
        m, v, change, count = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat), 0
        streams = max(1, min(streams, sum(map(len, docs)) // window))
        firsts = [start] * len(docs)
        if stretch:
            firsts = [start if not k else int(x[k - 1]) for x in docs for k in range(0, len(x), stretch)]
            docs = [x[k : k + stretch] for x in docs for k in range(0, len(x), stretch)]
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            source, target, reset, owner = pack([docs[k] for k in order], start, streams, [firsts[k] for k in order])
            steps = -(-len(source) // window)
            total, h = steps * epochs, np.zeros((source.shape[1], self.hidden), flat.dtype)
            for k in range(steps):
                # Streams are sorted by length, so those that have ended are at the end; what pads the others isn't learned.
                live = max(1, int((owner[k * window] >= 0).sum()))
                cut, grads = (slice(k * window, (k + 1) * window), slice(live)), {}
                real = (owner[cut] >= 0).astype(flat.dtype)
                _, h = self.window(source[cut], target[cut], reset[cut], h[:live], grads, real)
                count += 1
                tokens = float(real.sum())
                g = np.concatenate([grads[name].ravel() for name in names])
                g *= 1 / (tokens * max(1.0, math.sqrt(float(g @ g)) / tokens / 0.5))
                pace = rate * (1 - 0.9 * min(1, count / total)) * math.sqrt(1 - 0.99**count) / (1 - 0.9**count)
                m *= 0.9
                v *= 0.99
                np.multiply(g, 0.1, out=change)
                m += change
                g *= g
                g *= 0.01
                v += g
                np.sqrt(v, out=change)
                change += 1e-8
                np.divide(m, change, out=change)
                change *= pace
                flat += change

    def score(self, docs: list[np.ndarray], start: int, streams: int = POOL_STREAMS, window: int = POOL_WINDOW) -> np.ndarray:
        """Natural log-likelihood of each complete document, the state carried across windows."""
        if not docs:
            return np.zeros(0)
        source, target, reset, owner = pack(docs, start, min(streams, len(docs)))
        h, out = np.zeros((source.shape[1], self.hidden), self.p["state"].dtype), np.zeros(len(docs) + 1)
        k = 0
        while k < len(source):
            # Streams are sorted by length, so those that have ended are at the end. Few streams take longer windows.
            live = max(1, int((owner[k] >= 0).sum()))
            cut = slice(k, k + window * max(1, source.shape[1] // live))
            k = cut.stop
            logs, h = self.window(source[cut, :live], target[cut, :live], reset[cut, :live], h[:live])
            out += np.bincount(owner[cut, :live].ravel() + 1, logs.ravel(), len(docs) + 1)
        return out[1:]


def pack(docs: list[np.ndarray], start: int, streams: int, firsts: list[int] | None = None) -> tuple[np.ndarray, ...]:
    """(source, target, reset, owner) by (time, stream): documents dealt to the shortest stream, longest first; owner -1 is padding.

    firsts: the symbols before each document (none given: start).
    """
    import heapq

    heap, own = [(0, s) for s in range(streams)], [[] for _ in range(streams)]
    for k in sorted(range(len(docs)), key=lambda k: -len(docs[k])):
        size, s = heapq.heappop(heap)
        own[s].append(k)
        heapq.heappush(heap, (size + len(docs[k]), s))
    own.sort(key=lambda ks: -sum(len(docs[k]) for k in ks))
    length = max(sum(len(docs[k]) for k in ks) for ks in own)
    source, target = np.full((length, streams), start, np.int32), np.full((length, streams), start, np.int32)
    reset, owner = np.zeros((length, streams), bool), np.full((length, streams), -1, np.int32)
    for s, ks in enumerate(own):
        if not ks:
            continue
        flat, at = np.concatenate([docs[k] for k in ks]), np.cumsum([0, *[len(docs[k]) for k in ks]])
        target[: len(flat), s], source[1 : len(flat), s], owner[: len(flat), s] = flat, flat[:-1], np.repeat(ks, np.diff(at))
        source[at[:-1], s], reset[at[:-1], s] = start if firsts is None else [firsts[k] for k in ks], True
    return source, target, reset, owner


class Scorer:
    """The network, the frequent words' counts and the buckets' totals, as sent to the workers."""

    def __init__(self, head: list[tuple[bytes, int]], totals: dict[int, tuple[int, int]], n: int, v: int):
        """head: words by falling count; totals: (N_b, V_b) over all words that have no symbol of their own."""
        self.n, self.v, self.totals = n, v, totals
        self.words = pa.array([w for w, _ in head], pa.binary())
        counts = np.array([c for _, c in head], float)
        self.size = min(MODEL_WORDS, len(head))
        self.symbol = np.array([k if k < self.size else self.size + bucket(w) for k, (w, _) in enumerate(head)], np.int32)
        rooms = np.array([self.room(b) for b in range(BUCKETS)])
        self.base = np.log10((counts + ALPHA) / (n + ALPHA * (v + 1)))
        self.inside = np.zeros(len(head))
        self.inside[self.size :] = np.log10((counts[self.size :] + ALPHA) / rooms[self.symbol[self.size :] - self.size])
        self.end = next((k for k, (w, _) in enumerate(head) if w == END), -1)
        self.start = int(self.symbol[self.end]) if self.end >= 0 else self.size + bucket(END)
        self.network = Network(np.concatenate([counts[: self.size], [totals.get(b, (0, 0))[0] for b in range(BUCKETS)]]))

    def room(self, b: int) -> float:
        n, v = self.totals.get(b, (0, 0))
        return n + ALPHA * (v + 1)

    def look(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Of words: symbols and places in the head (-1: not there); which aren't there, as a number among the distinct ones of these, those, and their buckets."""
        at = pa.compute.index_in(words, value_set=self.words).fill_null(-1).to_numpy()
        out, lost = (self.symbol[at] if len(self.symbol) else np.zeros(len(at), np.int32)), np.flatnonzero(at < 0)
        others = words.take(pa.array(lost)).dictionary_encode()
        buckets = np.array([bucket(w) for w in others.dictionary.to_pylist()], np.int32)
        which = others.indices.to_numpy()
        out[lost] = self.size + buckets[which] if len(lost) else 0
        return out, at, lost, which, others.dictionary, buckets

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Symbols with the end's last, the places in the head (-1: not there), and the words that aren't there."""
        out, at, lost, *_ = self.look(pa.array([*words, END], pa.binary()))
        return out, at, [[*words, END][k] for k in lost]

    def texts(self, texts: pa.Array, counts: bool = True) -> tuple:
        """Of texts: all symbols with ends, and where each text's begin. If counts, for each text also the tokens in the head, the sums of
        their base and inside logarithms, and the distinct words that aren't there, with buckets and times."""
        flat, ends = cut(texts)
        symbols, at, lost, which, others, buckets = self.look(flat)
        many, starts = len(ends) - 1, ends + np.arange(len(ends))
        place = np.arange(len(flat)) + np.repeat(np.arange(many), np.diff(ends))
        out = np.full(starts[-1], self.start, np.int32)
        out[place] = symbols
        if not counts:
            return out, starts
        head = np.full(starts[-1], self.end, np.int64)
        head[place] = at
        here = head >= 0
        sums = [np.add.reduceat(np.where(here, table[head], 0.0) if len(table) else np.zeros(len(head)), starts[:-1]) if many else np.zeros(0) for table in (np.ones(len(self.base)), self.base, self.inside)]
        owner = np.searchsorted(ends, lost, side="right") - 1
        if self.end < 0:
            others, buckets = pa.concat_arrays([others, pa.array([END], pa.binary())]), np.append(buckets, np.int32(bucket(END)))
            owner, which = np.concatenate([owner, np.arange(many)]), np.concatenate([which, np.full(many, len(others) - 1)])
        keys, times = np.unique(owner * max(1, len(others)) + which, return_counts=True)
        owner, which = np.divmod(keys, max(1, len(others)))
        rest = pa.StructArray.from_arrays([others.take(pa.array(which)), pa.array(buckets[which] if len(which) else [], pa.int32()), pa.array(times, pa.int64())], ["word", "bucket", "times"])
        return out, starts, *sums, pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(many + 1)), pa.int32()), rest)


def frequent(counts: DataFrame, most: int | None = None) -> list[tuple[bytes, int]]:
    """HEAD words at most, by falling count: all at or above the lowest of a histogram's steps (64 to an octave) that leaves no more."""
    step = F.floor(F.log2("c") * 64)
    steps = sorted(((r.step, r.n, r.low) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("low")).collect()), reverse=True)
    total, floor = 0, None
    for _, n, low in steps:
        total += n
        if total > (HEAD if most is None else most):
            break
        floor = low
    if floor is None:
        return []
    rows = counts.where(F.col("c") >= floor).select("word", "c").toArrow()
    return sorted(zip(rows.column("word").to_pylist(), rows.column("c").to_pylist()), key=lambda x: (-x[1], x[0]))


def fit(docs: DataFrame) -> tuple[Scorer, DataFrame]:
    """The scorer and the stored counts (word, bucket, c) of docs' training rows."""
    train = docs.where(F.coalesce(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT, F.lit(True)))
    counts = stored(count_words(train), "words")
    row = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    head = frequent(counts)
    totals = {r.bucket: (r.n, r.v) for r in counts.groupBy("bucket").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    for w, c in head[:MODEL_WORDS]:
        n, v = totals[bucket(w)]
        totals[bucket(w)] = n - c, v - 1
    scorer = Scorer(head, totals, row.n or 0, row.v)
    short = train.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST)
    chosen = short.where("doc_id is not null").select(F.col("doc_id").alias("chosen_id"), F.xxhash64("doc_id").alias("h")).orderBy("h", "chosen_id").limit(SAMPLE)
    texts = short.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id")).orderBy("h").select("text").limit(SAMPLE).toArrow()
    symbols, starts = scorer.texts(texts.column("text").combine_chunks(), counts=False)
    scorer.network.train(np.split(symbols, starts[1:-1]) if len(starts) > 1 else [], scorer.start, stretch=STRETCH)
    for k in range(ROUNDS):
        learn(scorer, train.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == k))
    return scorer, counts


def learn(scorer: Scorer, docs: DataFrame) -> None:
    """One round: the network becomes the average of the copies that the tasks trained on their shares of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # bounded by HEAD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pool, weight, tokens = shared.value, [], 0, 0
        network = copy.copy(own.network)
        network.p = {name: x.copy() for name, x in network.p.items()}

        def learn_pool() -> None:
            network.train(pool, own.start, 1, ROUND_RATE, ROUND_STREAMS, ROUND_WINDOW, stretch=STRETCH)
            pool.clear()

        for part in pieces(batches, LOOKUP_ROWS, LOOKUP_BYTES):
            symbols, starts = own.texts(part.column("text"), counts=False)
            pool += np.split(symbols, starts[1:-1])
            tokens += len(symbols)
            weight += part.column("text").nbytes
            if weight >= POOL_BYTES:
                learn_pool()
                weight = 0
        learn_pool()
        if tokens:
            parts = np.array_split(np.concatenate([x.ravel() for x in network.p.values()]), PIECES)
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([task] * PIECES, pa.int32()), pa.array([tokens] * PIECES, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], ["piece", "task", "tokens", "w"])

    def average(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        total, out = sum(table.column("tokens").to_pylist()), 0.0
        for n, w in zip(table.column("tokens").to_pylist(), table.column("w")):
            out = out + np.frombuffer(w.as_py(), np.float32).astype(np.float64) * (n / total)
        return pa.table({"piece": table.column("piece").slice(0, 1), "task": table.column("batch").slice(0, 1), "tokens": pa.array([total], pa.int64()), "w": pa.array([out.astype(np.float32).tobytes()], pa.binary())})

    kind = "piece int, task int, tokens long, w binary"
    parts = docs.select("text").mapInArrow(run, kind)
    for batch in (F.floor(F.col("task") / COPIES).cast("int"), F.lit(0)):  # so that no group grows with the number of tasks
        parts = parts.withColumn("batch", batch).groupBy("piece", "batch").applyInArrow(average, kind)
    rows = sorted(parts.collect(), key=lambda r: r.piece)  # as large as the network
    if rows:
        flat, at = np.concatenate([np.frombuffer(bytes(r.w), np.float32) for r in rows]), 0
        for name, x in scorer.network.p.items():
            scorer.network.p[name] = flat[at : at + x.size].reshape(x.shape).copy()
            at += x.size


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scorer, counts = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # bounded by HEAD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, pool, weight = shared.value, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            model, at = own.network.score(pool, own.start) / math.log(10), 0
            for ids, sizes, known, base, inside, rest in held:
                arrays = [ids, pa.array(sizes, pa.int64()), pa.array(known.astype(np.int64)), pa.array(base), pa.array(model[at : at + len(ids)] + inside), rest]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "known", "base", "model", "rest"])
                at += len(ids)
            held.clear()
            pool.clear()

        for part in pieces(batches, LOOKUP_ROWS, LOOKUP_BYTES):
            symbols, starts, known, base, inside, rest = own.texts(part.column("text"))
            held.append((part.column("doc_id"), np.diff(starts), known, base, inside, rest))
            pool += np.split(symbols, starts[1:-1])
            weight += part.column("text").nbytes
            if weight >= POOL_BYTES:
                yield from flush()
                weight = 0
        yield from flush()

    first = docs.mapInArrow(run, "doc_id long, n_tokens long, known long, base double, model double, rest array<struct<word: binary, bucket: int, times: long>>")
    first = stored(first.withColumn("row", F.monotonically_increasing_id()), "scored")
    room = F.array(*[F.lit(scorer.room(b)) for b in range(BUCKETS)])
    c = F.coalesce("c", F.lit(0))
    seen = first.select("row", F.explode("rest").alias("x")).select("row", F.col("x.word").alias("word"), F.col("x.bucket").alias("b"), F.col("x.times").alias("times")).join(counts.select("word", "c"), "word", "left")
    rest = seen.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((c + ALPHA) / F.lit(scorer.n + ALPHA * (scorer.v + 1)))).alias("more_base"),
        F.sum(F.col("times") * F.log10((c + ALPHA) / room[F.col("b")])).alias("more_model"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return first.drop("rest").join(rest, "row", "left").select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "n_tokens",
        plus("known", "more_known").alias("n_known"), F.lit(scorer.n).cast("long").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"), plus("model", "more_model").alias("score"),
    )
