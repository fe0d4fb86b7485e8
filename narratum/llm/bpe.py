"""BPE encoding and decoding by a depth-first walk over a trie of distinct words.

A byte-level BPE encoding is a chain: the encoding of a prefix is the encoding of a shorter prefix and one last token,
and the last token is the only vocabulary suffix that stays apart from the token before it when both are merged. So one
number for each trie node (its last token) describes the encodings of all words below, and words with a common prefix
share that prefix's work. The trie is kept as the sorted list of its words; the walk holds the states of one path: the
longest piece of vocabulary that ends there, the last token, and the encoding so far.

Cases: null texts count as empty; an empty text has no ids; repeated rows are encoded alike; columns other than the
text are passed through, and clashing output names are replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remembered, slices

VOCABULARY = "byte_bpe_50k.json"
#: The byte-level split of the public tokenizer format.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for ASCII text.
ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\x09-\x0d A-Za-z0-9]+|[\x09-\x0d ]+(?![^\x09-\x0d ])|[\x09-\x0d ]+")
#: White space, a space, white space or the end: where a space may stand inside a piece of white space.
UNSURE = regex.compile(r" (?<=[\s\x1c-\x1f\x85] )(?:[\s\x1c-\x1f\x85]|$)")
#: Words that a worker remembers in each of two generations, and pairs of tokens (these bound memory, not results).
REMEMBERED, PAIRS = 150_000, 400_000


def byte_letters() -> dict[str, int]:
    """The format's letter for each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Remembered:
    """Encodings of words in two generations: a full young one becomes the old one, and what is asked for moves back."""

    def __init__(self, most: int | None = None):
        self.most = REMEMBERED if most is None else most
        self.young: dict[str | bytes, bytes] = {}
        self.old: dict[str | bytes, bytes] = {}

    def age(self) -> None:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young

    def unknown(self, words: Iterable[str | bytes]) -> list[str | bytes]:
        """The words that neither generation has; those of the old one move to the young one."""
        out, old = [], self.old
        for word in words:
            if word not in self.young:
                if (known := old.get(word)) is None:
                    out.append(word)
                else:
                    self.young[word] = known
        return out


class Codec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in vocab.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank[vocab[a], vocab[b]] = k, vocab[a + b]
        self.bytes = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for t, i in self.ids.items():
            self.bytes[i] = t
        for t, i in self.added.items():
            self.bytes[i] = t.encode()
        self.sizes = [len(t) for t in self.bytes]
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.bytes))]
        self.table = pa.array(self.bytes, pa.large_binary())
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        # What each token was merged from and when. Each made by one merge, of parts made earlier: then times are ranks.
        self.made = {token: (k, *pair) for pair, (k, token) in self.rank.items()}
        self.plain = len(self.made) == len(self.rank) and all(k > max(self.made.get(x, (-1,))[0] for x in pair) for k, *pair in self.made.values())
        # Beginnings of tokens are the states of the walk; 0 is the empty one.
        self.states: dict[bytes, int] = {b"": 0}
        for t in self.ids:
            for k in range(1, len(t) + 1):
                self.states.setdefault(t[:k], len(self.states))
        self.spelled = list(self.states)
        self.ahead: dict[int, tuple[int, int]] = {}
        self.inner: dict[int, int] = {}
        self.apart: dict[int, bool] = {}
        #: Words behind a space (without it), words without one, and white space behind a space.
        self.spaced, self.bare, self.blank = Remembered(), Remembered(), Remembered()

    def merge(self, ids: list[int]) -> list[int]:
        """Merges by rank, for a short list."""
        while len(ids) > 1:
            best = min(((*self.rank.get(p, (1 << 60, 0)), k) for k, p in enumerate(zip(ids, ids[1:]))))
            if best[0] == 1 << 60:
                break
            ids[best[2] : best[2] + 2] = [best[1]]
        return ids

    def rims(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, time until which it stands) at a token's right (2) or left (1) rim, from its byte up to itself."""
        out, until = [], 1 << 60
        while True:
            out.append((token, until))
            if token not in self.made:
                return out[::-1]
            until, token = self.made[token][0], self.made[token][side]

    def stay_apart(self, a: int, b: int) -> bool:
        """Do the tokens a and b stand beside each other in the encoding of their joined bytes?

        They don't if, at some time, the tokens at both sides of the border merge before either merges away from it
        (of equal pairs the left one merges first).
        """
        if not self.plain:
            return self.merge([self.ids[bytes((x,))] for x in self.bytes[a] + self.bytes[b]]) == [a, b]
        left, right, i, j = self.rims(a, 2), self.rims(b, 1), 0, 0
        while True:
            (x, leaves), (y, goes) = left[i], right[j]
            met = self.rank.get((x, y))
            if met and met[0] < leaves and met[0] <= goes:
                return False
            if leaves == goes == 1 << 60:
                return True
            if leaves <= goes:
                i += 1
            else:
                j += 1

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The state after one more byte, and the longest token that ends there."""
        text = self.spelled[state] + bytes((byte,))
        after = next(s for k in range(len(text) + 1) if (s := self.states.get(text[k:])) is not None)
        token = next((t for k in range(len(text)) if (t := self.ids.get(text[k:])) is not None), None)
        if token is None:
            raise ValueError(f"the vocabulary can't spell byte {byte}")
        if len(self.ahead) > PAIRS:
            self.ahead.clear()
        self.ahead[state << 8 | byte] = after, token
        return after, token

    def shorter(self, token: int) -> int:
        """The next shorter token at a token's end."""
        if token not in self.inner:
            text = self.bytes[token]
            self.inner[token] = next(t for k in range(1, len(text)) if (t := self.ids.get(text[k:])) is not None)
        return self.inner[token]

    def walk(self, words: Iterable[str], before: bytes, out: dict[str, bytes]) -> None:
        """Depth-first over the trie of the words, each behind `before`; out gets their ids.

        At depth d stand the state, the last token and the encoding of the path's first d bytes.
        """
        ahead, apart, sizes, packed = self.ahead, self.apart, self.sizes, self.packed
        states, last, codes, path = [0], [-1], [b""], b""
        for word in sorted(words):
            spelled = before + word.encode()
            shared, most = 0, min(len(path), len(spelled))
            while shared < most and path[shared] == spelled[shared]:
                shared += 1
            if (more := len(spelled) + 1 - len(states)) > 0:
                states += [0] * more
                last += [0] * more
                codes += [b""] * more
            state = states[shared]
            for end, byte in enumerate(spelled[shared:], shared + 1):
                state, token = ahead.get(state << 8 | byte) or self.step(state, byte)
                start = end - sizes[token]
                while start:
                    pair = last[start] << 24 | token
                    known = apart.get(pair)
                    if known is None:
                        if len(apart) > PAIRS:
                            apart.clear()
                        known = apart[pair] = self.stay_apart(last[start], token)
                    if known:
                        break
                    token = self.shorter(token)
                    start = end - sizes[token]
                states[end], last[end], codes[end] = state, token, codes[start] + packed[token]
            out[word] = codes[len(spelled)]
            path = spelled

    def home(self, piece: str) -> tuple[Remembered, str]:
        """Where a piece's encoding is kept, and by which key."""
        if piece[0] != " ":
            return self.bare, piece
        return (self.blank if len(piece) == 1 or piece[1].isspace() else self.spaced), piece[1:]

    def learn(self, words: Iterable[str], chunks: Iterable[str] = ()) -> None:
        """Remembers the encodings of words behind a space, and of other chunks.

        Each is cut into pieces, and each distinct new piece enters the trie.
        """
        homes = (self.spaced, b" "), (self.bare, b""), (self.blank, b" ")
        single, rest, blank, joined = set(), set(), set(), []
        for word in self.spaced.unknown(words):
            if word.isascii() and word.isalpha():
                single.add(word)
                continue
            first, *more = (ASCII_PIECE if word.isascii() else PIECE).findall(" " + word)
            single.add(first[1:])
            if more:
                rest.update(more)
                joined.append((self.spaced, word, [(self.spaced, first[1:]), *[(self.bare, x) for x in more]]))
        new = {id(self.spaced): single, id(self.bare): rest, id(self.blank): blank}
        for home, key, chunk in [(*self.home(c), c) for c in chunks]:
            if home.unknown([key]):
                parts = [self.home(x) for x in PIECE.findall(chunk)]
                for where, piece in parts:
                    new[id(where)].add(piece)
                if len(parts) > 1:
                    joined.append((home, key, parts))
        for home, before in homes:
            self.walk(home.unknown(new[id(home)]), before, home.young)
        for home, key, parts in joined:
            home.young[key] = b"".join([h.young[k] for h, k in parts])

    def cut(self, text: str) -> list[str]:
        """Chunks that are encoded on their own. A space begins a piece, but for one inside or at the end of white space."""
        if UNSURE.search(text):
            return PIECE.findall(text)
        first, *rest = text.split(" ")
        return [*([first] if first else []), *[" " + x for x in rest]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers.

        Most words of a text are known, by a lookup without the space before them. Words that are empty or begin with white
        space are never found there; texts with one are cut with care.
        """
        for home in (self.spaced, self.bare, self.blank):
            home.age()
        spaced, out = self.spaced.young, [b""] * len(texts)
        words: set[str] = set()
        chunks: set[str] = set()
        late, careful = [], []
        for k, text in enumerate(texts):
            if self.split_added and any(x in text for x in self.added):
                cut = [y for x in self.split_added.split(text) for y in ([x] if x in self.added else self.cut(x) if x else [])]
                chunks.update([c for c in cut if c not in self.added])
                careful.append((k, cut))
                continue
            first, *rest = text.split(" ")
            found, holes, at = list(map(spaced.get, rest)), [], -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                holes.append(at)
            new = [rest[at] for at in holes]
            if any([not x or x[0].isspace() for x in new]):
                cut = self.cut(text)
                chunks.update(cut)
                careful.append((k, cut))
            else:
                words.update(new)
                if first:
                    chunks.add(first)
                late.append((k, first, rest, found, holes))
        self.learn(words, chunks)
        bare = self.bare.young
        for k, first, rest, found, holes in late:
            for at in holes:
                found[at] = spaced[rest[at]]
            out[k] = (bare[first] if first else b"") + b"".join(found)
        for k, cut in careful:
            out[k] = b"".join([self.packed[self.added[c]] if c in self.added else self.known(c) for c in cut])
        return out

    def known(self, chunk: str) -> bytes:
        home, key = self.home(chunk)
        return home.young[key]

    def spell(self, ids: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
        """The joined bytes of the ids, and where each id's bytes begin (and the last one's end)."""
        taken = self.table.take(pa.array(ids, pa.int32()))
        return taken.buffers()[2], np.frombuffer(taken.buffers()[1], "<i8")[: len(ids) + 1]

    def decode(self, ids: np.ndarray, ends: np.ndarray | None = None, skip: frozenset[int] = frozenset()) -> pa.Array:
        """The texts of ids[ends[k] : ends[k + 1]] for each k (no ends: one text of all ids); what isn't UTF-8 is replaced."""
        ends = np.array([0, len(ids)]) if ends is None else ends
        if skip:
            stays = ~np.isin(ids, list(skip))
            ids, ends = ids[stays], np.concatenate([[0], np.cumsum(stays)])[ends]
        data, at = self.spell(ids)
        places = at[ends] if len(ids) else np.zeros(len(ends), np.int64)
        texts = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(places.astype("<i8").tobytes()), data])
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            raw = data.to_pybytes()
            texts = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(places[:-1].tolist(), places[1:].tolist())], pa.large_string())
        return texts.cast(pa.string())


def codec(path: str) -> Codec:
    """A worker process's codec for a vocabulary."""
    return remembered(f"bpe {path}", lambda: Codec(path))


def encode(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """df with an array<int> column of token ids and, if asked for, the text that those ids decode to.

    vocabulary names a file of public_tokenizers, which each executor has installed.
    """
    source = df.drop(*[c for c in (ids, decoded) if c and c != text])
    extra = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if decoded:
        extra.append(T.StructField(decoded, T.StringType(), False))
    kept = [f for f in source.schema.fields if f.name != decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(public_tokenizers.path(vocabulary))
        for part, texts in slices(batches, text):
            packed = own.encode(texts)
            flat = np.frombuffer(b"".join(packed), "<i4")
            ends = np.cumsum([0, *map(len, packed)]) // 4
            arrays = [part.column(part.schema.get_field_index(f.name)) for f in kept]
            arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))
            if decoded:
                arrays.append(own.decode(flat, ends))
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in kept] + [f.name for f in extra])

    return source.mapInArrow(run, T.StructType(kept + extra))


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the text that the ids decode to (null ids: empty)."""
    source = df.drop(decoded)
    names = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(public_tokenizers.path(vocabulary))
        for part in batches:
            column = part.column(part.schema.get_field_index(ids))
            ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))])
            yield pa.RecordBatch.from_arrays([*part.columns, own.decode(column.flatten().to_numpy(zero_copy_only=False), ends)], [*names, decoded])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField(decoded, T.StringType(), False)]))


def digests(df: DataFrame) -> DataFrame:
    """doc_id and what the contract asks of the ids and the decoded text."""
    done = encode(df.select("doc_id", "text"), decoded="decoded")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
