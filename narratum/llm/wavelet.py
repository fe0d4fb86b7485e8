"""Token ids kept as wavelet matrices, one compressed file image for each shard.

Documents in ascending id order are cut into shards. A shard's tokens are one sequence over its own alphabet; plane k
of the matrix holds bit k (from the highest) of every symbol, and after each plane the symbols with bit 0 move stably
before those with bit 1. Rank on the planes then gives any token, the number of a token's occurrences before a place,
and (upwards, by select) the places themselves, without decoding the rest.

Layout of an image, little-endian: magic WMX1; u32 length and bytes of a JSON header (n tokens, docs, levels, zeros of
each level, width); then blobs, each as u32 length and zstd data: alphabet u32, doc ids i64, doc validity u8, doc lengths u64, and for
each level its bits and its rank directory (u32 ones before each 512 bits).

Images are rows of a table (part, seq, n_docs, n_tokens, image) with one row to a file, written by Spark's own
committer in the shared folder, so that any store works and a lost task is simply run again.

Cases: null texts count as empty (just the end id); an empty table gives no shards; repeated ids follow each other by
the hash of their text; null ids come first; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import remembered, slices, stored

VOCABULARY, END = "word_bpe_49k.json", 2
#: Tokens after which a shard ends (at the end of a document).
SHARD_TOKENS = 2_000_000
#: Distinct words, and as many pieces, that a worker remembers (bounds memory, not results).
REMEMBERED = 800_000
#: Shard descriptions (24 bytes each) that may be broadcast; beyond, they are joined by a shuffle.
BROADCAST_SHARDS = 200_000


#: Texts that the format's normalizer only lower-cases: no control or special characters, none beyond U+024F (none of these composes).
PLAIN = re.compile(r"[\x09-\x0d\x20-\x7e\xa0-ɏ]*")
LETTERS, DIGITS = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", r"0-9\xb2\xb3\xb9\xbc-\xbe"
#: The format's split into pieces, for such texts.
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+")
#: The same for lower-cased ASCII texts.
ASCII_PIECE = re.compile(r"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9]+")


class WordEncoder:
    """The library's ids of whole texts.

    The format drops white space, so words are encoded apart: of plain texts each distinct piece once by the library's
    model, of other texts (further scripts, control characters, special tokens) each distinct word once by the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.letters = {b: c for c, b in byte_letters().items()}
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]

    def piece(self, text: str) -> bytes:
        tokens = self.library.model.tokenize(text.encode().decode("latin-1").translate(self.letters))
        self.pieces[text] = packed = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        return packed

    def word(self, word: bytes) -> bytes:
        self.words[word] = packed = np.array(self.library.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return packed

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers, without the end id."""
        for memory in (self.words, self.pieces):
            if len(memory) > REMEMBERED:
                memory.clear()
        out = []
        for text in texts:
            if PLAIN.fullmatch(text) and not any(x in text for x in self.special):
                cut, known, make = (ASCII_PIECE if text.isascii() else PIECE).findall(text.lower()), self.pieces, self.piece
            else:
                cut, known, make = text.encode().split(), self.words, self.word
            found, at = list(map(known.get, cut)), -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                found[at] = known.get(cut[at]) or make(cut[at])
            out.append(b"".join(found))
        return out


def encoder(name: str) -> WordEncoder:
    """A worker process's encoder for a vocabulary."""
    return remembered(f"words {name}", lambda: WordEncoder(public_tokenizers.path(name)))


class Bits:
    """A plane with rank and select."""

    def __init__(self, packed: bytes, directory: np.ndarray, n: int):
        self.n = n
        padded = -(-max(len(packed), 1) // 64) * 64
        self.words = np.frombuffer(packed.ljust(padded + 64, b"\0"), "<u8")
        self.directory = directory

    @staticmethod
    def count(packed: bytes) -> np.ndarray:
        words = np.frombuffer(packed.ljust(-(-max(len(packed), 1) // 64) * 64, b"\0"), "<u8")
        ones = np.bitwise_count(words).reshape(-1, 8).sum(axis=1, dtype=np.uint32)
        return np.concatenate([[0], np.cumsum(ones, dtype=np.uint32)]).astype("<u4")

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        at = np.asarray(at, np.int64)
        word = at >> 6
        out = self.directory[at >> 9].astype(np.int64)
        for k in range(7):
            w = (word & ~7) + k
            out += np.where(w < word, np.bitwise_count(self.words[w]), 0)
        return out + np.bitwise_count(self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def select(self, bit: int, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) one or zero, by bisection on rank."""
        k = np.asarray(k, np.int64)
        low, high = np.zeros_like(k), np.full_like(k, self.n)
        while (low < high).any():
            mid = (low + high) >> 1
            ones = self.rank(mid + 1)
            enough = (ones if bit else mid + 1 - ones) > k
            low, high = np.where(enough | (low >= high), low, mid + 1), np.where(enough & (low < high), mid, high)
        return low


def build(docs: list[tuple[int | None, bytes]]) -> bytes:
    """The image of documents given as (id, ids in little-endian 32-bit integers)."""
    flat = np.frombuffer(b"".join(d for _, d in docs), "<u4")
    used = np.zeros(int(flat.max(initial=0)) + 1, bool)
    used[flat] = True
    alphabet = np.flatnonzero(used) if len(flat) else np.zeros(0, np.int64)
    code = np.zeros(len(used), np.uint32)
    code[alphabet] = np.arange(len(alphabet))
    symbols = code[flat].astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    levels = max(1, (len(alphabet) - 1).bit_length()) if len(flat) else 0
    squeeze = zstandard.ZstdCompressor(level=1).compress
    lengths = np.array([len(d) // 4 for _, d in docs], "<u8")
    ids = np.array([0 if i is None else i for i, _ in docs], "<i8")
    blobs = [alphabet.astype("<u4").tobytes(), ids.tobytes(), bytes(i is not None for i, _ in docs), lengths.tobytes()]
    zeros = []
    for level in range(levels):
        one = (symbols >> (levels - 1 - level)) & 1 == 1
        packed = np.packbits(one, bitorder="little").tobytes()
        blobs += [packed, Bits.count(packed).tobytes()]
        low = symbols[~one]
        zeros.append(len(low))
        symbols = np.concatenate([low, symbols[one]])
    header = json.dumps({"n": len(flat), "docs": len(docs), "levels": levels, "zeros": zeros}).encode()
    return b"WMX1" + struct.pack("<I", len(header)) + header + b"".join(struct.pack("<I", len(x)) + x for x in map(squeeze, blobs))


class WaveletMatrix:
    """Reader of one image."""

    def __init__(self, image: bytes):
        if image[:4] != b"WMX1":
            raise ValueError("not a WMX1 image")
        size = struct.unpack_from("<I", image, 4)[0]
        self.header = json.loads(image[8 : 8 + size])
        at, blobs, open_ = 8 + size, [], zstandard.ZstdDecompressor().decompress
        while at < len(image):
            size = struct.unpack_from("<I", image, at)[0]
            blobs.append(open_(image[at + 4 : at + 4 + size]))
            at += 4 + size
        self.n, self.levels, self.zeros = self.header["n"], self.header["levels"], self.header["zeros"]
        self.alphabet = np.frombuffer(blobs[0], "<u4")
        valid = np.frombuffer(blobs[2], np.uint8)
        self.doc_ids = [int(i) if v else None for i, v in zip(np.frombuffer(blobs[1], "<i8"), valid)]
        self.lengths = np.frombuffer(blobs[3], "<u8").astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.packed = blobs[4::2]
        self.planes = [Bits(p, np.frombuffer(d, "<u4"), self.n) for p, d in zip(blobs[4::2], blobs[5::2])]

    def access(self, at: np.ndarray) -> np.ndarray:
        """Tokens at the given places."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for plane, zeros in zip(self.planes, self.zeros):
            bit, ones = plane[at].astype(np.int64), plane.rank(at)
            at, out = np.where(bit == 1, zeros + ones, at - ones), out << 1 | bit
        return self.alphabet[out]

    def _range(self, token: int, low: int, high: int) -> tuple[int, int] | None:
        code = int(np.searchsorted(self.alphabet, token))
        if code == len(self.alphabet) or self.alphabet[code] != token:
            return None
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            ones = plane.rank(np.array([low, high]))
            low, high = (zeros + ones[0], zeros + ones[1]) if code >> (self.levels - 1 - level) & 1 else (low - ones[0], high - ones[1])
        return int(low), int(high)

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of a token in [low, high)."""
        found = self._range(token, low, self.n if high is None else high)
        return found[1] - found[0] if found else 0

    def occurrences(self, token: int) -> np.ndarray:
        """All places of a token, ascending."""
        found = self._range(token, 0, self.n)
        if not found:
            return np.zeros(0, np.int64)
        at, code = np.arange(*found), int(np.searchsorted(self.alphabet, token))
        for level in range(self.levels - 1, -1, -1):
            bit = code >> (self.levels - 1 - level) & 1
            at = self.planes[level].select(bit, at - self.zeros[level] if bit else at)
        return at

    def sequence(self) -> np.ndarray:
        """All tokens, by undoing the stable moves from the last plane up."""
        kind = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        symbols = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            one = np.unpackbits(np.frombuffer(self.packed[level], np.uint8), count=self.n, bitorder="little").astype(bool)
            up = np.empty(self.n, kind)
            up[~one] = symbols[: self.zeros[level]]
            up[one] = symbols[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            symbols = up
        return self.alphabet[symbols] if self.n else np.zeros(0, np.uint32)


def write(docs: DataFrame, label: str = "wavelet", vocabulary: str = VOCABULARY, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes docs (doc_id, text) and writes their shards; returns the table of images.

    part ascends with doc_id, seq within part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part, seq, docs_, weight = encoder(vocabulary), TaskContext.get().partitionId(), 0, [], 0
        tail = np.array([end], "<u4").tobytes()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(docs_)], pa.int64()), pa.array([weight], pa.int64()), pa.array([build(docs_)], pa.binary())], ["part", "seq", "n_docs", "n_tokens", "image"])

        for piece, texts in slices(batches):
            for doc_id, ids in zip(piece.column(0).to_pylist(), own.encode(texts)):
                docs_.append((doc_id, ids + tail))
                weight += len(ids) // 4 + 1
                if weight >= shard_tokens:
                    yield flush()
                    seq, docs_, weight = seq + 1, [], 0
        if docs_:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    images = ordered.mapInArrow(run, "part int, seq int, n_docs long, n_tokens long, image binary")
    return stored(images, label, maxRecordsPerFile=1)


def read_documents(images: DataFrame) -> DataFrame:
    """(doc_id, start, ids) from the images: start is the number of ids of all documents before, ids little-endian 32-bit integers."""
    shards = images.select("part", "seq", "n_tokens")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of the writer
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("of_parts"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.join(parts, "part").select("part", "seq", (F.col("of_parts") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("base"))
    if shards.count() <= BROADCAST_SHARDS:
        bases = F.broadcast(bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                matrix, base = WaveletMatrix(batch.column(1)[k].as_py()), batch.column(0)[k].as_py()
                flat = matrix.sequence().astype("<u4", copy=False)
                for s in range(0, len(matrix.doc_ids), 256):
                    ids, at = matrix.doc_ids[s : s + 256], matrix.starts[s : s + 257]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(base + at[:-1]), pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], ["doc_id", "start", "ids"])

    return images.join(bases, ["part", "seq"]).select("base", "image").mapInArrow(run, "doc_id long, start long, ids binary")


def locate(images: DataFrame, token: int) -> DataFrame:
    """(doc_id, position) of every occurrence of a token, by select in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image in batch.column(0):
                matrix = WaveletMatrix(image.as_py())
                at = matrix.occurrences(token)
                doc = np.searchsorted(matrix.starts, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array([matrix.doc_ids[d] for d in doc], pa.int64()), pa.array(at - matrix.starts[doc])], ["doc_id", "position"])

    return images.select("image").mapInArrow(run, "doc_id long, position long")


def count(images: DataFrame, token: int) -> DataFrame:
    """(part, seq, n) occurrences of a token in each shard, by rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([WaveletMatrix(x.as_py()).count(token) for x in b.column(2)], pa.int64())], ["part", "seq", "n"])

    return images.select("part", "seq", "image").mapInArrow(run, "part int, seq int, n long")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 as read back from the written shards."""
    back = read_documents(write(docs))
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
