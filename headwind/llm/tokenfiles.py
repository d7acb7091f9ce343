"""Token ids of documents in binary files with Elias-Fano document boundaries.

A data set is a folder of shards and index.json, which names the shards in order with the number of ids before each.
A shard holds, little-endian: the magic, a header (documents, ids, bytes to an id, documents without doc_id, least
doc_id), the Elias-Fano coded ends of the documents, the Elias-Fano coded doc_ids less the least, and the ids one after
another. Ids take two bytes if the vocabulary allows, else four. Documents are in ascending doc_id order, those without
one first.

Shards are written by the executors through pyarrow's file systems under names that no other attempt uses; only those
of successful tasks get into index.json, so a lost or repeated task leaves nothing wrong.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwind.llm import kernel as K
from headwind.llm.eliasfano import EliasFano
from headwind.llm.workers import mapped
from headwind.session import new_path

MAGIC = b"HWTOKEF1"
_HEAD = struct.Struct("<QQQQq")
#: Ids after which a task begins another shard; words that an encoder remembers: the first ones that it meets, as
#: frequent words come early.
SHARD_IDS, REMEMBERED = 1 << 22, 500_000
END_ID = 1


#: The pattern of the split under which words can be encoded apart.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Encodes texts with a tokenizers file, each distinct word once while it is remembered.

    Texts are cut into words only if the tokenizer lower-cases and then splits letters, digits and marks from each other
    and from white space, which it drops: no token spans such a cut, so the ids are the same as of whole texts. With any
    other tokenizer, and where a text may hold a special token, texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        first = steps[0] if steps else {}
        folds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        plain = all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in spec.get("added_tokens", []))
        splits = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
        self.by_word = plain and splits and first["pattern"].get("Regex") == _WORDS and folds == ["NFC", "Replace", "Lowercase"]
        self.table = WordTable(REMEMBERED)
        self.kind = np.uint16 if self.width == 2 else np.uint32
        self.at, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, self.kind)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of texts by the tokenizer itself."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), self.kind, int(counts.sum())), counts

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of a batch's documents, one after another."""
        raw = data.tobytes()
        if not self.by_word or b"<|" in raw:
            return self._encoded([raw[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())])
        plain = _PLAIN[data]
        letter, mark = _LETTER[plain], _MARK[plain]
        cuts = np.union1d(np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1, offs[1:-1])
        spaced = np.insert(plain, cuts, 0x20)
        starts, ends, at = K.spans(spaced, offs + np.searchsorted(cuts, offs), _INK)
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(offs) - 1, np.int64)
        keys, checks = K.word_hashes(spaced, starts, ends, None), word_checks(spaced, starts, ends)
        numbers = self.table.find(keys, checks)
        # Words not met before: each once, in the order of the batch.
        new = np.flatnonzero(numbers < 0)
        _, first, index = np.unique(np.rec.fromarrays([keys[new], checks[new]]), return_index=True, return_inverse=True)
        first = new[first]
        text = spaced.tobytes()
        ids, counts = self._encoded([text[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist())])
        known = self.table.used
        self._write(known, ids, counts)
        numbers[new] = known + index
        if known + len(first) <= REMEMBERED:
            self.table.add(keys[first], checks[first])
        sizes = self.at[numbers + 1] - self.at[numbers]
        past = np.cumsum(sizes)
        out = self.flat[np.repeat(self.at[numbers] - past + sizes, sizes) + np.arange(int(past[-1]))]
        return out, K.segment_sum(sizes, at)

    def _write(self, known: int, ids: np.ndarray, counts: np.ndarray) -> None:
        """Put words' ids behind those of the known words; they stay there if the words become known."""
        end = int(self.at[known])
        while end + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while known + len(counts) >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[end : end + len(ids)] = ids
        self.at[known + 1 : known + 1 + len(counts)] = end + np.cumsum(counts)


def word_checks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Length, first, middle and last byte of words, beside their hash, so that a chance hit of the hash is no hit."""
    parts = [np.minimum(ends - starts, 255), data[starts], data[(starts + ends) >> 1], data[ends - 1]]
    out = np.zeros(len(starts), np.uint32)
    for part in parts:
        out = (out << np.uint32(8)) | part.astype(np.uint32)
    return out


class WordTable:
    """Numbers words by hash and check, in the order in which they are added: a table with open addressing, in arrays."""

    def __init__(self, most: int):
        self.bits = max(4, int(2 * most - 1).bit_length())
        self.keys, self.checks = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint32)
        self.numbers, self.used = np.full(1 << self.bits, -1, np.int32), 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for those that aren't there."""
        out, at = np.full(len(keys), -1, np.int64), self._home(keys)
        left = np.arange(len(keys))
        while len(left):
            number = self.numbers[at]
            hit = (number >= 0) & (self.keys[at] == keys[left]) & (self.checks[at] == checks[left])
            out[left[hit]] = number[hit]
            on = (number >= 0) & ~hit
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, checks: np.ndarray) -> None:
        """Number words that aren't there; each must come once."""
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = np.flatnonzero(self.numbers[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.checks[at[put]], self.numbers[at[put]] = keys[left[put]], checks[left[put]], self.used + left[put]
            on = np.ones(len(left), bool)
            on[put] = False
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        self.used += len(keys)


#: What leaves the ids alone, as the tokenizer drops white space and case and splits letters from marks: line ends as
#: blanks, A-Z in lower case, and a blank between a letter and a mark that is no apostrophe.
_PLAIN = K.LOWER.copy()
_PLAIN[[0x09, 0x0A, 0x0D]] = 0x20
_LETTER = K._class(bytes(range(0x61, 0x7B)))
_MARK = K._class(bytes([*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]))
_INK = ~K._class(b" ")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder in a worker process for each file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def shard_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, width: int) -> Iterator[bytes]:
    """The parts of a shard; documents without doc_id come first."""
    nulls = sum(x is None for x in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    least = int(known[0]) if len(known) else 0
    yield MAGIC + _HEAD.pack(len(doc_ids), len(ids), width, nulls, least)
    yield EliasFano.encode(np.cumsum(counts)).to_bytes()
    yield EliasFano.encode(known.astype(np.uint64) - np.array(least, np.int64).astype(np.uint64)).to_bytes()
    yield ids.astype("<u2" if width == 2 else "<u4").tobytes()


class Shard:
    """A shard's bytes, read."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        self.n, self.n_ids, width, self.nulls, self.least = _HEAD.unpack_from(data, len(MAGIC))
        view, at = memoryview(data), len(MAGIC) + _HEAD.size
        self.ends, took = EliasFano.from_bytes(view[at:])
        at += took
        self.known, took = EliasFano.from_bytes(view[at:])
        self.ids = np.frombuffer(data, "<u2" if width == 2 else "<u4", self.n_ids, at + took)

    def doc_ids(self) -> list[int | None]:
        known = (self.known.decode().astype(np.uint64) + np.array(self.least, np.int64).astype(np.uint64)).astype(np.int64)
        return [None] * self.nulls + known.tolist()

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, found by select alone."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _write_shards(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    """Write the rows (doc_id, text) of a task; a row for each shard: part, turn, file, docs, ids."""
    files, base = _open(folder)
    own, part, done = encoder(tokenizer), TaskContext.get().partitionId(), []
    doc_ids, counts, ids = [], [], []

    def close() -> None:
        if not doc_ids:
            return
        name = f"part-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.tok"
        n, flat = np.concatenate(counts), np.concatenate(ids)
        with files.open_output_stream(f"{base}/{name}") as out:
            for piece in shard_bytes(doc_ids, n, flat, own.width):
                out.write(piece)
        done.append((part, len(done), name, len(doc_ids), len(flat)))
        for x in (doc_ids, counts, ids):
            x.clear()

    for batch in batches:
        column, keys = batch.column(1), batch.column(0).to_pylist()
        for lo, hi, data, offs in K.text_batches(column):
            found, n = own.encode(data, offs)
            ends = np.cumsum(n)
            doc_ids += keys[lo:hi]
            counts.append(n + 1)
            ids.append(np.insert(found, ends, end_id))
            if sum(map(len, ids)) >= shard_ids:
                close()
    close()
    yield pa.RecordBatch.from_pydict({k: [x[i] for x in done] for i, k in enumerate(("part", "turn", "file", "docs", "ids"))}, schema=pa.schema([("part", pa.int32()), ("turn", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> str:
    """Encode every row of docs and write the data set; returns its folder.

    A null text is encoded as empty, so it has the end id alone; a null doc_id comes first; rows of one doc_id are in the
    order of their texts' hash, so rows that are alike in both are interchangeable. An empty table gives an index without
    shards. tokenizer: a tokenizers file at a path that executors have too. Memory is bounded by shard_ids and the longest
    text.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    files, base = _open(folder)
    files.create_dir(base, recursive=True)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    own = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    ordered = own.repartitionByRange(*order).sortWithinPartitions(*order)
    shards = mapped(ordered, lambda it: _write_shards(it, folder, tokenizer, end_id, shard_ids), "part int, turn int, file string, docs bigint, ids bigint").collect()
    index, before = [], 0
    for s in sorted(shards):
        index.append({"file": s["file"], "docs": s["docs"], "ids": s["ids"], "before": before})
        before += s["ids"]
    with files.open_output_stream(f"{base}/index.json") as out:
        out.write(json.dumps({"format": MAGIC.decode(), "ids": before, "shards": index}).encode())
    return folder


def _read_shards(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, base = _open(folder)
    for batch in batches:
        for row in batch.to_pylist():
            with files.open_input_stream(f"{base}/{row['file']}") as source:
                shard = Shard(source.read())
            ends = shard.ends.decode()
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            wide = shard.ids.astype("<u4")
            crcs = [zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids(), pa.int64()), pa.array(starts + row["before"], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a data set, from its files.

    A null doc_id comes back as null; a document of a null or empty text has the end id alone; repeated rows come back as
    often as they were written, one after another; a data set without shards gives no rows.
    """
    files, base = _open(folder)
    with files.open_input_stream(f"{base}/index.json") as source:
        shards = json.loads(source.read())["shards"]
    rows = [(s["file"], s["before"]) for s in shards]
    listed = spark.createDataFrame(rows, "file string, before bigint").repartition(max(1, min(len(rows), 10_000)))
    return mapped(listed, lambda it: _read_shards(it, folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
