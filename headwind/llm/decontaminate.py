"""Benchmark decontamination by winnowing.

Of every WINDOW - GRAM + 1 consecutive GRAM-word hashes of a text the smallest are kept as fingerprints, so two
texts that share WINDOW consecutive words share a fingerprint. The fingerprints of documents are joined with those
of the benchmark items, and each hit is extended to the whole windows around it, which are compared by a 64-bit hash
of all their words. Items shorter than a window are one window of their own length, winnowed with a window of one gram
of that length.

The benchmark is cut into blocks of a checked size; each is one broadcast index. A usual benchmark is one block, against
which all documents are read once, and then nothing is shuffled. With several, fingerprints of documents and items are
shuffled and joined first, and only documents that share one are read against the blocks; items shorter than a window
are few words each and are read against all documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwind.llm import kernel as K
from headwind.llm.workers import mapped
from headwind.session import materialize

WINDOW, GRAM = 13, 5
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 8 << 20
#: Tasks to which the documents with one fingerprint are dealt.
SALTS = 16
_BITS = 18

RESULT = "n_words bigint, n_hit bigint, item_ids array<string>, runs array<struct<first:int,past:int>>"


def winnow(grams: np.ndarray, left: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Positions of the fingerprints: of each window of grams within a document all that have its minimum."""
    width, n = window - gram + 1, len(grams)
    kept = np.zeros(n, bool)
    if n < width:
        return np.flatnonzero(kept)
    least = grams[: n - width + 1].copy()
    for d in range(1, width):
        np.minimum(least, grams[d : n - width + 1 + d], out=least)
    whole = left[: n - width + 1] >= window
    for d in range(width):
        kept[d : n - width + 1 + d] |= whole & (grams[d : n - width + 1 + d] == least)
    return np.flatnonzero(kept)


def _windows_at(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = words[at].copy()
    for j in range(1, size):
        out = out * K.U64(K._WORD) + words[at + j]
    return K.mix(out)


@dataclass
class Postings:
    """Window hashes in order, and the items that have each."""

    keys: np.ndarray
    at: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, items: np.ndarray) -> Postings:
        pairs = np.unique(np.rec.fromarrays([hashes, items], names="h,i"))
        keys, first = np.unique(pairs.h, return_index=True)
        return cls(keys, np.append(first, len(pairs)), np.asarray(pairs.i))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """For each hash its index among the keys, or -1."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        i = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[i] == hashes, i, -1)


@dataclass
class BenchmarkIndex:
    """The fingerprints and windows of a block of items."""

    ids: list[str | None]
    prints: np.ndarray = field(default=None)
    seen: np.ndarray = field(default=None)
    sizes: dict[int, Postings] = field(default_factory=dict)

    @classmethod
    def build(cls, ids: list[str | None], texts: list[str | None]) -> BenchmarkIndex:
        out, found, prints = cls(ids), {}, []
        for lo, _, data, offs in K.text_batches(pa.array(texts, pa.large_string())):
            starts, ends, at = K.spans(data, offs, K.ALNUM)
            words, counts = K.word_hashes(data, starts, ends), np.diff(at)
            _, left = K.place(at)
            item = lo + np.repeat(np.arange(len(counts)), counts)
            for size in {min(int(c), WINDOW) for c in counts if c}:
                own = np.repeat(np.minimum(counts, WINDOW) == size, counts)
                where = np.flatnonzero(own & (left >= size))
                found.setdefault(size, []).append((_windows_at(words, where, size), item[where]))
            grams = K.gram_hashes(words, GRAM)
            prints.append(grams[winnow(grams, left)])
        out.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, K.U64)
        out.seen = np.zeros(1 << _BITS, bool)
        out.seen[(out.prints >> K.U64(64 - _BITS)).astype(np.int64)] = True
        out.sizes = {size: Postings.of(*map(np.concatenate, zip(*x))) for size, x in found.items()}
        return out

    def candidates(self, words: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Positions of whole windows that hold a shared fingerprint."""
        if not len(self.prints):
            return np.zeros(0, np.int64)
        grams = K.gram_hashes(words, GRAM)
        at = winnow(grams, left)
        at = at[self.seen[(grams[at] >> K.U64(64 - _BITS)).astype(np.int64)]]
        i = np.minimum(np.searchsorted(self.prints, grams[at]), len(self.prints) - 1)
        at = at[self.prints[i] == grams[at]]
        around = np.unique((at[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
        around = around[around >= 0]
        return around[left[around] >= WINDOW]

    def match(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]], list[list[dict]]]:
        """For each document: words, hit words, the items found, and the runs of hit words."""
        starts, ends, at = K.spans(data, offs, K.ALNUM)
        words, counts = K.word_hashes(data, starts, ends), np.diff(at)
        _, left = K.place(at)
        cover, docs, items = np.zeros(len(words) + 1, np.int64), [], []
        doc_of = np.repeat(np.arange(len(counts)), counts)
        for size, postings in self.sizes.items():
            where = self.candidates(words, left) if size == WINDOW else np.flatnonzero(left >= size)
            key = postings.find(_windows_at(words, where, size))
            where, key = where[key >= 0], key[key >= 0]
            np.add.at(cover, where, 1)
            np.add.at(cover, where + size, -1)
            pairs = np.unique(doc_of[where] * len(postings.keys) + key)
            doc, key = pairs // max(len(postings.keys), 1), pairs % max(len(postings.keys), 1)
            many = postings.at[key + 1] - postings.at[key]
            first = np.repeat(postings.at[key] - np.cumsum(many) + many, many)
            docs.append(np.repeat(doc, many))
            items.append(postings.items[first + np.arange(len(first))])
        hit = np.cumsum(cover)[:-1] > 0
        found, runs = [[] for _ in counts], [[] for _ in counts]
        if docs:
            pairs = np.unique(np.concatenate(docs) * max(len(self.ids), 1) + np.concatenate(items))
            for p in pairs.tolist():
                found[p // len(self.ids)].append(p % len(self.ids))
        for d in np.unique(doc_of[hit]).tolist():
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[at[d] : at[d + 1]].astype(np.int8), [0]])))
            runs[d] = [{"first": int(a), "past": int(b)} for a, b in edges.reshape(-1, 2)]
        return counts, K.segment_sum(hit.astype(np.int64), at), found, runs


def fingerprints(texts: DataFrame, kept: str, keep: tuple[str, ...] = ("key",)) -> DataFrame:
    """(kept..., n_words, prints) of texts (keep..., text): the number of words and the distinct fingerprints; kept is the
    schema of the columns keep."""

    def run(batches):
        for batch in batches:
            names, counts, flat, sizes = list(keep), [], [], []
            for _, _, data, offs in K.text_batches(batch.column(batch.schema.get_field_index("text"))):
                starts, ends, at = K.spans(data, offs, K.ALNUM)
                words = K.word_hashes(data, starts, ends)
                grams, left = K.gram_hashes(words, GRAM), K.place(at)[1]
                where = winnow(grams, left)
                pairs = np.unique(np.rec.fromarrays([np.searchsorted(at, where, side="right") - 1, grams[where]], names="d,g"))
                counts.append(np.diff(at))
                flat.append(pairs.g.view(np.int64))
                sizes.append(np.bincount(pairs.d, minlength=len(at) - 1))
            ends = np.concatenate([[0], *sizes]).cumsum().astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *flat])))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(np.concatenate([np.zeros(0, np.int64), *counts]), pa.int64()), lists], names=[*names, "n_words", "prints"])

    return mapped(texts, run, f"{kept}, n_words bigint, prints array<bigint>")


def _matched(docs: DataFrame, index, passed: str, inside: str | None = None) -> DataFrame:
    """docs (passed..., text) with RESULT in place of text; inside: the text is this field of the struct `row` instead."""

    def run(batches):
        own = index.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("row")).field(inside) if inside else batch.column(batch.schema.get_field_index("text"))
            parts = [own.match(data, offs) for _, _, data, offs in K.text_batches(column)]
            keep = [n for n in batch.schema.names if n != "text"]
            n_words = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
            n_hit = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
            ids = [sorted({own.ids[i] for i in x} - {None}) for p in parts for x in p[2]]
            runs = [x for p in parts for x in p[3]]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(n)) for n in keep), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array(ids, pa.list_(pa.string())), pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())])))],
                names=[*keep, "n_words", "n_hit", "item_ids", "runs"],
            )

    return mapped(docs, run, f"{passed}, {RESULT}" if passed else RESULT)


def find_benchmark_words(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row of docs as the struct `row`, with n_words, n_hit, item_ids (sorted strings) and runs of hit words.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased. A null text has no words and so no
    hits; so has every document if the benchmark is empty. Items with a null id hit words, but are not in item_ids;
    rows of one item id count as one item. Repeated rows are each judged. Names of docs cannot clash with the results,
    as its columns stay inside `row`.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).where(F.length("text") > 0)
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    passed = f"row {source.schema['row'].dataType.simpleString()}"

    def indexes(own: DataFrame, blocks: int):
        for block in range(blocks):
            rows = own.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).select("id", "text").collect()
            made = spark.sparkContext.broadcast(BenchmarkIndex.build([r[0] for r in rows], [r[1] for r in rows]))
            yield made
            made.destroy()  # one block at a time, on the driver too

    def blocks_of(own: DataFrame) -> int:
        return -(-int(own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // block_bytes)

    if blocks_of(items) <= 1:
        rows = items.collect()
        return _matched(source, spark.sparkContext.broadcast(BenchmarkIndex.build([r[0] for r in rows], [r[1] for r in rows])), passed, text)
    # Several blocks: what each finds is keyed by the text, merged, and joined to the documents again.
    own = F.col("row").getField(text)
    keyed = source.withColumn("key", F.struct(F.xxhash64(own).alias("a"), F.sha2(F.coalesce(own, F.lit("")), 256).alias("b")))
    texts = keyed.select("key", own.alias("text"))
    key = f"key {texts.schema['key'].dataType.simpleString()}"
    signed = materialize(fingerprints(items, "id string, text string", ("id", "text")), "benchmark-items")
    long_, short = signed.where(F.col("n_words") >= WINDOW), signed.where(F.col("n_words") < WINDOW)
    # The join of fingerprints: one that many documents have is dealt to several tasks; items are the smaller side.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    asked = long_.select(F.explode("prints").alias("print")).distinct().select("print", salts.alias("salt"))
    met = fingerprints(texts, key).select("key", F.explode("prints").alias("print"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"))
    sharing = met.join(asked, ["print", "salt"], "left_semi").select("key").distinct()
    near = materialize(texts.join(sharing, "key", "left_semi").dropDuplicates(["key"]), "benchmark-near")
    union = spark.createDataFrame([], f"{key}, {RESULT}")
    for some, read in ((long_, near), (short, texts)):
        for own_index in indexes(some, blocks_of(some)):
            union = union.unionByName(materialize(_matched(read, own_index, key).where("n_hit > 0"), "benchmark-hits"))
    merged = (
        union.groupBy("key")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"), F.array_distinct(F.flatten(F.collect_set("runs"))).alias("runs"))
        .withColumn("runs", _merged_runs(F.col("runs")))
    )
    nothing = BenchmarkIndex.build([], [])
    counted = _matched(keyed, spark.sparkContext.broadcast(nothing), f"{passed}, {key}", text)
    runs = F.coalesce(F.col("m.runs"), F.col("c.runs"))
    return counted.alias("c").join(merged.alias("m"), F.col("c.key") == F.col("m.key"), "left").select(
        "c.row", "c.n_words", F.aggregate(runs, F.lit(0).cast("bigint"), lambda s, r: s + r["past"] - r["first"]).alias("n_hit"),
        F.coalesce("m.item_ids", "c.item_ids").alias("item_ids"), runs.alias("runs"),
    )


def _merged_runs(runs: Column) -> Column:
    """The union of overlapping runs."""
    kind = "array<struct<first:int,past:int>>"

    def add(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["first"].alias("first"), F.greatest(last["past"], r["past"]).alias("past"))
        return F.when(F.size(done) == 0, F.array(r)).when(r["first"] <= last["past"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(runs), F.array().cast(kind), add)


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words, and one word, are hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def leaks(runs: Column, n_hit: Column, n_words: Column) -> Column:
    """A whole window of an item occurs, or shorter items make up a twentieth of the words."""
    return F.exists(runs, lambda r: r["past"] - r["first"] >= WINDOW) | contaminated(n_hit, n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without the documents that leak benchmark items, with the columns of docs.

    This is stricter than contaminated(): WINDOW consecutive words of an item are a leak in a text of any length. A null or
    empty text leaks nothing and stays; repeated rows stay or go together; an empty benchmark removes nothing; items
    without an id count; an empty table gives no rows.
    """
    found = find_benchmark_words(docs, benchmark, text)
    return found.where(~leaks(F.col("runs"), F.col("n_hit"), F.col("n_words"))).select("row.*")
