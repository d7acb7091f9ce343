"""Similarity join on word n-grams: MinHash banding, then a check of each candidate on its full n-gram set.

1. Every text becomes a digest of its words and b band hashes of r minima each; b and r follow from the target
   recall at the threshold. Texts of the same words form a class, of which one text goes on.
2. Band hashes are shuffled and counted; only texts that share a band with another are candidates. The candidate
   graph has one edge from each text to the least text of its bucket; a bucket lies in one of its components.
3. Candidates meet in tasks by whichever is less work: all texts of a component together, or those of each of its buckets
   apart (buckets of the same texts are one). Near copies share most buckets, so their component costs each text
   once; a long chain of texts, each alike to the next alone, costs its buckets, in proportion to its length. In a
   bucket a pair is compared only if no earlier band has it, so pairs count once. Texts meet in blocks of bounded size;
   a group of several blocks is checked block pair by block pair, so no task gets more than two blocks. Pairs are
   compared inside a task on their full n-gram sets; it returns each text's number of partners and a spanning forest
   of the links, never the pairs.
4. Components of those links are the near-duplicate classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwind.llm import kernel as K
from headwind.llm.components import connected_components
from headwind.llm.workers import mapped
from headwind.session import materialize

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Texts and bytes of a block.
BLOCK_ROWS, BLOCK_BYTES = 128, 4 << 20
#: Keys of rows that are sent to all executors at most, about 30 MB; where there are more, texts are shuffled instead.
MOST_KEYS = 1 << 19


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows to a band, so the fewest candidates, that reach the recall at the threshold."""
    if not (0 < threshold <= 1 and 0 < recall < 1):
        raise ValueError("threshold must be in (0, 1], recall in (0, 1)")
    best = None
    for rows in range(1, most_hashes + 1):
        chance = threshold**rows
        bands = 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - chance))
        if bands * rows > most_hashes:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError("most_hashes is too small for that recall")
    return best


def band_hashes(grams: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Each document's band hashes; documents without grams get zeros."""
    out = np.zeros((len(at) - 1, bands), K.U64)
    full = np.flatnonzero(np.diff(at) > 0)
    if not len(full):
        return out
    rng = np.random.default_rng(20240229)
    factors = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    base, first = (grams >> K.U64(32)).astype(np.uint32), at[:-1][full]
    buffer = np.empty_like(base)
    for b in range(bands):
        h = np.full(len(full), b + 1, K.U64)
        for j in range(b * rows, (b + 1) * rows):
            np.multiply(base, factors[j], out=buffer)
            np.bitwise_xor(buffer, shifts[j], out=buffer)
            h = K.mix(h ^ np.minimum.reduceat(buffer, first).astype(K.U64))
        out[full, b] = h
    return out


def signatures(docs: DataFrame, key: str, k: int, bands: int, rows: int) -> DataFrame:
    """(key..., n_words, d1, d2, bands) of docs (key..., text); key is the schema of the columns before text."""

    def run(batches):
        for batch in batches:
            parts = []
            for _, _, data, offs in K.text_batches(batch.column(batch.schema.get_field_index("text"))):
                starts, ends, at = K.spans(data, offs, K.ALNUM)
                words = K.word_hashes(data, starts, ends)
                grams, gat = K.shingles(words, at, k)
                parts.append((np.diff(at), K.sequence_digests(words, at), band_hashes(grams, gat, bands, rows)))
            n, d, b = map(np.concatenate, zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros((0, 2), K.U64), np.zeros((0, bands), K.U64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * bands + 1, bands, dtype=np.int32)), pa.array(b.ravel().view(np.int64)))
            names = [x for x in batch.schema.names if x != "text"]
            d = d.view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(x)) for x in names), pa.array(n, pa.int64()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), lists], names=[*names, "n_words", "d1", "d2", "bands"])

    return mapped(docs, run, f"{key}, n_words bigint, d1 bigint, d2 bigint, bands array<bigint>")


class Sets:
    """The distinct n-grams of some texts, with postings, to count what pairs share."""

    def __init__(self, grams: np.ndarray, at: np.ndarray):
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        order = np.lexsort((owner, grams))
        g, o = grams[order], owner[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
        g, o = g[new], o[new]
        self.n = len(at) - 1
        self.size = np.bincount(o, minlength=self.n)
        step = np.ones(len(g), bool)
        step[1:] = g[1:] != g[:-1]
        gid = np.cumsum(step) - 1
        df = np.bincount(gid)
        first = np.cumsum(df) - df
        shared = df[gid] > 1
        self.posts = o
        # The postings of each text's shared n-grams, text by text.
        by = np.argsort(o[shared], kind="stable")
        ids = gid[shared][by]
        self.start, self.count = first[ids], df[ids]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(o[shared], minlength=self.n))])

    def shared(self, i: int) -> np.ndarray:
        """How many n-grams text i shares with each text."""
        a, b = self.at[i], self.at[i + 1]
        count = self.count[a:b]
        total = int(count.sum())
        if not total:
            return np.zeros(self.n, np.int64)
        base = np.repeat(self.start[a:b] - np.cumsum(count) + count, count)
        return np.bincount(self.posts[base + np.arange(total)], minlength=self.n)


def _links(sets: Sets, side: np.ndarray, same: bool, weight: np.ndarray, threshold: float, bands: np.ndarray | None = None, band: int = -1) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The weight of each text's partners, and the edges of a spanning forest of the links.

    same: all pairs are compared; else those of a text of side 0 with one of side 1. With bands, a row of band hashes for
    each text, only pairs count of which `band` is the first that they share.
    """
    n, size = sets.n, sets.size
    partners, label, edges = np.zeros(n, np.int64), np.arange(n), []
    for i in range(n) if same else np.flatnonzero(side == 0).tolist():
        both = sets.shared(i)
        # Jaccard >= threshold as both * (1 + t) >= t * (sizes), with room for rounding.
        near = (both * (1 + threshold) >= threshold * (size[i] + size) - 1e-9) & (both > 0)
        if same:
            near[: i + 1] = False
        else:
            near &= side == 1
        j = np.flatnonzero(near)
        if bands is not None and len(j):
            j = j[(bands[j] == bands[i]).argmax(1) == band]
        if not len(j):
            continue
        partners[j] += weight[i]
        partners[i] += weight[j].sum()
        met, first = np.unique(label[j], return_index=True)
        for other, at in zip(met.tolist(), first.tolist()):
            if other != label[i]:
                edges.append((i, int(j[at])))
                label[label == other] = label[i]
    return partners, edges


def _checked(batches: Iterator[pa.RecordBatch], k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """For rows (band, bucket, i, j, side, cid, weight, bands, text) in order of the first four: (cid, partners, other) for
    each text with partners, with other null, and for each edge of the forest, with partners 0. A band below 0 is that of
    a whole component, whose texts come without bands."""
    group = ("band", "bucket", "i", "j")
    schema = pa.schema([("cid", pa.int64()), ("partners", pa.int64()), ("other", pa.int64())])

    def done(t: pa.Table) -> pa.RecordBatch:
        grams, counts = [], []
        for _, _, data, offs in K.text_batches(t["text"]):
            starts, ends, at = K.spans(data, offs, K.ALNUM)
            g, gat = K.shingles(K.word_hashes(data, starts, ends), at, k)
            grams.append(g)
            counts.append(np.diff(gat))
        grams, at = np.concatenate(grams), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        col = {c: t[c].to_numpy() for c in (*group, "side", "cid", "weight")}
        new = np.logical_or.reduce([col[c][1:] != col[c][:-1] for c in group])
        bounds = [0, *(np.flatnonzero(new) + 1).tolist(), len(t)]
        cids, partners, others = [], [], []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo < 2:
                continue
            cid, band = col["cid"][lo:hi], int(col["band"][lo])
            bands = np.array(t["bands"].slice(lo, hi - lo).combine_chunks().flatten()).reshape(hi - lo, -1) if band >= 0 else None
            found, edges = _links(Sets(grams[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]), col["side"][lo:hi], col["i"][lo] == col["j"][lo], col["weight"][lo:hi], threshold, bands, band)
            some = np.flatnonzero(found)
            cids += [*cid[some].tolist(), *(int(cid[a]) for a, _ in edges)]
            partners += [*found[some].tolist(), *[0] * len(edges)]
            others += [*[None] * len(some), *(int(cid[b]) for _, b in edges)]
        return pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(partners, pa.int64()), pa.array(others, pa.int64())], schema=schema)

    wait: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        # Whole groups only: what follows the last change of group waits for the next batch.
        key = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in group]
        if wait and [int(x[0]) for x in key] != [wait[-1].column(wait[-1].schema.get_field_index(c))[-1].as_py() for c in group]:
            yield done(pa.Table.from_batches(wait))
            wait = []
        steps = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in key]))
        if len(steps):
            yield done(pa.Table.from_batches([*wait, batch.slice(0, int(steps[-1]) + 1)]))
            wait, batch = [], batch.slice(int(steps[-1]) + 1)
        wait.append(batch)
    if wait:
        yield done(pa.Table.from_batches(wait))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, class_id, n_links, copies, first_id, first_hash.

    n_links: how many other rows have a text whose set of k-word n-grams has a Jaccard similarity of threshold or
    more; class_id: the smallest doc_id that is reached over such links. Words are lower-cased runs of letters, digits
    and bytes beyond ASCII; a text of fewer than k words, but not none, has one n-gram of all of them. Texts of the
    same words are copies: similar with 1, and counted in each other's n_links. A null text, or one without words, has
    no links and its own doc_id as class_id; first_id and first_hash are then its own. Repeated rows, or rows of one
    doc_id, are each a row; a null doc_id has a row too and sorts before all others among first_id. doc_id must be an
    integer. text_hash (xxhash64 of the text) and doc_id name a row; first_id and first_hash name one row of the class,
    the same for all its members.
    """
    bands, rows = choose_bands(threshold, recall)
    own = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text"))
    signed = materialize(signatures(own, "doc_id bigint, text_hash bigint", k, bands, rows), "jaccard-signatures")
    worded = signed.where("n_words > 0")
    # One text of each class goes on: the least row, so that the same one is found again below.
    classes = worded.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "text_hash")).alias("least_row"), F.min("doc_id").alias("least_id"), F.count("*").alias("weight"), F.min("n_words").alias("n_words"), F.min("bands").alias("bands"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")
    in_bands = classes.select("cid", "n_words", F.posexplode("bands").alias("band", "hash"))
    counted = in_bands.groupBy("band", "hash").agg(F.min("cid").alias("least"), F.count("*").alias("n"), F.sum("n_words").alias("words"), F.bit_xor(F.xxhash64("cid")).alias("texts")).where("n > 1")
    shared = materialize(in_bands.drop("n_words").join(counted, ["band", "hash"]), "jaccard-buckets")
    # A class is linked to the least of its bucket; distinct pairs, as near copies meet in most bands.
    stars = shared.where("cid != least").select(F.col("cid").alias("u"), F.col("least").alias("v")).distinct()
    groups = connected_components(stars, "jaccard-groups").select(F.col("node").alias("cid"), "root")
    blocks = lambda n, words: F.greatest(F.ceil(n / block_rows), F.ceil(words * 8 / block_bytes)).cast("int")
    # Of buckets with the same texts the one of the first band; the work of a group is its texts times its blocks.
    single = shared.where("cid = least").groupBy("least", "n", "texts").agg(F.min(F.struct("band", "hash")).alias("b"), F.min("words").alias("words"))
    single = single.join(groups.withColumnRenamed("cid", "least"), "least").select("root", "b.band", "b.hash", blocks(F.col("n"), F.col("words")).alias("blocks"), "n")
    members = materialize(classes.join(groups, "cid"), "jaccard-members")
    whole = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_words").alias("words")).select("root", blocks(F.col("n"), F.col("words")).alias("blocks"), "n")
    apart = single.groupBy("root").agg(F.sum(F.col("n") * F.col("blocks")).alias("work"))
    ways = whole.join(apart, "root").select("root", "blocks", (F.col("work") < F.col("n") * F.col("blocks")).alias("by_bucket"))
    ways = materialize(ways, "jaccard-ways")
    together = members.join(ways.where("not by_bucket"), "root").select("cid", F.lit(-1).alias("band"), F.col("root").alias("bucket"), "blocks")
    bucketed = single.join(ways.where("by_bucket").select("root"), "root", "left_semi").select("band", "hash", "blocks")
    parted = shared.select("cid", "band", "hash").join(bucketed, ["band", "hash"]).select("cid", "band", F.col("hash").alias("bucket"), "blocks")
    # Where each text goes: at most one place for each band, so the lists are short.
    places = together.unionByName(parted).groupBy("cid").agg(F.collect_list(F.struct("band", "bucket", "blocks")).alias("places"))
    placed = members.join(places, "cid").select("cid", "weight", "places", F.when(F.col("places")[0]["band"] >= 0, F.col("bands")).alias("bands"), F.col("least_row.doc_id").alias("row_id"), F.col("least_row.text_hash").alias("row_hash"))
    placed = materialize(placed, "jaccard-placed")
    # Their texts, found again by the row that stands for each class; repeated rows give one.
    wanted = placed.select("row_id", "row_hash")
    texts = _with_keys(own, wanted, "doc_id", "text_hash", wanted.count())
    met = texts.join(placed, F.col("doc_id").eqNullSafe(F.col("row_id")) & (F.col("text_hash") == F.col("row_hash"))).dropDuplicates(["row_id", "row_hash"])
    met = met.select("cid", "weight", "bands", "text", F.inline("places")).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("band", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cid", "weight", "bands", "text")
    spread = met.repartition("band", "bucket", "i", "j").sortWithinPartitions("band", "bucket", "i", "j", "cid")
    found = materialize(mapped(spread, lambda it: _checked(it, k, threshold), "cid bigint, partners bigint, other bigint"), "jaccard-links")
    partners = found.where("other is null").groupBy("cid").agg(F.sum("partners").alias("partners"))
    links = found.where("other is not null").select(F.col("cid").alias("u"), F.col("other").alias("v"))
    roots = connected_components(links, "jaccard-linked").select(F.col("node").alias("cid"), "root")
    linked = classes.drop("bands", "n_words").join(partners, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    linked = materialize(linked, "jaccard-roots")
    firsts = linked.groupBy("root").agg(F.min("least_row").alias("class_first"), F.min("least_id").alias("class_id"))
    found = linked.join(firsts, "root").select("d1", "d2", F.col("weight").alias("copies"), (F.col("weight") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"), "class_first", "class_id")
    return (
        signed.drop("bands")
        .join(found, ["d1", "d2"], "left")
        .select(
            "doc_id", "text_hash",
            F.when(F.col("n_words") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
            F.when(F.col("n_words") > 0, F.col("n_links")).otherwise(0).cast("bigint").alias("n_links"),
            F.when(F.col("n_words") > 0, F.col("copies")).otherwise(1).cast("bigint").alias("copies"),
            F.when(F.col("n_words") > 0, F.col("class_first.doc_id")).otherwise(F.col("doc_id")).alias("first_id"),
            F.when(F.col("n_words") > 0, F.col("class_first.text_hash")).otherwise(F.col("text_hash")).alias("first_hash"),
        )
    )


def _with_keys(rows: DataFrame, keys: DataFrame, first: str, second: str, n: int, without: bool = False, most_keys: int | None = None) -> DataFrame:
    """rows whose (first, second) are among the n keys of two columns, or are not; a null equals a null.

    Up to most_keys keys are sent to all executors, and rows stay where they are. Beyond that nothing is filtered out
    that must be found, and everything is shuffled that must be left out.
    """
    own = keys.toDF("key_a", "key_b").distinct()
    same = F.col(first).eqNullSafe(F.col("key_a")) & (F.col(second) == F.col("key_b"))
    if n <= (MOST_KEYS if most_keys is None else most_keys):
        return rows.join(F.broadcast(own), same, "left_anti" if without else "left_semi")
    return rows.join(own, same, "left_anti") if without else rows


def one_of_each_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each near-duplicate class, with the columns of docs: the row with the least doc_id, null
    first, and of these the least hash of the text.

    Texts without words are copies only of rows with the same doc_id and text. Of rows that agree in doc_id and text
    one stays. An empty table stays empty.
    """
    found = near_duplicates(docs, doc_id, text, **options)
    stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    keys = materialize(found.select("doc_id", "text_hash", stays.alias("stays")).groupBy("doc_id", "text_hash").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("n")), "jaccard-kept")
    gone, again = keys.where("not stays").select("doc_id", "text_hash"), keys.where("stays and n > 1").select("doc_id", "text_hash")
    n_gone, n_again = keys.agg(F.count_if(~F.col("stays")), F.count_if(F.col("stays") & (F.col("n") > 1))).first()
    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").cast("bigint").alias("own_id"), F.xxhash64(F.col(f"`{text}`")).alias("own_hash"))
    kept = _with_keys(nested, gone, "own_id", "own_hash", n_gone, without=True)
    if n_again:  # only rows that are there twice meet their like
        once = _with_keys(kept, again, "own_id", "own_hash", n_again, without=True)
        twice = kept.join(again, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")), "left_semi").dropDuplicates(["own_id", "own_hash"])
        kept = once.unionByName(twice)
    return kept.select("row.*")
