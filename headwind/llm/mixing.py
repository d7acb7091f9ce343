"""Mixing sources to target weights by balanced sampling with the cube method.

Every document is taken floor(r) times and once more with probability r - floor(r), r being its source's target over
its source's size. The extra takes are a balanced sample: the flight phase moves the probabilities through the null
space of two constraints - the number of documents and the number of words taken - until nearly all are 0 or 1. Sources
are cut into blocks of bounded size, whose flights run apart and leave at most two open documents each; the open ones
meet in further rounds of blocks. The block that is its source's only one flies until LANDING documents are open, and
the landing phase draws one of their samples from the distribution that keeps every probability and, among those,
has the least expected distance from the balance: a linear programme. So the mean of what is taken is every
document's rate. A mix whose words miss the source's target by more than NEAR is drawn again, a bounded number of times;
if none is near, documents of the nearest are changed, one or two at a time. So it is where one document outweighs what
a small source is to give: a near mix cannot hold it as often as its rate asks, and nearness comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwind.llm import kernel as K
from headwind.llm.workers import mapped
from headwind.session import materialize

#: Weights of the sources in order, repeated; words to take over all words; most takes of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BLOCK, SEED = 2048, 17
#: Documents that the landing phase closes together: it weighs up 2 ** LANDING samples.
LANDING = 12
#: Distance from its target, as a part of it, at which a source's mix is drawn again; flights, and landings of each.
NEAR, FLIGHTS, LANDINGS = 0.005, 4, 4
_EPS = 1e-9


def _random(draw: np.ndarray, *turn: int) -> np.random.Generator:
    """Random numbers that depend on the rows' draws and the turn alone."""
    return np.random.default_rng((np.asarray(draw)[:8] * float(1 << 53)).astype(np.uint64).tolist() + list(turn))


def flight(p: np.ndarray, size: np.ndarray, draw: np.ndarray, most_open: int = 2, turn: int = 0) -> np.ndarray:
    """p moved until at most most_open (2 or more) are fractional, with sum(p) and sum(p * size) kept.

    draw: uniform numbers that decide the moves, with the turn. In each move the largest open unit goes up or down as fast as it can
    while all other open ones make up for it in a random way, those near 0 or 1 the least; so large units close early, when many others
    can balance them. Each move closes a unit or more.
    """
    p, size = p.astype(float).copy(), size.astype(float)
    p[(p <= _EPS) | (p >= 1 - _EPS)] = np.round(p[(p <= _EPS) | (p >= 1 - _EPS)])
    rng = _random(draw, turn)
    open_ = np.flatnonzero((p > 0) & (p < 1))
    open_ = open_[np.argsort(-size[open_], kind="stable")]
    own, ranked = p[open_], size[open_]
    while len(open_) > max(most_open, 2):
        u = _direction(own, ranked, rng.standard_normal(len(open_) - 1))
        speed = np.abs(u) + 1e-300
        up = np.where(u > 0, 1 - own, own)
        forth, back = up / speed, (1 - up) / speed
        rise, fall = int(forth.argmin()), int(back.argmin())
        if rng.random() * (forth[rise] + back[fall]) < back[fall]:
            limit, own = rise, own + forth[rise] * u
        else:
            limit, own = fall, own - back[fall] * u
        # The unit that limits the move is closed by definition, whatever rounding says.
        own[limit] = round(own[limit])
        gone = (own <= _EPS) | (own >= 1 - _EPS)
        own[gone] = np.abs(np.round(own[gone]))
        p[open_] = own
        open_, own, ranked = open_[~gone], own[~gone], ranked[~gone]
    return p


def _direction(p: np.ndarray, size: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """A direction that keeps sum(p) and sum(p * size), of units from the largest to the smallest, three or more.

    The first unit moves by up to 1; the others by w * (noise - a - b * size) with w = p * (1 - p), a and b being what both
    sums ask for. Without noise units of like size would be taken or left together.
    """
    w = p[1:] * (1 - p[1:])
    whole = float(w.sum())
    mid = float(w @ size[1:]) / whole
    off = size[1:] - mid
    heavy, jolt = w * off, w * noise
    spread, ahead = float(heavy @ off), float(size[0]) - mid
    u = np.empty(len(p))
    if spread > 1e-9 * max(1.0, mid * mid) * whole:
        answer = 1 / whole + ahead / spread * off
        # As fast as the others can follow: a unit that they cannot balance waits for the landing.
        u[0] = pace = 1 / max(1.0, float(np.abs(answer).max()) / 5)
        u[1:] = jolt - w * (float(jolt.sum()) / whole) - heavy * (float(jolt @ off) / spread) - pace * w * answer
    elif ahead <= 1e-9 * max(1.0, mid):  # all alike
        u[0], u[1:] = 1.0, jolt - w * ((1 + float(jolt.sum())) / whole)
    else:  # the others are alike and cannot make up for the first: two of them move against each other
        u[:] = 0.0
        u[1], u[2] = 1.0, -1.0
    return u


@dataclass
class Landing:
    """The units that flight leaves open, at most about a dozen, and the chances of their samples.

    All samples of the open units are weighed up: of the distributions over them under which every unit keeps its
    probability, one with the least expected distance from the balance is taken, by the simplex method. Distance is that of
    words; that of documents decides between equals.
    """

    p: np.ndarray
    units: np.ndarray
    samples: np.ndarray
    chance: np.ndarray

    @classmethod
    def of(cls, p: np.ndarray, size: np.ndarray) -> Landing:
        units = np.flatnonzero((p > 0) & (p < 1))
        own, s = p[units], size[units].astype(float)
        samples = (np.arange(1 << len(units))[:, None] >> np.arange(len(units)) & 1).astype(float)
        words, docs = np.abs(samples @ s - own @ s), np.abs(samples.sum(1) - own.sum())
        return cls(p.astype(float), units, samples, _least_mean(samples, own, words + docs * 1e-3) if len(units) else np.ones(1))

    def draw(self, rng: np.random.Generator) -> np.ndarray:
        """p with the open units closed by one of their samples."""
        out = self.p.copy()
        at = np.searchsorted(np.cumsum(self.chance), rng.random() * self.chance.sum(), side="right")
        out[self.units] = self.samples[min(int(at), len(self.samples) - 1)]
        return out


def landing(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Close the units that flight leaves open, each with its probability."""
    return Landing.of(p, size).draw(_random(draw, 0, 0))


def _least_mean(samples: np.ndarray, p: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The chances of the samples with the least mean cost of those under which unit i is in a sample with chance p[i].

    The simplex method from the nested samples of the likeliest units. Ties among p are parted by less than 1e-7, as
    equal ones would let it go round in circles.
    """
    m = len(p)
    p = np.clip(p + np.linspace(0.0, 1e-8, m), 1e-9, 1 - 1e-9)
    rows = np.concatenate([np.ones((1, len(samples))), samples.T])
    goal = np.concatenate([[1.0], p])
    order = np.argsort(-p, kind="stable")
    nested = np.concatenate([[0], np.cumsum(1 << order)])
    basis = nested.astype(int)
    for _ in range(200 * (m + 1)):
        inverse = np.linalg.inv(rows[:, basis])
        gain = cost - (cost[basis] @ inverse) @ rows
        gain[basis] = 0.0
        into = int(np.argmin(gain))
        if gain[into] > -1e-9 * max(1.0, np.abs(cost).max()):
            break
        now, move = inverse @ goal, inverse @ rows[:, into]
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(move > 1e-11, now / move, np.inf)
        if not np.isfinite(reach.min()):
            break
        basis[int(np.argmin(reach))] = into
    chance = np.zeros(len(samples))
    chance[basis] = np.maximum(np.linalg.solve(rows[:, basis], goal), 0.0)
    return chance


def _nearest_change(change: np.ndarray, over: float) -> np.ndarray:
    """The one or two units whose change brings over nearest to 0; none if that isn't nearer than it is."""
    if not len(change):
        return np.zeros(0, np.int64)
    best, units = abs(over) - _EPS, np.zeros(0, np.int64)
    k = int(np.argmin(np.abs(over + change)))
    if abs(over + change[k]) < best:
        best, units = abs(over + change[k]), np.array([k])
    order = np.argsort(change, kind="stable")
    ranked = change[order]
    place = np.searchsorted(ranked, -(over + ranked))
    for shift in (-1, 0):
        other = np.clip(place + shift, 0, len(ranked) - 1)
        left = np.abs(over + ranked + ranked[other])
        left[other == np.arange(len(ranked))] = np.inf
        i = int(np.argmin(left))
        if left[i] < best:
            best, units = left[i], order[[i, other[i]]]
    return units


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block after its flight; if it is its source's only one, after its landing, near the source's target if that can be."""
    pdf = pdf.sort_values(["draw", "doc_id", "row_hash"], kind="stable")
    p, size, draw = (pdf[c].to_numpy() for c in ("p", "size", "draw"))
    out = pdf.drop(columns=["block", "blocks"])
    if pdf["blocks"].iloc[0] > 1:
        return out.assign(p=flight(p, size, draw))
    best, left = None, np.inf
    for turn in range(FLIGHTS):
        landed = Landing.of(flight(p, size, draw, LANDING, turn), size)
        for again in range(LANDINGS):
            now = landed.draw(_random(draw, turn, again))
            off = abs(float(((now - p) * size).sum()))
            if off < left:
                best, left = now, off
            if left <= NEAR * float(pdf["target"].iloc[0]):
                return out.assign(p=best)
    over = float(((best - p) * size).sum())
    for _ in range(len(best)):
        change = np.where(best == 1.0, -size, size).astype(float)
        units = _nearest_change(change, over)
        if not len(units):
            break
        over += float(change[units].sum())
        best[units] = 1.0 - best[units]
    return out.assign(p=best)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [np.diff(K.spans(data, offs, K.VISIBLE)[2]) for _, _, data, offs in K.text_batches(batch.column(batch.schema.get_field_index("text")))]
        names = [n for n in batch.schema.names if n != "text"]
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(n, pa.int64())], names=[*names, "size"])


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of (source, size, ...).

    Sources in code point order, null last, weigh weights[0], weights[1], ... over and over, and share `share` of all
    words by weight; a target stops at `most` times its source's size, and the excess is shared again by weight until none
    is above. Then target = min(most * size, level * weight) for one level, which is found by a few sums over the sources.
    """
    if share > most:
        raise ValueError("share must not be above most: no targets would do")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = totals.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = materialize(ranged.withColumn("at", F.monotonically_increasing_id()), "mixing-sources").withColumn("part", F.shiftright("at", 33))
    before, offsets = 0, []
    for part, n in sorted(placed.groupBy("part").count().collect()):
        offsets.append((part, before - (part << 33)))
        before += n
    offsets = sizes.sparkSession.createDataFrame(offsets, "part bigint, shift bigint")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = placed.join(offsets, "part").select("source", "source_size", F.element_at(cycle, (F.pmod(F.col("at") + F.col("shift"), F.lit(len(weights))) + 1).cast("int")).alias("weight"))
    cap, level, capped = F.col("source_size") * F.lit(float(most)), 0.0, -1
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        n, used, weight, total = ranked.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
        if n == capped or not weight:
            break
        level, capped = (share * int(total) - used) / weight, n
    return ranked.select("source", "source_size", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def mix_to_targets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row for each row of docs: doc_id, row_hash, source, size, source_size, target, times.

    size: words [^\\x20\\x09-\\x0D]+ of the text, 0 for null; times: how often the mix takes the row, floor or ceiling of
    target / source_size, so never above `most`; row_hash: a hash of all columns that can be hashed. A null source is a
    source of its own; a source without words has target 0 and is not taken. A draw depends on seed, doc_id and row_hash
    alone, so a rerun agrees; repeated rows are each drawn and interchangeable. An empty table gives no rows.
    """
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    own = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.xxhash64(*hashed).alias("row_hash"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{text}`").alias("text"))
    sized = materialize(mapped(own, _sizes, "doc_id bigint, row_hash bigint, source string, size bigint"), "mixing-sizes")
    targets = materialize(source_targets(sized, weights, share, most), "mixing-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # Rates that rounding leaves next to a whole number are that number.
    rate = F.when(F.abs(rate - F.round(rate)) < _EPS, F.round(rate)).otherwise(rate)
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select("doc_id", "row_hash", sized["source"], "size", "source_size", "target", rate.alias("rate"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "row_hash"), 11) / F.lit(float(1 << 53))
    now = joined.withColumns({"p": F.col("rate") - F.floor("rate"), "draw": draw})
    schema = "doc_id bigint, row_hash bigint, source string, size bigint, source_size bigint, target double, rate double, p double, draw double"
    done, turn = [now.where("p = 0")], 0
    now = now.where("p > 0")
    while turn == 0 or not now.isEmpty():
        counts = now.groupBy("source").agg(F.ceil(F.count("*") / block).cast("bigint").alias("blocks"))
        blocked = now.join(counts.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        blocked = blocked.withColumn("block", F.pmod(F.xxhash64(F.lit(turn), "draw"), "blocks"))
        flown = materialize(blocked.groupBy("source", "block").applyInPandas(_block, schema), "mixing-flown")
        done.append(flown.where("p = 0 or p = 1"))
        now, turn = flown.where("p > 0 and p < 1"), turn + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "row_hash", "source", "size", "source_size", "target", (F.floor("rate") + F.round("p")).cast("bigint").alias("times"))


def repeat_by_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """docs with each row as often as the mix takes it, with the columns of docs.

    A null doc_id or source is a value of its own; a null or empty text has no words, and is taken as others of its source
    are; of rows alike in every column that can be hashed, as many come back as the mix takes of them together; an empty
    table gives no rows.
    """
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    taken = mix_to_targets(docs, doc_id, text, source, **options)
    # Rows alike in doc_id and hash are alike: what the mix takes of them together is all that counts.
    taken = taken.groupBy("doc_id", "row_hash").agg(F.sum("times").alias("times"), F.count("*").alias("alike")).where("times > 0")
    taken = taken.select(F.col("doc_id").alias("of_id"), F.col("row_hash").alias("of_hash"), "times", "alike")
    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").cast("bigint").alias("own_id"), F.xxhash64(*hashed).alias("own_hash"))
    met = nested.join(taken, F.col("own_id").eqNullSafe(F.col("of_id")) & (F.col("own_hash") == F.col("of_hash")))
    once = met.where("alike = 1").unionByName(met.where("alike > 1").dropDuplicates(["own_id", "own_hash"]))
    return once.withColumn("turn", F.explode(_turns(F.col("times")))).select("row.*")


def _turns(times: Column) -> Column:
    return F.sequence(F.lit(1).cast("bigint"), times)
