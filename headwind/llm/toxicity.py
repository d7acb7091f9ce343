"""Toxicity by noisy-channel deobfuscation, then scoring of the restored text.

A text's suspicious tokens - letters mixed with digits and marks, letters with marks between them, letters repeated
three times or more, signs alone, runs of single letters and signs - become character lattices: each sign may stand for itself, for a letter
that it resembles, or for nothing. Viterbi decoding under a character trigram model finds the likeliest letters. All
other tokens have one reading and stay. The restored text is scored by logistic regression on the presence of words and
of five-byte pieces of words that labelled documents show to be typical of toxic ones.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwind.llm import kernel as K
from headwind.llm import letters as L
from headwind.llm.folds import fold
from headwind.llm.workers import mapped
from headwind.session import materialize

#: Labelled rows of each label to learn from at most; features chosen; least toxic documents a feature must be in.
MOST_ROWS, FEATURES, LEAST = 3_000, 1_000, 5
_BITS = 18

#: What a sign may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "¡": "i", "€": "e", "£": "l",
}
#: Costs, as negative logarithms: a letter for a sign that resembles it, nothing for a mark, for a sign that resembles a
#: letter, or for a repetition, any vowel for a star, and a sign that stands for itself and so ends a word.
SWAP, DROP, LOSE, REPEAT, STAR, STAY = 1.0, 0.5, 5.0, 0.3, 2.0, 10.0
#: Letters with two before them, and readings of tokens, that a worker remembers at most.
MOST_KNOWN = 100_000

_SIGNS = K._class(b"0123456789@$!|+(<")
_MARKS = K._class(b"@$!|+(<")
#: Letterless tokens that are numbers.
_NUMBER = re.compile(r"[$+<|]*\d+[+!%|]*|\d*")
_TRIPLE = re.compile(r"([^\W\d_])\1\1", re.IGNORECASE)
_LETTERS = K._class(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))


@dataclass
class LetterModel:
    """Costs of letters after two others, from hashed counts of letters and their neighbours."""

    pairs: np.ndarray
    triples: np.ndarray
    singles: np.ndarray

    def __post_init__(self) -> None:
        self.seen: dict[tuple[int, int, int], float] = {}

    def cost(self, a: int, b: int, c: int) -> float:
        """Of c after a and b; 0 stands for a word's edge."""
        found = self.seen.get((a, b, c))
        if found is None:
            one = [np.array([x], np.uint32) for x in (a, b, c)]
            two, before = self.pairs[L.hashed(_BITS, one[1], one[2])[0]], self.singles[L.hashed(_BITS, one[1])[0]]
            three, pair = self.triples[L.hashed(_BITS, *one)[0]], self.pairs[L.hashed(_BITS, one[0], one[1])[0]]
            low = 0.9 * two / max(before, 1) + 0.1 / 64
            # At a word's beginning nothing precedes its edge.
            p = low if a == b == 0 else 0.85 * three / max(pair, 1) + 0.15 * low
            if len(self.seen) >= MOST_KNOWN:
                self.seen.clear()
            found = self.seen[a, b, c] = -math.log(max(p, 1e-9))
        return found


def train_letters(docs: DataFrame, text: str = "text") -> LetterModel:
    """Counts of letters with their neighbours in all documents. What reaches the driver is bounded by the buckets."""

    def run(batches):
        counts = {k: np.zeros(1 << _BITS, np.int64) for k in range(3)}
        for batch in batches:
            for _, _, codes, before, after, _ in L.word_batches(batch.column(0)):
                where = np.flatnonzero(codes)
                a, b, c = before[where], codes[where], after[where]
                starts, ends = a == 0, c == 0
                zero = np.zeros(int(starts.sum()), np.uint32)
                # Triples around each letter; pairs of a letter and the next, and of a word's edge and its first letter.
                counts[2] += np.bincount(L.hashed(_BITS, a, b, c), minlength=1 << _BITS)
                counts[1] += np.bincount(L.hashed(_BITS, b, c), minlength=1 << _BITS)
                counts[1] += np.bincount(L.hashed(_BITS, zero, b[starts]), minlength=1 << _BITS)
                counts[0] += np.bincount(L.hashed(_BITS, b), minlength=1 << _BITS)
                counts[0] += np.bincount(L.hashed(_BITS, zero), minlength=1 << _BITS) if ends.any() else 0
        for k, c in counts.items():
            met = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), k, np.int32)), pa.array(met.astype(np.int32)), pa.array(c[met])], names=["k", "bucket", "n"])

    own = docs.select(F.col(f"`{text}`").alias("text")).where("text is not null")
    rows = mapped(own, run, "k int, bucket int, n bigint").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toPandas()
    tables = []
    for k in (1, 2, 0):
        table = np.zeros(1 << _BITS)
        part = rows[rows["k"] == k]
        table[part["bucket"].to_numpy()] = part["n"].to_numpy()
        tables.append(table)
    return LetterModel(*tables)


def readings(token: str, at: int) -> list[tuple[str, float]]:
    """What the sign at a place of a token may stand for, and its cost: letters, nothing, or a blank for itself."""
    ch = token[at]
    if ch.isalpha():
        run = at > 0 and token[at - 1] == ch and (token[at - 2 : at - 1] == ch or token[at + 1 : at + 2] == ch)
        return [(ch, 0.0), *([("", REPEAT)] if run else [])]
    options = [(x, SWAP) for x in LOOKS_LIKE.get(ch, "")]
    if ch == "*":
        options += [(x, STAR) for x in "aeiou"]
    if not ch.isdigit():
        options.append(("", LOSE if ch in LOOKS_LIKE else DROP))
    return [*options, (" ", STAY)]


def decode(token: str, model: LetterModel) -> str:
    """The likeliest reading of a token; parts that end a word are parted by blanks.

    One Viterbi path over the whole token, however long: a state is the last two letters, and each step keeps for every
    state the cost and which state and sign it came from, so time and memory grow with the token's length. Of readings of
    equal cost the one that was met first stays, in the order of readings().
    """
    token = token.lower()
    states: dict[tuple[int, int], float] = {(0, 0): 0.0}
    steps: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
    for at in range(len(token)):
        new: dict[tuple[int, int], float] = {}
        came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        options = readings(token, at)
        for state, cost in states.items():
            a, b = state
            for out, extra in options:
                if out == "":
                    to, total, sign = state, cost + extra, ""
                elif out == " ":
                    to, total, sign = (0, 0), cost + extra + (model.cost(a, b, 0) if b else 0.0), " " if b else ""
                else:
                    c = ord(out)
                    to, total, sign = (b, c), cost + extra + model.cost(a, b, c), out
                old = new.get(to)
                if old is None or total < old:
                    new[to], came[to] = total, (state, sign)
        states = new
        steps.append(came)
    ends = [(cost + (model.cost(*state, 0) if state[1] else 0.0), i, state) for i, (state, cost) in enumerate(states.items())]
    state, text = min(ends)[2], []
    for came in reversed(steps):
        state, sign = came[state]
        text.append(sign)
    return "".join(reversed(text))


def _brackets(data: np.ndarray, offs: np.ndarray) -> set[int]:
    """Places of ( and < that are closed later in their document."""
    closed: set[int] = set()
    for left, right in ((0x28, 0x29), (0x3C, 0x3E)):
        where = np.flatnonzero((data == left) | (data == right))
        docs, stack, own = np.searchsorted(offs, where, side="right"), [], -1
        for place, d, is_left in zip(where.tolist(), docs.tolist(), (data[where] == left).tolist()):
            if d != own:
                stack, own = [], d
            if is_left:
                stack.append(place)
            elif stack:
                closed.add(stack.pop())
    return closed


def _edge_signs(token: bytes, at: int, closed: set[int]) -> tuple[int, int]:
    """How many bytes at the token's two ends are no part of its core: brackets, final !, a sign three times or more."""
    lo, hi = 0, len(token)
    while True:
        ends = (lo, hi)
        while lo < hi and at + lo in closed:
            lo += 1
        while lo < hi and (token[hi - 1] == 0x21 or at + hi - 1 in closed):
            hi -= 1
        for first, step in ((lo, 1), (hi - 1, -1)):
            n = 0
            while lo <= first + n * step < hi and token[first + n * step] == token[first] and _MARKS[token[first]]:
                n += 1
            if n >= 3:
                lo, hi = (lo + n, hi) if step > 0 else (lo, hi - n)
        if (lo, hi) == ends:
            return lo, len(token) - hi


def suspects(data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, bool]]:
    """(start, end, spaced) of tokens with more than one reading, in order; spaced: a run of single letters and signs."""
    starts, ends, at = K.spans(data, offs, K.VISIBLE)
    if not len(starts):
        return []

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int32)
        np.cumsum(flags, out=sums[1:])
        return sums

    # The core of a token: from its first letter, digit or sign to its last, less signs that only decorate it.
    marks, alnum = _MARKS[data], K.ALNUM[data]
    plain = np.flatnonzero(alnum | marks)
    if not len(plain):
        return []
    i, j = np.searchsorted(plain, starts), np.searchsorted(plain, ends) - 1
    some = j >= i
    starts, ends, i, j = starts[some], ends[some], i[some], j[some]
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))[some]
    first, last = plain[i], plain[j] + 1
    edged = np.flatnonzero((marks[first] | marks[last - 1]) & (last - first > 1))
    closed = _brackets(data, offs) if len(edged) else set()
    for k in edged.tolist():
        a, b = int(first[k]), int(last[k])
        less, cut = _edge_signs(data[a:b].tobytes(), a, closed)
        first[k], last[k] = (a + less, b - cut) if less + cut < b - a else (a, a)
    sums = count(alnum | marks)
    inner = last - first - (sums[last] - sums[first])
    sums = count(_LETTERS[data])
    letters = sums[last] - sums[first]
    # Signs of two and three bytes: inverted !, pound, euro; the first is punctuation where it begins a token.
    after, third = np.append(data[1:], 0), np.append(data[2:], (0, 0))[: len(data)]
    turned = (data == 0xC2) & (after == 0xA1)
    foreign = turned | ((data == 0xC2) & (after == 0xA3)) | ((data == 0xE2) & (after == 0x82) & (third == 0xAC))
    sums = count(_SIGNS[data] | foreign)
    at_first = np.minimum(first, len(data) - 1)
    signs = sums[last] - sums[first] - (turned[at_first] & (last > first))
    sums = count((data == 0x27) | (data == 0x2D))
    apostrophe = sums[last] - sums[first]
    low = K.LOWER[data]
    triple = np.zeros(len(data), bool)
    triple[: max(len(data) - 2, 0)] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & _LETTERS[data[2:]] & (data[2:] < 0x80)
    sums = count(triple)
    repeated = sums[np.maximum(last - 2, first)] > sums[first]
    odd = (letters > 0) & ((signs > 0) | (inner > np.minimum(apostrophe, 1)) | repeated)
    # Letters of several bytes, three times over.
    sums = count(data >= 0xC0)
    for k in np.flatnonzero(~odd & (sums[last] - sums[first] >= 3)).tolist():
        odd[k] = _TRIPLE.search(data[first[k] : last[k]].tobytes().decode("utf-8", "replace")) is not None
    # Without a letter: three signs or more, of two kinds, that are no number.
    sums = count(marks)
    for k in np.flatnonzero((letters == 0) & (signs >= 3) & (sums[last] - sums[first] > 0)).tolist():
        token = data[first[k] : last[k]].tobytes()
        odd[k] = inner[k] == 0 and len(set(token)) > 1 and _NUMBER.fullmatch(token.decode()) is None
    # Runs of three or more tokens of one letter or sign within a document, of which two and two in five are letters.
    sums = count((data & 0xC0) != 0x80)
    single = (sums[last] - sums[first] == 1) & ((letters > 0) | (signs > 0))
    joined = np.zeros(len(single), bool)
    joined[1:] = single[1:] & single[:-1] & (doc[1:] == doc[:-1])
    begins = np.flatnonzero(single & ~joined)
    stops = np.flatnonzero(single & ~np.append(joined[1:], False))
    sums = count(single & (letters > 0))
    n = sums[stops + 1] - sums[begins]
    runs = (stops - begins >= 2) & (n >= 2) & (5 * n >= 2 * (stops - begins + 1))
    out = [(int(first[a]), int(last[b]), True) for a, b in zip(begins[runs], stops[runs])]
    out += [(int(first[k]), int(last[k]), False) for k in np.flatnonzero(odd & ~single)]
    return sorted(out)


class Restorer:
    """Texts with their suspicious tokens decoded; readings of short tokens are remembered up to a bound."""

    LONGEST = 64

    def __init__(self, model: LetterModel):
        self.model, self.known = model, {}

    def reading(self, token: str, spaced: bool) -> str:
        key = token if not spaced else "".join(c for t in token.split() for c in t if c.isalnum() or t in LOOKS_LIKE)
        found = self.known.get(key)
        if found is None:
            found = decode(key, self.model)
            if len(key) <= self.LONGEST:
                if len(self.known) >= MOST_KNOWN:
                    self.known.clear()
                self.known[key] = found
        return found

    def restore(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The batch restored, each document followed by a line end."""
        raw, pieces, ends, at, done = data.tobytes(), [], [0], 0, 0
        found = suspects(data, offs)
        k = 0
        for d in range(len(offs) - 1):
            past = int(offs[d + 1])
            while k < len(found) and found[k][0] < past:
                start, end, spaced = found[k]
                k += 1
                if start < at:
                    continue
                piece = raw[at:start] + self.reading(raw[start:end].decode("utf-8", "replace"), spaced).encode()
                pieces.append(piece)
                done += len(piece)
                at = end
            pieces.append(raw[at:past])
            pieces.append(b"\n")
            done += past - at + 1
            at = past
            ends.append(done)
        return np.frombuffer(b"".join(pieces), np.uint8), np.array(ends, np.int64)


def restored_texts(docs: DataFrame, letters: LetterModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of every row of docs and `restored`: the text with its suspicious tokens decoded; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(letters)
    own = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("text_of_document"))

    def run(batches):
        restorer = Restorer(shared.value)
        for batch in batches:
            column, out = batch.column(batch.num_columns - 1), []
            for _, _, data, offs in K.text_batches(column):
                made, at = restorer.restore(data, offs)
                raw = made.tobytes()
                out += [raw[a : b - 1].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            kept = pc.if_else(pc.is_valid(column), pa.array(out, pa.string()), None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], kept], names=[*batch.schema.names[:-1], "restored"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema.fields[:-1])
    return mapped(own, run, f"{schema}restored string")


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, documents) of words and of five-byte pieces of words, edges included, in restored texts."""
    starts, ends, at = K.spans(data, offs, K.ALNUM)
    words = K.word_hashes(data, starts, ends)
    plain = np.where(K.ALNUM[data], K.LOWER[data], np.uint8(0x20))
    wide = plain.astype(np.uint64)
    n = max(len(data) - 4, 0)
    gram = np.zeros(n, np.uint64)
    for j in range(5):
        gram = (gram << np.uint64(8)) | wide[j : n + j]
    inside = plain != 0x20
    kept = inside[1 : n + 1] & inside[2 : n + 2] & inside[3 : n + 3]
    where = np.flatnonzero(kept)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    # A piece of two documents cannot be: a line end, which reads as a blank, parts them.
    return np.concatenate([words, K.mix(gram[where])]), np.concatenate([owner, np.searchsorted(offs, where + 1, side="right") - 1])


@dataclass
class ToxicModel:
    """Feature hashes in order, their weights, and the intercept."""

    letters: LetterModel
    keys: np.ndarray
    weights: np.ndarray
    intercept: float

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, features): which features each restored document has, each once."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes, docs = pieces(data, offs)
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(44)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        is_ = self.keys[i] == hashes[maybe]
        pairs = np.unique(docs[maybe[is_]] * len(self.keys) + i[is_])
        return pairs // len(self.keys), pairs % len(self.keys)

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        docs, features = self.hits(data, offs)
        z = np.bincount(docs, self.weights[features], minlength=len(offs) - 1) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression with both labels weighed as in the whole: weights, none below 0, and the intercept.

    Newton's method; features whose weight comes out below 0 leave, and the rest is fitted again.
    """
    n1, n0 = max(int((y == 1).sum()), 1), max(int((y == 0).sum()), 1)
    weight = np.where(y == 1, share / n1, (1 - share) / n0)
    used = np.arange(x.shape[1])
    while True:
        z = np.concatenate([x[:, used].astype(float), np.ones((len(x), 1))], 1)
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-9
        w = np.zeros(z.shape[1])
        w[-1] = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            curve = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
            step = np.linalg.solve(curve, z.T @ (weight * (p - y)) + penalty * w)
            w -= np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-4:
                break
        if (w[:-1] >= 0).all():
            break
        used = used[w[:-1] > 0]
    out = np.zeros(x.shape[1])
    out[used] = w[:-1]
    return out, float(w[-1])


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, held: int = 0, most_rows: int = MOST_ROWS) -> ToxicModel:
    """A model from rows whose fold is not `held`, at most about most_rows of each label, chosen by a hash of doc_id.

    Labels other than 0 and 1, null ids and null texts are left out. Without both labels no feature is chosen, and every
    score is the share of label 1 (0 if there are no labels).
    """
    spark = docs.sparkSession
    letters = train_letters(docs)
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").distinct()
    known = known.where(fold(F.col("doc_id"), parts) != held)
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        share = n1 / max(n0 + n1, 1)
        return ToxicModel(letters, np.zeros(0, np.uint64), np.zeros(0), math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    chance = F.when(F.col("label") == 1, most_rows / n1).otherwise(most_rows / n0)
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < chance * (1 << 30))
    # The sample is bounded by most_rows of each label, so it can be sent to every executor.
    rows = materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).join(F.broadcast(sample), "doc_id").where("text is not null").select("doc_id", "label", "text"), "toxicity-sample")
    shared = spark.sparkContext.broadcast(letters)

    def counted(batches):
        restorer = Restorer(shared.value)
        for batch in batches:
            label_of = batch.column(1).to_numpy(zero_copy_only=False)
            found = []
            for lo, _, data, offs in K.text_batches(batch.column(2)):
                hashes, owner = pieces(*restorer.restore(data, offs))
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                new = np.ones(len(hashes), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                found.append((hashes[new], label_of[lo + owner[new]]))
            if not found:
                continue
            hashes, label = map(np.concatenate, zip(*found))
            keys, index = np.unique(hashes, return_inverse=True)
            yes = np.bincount(index, label, minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(yes), pa.array(np.bincount(index, minlength=len(keys)) - yes)], names=["feature", "yes", "no"])

    df = mapped(rows, counted, "feature bigint, yes bigint, no bigint").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    m1, m0 = min(n1, most_rows), min(n0, most_rows)
    p, q = (F.col("yes") + 0.5) / (m1 + 1.0), (F.col("no") + 0.5) / (m0 + 1.0)
    odds = F.log(p / (1 - p + 1e-9)) - F.log(q / (1 - q + 1e-9))
    z = odds / F.sqrt(1 / (F.col("yes") + 0.5) + 1 / (F.col("no") + 0.5))
    least = min(LEAST, max(1, m1 // 20))
    best = df.where(F.col("yes") >= least).withColumn("z", z).where((odds > 2.0) & (F.col("z") > 3.0)).orderBy(F.desc("z"), "feature").limit(FEATURES).select("feature").toPandas()
    keys = np.sort(best["feature"].to_numpy(np.int64).view(np.uint64))
    model = ToxicModel(letters, keys, np.ones(len(keys)), 0.0)
    untrained = spark.sparkContext.broadcast(model)

    def met(batches):
        own = untrained.value
        restorer = Restorer(own.letters)
        for batch in batches:
            for lo, hi, data, offs in K.text_batches(batch.column(2)):
                owner, features = own.hits(*restorer.restore(data, offs))
                at = np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(features.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), lists], names=["doc_id", "label", "features"])

    table = mapped(rows, met, "doc_id bigint, label int, features array<int>").toPandas()
    # Rows of one id are told apart by their features, so the sums don't depend on the order they came in.
    table = table.assign(key=[tuple(f) for f in table["features"]]).sort_values(["doc_id", "label", "key"], kind="stable")
    x = np.zeros((len(table), len(keys)), np.float32)
    for i, f in enumerate(table["features"]):
        x[i, f] = 1.0
    w, b = _fit(x, table["label"].to_numpy(np.float64), n1 / (n0 + n1))
    return ToxicModel(letters, keys, w, b)


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, held: int = 0, most_rows: int = MOST_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (1 from a score of 0.5 on).

    A null or empty text has no features and gets the score of such texts; repeated rows are each scored; a null doc_id is
    scored and never learned from. Other columns of docs play no part.
    """
    model = docs.sparkSession.sparkContext.broadcast(train_toxicity(docs, labels, label, parts, held, most_rows))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))

    def run(batches):
        restorer = Restorer(model.value.letters)
        for batch in batches:
            scores = [model.value.score(*restorer.restore(data, offs)) for _, _, data, offs in K.text_batches(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "score"])

    scored = mapped(own, run, "doc_id bigint, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
