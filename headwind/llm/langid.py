"""Language identification as inference of a mixture.

Each language has a distribution over hashed letter trigrams, learned from labelled documents. A document is a mixture:
each word comes from one language, and expectation-maximisation estimates the proportions from the words' trigram
likelihoods, until they no longer move. The set of languages grows from the likeliest on, by their shares of the whole
mixture, while likelihood less a penalty for each language rises; it may have any number of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwind.llm import letters as L
from headwind.llm.folds import fold
from headwind.llm.workers import mapped

BITS = 16
#: Added to each trigram's count; the weight of likelihoods (trigrams overlap, so they count less than in full); the
#: largest change of a proportion at which expectation-maximisation ends; the penalty in units of half the logarithm of the words.
SMOOTH, TEMPER, TOLERANCE, PENALTY = 0.5, 0.5, 1e-4, 2.0
#: Languages in a row that may fail to raise the penalised likelihood before no more are tried.
PATIENCE = 2
#: Learned languages at most, so that the table sent to executors stays within 256 MB; more are an error, never left out.
MOST_LEARNED = 1_000
UNKNOWN = "und"

RESULT = "lang_pred string, score double, languages array<string>, proportions array<double>"


@dataclass
class LanguageModel:
    """languages, in order, and the logarithm of each trigram's probability in each."""

    languages: list[str]
    log_p: np.ndarray

    @classmethod
    def of(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
        """counts: for each language the trigrams met and how often."""
        names = sorted(counts)
        table = np.full((1 << BITS, len(names)), SMOOTH)
        for j, name in enumerate(names):
            table[counts[name][0], j] += counts[name][1]
        return cls(names, np.log(table / table.sum(0)).astype(np.float32) if names else np.zeros((1 << BITS, 0), np.float32))

    def word_likelihoods(self, codes: np.ndarray, before: np.ndarray, after: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Likelihoods of words, the best language of each having 1; each document's first word."""
        where, starts, at = L.letter_words(codes, before, offs)
        if not len(starts):
            return np.zeros((0, len(self.languages)), np.float32), at
        log = np.add.reduceat(self.log_p[L.hashed(BITS, before[where], codes[where], after[where])], starts, axis=0)
        log -= log.max(1, keepdims=True)
        return np.exp(np.float32(TEMPER) * log), at

    def infer(self, codes: np.ndarray, before: np.ndarray, after: np.ndarray, offs: np.ndarray) -> list[tuple[str, float, list[str], list[float]]]:
        """For each document: the main language, its score, the chosen set and its proportions, largest first."""
        like, at = self.word_likelihoods(codes, before, after, offs)
        n = np.diff(at)
        out = [(UNKNOWN, 0.0, [], [])] * len(n)
        full = np.flatnonzero(n > 0)
        if not len(full) or not self.languages:
            return out
        n, first = n[full], at[:-1][full]
        counts = n
        owner = np.repeat(np.arange(len(full)), n)
        share = _proportions(like, owner, first, n, np.full((len(full), like.shape[1]), 1 / like.shape[1], np.float32))
        order = np.argsort(-share, axis=1, kind="stable")
        best, chosen, size = np.full(len(full), -np.inf), np.zeros((len(full), like.shape[1])), np.ones(len(full), int)
        live, missed = np.arange(len(full)), np.zeros(len(full), int)
        for k in range(1, chosen.shape[1] + 1):
            top = order[live, :k]
            part = np.take_along_axis(like, top[owner], 1)
            own = np.maximum(np.take_along_axis(share[live], top, 1), 1e-6)
            own /= own.sum(1, keepdims=True)
            if k > 1:
                own = _proportions(part, owner, first, n, own)
            value = np.add.reduceat(np.log(np.maximum((part * own[owner]).sum(1), 1e-30)), first) - PENALTY * 0.5 * (k - 1) * np.log(n + 1)
            better = value > best[live] + 1e-6
            best[live[better]], size[live[better]] = value[better], k
            chosen[live[better], :k] = own[better]
            # A document is done once PATIENCE more languages in a row have not raised its penalised likelihood.
            missed[live] = np.where(better, 0, missed[live] + 1)
            going = missed[live] < PATIENCE
            if not going.all():
                like, live, n = like[going[owner]], live[going], n[going]
                if not len(live):
                    break
                owner, first = np.repeat(np.arange(len(live)), n), np.cumsum(n) - n
        n = counts
        for i, d in enumerate(full.tolist()):
            k = int(size[i])
            rank = np.argsort(-chosen[i, :k], kind="stable")
            names = [self.languages[order[i, r]] for r in rank]
            shares = [float(chosen[i, r]) for r in rank]
            # The proportion over the chosen set, less what so few words leave open.
            out[d] = (names[0], (shares[0] * float(n[i]) + 0.5 / len(self.languages)) / (float(n[i]) + 0.5), names, shares)
        return out


def _proportions(like: np.ndarray, owner: np.ndarray, first: np.ndarray, n: np.ndarray, share: np.ndarray, steps: int | None = None) -> np.ndarray:
    """Expectation-maximisation from share, for all documents at once: so many steps, or each until it moves by TOLERANCE at most."""
    share, live, done = share.astype(np.float32), np.arange(len(n)), 0
    while len(live) and done != steps:
        own = share[live]
        part = like * own[owner]
        part /= np.maximum(part.sum(1, keepdims=True), 1e-30)
        share[live] = np.add.reduceat(part, first, axis=0) / n[:, None].astype(np.float32)
        done += 1
        still = np.abs(share[live] - own).max(1) > TOLERANCE
        if steps is None and not still.all():
            like, live, n = like[still[owner]], live[still], n[still]
            owner, first = np.repeat(np.arange(len(live)), n), np.cumsum(n) - n
    return share


def train(rows: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """A model from all rows with a text and a language. What reaches the driver is one number for each language and trigram.

    ValueError if there are more than MOST_LEARNED languages: labels then need cleaning first, and none is dropped unsaid.
    """

    def run(batches):
        counts: dict[str, np.ndarray] = {}

        def emptied():
            for name, c in counts.items():
                met = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(met), pa.string()), pa.array(met.astype(np.int32)), pa.array(c[met])], names=["lang", "gram", "n"])
            counts.clear()

        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            for lo, hi, codes, before, after, offs in L.word_batches(batch.column(0)):
                where = np.flatnonzero(codes)
                grams = L.hashed(BITS, before[where], codes[where], after[where])
                own = names[lo:hi]
                kinds, index = np.unique(own, return_inverse=True)
                kind_of = index[np.searchsorted(offs, where, side="right") - 1]
                for j, name in enumerate(kinds.tolist()):
                    counts.setdefault(name, np.zeros(1 << BITS, np.int64))
                    counts[name] += np.bincount(grams[kind_of == j], minlength=1 << BITS)
            if len(counts) > 64:
                yield from emptied()
        yield from emptied()

    own = rows.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("text is not null and lang is not null")
    known = own.agg(F.count_distinct("lang")).first()[0]
    if known > MOST_LEARNED:
        raise ValueError(f"{known} languages are more than the {MOST_LEARNED} that one model may hold")
    counted = mapped(own, run, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return LanguageModel.of({name: (g["gram"].to_numpy(), g["n"].to_numpy()) for name, g in counted.groupby("lang")})


def detect_languages(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of every row of docs with lang_pred, score, languages and proportions.

    languages and proportions are the chosen set, largest first; lang_pred is its first, score its proportion, drawn
    towards an even share where words are few. A null text or one without a letter gets `und`, 0 and no languages, and so
    does every text if nothing was learned. Ties go to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("text_of_document"))

    def run(batches):
        for batch in batches:
            rows = [x for _, _, *parts in L.word_batches(batch.column(batch.num_columns - 1)) for x in shared.value.infer(*parts)]
            kinds = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "lang_pred", "score", "languages", "proportions"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return mapped(own, run, f"{schema}, {RESULT}" if schema else RESULT)


def languages_of_documents(docs: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages, proportions of every row of docs, learned from the other folds."""
    model = train(docs.where(fold(F.col("doc_id"), parts) != held))
    found = detect_languages(docs, model)
    return found.withColumn("held_out", fold(F.col("doc_id"), parts) == held).select("doc_id", "held_out", "lang_pred", "score", "languages", "proportions")
