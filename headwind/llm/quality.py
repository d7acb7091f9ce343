"""Quality classifier by Bradley-Terry pairwise ranking.

A document's score is a linear function of features of its text. Pairs of a preferred and a rejected document are drawn
from labelled rows, and the weights are learned by logistic loss on the difference of their features, so only the order
of scores matters. The threshold is the score quantile at the share of rejected documents among the labelled ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwind.llm import kernel as K
from headwind.llm.folds import bounded_sample, fold
from headwind.llm.workers import mapped
from headwind.session import give_back

#: Labelled rows to learn from at most, pairs drawn from them, and the weight of the squared weights.
MOST_ROWS, PAIRS, RIDGE, SEED = 50_000, 200_000, 1e-3, 11

FEATURES = (
    "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "bang_share", "bar_share", "mark_share",
    "line_share", "same_as_last", "same_as_near", "capital_words", "marked_words", "non_ascii_share", "long_words", "no_words",
)
_SETS = {
    "upper": K._class(bytes(range(0x41, 0x5B))),
    "digit": K._class(b"0123456789"),
    "symbol": K._class(b"#$%&*<>{}[]@^~=+\\/_"),
    "bang": K._class(b"!?"),
    "bar": K._class(b"|"),
    "mark": K._class(b".,;:'\"-()"),
    "line": K._class(b"\n"),
    "wide": K._class(bytes(range(0x80, 0x100))),
    "letter": K._class(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])),
}


def text_features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each document; all 0 but no_words for a text without words."""
    n = np.diff(offs)
    starts, ends, at = K.spans(data, offs, K.VISIBLE)
    words = np.diff(at)
    hashes = K.word_hashes(data, starts, ends)
    position, _ = K.place(at)
    counts = {}
    for name, table in _SETS.items():
        sums = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
        np.cumsum(table[data], out=sums[1:])
        counts[name] = (sums[offs[1:]] - sums[offs[:-1]]).astype(float)
        if name in ("upper", "letter"):
            counts[f"word_{name}"] = sums[ends] - sums[starts]
    last = np.zeros(len(hashes), bool)
    near = np.zeros(len(hashes), bool)
    for d in range(1, 9):
        same = np.zeros(len(hashes), bool)
        same[d:] = (hashes[d:] == hashes[:-d]) & (position[d:] >= d)
        near |= same
        if d == 1:
            last |= same
    upper = (counts["word_upper"] == counts["word_letter"]) & (counts["word_letter"] > 1)
    plain = K.ALNUM[data]
    marked = np.zeros(len(starts), bool)
    if len(starts):
        tail = data[ends - 1]
        marked = ~plain[ends - 1] & (tail != 0x2E) & (tail != 0x2C)
    long_ = ends - starts > 30
    total, n_words, letters = np.maximum(n, 1), np.maximum(words, 1), np.maximum(counts["letter"], 1)
    share = lambda flags: K.segment_sum(flags.astype(np.int64), at) / n_words
    columns = [
        np.log1p(words), (n - counts["wide"] / 2) / n_words, counts["upper"] / letters, counts["digit"] / total, counts["symbol"] / total, counts["bang"] / total, counts["bar"] / total,
        counts["mark"] / total, counts["line"] / n_words, share(last), share(near), share(upper), share(marked), counts["wide"] / total, share(long_), (words == 0).astype(float),
    ]
    out = np.stack(columns, 1)
    out[:, 1] = np.minimum(out[:, 1], 100.0)
    out[words == 0, :-1] = 0.0
    return out


@dataclass
class PairwiseModel:
    """score = w . standardised features; a document is good from threshold on."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def spread(self, x: np.ndarray) -> np.ndarray:
        """Features and their square roots, standardised: rare marks count from the first on."""
        wide = np.concatenate([x, np.sqrt(np.abs(x))], 1)
        return np.clip((wide - self.mean) / self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        """In 0..1, and 0.5 or more where the ranking score reaches the threshold.

        The weighted features are added column by column, so a row's score does not depend on the rows beside it, as it
        does where a matrix product chooses its order of summation by their number.
        """
        spread, z = self.spread(x), np.zeros(len(x))
        for j, w in enumerate(self.weights.tolist()):
            z += spread[:, j] * w
        return 1 / (1 + np.exp(-np.clip(self.slope * (z - self.threshold), -30, 30)))


def train_pairwise(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = SEED) -> PairwiseModel:
    """Learn from features and labels 1 (preferred) and 0; with one label alone, every score is on that label's side."""
    wide = np.concatenate([x, np.sqrt(np.abs(x))], 1) if len(x) else np.zeros((0, 2 * len(FEATURES)))
    mean = wide.mean(0) if len(x) else np.zeros(wide.shape[1])
    scale = wide.std(0) if len(x) else np.ones(wide.shape[1])
    model = PairwiseModel(mean, np.where(scale > 1e-12, scale, 1.0), np.zeros(wide.shape[1]), 0.0, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        model.threshold = 1.0 if len(bad) else -1.0
        return model
    z, rng = model.spread(x), np.random.default_rng(seed)
    diff = z[rng.choice(good, pairs)]
    diff -= z[rng.choice(bad, pairs)]  # in place: the pairs are the most that the driver's Python holds
    w = np.zeros(z.shape[1])
    for _ in range(30):  # Newton's method
        chance = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        gradient = diff.T @ (chance - 1) / pairs + ridge * w
        curve = (diff * (chance * (1 - chance))[:, None]).T @ diff / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    s = np.sort(z @ w)
    # The quantile at the share of rejected documents, halfway to the next score.
    model.threshold = float(s[len(bad) - 1] + s[len(bad)]) / 2
    margin = (z @ w - model.threshold) * np.where(y == 1, 1, -1)
    slopes = np.geomspace(0.05, 20, 60)
    model.slope = float(slopes[np.argmin([np.logaddexp(0, -np.clip(a * margin, -30, 30)).mean() for a in slopes])])
    return model


def feature_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, features array<double>) of every row of docs."""

    def run(batches):
        for batch in batches:
            parts = [text_features(data, offs) for _, _, data, offs in K.text_batches(batch.column(1))]
            x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "features"])

    own = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return mapped(own, run, "doc_id bigint, features array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 3, held: int = 1, most_rows: int = MOST_ROWS, doc_id: str = "doc_id", text: str = "text") -> PairwiseModel:
    """A model from rows whose fold is not `held`; at most about most_rows of them, chosen by a hash of doc_id.

    Labels other than 0 and 1, null ids and ids without a document are left out; an id with both labels counts as both, and
    rows of one id count once for each set of features that they have. Features are computed of the labelled rows alone: their ids, of which there
    are about most_rows at most, are sent to the documents. Null and empty texts have the features of no words.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").distinct()
    known = bounded_sample(known.where(fold(F.col("doc_id"), parts) != held), most_rows, F.col("doc_id"))
    ids = known.groupBy("doc_id").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    own = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    labelled = own.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")
    rows = feature_table(labelled).distinct().toPandas().merge(ids.toPandas(), on="doc_id")
    x = np.array(rows["features"].tolist(), float).reshape(-1, len(FEATURES))
    both = (rows["least"] != rows["most"]).to_numpy()
    # Rows of one id are told apart by their features, so that the drawn pairs don't depend on the order they came in.
    x = np.concatenate([x, x[both]])
    y = np.concatenate([rows["most"].to_numpy(np.int64), np.zeros(int(both.sum()), np.int64)])
    at = np.concatenate([rows["doc_id"].to_numpy(np.int64), rows["doc_id"].to_numpy(np.int64)[both]])
    order = np.lexsort((*x.T[::-1], y, at))
    give_back(docs.sparkSession)
    return train_pairwise(x[order], y[order])


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 3, held: int = 1, most_rows: int = MOST_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (1 from a score of 0.5 on).

    A null or empty text has the features of no words and is scored as any other; repeated rows are each scored, alike; a
    null doc_id is scored and never learned from. Without labelled rows of both kinds every score is 0.5 or more, unless
    all are rejected. Other columns of docs play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, label, parts, held, most_rows))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), shared.value), pa.float64())], names=["doc_id", "score"])

    scored = mapped(own, run, "doc_id bigint, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _scores(texts: pa.Array, model: PairwiseModel) -> np.ndarray:
    parts = [model.score(text_features(data, offs)) for _, _, data, offs in K.text_batches(texts)]
    return np.concatenate(parts) if parts else np.zeros(0)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the documents whose score is below 0.5, with the columns of docs.

    These are the rows that quality_scores() predicts to be 1. A null or empty text is judged by the features of no words;
    repeated rows stay or go together, as do rows alike in text whatever their doc_id; a null doc_id is judged by its text;
    without labels every row stays; an empty table gives no rows. options are those of fit_quality().
    """
    model = fit_quality(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches):
        for batch in batches:
            good = _scores(batch.column(0).field("text"), shared.value) >= 0.5
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["row"]).filter(pa.array(good))

    return mapped(nested, run, f"row {nested.schema['row'].dataType.simpleString()}").select("row.*")
