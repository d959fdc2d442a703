"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Training sees trusted positives (rows labelled 1) and unlabelled texts: a sample of the whole table, mostly documents
without any label, as they come; a label that one of them has is not looked at. With class prior p, loss l and scorer f
the risk is p * E_pos[l(f)] + max(0, E_unl[l(-f)] - p * E_pos[l(-f)]); where the second part turns negative, the
gradient step goes the other way on it. The class prior is estimated from scores (``class_prior``), so labels with value
0 are not needed. The scorer is a small network on counts of the text alone (letters, marks, word shapes, repeats).

Sampling: the fit uses at most ``MAX_FIT`` positives and ``MAX_FIT`` unlabelled rows, those of smallest hash, by
thresholds from counts of all; all else covers every row. The fitted network has a fixed size; scoring is map-only.

Assumed, as by the method: the positives are drawn from all good texts alike. Good texts of a kind that has no positives
(a language, say) count as bad.

Held-out rows are those with crc32(doc_id as text) mod 4 = 2; their labels are never read, and they are in no sample.

Defined cases: null and empty texts are scored as texts without words; null ids are scored and not held out; repeated
rows and labels do no harm; a long text's counts are added up over pieces, so it takes no more memory than others; without positives of learnable folds every text scores 0.5; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.text_arrays import PIECE, Words, buffers, lengths, pieces, releasing, slices

MAX_FIT = 20_000
THRESHOLD = 0.7
FOLDS, HELD = 4, 2
N_FEATURES, N_SUMS = 21, 19
HIDDEN = 12
STEPS = 400
PRIOR_STEPS = 200

_KINDS = np.zeros((256, 8), bool)
_KINDS[97:123, 0] = _KINDS[65:91, 0] = True  # letters
_KINDS[128:, 1] = True  # bytes of other scripts and accents
_KINDS[48:58, 2] = True  # digits
_KINDS[65:91, 3] = True  # capitals
_KINDS[[ord(c) for c in ".,;:!?"], 4] = True
_KINDS[[ord(c) for c in "#*$%&|<>"], 5] = True
_KINDS[[ord(c) for c in "()[]{}\"'-_/\\@=+~^`"], 6] = True
_KINDS[10, 7] = True  # line feeds


def features(column: pa.Array) -> np.ndarray:
    """A row of N_FEATURES numbers for each text; a single long text goes through in pieces."""
    if len(column) == 1 and lengths(column)[0] > 2 * PIECE:
        return _shares(_long_sums(buffers(column)[0])[None, :])
    return _shares(_sums(Words(column)))


def _sums(w: Words) -> np.ndarray:
    """For each text: bytes of each kind, bytes, words, words that are marked, bare, repeated at once, short, long, very long, their lengths and squares, and distinct words."""
    size, n = np.diff(w.texts), np.diff(w.first)

    def per_text(values, at):  # sums over each text's share of values
        sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return sums[at[1:]] - sums[at[:-1]]

    kinds = [per_text(_KINDS[w.raw, k], w.texts) for k in range(8)]
    length = w.end - w.begin
    owner = np.repeat(np.arange(len(size)), n)
    marks = np.concatenate([[0], np.cumsum(_KINDS[w.raw, 5])])
    letters = np.concatenate([[0], np.cumsum(_KINDS[w.raw, 0] | _KINDS[w.raw, 1])])
    marked = (marks[w.end] - marks[w.begin]) > 0
    bare = (letters[w.end] - letters[w.begin]) == 0
    again = np.zeros(len(length), bool)
    if len(length) > 1:
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((w.hash, owner))
    fresh = np.ones(len(length), bool)
    if len(length) > 1:
        fresh[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][fresh], minlength=len(n)) if len(length) else np.zeros(len(n))
    words = [per_text(x, w.first) for x in (marked, bare, again, length <= 3, length >= 10, length >= 25, length, length.astype(float) ** 2)]
    return np.column_stack([*kinds, size, n, *words, distinct]).astype(np.float64)


def _long_sums(raw: np.ndarray) -> np.ndarray:
    total, seen, last = np.zeros(N_SUMS), [], None
    for w in pieces(raw):
        total += _sums(w)[0]
        if len(w.hash):
            total[12] += last is not None and w.hash[0] == last  # a word repeated across the cut
            last = w.hash[-1]
            seen.append(np.unique(w.hash))
    total[N_SUMS - 1] = len(np.unique(np.concatenate(seen))) if seen else 0
    return total


def _shares(s: np.ndarray) -> np.ndarray:
    size, n, distinct = s[:, 8], s[:, 9], s[:, N_SUMS - 1]
    many = np.maximum(n, 1)
    kinds, shares = s[:, :8] / np.maximum(size, 1)[:, None], s[:, 10:16] / many[:, None]
    mean = s[:, 16] / many
    spread = np.sqrt(np.maximum(s[:, 17] / many - mean**2, 0))
    return np.column_stack([kinds, shares, np.log1p(n), np.log1p(size), mean, spread, distinct / many, np.log1p(distinct) / np.log1p(many), 1.0 * (n < 10)])


class Scorer:
    """A network with one hidden layer on standardised features."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    def logits(self, x: np.ndarray) -> np.ndarray:
        return _forward(np.clip((x - self.mean) / self.scale, -8, 8), self.weights)[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _forward(x, weights):
    w1, b1, w2, b2 = weights
    h = np.tanh(x @ w1 + b1)
    return h @ w2 + b2, h


def fit(x: np.ndarray, positive: np.ndarray, hidden: np.ndarray, prior: float | None, steps: int = STEPS, seed: int = 7) -> Scorer:
    """x: features; positive: which rows are trusted positives; hidden: which are in the unlabelled sample (a row can be both).

    Without a prior the scorer tells positives from unlabelled rows, both of equal weight.
    """
    mean, scale = x[hidden].mean(0), x[hidden].std(0) + 1e-9
    z = np.clip((x - mean) / scale, -8, 8)
    gain, part = (1.0, 0.0) if prior is None else (prior, prior)
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, 0.3, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    n, m = max(1, hidden.sum()), max(1, positive.sum())
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
    for step in range(1, steps + 1):
        out, h = _forward(z, weights)
        soft = np.logaddexp(0, out)  # loss as a negative
        p = sigmoid(out)
        negative_risk = soft[hidden].mean() - part * soft[positive].mean()
        grad_pos, grad_neg = np.zeros(len(z)), np.where(hidden, p / n, 0.0)
        grad_pos[positive] = gain * (p[positive] - 1) / m
        grad_neg[positive] -= part * p[positive] / m
        grad = grad_pos + grad_neg if negative_risk >= 0 else -grad_neg
        back = np.outer(grad, weights[2]) * (1 - h**2)
        grads = [z.T @ back + 1e-4 * weights[0], back.sum(0), h.T @ grad + 1e-4 * weights[2], np.array([grad.sum()])]
        rate = 0.02 * (0.1 + 0.9 * (1 - step / steps))
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
    return Scorer(mean, scale, weights)


def class_prior(x: np.ndarray, positive: np.ndarray, hidden: np.ndarray, half: np.ndarray) -> float:
    """The share of positives among the hidden rows, by scores on the half that the scorer has not seen, both halves in turn.

    Above a score that only positives reach, the share of hidden rows over the share of positives is the prior; the
    score is the one where that ratio, with the sampling error of both shares, is least.
    """
    found = []
    for seen in (half, ~half):
        if not ((positive & seen).any() and (positive & ~seen).any() and (hidden & seen).any() and (hidden & ~seen).any()):
            continue
        scorer = fit(x[seen], positive[seen], hidden[seen], None, PRIOR_STEPS)
        good, all_rows = np.sort(scorer.logits(x[positive & ~seen])), np.sort(scorer.logits(x[hidden & ~seen]))
        of_good = 1 - np.arange(len(good)) / len(good)  # share of the positives at or above each of them
        of_all = 1 - np.searchsorted(all_rows, good) / len(all_rows)
        error = np.sqrt(np.log(40) / (2 * len(good))) + np.sqrt(np.log(40) / (2 * len(all_rows)))
        at = np.argmin((of_all + error) / of_good)
        found.append(of_all[at] / of_good[at])
    return float(np.clip(np.mean(found), 0.001, 0.999)) if found else 0.5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD, F.lit(False))


_FEATURES = "draw long, positive boolean, hidden boolean, x array<double>"
_MARKS = ["draw", "positive", "hidden"]


def _featured(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a, b in slices(lengths(batch.column("text")), PIECE):
                part = batch.slice(a, b - a)
                x = features(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_FEATURES, pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in _MARKS], lists], [*_MARKS, "x"])

    return docs.mapInArrow(releasing(run), _FEATURES)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_fit: int = MAX_FIT) -> Scorer | None:
    """Fits on positives of the learnable folds and unlabelled documents, about max_fit of each at most; None if there are no positives.

    Labels count only where docs has their document, so both samples and their rates are of the table given.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("doc"))
    open_rows = (
        labels.select(F.col(doc_id).cast("long").alias("doc"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc")))
        .groupBy("doc")
        .agg(F.max("y").alias("y"))
        .where("y = 1")
        .join(given, "doc", "left_semi")
    )
    n_positives = open_rows.count()
    if not n_positives:
        return None
    n_docs = docs.where(~held_out(F.col(doc_id))).count()
    share = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "draw"), F.lit(1_000_000)) < 1_000_000 * 0.95 * max_fit / max(n, 1)
    draw = F.xxhash64(F.lit("fit"), F.coalesce(F.col("doc"), F.xxhash64("text")))
    chosen = open_rows.withColumn("draw", F.xxhash64(F.lit("fit"), "doc")).where(share("positive", n_positives)).select("doc", F.lit(True).alias("positive"))  # at most about max_fit rows, which the driver and tasks can hold
    rows = (
        docs.select(F.col(doc_id).cast("long").alias("doc"), held_out(F.col(doc_id)).alias("held"), F.col(text).alias("text"))
        .withColumn("draw", draw)
        .withColumn("hidden", ~F.col("held") & share("hidden", n_docs))
        .join(F.broadcast(chosen), "doc", "left")
        .withColumn("positive", F.coalesce("positive", F.lit(False)))
        .where("positive or hidden")
        .select(*_MARKS, "text")
    )
    found = _featured(rows).toArrow()  # about max_fit rows of each kind
    x = np.asarray(found.column("x").combine_chunks().flatten()).reshape(-1, N_FEATURES)
    draw, positive, hidden = (found.column(c).to_numpy(zero_copy_only=False) for c in _MARKS) if len(found) else (np.zeros(0),) * 3
    if not positive.any():
        return None
    order = np.lexsort([*x.T, draw])  # the same on any cluster
    x, positive, hidden, half = x[order], positive[order].astype(bool), hidden[order].astype(bool), draw[order] % 2 == 0
    if not hidden.any():
        hidden = positive
    return fit(x, positive, hidden, class_prior(x, positive, hidden, half))


def score(docs: DataFrame, scorer: Scorer | None, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""

    def run(batches):
        for batch in batches:
            for a, b in slices(lengths(batch.column("text")), PIECE):
                part = batch.slice(a, b - a)
                values = scorer.scores(features(part.column("text"))) if scorer else np.full(b - a, 0.5)
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("held"), pa.array(values), pa.array((values >= threshold).astype(np.int32))], [doc_id, "held_out", "score", "predicted"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc"), held_out(F.col(doc_id)).alias("held"), F.col(text).alias("text"))
    return narrow.mapInArrow(releasing(run), f"{doc_id} long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, scorer: Scorer | None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The documents that score at least the threshold (all, if nothing could be learned), with all their columns."""
    if scorer is None:
        return docs

    def run(batches):
        for batch in batches:
            for a, b in slices(lengths(batch.column(names.index(text))), PIECE):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(scorer.scores(features(part.column(names.index(text)))) >= threshold))

    names = docs.columns
    return docs.mapInArrow(releasing(run), docs.schema)
