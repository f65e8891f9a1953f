"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; unlabelled are all documents of the learning folds. With the logistic loss
l, class prior p and a linear score f, the unbiased risk is

    p * mean_P l(f) + max(0, mean_U l(-f) - p * mean_P l(-f))

whose second part, the risk of the negatives, can not be negative. It is minimised by Newton steps; where a step would
make the second part negative, that part is raised again by a step up its own gradient and fitting ends. The class prior
comes from the same two sets: the smallest ratio, over score levels z, of the shares of unlabelled and of positive
documents scoring at least z, with a bound for the sampling error (best bin estimation) on the scores of a first fit.

Features come from the text alone: shares of kinds of characters, words, repeated words and lines. Sums for each step are
made where the rows are, added up in ``SLOTS`` groups, and only those partial sums reach the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotyard.session import hand_over

THRESHOLD = 0.3
FIRST_PRIOR = 0.5
STEPS, RIDGE, SLOTS, BINS = 12, 1e-3, 16, 400
FEATURES = "doc_id long, held_out boolean, features binary"

_KINDS = np.zeros(256, dtype=np.int64)  # bytes by kind: 0 others
for _kind, _chars in enumerate(
    ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!", "?", "|", "#", "*", "$", "%", "&", "<>", "'\"", "()[]{}", ":;", "/\\", "-_", "@=+~^`"), 1
):
    _KINDS[list(_chars.encode())] = _kind
_KINDS[128:] = _KINDS.max() + 1
_N_KINDS = int(_KINDS.max()) + 1
SHARES = _N_KINDS + 9
WIDTH = 1 + 2 * SHARES + 4  # bias, shares and their square roots, sizes


def text_features(text: str | None) -> np.ndarray:
    """Features of a whole text; an empty or null one has only the bias."""
    out = np.zeros(WIDTH, dtype=np.float32)
    out[0] = 1.0
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    shares = np.zeros(SHARES)
    kinds = np.bincount(raw, minlength=256)
    shares[:_N_KINDS] = np.bincount(_KINDS, weights=kinds, minlength=_N_KINDS) / len(raw)
    words = text.split()
    n = len(words)
    if n:
        counts = Counter(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        pairs = len(set(zip(words, words[1:], strict=False)))
        shares[_N_KINDS :][:6] = (
            len(counts) / n,
            max(counts.values()) / n,
            pairs / max(1, n - 1),
            sum(map(str.isupper, counts)) / len(counts),
            float(np.mean(lengths <= 2)),
            float(np.mean(lengths >= 12)),
        )
        out[-4:-2] = math.log1p(n), math.log1p(float(lengths.mean()))
    lines = text.split("\n")
    shares[_N_KINDS + 6 :] = (len(set(lines)) / len(lines), min(1.0, len(lines) / max(1, n)), sum(not x.strip() for x in lines) / len(lines))
    p = kinds[kinds > 0] / len(raw)
    out[-2:] = math.log1p(len(raw) / len(lines)), float(-(p * np.log(p)).sum())
    out[1 : 1 + SHARES] = shares
    out[1 + SHARES : 1 + 2 * SHARES] = np.sqrt(shares)
    return out


def featurize(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out`` and the features of every document; ``doc_id`` and ``text`` are read, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = [text_features(x.as_py()).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(features, pa.binary())], names=["doc_id", "held_out", "features"])

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return docs.mapInArrow(run, FEATURES)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, WIDTH).astype(np.float64)


def _sums(rows: DataFrame, part) -> np.ndarray:
    """Sum over all rows of ``part(features, is positive)``, a vector; rows are added up in tasks, then in slots."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                value = part(_matrix(batch.column(0)), np.asarray(batch.column(1).to_pylist(), dtype=bool))
                total = value if total is None else total + value
        if total is not None:
            from pyspark import TaskContext

            slot = TaskContext.get().partitionId() % SLOTS
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "sums"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype=np.float64) for x in pdf["sums"])
        return pd.DataFrame({"sums": [total.tobytes()]})

    partial = rows.select("features", "positive").mapInArrow(local, "slot int, sums binary")
    found = partial.groupBy("slot").applyInPandas(merge, "sums binary").collect()  # at most SLOTS rows
    return sum((np.frombuffer(bytes(r.sums), dtype=np.float64) for r in found), np.zeros(1))


class Model:
    """Standardised linear score."""

    def __init__(self, center: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.center, self.scale, self.weights = center, scale, weights

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.center) / self.scale) @ self.weights, -30, 30)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _fit(rows: DataFrame, center: np.ndarray, scale: np.ndarray, n_pos: float, n_all: float, prior: float) -> Model:
    model = Model(center, scale, np.zeros(WIDTH))
    ridge = np.full(WIDTH, RIDGE)
    ridge[0] = 0.0

    def part(x: np.ndarray, pos: np.ndarray) -> np.ndarray:
        z, f = (x - center) / scale, model.margin(x)
        s, soft = 1 / (1 + np.exp(-f)), np.logaddexp(0, f)
        hessian = (z * (s * (1 - s))[:, None]).T @ z
        return np.concatenate([z[pos].sum(0), z[pos].T @ s[pos], z.T @ s, [soft[pos].sum(), (soft - f)[pos].sum(), soft.sum()], hessian.ravel()])

    w = WIDTH
    for _ in range(STEPS):
        v = _sums(rows, part)
        mean_pos, up_pos, up_all = v[:w] / n_pos, v[w : 2 * w] / n_pos, v[2 * w : 3 * w] / n_all
        loss_neg_pos, loss_neg_all = v[3 * w] / n_pos, v[3 * w + 2] / n_all
        if loss_neg_all - prior * loss_neg_pos < 0:
            model.weights = model.weights + 0.1 * (up_all - prior * up_pos)
            break
        gradient = up_all - prior * mean_pos + ridge * model.weights
        hessian = v[3 * w + 3 :].reshape(w, w) / n_all + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        size = float(np.abs(step).max())
        model.weights = model.weights - step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-4:
            break
    return model


def estimate_prior(rows: DataFrame, model: Model, n_pos: float, n_all: float) -> float:
    """Best bin estimate of the share of positives among unlabelled rows from the scores of ``model``."""

    def part(x: np.ndarray, pos: np.ndarray) -> np.ndarray:
        bins = np.minimum((model.score(x) * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(bins[pos], minlength=BINS), np.bincount(bins, minlength=BINS)]).astype(np.float64)

    v = _sums(rows, part)
    pos, every = (np.cumsum(h[::-1])[::-1] for h in (v[:BINS] / n_pos, v[BINS:] / n_all))
    slack = math.sqrt(math.log(40) / (2 * n_pos)) + math.sqrt(math.log(40) / (2 * n_all))
    usable = pos > max(0.05, 2 * slack)
    if not usable.any():  # too few positives to tell
        return FIRST_PRIOR
    ratio = (every[usable] + slack) / pos[usable]
    return float(np.clip(every[usable][ratio.argmin()] / pos[usable][ratio.argmin()], 0.05, 0.98))


def fit(rows: DataFrame) -> Model:
    """Model from ``rows`` with ``features``, ``held_out`` and ``positive`` (trusted). Without learning rows of both kinds the model
    scores everything 0.5."""
    learn = rows.filter("NOT held_out")
    moments = _sums(learn, lambda x, pos: np.concatenate([x.sum(0), (x * x).sum(0), [len(x), pos.sum()]]))
    if len(moments) == 1 or moments[-1] == 0:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH))
    n_all, n_pos = moments[-2:]
    center = moments[:WIDTH] / n_all
    scale = np.sqrt(np.maximum(moments[WIDTH : 2 * WIDTH] / n_all - center**2, 0)) + 1e-6
    center[0], scale[0] = 0.0, 1.0
    first = _fit(learn, center, scale, n_pos, n_all, FIRST_PRIOR)
    prior = estimate_prior(learn, first, n_pos, n_all)
    return _fit(learn, center, scale, n_pos, n_all, prior)


def learning_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Features, fold and trusted label of every document, as a written table."""
    trusted = labels.groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality")).filter("quality = 1")
    labelled = featurize(documents).join(trusted.select("doc_id", F.lit(True).alias("is_one")), "doc_id", "left")
    positive = F.coalesce(F.col("is_one") & ~F.col("held_out"), F.lit(False))
    return hand_over(labelled.select("doc_id", "held_out", "features", positive.alias("positive")), "quality-features")


def keep_quality(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents``, all columns of any name, whose text scores at least ``threshold``. Every row is judged by its own text, so repeated
    rows stay or go together; a null text is an empty one, a null id never has a label. An empty table gives an empty one."""
    model = fit(learning_rows(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                features = np.stack([text_features(x.as_py()) for x in batch.column("text")]).astype(np.float64)
                yield batch.filter(pa.array(model.score(features) >= threshold))

    return documents.mapInArrow(run, documents.schema)


def score_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) of every document; nothing but its text decides a score.

    ``labels`` needs ``doc_id`` and ``quality``; a document is a trusted positive if it has labels and all say 1. Labels of held-out
    rows (crc32 of the id as text divisible by 5) and of null ids are never read into a fit. Repeated rows are each scored.
    """
    rows = learning_rows(documents, labels)
    model = fit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["doc_id", "held_out", "score"])

    return rows.select("doc_id", "held_out", "features").mapInArrow(run, "doc_id long, held_out boolean, score double")
