"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Every text becomes a short vector of statistics, each transformed towards a bell shape. Per class, the mean and a
shrunk covariance, ``(1 - a - b) * own + a * pooled + b * (trace / d) * I``, are estimated from the labelled training
rows; their moments are summed on the executors, so the driver only ever holds d x d sums. A score is the sigmoid of the
difference of two log densities, whose Mahalanobis terms come from Cholesky factors that are computed once and cached.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, light, small_batches, written

THRESHOLD = 0.3
_KINDS = np.zeros(256, np.intp)  # 0 other symbol, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 sentence mark, 7 beyond ASCII
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58], _KINDS[[9, 11, 12, 13, 32]], _KINDS[10] = 1, 2, 3, 4, 5
_KINDS[[ord(c) for c in ".,;:'\"-?()"]], _KINDS[128:] = 6, 7
NAMES = (
    "words", "word_bytes", "upper", "digits", "symbols", "marks", "lines", "distinct", "top_word", "repeated_lines", "repeated_fives", "symbol_words", "long_words", "pipes", "doubled"
)


def _logit(part: float, whole: float) -> float:
    """log odds of part in whole, with half a count added to either side."""
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: str) -> np.ndarray:
    """The transformed statistics of one whole text, in the order of NAMES; an empty text has a vector too."""
    raw = text.encode("utf-8", "replace")
    kinds = np.bincount(_KINDS[np.frombuffer(raw, np.uint8)], minlength=8)
    letters = int(kinds[1] + kinds[2] + kinds[7])
    words = raw.lower().split()
    n = len(words)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    # 5-word runs that came before; ids by word, so a run is a few integer operations
    ids = {w: i for i, w in enumerate(counts)}
    x = np.fromiter(map(ids.__getitem__, words), np.uint64, n)
    if n >= 5:
        mix = np.uint64(0x9E3779B97F4A7C15)
        runs = x[: n - 4].copy()
        for k in range(1, 5):
            runs = (runs ^ (runs >> np.uint64(29))) * mix + x[k : n - 4 + k]
        repeated = n - 4 - len(np.unique(runs))
    else:
        repeated = 0
    marked = sum(c for w, c in counts.items() if not w.strip(b".,;:'\"-?()").isalnum() and not max(w) > 127)
    return np.array(
        [
            np.log1p(n),
            np.log1p(len(raw) / (n + 1)),
            _logit(int(kinds[2]), letters),
            _logit(int(kinds[3]), len(raw)),
            _logit(int(kinds[0]), len(raw)),
            _logit(int(kinds[6]), len(raw)),
            np.log((len(lines) + 1) / (n + 1)),
            np.log1p(len(counts)) - 0.8 * np.log1p(n),
            _logit(max(counts.values(), default=0), n),
            _logit(len(lines) - len(set(lines)), len(lines)),
            _logit(repeated, max(n - 4, 0)),
            _logit(marked, n),
            _logit(sum(c for w, c in counts.items() if len(w) > 14), n),
            _logit(raw.count(b"|"), len(raw)),
            _logit(int(np.count_nonzero(x[1:] == x[:-1])), n),
        ]
    )


def document_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` plus ``_x`` (array of double, see NAMES): one row per row of ``docs``; null texts are empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in light(batches, "_text"):
            found = [statistics(t or "") for t in batch.column("_text").to_pylist()]
            at = [batch.schema.get_field_index(c) for c in keep]
            flat = pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(NAMES), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in at], x], [*keep, "_x"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, ", ".join([*kinds, "_x array<double>"]))


@dataclass(frozen=True)
class Discriminant:
    """Means, log determinants, log priors and inverse Cholesky factors of the two classes, ready to score."""

    scale: tuple[np.ndarray, np.ndarray]
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    @staticmethod
    def fit(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, own: float = 0.95, pooled: float = 0.04) -> Discriminant:
        """From the counts, sums and sums of outer products of both classes. A class without rows takes the pooled moments."""
        d = len(NAMES)
        total = n.sum()
        if total < 2:
            return Discriminant((np.zeros(d), np.ones(d)), np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2))
        centre = sums.sum(0) / total
        spread = np.sqrt(np.maximum(np.diag(squares.sum(0)) / total - centre**2, 1e-6))
        means, covs = np.zeros((2, d)), np.zeros((2, d, d))
        z = lambda k, m: (m - np.outer(sums[k], centre) - np.outer(centre, sums[k]) + n[k] * np.outer(centre, centre)) / np.outer(spread, spread)
        for k in (0, 1):
            if n[k]:
                means[k] = (sums[k] / n[k] - centre) / spread
                covs[k] = z(k, squares[k]) / n[k] - np.outer(means[k], means[k])
        within = sum(n[k] * covs[k] for k in (0, 1)) / total
        factors, constants = np.zeros((2, d, d)), np.zeros(2)
        for k in (0, 1):
            mine = covs[k] if n[k] > 1 else within
            cov = own * mine + pooled * within + (1 - own - pooled) * max(np.trace(mine) / d, 1e-3) * np.eye(d)
            low = np.linalg.cholesky(cov)
            factors[k] = np.linalg.inv(low)
            constants[k] = np.log((n[k] + 1) / (total + 2)) - np.log(np.diag(low)).sum()
        return Discriminant((centre, spread), means, factors, constants)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of statistics."""
        z = (x - self.scale[0]) / self.scale[1]
        log = [self.constants[k] - 0.5 * (((z - self.means[k]) @ self.factors[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))


def fit(rows: DataFrame) -> Discriminant:
    """From rows (_x, quality): class moments are added up by partition, then by key (class), then on the driver (2 rows)."""
    d = len(NAMES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            x = np.asarray(batch.column("_x").flatten()).reshape(-1, d)
            y = np.asarray(batch.column("quality"))
            for k in (0, 1):
                own = x[y == k]
                n[k] += len(own)
                sums[k] += own.sum(0)
                squares[k] += own.T @ own
        flat = [np.concatenate([[n[k]], sums[k], squares[k].ravel()]) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], len(flat[0])), pa.int32()), pa.array(np.tile(np.arange(len(flat[0])), 2), pa.int32()), pa.array(np.concatenate(flat))], ["k", "i", "v"]
        )

    found = rows.select("_x", F.col("quality").cast("int").alias("quality")).mapInArrow(moments, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros((2, 1 + d + d * d))
    for r in found:
        flat[r["k"], r["i"]] = r["v"]
    return Discriminant.fit(flat[:, 0], flat[:, 1 : 1 + d], flat[:, 1 + d :].reshape(2, d, d))


def with_scores(rows: DataFrame, model: Discriminant, keep: list[str]) -> DataFrame:
    """``keep`` and ``score`` from rows with ``_x``; a column to keep must not be called score."""
    if "score" in {c.lower() for c in keep}:
        raise ValueError("a column to keep has the name of the column to make: score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("_x").flatten()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(model.score(x))], [*keep, "score"])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.select(*keep, "_x").mapInArrow(run, ", ".join([*kinds, "score double"]))


def training_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that may teach: labelled 0 or 1, crc32(doc_id) mod 5 not 0. An id with labels of both kinds counts once for each."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), "quality").distinct()
    return rows.where(crc_mod("doc_id", 5) != 0).join(known, F.col("doc_id") == F.col("_id")).select("_x", "quality")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    Null and empty texts are scored like others; without any labels the score is 0.5; null ids are scored and, their crc32
    being that of an empty text, held out. Only the text reaches the score. The statistics are written once to the shared folder.
    """
    rows = written(document_statistics(docs, ["doc_id"]), "quality")
    scored = with_scores(rows, fit(training_rows(rows, labels)), ["doc_id"])
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``; the columns are those of ``docs``."""
    # statistics are small and meet the labels; texts are read twice instead of being shuffled to them
    taught = docs.where(crc_mod("doc_id", 5) != 0)
    model = fit(training_rows(document_statistics(taught, ["doc_id"]), labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in light(batches, "text"):
            yield batch.filter(pa.array(model.score(np.stack([statistics(t or "") for t in batch.column("text").to_pylist()])) >= threshold))

    return docs.mapInArrow(run, docs.schema)
