"""Quality classifier: a sparse ensemble of rules.

Small boosted trees over statistics of a text give paths; each path is a conjunctive rule; a
lasso logistic fit keeps few of them; the model is one Spark column over the statistics. Only
the fit is on the driver, over a bounded sample of labelled rows. Scoring is one scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.llm.common import rows
from gatewright.session import in_arrow

#: What a rule can ask of a text; each is 0 for an empty text.
STATS = (
    "log_bytes", "upper", "digits", "blanks", "commas_stops", "other_ascii", "non_ascii", "words_log",
    "word_bytes", "distinct_words", "same_as_last", "odd_ends", "odd_words", "distinct_lines", "line_words",
)
UPPER, DIGITS, BLANKS, STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\x0b\x0c\r", b".,"
LETTERS = b"abcdefghijklmnopqrstuvwxyz" + UPPER
HIGH = bytes(range(128, 256))
OTHER = bytes(c for c in range(128) if c not in LETTERS + DIGITS + BLANKS + STOPS)


def text_stats(text: bytes) -> tuple[float, ...]:
    """STATS of one text: shares of bytes and words, and logarithms of sizes."""
    n, words = len(text), text.split()
    if not words:
        return (float(np.log1p(n)),) + (0.0,) * (len(STATS) - 1)
    share = lambda chars: (n - len(text.translate(None, chars))) / n
    other, k = share(OTHER), len(words)
    odd = sum(w[-1] in OTHER for w in words) if other else 0
    alone = sum(len(w) == 1 and w[0] in OTHER for w in words) if other else 0
    lines = [x for x in text.split(b"\n") if x]
    return (
        float(np.log1p(n)), share(UPPER), share(DIGITS), share(BLANKS), share(STOPS), other, share(HIGH), float(np.log1p(k)),
        sum(map(len, words)) / k, len(set(words)) / k, sum(map(bytes.__eq__, words, words[1:])) / k, odd / k, alone / k,
        len(set(lines)) / max(1, len(lines)), k / max(1, len(lines)),
    )


def _with_stats(batches):
    for batch in batches:
        for part, texts in rows(batch):
            x = np.array([text_stats(t) for t in texts], np.float64).reshape(-1, len(STATS))
            stats = pa.StructArray.from_arrays([pa.array(x[:, i]) for i in range(len(STATS))], names=list(STATS))
            yield pa.RecordBatch.from_arrays([part.column(0), stats], ["row", "stats"])


def with_stats(docs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """row (a struct of the named columns of docs) and stats (a struct of STATS). A null text counts as empty."""
    row = F.struct(*[F.col(f"`{c}`") for c in names or docs.columns])
    given = docs.select(row.alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = given.schema["row"].dataType.simpleString()
    return in_arrow(given, _with_stats, f"row {kind}, stats struct<{', '.join(f'{s}: double' for s in STATS)}>")


Condition = tuple[int, bool, float]  # statistic, whether it is above the bound, the bound


@dataclass(frozen=True)
class RuleModel:
    """score = sigmoid(bias + the weights of the rules that hold)."""

    bias: float
    rules: list[tuple[Condition, ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self, stats: str = "stats") -> Column:
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for at, above, bound in rule:
                x = F.col(f"{stats}.{STATS[at]}")
                holds = holds & ((x > bound) if above else (x <= bound))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree_paths(bins: np.ndarray, bounds: list[np.ndarray], target: np.ndarray, depth: int, least: int):
    """Greedy least-squares tree: its paths (one for each node but the root), and its fitted values."""
    fitted, paths = np.zeros(len(target)), []

    def grow(at: np.ndarray, path: tuple[Condition, ...], left: int) -> None:
        if path:
            paths.append(path)
        fitted[at] = target[at].mean() if len(at) else 0
        if not left or len(at) < 2 * least:
            return
        best = (1e-9, 0, 0)
        total, n = target[at].sum(), len(at)
        for j, own in enumerate(bounds):
            if not len(own):
                continue
            size = np.bincount(bins[at, j], minlength=len(own) + 1)[:-1].cumsum()
            summed = np.bincount(bins[at, j], target[at], len(own) + 1)[:-1].cumsum()
            fits = (size >= least) & (n - size >= least)
            gain = np.where(fits, summed**2 / np.maximum(size, 1) + (total - summed) ** 2 / np.maximum(n - size, 1) - total**2 / n, 0)
            if gain.max() > best[0]:
                best = (gain.max(), j, int(gain.argmax()))
        if best[0] <= 1e-9:
            return
        _, j, k = best
        low = bins[at, j] <= k
        grow(at[low], (*path, (j, False, float(bounds[j][k]))), left - 1)
        grow(at[~low], (*path, (j, True, float(bounds[j][k]))), left - 1)

    grow(np.arange(len(target)), (), depth)
    return paths, fitted


def _lasso(holds: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all but the bias, by accelerated proximal gradient."""
    n, m = holds.shape
    x = np.hstack([np.ones((n, 1)), holds])
    v = np.ones(m + 1)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / float(v @ (x.T @ (x @ v)))
    w = z = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        new = z - rate * (x.T @ (_sigmoid(x @ z) - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z, w = new + (last - 1) / t * (new - w), new
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, penalty: float = 5e-4, steps: int = 400) -> RuleModel:
    """The model of statistics x and labels y in {0, 1}. With one class only, or no rows, a constant."""
    if len(y) == 0:
        return RuleModel(0.0)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    bias = float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return RuleModel(bias)
    bounds = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 49))) for j in range(x.shape[1])]
    bounds = [b[(b >= x[:, j].min()) & (b < x[:, j].max())] for j, b in enumerate(bounds)]
    bins = np.stack([np.searchsorted(b, x[:, j], "left") for j, b in enumerate(bounds)], 1)
    margin, found = np.full(len(y), bias), {}
    for _ in range(trees):
        paths, fitted = _tree_paths(bins, bounds, y - _sigmoid(margin), depth, max(5, len(y) // 500))
        margin = margin + 2.0 * fitted
        found |= dict.fromkeys(paths)
    holds = np.stack([np.logical_and.reduce([(x[:, j] > b) == above for j, above, b in r]) for r in found], 1) if found else np.zeros((len(y), 0))
    bias, weights = _lasso(holds.astype(np.float64), y, penalty, steps)
    kept = [(r, float(w)) for r, w in zip(found, weights) if w]
    return RuleModel(bias, [r for r, _ in kept], [w for _, w in kept])


def learns_from(doc_id: str = "doc_id") -> Column:
    """Whether a row is open to the fit: crc32 of its doc_id as text, mod 5, is not 0."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 != 0


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> RuleModel:
    """Fit on at most max_rows labelled documents, those with the smallest hash of doc_id.

    Null labels and null doc_ids are left out; of repeated labels of one doc_id the smaller counts,
    and of repeated documents the one with the least statistics.
    """
    sample = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & learns_from())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    # At most max_rows rows of two numbers: small enough to broadcast at any size of the corpus.
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    each = with_stats(picked, ["doc_id", "quality"]).select("row.doc_id", F.struct("row.quality", "stats.*").alias("s")).groupBy("doc_id").agg(F.min("s").alias("s"))
    got = each.select("doc_id", "s.*").toPandas().sort_values("doc_id", kind="stable")
    return fit_rules(got[list(STATS)].to_numpy(np.float64), (got["quality"] > 0).to_numpy(np.float64))


def score_quality(docs: DataFrame, model: RuleModel) -> DataFrame:
    """row (a struct of all columns of docs) and score (0 to 1), in one scan. Null and empty texts have a score too."""
    return with_stats(docs).select("row", model.column().alias("score"))
