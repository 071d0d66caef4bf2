"""An isolation forest grown where the rows are.

All that is random comes from MD5, so that SQL can grow the same trees: a row's place on a circle from
its key, a node's feature and split from the tree and the number of the node (children of n are
2 n and 2 n + 1). The driver holds the nodes, at most trees * 2 ** (depth + 1), and no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a tree that a draw looks at, over those it takes: fewer than are taken are below that share of places with a chance of e ** -(1.5 * taken) or so.
MARGIN = 4
NODES = "tree int, node int, feature int, at double, value double"


def path(n: float) -> float:
    """The mean depth at which n rows are told apart."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def uniform(digest: str, start: int) -> float:
    return int(digest[start : start + 13], 16) / 16**13


def _uniform(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start + 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def grown(tree: int, rows: np.ndarray, cap: int) -> list[tuple]:
    """The nodes (tree, node, feature, at, value) over rows: a feature and a split, or the depth that a leaf stands for."""
    out, todo = [], [(1, 0, rows)]
    while todo:
        node, depth, own = todo.pop()
        low, high = (own.min(0), own.max(0)) if len(own) else (np.zeros(rows.shape[1]),) * 2
        varied = np.flatnonzero(high > low)
        if depth >= cap or len(own) <= 1 or not len(varied):
            out.append((tree, node, None, None, depth + path(len(own))))
            continue
        digest = hashlib.md5(f"{tree}:{node}".encode()).hexdigest()
        f = int(varied[int(uniform(digest, 0) * len(varied))])
        at = float(low[f] + uniform(digest, 13) * (high[f] - low[f]))
        left = own[:, f] < at
        out.append((tree, node, f, at, None))
        todo += [(2 * node, depth + 1, own[left]), (2 * node + 1, depth + 1, own[~left])]
    return out


def isolation_forest(cells: DataFrame, features: list[str], key: list[str], trees: int = 50, sample: int = 256, seed: int = 11) -> DataFrame:
    """(key, anomaly) in (0, 1]: isolation depth over seeded random trees; null features and NaN count as the median of the rows drawn.

    Rows lie on a circle, by their keys; a tree is drawn from the `sample` of them that follow its own point. Of
    many rows no two trees have the same, of few they share some. Rows are filtered by place before any order
    is made, so no task sorts more than a few times `sample` of them for a tree. Trees are grown in tasks, one
    group each; all rows are scored by all trees, in Arrow batches.
    """
    x = cells.select(*key, *[F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias(f) for f in features])
    n = cells.count()
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    placed = x.withColumn("_h", digest).withColumn("_place", _uniform(F.col("_h"), 0))
    back = min(trees - 1, trees * MARGIN * sample // max(1, n) + 1)  # no tree whose point lies further back can take a row
    own = placed.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(back)))).withColumn("_tree", F.pmod(F.floor(F.col("_place") * trees).cast("int") - F.col("_tree"), F.lit(trees)))
    after = F.col("_place") - F.col("_tree") / F.lit(float(trees))
    near = own.withColumn("_after", F.when(after < 0, after + 1).otherwise(after)).where(F.col("_after") * n < MARGIN * sample)
    drawn = near.withColumn("_i", F.row_number().over(Window.partitionBy("_tree").orderBy("_after", "_h"))).where(F.col("_i") <= sample)
    told = drawn.agg(*[F.median(f).alias(f) for f in features]).first()
    middle = np.array([told[f] if told[f] is not None else 0.0 for f in features])
    cap = math.ceil(math.log2(max(2, sample)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[features].to_numpy(float)
        return pd.DataFrame(grown(int(pdf["_tree"].iloc[0]), np.where(np.isnan(rows), middle, rows), cap), columns=["tree", "node", "feature", "at", "value"]).astype({"feature": "Int32"})

    forest = drawn.select("_tree", *features).groupBy("_tree").applyInPandas(grow, NODES).collect()  # bounded by the parameters
    largest = drawn.groupBy("_tree").count().agg(F.max("count")).first()[0] or 0
    number = {t: i for i, t in enumerate(sorted({r.tree for r in forest}))}
    split, at, value = (np.full((len(number), 2 ** (cap + 1)), fill) for fill in (-1, 0.0, 0.0))
    for r in forest:
        where = number[r.tree], r.node
        split[where], at[where], value[where] = (-1 if r.feature is None else r.feature), r.at or 0.0, r.value or 0.0

    def score(batches):
        for pdf in batches:
            rows = pdf[features].to_numpy(float)
            rows, depth, each = np.where(np.isnan(rows), middle, rows), np.zeros(len(pdf)), np.arange(len(pdf))
            for s, a, v in zip(split, at, value):
                node = np.ones(len(pdf), np.int64)
                for _ in range(cap):
                    f = s[node]
                    node = np.where(f < 0, node, 2 * node + (rows[each, np.maximum(f, 0)] >= a[node]))
                depth += v[node]
            yield pdf[key].assign(anomaly=2.0 ** (-depth / max(1, len(split)) / max(path(max(2, largest)), 1e-9)))

    kinds = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in key)
    return x.mapInPandas(score, f"{kinds}, anomaly double")
