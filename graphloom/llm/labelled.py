"""Bounded samples of labelled documents for the classifiers, and their calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize

SAMPLE_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, modulus: int = 5, held: int = 0, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[tuple[str, int]], float]:
    """Texts of each label from rows outside the held-out fold, and the share of label 1 among all such rows.

    At most ``per_class`` documents of either label are taken in the order of a hash of their id; of these, one that
    would bring the label's texts beyond ``sample_bytes`` is passed over.  Label rows with a null id or label are left
    out, and so are documents that are labelled both ways.  Of repeated ids the least text counts, once.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    y = y.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold("doc_id", modulus) != held))
    y = y.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").drop("most")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    sizes = texts.select("doc_id", F.octet_length("text").cast("long").alias("size")).join(y, "doc_id")
    present = materialize(sizes.groupBy("doc_id", "y").agg(F.max("size").alias("size")), "labelled")
    counts = {r["y"]: r["n"] for r in present.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    chosen: dict[int, int] = {}
    for k in (0, 1):
        left = sample_bytes
        for r in present.filter(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect():
            if r["size"] <= left:
                chosen[r["doc_id"]] = k
                left -= r["size"]
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")  # at most 2 * per_class
    got = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    return [(r["text"], chosen[r["doc_id"]]) for r in sorted(got, key=lambda r: (chosen[r["doc_id"]], r["doc_id"]))], share


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, share: float | None = None, steps: int = 50) -> np.ndarray:
    """Weights and, last, bias of a ridge logistic regression, by Newton's method.

    With ``share``, rows count as if label 1 had that share of them.
    """
    each = np.ones(len(y))
    if share is not None and 0 < share < 1 and 0 < y.mean() < 1:
        each = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        penalty = ridge * np.r_[np.ones(len(w) - 1), 1e-6]
        grad = a.T @ (each * (p - y)) + penalty * w
        hess = (a * (each * p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def linear(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows by weights, plus the bias; a row's value does not depend on the rows beside it, as in a matrix product."""
    out = np.full(len(x), w[-1])
    for k, v in enumerate(w[:-1]):
        out += x[:, k] * v
    return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
