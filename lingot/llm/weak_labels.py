"""A generative model of noisy voters over whole tables, and a linear scorer trained on its posteriors.

Voters say + (class 1), - (class 0) or nothing.  Every distinct pattern of votes is counted over all
rows; expectation-maximisation estimates how often each voter says + and - in either class; then the
correlations of voters within a class, beyond what the classes explain, discount voters that repeat
each other.  A pass is a map over the counted patterns and a sum: the driver sees a few numbers for
each voter (or pair of voters), never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOTES = "-0+"


def encode(votes: np.ndarray) -> list[str]:
    """Rows of -1, 0, 1 as strings of - 0 +."""
    letters = np.frombuffer(VOTES.encode(), dtype=np.uint8)[votes.astype(np.int64) + 1]
    return [r.tobytes().decode() for r in np.ascontiguousarray(letters)]


def decode(patterns: pd.Series, voters: int) -> np.ndarray:
    raw = np.frombuffer("".join(patterns).encode(), dtype=np.uint8).reshape(len(patterns), voters)
    return np.where(raw == ord("+"), 1, np.where(raw == ord("-"), -1, 0)).astype(np.int8)


@dataclass
class LabelModel:
    prior: float
    says: np.ndarray  # voter x (-, +) x (class 0, class 1): how often a voter says it in the class
    weight: np.ndarray  # of each voter: 1 for an independent one

    def logit(self, votes: np.ndarray) -> np.ndarray:
        """Log-odds of class 1; what says nothing is no evidence."""
        ratio = np.log(self.says[:, :, 1] / self.says[:, :, 0]) * self.weight[:, None]
        return np.log(self.prior / (1 - self.prior)) + (votes < 0) @ ratio[:, 0] + (votes > 0) @ ratio[:, 1]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(votes), -30, 30)))


def _sums(patterns: DataFrame, voters: int, model: LabelModel, pairs: bool) -> np.ndarray:
    """Sums over all rows, in each class: rows, each voter's - and +; with pairs, products of two voters' votes as well."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v, n = decode(b["pattern"], voters), b["n"].to_numpy(dtype=np.float64)
            p = model.posterior(v)
            got = []
            for mass in (n * (1 - p), n * p):
                got += [mass.sum(), *(mass @ (v < 0)), *(mass @ (v > 0))]
                if pairs:
                    got += list(((v * mass[:, None]).T @ v).ravel())
            yield pd.DataFrame({"i": np.arange(len(got)), "s": np.array(got, dtype=np.float64)})

    rows = patterns.select("pattern", "n").mapInPandas(part, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    size = 2 * (1 + 2 * voters + (voters * voters if pairs else 0))
    out = np.zeros(size)
    for r in rows:
        out[r["i"]] = r["s"]
    return out.reshape(2, -1)


def guess(accuracy: np.ndarray) -> np.ndarray:
    """First guess of what voters say in either class, from how often each is right when it says anything."""
    says = np.empty((len(accuracy), 2, 2))
    says[:, 1, 1] = says[:, 0, 0] = 0.2 * accuracy
    says[:, 1, 0] = says[:, 0, 1] = 0.2 * (1 - accuracy)
    return says


def fit(patterns: DataFrame, voters: int, prior: float, says: np.ndarray, rounds: int = 8) -> LabelModel:
    """The label model of ``patterns`` (pattern, n: how many rows vote so), from a first guess of what voters say."""
    model = LabelModel(prior, says, np.ones(voters))
    for _ in range(rounds):
        s = _sums(patterns, voters, model, pairs=False)
        rows = s[:, 0].sum()
        if not rows:
            return model
        minus, plus = s[:, 1 : 1 + voters], s[:, 1 + voters :]
        mass = s[:, :1]
        spoken = np.stack([minus, plus]).transpose(2, 0, 1)
        says = (spoken + model.says.mean()) / (mass.T[None] + 1.0)
        new = float(np.clip(s[1, 0] / rows, 0.005, 0.995))
        done = abs(new - model.prior) < 1e-4
        model = LabelModel(new, np.clip(says, 1e-6, 1), model.weight)
        if done:
            break
    s = _sums(patterns, voters, model, pairs=True)
    linked = np.zeros((voters, voters))
    for y in (0, 1):
        mass = max(s[y, 0], 1.0)
        mean = (s[y, 1 + voters : 1 + 2 * voters] - s[y, 1 : 1 + voters]) / mass
        cov = s[y, 1 + 2 * voters :].reshape(voters, voters) / mass - np.outer(mean, mean)
        deviation = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        linked += 0.5 * np.maximum(0, cov / np.outer(deviation, deviation) - 0.05)
    np.fill_diagonal(linked, 0)
    return LabelModel(model.prior, model.says, 1 / (1 + linked.sum(axis=1)))


def train_linear(rows: list[np.ndarray], size: int, target: np.ndarray, l2: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression on binary features, given as lists of feature numbers, with soft targets."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.concatenate(rows).astype(np.int64) if len(owner) else owner
    w = np.zeros(size + 1)
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = np.bincount(owner, weights=w[feature], minlength=len(rows)) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.append(np.bincount(feature, weights=error[owner], minlength=size), error.sum()) / max(1, len(rows))
        g[:-1] += l2 * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return w


def scores(rows: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.concatenate(rows).astype(np.int64) if len(owner) else owner
    z = np.bincount(owner, weights=w[feature], minlength=len(rows)) + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
