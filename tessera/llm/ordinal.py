"""Cumulative-link (proportional odds) regression over hashed sparse features: one weight vector, ordered thresholds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(w.x - thresholds[k]) for the grades 0 .. len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) of each row, a column for each threshold."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])

    def scores(self, row: np.ndarray, column: np.ndarray, value: np.ndarray | None, count: int) -> np.ndarray:
        return np.bincount(row, self.weights[column] if value is None else value * self.weights[column], count) if len(row) else np.zeros(count)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class _Entries:
    """Sparse rows: starts[i] to starts[i + 1] are the entries of row i. All sums go over pieces of bounded size, so that nothing
    but the columns (and values, if there are any) has an item for each entry."""

    PIECE = 1 << 20

    def __init__(self, starts: np.ndarray, column: np.ndarray, value: np.ndarray | None, width: int):
        self.starts, self.column, self.value, self.width = starts, column, value, width
        number = np.asarray(starts[1:]) // self.PIECE
        self.edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(starts) - 1] if len(starts) > 1 else [0]

    def pieces(self):
        for begin, end in zip(self.edges[:-1], self.edges[1:]):
            low, high = self.starts[begin], self.starts[end]
            yield slice(begin, end), self.starts[begin : end + 1] - low, self.column[low:high], None if self.value is None else self.value[low:high]

    def by_row(self, of_column: np.ndarray | None, power: int = 1) -> np.ndarray:
        """For each row the sum of value**power, times its column's number if given."""
        out = np.zeros(len(self.starts) - 1)
        for rows, starts, column, value in self.pieces():
            each = np.ones(len(column)) if of_column is None else of_column[column]
            if value is not None:
                each = each * value**power
            total = np.concatenate([[0.0], np.cumsum(each)])
            out[rows] = total[starts[1:]] - total[starts[:-1]]
        return out

    def by_column(self, of_row: np.ndarray, power: int = 1) -> np.ndarray:
        """For each column the sum of value**power times its row's number."""
        out = np.zeros(self.width)
        for rows, starts, column, value in self.pieces():
            each = np.repeat(of_row[rows], np.diff(starts))
            out += np.bincount(column, each if value is None else each * value**power, self.width)
        return out


def fit(starts: np.ndarray, column: np.ndarray, value: np.ndarray | None, grades: np.ndarray, width: int, sparsity: float = 1e-4, ridge: float = 1e-4, rounds: int = 150, balance: bool = True, enough: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood with an L1 and a small L2 penalty, by accelerated proximal gradient steps.

    starts, column, value: the rows' entries (value None: all 1). grades: 0, 1, ... for each row. balance: every grade weighs the
    same in all. It ends after so many rounds, or when ten of them raise the mean log likelihood by less than enough in all.
    The thresholds stay in order. One grade alone gives a constant model.
    """
    count, top = len(grades), int(grades.max(initial=0))
    if count == 0 or top == 0 or len(np.unique(grades)) < 2:
        sure = np.full(max(top, 1), -30.0 if top else 30.0)
        return OrdinalModel(np.zeros(width), sure)
    held = _Entries(np.asarray(starts, np.int64), column, value, width)
    share = np.bincount(grades, minlength=top + 1)
    weight = 1 / (np.maximum(share, 1)[grades] * (share > 0).sum()) if balance else np.full(count, 1 / count)
    tail = np.array([weight[grades > k].sum() for k in range(top)]).clip(1e-3, 1 - 1e-3)
    thresholds = np.maximum.accumulate(-np.log(tail / (1 - tail)) + 1e-3 * np.arange(top))
    norm = max(held.by_row(None, 2).max(initial=1.0), 1.0)
    # steps for each feature by how often it occurs: rare ones may move as fast as frequent ones
    pace = np.minimum(0.5 / np.sqrt(norm) / (held.by_column(weight, 2) + 1.0 / count), 800.0 / norm)
    w, previous, momentum = np.zeros(width), np.zeros(width), 1.0
    score, before, likelihood = np.zeros(count), np.zeros(count), []
    for _ in range(rounds):
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = (momentum - 1) / following
        look, looked = w + ahead * (w - previous), score + ahead * (score - before)  # scores are linear in the weights
        low = np.where(grades > 0, _sigmoid(looked - thresholds[np.maximum(grades - 1, 0)]), 1.0)
        high = np.where(grades < top, _sigmoid(looked - thresholds[np.minimum(grades, top - 1)]), 0.0)
        slope = weight * (1 - low - high)  # of the log likelihood by the score: both ends' logistic densities over their difference
        gradient = -held.by_column(slope) + ridge * look
        previous, before, w = w, score, look - pace * gradient
        w = np.sign(w) * np.maximum(np.abs(w) - pace * sparsity, 0)
        momentum = following
        score = held.by_row(w)
        if ((w - look) * (w - previous)).sum() < 0:  # restart where momentum leads uphill
            momentum = 1.0
        thresholds = _fit_thresholds(score, grades, weight, thresholds)
        likelihood.append(float((weight * np.log(np.maximum(low - high, 1e-12))).sum()))
        if len(likelihood) > 20 and abs(likelihood[-1] - likelihood[-11]) < enough:
            break
    return OrdinalModel(w, thresholds)


def _fit_thresholds(score: np.ndarray, grades: np.ndarray, weight: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """One damped step for each threshold from its own binary split, kept in order."""
    out = thresholds.copy()
    for k in range(len(out)):
        p = _sigmoid(score - out[k])
        above = grades > k
        out[k] += np.clip((weight * (p - above)).sum() / max((weight * p * (1 - p)).sum(), 1e-6), -1, 1) * 0.5
    return np.maximum.accumulate(out)
