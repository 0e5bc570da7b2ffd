"""Small models fitted on the driver from bounded samples: logistic regression, Platt calibration, a label model of voters."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 25, rows: np.ndarray | None = None, chunk: int = 2048) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression on dense features; the last weight is the bias, not penalised.

    ``rows`` picks rows of ``x`` and ``y``. Features are taken in chunks, so nothing of the size of ``x`` is made beside it.
    """
    rows = np.arange(len(x)) if rows is None else rows
    size = x.shape[1] + 1
    w = np.zeros(size)
    penalty = np.full(size, ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        gradient, curvature = penalty * w, np.diag(penalty)
        for start in range(0, len(rows), chunk):
            some = rows[start : start + chunk]
            part = np.ones((len(some), size))
            part[:, :-1] = x[some]
            own = 1.0 if weight is None else weight[some]
            p = sigmoid(part @ w)
            gradient += part.T @ (own * (p - y[some]))
            curvature += (part * (own * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ part
        step = np.linalg.solve(curvature, gradient)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def sparse_logistic(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, size: int, ridge: float = 0.1, steps: int = 600, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias on 0/1 features given as (row, column) pairs; ``y`` may be probabilities. Adam on the whole sample."""
    n = max(1, len(y))
    base = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    w = np.zeros(size + 1)
    w[-1] = np.log(base / (1 - base))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1 if len(y) else 1):
        p = sigmoid(np.bincount(rows, weights=w[columns], minlength=n) + w[-1])
        miss = p - y
        g = np.append(np.bincount(columns, weights=miss[rows], minlength=size) + ridge * w[:-1], miss.sum()) / n
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn scores into probabilities, with Platt's softened targets."""
    up, down = y.sum(), len(y) - y.sum()
    if up == 0 or down == 0:
        return 1.0, 0.0
    target = np.where(y > 0.5, (up + 1) / (up + 2), 1 / (down + 2))
    w = newton(logit[:, None], target, ridge=1e-3)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


class LabelModel:
    """P(votes, label) as a tree: each voter depends on the label and on the voter it is most correlated with.

    Fitted by expectation maximisation on counts of vote patterns; patterns of labelled rows keep their label. Accuracies are the
    conditional tables, correlations the tree.
    """

    def fit(self, votes: np.ndarray, unlabelled: np.ndarray, labelled: np.ndarray, rounds: int = 200) -> LabelModel:
        """``votes``: patterns x voters of 0/1; counts per pattern, ``labelled`` with a column for each label."""
        self.parent = [-1] * votes.shape[1]
        total = labelled.sum(axis=0) + 1.0
        self.prior = total / total.sum()
        # Start from what labelled rows show, each voter on its own.
        soft = labelled + unlabelled[:, None] * self.prior * 1e-3
        self.tables(votes, soft)
        for k in range(rounds):
            soft = labelled + unlabelled[:, None] * self.posterior(votes)
            if k in (1, rounds // 2):
                self.parent = self.tree(votes, soft)
            self.tables(votes, soft)
        return self

    def tables(self, votes: np.ndarray, soft: np.ndarray) -> None:
        """chance[j][state of parent][label] of vote 1, with one pseudo-vote spread at the voter's mean."""
        self.chance = []
        share = soft.sum(axis=0)
        self.prior = (share + 1) / (share + 1).sum()
        for j, parent in enumerate(self.parent):
            state = votes[:, parent] if parent >= 0 else np.zeros(len(votes), dtype=np.int64)
            mean = (soft.sum(axis=1) * votes[:, j]).sum() / max(soft.sum(), 1)
            chance = np.empty((2, 2))
            for s in (0, 1):
                inside = soft[state == s]
                chance[s] = (votes[state == s, j] @ inside + mean) / (inside.sum(axis=0) + 1)
            self.chance.append(np.clip(chance, 1e-5, 1 - 1e-5))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.tile(np.log(self.prior), (len(votes), 1))
        for j, parent in enumerate(self.parent):
            state = votes[:, parent] if parent >= 0 else np.zeros(len(votes), dtype=np.int64)
            p = self.chance[j][state]
            log += np.where(votes[:, [j]] == 1, np.log(p), np.log(1 - p))
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        return p / p.sum(axis=1, keepdims=True)

    def tree(self, votes: np.ndarray, soft: np.ndarray, least: float = 1e-4) -> list[int]:
        """Maximum spanning tree of the mutual information between voters given the label; weak links are left out."""
        m = votes.shape[1]
        total = max(soft.sum(), 1e-9)
        strength = np.zeros((m, m))
        for y in (0, 1):
            w, mass = soft[:, y], max(soft[:, y].sum(), 1e-9)
            one = (votes * w[:, None]).sum(axis=0) / mass
            both = (votes * w[:, None]).T @ votes / mass
            for a, b, joint in ((1, 1, both), (1, 0, one[:, None] - both), (0, 1, one[None, :] - both), (0, 0, 1 - one[:, None] - one[None, :] + both)):
                pa, pb = (one if a else 1 - one)[:, None], (one if b else 1 - one)[None, :]
                safe = np.maximum(joint, 1e-12)
                strength += mass / total * safe * np.log(safe / np.maximum(pa * pb, 1e-12))
        parent, joined = [-1] * m, {0} if m else set()
        while len(joined) < m:
            a, b = max(((a, b) for a in joined for b in range(m) if b not in joined), key=lambda x: strength[x])
            parent[b] = a if strength[a, b] > least else -1
            joined.add(b)
        return parent
