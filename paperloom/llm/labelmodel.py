"""A label model for noisy labelling functions, fitted by expectation-maximization.

Each function votes +1 (has the defect), -1 (has not) or 0 (no opinion, which says nothing). Given the hidden class the
votes are taken as independent; every function has a rate of votes for and against in either class, with a Beta prior
from the accuracy that its author declares. Only the counts of the vote patterns enter, so the fit takes at most 3^k rows for k functions, whatever
the number of records.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

VOTES = (-1, 0, 1)


@dataclass(frozen=True)
class Declared:
    """What the author of a labelling function expects: how often a vote is right, for and against."""

    name: str
    precision_for: float = 0.95
    precision_against: float = 0.95


class LabelModel:
    def __init__(self, functions: list[Declared], prior: float = 0.05, strength: float = 0.5) -> None:
        self.functions, self.prior, self.strength = functions, prior, strength
        self.rate = prior
        self.table = np.zeros((2, len(functions), 3))

    def fit(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> LabelModel:
        """``patterns``: (n, k) votes; ``counts``: how often each occurs."""
        n, k = patterns.shape
        counts = counts.astype(float)
        total = max(counts.sum(), 1.0)
        at = patterns + 1
        pseudo = np.zeros((2, k, 3))
        for j, f in enumerate(self.functions):
            against, given = ((counts[at[:, j] == v].sum() + 1e-3) / (total + 1e-3) for v in (0, 2))
            pseudo[1, j] = (against * (1 - f.precision_against), 0.0, given * f.precision_for)
            pseudo[0, j] = (against * f.precision_against, 0.0, given * (1 - f.precision_for))
        pseudo = pseudo / pseudo.sum(2, keepdims=True)
        weight = np.array([(1 - self.prior), self.prior])[:, None, None] * total * self.strength
        self.table, self.rate = pseudo.copy(), self.prior
        for _ in range(rounds):
            p = self._posterior(at)
            for y, q in ((1, p), (0, 1 - p)):
                mass = q * counts
                for j in range(k):
                    seen = np.bincount(at[:, j], mass, 3) * (1, 0, 1)
                    self.table[y, j] = seen + pseudo[y, j] * weight[y, 0, 0]
            self.table = (self.table + 1e-6) / (self.table + 1e-6).sum(2, keepdims=True)
            self.rate = float(np.clip((p * counts).sum() / total, 1e-4, 0.5))
        return self

    def _posterior(self, at: np.ndarray) -> np.ndarray:
        j = np.arange(at.shape[1])
        table = np.maximum(self.table, 1e-9)
        ratio = np.where(at == 1, 0.0, np.log(table[1][j, at]) - np.log(table[0][j, at]))
        score = np.log(self.rate) - np.log1p(-self.rate) + ratio.sum(1)
        return 1 / (1 + np.exp(-np.clip(score, -500, 500)))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self._posterior(patterns + 1)
