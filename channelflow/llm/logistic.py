"""A small logistic regression on the driver, for calibration on bounded samples."""

from __future__ import annotations

import numpy as np


class Logistic:
    """Newton steps on standardised features, with a ridge penalty."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3):
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self.standard(x)
        self.beta = np.zeros(z.shape[1])
        for _ in range(60):
            p = self.chance(z)
            curve = (z * (weight * p * (1 - p))[:, None]).T @ z + penalty * len(y) * np.eye(len(self.beta))
            step = np.linalg.solve(curve, z.T @ (weight * (y - p)) - penalty * len(y) * self.beta)
            self.beta += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (x - self.mean) / self.spread])

    def chance(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z @ self.beta, -40, 40)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.chance(self.standard(x))
