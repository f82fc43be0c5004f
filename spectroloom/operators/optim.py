"""AdamW on a dictionary of weights, and their moving average."""

from __future__ import annotations

import numpy as np


def decays(name: str) -> bool:
    """Whether weight decay applies: not to norms, tokens and biases, but for the joint bias of queries, keys and values."""
    return name.endswith("qkv.bias") or not (name.endswith(".bias") or "norm" in name or name in ("cls_token", "pos_embed"))


class AdamW:
    def __init__(self, weights: dict[str, np.ndarray], lr: float = 1.5e-4, weight_decay: float = 0.05, betas: tuple[float, float] = (0.9, 0.95), eps: float = 1e-8) -> None:
        self.weights, self.lr, self.weight_decay, self.betas, self.eps, self.steps = weights, lr, weight_decay, betas, eps, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, gradients: dict[str, np.ndarray], lr_scale: float = 1.0) -> None:
        self.steps += 1
        b1, b2 = self.betas
        lr = self.lr * lr_scale
        for k, g in gradients.items():
            self.mean[k] = b1 * self.mean[k] + (1 - b1) * g
            self.square[k] = b2 * self.square[k] + (1 - b2) * g * g
            if decays(k):
                self.weights[k] = self.weights[k] * (1 - lr * self.weight_decay)
            step = self.mean[k] / (1 - b1**self.steps) / (np.sqrt(self.square[k] / (1 - b2**self.steps)) + self.eps)
            self.weights[k] = self.weights[k] - lr * step


class EMA:
    """Shadow weights ``s = decay * s + (1 - decay) * w``."""

    def __init__(self, weights: dict[str, np.ndarray], decay: float = 0.999) -> None:
        self.decay, self.shadow = decay, {k: v.copy() for k, v in weights.items()}

    def update(self, weights: dict[str, np.ndarray]) -> None:
        for k, v in weights.items():
            self.shadow[k] = self.decay * self.shadow[k] + (1 - self.decay) * v

    def apply_to(self, weights: dict[str, np.ndarray]) -> None:
        weights.update({k: v.copy() for k, v in self.shadow.items()})
