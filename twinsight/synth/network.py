"""The two small dense networks, as NumPy functions of a flat parameter vector.

They run inside Spark tasks on mini-batches; nothing here knows about tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from twinsight.synth.config import SynthConfig
from twinsight.synth.schedule import CLEAN_CLAMP, add_noise, alpha_bars, clean_estimate

# Sizes of the time embedding and the condition, embedding period, noise scale.
TIME_WIDTH = 64
TIME_PERIOD = 10_000.0
CONDITION_WIDTH = 5
DP_NOISE_SCALE = 1e-3

Layers = list[tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Dense:
    """A stack of linear layers with one activation between them."""

    sizes: tuple[int, ...]
    activation: str

    @property
    def shapes(self) -> list[tuple[int, int]]:
        return list(zip(self.sizes[:-1], self.sizes[1:]))

    @property
    def n_parameters(self) -> int:
        return sum(a * b + b for a, b in self.shapes)

    def initial(self, rng: np.random.Generator) -> np.ndarray:
        parts = []
        for a, b in self.shapes:
            reach = 1.0 / math.sqrt(a)
            parts += [rng.uniform(-reach, reach, a * b), rng.uniform(-reach, reach, b)]
        return np.concatenate(parts).astype(np.float32)

    def unpack(self, flat: np.ndarray) -> Layers:
        layers, at = [], 0
        for a, b in self.shapes:
            w = flat[at : at + a * b].reshape(a, b)
            layers.append((w, flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return layers

    def curve(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Activation and its slope."""
        if self.activation == "relu":
            on = (z > 0).astype(z.dtype)
            return z * on, on
        s = sigmoid(z)
        return z * s, s * (1 + z * (1 - s))

    def forward(self, layers: Layers, x: np.ndarray) -> tuple[np.ndarray, list]:
        tape = []
        for i, (w, b) in enumerate(layers):
            z = x @ w + b
            if i == len(layers) - 1:
                tape.append((x, None))
                return z, tape
            out, slope = self.curve(z)
            tape.append((x, slope))
            x = out
        return x, tape

    def backward(self, layers: Layers, tape: list, grad: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Flat gradient per layer, and the gradient of the input."""
        grads = []
        for (w, _), (x, slope) in zip(reversed(layers), reversed(tape)):
            if slope is not None:
                grad = grad * slope
            grads.append(np.concatenate([(x.T @ grad).ravel(), grad.sum(axis=0)]))
            grad = grad @ w.T
        return grads[::-1], grad


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def cross_entropy(logit: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0.0, logit) - y * logit))


def time_embedding(t: np.ndarray) -> np.ndarray:
    rate = np.exp(-np.linspace(0.0, math.log(TIME_PERIOD), TIME_WIDTH // 2))
    angle = np.asarray(t, dtype=float)[:, None] * rate
    return np.concatenate([np.sin(angle), np.cos(angle)], axis=1).astype(np.float32)


class SurrogateTask:
    """Mini-batch loss of the classifier that stands in for the decision scorer."""

    def __init__(self, dim: int, config: SynthConfig):
        h = config.surrogate_hidden
        self.net = Dense((dim, h, h, 1), "relu")
        self.learning_rate = 1e-3  # fixed value

    @property
    def n_parameters(self) -> int:
        return self.net.n_parameters

    def initial(self, rng: np.random.Generator) -> np.ndarray:
        return self.net.initial(rng)

    def logit_and_input_slope(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray):
        """Mean loss, and its gradient with respect to the input rows."""
        layers = self.net.unpack(flat)
        logit, tape = self.net.forward(layers, x)
        slope = (sigmoid(logit[:, 0]) - y)[:, None] / len(x)
        grads, grad_x = self.net.backward(layers, tape, slope.astype(np.float32))
        return cross_entropy(logit[:, 0], y), grads, grad_x

    def loss_and_gradient(self, flat, x, y, tier, rng):
        loss, grads, _ = self.logit_and_input_slope(flat, x, y)
        return loss, np.concatenate(grads)


class DenoiserTask:
    """Mini-batch loss of the noise predictor, with the optional decision loss and noisy gradients."""

    def __init__(self, dim: int, config: SynthConfig, surrogate: np.ndarray | None = None):
        h = config.hidden_dim
        self.dim, self.config = dim, config
        self.time_net = Dense((TIME_WIDTH, h, h), "silu")
        self.main_net = Dense((dim + h + CONDITION_WIDTH, h, h, h, dim), "silu")
        self.surrogate_task = SurrogateTask(dim, config)
        self.surrogate = surrogate
        self.learning_rate = config.learning_rate
        self.alpha_bar = alpha_bars(config.diffusion_steps)

    @property
    def n_parameters(self) -> int:
        return self.time_net.n_parameters + self.main_net.n_parameters

    def initial(self, rng: np.random.Generator) -> np.ndarray:
        return np.concatenate([self.time_net.initial(rng), self.main_net.initial(rng)])

    def _unpack(self, flat: np.ndarray) -> tuple[Layers, Layers]:
        cut = self.time_net.n_parameters
        return self.time_net.unpack(flat[:cut]), self.main_net.unpack(flat[cut:])

    def loss_and_gradient(self, flat, x, y, tier, rng):
        b = len(x)
        time_layers, main_layers = self._unpack(flat)
        t = rng.integers(0, self.config.diffusion_steps, b)
        signal = np.sqrt(self.alpha_bar[t])[:, None].astype(np.float32)
        noise = np.sqrt(1 - self.alpha_bar[t])[:, None].astype(np.float32)
        eps = rng.standard_normal(x.shape, dtype=np.float32)
        x_t = add_noise(x, eps, signal, noise)

        embedded, time_tape = self.time_net.forward(time_layers, time_embedding(t))
        guess, main_tape = self.main_net.forward(
            main_layers, np.concatenate([x_t, embedded, conditions(y, tier)], axis=1)
        )
        loss = float(np.mean((guess - eps) ** 2))
        grad = 2.0 * (guess - eps) / eps.size
        if self.surrogate is not None:
            clean = clean_estimate(x_t, guess, signal, noise)
            extra, _, grad_clean = self.surrogate_task.logit_and_input_slope(self.surrogate, clean, y)
            loss += self.config.condition_weight * extra
            grad = grad - self.config.condition_weight * (noise / signal) * grad_clean
        main_grads, grad_in = self.main_net.backward(main_layers, main_tape, grad.astype(np.float32))
        grad_embedded = grad_in[:, self.dim : self.dim + self.config.hidden_dim]
        time_grads, _ = self.time_net.backward(time_layers, time_tape, grad_embedded)
        return loss, np.concatenate(self._privatise([*time_grads, *main_grads], rng))

    def _privatise(self, grads: list[np.ndarray], rng: np.random.Generator) -> list[np.ndarray]:
        """Clip each layer's gradient and add Gaussian noise by its tier."""
        config = self.config
        if not config.use_tiered_dp:
            return grads
        epsilon = {1: config.epsilon_tier1, 2: config.epsilon_tier2, 3: config.epsilon_tier3}
        out = []
        for i, g in enumerate(grads):
            norm = float(np.linalg.norm(g)) + 1e-12
            sigma = config.dp_clip_norm / max(epsilon[layer_tier(i, len(grads))], 1e-3)
            jitter = rng.standard_normal(g.shape, dtype=np.float32)
            out.append(g * min(1.0, config.dp_clip_norm / norm) + jitter * (sigma * DP_NOISE_SCALE))
        return out

    def generate(self, flat: np.ndarray, start: np.ndarray, y: np.ndarray, tier: np.ndarray) -> np.ndarray:
        """Run the reverse process from noise ``start``; the time branch is evaluated once per step."""
        time_layers, main_layers = self._unpack(flat)
        embedded, _ = self.time_net.forward(time_layers, time_embedding(np.arange(self.config.diffusion_steps)))
        (w, b), rest = main_layers[0], main_layers[1:]
        w_x, w_t, w_c = np.split(w, [self.dim, self.dim + self.config.hidden_dim])
        fixed = conditions(y, tier) @ w_c + b
        x = start.astype(np.float32)
        for t in range(self.config.diffusion_steps - 1, -1, -1):
            hidden, _ = self.main_net.curve(x @ w_x + (fixed + embedded[t] @ w_t))
            eps, _ = self.main_net.forward(rest, hidden)
            signal, noise = math.sqrt(self.alpha_bar[t]), math.sqrt(1 - self.alpha_bar[t])
            clean = np.clip(clean_estimate(x, eps, signal, noise), -CLEAN_CLAMP, CLEAN_CLAMP)
            before = self.alpha_bar[t - 1] if t else 1.0
            x = add_noise(clean, eps, math.sqrt(before), math.sqrt(1 - before))
        return x


def layer_tier(i: int, n_layers: int) -> int:
    """1 for the first and last linear layer, 2 for the rest of the first half, else 3."""
    if i in (0, n_layers - 1):
        return 1
    return 2 if i < n_layers // 2 else 3


def conditions(y: np.ndarray, tier: np.ndarray) -> np.ndarray:
    """Target one-hot (2) and tier one-hot (3)."""
    return np.concatenate(
        [np.eye(2, dtype=np.float32)[y.astype(int)], np.eye(3, dtype=np.float32)[tier.astype(int)]], axis=1
    )
