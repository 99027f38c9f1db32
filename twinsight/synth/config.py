"""Settings of the synthesizer."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass


@dataclass(frozen=True)
class SynthConfig:
    # Default hyper-parameters.
    diffusion_steps: int = 100
    hidden_dim: int = 384
    epochs: int = 200
    batch_size: int = 256
    learning_rate: float = 2e-4

    # Auxiliary loss through a frozen classifier of the target.
    use_decision_conditioning: bool = True
    surrogate_epochs: int = 30
    surrogate_hidden: int = 128
    condition_weight: float = 0.5

    # Rows of high value are drawn more often in training.
    use_value_stratified: bool = True
    value_oversample_factor: float = 2.0
    value_top_quantile: float = 0.90

    # Gradient clipping and noise per layer; a smaller epsilon means more noise.
    use_tiered_dp: bool = True
    dp_clip_norm: float = 1.0
    epsilon_tier1: float = 0.5
    epsilon_tier2: float = 2.0
    epsilon_tier3: float = 8.0

    seed: int = 42

    # Model replicas that train side by side and are averaged each epoch; None: up to the session's
    # parallelism and MAX_WORKERS, fewer on small tables. One worker is plain sequential SGD.
    workers: int | None = None

    def replace(self, **changes) -> SynthConfig:
        return dataclasses.replace(self, **changes)


MAX_WORKERS = 2_048
