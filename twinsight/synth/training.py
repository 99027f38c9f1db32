"""Data-parallel training: local SGD in every partition, averaged once per epoch.

One epoch is one Spark job. Each task streams its rows in Arrow batches through Adam steps on
its own model replica and emits the replica in slices; slices with the same number meet in one
group, are averaged by row count, and only the average (a few MB) returns to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

_GROUP_FLOATS = 8_000_000  # slices of all workers that meet in one group: 32 MB
_MAX_STATE_BYTES = 512 * 1024 * 1024
# Adam constants.
BETA1, BETA2, ADAM_EPS = 0.9, 0.999, 1e-8

_SLICE_SCHEMA = "slice int, rows long, steps long, loss double, part binary"


class Task(Protocol):
    learning_rate: float
    n_parameters: int

    def initial(self, rng: np.random.Generator) -> np.ndarray: ...

    def loss_and_gradient(self, flat, x, y, tier, rng) -> tuple[float, np.ndarray]: ...


class AdamState:
    """Parameters and both moments in one vector of 3 * n floats, with the step count."""

    def __init__(self, flat: np.ndarray, steps: int = 0):
        self.flat, self.steps = flat, steps

    @classmethod
    def start(cls, parameters: np.ndarray) -> AdamState:
        zeros = np.zeros_like(parameters)
        return cls(np.concatenate([parameters, zeros, zeros]).astype(np.float32))

    @property
    def parameters(self) -> np.ndarray:
        return self.flat[: len(self.flat) // 3]

    def step(self, grad: np.ndarray, rate: float) -> None:
        n = len(grad)
        p, m, v = self.flat[:n], self.flat[n : 2 * n], self.flat[2 * n :]
        self.steps += 1
        m += (1 - BETA1) * (grad - m)
        v += (1 - BETA2) * (grad * grad - v)
        scale = rate * np.sqrt(1 - BETA2**self.steps) / (1 - BETA1**self.steps)
        p -= (scale * m / (np.sqrt(v) + ADAM_EPS * np.sqrt(1 - BETA2**self.steps))).astype(np.float32)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a dense matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, width)


def _mini_batches(
    batches: Iterator[pa.RecordBatch], dim: int, size: int, rng: np.random.Generator, resample: bool
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Shuffled mini-batches over a stream of Arrow batches; a tail of one row is skipped.

    With ``resample`` each row first draws its number of copies, Poisson with its ``mean``:
    the distributed form of drawing the epoch with replacement by weight.
    """
    left: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = (
            matrix(batch.column("x"), dim),
            batch.column("y").to_numpy(zero_copy_only=False).astype(np.float32),
            batch.column("tier").to_numpy(zero_copy_only=False),
        )
        if resample:
            copies = rng.poisson(batch.column("mean").to_numpy(zero_copy_only=False))
            rows = tuple(np.repeat(a, copies, axis=0) for a in rows)
        if left is not None:
            rows = tuple(np.concatenate([a, b]) for a, b in zip(left, rows))
        order = rng.permutation(len(rows[0]))
        whole = len(order) // size * size
        for at in range(0, whole, size):
            pick = order[at : at + size]
            yield tuple(a[pick] for a in rows)
        left = tuple(a[order[whole:]] for a in rows)
    if left is not None and len(left[0]) >= 2:
        yield left


def run_epoch(
    rows: DataFrame,
    dim: int,
    task: Task,
    state: AdamState,
    batch_size: int,
    seed: tuple[int, ...],
    n_workers: int,
    resample: bool = False,
) -> tuple[AdamState, float]:
    """One pass over ``rows`` (x array<float>, y double, tier int, mean double); the averaged state and the mean loss."""
    if state.flat.nbytes > _MAX_STATE_BYTES:
        raise ValueError("the model is too large to broadcast; lower hidden_dim or drop wide categories")
    context = rows.sparkSession.sparkContext
    shared = context.broadcast((task, state))
    width = max(_GROUP_FLOATS // n_workers, 1_024)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, start = shared.value
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([*seed, part])
        local = AdamState(start.flat.copy(), start.steps)
        seen, total = 0, 0.0
        for x, y, tier in _mini_batches(batches, dim, batch_size, rng, resample):
            loss, grad = task.loss_and_gradient(local.parameters, x, y, tier, rng)
            local.step(grad, task.learning_rate)
            seen, total = seen + len(x), total + loss * len(x)
        if not seen:
            return
        for i, at in enumerate(range(0, len(local.flat), width)):
            yield pa.RecordBatch.from_pydict(
                {
                    "slice": pa.array([i], pa.int32()),
                    "rows": pa.array([seen], pa.int64()),
                    "steps": pa.array([local.steps], pa.int64()),
                    "loss": pa.array([total / seen], pa.float64()),
                    "part": pa.array([local.flat[at : at + width].tobytes()], pa.binary()),
                }
            )

    def average(group: pd.DataFrame) -> pd.DataFrame:
        weight = group["rows"].to_numpy(dtype=float)
        stack = np.stack([np.frombuffer(b, dtype=np.float32) for b in group["part"]])
        mean = (weight @ stack / weight.sum()).astype(np.float32)
        return pd.DataFrame(
            {
                "slice": [int(group["slice"].iloc[0])],
                "rows": [int(weight.sum())],
                "steps": [int(group["steps"].max())],
                "loss": [float(weight @ group["loss"] / weight.sum())],
                "part": [mean.tobytes()],
            }
        )

    slices = (
        rows.select("x", "y", "tier", *(["mean"] if resample else []))
        .mapInArrow(train, _SLICE_SCHEMA)
        .groupBy("slice")
        .applyInPandas(average, _SLICE_SCHEMA)
        .collect()
    )
    shared.destroy()
    if not slices:
        return state, float("nan")
    slices.sort(key=lambda r: r["slice"])
    flat = np.concatenate([np.frombuffer(r["part"], dtype=np.float32) for r in slices])
    return AdamState(flat, slices[0]["steps"]), slices[0]["loss"]
