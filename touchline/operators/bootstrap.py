"""Paired block bootstrap with a reproducible generator that each replicate can enter directly.

The generator is a 32-bit xorshift, linear over bits, so stepping ahead by a replicate's number of draws is one 32 x 32 bit
matrix; replicates then run side by side, with the draws that one long stream would have given.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Metrics whose paired differences get intervals.
METRICS = ("brier", "log_loss", "rps")
REPLICATES, LOW, HIGH, LEAST_BLOCKS = 5000, 0.025, 0.975, 20


def seed_of(version: str, label: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{version}:{label}".encode()).digest()[:4], "little") or 1


def step(x: np.ndarray) -> np.ndarray:
    x = x ^ (x << np.uint32(13))
    x = x ^ (x >> np.uint32(17))
    return x ^ (x << np.uint32(5))


def jump(state: int, draws: int, lanes: int) -> np.ndarray:
    """States after 0, draws, 2 * draws, ... steps."""
    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    power, image, left = columns.copy(), columns.copy(), draws

    def apply(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
        bits = (x[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
        return np.bitwise_xor.reduce(np.where(bits == 1, matrix, np.uint32(0)), axis=1).astype(np.uint32)

    power = step(columns)
    while left:
        if left & 1:
            image = apply(power, image)
        power, left = apply(power, power), left >> 1
    out = np.empty(lanes, np.uint32)
    x = np.array([state], np.uint32)
    for i in range(lanes):
        out[i] = x[0]
        x = apply(image, x)
    return out


def replicate_means(diff: np.ndarray, n: np.ndarray, seed: int, replicates: int = REPLICATES) -> np.ndarray:
    blocks = len(diff)
    state = jump(seed, blocks, replicates)
    total, count = np.zeros(replicates), np.zeros(replicates)
    for _ in range(blocks):
        state = step(state)
        pick = (state / 4294967296.0 * blocks).astype(np.int64)
        total += diff[pick]
        count += n[pick]
    return total / count


def block_bootstrap(blocks: DataFrame, version: str, metric: str, reference: str, replicates: int = REPLICATES, label: str = "{model}:{metric}:vs-{reference}") -> DataFrame:
    """model_id, point, low, high, blocks from model_id, block, diff, n; a task holds one model's weekly sums."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        if len(frame) < LEAST_BLOCKS:
            raise ValueError(f"{len(frame)} blocks; at least {LEAST_BLOCKS} are needed")
        model = frame.model_id.iloc[0]
        diff, n = frame["diff"].to_numpy(), frame.n.to_numpy(np.float64)
        means = replicate_means(diff, n, seed_of(version, label.format(model=model, metric=metric, reference=reference)), replicates)
        low, high = np.quantile(means, [LOW, HIGH])
        return pd.DataFrame({"model_id": [model], "point": [diff.sum() / n.sum()], "low": [low], "high": [high], "blocks": [len(frame)]})

    return blocks.select("model_id", "block", "diff", F.col("n").cast("long").alias("n")).groupBy("model_id").applyInPandas(run, "model_id string, point double, low double, high double, blocks long")
