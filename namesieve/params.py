"""Engine parameters and the hash family."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from math import isqrt

import numpy as np

# Results depend on them.
HASH_MOD = 1 << 20
SHINGLE = 3
EMPTY = "<empty>"
EL_CLUSTER, EL_MATCH = 200, 50
SEED, TAU, EPS = 42, 0.9, 1e-6
KMEANS_ROUNDS, KMEANS_SHIFT, NEAR_ZERO = 20, 1e-8, 1e-10
MASK_LOW, MASK_HIGH = 1.0, 10.0


#: Up to so many rows, seeds are drawn as positions from a permutation on the driver; beyond, by keyed hashes.
PARITY_ROWS = 1_000_000


@dataclass(frozen=True)
class Options:
    """Options of a screening run."""

    k: int | str = "sqrt"
    tau: float = TAU
    seed: int = SEED
    early_stop: bool = True
    search: str = "clustered"
    nprobe: int = 1


@cache
def hash_family(m: int = EL_CLUSTER) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (a, b) of the first m permutations x -> (a x + b) mod 2^20; a may be even."""
    if m > EL_CLUSTER:
        raise ValueError(f"at most {EL_CLUSTER} permutations, got {m}")
    draw = np.random.RandomState(SEED)
    a = draw.randint(1, HASH_MOD, EL_CLUSTER, np.int64)
    b = draw.randint(0, HASH_MOD, EL_CLUSTER, np.int64)
    return a[:m], b[:m]


def choose_k(n: int, mode: int | str = "sqrt") -> int:
    """Number of clusters for n rows: `sqrt`, a number, its digits, or `fixed:<k>`; at most n."""
    text = str(mode)
    if isinstance(mode, int) or text.isdigit() or text.startswith("fixed:"):
        digits = text.removeprefix("fixed:")
        if not digits.lstrip("-").isdigit():
            raise ValueError(f"not a number of clusters: {mode}")
        if int(digits) <= 0:
            raise ValueError(f"the number of clusters must be positive: {mode}")
        return min(int(digits), n)
    if text == "sqrt":
        return max(1, isqrt(n))
    if text == "paper":
        raise NotImplementedError("the published table of cluster numbers is not a rule")
    raise ValueError(f"unknown mode: {mode}")


def seed_positions(n: int, k: int, seed: int = SEED) -> list[int]:
    """Positions of the rows that seed the clusters, in cluster order."""
    return np.random.RandomState(seed).choice(n, k, replace=False).tolist()
