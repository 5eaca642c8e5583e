"""Cipher backends of a two-party deployment.

`PlainCipher` packs vectors without encrypting them: it gives NO confidentiality
and exists to run and test the protocol.  `TensealCipher` wraps CKKS where the
tenseal package is installed.  Both exchange bytes only.

Keys are made once, by `key_pair`, and travel as bytes: the asking party's tasks
get the secret one, the answering party's the public one, which cannot decrypt.
A ciphertext of one pair means nothing to another.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Cipher(Protocol):
    confidential: bool

    def secret_context(self) -> bytes: ...
    def public_context(self) -> bytes: ...
    def encrypt(self, vector: np.ndarray) -> bytes: ...
    def decrypt(self, data: bytes) -> np.ndarray: ...
    def dot_plain(self, data: bytes, vector: np.ndarray) -> bytes: ...
    def dot(self, x: bytes, y: bytes) -> bytes: ...
    def matmul_plain(self, data: bytes, matrix: np.ndarray) -> bytes: ...
    def add_plain(self, data: bytes, vector: np.ndarray) -> bytes: ...
    def mul_plain(self, data: bytes, vector: np.ndarray) -> bytes: ...


def _same(x: np.ndarray, y: np.ndarray) -> None:
    if x.shape[-1] != y.shape[0]:
        raise ValueError(f"lengths differ: {x.shape[-1]} and {y.shape[0]}")


class PlainCipher:
    """Little-endian doubles; no confidentiality."""

    confidential = False

    def __init__(self, context: bytes | None = None):
        pass

    def secret_context(self) -> bytes:
        return b"plain"

    def public_context(self) -> bytes:
        return b"plain"

    def encrypt(self, vector: np.ndarray) -> bytes:
        return np.atleast_1d(np.asarray(vector, "<f8")).tobytes()

    def decrypt(self, data: bytes) -> np.ndarray:
        if not isinstance(data, bytes):
            raise TypeError("ciphertexts cross the boundary as bytes")
        return np.frombuffer(data, "<f8")

    def dot_plain(self, data: bytes, vector: np.ndarray) -> bytes:
        x, y = self.decrypt(data), np.asarray(vector, np.float64)
        _same(x, y)
        return self.encrypt(x @ y)

    def dot(self, x: bytes, y: bytes) -> bytes:
        return self.dot_plain(x, self.decrypt(y))

    def matmul_plain(self, data: bytes, matrix: np.ndarray) -> bytes:
        x, m = self.decrypt(data), np.asarray(matrix, np.float64)
        _same(x, m)
        return self.encrypt(x @ m)

    def add_plain(self, data: bytes, vector: np.ndarray) -> bytes:
        return self.encrypt(self.decrypt(data) + vector)

    def mul_plain(self, data: bytes, vector: np.ndarray) -> bytes:
        return self.encrypt(self.decrypt(data) * vector)


class TensealCipher:
    """CKKS, polynomial degree 8192, moduli 60-40-40-60, scale 2^40; needs tenseal."""

    confidential = True

    def __init__(self, context: bytes | None = None):
        import tenseal as ts

        self.ts = ts
        if context is None:
            self.context = ts.context(ts.SCHEME_TYPE.CKKS, poly_modulus_degree=8192, coeff_mod_bit_sizes=[60, 40, 40, 60])
            self.context.global_scale = 2**40
            self.context.generate_galois_keys()
        else:
            self.context = ts.context_from(context)

    def secret_context(self) -> bytes:
        return self.context.serialize(save_secret_key=True)

    def public_context(self) -> bytes:
        return self.context.serialize(save_secret_key=False)

    def encrypt(self, vector: np.ndarray) -> bytes:
        return self.ts.ckks_vector(self.context, np.atleast_1d(vector).astype(float).tolist()).serialize()

    def _load(self, data: bytes):
        if not isinstance(data, bytes):
            raise TypeError("ciphertexts cross the boundary as bytes")
        return self.ts.ckks_vector_from(self.context, data)

    def decrypt(self, data: bytes) -> np.ndarray:
        return np.array(self._load(data).decrypt())

    def dot_plain(self, data: bytes, vector: np.ndarray) -> bytes:
        return self._load(data).dot(list(map(float, vector))).serialize()

    def dot(self, x: bytes, y: bytes) -> bytes:
        return self._load(x).dot(self._load(y)).serialize()

    def matmul_plain(self, data: bytes, matrix: np.ndarray) -> bytes:
        return self._load(data).matmul(np.asarray(matrix, float).tolist()).serialize()

    def add_plain(self, data: bytes, vector: np.ndarray) -> bytes:
        return (self._load(data) + list(map(float, vector))).serialize()

    def mul_plain(self, data: bytes, vector: np.ndarray) -> bytes:
        return (self._load(data) * list(map(float, vector))).serialize()


#: Schemes by name; each is made from the bytes of a context, or without any with new keys.
SCHEMES: dict[str, type] = {"plain": PlainCipher, "tenseal": TensealCipher}


@dataclass(frozen=True)
class Key:
    """A scheme (its name, or a class like those above), and the context of one party as bytes."""

    scheme: str | type
    context: bytes


def key_pair(scheme: str | type = "plain") -> tuple[Key, Key]:
    """(secret, public) keys of a new context."""
    made = _scheme(scheme)()
    return Key(scheme, made.secret_context()), Key(scheme, made.public_context())


def _scheme(scheme: str | type) -> type:
    if isinstance(scheme, str) and scheme not in SCHEMES:
        raise ValueError(f"unknown cipher backend {scheme}")
    return SCHEMES[scheme] if isinstance(scheme, str) else scheme


def backend(key: str | Key = "plain") -> Cipher:
    """The cipher of a key; by its name alone only a scheme that has no keys."""
    if isinstance(key, Key):
        return _scheme(key.scheme)(key.context)
    if _scheme(key).confidential:
        raise ValueError(f"{key} needs a key, which key_pair makes once for all tasks")
    return _scheme(key)()


def encrypted(vector: Column, name: str | Key = "plain") -> Column:
    """ARRAY<DOUBLE> to BINARY."""
    def run(s: pd.Series) -> pd.Series:
        cipher = backend(name)
        return s.map(lambda v: cipher.encrypt(np.asarray(v, float)))

    return F.pandas_udf(run, "binary")(vector)


def decrypted(data: Column, name: str | Key = "plain") -> Column:
    """BINARY to ARRAY<DOUBLE>."""
    def run(s: pd.Series) -> pd.Series:
        cipher = backend(name)
        return s.map(lambda b: cipher.decrypt(bytes(b)))

    return F.pandas_udf(run, "array<double>")(data)


def error_probe(cipher: Cipher, trials: int = 100, width: int = 50, seed: int = 0) -> dict[str, dict[str, float]]:
    """Mean, deviation, maximum and median of the error of a round trip, a ct-pt and a ct-ct product."""
    draw = np.random.default_rng(seed)
    errors: dict[str, list[float]] = {"round_trip": [], "ct_pt": [], "ct_ct": []}
    for _ in range(trials):
        x, y = draw.normal(size=(2, width))
        x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
        cx, cy = cipher.encrypt(x), cipher.encrypt(y)
        errors["round_trip"].append(float(np.abs(cipher.decrypt(cx) - x).max()))
        errors["ct_pt"].append(float(abs(cipher.decrypt(cipher.dot_plain(cx, y))[0] - x @ y)))
        errors["ct_ct"].append(float(abs(cipher.decrypt(cipher.dot(cx, cy))[0] - x @ y)))
    return {k: {"mean": float(np.mean(v)), "std": float(np.std(v)), "max": float(np.max(v)), "median": float(np.median(v))} for k, v in errors.items()}


def sign_stability(scores: np.ndarray, tau: float, noise: float = 1e-6, seed: int = 0) -> int:
    """How many decisions a noise of at most `noise` turns over, for scores near tau."""
    moved = scores + np.random.default_rng(seed).uniform(-noise, noise, len(scores))
    return int(((scores - tau > noise) != (moved - tau > noise)).sum())


def error_study(cipher: Cipher, samples: int = 1000, width: int = 50, tau: float = 0.9, trials: int = 20, seed: int = 0) -> dict[str, dict[str, float]]:
    """Errors of ct-pt and ct-ct products of unit vectors, and how often the decision turns over for scores within 0.05 of tau.

    Half of the pairs are drawn near tau, so that the last part is never empty.
    """
    draw = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v)
    errors: dict[str, list[float]] = {"ct_pt_abs_error": [], "ct_ct_abs_error": [], "threshold_failure_rate": []}
    for i in range(samples):
        x, y = unit(draw.normal(size=width)), unit(draw.normal(size=width))
        if i % 2:
            y = unit(y - (x @ y) * x)
            cos = tau + draw.uniform(-0.05, 0.05)
            y = cos * x + np.sqrt(max(1 - cos * cos, 0)) * y
        true, cx = float(x @ y), cipher.encrypt(x)
        errors["ct_pt_abs_error"].append(abs(float(cipher.decrypt(cipher.dot_plain(cx, y))[0]) - true))
        errors["ct_ct_abs_error"].append(abs(float(cipher.decrypt(cipher.dot(cx, cipher.encrypt(y)))[0]) - true))
        if abs(true - tau) < 0.05:
            score = cipher.encrypt(np.array([true]))
            seen = [float(cipher.decrypt(cipher.mul_plain(cipher.add_plain(score, np.array([-tau])), np.array([draw.uniform(1, 10)])))[0]) for _ in range(trials)]
            errors["threshold_failure_rate"].append(float(np.mean([(v > 0) != (true > tau) for v in seen])))
    stats = lambda v: {"mean": float(np.mean(v)), "std": float(np.std(v)), "max": float(np.max(v)), "median": float(np.median(v))} if v else dict.fromkeys(("mean", "std", "max", "median"), 0.0)
    return {k: stats(v) for k, v in errors.items()}


def study_report(study: dict[str, dict[str, float]]) -> str:
    """The study as lines of text."""
    lines = [f"{part}: " + ", ".join(f"{k} {v:.6e}" for k, v in values.items()) for part, values in study.items()]
    stable = study["threshold_failure_rate"]["max"] == 0
    return "\n".join([*lines, "no decision turned over" if stable else "some decisions turned over: raise the scale or lower the depth"])
