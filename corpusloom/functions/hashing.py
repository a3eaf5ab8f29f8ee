"""Wrap-around hashes and hashed n-gram vectors, on Arrow batches with NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from corpusloom import constants as K

_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
_BLOCK = 4096
# powers of the multiplier, highest first, for one block of bytes
_POWERS = np.array([pow(K.HASH_MULT, _BLOCK - 1 - i, 1 << 32) for i in range(_BLOCK)], dtype=np.uint64)


def byte_hash(data) -> int:
    """h = h*33 + byte modulo 2^32, a block of bytes at a time."""
    codes = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    h = K.HASH_SEED
    for lo in range(0, len(codes), _BLOCK):
        part = codes[lo : lo + _BLOCK]
        n = len(part)
        value = int((part * _POWERS[_BLOCK - n :] & np.uint64(0xFFFFFFFF)).sum())
        h = (h * pow(K.HASH_MULT, n, 1 << 32) + value) & 0xFFFFFFFF
    return h


def base36(n: int) -> str:
    if n == 0:
        return "0"
    out = ""
    while n:
        n, r = divmod(n, 36)
        out = _DIGITS[r] + out
    return out


@F.arrow_udf(T.StringType())
def text_hash(s: pa.Array) -> pa.Array:
    """Hash of the UTF-8 bytes in base 36, as stored with chunks and notes. The bytes are read
    where the Arrow batch has them: no text becomes a Python object."""
    return pa.array([base36(byte_hash(t.as_buffer())) if t.is_valid else None for t in s], pa.string())


def ngram_vector(text: str) -> np.ndarray:
    """Unit vector of hashed character n-gram counts; all zeros for a blank text."""
    t = " ".join(text.lower().split())
    codes = np.frombuffer(t.encode("utf-16-le"), dtype=np.uint16).astype(np.int32)
    counts = np.zeros(K.VEC_DIM)
    h = np.full(len(codes), K.HASH_SEED, dtype=np.int32)
    for n in range(1, K.NGRAM_MAX + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        # a run of n characters is one of n - 1 and the next character; 32 bits wrap around
        h = h[:m] * np.int32(K.HASH_MULT) + codes[n - 1 :]
        if n >= K.NGRAM_MIN:
            # the size of the remainder with the sign of the hash: not the same as `h & 255`
            counts += np.bincount(np.abs(h).view(np.uint32) % np.uint32(K.VEC_DIM), minlength=K.VEC_DIM)
    norm = np.sqrt((counts * counts).sum())
    return (counts / norm if norm > 0 else counts).astype(np.float32)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def embed(s: pa.Array) -> pa.Array:
    """One text is a Python object at a time, and the vectors are one block of numbers."""
    out = np.zeros((len(s), K.VEC_DIM), np.float32)
    for i, t in enumerate(s):
        out[i] = ngram_vector(t.as_py() or "")
    return pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * K.VEC_DIM), pa.array(out.ravel()))
