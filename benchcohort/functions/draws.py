"""Numpy twins of the draws of :mod:`hashing` and :mod:`sampling`, for tasks that draw
many counts a row: the same numbers from the same streams, an array at a time.

Streams are arrays of uint32, whose sums and products wrap at 2^32 as the columns' do."""

from __future__ import annotations

import numpy as np

from .binomial import _HALF_LN_2PI, _LOG_FACT_SMALL, _SMALL
from .hashing import GOLDEN, M32, MIX, POISSON1_CUTS, TWO32
from .sampling import FEW, SEARCH, SMALL_MEAN, TRIES

COMMON = 6  # cuts below which most draws lie


def steps(i) -> np.ndarray:
    """What the i-th draws of a stream add to its base."""
    return (np.asarray(i, dtype=np.uint64) * np.uint64(GOLDEN) % np.uint64(M32)).astype(np.uint32)


def mix32(a: np.ndarray) -> np.ndarray:
    """The finaliser, in place."""
    t = np.empty_like(a)
    for _ in range(2):
        np.right_shift(a, 16, out=t)
        np.bitwise_xor(t, a, out=a)
        np.multiply(a, np.uint32(MIX), out=a)
    np.right_shift(a, 16, out=t)
    return np.bitwise_xor(t, a, out=a)


def stream(base: np.ndarray, i) -> np.ndarray:
    return mix32(base + steps(i))


def uniform(base: np.ndarray, i: int) -> np.ndarray:
    return (stream(base, i) + 0.5) / TWO32


def log_factorial(k: np.ndarray) -> np.ndarray:
    z = np.maximum(k, _SMALL) + 1.0
    stirling = ((z - 0.5) * np.log(z) - z + _HALF_LN_2PI + 1.0 / (12.0 * z) - 1.0 / (360.0 * z * z * z)
                + 1.0 / (1260.0 * z * z * z * z * z) - 1.0 / (1680.0 * z * z * z * z * z * z * z))
    return np.where(k < _SMALL, np.array(_LOG_FACT_SMALL)[np.clip(k, 0, _SMALL - 1).astype(np.intp)], stirling)


def poisson1(z: np.ndarray) -> np.ndarray:
    """Poisson(1) counts (uint8) of 32-bit draws."""
    w = (z >= np.uint32(POISSON1_CUTS[0])).view(np.uint8)
    for cut in POISSON1_CUTS[1:COMMON]:
        w += (z >= np.uint32(cut)).view(np.uint8)
    rare = np.nonzero(z >= np.uint32(POISSON1_CUTS[COMMON]))
    w[rare] += np.searchsorted(np.array(POISSON1_CUTS[COMMON:], dtype=np.uint32), z[rare], side="right").astype(np.uint8)
    return w


def _poisson_by_rejection(mean: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Counts of means above FEW, by the transformed rejection of :func:`sampling.poisson_draw`."""
    b = 0.931 + 2.53 * np.sqrt(mean)
    a, inverse, least = -0.059 + 0.02483 * b, 1.1239 + 1.1328 / (b - 3.4), 0.9277 - 3.6224 / (b - 2.0)
    out, left = np.floor(mean), np.arange(len(mean))
    for t in range(TRIES):
        m, bl, al, own = mean[left], b[left], a[left], base[left]
        u, v = uniform(own, 2 * t) - 0.5, uniform(own, 2 * t + 1)
        us = 0.5 - np.abs(u)
        k = np.floor((2.0 * al / us + bl) * u + m + 0.43)
        height = np.log(v) + np.log(inverse[left]) - np.log(al / (us * us) + bl)
        fits = (k >= 0) & ~((us < 0.013) & (v > us)) & (height <= -m + k * np.log(m) - log_factorial(k))
        taken = ((us >= 0.07) & (v <= least[left]) & (k >= 0)) | fits
        out[left[taken]] = k[taken]
        left = left[~taken]
        if not len(left):
            break
    return out


def poisson(mean: np.ndarray, base: np.ndarray) -> np.ndarray:
    """replicates x units: counts of whole-numbered means >= 1 (one a unit) from ``base`` (replicates x units)."""
    out = np.zeros(base.shape)
    few = mean <= FEW
    for i in range(1, int(mean[few].max(initial=0)) + 1):
        at = np.flatnonzero(few & (mean >= i))
        out[:, at] += poisson1(stream(base[:, at], i))
    many = np.flatnonzero(~few)
    if len(many):
        own = base[:, many]
        out[:, many] = _poisson_by_rejection(np.broadcast_to(mean[many].astype(float), own.shape).ravel(), own.ravel()).reshape(own.shape)
    return out


def _binomial_by_search(n: np.ndarray, p: np.ndarray, base: np.ndarray) -> np.ndarray:
    """n p < SMALL_MEAN and p <= 1/2, by adding up probabilities."""
    odds, u = p / (1.0 - p), uniform(base, 0)
    f, out, left = np.exp(n * np.log1p(-p)), np.zeros(len(n)), np.arange(len(n))
    for k in range(SEARCH):
        go = u[left] >= f[left]
        left = left[go]
        if not len(left):
            break
        u[left] -= f[left]
        out[left] += 1.0
        f[left] = f[left] * (n[left] - k) / (k + 1) * odds[left]
    return np.minimum(out, n)


def _binomial_by_rejection(n: np.ndarray, p: np.ndarray, base: np.ndarray) -> np.ndarray:
    """n p >= SMALL_MEAN and p <= 1/2, by the transformed rejection of :func:`sampling.binomial_draw`."""
    spread = np.sqrt(n * p * (1.0 - p))
    b = 1.15 + 2.53 * spread
    a, alpha = -0.0873 + 0.0248 * b + 0.01 * p, (2.83 + 5.1 / b) * spread
    mode, odds = np.floor((n + 1.0) * p), np.log(p / (1.0 - p))
    top = log_factorial(mode) + log_factorial(n - mode)
    out, left = mode.copy(), np.arange(len(n))
    for t in range(TRIES):
        al, bl, nl = a[left], b[left], n[left]
        u, v = uniform(base[left], 2 * t) - 0.5, uniform(base[left], 2 * t + 1)
        us = 0.5 - np.abs(u)
        k = np.floor((2.0 * al / us + bl) * u + nl * p[left] + 0.5)
        inside = (k >= 0) & (k <= nl)
        kk = np.clip(k, 0, nl)
        height = np.log(v * alpha[left] / (al / (us * us) + bl))
        fits = inside & (height <= top[left] - log_factorial(kk) - log_factorial(nl - kk) + (kk - mode[left]) * odds[left])
        taken = ((us >= 0.07) & (v <= 0.92 - 4.2 / bl) & (k >= 0)) | fits
        out[left[taken]] = k[taken]
        left = left[~taken]
        if not len(left):
            break
    return out


def binomial(n: np.ndarray, p: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Successes among n trials of probability p, element by element; arrays of one length."""
    turned = p > 0.5
    q = np.minimum(p, 1.0 - p)
    out = np.zeros(len(n))
    few = (n * q > 0) & (n * q < SMALL_MEAN)
    many = n * q >= SMALL_MEAN
    out[few] = _binomial_by_search(n[few], q[few], base[few])
    out[many] = _binomial_by_rejection(n[many], q[many], base[many])
    return np.where(turned, n - out, out)


def multinomial(w: np.ndarray, bases: np.ndarray) -> np.ndarray:
    """replicates x leaves: w.sum() draws of each replicate (its stream in ``bases``) onto leaves of weights w, by
    binomial draws along the binary digits of the leaf numbers."""
    depth = (len(w) - 1).bit_length()
    weights = [np.concatenate([w, np.zeros((1 << depth) - len(w))]).astype(float)]
    for level in range(depth - 1, -1, -1):
        weights.insert(0, weights[0][:1 << level] + weights[0][1 << level:])
    k = np.full((len(bases), 1), weights[0][0])
    for level in range(depth):
        half = 1 << level
        total, below = weights[level], weights[level + 1][:half]
        share = np.divide(below, total, out=np.zeros(half), where=total > 0)
        own = stream(bases[:, None], (np.arange(half) + half)[None, :])
        some = binomial(k.ravel(), np.broadcast_to(share, k.shape).ravel(), own.ravel()).reshape(k.shape)
        k = np.concatenate([some, k - some], axis=1)
    return k[:, :len(w)]


def picked_sums(values: np.ndarray, k: np.ndarray, bases: np.ndarray, leaf: int) -> np.ndarray:
    """Each replicate's sum of k values of a leaf, drawn with replacement."""
    own = stream(stream(bases, 0), leaf)
    of = np.repeat(np.arange(len(k)), k)
    j = np.arange(1, len(of) + 1) - np.repeat(np.cumsum(k) - k, k)
    at = mix32(own[of] + steps(j)) % np.uint32(len(values))
    return np.bincount(of, weights=values[at], minlength=len(k))
