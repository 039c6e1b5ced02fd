"""Eigenvalues and eigenvectors of an integer matrix from its exact characteristic polynomial.

The matrix is symmetric and has no negative eigenvalue, like every scatter matrix. Its characteristic polynomial is
found modulo many primes and put together by Chinese remaindering. As all roots are real, the sign changes of a
shifted polynomial count the roots beyond the shift exactly, copies included; intervals are halved until each root is
alone or its interval is narrower than the precision asked for. Eigenvectors are the null space of the shifted matrix,
by inverse iteration in long fixed-point numbers.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np

PRECISION = 96  # bits of a root beyond its leading one
GUARD = 128  # further bits of the fixed-point numbers


def is_prime(n: int) -> bool:
    """Exact for n below 3.3e24: no composite number passes all of these bases."""
    bases = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
    if n < 2 or any(n % b == 0 for b in bases):
        return n in bases
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for b in bases:
        x = pow(b, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def bound(matrix: list[list[int]]) -> int:
    """No coefficient is larger: each is a sum of principal minors, and those are at most products of diagonal entries."""
    sums = [1]
    for i in range(len(matrix)):
        sums = [a + matrix[i][i] * b for a, b in zip([*sums, 0], [0, *sums], strict=True)]
    return max(sums)


def primes_for(limit: int) -> list[int]:
    """Primes below 2**31, from the largest down, whose product exceeds 2 * limit."""
    found, product, n = [], 1, (1 << 31) - 1
    while product <= 2 * limit:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def modular(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(x I - matrix) modulo p, lowest first: reduction to Hessenberg form, then its recurrence."""
    h = np.array([[x % p for x in row] for row in matrix], dtype=np.int64)
    n = len(h)
    for k in range(n - 2):
        held = np.flatnonzero(h[k + 1 :, k])
        if not len(held):
            continue
        pivot = k + 1 + int(held[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factors = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factors[:, None] * h[k + 1][None, :] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factors[None, :] % p).sum(axis=1)) % p
    polynomials = np.zeros((n + 1, n + 1), dtype=np.int64)
    polynomials[0, 0] = 1
    for k in range(n):
        grown = np.zeros(n + 1, dtype=np.int64)
        grown[1:] = polynomials[k, :-1]
        grown = (grown - polynomials[k] * h[k, k] % p) % p
        below = 1
        for i in range(k - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            if not below:
                break
            grown = (grown - polynomials[i] * (below * int(h[i, k]) % p) % p) % p
        polynomials[k + 1] = grown
    return polynomials[n].tolist()


def combined(residues: list[tuple[int, list[int]]]) -> list[int]:
    """The integers of least size with these remainders modulo each prime."""
    product = math.prod(p for p, _ in residues)
    parts = [(product // p) * pow(product // p, -1, p) for p, _ in residues]
    out = []
    for i in range(len(residues[0][1])):
        x = sum(part * values[i] for part, (_, values) in zip(parts, residues, strict=True)) % product
        out.append(x - product if 2 * x > product else x)
    return out


def _scaled(polynomial: list[int], shift: int) -> list[int]:
    """The polynomial whose roots are 2**shift times those of a monic one; below 0 only if it divides evenly."""
    n = len(polynomial) - 1
    return [c << shift * (n - i) for i, c in enumerate(polynomial)]


def roots_above(polynomial: list[int], at: int) -> int:
    """How many roots of a polynomial with real roots only are larger than ``at``, copies included."""
    c = list(polynomial)
    n = len(c) - 1
    for i in range(n):
        for j in range(n - 1, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _value(polynomial: list[int], at: int) -> int:
    out = 0
    for c in reversed(polynomial):
        out = out * at + c
    return out


def largest_roots(polynomial: list[int], most: int) -> list[tuple[Fraction, int]]:
    """The positive roots of a monic integer polynomial with real roots, none negative, from the largest on, and how
    many copies each has; as many as make ``most`` with copies, or fewer, if there are fewer.

    Each is known to PRECISION bits. Roots that agree in all of them count as copies.
    """
    zeros = next(i for i, c in enumerate(polynomial) if c)
    polynomial = polynomial[zeros:]
    if len(polynomial) == 1:
        return []
    high = 1 << max(1, (-polynomial[-2]).bit_length())  # the sum of all roots is smaller
    found: list[tuple[Fraction, int]] = []
    open_ = [(0, high, 0, 0, len(polynomial) - 1)]  # low, high, bits behind the point, roots above high, roots above low
    while open_:
        low, high, bits, above_high, above_low = open_.pop()
        if above_high == above_low or above_high >= most:
            continue
        if above_low - above_high == 1 and low:
            found.append((_refined(polynomial, low, high, bits, above_high), 1))
            continue
        if low and (high - low) << PRECISION <= low:
            found.append((Fraction(low + high, 2 << bits), above_low - above_high))
            continue
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        above = roots_above(_scaled(polynomial, bits), middle)
        open_ += [(low, middle, bits, above, above_low), (middle, high, bits, above_high, above)]
    return found


def _refined(polynomial: list[int], low: int, high: int, bits: int, above_high: int) -> Fraction:
    """The only root in (low, high], halved down by signs."""
    scaled = _scaled(polynomial, bits)
    before = -1 if above_high % 2 else 1  # the sign right of the root
    while (high - low) << PRECISION > low:
        if high - low == 1:
            step = max(1, PRECISION - low.bit_length() + 1)
            low, high, bits = low << step, high << step, bits + step
            scaled = _scaled(polynomial, bits)
        middle = (low + high) // 2
        value = _value(scaled, middle)
        if value == 0:
            return Fraction(middle, 1 << bits)
        if (value > 0) == (before > 0):
            high = middle
        else:
            low = middle
    return Fraction(low + high, 2 << bits)


def null_vectors(matrix: list[list[int]], root: Fraction, copies: int) -> np.ndarray:
    """Unit vectors, ``copies`` of them at right angles, that the matrix stretches by ``root``, as rows.

    (matrix - root I) is factored once in fixed-point numbers with row exchanges; solving with it again and again turns
    any start into the null space, as the root is known far better than the distance to the next one.
    """
    n = len(matrix)
    places = PRECISION + GUARD + max(0, -math.floor(math.log2(root))) if root else PRECISION + GUARD
    shift = (root.numerator << places) // root.denominator
    a = np.array([[x << places for x in row] for row in matrix], dtype=object).reshape(n, n)
    for i in range(n):
        a[i, i] -= shift
    order = np.arange(n)
    tiny = 1
    for k in range(n):
        pivot = k + max(range(n - k), key=lambda i: abs(a[k + i, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            order[[k, pivot]] = order[[pivot, k]]
        if not a[k, k]:
            a[k, k] = tiny
        factors = np.array([(x << places) // a[k, k] for x in a[k + 1 :, k]], dtype=object)
        if len(factors):
            a[k + 1 :, k + 1 :] -= (factors[:, None] * a[k, k + 1 :][None, :]) >> places
            a[k + 1 :, k] = factors
    out: list[np.ndarray] = []
    start = np.random.Generator(np.random.PCG64(4_099))
    for _ in range(copies):
        x = np.array([int(v) for v in start.integers(-(1 << 40), 1 << 40, n)], dtype=object) << (places - 40)
        for _ in range(4):
            x = _orthogonal(x, out, places)
            x = x[order]
            for k in range(n):
                x[k + 1 :] -= (a[k + 1 :, k] * x[k]) >> places
            for k in range(n - 1, -1, -1):
                x[k] = ((x[k] - (int((a[k, k + 1 :] * x[k + 1 :]).sum()) >> places if k + 1 < n else 0)) << places) // a[k, k]
            x = _unit(x, places)
        out.append(_unit(_orthogonal(x, out, places), places))
    return np.array([[int(v) / (1 << places) for v in x] for x in out]).reshape(copies, n)


def _unit(x: np.ndarray, places: int) -> np.ndarray:
    length = math.isqrt(sum(int(v) ** 2 for v in x)) or 1
    return np.array([(int(v) << places) // length for v in x], dtype=object)


def _orthogonal(x: np.ndarray, to: list[np.ndarray], places: int) -> np.ndarray:
    for other in to:
        along = sum(int(u) * int(v) for u, v in zip(x, other, strict=True)) >> places
        x = x - np.array([(along * int(v)) >> places for v in other], dtype=object)
    return x
