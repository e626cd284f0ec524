"""Largest eigenvalues and eigenvectors of a symmetric integer matrix without negative eigenvalues.

The characteristic polynomial is exact: its coefficients modulo many primes come from a Hessenberg form modulo
each prime (all primes of a batch at once in numpy) and are joined by Chinese remainders; a bound on the
coefficients says how many primes are enough. As all roots are real, the sign changes of the polynomial
shifted by t count its roots above t exactly (Descartes), multiple ones included; bisection by these counts
isolates roots, bisection by the sign narrows simple ones. Eigenvectors are inverse iterations in fixed-point
integers with the matrix less its root, whose null space they find.

All this depends on the dimension alone, never on the number of rows. ``whitening`` runs the primes as Spark
tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb, gcd, isqrt

import numpy as np

#: Roots are narrowed to this many bits of their size; closer ones count as one multiple root.
BITS = 110


def is_prime(n: int) -> bool:
    """For odd n below 2^32; the three bases decide these."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def enough_primes(size: int, trace: int) -> list[int]:
    """Primes below 2^31 whose product exceeds twice any coefficient.

    Coefficient k is a sum of products of k roots; with roots of at least 0 it is at most that of equal ones.
    """
    most = max(comb(size, k) * trace**k // max(size, 1) ** k + 1 for k in range(size + 1))
    primes, product, n = [], 1, 2**31 - 1
    while product <= 2 * most:
        if is_prime(n):
            primes.append(n)
            product *= n
        n -= 2
    return primes


def _inverse(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """a^(p - 2) modulo p; 0 for 0."""
    out, power, rest = np.ones_like(a), a % p, p - 2
    while rest.any():
        out = np.where(rest & 1, out * power % p, out)
        power, rest = power * power % p, rest >> 1
    return out


def polynomials_modulo(matrix: np.ndarray, primes: list[int]) -> np.ndarray:
    """Coefficients of det(x - matrix), the constant first, modulo each prime. ``matrix`` holds Python integers."""
    size, p = len(matrix), np.array(primes, np.int64)
    h = np.stack([(matrix % q).astype(np.int64) for q in primes])
    each, p2, p3 = np.arange(len(primes)), p[:, None], p[:, None, None]
    for k in range(1, size - 1):
        pivot = k + (h[:, k:, k - 1] != 0).argmax(1)
        h[each, pivot], h[:, k] = h[:, k].copy(), h[each, pivot].copy()
        h[each, :, pivot], h[:, :, k] = h[:, :, k].copy(), h[each, :, pivot].copy()
        factor = h[:, k + 1 :, k - 1] * _inverse(h[:, k, k - 1], p)[:, None] % p2
        h[:, k + 1 :] = (h[:, k + 1 :] - factor[:, :, None] * h[:, k, None, :]) % p3
        h[:, :, k] = (h[:, :, k] + (h[:, :, k + 1 :] * factor[:, None, :] % p3).sum(2)) % p2
    found = np.zeros((len(primes), size + 1, size + 1), np.int64)  # polynomial of each leading block
    found[:, 0, 0] = 1
    for k in range(1, size + 1):
        now = np.zeros((len(primes), size + 1), np.int64)
        now[:, 1:] = found[:, k - 1, :-1]
        now -= h[:, k - 1, k - 1, None] * found[:, k - 1] % p2
        chain = np.ones(len(primes), np.int64)
        factors = np.zeros((len(primes), max(k - 1, 0)), np.int64)
        for i in range(k - 1, 0, -1):
            chain = chain * h[:, i, i - 1] % p
            factors[:, i - 1] = chain * h[:, i - 1, k - 1] % p
        now -= (factors[:, :, None] * found[:, : k - 1] % p3).sum(1)
        found[:, k] = now % p2
    return found[:, size]


def chinese_remainders(residues: np.ndarray, primes: list[int]) -> list[int]:
    """The integers of smallest size with these residues, one for each column."""
    product = 1
    for q in primes:
        product *= q
    weights = [product // q * pow(product // q, -1, q) for q in primes]
    joined = [sum(int(r) * w for r, w in zip(column, weights)) % product for column in residues.T]
    return [x - product if 2 * x > product else x for x in joined]


@dataclass
class Root:
    """A root in (low, high] / 2^scale that ``times`` roots share as far as can be told."""

    low: int
    high: int
    scale: int
    times: int

    @property
    def middle(self) -> tuple[int, int]:
        return self.low + self.high, self.scale + 1


class RealRoots:
    """Roots of a polynomial (constant first) whose roots are all real and not negative."""

    def __init__(self, coefficients: list[int]) -> None:
        self.coefficients, self.degree = coefficients, len(coefficients) - 1

    def _scaled(self, scale: int) -> list[int]:
        return [c << (scale * (self.degree - k)) for k, c in enumerate(self.coefficients)]

    def above(self, place: int, scale: int = 0) -> int:
        """How many roots are larger than place / 2^scale."""
        shifted = self._scaled(scale)
        for i in range(self.degree):
            for k in range(self.degree - 1, i - 1, -1):
                shifted[k] += place * shifted[k + 1]
        signs = [c > 0 for c in shifted if c]
        return sum(a != b for a, b in zip(signs, signs[1:]))

    def positive(self, place: int, scale: int) -> int:
        """The sign of the polynomial there."""
        value = 0
        for c in reversed(self._scaled(scale)):
            value = value * place + c
        return (value > 0) - (value < 0)

    def largest(self, number: int) -> list[Root]:
        """Roots above 0 in falling order until they make up ``number`` (with their multiples) or there are no more."""
        found: list[Root] = []
        have, known = 0, self.above(0)
        top = 1 << max(1, (-self.coefficients[-2]).bit_length()) if self.degree else 1
        while have < min(number, known):
            root = self._narrow(have + 1, top)
            found.append(root)
            have += root.times
        return found

    def _narrow(self, order: int, top: int) -> Root:
        """The root of this order from above."""
        low, high, scale, over_low, over_high = 0, top, 0, self.above(0), 0
        while over_low - over_high > 1 and (low == 0 or high - low > low >> BITS):
            if high - low < 2:
                low, high, scale = low << 16, high << 16, scale + 16
            place = (low + high) // 2
            count = self.above(place, scale)
            if count >= order:
                low, over_low = place, count
            else:
                high, over_high = place, count
        below_high = None
        while low == 0 or high - low > low >> BITS:
            if high - low < 2:
                low, high, scale = low << 16, high << 16, scale + 16
            place = (low + high) // 2
            if below_high is None:  # just above the root the sign is that of an even or odd number of roots above
                below_high = 1 if over_high % 2 == 0 else -1
            sign = self.positive(place, scale)
            if sign == below_high or sign == 0:
                high = place
            else:
                low = place
        return Root(low, high, scale, over_low - over_high)


class Elimination:
    """LU form of a square matrix of fixed-point integers with ``bits`` after the point, rows exchanged."""

    def __init__(self, matrix: np.ndarray, bits: int) -> None:
        self.bits, self.a, self.order = bits, matrix.copy(), list(range(len(matrix)))
        a = self.a
        for k in range(len(a)):
            best = max(range(k, len(a)), key=lambda i: abs(a[i, k]))
            if best != k:
                a[[k, best]] = a[[best, k]]
                self.order[k], self.order[best] = self.order[best], self.order[k]
            if a[k, k] == 0:
                a[k, k] = 1  # the root is exact: the smallest number in its place
            if k + 1 < len(a):
                a[k + 1 :, k] = (a[k + 1 :, k] << bits) // a[k, k]
                a[k + 1 :, k + 1 :] -= np.multiply.outer(a[k + 1 :, k], a[k, k + 1 :]) >> bits

    def solve(self, right: np.ndarray) -> np.ndarray:
        x = right[self.order].copy()
        for k in range(len(x)):
            x[k + 1 :] -= (self.a[k + 1 :, k] * x[k]) >> self.bits
        for k in range(len(x) - 1, -1, -1):
            x[k] = (x[k] << self.bits) // self.a[k, k]
            x[:k] -= (self.a[:k, k] * x[k]) >> self.bits
        return x


def unit(vector: np.ndarray, bits: int) -> np.ndarray:
    length = isqrt(int((vector * vector).sum()))
    return np.array([(int(c) << bits) // max(length, 1) for c in vector], object)


def null_vectors(matrix: np.ndarray, root: Root) -> list[np.ndarray]:
    """``root.times`` orthogonal unit vectors (doubles) that the matrix only stretches by the root."""
    size = len(matrix)
    bits = 4 * BITS + max(int(abs(x)).bit_length() for x in matrix.ravel()) + size.bit_length()
    middle, scale = root.middle
    shifted = np.array([[int(x) << bits for x in row] for row in matrix], object)
    shifted[np.arange(size), np.arange(size)] -= (middle << bits) >> scale
    lu, found = Elimination(shifted, bits), []
    for start in range(root.times):
        signs = np.random.default_rng(start).integers(1, 1 << 30, size)
        vector = unit(np.array([int(s) for s in signs], object), bits)
        for _ in range(4):
            for other in found:
                vector = vector - ((other * ((vector * other).sum() >> bits)) >> bits)
            vector = unit(lu.solve(vector), bits)
        for other in found:
            vector = vector - ((other * ((vector * other).sum() >> bits)) >> bits)
        found.append(unit(vector, bits))
    out = []
    for vector in found:
        doubles = np.array([int(c) / (1 << bits) for c in vector])
        out.append(doubles * (1.0 if doubles[np.abs(doubles).argmax()] > 0 else -1.0))
    return out


def common_divisor(matrix: np.ndarray) -> int:
    return gcd(*(int(x) for x in matrix.ravel())) or 1
