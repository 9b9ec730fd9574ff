"""Operation counts of dense linear algebra in real double arithmetic (complex: multiplications count 6, additions 2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _either(condition, yes, no):
    """yes where the condition holds, else no; sizes may be numbers or columns."""
    return F.when(condition, yes).otherwise(no) if isinstance(condition, Column) else yes if condition else no


def _count(multiplications: float, additions: float, complex_: bool = False) -> float:
    return 6 * multiplications + 2 * additions if complex_ else multiplications + additions


def gemm(m, n, k, complex_=False):
    return _count(m * n * k, m * n * k, complex_)


def dot(m, complex_=False):
    return _count(m, m, complex_)


def trmm(side, m, n, complex_=False):
    k, w = (m, n) if side == "L" else (n, m)
    return _count(0.5 * w * k * (k + 1), 0.5 * w * k * (k - 1), complex_)


def trsm(side, m, n, complex_=False):
    return trmm(side, m, n, complex_)


def potrf(n, complex_=False):
    return _count(n * (n * n / 6 + n / 2 + 1 / 3), n * (n * n / 6 - 1 / 6), complex_)


def potrs(side, m, n, complex_=False):
    return 2 * trsm(side, m, n, complex_)


def trtri(n, complex_=False):
    return _count(n * (n * n / 6 + n / 2 + 1 / 3), n * (n * n / 6 - n / 2 + 1 / 3), complex_)


def lauum(n, complex_=False):
    return potrf(n, complex_)


def potri(n, complex_=False):
    return trtri(n, complex_) + lauum(n, complex_)


def potrf_potri(n, complex_=False):
    return potrf(n, complex_) + potri(n, complex_)


def posv(side, m, n, complex_=False):
    return potrf(n, complex_) + potrs(side, m, n, complex_)


def symm(side, m, n, complex_=False):
    return gemm(m, m, n, complex_) if side == "L" else gemm(m, n, n, complex_)


def syrk(k, n, complex_=False):
    return _count(0.5 * k * n * (n + 1), 0.5 * k * n * (n + 1), complex_)


# The fractions of the operation counts of QR factors.
def geqrf(m, n, complex_=False):
    tall = _count(n * (n * (0.5 - n / 3 + m) + m + 23 / 6), n * (n * (0.5 - n / 3 + m) + 5 / 6), complex_)
    wide = _count(m * (m * (-0.5 - m / 3 + n) + 2 * n + 23 / 6), m * (m * (-0.5 - m / 3 + n) + n + 5 / 6), complex_)
    return _either(m > n, tall, wide)


def orgqr(m, n, k, complex_=False):
    return _count(k * (2 * m * n + 2 * n - 5 / 3 + k * (2 / 3 * k - (m + n) - 1)), k * (2 * m * n + n - m + 1 / 3 + k * (2 / 3 * k - (m + n))), complex_)


def gemm_lr_lld(m, n, k, ra, rb, complex_=False):
    """A product of two low-rank tiles (ranks ra and rb, common side k) into a dense m x n tile: the inner ranks first, then outwards."""
    return gemm(ra, rb, k, complex_) + gemm(ra, n, rb, complex_) + gemm(m, n, ra, complex_)


def gemm_lr_lll(m, n, k, ra, rb, rc, complex_=False):
    """The same into a tile of rank rc: the product's factors, both QR factors of the joined ranks, their recompression
    and the new factors. The inner product counts over m, whatever k is."""
    r = rc + ra
    inner = gemm(ra, rb, m, complex_) + gemm(n, ra, rb, complex_)
    scaled = _count(n * rc, 0, complex_)
    factors = geqrf(m, r, complex_) + geqrf(n, r, complex_) + trmm("R", r, r, complex_)
    compressed = _count(r * r * r, 2 * (r * r * r), complex_)
    outer = orgqr(m, r, r, complex_) + orgqr(n, r, r, complex_) + gemm(m, r, r, complex_) + gemm(n, r, r, complex_)
    return inner + scaled + factors + compressed + outer


def evaluation(batches: int, m: int, padded: int | None = None) -> dict[str, float]:
    """GFLOP of one likelihood evaluation by stage."""
    padded = padded or -(-m // 32) * 32
    out = {"potrf": batches * potrf(m) / 1e9, "trsm": 2 * batches * trsm("L", padded, 1) / 1e9, "dot": 2 * batches * dot(m) / 1e9}
    return out | {"total": sum(out.values())}
