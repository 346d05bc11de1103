"""Tail probabilities and small numeric helpers that need no library beyond the standard one."""

from __future__ import annotations

import math


def chi2_tail(stat: float, df: int) -> float | None:
    """P(X > stat) for a chi-squared variable with an integer number of degrees of freedom.

    Even degrees are a Poisson sum, odd ones a complementary error function and
    a finite sum.  None for no degrees of freedom: nothing was compared.
    """
    if df <= 0:
        return None
    if stat <= 0:
        return 1.0
    half = stat / 2
    if df % 2 == 0:
        term = total = math.exp(-half)
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return min(1.0, total)
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for i in range(1, (df - 1) // 2 + 1):
        total += term
        term *= half / (i + 0.5)
    return min(1.0, total)


def homogeneity(a: list[list[float]], b: list[list[float]], kind: str = "chi2") -> tuple[float, int]:
    """Statistic and degrees of freedom that two count tables (rows: inputs, columns: outputs) share their row distributions.

    A row without counts on either side is no evidence and takes no degrees.
    """
    stat, used, width = 0.0, 0, len(a[0]) if a else 0
    for row_a, row_b in zip(a, b, strict=True):
        n_a, n_b = sum(row_a), sum(row_b)
        if not n_a or not n_b:
            continue
        used += 1
        for x, y in zip(row_a, row_b, strict=True):
            pooled = (x + y) / (n_a + n_b)
            for seen, n in ((x, n_a), (y, n_b)):
                expected = pooled * n
                if kind == "chi2" and expected:
                    stat += (seen - expected) ** 2 / expected
                elif kind == "G" and seen:
                    stat += 2 * seen * math.log(seen / expected)
    return stat, used * (width - 1)


def homogeneity_test(a: list[list[float]], b: list[list[float]], alpha: float = 0.001, kind: str = "chi2") -> tuple[bool, float | None]:
    """Whether equality is rejected, and the p-value (None, not rejected, if nothing could be compared)."""
    if kind not in ("chi2", "G"):
        raise ValueError(f"unknown test {kind!r}: chi2 or G")
    p = chi2_tail(*homogeneity(a, b, kind))
    return p is not None and p < alpha, p


def state_label(n: int) -> str:
    """0 to 25: A to Z; then the letter repeated (26: AA, 27: BB, 52: AAA)."""
    return chr(65 + n % 26) * (n // 26 + 1)


def significant(value: float, digits: int = 3) -> str:
    """A number with so many significant digits, a decimal point kept."""
    text = f"{value:.{digits}}"
    return text


def entropy(weights: list[float]) -> float:
    total = sum(weights)
    return -sum(w / total * math.log2(w / total) for w in weights if w > 0) + 0.0 if total else 0.0
