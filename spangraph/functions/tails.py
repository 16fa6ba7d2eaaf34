"""Tail probabilities with numpy and the standard library only.

Student's t and F go through the continued fraction of the incomplete beta function, chi-square through
the incomplete gamma function; each is exact to about 1e-12 relative over the range used here.
"""

from __future__ import annotations

import math


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution function, by Newton steps from a logistic start."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    x = math.copysign(math.sqrt(max(0.0, -math.pi / 2 * math.log(4 * p * (1 - p)))), p - 0.5)
    for _ in range(60):
        err = (0.5 * math.erfc(-x / math.sqrt(2)) - p) * math.sqrt(2 * math.pi) * math.exp(x * x / 2)
        step = err / (1 + x * err / 2)
        x -= step
        if abs(step) < 1e-14 * max(1.0, abs(x)):
            break
    return x


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    value = d
    for m in range(1, 1000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def t_two_sided(t: float, df: float) -> float:
    return beta_tail(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_tail(x: float, df: float) -> float:
    """Upper tail of chi-square."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    value = d
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def chi2_of_p(p: float) -> float:
    """The one-df chi-square value whose upper tail is p."""
    return normal_quantile(p / 2) ** 2


def mixture_tail(q: float, weights) -> float:
    """Upper tail of a weighted sum of one-df chi-squares, by Imhof's inversion of the characteristic function."""
    import numpy as np

    lam = np.asarray([w for w in weights if w > 0], float)
    if not len(lam) or q <= 0:
        return 1.0 if q <= 0 else 0.0
    scale = lam.max()
    lam, q = lam / scale, q / scale
    if len(lam) == 1:
        return chi2_tail(q, 1)
    # u runs far enough for the integrand to fall below 1e-9; steps are fine against the oscillation in q
    top = 1.0
    while np.log(top) + 0.25 * np.log1p((lam * top) ** 2).sum() < 20 and top < 1e7:
        top *= 2
    edges = np.concatenate([[1e-12], np.arange(1, int(min(top, 4000) * max(1.0, q / 8)) + 2) / max(1.0, q / 8)])
    if edges[-1] < top:
        edges = np.concatenate([edges, np.geomspace(edges[-1], top, 20000)[1:]])
    nodes, gauss = np.polynomial.legendre.leggauss(8)
    total = 0.0
    for at in range(0, len(edges) - 1, 4096):
        a, b = edges[at : at + 4096][:, None], edges[at + 1 : at + 4097][:, None]
        a = a[: len(b)]
        u = (b - a) / 2 * nodes + (a + b) / 2
        lu = lam[:, None, None] * u
        angle = 0.5 * np.arctan(lu).sum(axis=0) - 0.5 * q * u
        size = u * np.exp(0.25 * np.log1p(lu**2).sum(axis=0))
        total += float(((b - a) / 2 * gauss * np.sin(angle) / size).sum())
    return min(1.0, max(0.0, 0.5 + total / math.pi))


def chi2_quantile(p: float, df: float) -> float:
    """The chi-square value whose upper tail is p, by bisection."""
    lo, hi = 0.0, max(df, 1.0)
    while chi2_tail(hi, df) > p and hi < 1e6:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_tail(mid, df) > p else (lo, mid)
    return (lo + hi) / 2


def _matched(weights) -> tuple[float, float, float]:
    """Mean, standard deviation and the degrees of freedom whose kurtosis is that of the weighted sum of chi-squares."""
    return sum(weights), math.sqrt(2 * sum(w**2 for w in weights)), sum(w**2 for w in weights) ** 2 / sum(w**4 for w in weights)


def moment_tail(q: float, weights) -> float:
    """Upper tail of a weighted sum of one-df chi-squares, by matching moments; cruder and faster than ``mixture_tail``."""
    mean, sd, df = _matched(weights)
    return chi2_tail((q - mean) / sd * math.sqrt(2 * df) + df, df)


def moment_quantile(p: float, weights) -> float:
    """The value whose ``moment_tail`` is p."""
    mean, sd, df = _matched(weights)
    return (chi2_quantile(p, df) - df) / math.sqrt(2 * df) * sd + mean


def cauchy_quantile(p: float) -> float:
    """The Cauchy quantile of 1 - p; below 1e-15 the tangent is its first term."""
    return math.tan((0.5 - min(p, 1 - 1e-15)) * math.pi) if p > 1e-15 else 1 / (max(p, 1e-300) * math.pi)


def cauchy_tail(value: float) -> float:
    return 0.5 - math.atan(value) / math.pi if value < 1e15 else 1 / (value * math.pi)


def cauchy(ps, weights=None) -> float:
    """One p-value from several, by the weighted mean of their Cauchy quantiles; valid whatever their dependence."""
    w = [1.0] * len(ps) if weights is None else list(weights)
    whole = sum(w)
    if not whole > 0:
        return math.nan
    return cauchy_tail(sum(v * cauchy_quantile(p) for p, v in zip(ps, w)) / whole)


def exact_tail(doses, rates, observed: float, most: int = 16) -> float | None:
    """P(|S| >= |observed|) for S the sum of dose x (outcome - rate) over independent 0/1 outcomes, by counting all of them; None past ``most`` carriers."""
    import numpy as np

    if len(doses) > most:
        return None
    value, chance = np.zeros(1), np.ones(1)
    for g, r in zip(doses, rates):
        value = np.concatenate([value - g * r, value + g * (1 - r)])
        chance = np.concatenate([chance * (1 - r), chance * r])
    return float(min(1.0, chance[np.abs(value) >= abs(observed) - 1e-9].sum()))


def classes_tail(doses, counts, rates, observed: float) -> float:
    """The same two-sided tail for carriers in classes of one whole-numbered dose and rate, counted for any number of them.

    Each class is a binomial variable. Every side of the tail is counted under the measure tilted so that its mean is the
    observed value, where the distribution of the sum comes by one Fourier transform on the lattice of doses, and
    is turned back; so tails far below the rounding of the transform keep their digits.
    """
    import numpy as np

    g, n, r = np.asarray(doses, np.int64), np.asarray(counts, np.int64), np.asarray(rates, float)
    live = (g != 0) & (n > 0) & (r > 0) & (r < 1)
    sure = float((g * n * (r >= 1)).sum())
    mean = float((g * n * r).sum())
    g, n, r = g[live], n[live], r[live]
    if not len(g):
        return 1.0 if abs(sure - mean) >= abs(observed) - 1e-9 else 0.0
    low, high = int((n * np.minimum(g, 0)).sum()), int((n * np.maximum(g, 0)).sum())
    size = 1 << int(high - low + 1).bit_length()
    turn = np.exp(2j * math.pi * np.outer(np.arange(size // 2 + 1), g) / size)
    shift = mean - sure  # of the lattice against the centred sum
    places = np.arange(low, high + 1)

    def tilted(t: float):
        return 1 / (1 + (1 - r) / r * np.exp(-np.clip(g * t, -500, 500)))

    def one(edge: float, up: bool) -> float:
        kept = places >= math.ceil(edge - 1e-9) if up else places <= math.floor(edge + 1e-9)
        if not kept.any():
            return 0.0
        first = float(places[kept][0 if up else -1])
        lo, hi = -60.0, 60.0
        for _ in range(100):  # the tilt that puts the mean on the edge of the tail, or as near as may be
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if float((g * n * tilted(mid)).sum()) < first else (lo, mid)
        t = max((lo + hi) / 2, 0.0) if up else min((lo + hi) / 2, 0.0)
        q = tilted(t)
        chance = np.fft.irfft(np.prod((1 - q + q * turn) ** n, axis=1).conj(), size)[places % size]
        logs = float((n * np.log1p(r * np.expm1(np.clip(g * t, -500, 500)))).sum())
        return float((np.maximum(chance[kept], 0) * np.exp(np.minimum(logs - t * places[kept], 700))).sum())

    upper, lower = one(shift + abs(observed), True), one(shift - abs(observed), False)
    return 1.0 if abs(observed) < 1e-12 else min(1.0, upper + lower)


def saddlepoint_tail(doses, rates, observed: float, counts=None) -> float:
    """The same two-sided tail by saddlepoint approximation; the normal tail where the observed value is near the mean.

    With ``counts`` an entry stands for so many carriers of one dose and rate.
    """
    import numpy as np

    g, r = np.asarray(doses, float), np.asarray(rates, float)
    k = np.ones(len(g)) if counts is None else np.asarray(counts, float)
    spread = float((k * g * g * r * (1 - r)).sum())
    if spread <= 0:
        return 1.0
    if abs(observed) < 2 * math.sqrt(spread):
        return normal_two_sided(observed / math.sqrt(spread))
    low, high = float((k * np.minimum(g * (1 - r), -g * r)).sum()), float((k * np.maximum(g * (1 - r), -g * r)).sum())

    def tilted(t: float):
        return r / (r + (1 - r) * np.exp(-np.clip(g * t, -500, 500)))

    def slope(t: float) -> float:
        return float((k * g * (tilted(t) - r)).sum())

    def one(s: float) -> float:
        """P(S >= s) for s > 0, P(S <= s) for s < 0."""
        edge = high if s > 0 else low
        if abs(s) >= abs(edge) - 1e-12:
            return float(np.prod(np.where((g > 0) == (s > 0), r, 1 - r) ** k)) if abs(s - edge) < 1e-9 else 0.0
        lo, hi = (0.0, 1.0) if s > 0 else (-1.0, 0.0)
        while s > 0 and slope(hi) < s and hi < 1e4:
            hi *= 2
        while s < 0 and slope(lo) > s and lo > -1e4:
            lo *= 2
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if slope(mid) < s else (lo, mid)
        t = (lo + hi) / 2
        p = tilted(t)
        logs = float((k * (np.log1p(r * np.expm1(np.clip(g * t, -500, 500))) - g * r * t)).sum())
        curve = float((k * g * g * p * (1 - p)).sum())
        w = math.copysign(math.sqrt(max(2 * (t * s - logs), 1e-300)), t)
        v = t * math.sqrt(max(curve, 1e-300))
        return 0.5 * math.erfc(abs(w + math.log(v / w) / w) / math.sqrt(2))

    return min(1.0, one(abs(observed)) + one(-abs(observed)))
