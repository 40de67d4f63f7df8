"""Ordered scans and iterative fits, one asset at a time in Arrow batches.

Each is a step or fit in plain Python with a DataFrame wrapper; the same step serves streams."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class DualKalman:
    """State (level, velocity) and parameters (drift, kappa, log sigma) filtered together."""

    RHO, NOISE, EPS = 0.9, 0.1, 1e-5

    def __init__(self, walk: float = 1e-3, sigma_obs: float = 0.01):
        self.q = (walk * walk, walk * walk / 10, walk * walk)
        self.r = sigma_obs * sigma_obs
        self.x, self.p = None, (1.0, 0.0, 1.0)
        self.theta, self.pi = [0.0, 0.05, math.log(1e-3)], (0.1, 0.0, 0.0, 0.1)
        self.mean = 0.0

    @staticmethod
    def _held(theta):
        return min(max(theta[0], -0.01), 0.01), min(max(theta[1], 0.001), 0.98), min(max(theta[2], -12.0), -1.0)

    def _level(self, theta):
        mu, kappa, _ = self._held(theta)
        return (1 - kappa) * self.x[0] + self.x[1] + kappa * self.mean + mu

    def step(self, z: float) -> tuple[float, float, float, float, float, float]:
        """level, velocity, drift, kappa, log predictive density, level variance."""
        if self.x is None:
            self.x, self.mean = (z, 0.0), z
            return z, 0.0, *self.theta[:2], 0.0, 1.0
        self.mean = 0.99 * self.mean + 0.01 * z
        t0, t1, t2 = self.theta
        mu, kappa, log_sigma = self._held(self.theta)
        a, b, c = self.p
        f, s2 = 1 - kappa, math.exp(2 * log_sigma)
        pa = f * f * a + 2 * f * b + c + s2
        pb = self.RHO * (f * b + c)
        pc = self.RHO * self.RHO * c + self.NOISE * s2
        x0, x1 = self._level(self.theta), self.RHO * self.x[1]
        e, s = z - x0, pa + self.r
        k0, k1 = pa / s, pb / s
        eps = self.EPS
        j0 = (self._level((t0 + eps, t1, t2)) - self._level((t0 - eps, t1, t2))) / (2 * eps)
        j1 = (self._level((t0, t1 + eps, t2)) - self._level((t0, t1 - eps, t2))) / (2 * eps)
        # the update matrix is [[1 - k0, -k0], [-k1, 1 - k1]]: a fixed rule, not the textbook's
        m00, m01 = (1 - k0) * pa - k0 * pb, (1 - k0) * pb - k0 * pc
        m10, m11 = (1 - k1) * pb - k1 * pa, (1 - k1) * pc - k1 * pb
        self.p = (
            m00 * (1 - k0) - m01 * k0 + k0 * k0 * self.r,
            m01 * (1 - k1) - m00 * k1 + k0 * k1 * self.r,
            m11 * (1 - k1) - m10 * k1 + k1 * k1 * self.r,
        )
        self.x = (x0 + k0 * e, x1 + k1 * e)
        # the level does not depend on log sigma, so its gain is zero and it keeps its start
        w00, w01, w10, w11 = self.pi[0] + self.q[0], self.pi[1], self.pi[2], self.pi[3] + self.q[1]
        h0, h1 = w00 * j0 + w01 * j1, w10 * j0 + w11 * j1
        d = max(j0 * h0 + j1 * h1 + s, 1e-30)
        g0, g1 = h0 / d, h1 / d
        self.theta = list(self._held((t0 + g0 * e, t1 + g1 * e, t2)))
        u0, u1 = j0 * w00 + j1 * w10, j0 * w01 + j1 * w11
        self.pi = (w00 - g0 * u0, w01 - g0 * u1, w10 - g1 * u0, w11 - g1 * u1)
        return *self.x, *self.theta[:2], -0.5 * (e * e / s + math.log(s) + math.log(2 * math.pi)), self.p[0]


class LinearKalman:
    """Level and velocity with F = [[1, 1], [0, 1]], started at 0 with unit covariance."""

    def __init__(self, q_level: float = 1e-4, q_velocity: float = 1e-7, r: float = 1e-3):
        self.q, self.r, self.x, self.p = (q_level, q_velocity), r, (0.0, 0.0), (1.0, 0.0, 1.0)

    def step(self, z: float) -> tuple[float, float]:
        a, b, c = self.p
        pa, pb, pc = a + 2 * b + c + self.q[0], b + c, c + self.q[1]
        x0, x1 = self.x[0] + self.x[1], self.x[1]
        k0, k1 = pa / (pa + self.r), pb / (pa + self.r)
        self.x = (x0 + k0 * (z - x0), x1 + k1 * (z - x0))
        self.p = ((1 - k0) * pa, (1 - k0) * pb, pc - k1 * pb)
        return self.x


def _scan(df: DataFrame, make, names: tuple[str, ...], value: str = "close") -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("open_time")
        step = make().step
        out = pd.DataFrame([step(v) for v in pdf[value].tolist()], columns=list(names), dtype=float)
        return pd.concat([pdf[["asset", "open_time"]].reset_index(drop=True), out], axis=1)

    return df.select("asset", "open_time", value).groupBy("asset").applyInPandas(run, "asset string, open_time long, " + ", ".join(f"{n} double" for n in names))


def dual_kalman(bars: DataFrame) -> DataFrame:
    return _scan(bars, DualKalman, ("level", "velocity", "drift", "kappa", "log_predictive", "level_variance"))


def linear_kalman(bars: DataFrame) -> DataFrame:
    return _scan(bars, LinearKalman, ("level", "velocity"))


# ---- fits -------------------------------------------------------------------------------------

def _lgamma(x: float) -> float:
    return math.lgamma(x)


def digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out, x = out - 1 / x, x + 1
    i = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


def student_t(r: np.ndarray, rounds: int = 200) -> dict[str, float]:
    """Location at the mean; scale and degrees of freedom (2.1 at least) by EM."""
    mu, s2, nu = float(r.mean()), float(r.var()) or 1e-12, 6.0
    d2 = (r - mu) ** 2
    for _ in range(rounds):
        w = (nu + 1) / (nu + d2 / s2)
        s2 = max(float((w * d2).mean()), 1e-300)
        c = 1 + float((np.log(w) - w).mean()) + digamma((nu + 1) / 2) - math.log((nu + 1) / 2)
        low, high = 2.1, 200.0
        for _ in range(60):  # the condition falls in nu
            nu = (low + high) / 2
            low, high = (nu, high) if -digamma(nu / 2) + math.log(nu / 2) + c > 0 else (low, nu)
    ll = len(r) * (_lgamma((nu + 1) / 2) - _lgamma(nu / 2) - 0.5 * math.log(nu * math.pi * s2)) - (nu + 1) / 2 * float(np.log1p(d2 / s2 / nu).sum())
    return {"location": mu, "scale": math.sqrt(s2), "nu": nu, "ll": ll, "aic": 6 - 2 * ll}


def cauchy(r: np.ndarray, rounds: int = 300) -> dict[str, float]:
    """Location and scale, from the median and half the quartile range, by reweighting."""
    s = np.sort(r)
    x0, g = float(np.median(r)), max(float(s[3 * len(s) // 4] - s[len(s) // 4]) / 2, 1e-12)
    best = (-math.inf, x0, g)
    for _ in range(rounds):
        z2 = ((r - x0) / g) ** 2
        ll = float(-(np.log(math.pi * g) + np.log1p(z2)).sum())
        best = max(best, (ll, x0, g))
        w = 1 / (1 + z2)
        x0 = float((w * r).sum() / w.sum())
        g = max(g * math.sqrt(float((2 * w * ((r - x0) / g) ** 2).mean())), 1e-12)
    return {"location": best[1], "scale": best[2], "nu": 1.0, "ll": best[0], "aic": 4 - 2 * best[0]}


def discrete(r: np.ndarray) -> dict[str, float]:
    """Density of the histogram by Scott's width with add-half smoothing; its AIC counts filled bins - 1."""
    w = 3.5 * max(float(r.std()), 1e-10) * len(r) ** (-1 / 3)
    low, span = float(r.min()) - w, float(r.max() - r.min()) + 2 * w
    bins = min(max(math.ceil(span / w), 5), 100)
    n = np.bincount(np.minimum(((r - low) / (span / bins)).astype(int), bins - 1))
    n = n[n > 0]
    ll = float((n * np.log((n + 0.5) / (len(r) + 0.5 * bins) / (span / bins))).sum())
    return {"ll": ll, "aic": 2.0 * (len(n) - 1) - 2 * ll}


def garch_variances(r: np.ndarray, omega: float, alpha: float, beta: float) -> np.ndarray:
    """h_t from the squared return of the same step, as the fixed rule has it."""
    h, out = float(r.var()), []
    for x in r.tolist():
        h = omega + alpha * x * x + beta * h
        out.append(h)
    return np.array(out)


def _garch_ll(r, omega, alpha, beta, nu) -> float:
    if omega <= 0 or alpha < 0 or beta < 0 or nu <= 2:
        return -math.inf
    h = garch_variances(r, omega, alpha, beta)
    if not (h > 0).all():
        return -math.inf
    c = _lgamma((nu + 1) / 2) - _lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
    return float((c - 0.5 * np.log(h) - (nu + 1) / 2 * np.log1p(r * r / h / (nu - 2))).sum())


def garch(r: np.ndarray, steps: int = 40) -> dict[str, float]:
    """GARCH(1,1) with t errors by coordinate search from (0.05 var, 0.10, 0.85, 6)."""
    p = [0.05 * float(r.var()), 0.10, 0.85, 6.0]
    best, width = _garch_ll(r, *p), 0.2
    for _ in range(steps):
        moved = False
        for i in range(4):
            for f in (1 + width, 1 / (1 + width)):
                q = list(p)
                q[i] *= f
                if q[1] + q[2] < 0.9999 and (ll := _garch_ll(r, *q)) > best:
                    best, p, moved = ll, q, True
        width = width if moved else width / 2
    h = garch_variances(r, *p[:3])
    return {"omega": p[0], "alpha": p[1], "beta": p[2], "nu": p[3], "ll": best, "forecast": p[0] + (p[1] + p[2]) * float(h[-1]), "unconditional": p[0] / (1 - p[1] - p[2])}


def hawkes_ll(times: np.ndarray, buy: np.ndarray, p) -> float:
    """Log likelihood of two mutually exciting processes, in one pass over the merged events."""
    mb, ms, bb, bs, sb, ss, beta = p
    rb = rs = last = ll = 0.0
    for t, is_buy in zip(times.tolist(), buy.tolist(), strict=True):
        d = math.exp(-beta * (t - last))
        rb, rs, last = rb * d, rs * d, t
        rate = mb + bb * rb + bs * rs if is_buy else ms + sb * rb + ss * rs
        if rate <= 0:
            return -math.inf
        ll += math.log(rate)
        rb, rs = rb + is_buy, rs + (not is_buy)
    end = times[-1]
    left = 1 - np.exp(-beta * (end - times))
    return ll - (mb + ms) * end - ((bb + sb) * left[buy].sum() + (bs + ss) * left[~buy].sum()) / beta


def hawkes(times: np.ndarray, buy: np.ndarray, steps: int = 30) -> dict[str, float]:
    """Rates and excitations by coordinate search; times in seconds from the first event's."""
    times = times - times[0]
    end = max(float(times[-1]), 1.0)
    p = [buy.sum() / end / 2, (~buy).sum() / end / 2, 0.3, 0.1, 0.1, 0.3, 1.0]
    best, width = hawkes_ll(times, buy, p), 0.3
    for _ in range(steps):
        moved = False
        for i in range(7):
            for f in (1 + width, 1 / (1 + width)):
                q = list(p)
                q[i] *= f
                if (ll := hawkes_ll(times, buy, q)) > best:
                    best, p, moved = ll, q, True
        width = width if moved else width / 2
    names = ("mu_buy", "mu_sell", "a_bb", "a_bs", "a_sb", "a_ss", "beta")
    return dict(zip(names, map(float, p), strict=True)) | {"ll": best, "cross": p[3] / p[2] if p[2] > 1e-10 else 0.0, "intensity_ofi": (p[0] - p[1]) / (p[0] + p[1]) if p[0] + p[1] > 1e-10 else 0.0}




def hmm(obs: np.ndarray, states: int = 4, rounds: int = 200, tolerance: float = 1e-6):
    """Baum-Welch with diagonal Gaussians from quantile starts: (pi, A, means, variances, ll)."""
    n, d = obs.shape
    order = np.argsort(obs[:, 0], kind="stable")
    parts = np.array_split(order, states)
    mean = np.array([obs[i].mean(axis=0) for i in parts])
    var = np.maximum(np.array([obs[i].var(axis=0) for i in parts]), 1e-10) + obs.var(axis=0) * 0.1 + 1e-10
    pi, a, last = np.full(states, 1 / states), np.full((states, states), 0.1 / (states - 1)), -math.inf
    np.fill_diagonal(a, 0.9)
    for _ in range(rounds):
        e = emissions(obs, mean, var)
        top = e.max(axis=1, keepdims=True)
        b = np.exp(e - top)
        alpha, beta, scale = np.zeros((n, states)), np.ones((n, states)), np.zeros(n)
        f = pi * b[0]
        for t in range(n):
            if t:
                f = (alpha[t - 1] @ a) * b[t]
            scale[t] = max(f.sum(), 1e-300)
            alpha[t] = f / scale[t]
        for t in range(n - 2, -1, -1):
            beta[t] = a @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
        ll = float(np.log(scale).sum() + top.sum())
        gamma = alpha * beta
        gamma /= np.maximum(gamma.sum(axis=1, keepdims=True), 1e-300)
        xi = a * (alpha[:-1].T @ (b[1:] * beta[1:] / scale[1:, None]))
        pi, a = gamma[0], xi / np.maximum(xi.sum(axis=1, keepdims=True), 1e-300)
        weight = np.maximum(gamma.sum(axis=0), 1e-300)[:, None]
        mean = gamma.T @ obs / weight
        var = np.maximum(gamma.T @ (obs * obs) / weight - mean * mean, 1e-10)
        if abs(ll - last) < tolerance:
            break
        last = ll
    return pi, a, mean, var, ll


def emissions(obs, mean, var) -> np.ndarray:
    return -0.5 * (((obs[:, None, :] - mean) ** 2 / var) + np.log(2 * math.pi * var)).sum(axis=2)


def viterbi(obs, pi, a, mean, var) -> np.ndarray:
    """The likeliest path; of equal maxima the last counts."""
    e, la = emissions(obs, mean, var), np.log(np.maximum(a, 1e-300))
    score, back = np.log(np.maximum(pi, 1e-300)) + e[0], np.zeros((len(obs), len(pi)), int)
    last_max = lambda m, axis: m.shape[axis] - 1 - np.flip(m, axis).argmax(axis)
    for t in range(1, len(obs)):
        m = score[:, None] + la
        back[t] = last_max(m, 0)
        score = m[back[t], np.arange(len(pi))] + e[t]
    path = [int(last_max(score, 0))]
    for t in range(len(obs) - 1, 0, -1):
        path.append(int(back[t][path[-1]]))
    return np.array(path[::-1])


def tree(x: np.ndarray, y: np.ndarray, depth: int, leaf: int = 5):
    """Exhaustive squared-error splits at midpoints: a leaf value or (feature, cut, low, high)."""
    best = None
    if depth and len(y) >= 2 * leaf:
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, s = x[order, j], np.cumsum(y[order])
            n = np.arange(1, len(y))
            gain = s[:-1] ** 2 / n + (s[-1] - s[:-1]) ** 2 / (len(y) - n)
            ok = (v[1:] > v[:-1]) & (n >= leaf) & (len(y) - n >= leaf)
            if ok.any():
                i = int(np.argmax(np.where(ok, gain, -np.inf)))
                if best is None or gain[i] > best[0] + 1e-12:
                    best = (gain[i], j, (v[i] + v[i + 1]) / 2)
    if best is None or best[0] <= y.sum() ** 2 / len(y) + 1e-12:
        return float(y.mean())
    low = x[:, best[1]] <= best[2]
    return best[1], float(best[2]), tree(x[low], y[low], depth - 1, leaf), tree(x[~low], y[~low], depth - 1, leaf)


def tree_values(t, x: np.ndarray) -> np.ndarray:
    if not isinstance(t, tuple):
        return np.full(len(x), t)
    return np.where(x[:, t[0]] <= t[1], tree_values(t[2], x), tree_values(t[3], x))


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 20, rate: float = 0.1, depth: int = 3):
    base, trees = float(y.mean()), []
    now = np.full(len(y), base)
    for _ in range(rounds):
        trees.append(tree(x, y - now, depth))
        now = now + rate * tree_values(trees[-1], x)
    return base, rate, trees


def boosted_values(model, x: np.ndarray) -> np.ndarray:
    base, rate, trees = model
    return base + rate * sum((tree_values(t, x) for t in trees), np.zeros(len(x)))


def by_asset(df: DataFrame, columns: list[str], order: str, fit, names: tuple[str, ...], least: int) -> DataFrame:
    """One row an asset: fit(arrays of columns in order) as a dict, nulls where rows are too few."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        got = fit(*(pdf[c].to_numpy() for c in columns)) if len(pdf) >= least else {}
        return pd.DataFrame([{"asset": pdf["asset"].iloc[0], "n": len(pdf)} | {k: got.get(k) for k in names}])

    return df.select("asset", *dict.fromkeys([order, *columns])).groupBy("asset").applyInPandas(run, "asset string, n long, " + ", ".join(f"{k} double" for k in names))
