"""Numerics over one regular series: arrays of doubles with NaN for cells without a value.

Plain numpy, called on executors batch by batch and in tests directly. Each function takes the cells first.
"""

from __future__ import annotations

import math

import numpy as np

Cells = np.ndarray


def known(a: Cells) -> np.ndarray:
    return np.flatnonzero(~np.isnan(a))


def _between(a: Cells, at: np.ndarray) -> Cells:
    """Gaps on the line y0 + (y1 - y0) * part, rounded in this order; ends held."""
    i = np.arange(len(a))
    after = np.searchsorted(at, i)
    lo, hi = at[np.maximum(after - 1, 0)], at[np.minimum(after, len(at) - 1)]
    out = np.where(np.isnan(a), a[lo], a)
    inner = np.isnan(a) & (lo < hi)
    i, lo, hi = i[inner], lo[inner], hi[inner]
    out[inner] = a[lo] + (a[hi] - a[lo]) * ((i - lo) / (hi - lo))
    return out


def _filled(a: Cells) -> Cells:
    """For what needs every cell: gaps are interpolated, ends held."""
    at = known(a)
    return a.copy() if len(at) in (0, len(a)) else _between(a, at)


# --- fills


def fill_forward(a: Cells, limit: int | None = None) -> Cells:
    last = np.maximum.accumulate(np.where(np.isnan(a), -1, np.arange(len(a))))
    out = np.where(last >= 0, a[last], np.nan)
    return out if limit is None else np.where(np.arange(len(a)) - last <= limit, out, np.nan)


def fill_backward(a: Cells, limit: int | None = None) -> Cells:
    return fill_forward(a[::-1], limit)[::-1]


def fill_linear(a: Cells) -> Cells:
    at = known(a)
    if len(at) < 2:
        return a.copy()
    out = _between(a, at)
    out[: at[0]] = out[at[-1] + 1 :] = np.nan
    return out


def fill_const(a: Cells, value: float = 0.0) -> Cells:
    return np.where(np.isnan(a), value, a)


def fill_spline(a: Cells) -> Cells:
    """Natural cubic spline between known cells: second derivatives from a tridiagonal system, 0 at both ends."""
    x = known(a)
    n = len(x)
    if n < 3:
        return fill_linear(a)
    y, h = a[x], np.diff(x).astype(float)
    m = np.zeros(n)
    diagonal, upper, right = np.empty(n), np.empty(n), np.empty(n)
    diagonal[0], upper[0], right[0] = 1, 0, 0
    for i in range(1, n - 1):
        d = 2 * (h[i - 1] + h[i]) - h[i - 1] * upper[i - 1]
        upper[i] = h[i] / d
        right[i] = (6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1]) - h[i - 1] * right[i - 1]) / d
    for i in range(n - 2, 0, -1):
        m[i] = right[i] - upper[i] * m[i + 1]
    out = a.copy()
    for c in np.flatnonzero(np.isnan(a)):
        i = int(np.searchsorted(x, c)) - 1
        if 0 <= i < n - 1:
            u, w = (x[i + 1] - c) / h[i], (c - x[i]) / h[i]
            out[c] = u * y[i] + w * y[i + 1] + h[i] ** 2 / 6 * ((u**3 - u) * m[i] + (w**3 - w) * m[i + 1])
    return out


# --- recurrences and filters


def iir(a: Cells, num: list[float], den: list[float]) -> Cells:
    """y[i] = (sum num[k] x[i-k] - sum den[k] y[i-k], k >= 1) / den[0]; a cell without a value has none and is passed over."""
    out = np.full(len(a), np.nan)
    xs: list[float] = []
    ys: list[float] = []
    for i in known(a):
        xs.append(a[i])
        y = sum(b * x for b, x in zip(num, reversed(xs[-len(num) :]))) - sum(c * y for c, y in zip(den[1:], reversed(ys[-(len(den) - 1) :] if len(den) > 1 else [])))
        ys.append(y / den[0])
        out[i] = ys[-1]
    return out


def _ema_once(a: Cells, alpha: float) -> Cells:
    out, s = np.full(len(a), np.nan), math.nan
    for i in known(a):
        s = a[i] if math.isnan(s) else alpha * a[i] + (1 - alpha) * s
        out[i] = s
    return out


def ema(a: Cells, alpha: float | None = None, span: float | None = None, order: int = 1) -> Cells:
    """Exponential moving average begun at the first value; order 2 and 3 are the double and triple ones."""
    alpha = 2 / (span + 1) if alpha is None else alpha
    e1 = _ema_once(a, alpha)
    if order == 1:
        return e1
    e2 = _ema_once(e1, alpha)
    return 2 * e1 - e2 if order == 2 else 3 * e1 - 3 * e2 + _ema_once(e2, alpha)


def exp_smooth(a: Cells, alpha: float = 0.5) -> Cells:
    return _ema_once(a, alpha)


def time_decayed(a: Cells, half_life: float, kind: str = "sum", step: float = 1.0) -> Cells:
    """Sum, count, average or maximum of the values so far, each halved for every half-life gone by."""
    keep = 0.5 ** (step / half_life)
    out = np.full(len(a), np.nan)
    total = weight = 0.0
    top = -math.inf
    for i, x in enumerate(a):
        total, weight, top = total * keep, weight * keep, top * keep
        if not math.isnan(x):
            total, weight, top = total + x, weight + 1, max(top, x)
        if weight:
            out[i] = {"sum": total, "count": weight, "avg": total / weight, "max": top}[kind]
    return out


def fir(a: Cells, weights: list[float], normalize: bool = True, center: bool = False) -> Cells:
    """Weighted sum over a moving window; cells without a value, and those beyond the ends, weigh nothing."""
    w = np.asarray(weights, float)
    shift = len(w) // 2 if center else len(w) - 1
    x, seen = np.nan_to_num(a), (~np.isnan(a)).astype(float)
    pad = (shift, len(w) - 1 - shift)
    run = lambda s: np.convolve(np.pad(s, pad), w[::-1], "valid")
    total, used = run(x), run(seen)
    out = np.divide(total, used, out=np.full(len(a), np.nan), where=used != 0) if normalize else total
    return np.where(run(seen) != 0, out, np.nan)


# --- spectra and correlation


def fft(a: Cells) -> dict[str, Cells]:
    z = np.fft.fft(_filled(a))
    return {"re": z.real, "im": z.imag}


def ifft(re: Cells, im: Cells) -> dict[str, Cells]:
    z = np.fft.ifft(re + 1j * im)
    return {"re": z.real, "im": z.imag}


def _acf(x: Cells) -> Cells:
    x = x - x.mean()
    n = len(x)
    size = 1 << (2 * n - 1).bit_length()
    power = np.fft.rfft(x, size)
    c = np.fft.irfft(power * power.conj(), size)[:n]
    return c / c[0] if c[0] > 0 else np.r_[1.0, np.zeros(n - 1)]


def acf(a: Cells, max_lag: int | None = None) -> Cells:
    """Autocorrelation by lag with denominator n."""
    return _acf(_filled(a))[: None if max_lag is None else max_lag + 1] if len(a) else a


def ccf(a: Cells, b: Cells, max_lag: int) -> dict:
    """Correlation of a[i + lag] with b[i] for lag -max_lag..max_lag, denominators n, and the lag where it is largest."""
    x, y = _filled(a) - _filled(a).mean(), _filled(b) - _filled(b).mean()
    scale = math.sqrt(float((x @ x) * (y @ y)))
    lags = np.arange(-max_lag, max_lag + 1)
    n = len(x)
    out = np.array([(x[max(0, k) : n + min(0, k)] @ y[max(0, -k) : n - max(0, k)]) / scale if scale and abs(k) < n else 0.0 for k in lags])
    return {"values": out, "lag": int(lags[int(np.argmax(out))])}


def periods_detect(a: Cells, lowest: int = 2, highest: int | None = None, most: int = 3) -> dict:
    """Periods at peaks of the autocorrelation that a strong frequency suggests, with the autocorrelation as score."""
    x = _filled(a)
    n = len(x)
    highest = n // 2 if highest is None else min(highest, n // 2)
    if n < 4 or highest < lowest:
        return {"periods": [], "scores": []}
    r = _acf(x)
    power = np.abs(np.fft.rfft(x - x.mean())) ** 2
    found: dict[int, float] = {}
    for k in np.argsort(-power[1:])[: 4 * most] + 1:
        near = n / k
        lo, hi = max(lowest, int(n / (k + 0.5))), min(highest, math.ceil(n / max(k - 0.5, 0.5)))
        if lowest <= near <= highest + 0.5 and lo <= hi:
            p = lo + int(np.argmax(r[lo : hi + 1]))
            if 0 < p < n - 1 and r[p] >= r[p - 1] and r[p] >= r[p + 1] and r[p] > 0:
                found[p] = float(r[p])
    best = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:most]
    return {"periods": [p for p, _ in best], "scores": [s for _, s in best]}


def periods_validate(a: Cells, periods: list[int]) -> list[float]:
    r = _acf(_filled(a))
    return [float(max(0.0, r[p])) if 0 < p < len(r) else 0.0 for p in periods]


# --- decomposition


def _line(x: Cells) -> Cells:
    at = known(x)
    if len(at) < 2:
        return np.full(len(x), x[at[0]] if len(at) else np.nan)
    t = at - at.mean()
    slope = (t @ (x[at] - x[at].mean())) / (t @ t)
    return x[at].mean() + slope * (np.arange(len(x)) - at.mean())


def _phases(x: Cells, period: int) -> Cells:
    means = np.array([np.nanmean(x[p::period]) if (~np.isnan(x[p::period])).any() else 0.0 for p in range(min(period, len(x)))])
    return (means - means.mean())[np.arange(len(x)) % period]


def decompose_additive(a: Cells, period: int) -> dict[str, Cells]:
    """Seasonal: means by phase of what a line leaves, centred. Trend: the line through the rest."""
    first = _line(a)
    seasonal = _phases(a - first, period)
    trend = _line(a - seasonal)
    return {"seasonal": seasonal, "trend": trend, "residual": a - seasonal - trend, "baseline": seasonal + trend}


def seasonal(a: Cells, period: int) -> Cells:
    return _phases(a - _line(a), period)


def decompose_forecast(a: Cells, period: int, points: int) -> Cells:
    """The baseline carried on for so many points."""
    d = decompose_additive(a, period)
    trend, n = d["trend"], len(a)
    slope = trend[1] - trend[0] if n > 1 else 0.0
    ahead = np.arange(1, points + 1)
    return trend[-1] + slope * ahead + d["seasonal"][(n - 1 + ahead) % period if n >= period else np.zeros(points, int)]


#: So many cells of windows are held at once.
LOESS_CELLS = 1_000_000


def loess(y: Cells, span: int, degree: int = 1, weights: Cells | None = None, at: Cells | None = None) -> Cells:
    """Local regression with tricube weights over the ``span`` nearest points; of many series at once where ``y`` has them as rows."""
    n = y.shape[-1]
    x = np.arange(n, dtype=float)
    at = x if at is None else at
    q = min(span, n)
    most = max(1, LOESS_CELLS // max(1, q * (y.size // max(1, n))))
    if len(at) > most:
        return np.concatenate([loess(y, span, degree, weights, at[i : i + most]) for i in range(0, len(at), most)], -1)
    # The window of each place, moved right while its far neighbour there is nearer.
    lo = np.clip(np.round(at) - q // 2, 0, n - q).astype(int)
    while len(move := np.flatnonzero((lo + q < n) & (np.minimum(lo + q, n - 1) - at < at - lo))):
        lo[move] += 1
    xs = lo[:, None] + np.arange(q)
    d = np.abs(xs - at[:, None])
    h = np.maximum(d.max(1) * (span / q if span > n else 1.0), 1e-12)
    w = np.clip(1 - (d / (h * 1.0000001)[:, None]) ** 3, 0, None) ** 3
    ys = y[..., xs]
    if weights is not None:
        w = w * weights[..., xs]
    total = w.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mx, my = (w * xs).sum(-1) / total, (w * ys).sum(-1) / total
        dx = xs - mx[..., None]
        sxx = (w * dx**2).sum(-1)
        out = my if degree == 0 else np.where(sxx < 1e-12, my, my + (w * (dx * (ys - my[..., None]))).sum(-1) / sxx * (at - mx))
    return np.where(total <= 0, ys.mean(-1), out)


def decompose_stl(a: Cells, period: int, seasonal_span: int = 7, trend_span: int | None = None, inner: int = 2, outer: int = 1) -> dict[str, Cells]:
    """Cleveland's STL: cycle-subseries smoothing, a low-pass filter, loess for the trend, and robustness weights.

    Rows of ``a`` are series of one length, which are smoothed together.
    """
    n = a.shape[-1]
    y = np.apply_along_axis(_filled, -1, a) if a.size else a.copy()
    if n < 2 * period:
        trend = np.apply_along_axis(_line, -1, y) if a.size else y
        return {"seasonal": np.zeros(a.shape), "trend": trend, "residual": a - trend}
    trend_span = trend_span or int(math.ceil(1.5 * period / (1 - 1.5 / seasonal_span))) | 1
    low = period | 1
    trend, season, robust = np.zeros(a.shape), np.zeros(a.shape), None
    for round_ in range(max(1, outer)):
        for _ in range(inner):
            free = y - trend
            cycle = np.empty((*a.shape[:-1], n + 2 * period))
            for p in range(period):
                part = free[..., p::period]
                m = part.shape[-1]
                smoothed = loess(part, seasonal_span, 1, None if robust is None else robust[..., p::period], np.arange(-1.0, m + 1))
                cycle[..., p::period] = smoothed[..., : cycle[..., p::period].shape[-1]]
            smooth = lambda x, k: np.lib.stride_tricks.sliding_window_view(x, k, -1).sum(-1) / k
            passed = loess(smooth(smooth(smooth(cycle, period), period), 3), low)
            season = cycle[..., period : period + n] - passed
            trend = loess(y - season, trend_span, 1, robust)
        if round_ + 1 < outer:
            rest = np.abs(y - season - trend)
            h = 6 * np.median(rest, -1, keepdims=True)
            robust = np.where(h > 0, np.clip(1 - (rest / np.where(h > 0, h, 1)) ** 2, 0, None) ** 2, 1.0)
    return {"seasonal": season, "trend": trend, "residual": a - season - trend}


def holt_winters(a: Cells, alpha: float, beta: float, gamma: float, period: int, horizon: int, band: float = 2.0) -> dict:
    """Additive seasonal smoothing: forecasts with bands of ``band`` smoothed deviations, and 1 where a value left its band."""
    y = _filled(a)
    n = len(y)
    period = min(period, max(1, n))
    level = float(y[:period].mean())
    trend = float((y[period : 2 * period].mean() - level) / period) if n >= 2 * period else 0.0
    season, spread = list(y[:period] - level), [0.0] * period
    odd = np.zeros(n)
    for i in range(n):
        p = i % period
        said = level + trend + season[p]
        miss = abs(y[i] - said)
        odd[i] = float(i >= 2 * period and miss > band * spread[p] and spread[p] > 0)
        spread[p] = gamma * miss + (1 - gamma) * spread[p]
        before = level
        level = alpha * (y[i] - season[p]) + (1 - alpha) * (level + trend)
        trend = beta * (level - before) + (1 - beta) * trend
        season[p] = gamma * (y[i] - level) + (1 - gamma) * season[p]
    ahead = np.arange(1, horizon + 1)
    at = [(n + k - 1) % period for k in ahead]
    forecast = np.array([level + k * trend + season[p] for k, p in zip(ahead, at)])
    width = band * np.array([spread[p] for p in at])
    return {"forecast": forecast, "lower": forecast - width, "upper": forecast + width, "aberration": odd}


# --- fits


def fit_poly(a: Cells, degree: int = 2) -> dict:
    """Least squares on Chebyshev polynomials over the cells' places scaled to -1..1."""
    if not 0 <= degree <= 8:
        raise ValueError("degree must be 0 to 8")
    at = known(a)
    x = np.linspace(-1, 1, len(a)) if len(a) > 1 else np.zeros(len(a))
    degree = min(degree, max(0, len(at) - 1))
    if not len(at):
        return {"coefficients": [], "fit": a, "r2": math.nan}
    c = np.polynomial.chebyshev.chebfit(x[at], a[at], degree)
    fit = np.polynomial.chebyshev.chebval(x, c)
    total = ((a[at] - a[at].mean()) ** 2).sum()
    return {"coefficients": c, "fit": fit, "r2": float(1 - ((a[at] - fit[at]) ** 2).sum() / total) if total > 0 else 1.0}


def fit_robust(a: Cells, k: float = 1.345, rounds: int = 50) -> dict:
    """A line by iterated reweighting with Huber's weights and the scaled median deviation."""
    at = known(a)
    if len(at) < 2:
        return {"slope": math.nan, "intercept": math.nan, "fit": a}
    x, y, w = at.astype(float), a[at], np.ones(len(at))
    slope = intercept = 0.0
    for _ in range(rounds):
        mx, my = (w @ x) / w.sum(), (w @ y) / w.sum()
        now = (w @ ((x - mx) * (y - my))) / (w @ (x - mx) ** 2)
        done = abs(now - slope) <= 1e-12 * (1 + abs(now)) and abs(my - now * mx - intercept) <= 1e-12 * (1 + abs(intercept))
        slope, intercept = now, my - now * mx
        rest = np.abs(y - intercept - slope * x)
        scale = np.median(rest) / 0.6745
        if done or scale <= 1e-12:
            break
        w = np.minimum(1.0, k * scale / np.maximum(rest, 1e-300))
    return {"slope": float(slope), "intercept": float(intercept), "fit": intercept + slope * np.arange(len(a))}


def _sse(n, sx, sy, sxx, sxy, syy):
    vx = sxx - sx * sx / n
    return np.maximum(0.0, syy - sy * sy / n - np.where(vx > 1e-12, (sxy - sx * sy / n) ** 2 / np.where(vx > 1e-12, vx, 1), 0.0))


def fit_2lines(a: Cells) -> dict:
    """The split into two lines with the largest R squared, from prefix sums."""
    at = known(a)
    n = len(at)
    if n < 4:
        return {"split": -1, "r2": math.nan, "left_slope": math.nan, "right_slope": math.nan}
    x, y = at - at.mean(), a[at] - a[at].mean()
    sums = [np.cumsum(z) for z in (x, y, x * x, x * y, y * y)]
    k = np.arange(2, n - 1)
    left = _sse(k, *[s[k - 1] for s in sums])
    right = _sse(n - k, *[s[-1] - s[k - 1] for s in sums])
    best = int(k[np.argmin(left + right)])
    total = sums[4][-1]
    slope = lambda u, w: float(np.polyfit(u, w, 1)[0])
    return {"split": int(at[best]), "r2": float(1 - (left + right).min() / total) if total > 0 else 1.0, "left_slope": slope(x[:best], y[:best]), "right_slope": slope(x[best:], y[best:])}


# --- outliers, shape and reduction


def outliers_tukey(a: Cells, low: float = 0.25, high: float = 0.75, k: float = 1.5) -> Cells:
    """0 inside the fences; outside, how far beyond them in widths between the two quantiles, with a sign."""
    at = known(a)
    if not len(at):
        return a.copy()
    q1, q3 = np.quantile(a[at], [low, high])
    width = q3 - q1
    if width <= 0:
        return np.where(np.isnan(a), np.nan, np.sign(a - q1) * np.where(a == q1, 0.0, math.inf))
    over, under = (a - (q3 + k * width)) / width, (a - (q1 - k * width)) / width
    return np.where(np.isnan(a), np.nan, np.where(over > 0, over, np.where(under < 0, under, 0.0)))


def decompose_anomalies(a: Cells, period: int, k: float = 1.5) -> dict[str, Cells]:
    d = decompose_additive(a, period)
    score = outliers_tukey(d["residual"], k=k)
    return {"flag": np.where(np.isnan(score), np.nan, np.sign(score)), "score": score, "baseline": d["baseline"]}


def znorm(a: Cells) -> Cells:
    at = known(a)
    sd = a[at].std() if len(at) else 0.0
    return np.where(np.isnan(a), np.nan, 0.0) if sd == 0 else (a - a[at].mean()) / sd


def lttb(a: Cells, points: int) -> list[int]:
    """Places of the cells that draw the line: one a bucket, that with the largest triangle."""
    at = known(a)
    n = len(at)
    if points >= n or points < 3:
        return [int(i) for i in at]
    edges = np.linspace(1, n - 1, points - 1).astype(int)
    out, last = [int(at[0])], 0
    for b in range(points - 2):
        lo, hi = edges[b], max(edges[b] + 1, edges[b + 1])
        nxt = at[hi : edges[b + 2] if b + 2 < len(edges) else n]
        cx, cy = (nxt.mean(), a[nxt].mean()) if len(nxt) else (at[-1], a[at[-1]])
        x, y = at[lo:hi], a[at[lo:hi]]
        area = np.abs((at[last] - cx) * (y - a[at[last]]) - (at[last] - x) * (cy - a[at[last]]))
        last = lo + int(np.argmax(area))
        out.append(int(at[last]))
    return [*out, int(at[-1])]


def _moving(x: Cells, w: int) -> Cells:
    c = np.cumsum(np.r_[0.0, x])
    return (c[w:] - c[:-w]) / w


def _kurtosis(x: Cells) -> float:
    d = x - x.mean()
    m2 = (d**2).mean()
    return float((d**4).mean() / m2**2) if m2 > 0 else 0.0


def asap(a: Cells, longest: int | None = None) -> dict:
    """The moving average that is least rough among those that keep the kurtosis; windows are tried at peaks of the autocorrelation, then all."""
    x = _filled(a)
    n = len(x)
    longest = min(longest or n // 10 or 1, max(1, n - 1))
    rough = lambda y: float(np.diff(y).std()) if len(y) > 1 else 0.0
    kurt, best, least = _kurtosis(x), 1, rough(x)
    r = _acf(x) if n > 1 else np.ones(1)
    peaks = [k for k in range(2, longest + 1) if k + 1 < n and r[k] >= r[k - 1] and r[k] >= r[k + 1]]
    for w in [*peaks, *[k for k in range(2, longest + 1) if k not in peaks]]:
        y = _moving(x, w)
        if rough(y) < least and _kurtosis(y) >= kurt:
            best, least = w, rough(y)
    return {"window": best, "values": _moving(x, best) if best > 1 else x}


def dtw(a: Cells, b: Cells, band: int | None = None) -> float:
    """Distance by dynamic time warping with squared costs, within ``band`` of the diagonal (needed beyond 4096 cells)."""
    if band is None and max(len(a), len(b)) > 4096:
        raise ValueError("a band is needed beyond 4096 cells")
    x, y = _filled(a), _filled(b)
    n, m = len(x), len(y)
    if not n or not m:
        return math.nan
    band = max(n, m) if band is None else max(band, abs(n - m))
    before = np.full(m + 1, math.inf)
    before[0] = 0
    for i in range(1, n + 1):
        now = np.full(m + 1, math.inf)
        for j in range(max(1, i - band), min(m, i + band) + 1):
            now[j] = (x[i - 1] - y[j - 1]) ** 2 + min(before[j], now[j - 1], before[j - 1])
        before = now
    return math.sqrt(before[m])


def lb_keogh(a: Cells, b: Cells, band: int) -> float:
    """A lower bound of dtw() from the envelope of b."""
    lo = np.array([b[max(0, i - band) : i + band + 1].min() for i in range(len(a))])
    hi = np.array([b[max(0, i - band) : i + band + 1].max() for i in range(len(a))])
    return float(np.sqrt((np.where(a > hi, a - hi, np.where(a < lo, lo - a, 0.0)) ** 2).sum()))


def paa(a: Cells, segments: int) -> Cells:
    """Means of segments of equal width; a cell on a border counts in parts."""
    n = len(a)
    edges = np.arange(segments + 1) * n / segments
    out = np.empty(segments)
    for s in range(segments):
        at = np.arange(int(edges[s]), min(n, math.ceil(edges[s + 1])))
        w = np.minimum(at + 1, edges[s + 1]) - np.maximum(at, edges[s])
        ok = ~np.isnan(a[at])
        out[s] = (w[ok] @ a[at][ok]) / w[ok].sum() if ok.any() else math.nan
    return out


def breakpoints(alphabet: int) -> Cells:
    """Quantiles of the normal distribution at k / alphabet, by bisection of its distribution function."""
    out = []
    for k in range(1, alphabet):
        lo, hi = -10.0, 10.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < k / alphabet else (lo, mid)
        out.append((lo + hi) / 2)
    return np.array(out)


def sax(a: Cells, word: int = 8, alphabet: int = 4) -> str:
    if not 2 <= alphabet <= 26:
        raise ValueError("alphabet must be 2 to 26")
    at = np.searchsorted(breakpoints(alphabet), np.nan_to_num(paa(znorm(a), word)), side="right")
    return "".join(chr(97 + i) for i in at)


def sax_mindist(a: str, b: str, n: int, alphabet: int) -> float:
    """A lower bound of the distance of the two z-normalised series of n cells."""
    cut = breakpoints(alphabet)
    gap = lambda i, j: 0.0 if abs(i - j) <= 1 else cut[max(i, j) - 1] - cut[min(i, j)]
    return math.sqrt(n / len(a)) * math.sqrt(sum(gap(ord(x) - 97, ord(y) - 97) ** 2 for x, y in zip(a, b)))


def matrix_profile(a: Cells, m: int) -> dict:
    """Distance of each subsequence of m cells to its nearest other one, not within a quarter of m, and where that is.

    Dot products follow from the row before; a subsequence without spread is at distance sqrt(m) from others and 0 from
    its like.
    """
    x = _filled(a)
    k = len(x) - m + 1
    if m < 2 or k < 1:
        return {"profile": [], "index": []}
    away = math.ceil(m / 4)
    views = np.lib.stride_tricks.sliding_window_view(x, m)
    mean, sd = views.mean(1), views.std(1)
    flat = sd < 1e-12
    first = views @ x[:m]
    dots = first.copy()
    profile, index = np.full(k, math.inf), np.full(k, -1)
    for i in range(k):
        if i:
            dots[1:] = dots[:-1] - x[i - 1] * x[: k - 1] + x[i + m - 1] * x[m : m + k - 1]
            dots[0] = first[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.sqrt(np.maximum(0.0, 2 * m * (1 - (dots - m * mean[i] * mean) / (m * sd[i] * sd))))
        d = np.where(flat | flat[i], np.where(flat & flat[i], 0.0, math.sqrt(m)), d)
        d[max(0, i - away + 1) : i + away] = math.inf
        j = int(np.argmin(d))
        if math.isfinite(d[j]):
            profile[i], index[i] = d[j], j
    return {"profile": profile, "index": [int(i) for i in index]}


def changepoints(a: Cells, method: str = "PELT", penalty: float | None = None, hazard: float = 0.01) -> list[int]:
    """Places where the mean changes. PELT: least squared error plus a penalty a change, pruned; of
    equal costs, added up from the left, the earliest place. BOCPD: where the most probable run length falls."""
    x = _filled(a)
    n = len(x)
    if n < 4:
        return []
    if method == "PELT":
        noise = np.median(np.abs(np.diff(x))) / 0.6745 / math.sqrt(2)
        penalty = 3 * max(noise, 1e-12) ** 2 * math.log(n) if penalty is None else penalty
        s, q = np.r_[0.0, np.cumsum(x)], np.r_[0.0, np.cumsum(x * x)]
        best, before, alive = np.full(n + 1, math.inf), np.zeros(n + 1, int), np.array([0])
        best[0] = -penalty
        for j in range(1, n + 1):
            c = best[alive] + q[j] - q[alive] - (s[j] - s[alive]) ** 2 / (j - alive)
            k = int(np.argmin(c))
            best[j], before[j] = c[k] + penalty, alive[k]
            # What rounding alone puts above the bound stays, since it may tie later on.
            alive = np.r_[alive[c <= best[j] + 1e-9 * (abs(best[j]) + q[j])], j]
        out, j = [], n
        while before[j] > 0:
            out.append(int(before[j]))
            j = before[j]
        return sorted(out)
    if method != "BOCPD":
        raise ValueError(f"no method {method}")
    mu0, k0, a0, b0 = x.mean(), 1.0, 1.0, max(x.var(), 1e-12)
    mu, ka, al, be, run = (np.array([v]) for v in (mu0, k0, a0, b0, 1.0))
    out, last = [], 0
    for i, v in enumerate(x):
        scale = be * (ka + 1) / (al * ka)
        z = (v - mu) ** 2 / scale
        lg = np.array([math.lgamma(u + 0.5) - math.lgamma(u) for u in al])
        like = np.exp(lg - 0.5 * np.log(2 * math.pi * al * scale / 1.0) - (al + 0.5) * np.log1p(z / (2 * al)))
        grown, cut = run * like * (1 - hazard), (run * like * hazard).sum()
        run = np.r_[cut, grown]
        run /= run.sum()
        mu, ka, al, be = np.r_[mu0, (ka * mu + v) / (ka + 1)], np.r_[k0, ka + 1], np.r_[a0, al + 0.5], np.r_[b0, be + ka * (v - mu) ** 2 / (2 * (ka + 1))]
        length = int(np.argmax(run))
        if length < last:
            out.append(i - length + 1 if length else i)
        last = length
    return sorted({c for c in out if 0 < c < n})


def ks_test(a: Cells, b: Cells) -> dict[str, float]:
    """Two-sample Kolmogorov-Smirnov statistic and its asymptotic p-value."""
    x, y = np.sort(a[known(a)]), np.sort(b[known(b)])
    if not len(x) or not len(y):
        return {"statistic": math.nan, "p_value": math.nan}
    both = np.r_[x, y]
    d = float(np.abs(np.searchsorted(x, both, "right") / len(x) - np.searchsorted(y, both, "right") / len(y)).max())
    n = len(x) * len(y) / (len(x) + len(y))
    z = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    p = 1.0 if z < 1e-3 else 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101))
    return {"statistic": d, "p_value": min(1.0, max(0.0, p))}
