"""Series, histogram and pattern functions against plain restatements."""

import math

import numpy as np
import pytest

from gridweave.functions import histograms as H
from gridweave.functions import numerics as N
from gridweave.functions import patterns as P

R = np.random.default_rng(3)
X = R.normal(0, 1, 60).cumsum()
HOLES = np.where(R.random(60) < 0.2, np.nan, X)
WAVE = np.sin(np.arange(84) * 2 * np.pi / 7) * 3 + np.arange(84) * 0.1 + R.normal(0, 0.1, 84)


def test_fills():
    a = np.array([np.nan, 1, np.nan, np.nan, 4, np.nan])
    assert np.array_equal(N.fill_forward(a), [np.nan, 1, 1, 1, 4, 4], equal_nan=True)
    assert np.array_equal(N.fill_forward(a, 1), [np.nan, 1, 1, np.nan, 4, 4], equal_nan=True)
    assert np.array_equal(N.fill_backward(a), [1, 1, 4, 4, 4, np.nan], equal_nan=True)
    assert np.array_equal(N.fill_linear(a), [np.nan, 1, 2, 3, 4, np.nan], equal_nan=True)
    assert np.array_equal(N.fill_const(a, 7), [7, 1, 7, 7, 4, 7])


def test_spline_solves_the_natural_system():
    y = N.fill_spline(HOLES)
    at = N.known(HOLES)
    h = np.diff(at).astype(float)
    n = len(at)
    m = np.zeros((n, n))
    rhs = np.zeros(n)
    m[0, 0] = m[-1, -1] = 1
    for i in range(1, n - 1):
        m[i, i - 1], m[i, i], m[i, i + 1] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        rhs[i] = 6 * ((HOLES[at[i + 1]] - HOLES[at[i]]) / h[i] - (HOLES[at[i]] - HOLES[at[i - 1]]) / h[i - 1])
    s = np.linalg.solve(m, rhs)
    for c in np.flatnonzero(np.isnan(HOLES)):
        i = np.searchsorted(at, c) - 1
        if 0 <= i < n - 1:
            u, w = (at[i + 1] - c) / h[i], (c - at[i]) / h[i]
            want = u * HOLES[at[i]] + w * HOLES[at[i + 1]] + h[i] ** 2 / 6 * ((u**3 - u) * s[i] + (w**3 - w) * s[i + 1])
            assert y[c] == pytest.approx(want)


def test_recurrences_are_one_family():
    a = 0.3
    assert np.allclose(N.ema(X, alpha=a), N.iir(np.r_[X], [a], [1, a - 1]) + (1 - a) ** np.arange(1, 61) * X[0])
    assert np.allclose(N.ema(X, span=9), N.ema(X, alpha=0.2)) and np.allclose(N.exp_smooth(X, a), N.ema(X, a))
    brute = [sum(X[j] * 0.5 ** ((i - j) / 4) for j in range(i + 1)) for i in range(60)]
    assert np.allclose(N.time_decayed(X, 4), brute)
    n = [sum(0.5 ** ((i - j) / 4) for j in range(i + 1)) for i in range(60)]
    assert np.allclose(N.time_decayed(X, 4, "avg"), np.array(brute) / n) and np.allclose(N.time_decayed(X, 4, "count"), n)


def test_fir():
    assert np.allclose(N.fir(X, [1, 1, 1], center=True)[1:-1], np.convolve(X, np.ones(3) / 3, "valid"))
    assert np.allclose(N.fir(X, [1, 2], normalize=False)[1:], 2 * X[:-1] + X[1:]) or np.allclose(N.fir(X, [1, 2], normalize=False)[1:], X[:-1] + 2 * X[1:])


def test_spectra():
    z = N.fft(X)
    n = len(X)
    k = np.arange(n)
    want = np.array([(X * np.exp(-2j * np.pi * f * k / n)).sum() for f in range(n)])
    assert np.allclose(z["re"] + 1j * z["im"], want)
    assert np.allclose(N.ifft(z["re"], z["im"])["re"], X)
    d = X - X.mean()
    assert np.allclose(N.acf(X, 10), [(d[lag:] * d[: n - lag]).sum() / (d * d).sum() for lag in range(11)])
    shifted = N.ccf(np.roll(WAVE, 2), WAVE, 3)
    assert shifted["lag"] == 2 and len(shifted["values"]) == 7
    assert 7 in N.periods_detect(WAVE - N._line(WAVE))["periods"] and N.periods_validate(WAVE - N._line(WAVE), [7, 0])[0] > 0.8


def test_decompositions():
    d = N.decompose_additive(WAVE, 7)
    assert np.allclose(d["seasonal"] + d["trend"] + d["residual"], WAVE) and np.abs(d["residual"]).max() < 0.6
    s = N.decompose_stl(WAVE, 7)
    assert np.allclose(s["seasonal"] + s["trend"] + s["residual"], WAVE) and np.abs(s["residual"]).max() < 0.6
    ahead = N.decompose_forecast(WAVE, 7, 14)
    truth = np.sin(np.arange(84, 98) * 2 * np.pi / 7) * 3 + np.arange(84, 98) * 0.1
    assert np.abs(ahead - truth).max() < 0.4
    hw = N.holt_winters(WAVE, 0.3, 0.05, 0.3, 7, 7)
    assert np.abs(hw["forecast"] - truth[:7]).max() < 1.0 and (hw["lower"] <= hw["upper"]).all()
    odd = WAVE.copy()
    odd[40] += 20
    found = N.decompose_anomalies(odd, 7, 3.0)
    assert found["flag"][40] == 1 and np.argmax(np.abs(found["score"])) == 40


def test_series_are_decomposed_together_as_apart(monkeypatch):
    many = np.array([WAVE, np.where(R.random(84) < 0.2, np.nan, WAVE * 3), R.normal(0, 1, 84)])
    for outer in (1, 3):
        monkeypatch.setattr(N, "LOESS_CELLS", 1_000_000)
        all_ = N.decompose_stl(many, 7, outer=outer)
        monkeypatch.setattr(N, "LOESS_CELLS", 50)  # places in blocks
        for i, a in enumerate(many):
            for k, v in N.decompose_stl(a, 7, outer=outer).items():
                assert np.allclose(all_[k][i], v, atol=1e-9, equal_nan=True)
    short = N.decompose_stl(many[:, :9], 7)
    assert all(np.allclose(short["trend"][i], N.decompose_stl(a[:9], 7)["trend"]) for i, a in enumerate(many))
    # Weights of the second point are those of places -1..2 by hand.
    y = np.array([1.0, 2.0, 4.0])
    w = (1 - (np.array([1.0, 0.0, 1.0]) / 1.0000001) ** 3) ** 3
    assert N.loess(y, 3)[1] == pytest.approx(np.polyval(np.polyfit([0, 1, 2], y, 1, w=np.sqrt(w)), 1), abs=1e-6)


def test_fits():
    t = np.arange(50.0)
    p = N.fit_poly(3 + 2 * t - 0.1 * t * t, 2)
    assert np.allclose(p["fit"], 3 + 2 * t - 0.1 * t * t) and p["r2"] == pytest.approx(1)
    y = 1 + 0.5 * t
    y[::10] += 100
    r = N.fit_robust(y)
    assert r["slope"] == pytest.approx(0.5, abs=0.02)
    broken = np.where(t < 20, t, 20 - 3 * (t - 20))
    two = N.fit_2lines(broken)
    assert 19 <= two["split"] <= 21 and two["left_slope"] == pytest.approx(1) and two["right_slope"] == pytest.approx(-3)


def test_outliers_and_shape():
    a = np.r_[np.arange(20.0), 100, -100]
    s = N.outliers_tukey(a)
    assert (s[:20] == 0).all() and s[20] > 0 > s[21]
    assert N.znorm(X).mean() == pytest.approx(0, abs=1e-12) and N.znorm(X).std() == pytest.approx(1) and (N.znorm(np.ones(5)) == 0).all()
    kept = N.lttb(X, 12)
    assert len(kept) == 12 and kept[0] == 0 and kept[-1] == 59 and kept == sorted(set(kept))
    smooth = N.asap(WAVE)
    assert smooth["window"] >= 1 and len(smooth["values"]) == 84 - smooth["window"] + 1


def test_distances():
    a, b = X[:20], X[5:28]

    def brute(i, j, seen={}):  # noqa: B006
        if (i, j) not in seen:
            if i == 0 and j == 0:
                seen[i, j] = 0.0
            elif i == 0 or j == 0:
                seen[i, j] = math.inf
            else:
                seen[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(brute(i - 1, j), brute(i, j - 1), brute(i - 1, j - 1))
        return seen[i, j]

    assert N.dtw(a, b) == pytest.approx(math.sqrt(brute(len(a), len(b))))
    assert N.dtw(a, X[20:40], 3) >= N.lb_keogh(a, X[20:40], 3) and N.dtw(a, a) == 0
    assert np.allclose(N.paa(np.arange(12.0), 4), [1, 4, 7, 10]) and N.paa(np.arange(5.0), 2)[0] == pytest.approx((0 + 1 + 2 * 0.5) / 2.5)
    assert np.allclose(N.breakpoints(4), [-0.6744897501960817, 0, 0.6744897501960817])
    za, zb = N.znorm(X[:48]), N.znorm(X[10:58])
    assert N.sax_mindist(N.sax(X[:48], 8, 6), N.sax(X[10:58], 8, 6), 48, 6) <= np.sqrt(((za - zb) ** 2).sum()) + 1e-9


def test_matrix_profile():
    m = 6
    got = N.matrix_profile(X, m)
    views = np.array([N.znorm(X[i : i + m]) for i in range(len(X) - m + 1)])
    for i in range(len(views)):
        d = np.sqrt(((views - views[i]) ** 2).sum(1))
        d[max(0, i - 1) : i + 2] = math.inf
        assert got["profile"][i] == pytest.approx(d.min(), abs=1e-5)


def test_changepoints_and_ks():
    step = np.r_[np.zeros(40), np.full(40, 5.0), np.full(30, -3.0)] + R.normal(0, 0.2, 110)
    assert N.changepoints(step) == [40, 80]
    assert any(abs(c - 40) <= 2 for c in N.changepoints(step, "BOCPD"))
    a, b = R.normal(0, 1, 200), R.normal(0.8, 1, 150)
    k = N.ks_test(a, b)
    want = max(abs((a <= x).mean() - (b <= x).mean()) for x in np.r_[a, b])
    assert k["statistic"] == pytest.approx(want) and k["p_value"] < 0.01 and N.ks_test(a, a)["p_value"] == 1


def test_changepoints_of_equal_costs_are_the_earliest():
    """The second cell lies halfway between its neighbours, so a piece may end before or after it at one cost."""
    nan = math.nan
    a = np.array([
        102.71000000000001, nan, 535.57, 69.16999999999999, 16.05, 5.4, 27.4, 45.50000000000001, 48.03, 132.97, nan, 177.07999999999998, nan, 127.77000000000001, 0.79,
        47.400000000000006, nan, 1.62, 87.96, 81.25, 130.94, 75.32, 35.55, 368.45, 51.31, 172.38, 15.57, 1.09, nan, 287.31,
    ])
    assert N.changepoints(a) == [1, 3, 23, 24, 29]


# --- histograms


def test_bucket_edges_are_upper_inclusive():
    for scale in (-2, 0, 1, 3):
        for i in (-5, -1, 0, 1, 7):
            top = H.upper(i, scale)
            assert H.bucket_index(top, scale) == i and H.bucket_index(np.nextafter(top, math.inf), scale) == i + 1


def test_histogram_algebra():
    v = [float(x) for x in R.lognormal(1, 1, 300)] + [0.0, -2.0, -3.5]
    fine, coarse = H.from_values(v, 4), H.from_values(v, 1)
    assert H.downscale(fine, 1)["pos"] == coarse["pos"] and H.downscale(fine, 1)["neg"] == coarse["neg"]
    both = H.add(H.from_values(v[:100], 4), H.from_values(v[100:], 2))
    assert both["scale"] == 2 and both["count"] == len(v) and H.compact(both)["pos"] == H.compact(H.downscale(fine, 2))["pos"]
    back = H.subtract(both, H.from_values(v[100:], 2))
    assert H.compact(back)["pos"] == H.downscale(H.from_values(v[:100], 4), 2)["pos"]
    assert not H.detect_reset(H.from_values(v[:100], 2), H.from_values(v, 2)) and H.detect_reset(H.from_values(v, 2), H.from_values(v[:100], 2))
    assert H.unpack(H.pack(fine)) == H.compact(fine)


def test_histogram_points():
    v = sorted(float(x) for x in R.lognormal(1, 1, 500))
    h = H.from_values(v, 5)
    for phi in (0.1, 0.5, 0.9, 0.99):
        assert H.quantile(h, phi) == pytest.approx(v[math.ceil(phi * 500) - 1], rel=2 ** (2**-5) - 1 + 1e-9)
    assert H.quantile(h, -1) == -math.inf and H.quantile(h, 2) == math.inf and math.isnan(H.quantile(H.from_values([], 0), 0.5))
    assert H.fraction(h, 0, 1e9) == pytest.approx(1) and H.fraction(h, 0, v[249]) == pytest.approx(0.5, abs=0.02)
    mean, var = H.moments(h)
    assert mean == pytest.approx(np.mean(v)) and var == pytest.approx(np.var(v), rel=0.05)
    c = H.from_classic([(1, 10), (5, 30), (10, 28), (math.inf, 40)])
    assert c["counts"] == [10, 20, 0, 10] and H.from_classic([(1, 2)]) is None
    assert H.quantile(c, 0.5) == pytest.approx(1 + 4 * 0.5) and H.quantile(c, 0.9) == 10


def test_fraction_counts_zeros_at_its_lower_bound():
    h = H.from_values([0.0, 0.0, 1.0, 20.0])
    assert H.fraction(h, 0, 16) == 0.75 and H.fraction(h, 0, 32) == 1 and H.fraction(h, -1, 0) == 0.5 and H.fraction(h, 1, 16) == 0
    both = H.from_values([-4.0, 0.0, 0.0, 4.0])
    assert H.fraction(both, 0, 4) == 0.75 and H.fraction(both, -4, 0) == 0.75 and H.fraction(both, -4, 4) == 1


def test_histogram_increase():
    one, two = H.from_values([1, 2, 4], 1), H.from_values([1, 2, 4, 8, 8], 1)
    got = H.increase([(0, one), (60, two)], 60, 60)
    assert got["count"] == pytest.approx(2) and H.increase([(0, one)], 60, 60) is None
    reset = H.increase([(10, two), (60, one)], 60, 60)
    assert reset["count"] == pytest.approx(3 * 60 / 50)


# --- patterns


def found(pattern, text, within=10**9, skip="PAST LAST ROW", subsets=None):
    tree = P.parse(pattern)
    return ["".join(text[i] for i, _, out in m if not out) for m in P.find_all(tree, len(text), lambda v, i, taken: text[i] == v, list(range(len(text))), within, skip, subsets)]


@pytest.mark.parametrize(
    ("pattern", "text", "want"),
    [
        ("A B+ C", "ABBCABC", ["ABBC", "ABC"]),
        ("A B* C", "ACABBBC", ["AC", "ABBBC"]),
        ("A B?? B", "ABB", ["AB"]),
        ("A (B | C){2} D", "ABCDACBD", ["ABCD", "ACBD"]),
        ("A {- B -} C", "ABC", ["AC"]),
        ("PERMUTE(A, B, C)", "CABBCA", ["CAB", "BCA"]),
        ("^ A B", "ABAB", ["AB"]),
        ("A B $", "ABAB", ["AB"]),
        ("A{2,3}", "AAAAA", ["AAA", "AA"]),
        ("A{,2}? B", "AAB", ["AAB"]),
        ("(A B)+", "ABABX", ["ABAB"]),
    ],
)
def test_patterns(pattern, text, want):
    assert found(pattern, text) == want


def test_pattern_skips_and_limits():
    assert found("A A", "AAAA", skip="TO NEXT ROW") == ["AA"] * 3
    assert found("A B C", "ABCBC", skip="TO LAST C") == ["ABC"]
    assert found("A B+ C", "A" + "B" * 9 + "C", within=5) == []
    assert found("A B+ C", "A" + "B" * 3 + "C", within=4) == ["ABBBC"]
    assert found("A+", "A" * 5000) == ["A" * 5000]
    for bad in ("A (", "A {}", "A ]", "* A"):
        with pytest.raises(ValueError):
            P.parse(bad)
