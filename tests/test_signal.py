"""Crossings, phases, filter, spectra and statistics against plain NumPy."""

import numpy as np
import pytest
from helpers import butterworth, by_key, series
from pyspark.sql import functions as F

from kinespark.functions import lowpass
from kinespark.functions.spectral import power_spectrum, power_spectrum_dft, spectral_entropy
from kinespark.operators import gait, phases, smoothing, spectra, timedomain


@pytest.mark.parametrize("size", [1, 2, 100])
def test_zero_touch_is_crossed_twice(spark, size):
    df = series(spark, {"a": [1, 0, -1, 0, 0, 2]})
    assert by_key(phases.zero_crossings(df, ["key"], size=size), "n") == {"a": [0, 1, 2, 4]}


def plain_phases(z, t, min_len):
    crossings = np.where(np.diff(np.sign(z)))[0]
    out = []
    for s, e in zip(crossings[:-1], crossings[1:]):
        if e - s >= min_len:
            m = int(np.argmin(z[s:e])) + s
            out.append((len(out), int(s), m, int(e), float(t[s]), float(t[m]), float(t[e])))
    return out


@pytest.mark.parametrize("min_len", [1, 2])
@pytest.mark.parametrize("size", [5, 1000])
def test_phases(spark, size, min_len):
    rng = np.random.default_rng(2)
    data = {"noise": rng.normal(size=300), "coarse": rng.integers(-1, 2, 300).astype(float), "none": np.ones(20)}
    df = series(spark, data).withColumn("t", F.col("n") * 0.5)
    columns = ["phase_no", "start_n", "min_n", "end_n", "start_t", "min_t", "end_t"]
    found = by_key(phases.phases(df, ["key"], time="t", min_len=min_len, size=size), *columns)
    for key, z in data.items():
        assert found.get(key, []) == plain_phases(z, np.arange(len(z)) * 0.5, min_len)


def test_alerts_above_ten_percent(spark):
    rows = [("a", s, no, st, sw) for s, no, st, sw in [
        ("left", 0, 1.0, 2.0), ("right", 0, 1.05, 2.0), ("left", 1, 1.0, 2.0), ("right", 1, 1.2, 2.0),
        ("left", 2, 0.0, 1.0), ("right", 2, 0.0, 1.0), ("left", 3, 1.0, 1.0)]]
    df = spark.createDataFrame(rows, "key string, side string, phase_no long, stance_s double, swing_s double")
    differences = phases.phase_differences(df, ["key"])
    by_no = {r["phase_no"]: r for r in differences.collect()}
    assert set(by_no) == {0, 1, 2} and by_no[2]["stance_diff_pct"] is None
    alerts = phases.asymmetry_alerts(differences).collect()
    assert [(r["phase_no"], r["stance_alert"], r["swing_alert"]) for r in alerts] == [(1, True, False)]


def test_filter_coefficients_of_the_default():
    b, a = lowpass.coefficients(6, 100)
    assert b == pytest.approx([0.0278598, 0.0557195, 0.0278598], abs=1e-7)
    assert a == pytest.approx([1.0, -1.4754804, 0.5869195], abs=1e-7)
    assert lowpass.impulse_response().sum() == pytest.approx(1.0, abs=1e-14)


@pytest.mark.parametrize("size", [16, 64, 8192])
def test_low_pass_equals_the_recursive_filter(spark, size):
    rng = np.random.default_rng(3)
    data = {"long": rng.normal(size=700) * 50, "ten": rng.normal(size=10), "twelve": rng.normal(size=12), "nine": rng.normal(size=9)}
    df = series(spark, data)
    found = by_key(smoothing.low_pass(df, ["key"], size=size), "n", "z_filtered")
    assert set(found) == {"long", "ten", "twelve"}
    for key in found:
        assert [n for n, _ in found[key]] == list(range(len(data[key])))
        assert np.allclose([v for _, v in found[key]], butterworth(data[key]), rtol=0, atol=1e-12 * max(1, abs(data[key]).max()))
    assert [r["key"] for r in smoothing.too_short(df, ["key"]).collect()] == ["nine"]


def test_low_pass_with_other_cutoffs(spark):
    z = np.random.default_rng(8).normal(size=900)
    for cutoff, fs in ((2.0, 100.0), (35.0, 100.0)):
        found = by_key(smoothing.low_pass(series(spark, {"a": z}), ["key"], cutoff=cutoff, fs=fs, size=128), "n", "z_filtered")
        assert np.allclose([v for _, v in found["a"]], butterworth(z, cutoff, fs), atol=1e-11)


def test_spectra_of_odd_and_even_windows(spark):
    rng = np.random.default_rng(4)
    values = [rng.normal(size=n).tolist() for n in (2, 3, 50, 51)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<double>")
    rows = df.select("i", power_spectrum("v").alias("fft"), power_spectrum_dft("v").alias("dft")).collect()
    for row in rows:
        expected = np.abs(np.fft.fft(values[row["i"]]))[: len(values[row["i"]]) // 2] ** 2
        assert np.allclose(row["fft"], expected) and np.allclose(row["dft"], expected)
    silent = spark.createDataFrame([([0.0, 0.0, 0.0],)], "p array<double>").select(spectral_entropy("p").alias("e"))
    assert silent.first()["e"] is None


def test_tumbling_windows_are_anchored_and_complete(spark):
    times = ["00:00:00.500", "00:00:01.000", "00:00:02.499", "00:00:02.500", "00:00:07.000", "00:00:08.499"]
    df = spark.createDataFrame([("a", n, t) for n, t in enumerate(times)], "key string, n long, t string")
    df = df.select("key", "n", F.expr("cast('2024-01-01 ' || t as timestamp_ntz)").alias("ts"))
    rows = spectra.tumbling_windows(df, ["key"], 2.0).collect()
    # windows 0.5–2.5, 2.5–4.5, (4.5–6.5 has no rows), and 6.5–8.5 ends after the last row
    assert sorted((r["n"], r["window_id"]) for r in rows) == [(0, 0), (1, 0), (2, 0), (3, 1)]


def test_large_windows_in_lines_equal_one_fft(spark):
    rng = np.random.default_rng(9)
    rows = [(k, n, float(v)) for k, size in (("a", 230), ("b", 61)) for n, v in enumerate(rng.normal(size=size) + 1)]
    df = spark.createDataFrame(rows, "key string, n long, z double")
    df = df.withColumn("ts", F.expr("timestampadd(MILLISECOND, cast(n * 10 as int), timestamp_ntz'2024-01-01 00:00:00')"))
    df = df.filter("key = 'b' OR n % 50 <> 7")
    df = df.withColumn("n", F.expr("row_number() over (partition by key order by ts) - 1").cast("long"))
    whole = spectra.spectral_windows(df, ["key"], width_s=0.53).orderBy("key", "window_id").collect()
    pieces = spectra.spectral_windows(df, ["key"], width_s=0.53, fft_limit=51).orderBy("key", "window_id").collect()
    assert len(whole) == len(pieces) == 5
    assert {r["samples"] for r in whole} == {51, 52, 53}
    for a, b in zip(whole, pieces):
        assert a["samples"] == b["samples"] and a["dominant_freq"] == b["dominant_freq"]
        assert a["spectral_entropy"] == pytest.approx(b["spectral_entropy"])
        assert a["gait_band_energy"] == pytest.approx(b["gait_band_energy"])


def test_spread_fft_of_several_lengths(spark):
    rng = np.random.default_rng(3)
    series_ = {e: rng.normal(size=2**e) + 1j * rng.normal(size=2**e) for e in (0, 1, 4, 9)}
    rows = [(e, i, float(v.real), float(v.imag)) for e, x in series_.items() for i, v in enumerate(x)]
    found = spectra.spread_fft(spark.createDataFrame(rows, "e int, i long, re double, im double"), []).collect()
    for e, x in series_.items():
        own = sorted((r["i"], complex(r["re"], r["im"])) for r in found if r["e"] == e)
        assert np.allclose([v for _, v in own], np.fft.fft(x))


@pytest.mark.parametrize("limit", [0, 10**6])
def test_statistics(spark, limit):
    rng = np.random.default_rng(5)
    data = {"a": rng.normal(size=101), "b": rng.exponential(size=64) - 1, "ties": rng.integers(-2, 3, 80).astype(float)}
    rows = {r["key"]: r for r in timedomain.time_domain(series(spark, data), ["key"], limit=limit).collect()}
    for key, z in data.items():
        sd = z.std(ddof=1)
        expected = {
            "mean": z.mean(), "std": sd, "max": z.max(), "min": z.min(), "rms": np.sqrt((z**2).mean()),
            "mad": np.median(np.abs(z - np.median(z))), "range": np.ptp(z), "pkamp": np.ptp(z),
            "iqr": np.percentile(z, 75) - np.percentile(z, 25), "skew": ((z - z.mean()) ** 3).mean() / sd**3,
            "kurt": ((z - z.mean()) ** 4).mean() / sd**4, "zcr": (z[:-1] * z[1:] < 0).sum(), "pkcnt": (z[:-1] * z[1:] < 0).sum(),
        }
        for name, value in expected.items():
            assert rows[key][name] == pytest.approx(value), (key, name)
    compat = timedomain.time_domain(series(spark, data), ["key"], compat=True, limit=limit).collect()
    assert {r["zcr"] for r in compat} == {0}


def test_cross_limb_against_plain_numpy(spark):
    rng = np.random.default_rng(6)
    t = np.arange(900) / 100
    sides = {"left": np.sin(2 * np.pi * t) * 40 + rng.normal(size=900), "right": np.sin(2 * np.pi * t * 1.1 + 0.4) * 35 + rng.normal(size=900)}
    rows = [("a", s, n, float(n) / 100, float(v)) for s, z in sides.items() for n, v in enumerate(z)]
    df = spark.createDataFrame(rows, "key string, side string, n long, elapsed double, z double")
    found = sorted(gait.cross_limb(df, ["key"]).collect(), key=lambda r: r["cycle_no"])

    from helpers import greedy, maxima
    smooth = {s: butterworth(z) for s, z in sides.items()}
    marks = {s: greedy([(p, y[p]) for p in maxima(y)], 50) for s, y in smooth.items()}
    count = min(len(m) for m in marks.values()) - 1
    assert len(found) == count > 3
    for i, row in enumerate(found):
        cut = {s: smooth[s][marks[s][i] : marks[s][i + 1]] for s in sides}
        k = min(len(c) for c in cut.values())
        spans = {s: t[marks[s][i + 1]] - t[marks[s][i]] for s in sides}
        assert row["left_stride_duration"] == pytest.approx(spans["left"])
        assert row["stride_duration_symmetry_ratio"] == pytest.approx(min(spans.values()) / max(spans.values()))
        assert row["right_peak"] == pytest.approx(cut["right"].max())
        assert row["peak_diff"] == pytest.approx(abs(cut["left"].max() - cut["right"].max()))
        assert row["z_corr"] == pytest.approx(np.corrcoef(cut["left"][:k], cut["right"][:k])[0, 1])


def test_sketched_statistics_of_a_long_series_are_within_the_rank_error(spark):
    rows = spark.range(3_000_000).select(
        F.lit("a").alias("key"), F.col("id").alias("n"), (F.pow(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1000, 2)).alias("z")
    )
    sketched = timedomain.time_domain(rows, ["key"], sketch=timedomain.SKETCH).first()
    plan = timedomain.sketched_quantiles(rows, ["key"], "z", {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "RangePartitioning" not in plan and "rangepartitioning" not in plan
    off = timedomain.rank_error(timedomain.SKETCH)
    assert off < 0.002
    # z is the square of a uniform number in [0, 1000]: the q-quantile is (1000 q)²
    def square(q):
        return (1000.0 * q) ** 2

    assert square(0.75 - off) - square(0.25 + off) <= sketched["iqr"] <= square(0.75 + off) - square(0.25 - off)
    deviations = rows.select(F.abs(F.col("z") - square(0.5)).alias("d"))
    share = deviations.filter(F.col("d") <= sketched["mad"]).count() / 3_000_000
    # the median itself is off by as much, which moves deviations by less than its own share of rows on either side
    assert abs(share - 0.5) <= 4 * off
    assert (sketched["mean"], sketched["zcr"]) == (pytest.approx(square(1) / 3, rel=1e-2), 0)


def test_sketches_leave_missing_values_out(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", None)], "key string, z double")
    found = timedomain.sketched_quantiles(rows, ["key"], "z", {"low": 0.0, "high": 1.0}).collect()
    assert [tuple(r) for r in found] == [("a", 1.0, 3.0)]
