"""Queries over single series: statistics, crossings, peaks, filter, spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinespark.functions.scalar import seconds_between
from kinespark.functions.spectral import power_spectrum, power_spectrum_dft
from kinespark.operators import gait, peaks, phases, smoothing, spectra, timedomain
from kinespark.operators.layout import attach, enumerate_rows
from kinespark.plans import sql_parts as S
from kinespark.plans.registry import query, r, rounded, with_
from kinespark.plans.views import SERIES, SUBJECT, samples, signal_long, staged_signal, supplier_series
from kinespark.plans.views import table
from kinespark.session import stage

WINDOW_DAYS = 2
SPECTRAL_WIDTH = WINDOW_DAYS * 86_400.0
FS = 100.0
PEAK_HEIGHT, PEAK_DISTANCE = 0.5, 10

KEYS = "subject_id, side"


def _statistics(source: str, keys: str) -> str:
    """One row per series with the thirteen statistics, from power sums and linear quantiles."""
    on = f"USING ({keys})"
    return f"""base AS (
  SELECT {keys}, z, lead(z) OVER (PARTITION BY {keys} ORDER BY n) AS next_z FROM {source}),
first_pass AS (
  SELECT {keys}, avg(z) AS mean, stddev_samp(z) AS std, max(z) AS max_z, min(z) AS min_z, sqrt(avg(z * z)) AS rms,
         median(z) AS med, quantile_cont(z, 0.75) - quantile_cont(z, 0.25) AS iqr,
         count(CASE WHEN z * next_z < 0 THEN 1 END) AS zcr
  FROM base GROUP BY {keys}),
stats AS (
  SELECT {keys}, any_value(mean) AS mean, any_value(std) AS std, any_value(max_z) AS max_z, any_value(min_z) AS min_z,
         any_value(rms) AS rms, median(abs(z - med)) AS mad, any_value(iqr) AS iqr,
         avg((z - mean) ** 3) / any_value(std) ** 3 AS skew, avg((z - mean) ** 4) / any_value(std) ** 4 AS kurt,
         any_value(zcr) AS zcr
  FROM base JOIN first_pass {on} GROUP BY {keys})"""


_STAT_SQL = {
    "mean": "mean", "std": "std", "max": "max_z", "min": "min_z", "rms": "rms", "mad": "mad", "range": "max_z - min_z",
    "iqr": "iqr", "skew": "skew", "kurt": "kurt", "pkamp": "max_z - min_z",
}
_COUNTS = {"zcr": "zcr", "pkcnt": "zcr"}


def _wide_statistics() -> str:
    columns = []
    for side in ("left", "right"):
        for name in timedomain.STATISTICS:
            source = _STAT_SQL.get(name) or _COUNTS[name]
            value = f"max(CASE WHEN side = '{side}' THEN {source} END)"
            alias = f"{side}_z_{name}"
            columns.append(f"CAST({value} AS BIGINT) AS {alias}" if name in _COUNTS else r(value, alias))
    return ", ".join(columns)


@query(
    "time_domain_features",
    with_(S.SIGNAL, _statistics("signal", KEYS)) + f"SELECT subject_id, {_wide_statistics()} FROM stats GROUP BY subject_id",
)
def time_domain_features(spark, sf_dir):
    """Thirteen statistics per side and subject, as one row of 26 columns."""
    stats = timedomain.time_domain(staged_signal(spark, sf_dir), SERIES)
    return rounded(timedomain.time_domain_wide(stats, SUBJECT))


@query(
    "time_domain_by_supplier",
    with_(S.SUPPLIERS, _statistics("suppliers", "l_suppkey"))
    + "SELECT l_suppkey, "
    + ", ".join(r(e, n) for n, e in _STAT_SQL.items())
    + ", CAST(zcr AS BIGINT) AS zcr, CAST(zcr AS BIGINT) AS pkcnt FROM stats",
)
def time_domain_by_supplier(spark, sf_dir):
    """The same statistics for many series."""
    return rounded(timedomain.time_domain(stage(supplier_series(spark, sf_dir), "suppliers"), ["l_suppkey"]))


@query(
    "quantiles_by_rank",
    "SELECT l_suppkey, " + r("quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.25)", "q1", 4) + ", "
    + r("median(CAST(l_extendedprice AS DOUBLE))", "q2", 4) + ", "
    + r("quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.75)", "q3", 4) + " FROM lineitem GROUP BY l_suppkey",
)
def quantiles_by_rank(spark, sf_dir):
    """Exact quartiles from cluster-wide ranks, the way that long series take."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.col("l_extendedprice").cast("double").alias("price"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("n"),
    )
    wanted = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    return rounded(timedomain.quantiles(rows, ["l_suppkey"], "price", wanted, limit=0), 4)


_SHARES = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99}


@query(
    "sketched_quantiles",
    "SELECT l_suppkey, p AS share, count(*) AS rows, TRUE AS within FROM lineitem, (VALUES "
    + ", ".join(f"(CAST({p} AS DOUBLE))" for p in _SHARES.values()) + ") s(p) GROUP BY l_suppkey, p",
)
def sketched_quantiles(spark, sf_dir):
    """Quantiles from sketches, and whether each has the wanted rank within the stated error and one row."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").cast("double").alias("price"))
    found = timedomain.sketched_quantiles(rows, ["l_suppkey"], "price", _SHARES)
    asked = found.select("l_suppkey", F.inline(F.array(*[
        F.struct(F.lit(p).alias("share"), F.col(name).alias("found")) for name, p in _SHARES.items()
    ])))
    off = timedomain.rank_error(timedomain.SKETCH)
    # equal values share their ranks, so the wanted one must lie between those below and those up to the found value
    ranked = rows.join(asked, "l_suppkey").groupBy("l_suppkey", "share").agg(
        F.count("*").alias("rows"), F.count_if(F.col("price") < F.col("found")).alias("below"),
        F.count_if(F.col("price") <= F.col("found")).alias("upto"),
    )
    wanted, slack = F.col("share") * F.col("rows"), F.col("rows") * off + 1
    return ranked.select(
        "l_suppkey", "share", "rows", ((F.col("below") <= wanted + slack) & (F.col("upto") >= wanted - slack)).alias("within")
    )


@query(
    "series_positions",
    with_(S.SIGNAL)
    + "SELECT subject_id, side, event_id, CAST(n AS BIGINT) AS n, "
    + r("(epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY subject_id, side)) / 1000000.0", "elapsed_s")
    + " FROM signal",
)
def series_positions(spark, sf_dir):
    """Row numbers by range partitions and seconds since each series' first row."""
    rows = enumerate_rows(samples(spark, sf_dir), SERIES, ["ts", "event_id"], limit=0, ranges=16)
    first = rows.groupBy(*SERIES).agg(F.min("ts").alias("_t0"))
    timed = attach(rows, first, SERIES).select(*SERIES, "event_id", "n", seconds_between("_t0", "ts").alias("elapsed_s"))
    return rounded(timed)


@query(
    "first_and_last_rows",
    with_(S.SIGNAL)
    + "SELECT subject_id, side, arg_min(z, n) AS first_z, arg_max(z, n) AS last_z, min(ts) AS first_ts, max(ts) AS last_ts"
    + " FROM signal GROUP BY subject_id, side",
)
def first_and_last_rows(spark, sf_dir):
    order = F.struct("ts", "event_id")
    return samples(spark, sf_dir).groupBy(*SERIES).agg(
        F.min_by("z", order).alias("first_z"), F.max_by("z", order).alias("last_z"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


@query(
    "classifier_extremes",
    with_(S.SIGNAL)
    + "SELECT subject_id, min(CASE WHEN side = 'right' THEN z END) AS right_z_min, min(CASE WHEN side = 'left' THEN z END)"
    " AS left_z_min, max(CASE WHEN side = 'right' THEN z END) AS right_z_max, max(CASE WHEN side = 'left' THEN z END)"
    " AS left_z_max FROM signal GROUP BY subject_id",
)
def classifier_extremes(spark, sf_dir):
    """Minimum and maximum per side: the subject classifier's inputs."""
    return timedomain.extremes(samples(spark, sf_dir), SUBJECT)


@query(
    "zero_crossings",
    with_(S.SIGNAL)
    + "SELECT subject_id, side, CAST(n AS BIGINT) AS n, z FROM (SELECT *, lead(z) OVER (PARTITION BY subject_id, side"
    " ORDER BY n) AS next_z FROM signal) WHERE sign(next_z) <> sign(z)",
)
def zero_crossings(spark, sf_dir):
    found = phases.zero_crossings(signal_long(spark, sf_dir), SERIES)
    return found.select(*SERIES, "n", "z")


_STANCE = (
    "SELECT subject_id, side, CAST(phase_no AS BIGINT) AS phase_no, "
    + r("(epoch_us(min_t) - epoch_us(start_t)) / 1000000.0", "stance_s") + ", "
    + r("(epoch_us(end_t) - epoch_us(min_t)) / 1000000.0", "swing_s")
)


@query("stance_swing", with_(S.SIGNAL, S.phases("signal", KEYS, "z", "ts", 2)) + _STANCE + " FROM phases")
def stance_swing(spark, sf_dir):
    """Stance and swing seconds of every phase of the unfiltered signal."""
    return rounded(gait.stance_swing(staged_signal(spark, sf_dir), SUBJECT))


_TIMED = "timed AS (" + _STANCE.replace("round(", "(").replace(", 6) + 0.0", ")") + " FROM phases)"


@query(
    "phase_shares",
    with_(S.SIGNAL, S.phases("signal", KEYS, "z", "ts", 2), _TIMED)
    + "SELECT subject_id, side, phase_no, " + r("stance_s / nullif(stance_s + swing_s, 0) * 100", "stance_pct") + ", "
    + r("swing_s / nullif(stance_s + swing_s, 0) * 100", "swing_pct") + " FROM timed",
)
def phase_shares(spark, sf_dir):
    """Stance and swing as percent of the cycle."""
    return rounded(phases.phase_shares(gait.stance_swing(staged_signal(spark, sf_dir), SUBJECT), SERIES))


@query(
    "temporal_symmetry",
    with_(S.SIGNAL, S.phases("signal", KEYS, "z", "ts", 2), _TIMED)
    + "SELECT subject_id, " + r("rr", "right_ratio") + ", " + r("lr", "left_ratio") + ", "
    + r("rr / nullif(lr, 0)", "temporal_symmetry")
    + " FROM (SELECT subject_id, avg(CASE WHEN side = 'right' THEN swing_s END)"
    " / nullif(avg(CASE WHEN side = 'right' THEN stance_s END), 0) AS rr, avg(CASE WHEN side = 'left' THEN swing_s END)"
    " / nullif(avg(CASE WHEN side = 'left' THEN stance_s END), 0) AS lr FROM timed GROUP BY subject_id)",
)
def temporal_symmetry(spark, sf_dir):
    return rounded(phases.temporal_symmetry(gait.stance_swing(staged_signal(spark, sf_dir), SUBJECT), SUBJECT))


_SMOOTH_PHASES = with_(
    S.SIGNAL,
    S.low_pass("signal", KEYS),
    S.phases("smooth", KEYS, "z_filtered", "CAST(n AS DOUBLE) / 100", 1),
)
_PAIRED = (
    "paired AS (SELECT l.subject_id, l.phase_no, l.min_t - l.start_t AS ls, r.min_t - r.start_t AS rs,"
    " l.end_t - l.min_t AS lw, r.end_t - r.min_t AS rw FROM phases l JOIN phases r"
    " ON l.subject_id = r.subject_id AND l.phase_no = r.phase_no AND l.side = 'left' AND r.side = 'right')"
)
_PCT = ", ".join(
    r(e, a)
    for a, e in {
        "left_stance_s": "ls", "left_swing_s": "lw", "right_stance_s": "rs", "right_swing_s": "rw",
        "stance_diff_pct": "abs(ls - rs) / nullif(greatest(ls, rs), 0) * 100",
        "swing_diff_pct": "abs(lw - rw) / nullif(greatest(lw, rw), 0) * 100",
    }.items()
)


def _smoothed_phases(spark, sf_dir):
    rows = staged_signal(spark, sf_dir).withColumn("elapsed", F.col("n") / FS)
    smooth = stage(smoothing.low_pass(rows, SERIES, fs=FS, keep=["elapsed"]), "smooth")
    found = phases.phases(smooth, SERIES, value="z_filtered", time="elapsed", min_len=1)
    return stage(phases.durations(found, SERIES), "durations")


@query(
    "phase_differences",
    _SMOOTH_PHASES.rstrip() + ",\n" + _PAIRED + "\nSELECT subject_id, CAST(phase_no AS BIGINT) AS phase_no, " + _PCT + " FROM paired",
)
def phase_differences(spark, sf_dir):
    """Percent difference of the k-th left and right phases of the smoothed signal."""
    return rounded(phases.phase_differences(_smoothed_phases(spark, sf_dir), SUBJECT))


@query(
    "asymmetry_alerts",
    _SMOOTH_PHASES.rstrip() + ",\n" + _PAIRED
    + ",\npct AS (SELECT subject_id, CAST(phase_no AS BIGINT) AS phase_no, " + _PCT + " FROM paired)"
    + "\nSELECT *, coalesce(stance_diff_pct > 10, false) AS stance_alert, coalesce(swing_diff_pct > 10, false) AS swing_alert"
    " FROM pct WHERE stance_diff_pct > 10 OR swing_diff_pct > 10",
)
def asymmetry_alerts(spark, sf_dir):
    """Cycles in which a phase differs by more than 10 percent between the sides."""
    differences = rounded(phases.phase_differences(_smoothed_phases(spark, sf_dir), SUBJECT))
    return phases.asymmetry_alerts(differences, 10.0)


@query(
    "local_maxima",
    with_(S.SIGNAL, S.maxima("signal", KEYS, height=PEAK_HEIGHT)) + "SELECT subject_id, side, n, z FROM maxima",
)
def local_maxima(spark, sf_dir):
    return peaks.local_maxima(signal_long(spark, sf_dir), SERIES, height=PEAK_HEIGHT)


@query(
    "local_maxima_by_supplier",
    with_(S.SUPPLIERS, S.maxima("suppliers", "l_suppkey")) + "SELECT l_suppkey, n, z FROM maxima",
)
def local_maxima_by_supplier(spark, sf_dir):
    """Many series with many flat tops."""
    return peaks.local_maxima(supplier_series(spark, sf_dir), ["l_suppkey"])


_THINNED = (S.SIGNAL, S.maxima("signal", KEYS, height=PEAK_HEIGHT), S.thinned("maxima", KEYS, PEAK_DISTANCE))


@query(
    "peaks",
    with_(*_THINNED, recursive=True)
    + "SELECT subject_id, side, n, z FROM thinned JOIN maxima USING (subject_id, side, n)",
)
def find_peaks(spark, sf_dir):
    """Peaks at least 0.5 high and 10 samples apart."""
    return peaks.find_peaks(signal_long(spark, sf_dir), SERIES, height=PEAK_HEIGHT, distance=PEAK_DISTANCE)


@query(
    "peaks_by_supplier",
    with_(
        S.SUPPLIERS, S.maxima("suppliers", "l_suppkey"), S.thinned("maxima", "l_suppkey", 100), recursive=True
    )
    + "SELECT l_suppkey, n, z FROM thinned JOIN maxima USING (l_suppkey, n)",
)
def peaks_by_supplier(spark, sf_dir):
    """Peaks 100 samples apart in many series with many equal heights."""
    return peaks.find_peaks(supplier_series(spark, sf_dir), ["l_suppkey"], distance=100)


_STRIDES = with_(*_THINNED, S.numbered_strides("thinned", KEYS), recursive=True)


@query(
    "stride_times",
    _STRIDES + "SELECT subject_id, side, CAST(stride_no AS BIGINT) AS stride_no, start_n, end_n, stride_samples FROM strides",
)
def stride_times(spark, sf_dir):
    return gait.stride_times(staged_signal(spark, sf_dir), SUBJECT, PEAK_HEIGHT, PEAK_DISTANCE)


_PAIRS = (
    "pairs AS (SELECT l.subject_id, CAST(l.stride_no AS BIGINT) AS stride_no, l.stride_samples AS left_stride_samples,"
    " r.stride_samples AS right_stride_samples,"
    " CASE WHEN l.stride_samples + r.stride_samples = 0 THEN 0 ELSE (l.stride_samples - r.stride_samples)"
    " / CAST(l.stride_samples + r.stride_samples AS DOUBLE) END AS a,"
    " CASE WHEN greatest(l.stride_samples, r.stride_samples) = 0 THEN 0 ELSE least(l.stride_samples, r.stride_samples)"
    " / CAST(greatest(l.stride_samples, r.stride_samples) AS DOUBLE) END AS s FROM strides l JOIN strides r"
    " ON l.subject_id = r.subject_id AND l.stride_no = r.stride_no AND l.side = 'left' AND r.side = 'right')"
)


def _stride_symmetry(spark, sf_dir):
    found = stage(gait.stride_times(staged_signal(spark, sf_dir), SUBJECT, PEAK_HEIGHT, PEAK_DISTANCE), "strides")
    return gait.stride_symmetry(found, SUBJECT)


@query(
    "stride_symmetry",
    with_(*_THINNED, S.numbered_strides("thinned", KEYS), _PAIRS, recursive=True) + "SELECT subject_id, stride_no, left_stride_samples, right_stride_samples, "
    + r("a", "asymmetry_index") + ", " + r("s", "symmetry_ratio") + " FROM pairs",
)
def stride_symmetry(spark, sf_dir):
    """Asymmetry index and symmetry ratio of the k-th left and right stride."""
    return rounded(_stride_symmetry(spark, sf_dir))


@query(
    "stride_symmetry_summary",
    with_(*_THINNED, S.numbered_strides("thinned", KEYS), _PAIRS, recursive=True) + "SELECT subject_id, " + r("avg(a)", "asymmetry_index") + ", "
    + r("avg(s)", "symmetry_ratio") + " FROM pairs GROUP BY subject_id",
)
def stride_symmetry_summary(spark, sf_dir):
    return rounded(gait.summarize_symmetry(_stride_symmetry(spark, sf_dir), SUBJECT))


@query(
    "cadence",
    with_(*_THINNED, S.numbered_strides("thinned", KEYS), recursive=True).rstrip()
    + """,
placed AS (SELECT t.subject_id, t.side, t.n, s.ts FROM thinned t JOIN signal s USING (subject_id, side, n)),
spans AS (
  SELECT st.subject_id, st.side, (epoch_us(b.ts) - epoch_us(a.ts)) / 1000000.0 AS stride_s
  FROM strides st JOIN placed a ON a.subject_id = st.subject_id AND a.side = st.side AND a.n = st.start_n
                  JOIN placed b ON b.subject_id = st.subject_id AND b.side = st.side AND b.n = st.end_n),
steps AS (
  SELECT subject_id, epoch_us(ts) AS us, CASE WHEN side <> lag(side) OVER w
         THEN (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0 END AS step_s
  FROM placed WINDOW w AS (PARTITION BY subject_id ORDER BY ts, side))
SELECT subject_id, """
    + r("l", "left_stride_s", 4) + ", " + r("rt", "right_stride_s", 4) + ", " + r("st", "step_s", 4) + ", "
    + r("spm", "steps_per_minute")
    + """ FROM (SELECT subject_id, avg(CASE WHEN side = 'left' THEN stride_s END) AS l,
                       avg(CASE WHEN side = 'right' THEN stride_s END) AS rt FROM spans GROUP BY subject_id)
JOIN (SELECT subject_id, avg(step_s) AS st, count(*) / ((max(us) - min(us)) / 60000000.0) AS spm
      FROM steps GROUP BY subject_id) USING (subject_id)""",
)
def cadence(spark, sf_dir):
    """Stride and step seconds and steps per minute."""
    found = gait.cadence(staged_signal(spark, sf_dir), SUBJECT, PEAK_HEIGHT, PEAK_DISTANCE)
    return rounded(found, 4, steps_per_minute=6)


@query(
    "low_pass_filter",
    with_(S.SIGNAL, S.low_pass("signal", KEYS))
    + "SELECT subject_id, side, CAST(n AS BIGINT) AS n, " + r("z_filtered", "z_filtered") + " FROM smooth",
)
def low_pass_filter(spark, sf_dir):
    """Zero-phase Butterworth low-pass of every series."""
    smooth = smoothing.low_pass(signal_long(spark, sf_dir), SERIES, fs=FS)
    return rounded(smooth.select(*SERIES, "n", "z_filtered"))


CYCLE_DISTANCE = 50
_CYCLES = (
    S.low_pass("signal", KEYS),
    S.maxima("smooth", KEYS, value="z_filtered", out="tops"),
    S.thinned("tops", KEYS, CYCLE_DISTANCE, value="z_filtered", out="cycle_peaks"),
    S.numbered_strides("cycle_peaks", KEYS, out="cycles"),
)


@query(
    "cycles",
    with_(S.SIGNAL, *_CYCLES, recursive=True)
    + "SELECT subject_id, side, CAST(stride_no AS BIGINT) AS cycle_no, start_n, end_n, "
    + r("start_n / CAST(100 AS DOUBLE)", "start_s") + ", " + r("end_n / CAST(100 AS DOUBLE)", "end_s") + " FROM cycles",
)
def cycles(spark, sf_dir):
    """Cycles between consecutive peaks of the smoothed signal."""
    rows = staged_signal(spark, sf_dir).withColumn("elapsed", F.col("n") / FS)
    found, _ = gait.cycles(rows, SUBJECT, FS)
    return rounded(found)


_CROSS = """cycle_rows AS (
  SELECT c.subject_id, c.side, c.stride_no AS cycle_no, s.n - c.start_n AS k, s.z_filtered AS v
  FROM cycles c JOIN smooth s ON s.subject_id = c.subject_id AND s.side = c.side AND s.n >= c.start_n AND s.n < c.end_n),
heights AS (SELECT subject_id, cycle_no, max(CASE WHEN side = 'left' THEN v END) AS lp,
                max(CASE WHEN side = 'right' THEN v END) AS rp FROM cycle_rows GROUP BY subject_id, cycle_no),
shapes AS (
  SELECT a.subject_id, a.cycle_no, covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0) AS z_corr
  FROM cycle_rows a JOIN cycle_rows b
    ON a.subject_id = b.subject_id AND a.cycle_no = b.cycle_no AND a.k = b.k AND a.side = 'left' AND b.side = 'right'
  GROUP BY a.subject_id, a.cycle_no),
spans AS (
  SELECT l.subject_id, l.stride_no AS cycle_no,
         l.end_n / CAST(100 AS DOUBLE) - l.start_n / CAST(100 AS DOUBLE) AS ld,
         r.end_n / CAST(100 AS DOUBLE) - r.start_n / CAST(100 AS DOUBLE) AS rd
  FROM cycles l JOIN cycles r ON l.subject_id = r.subject_id AND l.stride_no = r.stride_no
   AND l.side = 'left' AND r.side = 'right'
  WHERE least(l.end_n - l.start_n, r.end_n - r.start_n) >= 5),
cross_limb AS (
  SELECT subject_id, CAST(cycle_no AS BIGINT) AS cycle_no, ld AS left_stride_duration, rd AS right_stride_duration,
         abs(ld - rd) AS stride_duration_diff, least(ld, rd) / nullif(greatest(ld, rd), 0) AS stride_duration_symmetry_ratio,
         lp AS left_peak, rp AS right_peak, abs(lp - rp) AS peak_diff, z_corr
  FROM spans JOIN heights USING (subject_id, cycle_no) JOIN shapes USING (subject_id, cycle_no))"""
CROSS_SQL = with_(S.SIGNAL, *_CYCLES, _CROSS, recursive=True)


def cross_limb_rows(spark, sf_dir):
    rows = staged_signal(spark, sf_dir).withColumn("elapsed", F.col("n") / FS)
    return gait.cross_limb(rows, SUBJECT, FS)


@query(
    "cross_limb_cycles",
    CROSS_SQL + "SELECT subject_id, cycle_no, " + ", ".join(r(c, c) for c in gait.CROSS_LIMB) + " FROM cross_limb",
)
def cross_limb_cycles(spark, sf_dir):
    """Durations, peaks and correlation of the i-th left and right cycle."""
    return rounded(cross_limb_rows(spark, sf_dir))


@query(
    "cross_limb_summary",
    CROSS_SQL
    + "SELECT subject_id, "
    + ", ".join(r(f"avg({c})", f"{c}_mean") + ", " + r(f"stddev_samp({c})", f"{c}_std") for c in gait.CROSS_LIMB)
    + " FROM cross_limb GROUP BY subject_id",
)
def cross_limb_summary(spark, sf_dir):
    return rounded(gait.mean_and_std(cross_limb_rows(spark, sf_dir), SUBJECT, exclude=["cycle_no"]))


_WINDOWS = f"""bounds AS (SELECT subject_id, min(ts) AS t0, max(ts) AS t1 FROM signal GROUP BY subject_id),
windowed AS (
  SELECT * FROM (
    SELECT subject_id, side, n, ts, z, CAST((epoch_us(ts) - epoch_us(t0)) // {int(SPECTRAL_WIDTH * 1e6)} AS BIGINT) AS window_id, t0, t1
    FROM signal JOIN bounds USING (subject_id))
  WHERE t0 + to_days(CAST({WINDOW_DAYS} * (window_id + 1) AS INTEGER)) <= t1)"""


@query(
    "tumbling_windows",
    with_(S.SIGNAL, _WINDOWS)
    + f"SELECT subject_id, side, window_id, t0 + to_days(CAST({WINDOW_DAYS} * window_id AS INTEGER)) AS start_time, count(*) AS samples,"
    " max(z) AS z_max FROM windowed GROUP BY subject_id, side, window_id, t0",
)
def tumbling_windows(spark, sf_dir):
    """Complete windows of two days, anchored at each subject's first sample."""
    rows = spectra.tumbling_windows(samples(spark, sf_dir), SUBJECT, SPECTRAL_WIDTH, spread="event_id")
    return rows.groupBy(*SERIES, "window_id", "start_time").agg(F.count("*").alias("samples"), F.max("z").alias("z_max"))


SPECTRA_SQL = [
    S.SIGNAL,
    _WINDOWS,
    """placed AS (
  SELECT subject_id, side, window_id, z, row_number() OVER (PARTITION BY subject_id, side, window_id ORDER BY n) - 1 AS i,
         count(*) OVER (PARTITION BY subject_id, side, window_id) AS samples FROM windowed)""",
    """bins AS (
  SELECT subject_id, side, window_id, samples, k,
         sum(z * cos(2 * pi() * k * i / samples)) ** 2 + sum(z * sin(2 * pi() * k * i / samples)) ** 2 AS power
  FROM placed, LATERAL (SELECT unnest(range(0, samples // 2)) AS k) WHERE samples >= 2
  GROUP BY subject_id, side, window_id, samples, k)""",
    f"""spectra AS (
  SELECT subject_id, side, window_id, samples, first(k ORDER BY power DESC, k) * {FS} / samples AS dominant_freq,
         -sum(power / total * log2(power / total + 1e-10)) AS spectral_entropy,
         sum(CASE WHEN k * CAST({FS} AS DOUBLE) / samples BETWEEN 0.5 AND 3 THEN power ELSE 0 END) AS gait_band_energy
  FROM (SELECT *, nullif(sum(power) OVER (PARTITION BY subject_id, side, window_id), 0) AS total FROM bins)
  GROUP BY subject_id, side, window_id, samples)""",
]


def spectral_rows(spark, sf_dir):
    return spectra.spectral_windows(signal_long(spark, sf_dir), SERIES, SUBJECT, fs=FS, width_s=SPECTRAL_WIDTH)


@query(
    "spectral_windows",
    with_(*SPECTRA_SQL) + "SELECT subject_id, side, window_id, CAST(samples AS BIGINT) AS samples, "
    + r("dominant_freq", "dominant_freq") + ", " + r("spectral_entropy", "spectral_entropy") + ", "
    + r("gait_band_energy", "gait_band_energy", 3) + " FROM spectra",
)
def spectral_windows(spark, sf_dir):
    """Dominant frequency, spectral entropy and band energy per window."""
    return rounded(spectral_rows(spark, sf_dir).drop("start_time", "end_time"), gait_band_energy=3)


@query(
    "spectral_summary",
    with_(*SPECTRA_SQL)
    + "SELECT subject_id, "
    + ", ".join(
        r(f"avg(CASE WHEN side = '{s}' THEN {f} END)", f"{s}_{f}_mean", 3 if "energy" in f else 6) + ", "
        + r(f"stddev_samp(CASE WHEN side = '{s}' THEN {f} END)", f"{s}_{f}_std", 3 if "energy" in f else 6)
        for s in ("left", "right") for f in spectra.FEATURES
    )
    + " FROM spectra GROUP BY subject_id",
)
def spectral_summary(spark, sf_dir):
    wide = spectra.summarize_spectra(spectral_rows(spark, sf_dir), SUBJECT)
    return rounded(wide, **{c: 3 for c in wide.columns if "energy" in c})


_SPECTRUM_SQL = (
    "WITH cells AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i,"
    " len(embedding) AS size FROM embeddings)"
    " SELECT vec_id, CAST(k AS INTEGER) AS bin, "
    + r("sum(v * cos(2 * pi() * k * i / size)) ** 2 + sum(v * sin(2 * pi() * k * i / size)) ** 2", "power")
    + " FROM cells, LATERAL (SELECT unnest(range(0, size // 2)) AS k) GROUP BY vec_id, k"
)


def _bins(spark, sf_dir, spectrum):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rounded(vectors.select("vec_id", F.posexplode(spectrum(F.col("v"))).alias("bin", "power")))


@query("power_spectrum", _SPECTRUM_SQL)
def power_spectrum_bins(spark, sf_dir):
    return _bins(spark, sf_dir, power_spectrum)


@query("power_spectrum_dft", _SPECTRUM_SQL)
def power_spectrum_dft_bins(spark, sf_dir):
    """The same spectrum without Python."""
    return _bins(spark, sf_dir, power_spectrum_dft)
