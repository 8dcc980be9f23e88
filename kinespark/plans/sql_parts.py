"""Common table expressions that the SQL texts of several queries share."""

from __future__ import annotations

from kinespark.functions.lowpass import PAD, impulse_response

SIGNAL = """signal AS (
  SELECT user_id % 10 AS subject_id, CASE WHEN user_id % 10 < 5 THEN 0 ELSE 1 END AS class_label,
         CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, event_id, ts, value - 34.5 AS z,
         row_number() OVER (PARTITION BY user_id % 10, event_id % 2 ORDER BY ts, event_id) - 1 AS n
  FROM events)"""

SUPPLIERS = """suppliers AS (
  SELECT l_suppkey, CAST(l_quantity - 25.5 AS DOUBLE) AS z,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS n
  FROM lineitem)"""

GRID = """grid AS (
  SELECT subject_id, side, CAST(dayofyear(ts) * 24 + hour(ts) AS BIGINT) AS hour_no, max(z) AS z
  FROM signal GROUP BY subject_id, side, dayofyear(ts), hour(ts))"""

# full outer join of the sides on the hour, forward-filled in time order
MERGED = """joined AS (
  SELECT coalesce(l.subject_id, r.subject_id) AS subject_id, coalesce(l.hour_no, r.hour_no) AS hour_no,
         l.z AS lz, r.z AS rz
  FROM (SELECT * FROM grid WHERE side = 'left') l
  FULL OUTER JOIN (SELECT * FROM grid WHERE side = 'right') r
    ON l.subject_id = r.subject_id AND l.hour_no = r.hour_no),
merged AS (
  SELECT subject_id, hour_no,
         last_value(lz IGNORE NULLS) OVER w AS left_z, last_value(rz IGNORE NULLS) OVER w AS right_z,
         row_number() OVER (PARTITION BY subject_id ORDER BY hour_no) - 1 AS n
  FROM joined
  WINDOW w AS (PARTITION BY subject_id ORDER BY hour_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

# every sample of the second sensor
SECOND = """second AS (
  SELECT user_id % 10 AS subject_id, CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, ts,
         (CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) - 50) * CAST(0.01 AS DOUBLE) AS z
  FROM events WHERE event_type <> 'error')"""


def asof(source: str, out: str, within: str = "", columns: str = "z") -> str:
    """Both sides' last values at or before every time stamp, not older than ``within``."""
    def value(side, column):
        return f"CASE WHEN s.ts - {side}.ts <= {within} THEN {side}.{column} END" if within else f"{side}.{column}"

    values = ", ".join(f"{value(side[0], c)} AS {side}_{c}" for side in ("left", "right") for c in columns)
    return f"""{out} AS (
  SELECT s.subject_id, s.ts, {values}, row_number() OVER (PARTITION BY s.subject_id ORDER BY s.ts) - 1 AS n
  FROM (SELECT DISTINCT subject_id, ts FROM {source}) s
  ASOF LEFT JOIN (SELECT * FROM {source} WHERE side = 'left') l ON l.subject_id = s.subject_id AND s.ts >= l.ts
  ASOF LEFT JOIN (SELECT * FROM {source} WHERE side = 'right') r ON r.subject_id = s.subject_id AND s.ts >= r.ts)"""


def complete(source: str, out: str, columns: str = "z") -> str:
    values = [f"{side}_{c}" for side in ("left", "right") for c in columns]
    return f"""{out} AS (
  SELECT subject_id, ts, {", ".join(values)}, row_number() OVER (PARTITION BY subject_id ORDER BY ts) - 1 AS n
  FROM {source} WHERE {" AND ".join(f"{v} IS NOT NULL" for v in values)})"""


# both sensors at full rate, paired by position after dropping incomplete rows
TWO_SENSORS = (
    SIGNAL, SECOND, asof("signal", "gyro_rows"), complete("gyro_rows", "gyro"), asof("second", "accel_rows"),
    complete("accel_rows", "accel"),
    """both_sensors AS (
  SELECT g.subject_id, g.n, g.ts, g.left_z AS gyro_left_z, g.right_z AS gyro_right_z,
         a.left_z AS accel_left_z, a.right_z AS accel_right_z
  FROM gyro g JOIN accel a ON a.subject_id = g.subject_id AND a.n = g.n)""",
)


# three axes of both sensors and sides, paired by position
TWELVE = (
    """axes AS (
  SELECT user_id % 10 AS subject_id, CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, ts,
         CAST(user_id % 97 - 48 AS DOUBLE) AS x, CAST(event_id % 101 - 50 AS DOUBLE) AS y, value - 34.5 AS z FROM events),
other_axes AS (
  SELECT user_id % 10 AS subject_id, CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, ts,
         (user_id % 89 - 44) * CAST(0.01 AS DOUBLE) AS x, (event_id % 103 - 51) * CAST(0.01 AS DOUBLE) AS y,
         (CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) - 50) * CAST(0.01 AS DOUBLE) AS z
  FROM events WHERE event_type <> 'error')""",
    asof("axes", "gyro_rows", columns="xyz"), complete("gyro_rows", "gyro", "xyz"),
    asof("other_axes", "accel_rows", columns="xyz"), complete("accel_rows", "accel", "xyz"),
    "both_sensors AS (SELECT g.subject_id, g.n, g.ts, "
    + ", ".join(f"{t[0]}.{side}_{c} AS {t}_{side}_{c}" for t in ("gyro", "accel") for side in ("left", "right") for c in "xyz")
    + " FROM gyro g JOIN accel a ON a.subject_id = g.subject_id AND a.n = g.n)",
)


def maxima(source: str, keys: str, value: str = "z", height: float | None = None, out: str = "maxima") -> str:
    """Runs of equal values that rise on the left and fall on the right; the middle, rounded down."""
    cut = f"AND {value} >= {height}" if height is not None else ""
    return f"""{out}_flag AS (
  SELECT {keys}, n, {value},
         CASE WHEN lag({value}) OVER (PARTITION BY {keys} ORDER BY n) = {value} THEN 0 ELSE 1 END AS fresh
  FROM {source}),
{out}_run AS (
  SELECT {keys}, n, {value}, sum(fresh) OVER (PARTITION BY {keys} ORDER BY n ROWS UNBOUNDED PRECEDING) AS run_no
  FROM {out}_flag),
{out}_span AS (
  SELECT {keys}, run_no, min({value}) AS {value}, min(n) AS first_n, max(n) AS last_n FROM {out}_run GROUP BY {keys}, run_no),
{out} AS (
  SELECT {keys}, CAST((first_n + last_n) // 2 AS BIGINT) AS n, {value}
  FROM (SELECT *, lag({value}) OVER w AS before_v, lead({value}) OVER w AS after_v FROM {out}_span
        WINDOW w AS (PARTITION BY {keys} ORDER BY run_no))
  WHERE before_v < {value} AND after_v < {value} {cut})"""


def thinned(source: str, keys: str, distance: int, value: str = "z", out: str = "thinned") -> str:
    """Highest first; needs WITH RECURSIVE."""
    on = " AND ".join(f"c.{k.strip()} = g.{k.strip()}" for k in keys.split(","))
    gk = ", ".join(f"g.{k.strip()}" for k in keys.split(","))
    return f"""{out}_rank AS (
  SELECT {keys}, n, row_number() OVER (PARTITION BY {keys} ORDER BY {value} DESC, n DESC) AS place FROM {source}),
{out}_walk AS (
  SELECT DISTINCT {keys}, CAST(0 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS kept FROM {out}_rank
  UNION ALL
  SELECT {gk}, c.place,
         CASE WHEN len(list_filter(g.kept, lambda k: abs(k - c.n) < {distance})) > 0 THEN g.kept
              ELSE list_append(g.kept, c.n) END
  FROM {out}_walk g JOIN {out}_rank c ON {on} AND c.place = g.place + 1),
{out} AS (
  SELECT {keys}, unnest(kept) AS n FROM (
    SELECT {keys}, arg_max(kept, place) AS kept FROM {out}_walk GROUP BY {keys}))"""


def numbered_strides(peaks: str, keys: str, out: str = "strides") -> str:
    return f"""{out} AS (
  SELECT * FROM (
    SELECT {keys}, lag(n) OVER w AS start_n, n AS end_n, n - lag(n) OVER w AS stride_samples,
           row_number() OVER w - 2 AS stride_no
    FROM {peaks} WINDOW w AS (PARTITION BY {keys} ORDER BY n))
  WHERE start_n IS NOT NULL)"""


def phases(source: str, keys: str, value: str, time: str, min_len: int, out: str = "phases") -> str:
    return f"""{out}_mark AS (
  SELECT {keys}, n, {value} AS v, {time} AS t, lead({time}) OVER w AS next_t,
         CASE WHEN sign(lead({value}) OVER w) <> sign({value}) THEN 1 ELSE 0 END AS crossed
  FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY n)),
{out}_segment AS (
  SELECT *, sum(crossed) OVER (PARTITION BY {keys} ORDER BY n ROWS UNBOUNDED PRECEDING) AS segment FROM {out}_mark),
{out}_all AS (
  SELECT {keys}, segment, min(n) AS start_n, max(n) + 1 AS end_n, arg_min(t, n) AS start_t, arg_max(next_t, n) AS end_t,
         max(CASE WHEN next_t IS NULL THEN 1 ELSE 0 END) AS unfinished,
         first(n ORDER BY v, n) AS min_n, first(t ORDER BY v, n) AS min_t
  FROM {out}_segment WHERE segment > 0 GROUP BY {keys}, segment),
{out} AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY start_n) - 1 AS phase_no
  FROM {out}_all WHERE unfinished = 0 AND end_n - start_n >= {min_len})"""


def low_pass(source: str, keys: str, cutoff: float = 6.0, fs: float = 100.0, out: str = "smooth") -> str:
    """Both filter passes as sums over the impulse response, on the series extended by odd reflection."""
    h = impulse_response(cutoff, fs)
    total = 0.0
    rows = []
    for k, tap in enumerate(h):
        total += float(tap)
        rows.append(f"({k}, CAST({float(tap)!r} AS DOUBLE), CAST({1.0 - total!r} AS DOUBLE))")
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    ak = ", ".join(f"a.{k.strip()}" for k in keys.split(","))

    def one_way(src, dst, order):
        """y[m] = Σ h[k]·e[m−k] + (1 − Σ h[k ≤ m])·e[0], m counting from the pass's own start."""
        return f"""{dst}_pos AS (
  SELECT {keys}, n, v, row_number() OVER (PARTITION BY {keys} ORDER BY n {order}) - 1 AS m FROM {src}),
{dst} AS (
  SELECT {ak}, a.n, sum(t.tap * b.v + CASE WHEN b.m = 0 THEN t.rest * b.v ELSE 0 END) AS v
  FROM {dst}_pos a JOIN taps t ON t.k <= a.m JOIN {dst}_pos b ON {on} AND b.m = a.m - t.k
  GROUP BY {ak}, a.n)"""

    return f"""taps(k, tap, rest) AS (VALUES {", ".join(rows)}),
{out}_ends AS (
  SELECT {keys}, arg_min(z, n) AS first_z, arg_max(z, n) AS last_z, max(n) AS last_n FROM {source}
  GROUP BY {keys} HAVING count(*) > {PAD}),
{out}_padded AS (
  SELECT {keys}, n, z AS v FROM {source} SEMI JOIN {out}_ends USING ({keys})
  UNION ALL SELECT {keys}, -n, 2 * first_z - z FROM {source} JOIN {out}_ends USING ({keys}) WHERE n BETWEEN 1 AND {PAD}
  UNION ALL SELECT {keys}, 2 * last_n - n, 2 * last_z - z FROM {source} JOIN {out}_ends USING ({keys})
    WHERE n BETWEEN last_n - {PAD} AND last_n - 1),
{one_way(f"{out}_padded", f"{out}_there", "ASC")},
{one_way(f"{out}_there", f"{out}_back", "DESC")},
{out} AS (
  SELECT {keys}, n, v AS z_filtered FROM {out}_back JOIN {out}_ends USING ({keys}) WHERE n BETWEEN 0 AND last_n)"""
