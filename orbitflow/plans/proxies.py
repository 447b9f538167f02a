"""Sensor-shaped inputs from the star-schema tables, for queries that must run without recordings.

Every derivation has a twin in SQL (``CTES``), so that another engine can check the operators on the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitflow.functions import geometry as G

SCAN_EVENTS, IMU_EVENTS = ("view", "click", "purchase"), ("signup", "error")
TOLERANCE, DURATION, FEWEST = 1800.0, 21600.0, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as rows of a recording: recording_id, seq, stamp, value, user_id, event_type."""
    since = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("r"), (F.col("user_id") % 8).cast("string")).alias("recording_id"), F.col("event_id").alias("seq"), (since.cast("double") / 1000000.0).alias("stamp"), F.col("value").cast("double").alias("value"), "user_id", "event_type")


def heading(value=None):
    half = F.radians(F.col("value") if value is None else value) / 2
    return G.quat(F.lit(0.0), F.lit(0.0), F.sin(half), F.cos(half))


def imu(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stamped(spark, sf_dir).where(F.col("event_type").isin(*IMU_EVENTS))
    zero = F.lit(0.0)
    return e.select("recording_id", "seq", "stamp", F.col("seq").alias("id"), heading().alias("q"), G.vec(F.col("value"), zero, zero).alias("gyro"), G.vec(zero, zero, F.col("value")).alias("accel"))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four points a scan; the first is a zero return for every third user."""
    e = stamped(spark, sf_dir).where(F.col("event_type").isin(*SCAN_EVENTS))

    def point(i):
        return F.struct(
            (F.col("value") * i).cast("float").alias("x"), (i * 0.5).cast("float").alias("y"), (F.col("user_id") % 3).cast("float").alias("z"),
            F.lit(10.0).cast("float").alias("intensity"), (i * 0.001).cast("float").alias("time"), i.cast("long").alias("ring"),
        )

    points = F.transform(F.sequence(F.lit(0), (F.col("seq") % 4).cast("int")), point)
    return e.select("recording_id", "seq", "stamp", F.col("seq").alias("id"), F.size(points).alias("valid_points_num"), points.alias("points"))


def datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both streams as packets, arriving when they were stamped."""
    from orbitflow.functions.codec import pack_imu, pack_scan

    s = scans(spark, sf_dir).select("recording_id", "seq", F.col("stamp").alias("recv_time"), pack_scan(F.struct("stamp", "id", "valid_points_num", "points")).alias("payload"))
    i = imu(spark, sf_dir).select("recording_id", "seq", F.col("stamp").alias("recv_time"), pack_imu(F.struct("stamp", "id", "q", "gyro", "accel")).alias("payload"))
    return s.unionByName(i)


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    at = li.select(
        F.concat(F.lit("r"), (F.col("l_suppkey") % 4).cast("string")).alias("recording_id"), F.col("l_linenumber").cast("long").alias("ring"), "l_orderkey", "l_partkey",
        (F.col("l_quantity") / 10.0).alias("x"), (F.col("l_extendedprice") / 20000.0).alias("y"), (F.col("l_discount") * 10.0).alias("z"),
    )
    return at.withColumn("r", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """21 points for each embedding; ord is their order."""
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    p = e.select(F.concat(F.lit("m"), F.coalesce(F.col("label"), F.lit(-1)).cast("string")).alias("recording_id"), "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k"))
    xyz = [F.get("embedding", F.col("k") * 3 + j).cast("double").alias(c) for j, c in enumerate("xyz")]
    return p.select("recording_id", (F.col("vec_id") * 21 + F.col("k")).alias("ord"), *xyz)


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk for each user; frame_id is the event."""
    angle = F.radians((F.col("event_id") % 360).cast("double"))
    value = F.col("value").cast("double")
    c, s = F.cos(F.radians(value)), F.sin(F.radians(value))
    zero, one = F.lit(0.0), F.lit(1.0)
    delta = F.array(c, -s, zero, zero, s, c, zero, zero, zero, zero, one, zero, zero, zero, zero, one)
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("recording_id"), F.col("event_id").alias("frame_id"), (value * F.cos(angle)).alias("x"), (value * F.sin(angle)).alias("y"), (value / 10.0).alias("z"),
        delta.alias("delta"), value.alias("threshold"), (value / 100.0).alias("span"), (F.col("event_id") % 50).alias("size"), (value / 1000.0).alias("seconds"),
    )


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ("loop", "line", "stationary", "pivot"))), (F.col("c_custkey") % 4).cast("int"))
    known = F.col("c_custkey") % 5 != 0
    # A third are no user's, so that lookups miss.
    name = F.when(F.col("c_custkey") % 3 == 0, "other").otherwise("u")
    return table(spark, sf_dir, "customer").select(
        F.concat(name, F.col("c_custkey").cast("string")).alias("recording_id"), kind.alias("kind"), F.col("c_mktsegment").alias("environment"), F.when(F.col("c_custkey") % 2 == 0, 0.5).alias("speed_mps"),
        F.when(known, F.col("c_acctbal")).alias("truth_m"), F.when(known, "tape").alias("truth_method"),
    )


def walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wall (x = 3) and a floor (z = -0.5) for each of four recordings, a fifth of their points well off them."""
    c = table(spark, sf_dir, "customer")
    a, b, off = F.col("c_custkey") % 97 / 20.0, F.col("c_custkey") % 89 / 30.0, F.when(F.col("c_custkey") % 5 == 0, 1.0 + F.col("c_custkey") % 7 * 0.5).otherwise(0.0)
    rows = c.select(F.concat(F.lit("w"), (F.col("c_nationkey") % 4).cast("string")).alias("recording_id"), (F.col("c_custkey") * 2).alias("ord"), a.alias("a"), b.alias("b"), off.alias("off"))
    wall = rows.select("recording_id", F.lit("wall").alias("box"), "ord", (3.0 + F.col("off")).alias("x"), F.col("a").alias("y"), F.col("b").alias("z"))
    floor = rows.select("recording_id", F.lit("floor").alias("box"), (F.col("ord") + 1).alias("ord"), F.col("a").alias("x"), F.col("b").alias("y"), (F.col("off") - 0.5).alias("z"))
    return wall.unionByName(floor)


def shaking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inertial samples at 250 Hz (by their number in the recording) that shake at a tenth of that rate, a multiple of the spectrum's resolution; still around z."""
    e = stamped(spark, sf_dir).where(F.col("event_type").isin(*IMU_EVENTS)).select("recording_id", "seq")
    w = Window.partitionBy("recording_id").orderBy("seq")
    i = e.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("recording_id")))
    wave = F.sin(2 * 3.141592653589793 * F.floor(F.col("n") / 10) * F.col("i") / F.col("n"))
    zero = F.lit(0.0)
    return i.select("recording_id", "seq", (F.col("i") / 250.0).alias("stamp"), F.col("seq").alias("id"), G.quat(zero, zero, zero, F.lit(1.0)).alias("q"), G.vec(0.1 * wave, zero, zero).alias("gyro"), G.vec(zero, 2.0 * wave, zero).alias("accel"))


#: The same derivations for DuckDB.
CTES = f"""
ev AS (SELECT 'r' || (user_id % 8)::VARCHAR AS recording_id, event_id AS seq, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts)::DOUBLE / 1000000.0::DOUBLE AS stamp, value::DOUBLE AS value, user_id, event_type FROM events),
imu AS (SELECT * FROM ev WHERE event_type IN ('signup', 'error')),
scans AS (SELECT * FROM ev WHERE event_type IN ('view', 'click', 'purchase')),
pts AS (
  SELECT recording_id, seq, stamp, i AS pos, (value * i)::FLOAT::DOUBLE AS x, (i * 0.5::DOUBLE)::FLOAT::DOUBLE AS y, (user_id % 3)::FLOAT::DOUBLE AS z, (i * 0.001::DOUBLE)::FLOAT::DOUBLE AS time, i::BIGINT AS ring
  FROM (SELECT *, unnest(range(0, seq % 4 + 1)) AS i FROM scans)
),
back AS (SELECT s.recording_id, s.seq, s.stamp, i.seq AS lseq, i.stamp AS lst, i.value AS lv FROM scans s ASOF LEFT JOIN imu i ON s.recording_id = i.recording_id AND s.stamp > i.stamp),
ahead AS (SELECT s.seq, i.seq AS rseq, i.stamp AS rst, i.value AS rv FROM scans s ASOF LEFT JOIN imu i ON s.recording_id = i.recording_id AND s.stamp <= i.stamp),
near AS (
  SELECT b.recording_id, b.seq, b.stamp, lst IS NOT NULL AND (rst IS NULL OR b.stamp - lst <= rst - b.stamp) AS earlier, lseq, lst, lv, rseq, rst, rv FROM back b JOIN ahead a ON a.seq = b.seq
),
met0 AS (SELECT recording_id, seq, stamp, CASE WHEN earlier THEN stamp - lst ELSE rst - stamp END AS gap, CASE WHEN earlier THEN lseq ELSE rseq END AS imu_seq, CASE WHEN earlier THEN lv ELSE rv END AS v FROM near),
met AS (
  SELECT m.recording_id, seq, stamp, CASE WHEN gap <= {TOLERANCE}::DOUBLE THEN gap END AS gap, CASE WHEN gap <= {TOLERANCE}::DOUBLE THEN imu_seq END AS imu_seq, v,
         CASE WHEN gap <= {TOLERANCE}::DOUBLE THEN 'matched' WHEN n.newest IS NULL OR stamp > n.newest THEN 'pending' ELSE 'unmatched' END AS state
  FROM met0 m LEFT JOIN (SELECT recording_id, max(stamp) AS newest FROM imu GROUP BY 1) n ON n.recording_id = m.recording_id
),
ing AS (
  SELECT p.recording_id, p.seq, p.stamp, p.pos, p.z AS z, p.stamp + p.time AS t, m.v,
         p.x * cos(radians(m.v)) - p.y * sin(radians(m.v)) AS x, p.x * sin(radians(m.v)) + p.y * cos(radians(m.v)) AS y
  FROM pts p JOIN met m ON m.seq = p.seq WHERE m.state = 'matched' AND (p.x <> 0 OR p.y <> 0 OR p.z <> 0)
),
live AS (SELECT DISTINCT recording_id, seq, stamp FROM ing),
nxt AS MATERIALIZED (SELECT a.recording_id, a.stamp, b.stamp AS later FROM (SELECT recording_id, stamp, stamp + {DURATION}::DOUBLE AS reach FROM live) a ASOF LEFT JOIN live b ON a.recording_id = b.recording_id AND a.reach <= b.stamp),
starts AS (
  SELECT recording_id, min(stamp) AS t0, 0::BIGINT AS frame_id FROM live GROUP BY 1
  UNION ALL
  SELECT s.recording_id, n.later, s.frame_id + 1 FROM starts s JOIN nxt n ON n.recording_id = s.recording_id AND n.stamp = s.t0 WHERE n.later IS NOT NULL
),
framed AS (SELECT l.recording_id, l.seq, s.t0, s.frame_id FROM live l ASOF JOIN starts s ON l.recording_id = s.recording_id AND l.stamp >= s.t0),
still AS (SELECT DISTINCT recording_id, seq, stamp FROM pts WHERE x <> 0 OR y <> 0 OR z <> 0),
still_next AS MATERIALIZED (SELECT a.recording_id, a.stamp, b.stamp AS later FROM (SELECT recording_id, stamp, stamp + {DURATION}::DOUBLE AS reach FROM still) a ASOF LEFT JOIN still b ON a.recording_id = b.recording_id AND a.reach <= b.stamp),
still_starts AS (
  SELECT recording_id, min(stamp) AS t0, 0::BIGINT AS frame_id FROM still GROUP BY 1
  UNION ALL
  SELECT s.recording_id, n.later, s.frame_id + 1 FROM still_starts s JOIN still_next n ON n.recording_id = s.recording_id AND n.stamp = s.t0 WHERE n.later IS NOT NULL
),
still_frames AS (
  SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY frame_id) - 1 AS frame_id, t_start, t_end, n_scans, n_points FROM (
    SELECT f.recording_id, f.frame_id, min(p.stamp + p.time) AS t_start, max(p.stamp + p.time) AS t_end, count(DISTINCT p.seq) AS n_scans, count(*) AS n_points
    FROM (SELECT l.recording_id, l.seq, s.frame_id FROM still l ASOF JOIN still_starts s ON l.recording_id = s.recording_id AND l.stamp >= s.t0) f JOIN pts p ON p.seq = f.seq WHERE p.x <> 0 OR p.y <> 0 OR p.z <> 0 GROUP BY 1, 2) WHERE n_points >= {FEWEST}
),
frames AS (
  SELECT f.recording_id, f.frame_id, min(f.t0) AS frame_t0, min(i.t) AS t_start, max(i.t) AS t_end, count(DISTINCT f.seq) AS n_scans, count(*) AS n_points
  FROM framed f JOIN ing i ON i.seq = f.seq GROUP BY 1, 2
),
ret AS (
  SELECT *, sqrt(x * x + y * y + z * z) AS r FROM (
    SELECT 'r' || (l_suppkey % 4)::VARCHAR AS recording_id, l_linenumber::BIGINT AS ring, l_orderkey, l_partkey, l_quantity / 10.0::DOUBLE AS x, l_extendedprice / 20000.0::DOUBLE AS y, l_discount * 10.0::DOUBLE AS z FROM lineitem)
),
cloud AS (
  SELECT 'm' || coalesce(label, -1)::VARCHAR AS recording_id, vec_id * 21 + k AS ord, embedding[3 * k + 1]::DOUBLE AS x, embedding[3 * k + 2]::DOUBLE AS y, embedding[3 * k + 3]::DOUBLE AS z
  FROM (SELECT *, unnest(range(0, 21)) AS k FROM embeddings WHERE embedding IS NOT NULL)
),
poses AS (
  SELECT 'u' || user_id::VARCHAR AS recording_id, event_id AS frame_id, value * cos(radians((event_id % 360)::DOUBLE)) AS x, value * sin(radians((event_id % 360)::DOUBLE)) AS y, value / 10.0::DOUBLE AS z,
         value AS threshold, value / 100.0::DOUBLE AS span, event_id % 50 AS size, value / 1000.0::DOUBLE AS seconds, value FROM events
),
steps AS (
  SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)) AS step,
         sqrt((nx + px - 2 * x) * (nx + px - 2 * x) + (ny + py - 2 * y) * (ny + py - 2 * y) + (nz + pz - 2 * z) * (nz + pz - 2 * z)) AS second
  FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM poses WINDOW w AS (PARTITION BY recording_id ORDER BY frame_id))
),
path AS (
  SELECT recording_id, count(*) AS frames, coalesce(sum(step), 0) AS path_length, coalesce(median(second), 0) / 2.45::DOUBLE / 0.89::DOUBLE * 1000 AS jitter_mm,
         sqrt((arg_max(x, frame_id) - arg_min(x, frame_id)) ** 2 + (arg_max(y, frame_id) - arg_min(y, frame_id)) ** 2 + (arg_max(z, frame_id) - arg_min(z, frame_id)) ** 2) AS net_displacement
  FROM steps GROUP BY 1
),
meta AS (
  SELECT CASE WHEN c_custkey % 3 = 0 THEN 'other' ELSE 'u' END || c_custkey::VARCHAR AS recording_id, (['loop', 'line', 'stationary', 'pivot'])[c_custkey % 4 + 1] AS kind, c_mktsegment AS environment, CASE WHEN c_custkey % 2 = 0 THEN 0.5::DOUBLE END AS speed_mps,
         CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS truth_m, CASE WHEN c_custkey % 5 <> 0 THEN 'tape' END AS truth_method
  FROM customer
)
"""
