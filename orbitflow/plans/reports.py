"""What a user asks of recordings, each as a chain of operators: the odometry report, the sensor check, map quality, the live views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitflow.config import MAP_VOXEL, Config
from orbitflow.functions import codec
from orbitflow.operators import align, buffers, framing, health, mapping, odometry, results, rolling, trajectory


def frames_report(datagrams: DataFrame, config: Config | None = None) -> DataFrame:
    """Each frame's scans, points, stretch of time and span, over all recordings at once."""
    c = config or Config()
    m = codec.decode(datagrams)
    return framing.frames(codec.scans(m), codec.imu_samples(m), c.frame_duration, rotate=c.rotate_with_imu).drop("points")


def odometry_report(datagrams: DataFrame, meta: DataFrame | None = None, config: Config | None = None, scale: float = 1.0, **extra) -> tuple[DataFrame, DataFrame]:
    """(poses, one result row a recording); ``scale`` corrects positions before anything is measured."""
    c = config or Config()
    poses = trajectory.scaled(odometry.replay(datagrams, c), scale)
    return poses, results.run_row(poses, meta, c, **extra)


def precheck(datagrams: DataFrame, meta: DataFrame | None = None, config: Config | None = None) -> dict[str, DataFrame]:
    """The parts of the sensor check, by name; each is a table by recording. One decoding serves all if the caller caches ``datagrams``' decoded form."""
    c = config or Config()
    m = codec.decode(datagrams)
    scans, imu = codec.scans(m), codec.imu_samples(m)
    kind = health.recording_kind(health.yaw_summary(imu), meta)
    p = scans.select("recording_id", F.explode("points").alias("p")).select("recording_id", "p.ring", *[F.col(f"p.{a}").cast("double").alias(a) for a in "xyz"])
    seen = p.where("x <> 0 OR y <> 0 OR z <> 0").withColumn("r", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))
    pivots = seen.join(kind.where("kind = 'pivot'").select("recording_id"), "recording_id", "left_semi")
    cells = health.self_hit_cells(pivots)
    bands = health.self_hit_bands(cells)
    streams, radius, shaking = health.stream_health(scans, imu), health.self_hit_radius(cells, bands), health.vibration(health.spectra(imu), c)
    return {
        "streams": streams, "kind": kind, "histogram": health.range_histogram(seen), "min_range": health.min_range_sweep(seen, c.min_range),
        "self_hits": cells, "self_hit_bands": bands, "self_hit_radius": radius, "vibration": shaking, "verdict": health.go_no_go(kind, streams, radius, shaking, c),
    }


def map_quality(datagrams: DataFrame, boxes: dict[str, tuple[tuple, tuple]], map_voxel: float = MAP_VOXEL, config: Config | None = None, expected_angle: float | None = None, expected_distance: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(extent of each map, a row for each plane)."""
    cloud = odometry.accumulate_map(datagrams, map_voxel, config=config)
    planes = mapping.fit_plane(mapping.in_boxes(cloud, boxes), keys=["recording_id", "box"])
    return mapping.extent(cloud, ["recording_id"]), mapping.plane_report(planes, expected_angle, expected_distance)


def compare_deskew(datagrams: DataFrame, map_voxel: float = MAP_VOXEL, config: Config | None = None) -> DataFrame:
    """Map points with and without motion compensation, as ``cloud`` deskew or raw."""
    return odometry.accumulate_map(datagrams, map_voxel, True, config).withColumn("cloud", F.lit("deskew")).unionByName(odometry.accumulate_map(datagrams, map_voxel, False, config).withColumn("cloud", F.lit("raw")))


def latest_view(datagrams: DataFrame, max_scans: int = 100) -> dict[str, DataFrame]:
    """What a monitor shows: the newest messages, counters, and the rolling cloud's centroid and nearest return."""
    m = codec.decode(datagrams)
    scans, imu = codec.scans(m), codec.imu_samples(m)
    window = rolling.window_scans(framing.ingest(align.align(scans, imu)), max_scans)
    return {"scan": buffers.latest(scans), "imu": buffers.latest(imu), "stats": buffers.stream_stats(m), "cloud": rolling.centroid_and_nearest(rolling.points(window))}
