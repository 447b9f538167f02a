import ast
from pathlib import Path

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from orbitflow import config, schemas
from orbitflow.operators import buffers, health, results, trajectory

EYE = np.eye(4).ravel().tolist()


def poses(spark, xyz, **more):
    rows = [("r", i, i * 0.2, *map(float, p), EYE, EYE, 0.4 + i, 0.2, 100 + i, 0.05) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, schemas.POSES)


def test_path_metrics(spark):
    m = trajectory.path_metrics(poses(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0)])).first()
    assert (m.frames, m.path_length, m.net_displacement, m.jitter_mm, m.loop_pct) == (3, 2.0, 2.0, 0.0, 100.0)
    one = trajectory.path_metrics(poses(spark, [(1, 1, 1)])).first()
    assert (one.path_length, one.net_displacement, one.jitter_mm) == (0.0, 0.0, 0.0)
    z = trajectory.path_metrics(poses(spark, [(0, 0, 0), (1, 0, 0), (0, 0, 0)])).first()
    assert np.isclose(z.jitter_mm, 2 / 2.45 / 0.89 * 1000)
    assert trajectory.path_metrics(poses(spark, [])).count() == 0


def test_clipping_and_profile(spark):
    rest, go = [(0, 0, 0)] * 3, [(0.2 * i, 0, 0) for i in range(1, 4)]
    c = trajectory.clipping(poses(spark, rest + go + [go[-1]] * 2)).first()
    assert (c.head, c.tail, c.start_clipped, c.end_clipped) == (2, 2, False, False)
    c = trajectory.clipping(poses(spark, go)).first()
    assert (c.head, c.tail, c.start_clipped, c.end_clipped) == (0, 0, True, True)
    c = trajectory.clipping(poses(spark, rest)).first()
    assert (c.head, c.tail, c.start_clipped, c.end_clipped) == (0, 0, False, False)
    assert trajectory.sparkline(poses(spark, rest + go)).first().profile == "  !!!".replace("!", "#")


def test_run_row_and_truth(spark):
    meta = spark.createDataFrame([("r", "line", "lab", 0.5, 2.1, "tape")], "recording_id string, kind string, environment string, speed_mps double, truth_m double, truth_method string")
    p = poses(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0)])
    row = results.run_row(p, meta, note="n").first()
    assert row.scale_error_pct == -4.762 and row["cfg.voxel_size"] == 0.15 and row.note == "n" and row.environment == "lab" and row.frames == 3 and row.ms_per_frame == 50.0
    assert results.run_row(p, meta, truth=0.0).first().scale_error_pct is None and results.run_row(p).first().kind is None
    v = trajectory.verdicts(p, meta).first()
    assert np.isclose(v.scale_error_pct, -4.7619, atol=1e-3) and any("CLIPPED" in w for w in v.warnings)
    assert trajectory.scaled(p, 2).agg(F.max("x")).first()[0] == 4


def test_tables_widen_and_flatten(spark):
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2, 3)], "a int, c int")
    t = results.widen(results.widen(None, a), b)
    assert t.columns == ["a", "b", "c"] and rows_of(t) == [("1", "x", None), ("2", None, "3")]
    n = results.flatten(spark.sql("SELECT 1 AS a, named_struct('b', 2, 'c', named_struct('d', array(1, 2))) AS s"))
    assert n.columns == ["a", "s.b", "s.c.d"] and tuple(n.first()) == (1, 2, "[1, 2]")
    assert results.tags(["k=v=w"]) == {"k": "v=w"}
    with pytest.raises(ValueError):
        results.tags(["k"])
    m = spark.createDataFrame([("a", "loop", None, 0.5, 3.0, "tape"), ("b", None, "", None, None, None)], "recording_id string, kind string, environment string, speed_mps double, truth_m double, truth_method string")
    assert [r.summary for r in results.meta_summary(m).orderBy("recording_id").collect()] == ["loop  0.5 m/s  truth 3.0 m (tape)", "NO TRUTH RECORDED"]


def test_buffers(spark):
    df = spark.createDataFrame([("a", i) for i in range(8)] + [("b", 0)], "recording_id string, seq long")
    assert rows_of(buffers.latest_n(df, 3, 5)) == [("a", 5, 1), ("a", 6, 2), ("a", 7, 3), ("b", 0, 1)]
    assert rows_of(buffers.latest(df)) == [("a", 7), ("b", 0)]
    assert rows_of(buffers.counters(df, 5)) == [("a", 8, 5, 3), ("b", 1, 1, 0)]
    for bad, error in ((0, ValueError), (6, ValueError), (True, TypeError), (1.0, TypeError)):
        with pytest.raises(error):
            buffers.latest_n(df, bad, 5)
    with pytest.raises(Exception, match="fewer"):
        buffers.latest_n(df, 3, 5, allow_partial=False).collect()


def test_yaw_and_kinds(spark):
    def samples(degrees):
        return spark.createDataFrame([("r", i, 0.01 * i, i, (0.0, 0.0, float(np.sin(np.radians(d) / 2)), float(np.cos(np.radians(d) / 2))), (0.0,) * 3, (0.0,) * 3) for i, d in enumerate(degrees)], schemas.IMU_SAMPLES)

    y = health.yaw_summary(samples(range(0, 721, 30)))
    row = health.recording_kind(y).first()
    assert np.isclose(row.yaw_sweep_deg, 720) and np.isclose(row.yaw_net_deg, 720) and row.kind == "pivot"
    assert health.recording_kind(health.yaw_summary(samples([0, 1, 0]))).first().kind == "stationary" and health.recording_kind(health.yaw_summary(samples([0, 20]))).first().kind == "ambiguous"
    meta = spark.createDataFrame([("r", "stationary")], "recording_id string, kind string")
    assert health.recording_kind(y, meta).first().mismatch
    assert health.recording_kind(y, spark.createDataFrame([("r", "loop")], "recording_id string, kind string")).first().kind == "driving"


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(1)
    edges = np.array(health.histogram_edges())
    r = np.concatenate([rng.uniform(0, 1.7, 3000), edges, np.nextafter(edges, 9), np.nextafter(edges, -9)])
    got = health.range_histogram(spark.createDataFrame([("r", float(v)) for v in r], "recording_id string, r double"))
    counts, _ = np.histogram(r, edges)
    want = {round(float(a), 9): int(c) for a, c in zip(edges, counts) if c}
    assert {round(x.bin_lo, 9): x.n for x in got.collect()} == want


def test_self_hits(spark):
    rows = []
    for az in range(0, 360, 2):
        for k in range(30):
            near = 0.19 if az < 90 else 1.0 + 0.05 * k
            a = np.radians(az + 1)
            rows.append(("r", az % 4, near * np.cos(a), near * np.sin(a), near))
    ret = spark.createDataFrame([(a, b, float(c), float(d), float(e)) for a, b, c, d, e in rows], "recording_id string, ring int, x double, y double, r double")
    cells = health.self_hit_cells(ret)
    row = health.self_hit_radius(cells, health.self_hit_bands(cells)).first()
    assert np.isclose(row.outer, 0.19) and np.isclose(row.suggested_min_range, 0.24) and not row.near_wall
    sweep = health.min_range_sweep(ret).first()
    assert np.isclose(sweep.below_020cm_pct, 25) and np.isclose(sweep.nearest, 0.19)


@pytest.mark.parametrize("stretch", [1 << 15, 600])
def test_spectrum_finds_the_shake(spark, stretch):
    t = np.arange(2000) / 250
    g = 0.2 * np.sin(2 * np.pi * 20 * t)
    imu = spark.createDataFrame([("r", i, float(a), i, (0.0, 0.0, 0.0, 1.0), (float(b), 0.0, 0.0), (0.0, 0.0, float(9.8 + b))) for i, (a, b) in enumerate(zip(t, g))], schemas.IMU_SAMPLES)
    v = health.vibration(health.spectra(imu, stretch)).first()
    assert abs(v.gyro_hz - 20) < 0.6 and abs(v.gyro_amplitude - 0.2) < 0.03 and len(v.peaks) == 1 and len(v.warnings) == 1 and "constant velocity" in v.warnings[0]
    assert np.isclose(v.wobble_rad, v.gyro_amplitude / (2 * np.pi * v.gyro_hz)) and v.gyro_rms[0] > 0.1
    assert health.spectra(imu.limit(10)).count() == 0


def whole_spectrum(t, gyro, accel):
    """Frequencies, amplitudes, peaks and noise from transforms over all samples."""
    hz = 1 / np.median(np.diff(t))
    f = np.fft.rfftfreq(len(t), 1 / hz)
    win = np.hanning(len(t))
    mag = [np.abs(np.fft.rfft((x - x.mean(0)) * win[:, None], axis=0))[f > 0.5] * 2 / win.sum() for x in (gyro, accel)]
    f = f[f > 0.5]
    i, j = (int(m.sum(1).argmax()) for m in mag)
    width = health.highpass_width(hz)
    if len(t) > 2 * width:
        rest = (gyro - np.stack([np.convolve(gyro[:, c], np.ones(width) / width, "same") for c in range(3)], 1))[width:-width]
    else:
        rest = gyro - gyro.mean(0)
    return [f[i], np.linalg.norm(mag[0][i]), f[j], np.linalg.norm(mag[1][j]), *np.sqrt((rest**2).mean(0))], health.peaks_of(f, mag[0].sum(1))


@pytest.mark.parametrize("n, rate, stretch", [(2003, 250, 1 << 15), (2003, 250, 600), (2000, 250, 50), (1000, 250, 999), (150, 250, 64), (70, 1, 10)])
def test_spectrum_is_that_of_the_whole_recording(spark, n, rate, stretch):
    """Gyro and accelerometer are loudest in different places, and two tones are closer than any stretch could part."""
    rng = np.random.default_rng(n)
    t, part = np.arange(n) / rate, np.arange(n) / n
    gyro, accel = rng.normal(0.3, 0.02, (n, 3)), rng.normal(0, 0.05, (n, 3))
    gyro[:, 0] += np.where(part < 0.3, 0.5, 0.05) * np.sin(2 * np.pi * 0.08 * rate * t) + 0.2 * np.sin(2 * np.pi * (0.08 * rate + 1.4 * rate / n) * t)
    accel[:, 2] += 9.8 + np.where(part > 0.7, 2.0, 0.0) * np.sin(2 * np.pi * 0.2 * rate * t)
    rows = [("r", i, float(t[i]), i, (0.0, 0.0, 0.0, 1.0), tuple(map(float, gyro[i])), tuple(map(float, accel[i]))) for i in range(n)]
    got = health.spectra(spark.createDataFrame(rows, schemas.IMU_SAMPLES), stretch).collect()
    if rate == 1:
        assert got == []
        return
    want, peaks = whole_spectrum(t, gyro, accel)
    (s,) = got
    assert np.allclose([s.gyro_hz, s.gyro_amplitude, s.accel_hz, s.accel_amplitude, *s.gyro_rms], want)
    assert np.allclose([(p.hz, p.amplitude) for p in s.peaks], peaks)


def test_stream_health_skips_empty_scans(spark):
    p = lambda x, t: (float(x), 0.0, 0.0, 1.0, t, 3)
    scans = spark.createDataFrame([("r", 0, 1.0, 0, 2, [p(0, 0.0), p(1, 0.001)]), ("r", 1, 2.0, 1, 0, []), ("r", 2, 3.0, 2, 1, [p(1, 0.0)])], schemas.SCANS)
    imu = spark.createDataFrame([("r", i, i * 0.01, i, (0.0, 0.0, 0.0, 1.0), (0.0,) * 3, (0.0,) * 3) for i in range(5)], schemas.IMU_SAMPLES)
    h = health.stream_health(scans, imu).first()
    assert (h.packets, h.points_kept, h.points_reported, h.rings, h.time_filled) == (2, 2, 3, [3], True) and np.isclose(h.imu_hz, 100) and h.packets_per_s == 1.0


def test_history_sizes():
    assert config.history(2.0) == {"scan_maxlen": 360, "imu_maxlen": 500}
    with pytest.raises(ValueError):
        config.history(0)


def test_tuned_values_have_one_home():
    """No other module gives a tuned name a literal of its own."""
    names, bad = set(config.Config().as_dict()), []
    for path in Path(config.__file__).parent.rglob("*.py"):
        if path.name in ("config.py", "catalog.py"):
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.keyword) and node.arg in names and isinstance(node.value, ast.Constant):
                bad.append((path.name, node.arg))
            if isinstance(node, ast.FunctionDef):
                args = node.args.args[len(node.args.args) - len(node.args.defaults) :]
                bad += [(path.name, a.arg) for a, d in zip(args, node.args.defaults) if a.arg in names and isinstance(d, ast.Constant) and d.value is not None]
    assert not bad


def test_lag_does_not_depend_on_pieces(spark):
    rows = [(r, i, 10.0 + 0.1 * i + (0.7 if i % 5 == 0 else 0.0), 10.0 + 0.1 * i, float(i * i % 17)) for r in ("a", "b") for i in range(57)]
    df = spark.createDataFrame(rows, "recording_id string, frame_id long, newest_stamp double, t_end double, reg_ms double")
    for size in (3, 16, 1 << 18):
        got = {(r.recording_id, r.frame_id): r for r in trajectory.live_lag(df, 0.2, rows=size).collect()}
        assert len(got) == len(rows)
        for name, i, newest, end, _ in rows:
            r, last = got[name, i], [x[4] for x in rows if x[0] == name and i - 9 <= x[1] <= i]
            assert np.isclose(r.reg_ms_10, np.mean(last)) and r.behind == (newest - end > 0.6)
