import random

import numpy as np
import pytest
from conftest import ramp, rows_of
from pyspark.sql import functions as F

from orbitflow import schemas
from orbitflow.config import Config
from orbitflow.functions.codec import pack_imu_bytes, pack_scan_bytes, unpack
from orbitflow.operators import batches, align, fold, framing, odometry, rolling

IDENTITY = (0.0, 0.0, 0.0, 1.0)


def plain_nearest(scans, imu, tol):
    """(scan seq, imu seq) by looking at all pairs."""
    out = []
    for r, seq, s in scans:
        best = None
        own = [(q, t) for ri, q, t in imu if ri == r]
        left = max(((t, q) for q, t in own if t < s), default=None)
        right = min(((t, q) for q, t in own if t >= s), default=None)
        for cand in (left, right):
            if cand and (best is None or abs(cand[0] - s) < abs(best[0] - s)):
                best = cand
        out.append((r, seq, best[1] if best and abs(best[0] - s) <= tol else None))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_nearest_asof_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    step = rng.choice([0.001, 0.004, 0.05])
    stamp = lambda: 100 + rng.randrange(400) * step
    scans = [(rng.choice("ab"), i, stamp()) for i in range(150)]
    imu = [(rng.choice("ab"), i, stamp()) for i in range(80)]
    left, right = spark.createDataFrame(scans, "recording_id string, seq long, stamp double"), spark.createDataFrame(imu, "recording_id string, seq long, stamp double")
    got = align.nearest_asof(left, right, 0.01).select("recording_id", "seq", "match.seq")
    assert sorted(map(tuple, got.collect())) == sorted(plain_nearest(scans, imu, 0.01))


def test_ties_take_the_earlier_and_nulls_match_nothing(spark):
    left = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("a", 2, float("nan")), ("b", 3, 1.0)], "recording_id string, seq long, stamp double")
    right = spark.createDataFrame([("a", 10, 0.75), ("a", 11, 1.25), ("a", 12, None)], "recording_id string, seq long, stamp double")
    assert rows_of(align.nearest_asof(left, right, 0.25).select("seq", "match.seq")) == [(0, 10), (1, None), (2, None), (3, None)]
    with pytest.raises(ValueError):
        align.nearest_asof(left, right, 0)


def plain_frames(stamps, d):
    out, t0 = [], None
    for t in sorted(stamps):
        if t0 is None or t - t0 >= d:
            t0 = t
        out.append((t, t0))
    return sorted(set(out))


@pytest.mark.parametrize("slice_", [1, 2, 7, 4096])
def test_greedy_frames_do_not_depend_on_slices(spark, slice_):
    rng = random.Random(slice_)
    rows = [(r, i, round(rng.uniform(-20, 60) if rng.random() < 0.9 else rng.uniform(200, 210), 2)) for r in "abc" for i in range(300)]
    df = spark.createDataFrame(rows, "recording_id string, seq long, stamp double")
    got = framing.greedy_frames(df, 0.7, slice_)
    for r in "abc":
        mine = got.where(F.col("recording_id") == r)
        assert sorted({(x.stamp, x.frame_t0) for x in mine.collect()}) == plain_frames([s for q, _, s in rows if q == r], 0.7)
        ids = sorted({(x.frame_t0, x.frame_id) for x in mine.collect()})
        assert [i for _, i in ids] == list(range(len(ids)))
    starts = {x.recording_id: x.starts for x in framing.starts_native(df, 0.7).collect()}
    assert all(starts[r] == sorted({t for _, t in plain_frames([s for q, _, s in rows if q == r], 0.7)}) for r in "abc")


def test_frames_from_scans(spark):
    """Zero returns go with their times, times are scaled to the frame, one instant gives ones."""
    pts = lambda *p: [(float(x), 0.0, 0.0, 1.0, t, 0) for x, t in p]
    rows = [("a", 0, 5.0, 0, 5, pts((1, 0.0), (2, 0.001), (0, 0.002), (4, 0.003), (5, 0.004))), ("a", 1, 9.0, 1, 2, pts((1, 0.0), (2, 0.0))), ("a", 2, 20.0, 2, 1, pts((0, 0.0)))]
    scans = spark.createDataFrame(rows, schemas.SCANS)
    aligned = align.align(scans, None, rotate_with_imu=False)
    got = framing.assemble(aligned, 1.0, 3, rotate=False).orderBy("frame_id").collect()
    assert len(got) == 2 and got[0].n_points == 4 and np.allclose([p.t_norm for p in got[0].points], [0, 0.25, 0.75, 1], atol=1e-6)
    assert [p.t_norm for p in got[1].points] == [1.0, 1.0] and got[1].sparse and not got[0].sparse
    assert np.isclose(got[0].t_end, 5.004)


def scan(stamp, i=0, n=4, start=1):
    return unpack(pack_scan_bytes(stamp, i, ramp(n, start)))


def imu(stamp, q=IDENTITY, i=0):
    return unpack(pack_imu_bytes(stamp, i, q))


def drive(n=200, dt=0.005, t0=1.0, frame=0.2, **kw):
    a = fold.Assembler(frame, min_points=1, **kw)
    frames, window = [], []
    for i in range(n):
        window = [*window, imu(t0 + i * dt)][-500:]
        frames += a.take([scan(t0 + i * dt, i, 4, i + 1)], window)
    return a, frames


def test_frames_are_disjoint_and_nothing_is_lost():
    a, frames = drive()
    assert len(frames) >= 4 and all(x.t_end <= y.t_start for x, y in zip(frames, frames[1:])) and all(0.19 <= f.span <= 0.206 for f in frames)
    assert sum(f.n_scans for f in frames + a.close()) == a.counts["scans_ingested"] == 200
    assert a.close() == []


def test_rotation_takes_the_nearest_sample_whatever_the_order():
    s = np.sqrt(0.5)
    window = [imu(2.008), imu(1.996), imu(2.001, (0, 0, s, s))]
    a = fold.Assembler(0.2, min_points=1)
    a.take([scan(2.0, 0, 1, 1)], window)
    assert np.allclose(a.close()[0].points, [[0, 1, 0]], atol=1e-6)


def test_pending_unmatched_overflow_and_late_scans():
    a = fold.Assembler(0.2, min_points=1)
    assert a.take([scan(2.0)], [imu(1.9)]) == [] and len(a.waiting) == 1
    a.take([], [imu(1.9), imu(2.001)])
    assert a.counts["scans_ingested"] == 1 and not a.waiting
    a.take([scan(1.0)], [imu(2.0), imu(2.005)])
    assert a.counts["scans_unmatched"] == 1
    b = fold.Assembler(0.2, pending=5)
    for i in range(8):
        b.take([scan(1.0 + i)], [])
    assert len(b.waiting) == 5 and b.counts["scans_unmatched"] == 3
    c, times = fold.Assembler(0.05, min_points=1), [1 + 0.01 * i for i in range(20)]
    frames = c.take([scan(t, 0, 1, 1 + k) for k, t in reversed(list(enumerate(times)))], [imu(t) for t in times])
    assert all(np.all(np.diff(f.points[:, 0]) > 0) for f in frames) and frames


def test_without_rotation_no_samples_are_needed():
    for window in ([], [imu(999.0)]):
        a = fold.Assembler(0.05, min_points=1, rotate=False)
        frames = [f for i in range(60) for f in a.take([scan(1 + 0.005 * i)], window)]
        assert frames and a.counts["scans_unmatched"] == 0


def test_sparse_frames_are_counted():
    a = fold.Assembler(0.05, min_points=10_000, rotate=False)
    assert not [f for i in range(60) for f in a.take([scan(1 + 0.005 * i)], [])] and a.counts["frames_too_sparse"] > 0
    with pytest.raises(ValueError):
        fold.Assembler(0)


def recording(n=400, dt=0.005):
    out = []
    for i in range(n):
        out += [("r", 2 * i, i * dt, pack_imu_bytes(100 + i * dt, i, IDENTITY)), ("r", 2 * i + 1, i * dt, pack_scan_bytes(100 + i * dt, i, ramp(5, 1)))]
    return out


def test_batches_and_replay_end_to_end(spark):
    df = spark.createDataFrame(recording(), schemas.DATAGRAMS).repartition(3)
    b = batches.micro_batches(df, 0.1).orderBy("batch_id").collect()
    assert len(b) >= 5 and sum(x.n_scans for x in b) == 400 and b[-1].imu_window == 400 and [x.batch_id for x in b] == list(range(len(b)))
    f = fold.replay_frames(df, Config(frame_duration=0.2), 0.05, min_points=1).orderBy("frame_id").collect()
    assert len(f) >= 8 and all(abs(x.span - 0.2) <= 0.011 for x in f[:-1]) and all(p.t_norm <= 1 for p in f[0].points)
    c = fold.replay_counts(df, Config(), 0.05, min_points=1).first()
    assert c.scans_ingested == 400 and c.frames_emitted == len(f) and c.scans_pending == 0


def test_both_modes_agree_on_orderly_data(spark):
    from orbitflow.functions import codec

    df = spark.createDataFrame(recording(), schemas.DATAGRAMS)
    m = codec.decode(df)
    native = framing.assemble(align.align(codec.scans(m), codec.imu_samples(m)), 0.2, 1).select("frame_id", "n_scans", "n_points", F.round("t_start", 9), F.round("t_end", 9))
    folded = fold.replay_frames(df, Config(frame_duration=0.2), min_points=1).select("frame_id", F.col("n_scans").cast("int"), "n_points", F.round("t_start", 9), F.round("t_end", 9))
    assert rows_of(native) == rows_of(folded)


def test_rolling_window_keeps_the_newest_by_stamp(spark):
    rows = [("a", 0, 1.010), ("a", 1, 1.020), ("a", 2, 1.000)]
    df = spark.createDataFrame(rows, "recording_id string, seq long, stamp double")
    assert [r.seq for r in rolling.window_scans(df, 2).orderBy("stamp").collect()] == [0, 1]
    with pytest.raises(ValueError):
        rolling.window_scans(df, 0)


def test_cylinder_turns_into_a_circle(spark):
    """A point 2 m ahead of a turning sensor stays at radius 2 after rotation."""
    scans = [("c", i, 1 + i / 1000, i, 3, [(2.0, 0.0, float(z), 1.0, 0.0, 0) for z in range(3)]) for i in range(360)]
    samples = [("c", i, 1 + i / 1000, i, (0.0, 0.0, float(np.sin(np.radians(i) / 2)), float(np.cos(np.radians(i) / 2))), (0.0,) * 3, (0.0,) * 3) for i in range(360)]
    a = align.align(spark.createDataFrame(scans, schemas.SCANS), spark.createDataFrame(samples, schemas.IMU_SAMPLES))
    row = rolling.centroid_and_nearest(rolling.points(rolling.window_scans(framing.ingest(a), 360))).first()
    assert row.n_points == 1080 and abs(row.radius_mean - 2) < 1e-9 and row.radius_std < 1e-9 and abs(row.mean_x) < 1e-9


def test_accumulator_evicts_by_stamp_and_counts():
    a = rolling.Accumulator(2)
    near = [imu(t) for t in (1.0, 1.01, 1.02)]
    assert a.take([scan(1.010, 0, 1, 1), scan(1.020, 1, 1, 2)], near) == 2
    assert a.take([scan(1.000, 2, 1, 3)], near) == 1
    assert a.points()[:, 0].tolist() == [1, 2] and a.counts["scans_accumulated"] == 3
    a.take([scan(2.0)], near)
    assert len(a.waiting) == 1 and a.take([], [*near, imu(2.001)]) == 1
    a.take([scan(0.5)], near)
    assert a.counts["scans_unmatched"] == 1
    b = rolling.Accumulator(5)
    for i in range(8):
        b.take([scan(1.0 + i)], [])
    assert len(b.waiting) == 5 and b.counts["scans_unmatched"] == 3
    b.reset()
    assert len(b.points()) == 0 and b.counts["scans_unmatched"] == 3
    with pytest.raises(ValueError):
        rolling.Accumulator(0)
    # Just past the newest sample but within the tolerance: matched at once.
    assert rolling.Accumulator().take([scan(1.025)], near) == 1


def test_window_of_a_replay(spark):
    df = spark.createDataFrame(recording(150), schemas.DATAGRAMS)
    got = rolling.replay_window(df, 10)
    assert got.select("stamp").distinct().count() == 10 and got.agg(F.max("stamp")).first()[0] == 100 + 149 * 0.005


def test_micro_batches_equal_a_fold_in_order(spark):
    """Clocks that step back, equal times, broken datagrams, slices that cut anywhere, and a recording without inertial samples."""
    rng = random.Random(4)
    rows, want = [], []
    for name, n, kinds in (("a", 400, "is-"), ("b", 60, "s"), ("c", 1, "i"), ("d", 30, "is")):
        at, state, held = 50.0, fold.Batcher(1.0, 20), [None, None]
        for i in range(n):
            at += rng.choice([0.0, 0.1, 0.4, -0.3, 1.5])
            kind = rng.choice(kinds)
            data = {"i": pack_imu_bytes(at, i, (0, 0, 0, 1)), "s": pack_scan_bytes(at, i, ramp(3, 1)), "-": b"\x65\0\0\0"}[kind]
            rows.append((name, i, at, data))
            if kind == "-":
                continue
            held = [i if held[0] is None else held[0], i]
            if (b := state.take(at, ("imu" if kind == "i" else "scan", at, i, None))) is not None:
                want.append((name, b[0], len(b[1]), len(b[2]), *held))
                held[0] = None
        if (b := state.close()) is not None:
            want.append((name, b[0], len(b[1]), len(b[2]), *held))
    df = spark.createDataFrame(rows, schemas.DATAGRAMS).repartition(3)
    assert rows_of(batches.micro_batches(df, 1.0, 20)) == sorted(want, key=repr)
    assert batches.micro_batches(df.limit(0)).count() == 0


def dense(n: int = 3000, per_second: int = 100):
    """Datagrams far denser than the queues: two inertial samples for three scans, in order."""
    rows = []
    for i in range(n):
        t = i / per_second
        rows.append(("r", i, t, pack_imu_bytes(t, i, (0.0, 0.0, 0.0, 1.0)) if i % 5 in (1, 3) else pack_scan_bytes(t, i, ramp(1 + i % 4, 1))))
    return rows


def test_batches_in_parts_lose_nothing_to_queues(spark):
    df, scans = spark.createDataFrame(dense(), schemas.DATAGRAMS), [i for i in range(3000) if i % 5 not in (1, 3)]
    # A batch of 10 s holds 600 scans and 400 samples; the queues hold 400 and 100 scans, the window 500 and 100 samples.
    lost = fold.replay_counts(df, Config(frame_duration=1.0), 10.0, 100, tolerance=0.05, min_points=1).first()
    got = fold.replay_counts(df, Config(frame_duration=1.0), 10.0, 100, in_parts=True, tolerance=0.05, min_points=1).first()
    assert lost.scans_unmatched > 0 and got.scans_ingested == len(scans) and got.scans_unmatched == got.scans_pending == 0
    frames = fold.replay_frames(df, Config(frame_duration=1.0), 10.0, 100, in_parts=True, tolerance=0.05, min_points=1).collect()
    assert sum(f.n_scans for f in frames) == len(scans) and {f.n_scans for f in frames} == {60}
    still = Config(frame_duration=1.0, rotate_with_imu=False, voxel_size=5.0, max_range=300.0)
    poses = odometry.replay(df, still, 10.0, assembling={"min_points": 1}, in_parts=True)
    assert poses.agg(F.sum("size")).first()[0] == sum(1 + i % 4 for i in scans)
    both = odometry.sweep(df, {"a": still, "b": still}, 10.0, {"min_points": 1}, in_parts=True).groupBy("config").count()
    assert sorted(map(tuple, both.collect())) == [("a", 30), ("b", 30)]
    window = rolling.replay_window(df, 100, 0.05, 10.0, 100, in_parts=True).select("stamp").distinct()
    assert sorted(r[0] for r in window.collect()) == [i / 100 for i in scans[-100:]]


def test_batches_in_parts_hold_no_more_than_the_queue():
    b, most = fold.Batcher(1e9, 50, 40), 0
    for i in range(1000):
        b.take(0.0, ("imu" if i % 7 == 0 else "scan", float(i), i, None))
        most = max(most, len(b.scans))
    assert most < 20
