"""Parameters of the pipeline, in one place; everything else takes its defaults from here."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

# They decide results.
NOMINAL_SCAN_HZ, NOMINAL_IMU_HZ = 180, 250
MAX_POINTS = 120
MAX_TIME_GAP = 0.01
MIN_POINTS = 300
ASSEMBLER_PENDING = 400
IMU_WINDOW = 500
PERIOD = 0.05
MAP_VOXEL = 0.03


@dataclass(frozen=True)
class Config:
    """Tuned values; ``frame_duration`` in seconds, lengths in metres."""

    frame_duration: float = 0.2
    rotate_with_imu: bool = True
    voxel_size: float = 0.15
    max_range: float = 25.0
    min_range: float = 0.25
    deskew: bool = True
    initial_threshold: float = 0.4

    def __post_init__(self):
        if self.frame_duration <= 0:
            raise ValueError("frame_duration must be > 0")
        if not self.voxel_size or self.voxel_size <= 0:
            raise ValueError("voxel_size must be > 0")
        if self.min_range >= self.max_range:
            raise ValueError("min_range must be below max_range")

    def with_(self, **changes) -> Config:
        """A changed copy; an unknown name is a TypeError before anything is read."""
        known = {f.name for f in fields(self)}
        if unknown := sorted(set(changes) - known):
            raise TypeError(f"unknown config: {', '.join(unknown)}")
        return replace(self, **changes)

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class Registration:
    """Values of the registration that were never tuned."""

    min_motion_th: float = 0.02
    max_points_per_voxel: int = 20
    max_num_iterations: int = 500
    convergence_criterion: float = 1e-4


def history(seconds: float = 2.0) -> dict[str, int]:
    """How many scans and inertial samples a history of so many seconds holds."""
    if seconds <= 0:
        raise ValueError("seconds must be > 0")
    return {"scan_maxlen": max(1, int(NOMINAL_SCAN_HZ * seconds)), "imu_maxlen": max(1, int(NOMINAL_IMU_HZ * seconds))}
