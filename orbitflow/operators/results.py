"""Result rows, growing result tables, flattened settings, summaries of metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitflow.config import Config
from orbitflow.operators.trajectory import cost, path_metrics, rotations

KEYS = ["recording_id"]


def run_row(poses: DataFrame, meta: DataFrame | None = None, config: Config | None = None, host: str | None = None, truth: float | None = None, **extra) -> DataFrame:
    """One row a recording: what was driven, what was set, what came out, what it cost; rounded half to even. ``extra`` columns go first."""
    c = config or Config()
    rounded = lambda col, n: F.bround(col, n)
    more = rotations(poses).groupBy(*KEYS).agg(F.avg("size").alias("_size"), F.avg("rotation_deg").alias("_rot"), F.max_by("threshold", "frame_id").alias("_thr"), (F.max("z") - F.min("z")).alias("_z"), F.sum("seconds").alias("_s"))
    m = path_metrics(poses, c.frame_duration).join(more, KEYS).join(cost(poses, c.frame_duration), KEYS)
    fields = {"kind": "string", "environment": "string", "speed_mps": "double", "truth_m": "double", "truth_method": "string"}
    if meta is not None:
        m = m.join(meta.select(*KEYS, *fields), KEYS, "left")
    else:
        m = m.withColumns({k: F.lit(None).cast(t) for k, t in fields.items()})
    used = F.lit(truth).cast("double") if truth is not None else F.col("truth_m")
    net = F.col("net_displacement")
    out = {
        "recording": F.col("recording_id"),
        **{k: F.col(k) for k in fields},
        **{f"cfg.{k}": F.lit(v) for k, v in c.as_dict().items()},
        "frames": F.col("frames"),
        "points_per_frame": rounded(F.col("_size"), 1),
        "path_length_m": rounded(F.col("path_length"), 4),
        "net_displacement_m": rounded(net, 4),
        "loop_pct_of_path": rounded(F.col("loop_pct"), 3),
        "jitter_mm": rounded(F.col("jitter_mm"), 2),
        "rotation_deg_mean": rounded(F.col("_rot"), 3),
        "threshold_final": rounded(F.col("_thr"), 4),
        "z_span_m": rounded(F.col("_z"), 4),
        "replay_host": F.lit(host).cast("string"),
        "replay_seconds": rounded(F.col("_s"), 3),
        "ms_per_frame": rounded(F.col("ms_per_frame"), 2),
        "budget_pct": rounded(F.col("budget_pct"), 1),
        "truth_used_m": used,
        "scale_error_pct": rounded(F.when(used != 0, 100 * (net - used) / used), 3),
    }
    out |= {k: F.lit(v) for k, v in extra.items()}
    return m.select(*[c.alias(k) for k, c in out.items()])


def flatten(df: DataFrame, lists_as_text: bool = True) -> DataFrame:
    """Nested structs as columns ``a.b``; lists become text."""

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out: list[Column] = []
        for f in schema.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, here)
                continue
            col = F.col(".".join(f"`{p}`" for p in here))
            if isinstance(f.dataType, T.ArrayType) and lists_as_text:
                col = F.concat(F.lit("["), F.array_join(col.cast("array<string>"), ", "), F.lit("]"))
            out.append(col.alias(".".join(here)))
        return out

    return df.select(*leaves(df.schema, ()))


def flatten_map(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Chosen keys of a map column as columns ``column.key``."""
    rest = [c for c in df.columns if c != column]
    return df.select(*[F.col(f"`{c}`") for c in rest], *[F.col(column)[n].alias(f"{column}.{n}") for n in names])


def widen(log: DataFrame | None, rows: DataFrame) -> DataFrame:
    """``log`` with ``rows`` appended: new columns go right and are null in old rows, missing ones are null in the new. All columns are text."""
    text = rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns])
    return text if log is None else log.unionByName(text, allowMissingColumns=True)


def meta_lookup(rows: DataFrame, meta: DataFrame, on: str = "recording_id") -> DataFrame:
    """Left lookup of metadata; rows without any keep nulls. Spark broadcasts ``meta`` only where its measured size allows."""
    return rows.join(meta.dropDuplicates([on]), on, "left")


def meta_summary(meta: DataFrame) -> DataFrame:
    """``meta`` with ``summary``: what is known, two blanks apart."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    truth = F.when(F.col("truth_m").isNotNull(), F.concat(F.lit("truth "), F.col("truth_m").cast("string"), F.lit(" m ("), F.coalesce("truth_method", F.lit("None")), F.lit(")"))).otherwise("NO TRUTH RECORDED")
    speed = F.concat(F.col("speed_mps").cast("string"), F.lit(" m/s"))
    return meta.withColumn("summary", F.concat_ws("  ", some("kind"), some("environment"), speed, truth))


def tags(pairs: list[str]) -> dict[str, str]:
    """KEY=VALUE arguments; anything else is refused."""
    out = {}
    for p in pairs:
        key, sep, value = p.partition("=")
        if not sep or not key:
            raise ValueError(f"not KEY=VALUE: {p!r}")
        out[key] = value
    return out
