"""Pinhole camera as Column expressions. Viewpoint columns: x, y, z, yaw, pitch_deg, vfov_deg, aspect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def camera(prefix: str = "") -> dict[str, Column | tuple]:
    c = lambda name: F.col(prefix + name)
    yaw, tilt = F.radians(c("yaw")), F.radians(90.0 + c("pitch_deg"))
    cy, sy, ct, st = F.cos(yaw), F.sin(yaw), F.cos(tilt), F.sin(tilt)
    fov = F.greatest(F.lit(5.0), F.least(F.lit(150.0), F.coalesce(F.nullif(c("vfov_deg"), F.lit(0.0)), F.lit(55.0))))
    tan_v = F.tan(F.radians(fov) / 2)
    aspect = F.when(c("aspect") > 0, c("aspect")).otherwise(16 / 9)
    return {"position": (c("x"), c("y"), c("z")), "right": (cy, sy, F.lit(0.0)), "up": (-sy * ct, cy * ct, st), "forward": (-sy * st, cy * st, -ct), "tan_v": tan_v, "tan_h": tan_v * aspect}


def with_camera(df: DataFrame, prefix: str = "") -> tuple[DataFrame, dict]:
    """Camera axes as columns of ``df``: every later formula reuses them instead of repeating the trigonometry."""
    cam = camera(prefix)
    flat = {f"_cam_{k}{i}": c for k in ("right", "up", "forward") for i, c in enumerate(cam[k])}
    flat.update({"_cam_v": cam["tan_v"], "_cam_h": cam["tan_h"]})
    axes = {k: tuple(F.col(f"_cam_{k}{i}") for i in range(3)) for k in ("right", "up", "forward")}
    return df.withColumns(flat), {"position": cam["position"], **axes, "tan_v": F.col("_cam_v"), "tan_h": F.col("_cam_h")}


def _dot(a: tuple, b: tuple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def project(cam: dict, point: tuple) -> tuple[Column, Column, Column]:
    """Image u, v (0..1, v down) and depth of a world point; null behind the camera."""
    offset = tuple(p - o for p, o in zip(point, cam["position"]))
    depth = _dot(offset, cam["forward"])
    seen = depth > 1e-6
    u = (_dot(offset, cam["right"]) / (depth * cam["tan_h"]) + 1) / 2
    v = (1 - _dot(offset, cam["up"]) / (depth * cam["tan_v"])) / 2
    return F.when(seen, u), F.when(seen, v), F.when(seen, depth)


def in_frame(cam: dict, point: tuple, margin: float = 0.0) -> Column:
    u, v, _ = project(cam, point)
    return F.coalesce(u.between(-margin, 1 + margin) & v.between(-margin, 1 + margin), F.lit(False))


def ray(cam: dict, u: Column, v: Column) -> tuple[Column, Column, Column]:
    x, y = (u * 2 - 1) * cam["tan_h"], (1 - v * 2) * cam["tan_v"]
    d = [f + r * x + p * y for f, r, p in zip(cam["forward"], cam["right"], cam["up"])]
    length = F.sqrt(_dot(d, d))
    return tuple(c / length for c in d)


def on_plane(cam: dict, u: Column, v: Column, height: float = 0.0, direction: tuple | None = None) -> tuple[Column, Column]:
    """Where the image ray meets a horizontal plane; null when it never does. ``direction``: the ray, where already a column."""
    d = direction or ray(cam, u, v)
    distance = (F.lit(height) - cam["position"][2]) / F.when(F.abs(d[2]) >= 1e-6, d[2])
    hit = distance > 0
    return F.when(hit, cam["position"][0] + d[0] * distance), F.when(hit, cam["position"][1] + d[1] * distance)


def ground_positions(df: DataFrame, cam: dict, x0: str = "bx0", x1: str = "bx1", y1: str = "by1") -> DataFrame:
    """Adds implied_x, implied_y and range_m: the floor point under a detection box.

    The ray through the lower edge is left unnormalised: its component along the viewing direction
    is then 1, so the distance factor is the depth itself. It comes out of an explode, so that filters on it
    stay behind it and do not repeat the formula in the join before.
    """
    px = ((F.col(x0) + F.col(x1)) - 1) * cam["tan_h"]
    py = (1 - F.col(y1) * 2) * cam["tan_v"]
    rays = df.withColumns({"_px": px, "_py": py})
    rays = rays.withColumns({f"_ray{i}": cam["forward"][i] + cam["right"][i] * F.col("_px") + cam["up"][i] * F.col("_py") for i in range(3)})
    level = F.abs("_ray2") < 1e-6 * F.sqrt(F.col("_ray0") ** 2 + F.col("_ray1") ** 2 + F.col("_ray2") ** 2)
    rays = rays.withColumn("range_m", F.explode(F.array(-cam["position"][2] / F.when(~level, F.col("_ray2")))))
    ahead = F.col("range_m") > 0
    return rays.withColumns({"implied_x": F.when(ahead, cam["position"][0] + F.col("_ray0") * F.col("range_m")),
                             "implied_y": F.when(ahead, cam["position"][1] + F.col("_ray1") * F.col("range_m"))}).drop("_px", "_py", "_ray0", "_ray1", "_ray2")


def metres_per_pixel(cam: dict, depth: Column, height_px: int) -> Column:
    return F.when(depth > 0, 2.0 * depth * cam["tan_v"] / height_px).otherwise(0.0)
