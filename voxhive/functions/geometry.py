"""Frame changes, quaternions and pose interpolation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def zup_to_yup(x, y, z) -> tuple[Column, Column, Column]:
    """Robot frame (z up) to world frame (y up)."""
    return -_c(y), _c(z), -_c(x)


def yup_to_zup(x, y, z) -> tuple[Column, Column, Column]:
    """World frame (y up) to robot frame (z up)."""
    return -_c(z), -_c(x), _c(y)


def unproject(u, v, depth, fx: float, fy: float, cx: float, cy: float):
    """Pinhole camera: pixel and depth to camera coordinates."""
    d = _c(depth)
    return (_c(u) - F.lit(cx)) * d / F.lit(fx), (_c(v) - F.lit(cy)) * d / F.lit(fy), d


def depth_valid(depth, z_min: float = 0.1, z_max: float = 20.0) -> Column:
    d = _c(depth)
    return (d > F.lit(z_min)) & (d < F.lit(z_max)) & ~F.isnan(d)


def quat_normalised(qx, qy, qz, qw) -> tuple[Column, Column, Column, Column]:
    parts = [_c(q) for q in (qx, qy, qz, qw)]
    norm = F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    norm = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    return tuple(p / norm for p in parts)


def quat_matrix(qx, qy, qz, qw) -> list[list[Column]]:
    """Rotation matrix of a unit quaternion (x, y, z, w order)."""
    x, y, z, w = (_c(q) for q in (qx, qy, qz, qw))
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def rotate(matrix: list[list[Column]], x, y, z) -> tuple[Column, Column, Column]:
    point = (_c(x), _c(y), _c(z))
    return tuple(row[0] * point[0] + row[1] * point[1] + row[2] * point[2] for row in matrix)


def rigid_transform(pose: dict[str, Column], x, y, z) -> tuple[Column, Column, Column]:
    """Apply a pose given as columns px, py, pz, qx, qy, qz, qw."""
    rotated = rotate(quat_matrix(pose["qx"], pose["qy"], pose["qz"], pose["qw"]), x, y, z)
    return tuple(r + _c(pose[p]) for r, p in zip(rotated, ("px", "py", "pz")))


def lerp(a, b, u) -> Column:
    return (1 - _c(u)) * _c(a) + _c(u) * _c(b)


def slerp(q0: list[Column], q1: list[Column], u: Column) -> list[Column]:
    """Spherical interpolation; straight blend when the angle is tiny."""
    raw = sum((a * b for a, b in zip(q0[1:], q1[1:])), q0[0] * q1[0])
    flip = F.when(raw < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    dot = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), raw * flip))
    blend = [a + u * (flip * b - a) for a, b in zip(q0, q1)]
    norm = F.sqrt(sum((c * c for c in blend[1:]), blend[0] * blend[0]))
    angle = F.acos(dot)
    w0 = F.sin((1 - u) * angle) / F.sin(angle)
    w1 = F.sin(u * angle) / F.sin(angle)
    near = dot > 0.9995
    return [
        F.when(near, c / norm).otherwise(w0 * a + w1 * flip * b)
        for a, b, c in zip(q0, q1, blend)
    ]


def squared_distance(ax, ay, az, bx, by, bz) -> Column:
    dx, dy, dz = _c(ax) - _c(bx), _c(ay) - _c(by), _c(az) - _c(bz)
    return dx * dx + dy * dy + dz * dz


def point_in_obb(px, py, pz, centre, half, quat) -> Column:
    """Membership in an oriented box; ``quat`` is given in (x, y, z, w) order."""
    m = quat_matrix(*quat)
    rel = [_c(p) - _c(c) for p, c in zip((px, py, pz), centre)]
    inside = F.lit(True)
    for axis in range(3):
        local = rel[0] * m[0][axis] + rel[1] * m[1][axis] + rel[2] * m[2][axis]
        inside = inside & (F.abs(local) <= _c(half[axis]))
    return inside
