"""Poses, cameras and rotations as column expressions.

A pose is a row-major 4x4 camera-to-world ``array<double>`` of 16; cameras
look down -Z with +Y up. Functions take the pose column and return columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from stereoloom.functions.numeric import bind, clamp, col, is_finite

Vector = tuple[Column, Column, Column]


def element(pose: Column | str, row: int, column: int) -> Column:
    return col(pose)[4 * row + column]


def matrix(values: list[Column | float]) -> Column:
    return F.array(*[F.lit(float(v)) if not isinstance(v, Column) else v for v in values])


def position(pose: Column | str) -> Vector:
    """P10: the translation."""
    return tuple(element(pose, r, 3) for r in range(3))


def forward(pose: Column | str) -> Vector:
    """P10: unit viewing direction, minus the third axis."""
    axis = [-element(pose, r, 2) for r in range(3)]
    norm = F.sqrt(sum((a * a for a in axis[1:]), axis[0] * axis[0]))
    return tuple(F.try_divide(a, norm) for a in axis)


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def distance(a, b) -> Column:
    d = [x - y for x, y in zip(a, b, strict=True)]
    return F.sqrt(dot(d, d))


def rigid_inverse(pose: Column | str) -> Column:
    """P5: transpose of the rotation, and minus it times the translation."""
    r = [[element(pose, j, i) for j in range(3)] for i in range(3)]
    t = position(pose)
    rows = [[*r[i], -dot(r[i], t)] for i in range(3)]
    return matrix([*rows[0], *rows[1], *rows[2], 0, 0, 0, 1])


def flip_camera(pose: Column | str) -> Column:
    """Between the GL and CV camera axes: columns 1 and 2 change sign."""
    return matrix([element(pose, r, c) * (-1 if c in (1, 2) and r < 3 else 1) for r in range(4) for c in range(4)])


def flip_world(pose: Column | str) -> Column:
    """World turned by 180 degrees about X: rows 1 and 2 change sign."""
    return matrix([element(pose, r, c) * (-1 if r in (1, 2) else 1) for r in range(4) for c in range(4)])


def y_up_to_z_up(pose: Column | str) -> Column:
    """(x, y, z) becomes (x, -z, y)."""
    e = lambda r, c: element(pose, r, c)
    return matrix([*(e(0, c) for c in range(4)), *(-e(2, c) for c in range(4)), *(e(1, c) for c in range(4)), *(e(3, c) for c in range(4))])


def multiply(a: Column | str, b: Column | str) -> Column:
    """Product of two poses."""
    cells = []
    for r in range(4):
        for c in range(4):
            cells.append(sum((element(a, r, k) * element(b, k, c) for k in range(1, 4)), element(a, r, 0) * element(b, 0, c)))
    return matrix(cells)


def quaternion(pose: Column | str) -> Column:
    """struct<w,x,y,z> of the rotation, by the largest of four candidates, w not negative."""
    m = [[element(pose, r, c) for c in range(3)] for r in range(3)]
    trace = m[0][0] + m[1][1] + m[2][2]
    by_w = F.sqrt(F.greatest(trace + 1.0, F.lit(0.0))) * 2
    by_x = F.sqrt(F.greatest(1.0 + m[0][0] - m[1][1] - m[2][2], F.lit(0.0))) * 2
    by_y = F.sqrt(F.greatest(1.0 + m[1][1] - m[0][0] - m[2][2], F.lit(0.0))) * 2
    by_z = F.sqrt(F.greatest(1.0 + m[2][2] - m[0][0] - m[1][1], F.lit(0.0))) * 2

    def pack(w, x, y, z):
        sign = F.when(w < 0, -1.0).otherwise(1.0)
        return F.struct((w * sign).alias("w"), (x * sign).alias("x"), (y * sign).alias("y"), (z * sign).alias("z"))

    return (
        F.when(trace > 0, pack(by_w / 4, (m[2][1] - m[1][2]) / by_w, (m[0][2] - m[2][0]) / by_w, (m[1][0] - m[0][1]) / by_w))
        .when((m[0][0] > m[1][1]) & (m[0][0] > m[2][2]), pack((m[2][1] - m[1][2]) / by_x, by_x / 4, (m[0][1] + m[1][0]) / by_x, (m[0][2] + m[2][0]) / by_x))
        .when(m[1][1] > m[2][2], pack((m[0][2] - m[2][0]) / by_y, (m[0][1] + m[1][0]) / by_y, by_y / 4, (m[1][2] + m[2][1]) / by_y))
        .otherwise(pack((m[1][0] - m[0][1]) / by_z, (m[0][2] + m[2][0]) / by_z, (m[1][2] + m[2][1]) / by_z, by_z / 4))
    )


def rotation_of(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    """Rotation matrix of a unit quaternion."""
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def colmap_pose(pose: Column | str) -> Column:
    """struct<qw,qx,qy,qz,tx,ty,tz>, world to camera in the CV convention."""
    return bind(rigid_inverse(flip_camera(pose)), lambda inverse: bind(quaternion(inverse), lambda q: _colmap(inverse, q)))


def _colmap(inverse: Column, q: Column) -> Column:
    return F.struct(q["w"].alias("qw"), q["x"].alias("qx"), q["y"].alias("qy"), q["z"].alias("qz"), element(inverse, 0, 3).alias("tx"), element(inverse, 1, 3).alias("ty"), element(inverse, 2, 3).alias("tz"))


def rotation_angle(a: Column | str, b: Column | str) -> Column:
    """Angle in radians between two poses' rotations, by the trace of a-transpose times b."""
    trace = None
    for r in range(3):
        for c in range(3):
            term = element(a, r, c) * element(b, r, c)
            trace = term if trace is None else trace + term
    return F.acos(clamp((trace - 1) / 2, -1.0, 1.0))


def is_rigid(pose: Column | str, tolerance: float = 0.01) -> Column:
    """16 finite values, orthonormal rotation of determinant near 1, last row 0 0 0 1."""
    pose = col(pose)
    rows = [[element(pose, r, c) for c in range(3)] for r in range(3)]
    ok = (F.size(pose) == 16) & F.forall(pose, is_finite)
    for i in range(3):
        for j in range(i, 3):
            ok = ok & (F.abs(dot(rows[i], rows[j]) - (1.0 if i == j else 0.0)) <= tolerance)
    (a, b, c), (d, e, f), (g, h, k) = rows
    det = a * (e * k - f * h) - b * (d * k - f * g) + c * (d * h - e * g)
    ok = ok & (F.abs(det - 1) <= tolerance)
    for i, v in enumerate((0.0, 0.0, 0.0, 1.0)):
        ok = ok & (F.abs(element(pose, 3, i) - v) <= tolerance)
    return F.coalesce(ok, F.lit(False))


@dataclass
class Camera:
    """Intrinsics as columns."""

    fx: Column
    fy: Column
    cx: Column
    cy: Column
    width: Column
    height: Column

    @classmethod
    def of(cls, intrinsics: Column | str) -> Camera:
        i = col(intrinsics)
        return cls(*[i[k] for k in ("fx", "fy", "cx", "cy", "width", "height")])

    def struct(self) -> Column:
        return F.struct(*[getattr(self, k).alias(k) for k in ("fx", "fy", "cx", "cy", "width", "height")])

    def rescaled(self, width: Column, height: Column) -> Camera:
        """Each axis scales with its size."""
        sx, sy = width / self.width, height / self.height
        return Camera(self.fx * sx, self.fy * sy, self.cx * sx, self.cy * sy, width, height)

    def portrait(self) -> Camera:
        """A quarter turn; the axes change places."""
        return Camera(self.fy, self.fx, self.height - self.cy, self.cx, self.height, self.width)


def transform_point(pose: Column | str, p) -> Vector:
    return tuple(dot([element(pose, r, c) for c in range(3)], p) + element(pose, r, 3) for r in range(3))


def to_camera(pose: Column | str, p) -> Vector:
    """World point in the camera's axes, by the transposed rotation."""
    d = [x - t for x, t in zip(p, position(pose), strict=True)]
    return tuple(dot([element(pose, r, c) for r in range(3)], d) for c in range(3))


def unproject(camera: Camera, pose: Column | str, u: Column, v: Column, z: Column) -> Vector:
    """Pixel and depth to the world point."""
    return transform_point(pose, ((u - camera.cx) / camera.fx * z, -(v - camera.cy) / camera.fy * z, -z))


def project(camera: Camera, pose: Column | str, p) -> Column:
    """struct<u,v,z> of a world point in the GL convention; null behind the camera or outside the image."""
    x, y, back = to_camera(pose, p)
    z = -back
    u, v = F.try_divide(camera.fx * x, z) + camera.cx, camera.cy - F.try_divide(camera.fy * y, z)
    inside = (z > 0) & (u >= 0) & (v >= 0) & (u < camera.width) & (v < camera.height)
    return F.when(inside, F.struct(u.alias("u"), v.alias("v"), z.alias("z")))


def project_cv(camera: Camera, p) -> Column:
    """struct<u,v,z> of a point in camera axes with +Z forward; null behind the camera."""
    x, y, z = p
    return F.when(z > 0, F.struct((F.try_divide(camera.fx * x, z) + camera.cx).alias("u"), (F.try_divide(camera.fy * y, z) + camera.cy).alias("v"), z.alias("z")))
