"""Integer grids: packed voxel keys, shards, normals, Morton codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stereoloom.functions.numeric import clamp, col, divide_float32, is_finite

HALF = 1 << 20
MASK = (1 << 21) - 1


def cell_index(x: Column | str, size: float | Column) -> Column:
    """Index of the cell that holds x; null if x is not finite or the index leaves 21 signed bits."""
    q = F.floor(divide_float32(x, size))
    return F.when(is_finite(x) & (q >= -HALF) & (q < HALF), q.cast("long"))


def pack3(ix: Column, iy: Column, iz: Column) -> Column:
    """21 bits an axis in one long; null if any index is null."""
    a, b, c = ((i + HALF).cast("long") for i in (ix, iy, iz))
    return F.shiftleft(a, 42).bitwiseOR(F.shiftleft(b, 21)).bitwiseOR(c)


def unpack3(key: Column | str) -> tuple[Column, Column, Column]:
    key = col(key)
    return tuple(F.shiftright(key, s).bitwiseAND(F.lit(MASK).cast("long")) - HALF for s in (42, 21, 0))


def voxel_key(x, y, z, size: float | Column) -> Column:
    """Packed key of the voxel around a point, null outside the grid."""
    return pack3(cell_index(x, size), cell_index(y, size), cell_index(z, size))


def voxel_centre(key: Column | str, size: float) -> tuple[Column, Column, Column]:
    """Centre of a packed voxel."""
    return tuple((i + 0.5) * F.lit(size) for i in unpack3(key))


def shift_key(key: Column | str, dx, dy, dz) -> Column:
    """Key of a neighbour; null beyond the grid."""
    moved = []
    for i, d in zip(unpack3(key), (dx, dy, dz), strict=True):
        j = i + d
        moved.append(F.when((j >= -HALF) & (j < HALF), j))
    return pack3(*moved)


def neighbour_keys(key: Column | str, reach: int = 1, centre: bool = True) -> Column:
    """Array of the keys of the (2 * reach + 1)**3 cells around one, without those beyond the grid.

    Away from the grid's rim a neighbour is one addition on the packed key.
    """
    key = col(key)
    span = range(-reach, reach + 1)
    offsets = [(a, b, c) for a in span for b in span for c in span if centre or a or b or c]
    inside = None
    for i in unpack3(key):
        ok = (i >= reach - HALF) & (i < HALF - reach)
        inside = ok if inside is None else inside & ok
    steps = F.array(*[F.lit((a << 42) + (b << 21) + c).cast("long") for a, b, c in offsets])
    moves = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("abc", o, strict=True)]) for o in offsets])
    at_rim = F.filter(F.transform(moves, lambda o: shift_key(key, o["a"], o["b"], o["c"])), lambda k: k.isNotNull())
    return F.when(inside, F.transform(steps, lambda s: key + s)).when(key.isNotNull(), at_rim)


def shard_of(key: Column | str, shards: int = 16) -> Column:
    """The xor of a key's axes modulo a power of two."""
    key = col(key)
    return key.bitwiseXOR(F.shiftright(key, 21)).bitwiseXOR(F.shiftright(key, 42)).bitwiseAND(F.lit(shards - 1).cast("long")).cast("int")


def pack2(i: Column, j: Column) -> Column:
    """Two signed 21-bit indices in one long."""
    return F.shiftleft((i + HALF).cast("long"), 21).bitwiseOR((j + HALF).cast("long"))


def oct_encode(nx, ny, nz) -> Column:
    """Unit normal as two 8-bit octahedral coordinates, at least 1; 0 for no normal."""
    nx, ny, nz = col(nx), col(ny), col(nz)
    norm = F.abs(nx) + F.abs(ny) + F.abs(nz)
    px, py = F.try_divide(nx, norm), F.try_divide(ny, norm)
    side = lambda v: F.when(v >= 0, 1.0).otherwise(-1.0)
    u = F.when(nz >= 0, px).otherwise((1 - F.abs(py)) * side(px))
    v = F.when(nz >= 0, py).otherwise((1 - F.abs(px)) * side(py))
    byte = lambda c: F.floor((clamp(c, -1.0, 1.0) * 0.5 + 0.5) * 255 + 0.5).cast("int")
    code = F.greatest(byte(u) * 256 + byte(v), F.lit(1))
    return F.when(is_finite(norm) & (norm > 0), code).otherwise(F.lit(0))


def oct_decode(code: Column | str) -> Column:
    """struct<x,y,z> of an octahedral code; null for 0."""
    code = col(code)
    u, v = F.floor(code / 256) / 255 * 2 - 1, (code % 256) / F.lit(255.0) * 2 - 1
    z = 1 - F.abs(u) - F.abs(v)
    side = lambda c: F.when(c >= 0, 1.0).otherwise(-1.0)
    x = F.when(z < 0, (1 - F.abs(v)) * side(u)).otherwise(u)
    y = F.when(z < 0, (1 - F.abs(u)) * side(v)).otherwise(v)
    n = F.sqrt(x * x + y * y + z * z)
    return F.when(code > 0, F.struct((x / n).alias("x"), (y / n).alias("y"), (z / n).alias("z")))


def _spread(v: Column) -> Column:
    """Ten bits with two zero bits between each."""
    for shift, mask in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def morton30(x: Column, y: Column, z: Column, low: tuple, high: tuple) -> Column:
    """Ten bits an axis within a box, interleaved (x highest)."""
    out = None
    for p, a, b, shift in zip((x, y, z), low, high, (2, 1, 0), strict=True):
        cell = F.least(F.floor(F.when(b > a, (p - a) / (b - a)).otherwise(F.lit(0.0)) * 1024), F.lit(1023)).cast("long")
        part = F.shiftleft(_spread(cell), shift)
        out = part if out is None else out.bitwiseOR(part)
    return out
