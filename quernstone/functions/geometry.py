"""Geometry as Column expressions: coordinates, boxes, voxels, projections and axis-aligned overlaps.

Conventions: x forward, y left, z up, yaw about z; a KITTI row is (h, w, l, x, y, z, ry) with BEV plane (x, z).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def azimuth(x: Column, y: Column) -> Column:
    """Degrees from the forward axis."""
    return F.degrees(F.atan2(y, x))


def polar_to_xyz(r: Column, az: Column, el: Column) -> tuple[Column, Column, Column]:
    """Radar polar coordinates (radians, both angles negated first) to metres."""
    return r * F.cos(-el) * F.cos(-az), r * F.cos(-el) * F.sin(-az), r * F.sin(-el)


def xyz_to_polar(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Range, azimuth and elevation in radians; elevation null at the origin."""
    r = F.sqrt(x * x + y * y + z * z)
    return r, F.atan2(y, x), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(z, r))))


def quantized(v: Column, low: float, step: float, size: int) -> Column:
    """Nearest index on an axis, half to even, clipped to the axis."""
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), F.rint((v - low) / step).cast("int")))


def index_to_metre(i: Column, low: float, step: float, half: int = 0) -> Column:
    """Position of a cell index, shifted by half a cell (+1, -1) or not (0)."""
    return low + i * step + half * step / 2


def voxel_ceil(v: Column, low: float, step: float) -> Column:
    """Voxel index by rounding up, as the sparse radar voxeliser counts."""
    return F.ceil((v - low) / step).cast("int") - 1


def voxel_floor(v: Column, low: float, step: float, size: int) -> Column:
    """Voxel index by rounding down, clamped to the grid."""
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor((v - low) / step).cast("int")))


def voxel_centre(i: Column, low: float, step: float) -> Column:
    """Centre of a voxel."""
    return (i + 0.5) * step + low


def pixel_index(v: Column, low: float, step: float) -> Column:
    """Raster index by truncation towards zero."""
    return ((v - low) / step).cast("int")


def decibel(p: Column) -> Column:
    """10 log10 of a power; null for powers that are not positive."""
    return F.when(p > 0, 10 * F.log10(p))


def wrapped(angle: Column, period: float, offset: float = 0.5) -> Column:
    """An angle moved into one period: v - floor(v / p + o) * p."""
    return angle - F.floor(angle / period + offset) * period


def rotated(x: Column, y: Column, yaw: Column) -> tuple[Column, Column]:
    """A point turned about the vertical axis."""
    return x * F.cos(yaw) - y * F.sin(yaw), x * F.sin(yaw) + y * F.cos(yaw)


def box_corners(x: Column, y: Column, z: Column, length: Column, width: Column, height: Column, yaw: Column) -> Column:
    """The eight corners of a yawed box as an array of (k, x, y, z); bit 0 of k: back, bit 1: right, bit 2: bottom."""
    out = []
    for k in range(8):
        sx, sy, sz = ((1, -1)[k >> b & 1] for b in range(3))
        dx, dy = rotated(sx * length / 2, sy * width / 2, yaw)
        out.append(F.struct(F.lit(k).alias("k"), (x + dx).alias("x"), (y + dy).alias("y"), (z + sz * height / 2).alias("z")))
    return F.array(*out)


def bev_corners(x: Column, y: Column, length: Column, width: Column, yaw: Column) -> Column:
    """The four corners of a yawed rectangle as an array of (x, y)."""
    out = []
    for sx, sy in ((1, 1), (1, -1), (-1, -1), (-1, 1)):
        dx, dy = rotated(sx * length / 2, sy * width / 2, yaw)
        out.append(F.struct((x + dx).alias("x"), (y + dy).alias("y")))
    return F.array(*out)


def in_box(px: Column, py: Column, pz: Column, x: Column, y: Column, z: Column, length: Column, width: Column, height: Column, yaw: Column) -> Column:
    """Whether a point lies in a yawed box, faces included."""
    u, v = rotated(px - x, py - y, -yaw)
    return (F.abs(u) <= length / 2) & (F.abs(v) <= width / 2) & (F.abs(pz - z) <= height / 2)


def projected(px: Column, py: Column, pz: Column, matrix: list[list[float]]) -> tuple[Column, Column, Column]:
    """Pixel column, row and depth through a 3x4 matrix; pixels null where the depth is not positive."""
    u, v, d = (m[0] * px + m[1] * py + m[2] * pz + m[3] for m in matrix)
    return F.when(d > 0, u / d), F.when(d > 0, v / d), d


def overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Length of the common part of two intervals."""
    return F.greatest(F.least(hi1, hi2) - F.greatest(lo1, lo2), F.lit(0.0))


def iou(common: Column, one: Column, two: Column) -> Column:
    """Intersection over union of two sizes; null where both are empty."""
    return F.try_divide(common, one + two - common)


def residual_encoded(g: dict[str, Column], a: dict[str, Column]) -> list[Column]:
    """Residuals of a box against an anchor (x, y, z, l, w, h, r): centres by the anchor's diagonal, sizes by log."""
    diagonal = F.sqrt(a["l"] * a["l"] + a["w"] * a["w"])
    return [(g["x"] - a["x"]) / diagonal, (g["y"] - a["y"]) / diagonal, (g["z"] - a["z"]) / a["h"],
            F.log(g["l"] / a["l"]), F.log(g["w"] / a["w"]), F.log(g["h"] / a["h"]), g["r"] - a["r"]]


def residual_decoded(t: dict[str, Column], a: dict[str, Column]) -> list[Column]:
    """The box that :func:`residual_encoded` came from."""
    diagonal = F.sqrt(a["l"] * a["l"] + a["w"] * a["w"])
    return [t["x"] * diagonal + a["x"], t["y"] * diagonal + a["y"], t["z"] * a["h"] + a["z"],
            F.exp(t["l"]) * a["l"], F.exp(t["w"]) * a["w"], F.exp(t["h"]) * a["h"], t["r"] + a["r"]]


def extrinsic(yaw: float, pitch: float, roll: float, x: float, y: float, z: float) -> list[list[float]]:
    """3x4 matrix of rotations about the fixed axes z, y, x (degrees, in that order) and a translation."""
    (cz, sz), (cy, sy), (cx, sx) = ((math.cos(math.radians(a)), math.sin(math.radians(a))) for a in (yaw, pitch, roll))
    return [
        [cy * cz, -cy * sz, sy, x],
        [cx * sz + sx * sy * cz, cx * cz - sx * sy * sz, -sx * cy, y],
        [sx * sz - cx * sy * cz, sx * cz + cx * sy * sz, cx * cy, z],
    ]


def angles_of(m: list[list[float]]) -> tuple[float, float, float]:
    """Yaw, pitch and roll in degrees of an :func:`extrinsic` matrix."""
    return tuple(math.degrees(a) for a in (math.atan2(-m[0][1], m[0][0]), math.asin(max(-1.0, min(1.0, m[0][2]))), math.atan2(-m[1][2], m[2][2])))


def camera_matrix(fx: float, fy: float, px: float, py: float, ext: list[list[float]]) -> list[list[float]]:
    """Intrinsics times an extrinsic matrix, for :func:`projected`."""
    return [[fx * a + px * c for a, c in zip(ext[0], ext[2])], [fy * b + py * c for b, c in zip(ext[1], ext[2])], list(ext[2])]


def image_transformed(u: Column, v: Column, scale: float, crop: tuple[float, float], width: float, flip: bool, degrees: float, centre: tuple[float, float]) -> tuple[Column, Column]:
    """A pixel after resize, crop, optional mirror and rotation about a centre."""
    u, v = u * scale - crop[0], v * scale - crop[1]
    u = width - u if flip else u
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    du, dv = u - centre[0], v - centre[1]
    return c * du + s * dv + centre[0], c * dv - s * du + centre[1]


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon: an odd number of edges crosses the ray to the right."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1]):
        if y1 != y2:
            spans = (y > min(y1, y2)) & (y <= max(y1, y2))
            crossings = crossings + (spans & (x <= (y - y1) * (x2 - x1) / (y2 - y1) + x1)).cast("int")
    return crossings % 2 == 1


def in_convex(x: Column, y: Column, hull: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a convex hull given counter-clockwise, border included: on the left of every side."""
    inside = F.lit(True)
    for (x1, y1), (x2, y2) in zip(hull, hull[1:] + hull[:1]):
        inside = inside & ((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) >= 0)
    return inside


def point_encoded(x: Column, y: Column, z: Column, length: Column, width: Column, height: Column, yaw: Column, px: Column, py: Column, pz: Column, mean: tuple[float, float, float]) -> list[Column]:
    """Residuals of a box against a point and the mean size of its class; the heading as cosine and sine."""
    diagonal = math.hypot(mean[0], mean[1])
    return [(x - px) / diagonal, (y - py) / diagonal, (z - pz) / mean[2], F.log(length / mean[0]), F.log(width / mean[1]), F.log(height / mean[2]), F.cos(yaw), F.sin(yaw)]


def point_decoded(code: list[Column], px: Column, py: Column, pz: Column, mean: tuple[float, float, float]) -> list[Column]:
    """The box (x, y, z, l, w, h, yaw) that :func:`point_encoded` came from."""
    diagonal = math.hypot(mean[0], mean[1])
    x, y, z, length, width, height, c, s = code
    return [x * diagonal + px, y * diagonal + py, z * mean[2] + pz, F.exp(length) * mean[0], F.exp(width) * mean[1], F.exp(height) * mean[2], F.atan2(s, c)]


def bottom_of(z: Column, height: Column) -> Column:
    """Height of a box's bottom from that of its middle, as older decoders give it."""
    return z - height / 2


#: Channel means and deviations of the public image statistics; fixed values.
IMAGE_MEAN, IMAGE_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def _of_channel(values: tuple[float, ...], channel: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (channel + 1).cast("int"))


def pixel_normal(value: Column, channel: Column) -> Column:
    """A pixel of 0 to 255 less the channel's mean, over its deviation."""
    return (value / 255.0 - _of_channel(IMAGE_MEAN, channel)) / _of_channel(IMAGE_STD, channel)


def pixel_value(normal: Column, channel: Column) -> Column:
    """The pixel of a normalised value, rounded half to even and clipped to 0 to 255."""
    v = normal * _of_channel(IMAGE_STD, channel) * 255 + _of_channel(IMAGE_MEAN, channel) * 255
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(v))).cast("int")


def back_projected(u: Column, v: Column, depth: Column, fx: float, fy: float, px: float, py: float) -> tuple[Column, Column, Column]:
    """The point (x forward, y left, z up) that a pixel shows at a depth."""
    return depth, -(u - px) * depth / fx, -(v - py) * depth / fy
