"""Shapes of road damage as columns over points: the height they add and where they leave their label.

Each function gives (height change, labelled?) for columns x and y; the parameters are numbers or
columns, so that one plan shapes many scenes from a table of parameters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import clip, col, norm
from .prepare import point_segment, rounded_rectangle, smoothstep

Shape = tuple[Column, Column]


def _radius(x, y, cx, cy) -> Column:
    return norm(col(x) - cx, col(y) - cy)


def pothole(x, y, cx, cy, radius, depth, beta=2.0) -> Shape:
    """A bowl: depth (1 - (r / R)**beta)**(1 / beta) within the radius."""
    t = _radius(x, y, cx, cy) / F.lit(radius)
    inside = t <= 1
    return F.when(inside, -F.lit(depth) * F.pow(F.greatest(1.0 - F.pow(t, F.lit(beta)), F.lit(0.0)), F.lit(1.0 / beta))).otherwise(0.0), inside


def depression(x, y, cx, cy, radius, depth) -> Shape:
    """A Gaussian hollow over all points; labelled where it is deeper than a hundredth."""
    s = F.lit(radius) / 3.0
    r = _radius(x, y, cx, cy)
    d = F.lit(depth) * F.exp(-r * r / (2.0 * s * s))
    return -d, d > 0.01 * F.lit(depth)


def rutting(x, y, centre, separation, width, depth, length) -> Shape:
    """Two Gaussian wheel tracks along y whose depth varies with y."""
    s = F.lit(width) / 3.0
    tracks = sum((F.exp(-((col(x) - (F.lit(centre) + side * F.lit(separation) / 2.0)) ** 2) / (2.0 * s * s)) for side in (-1.0, 1.0)), F.lit(0.0))
    d = F.lit(depth) * tracks * (1.0 + 0.2 * F.sin(2.0 * math.pi * col(y) / (0.5 * F.lit(length))))
    return -d, F.abs(d) > 0.05 * F.lit(depth)


def corrugation(x, y, wavelength, amplitude, angle=0.0) -> Shape:
    """Waves across a direction."""
    u = col(x) * F.cos(F.lit(angle)) + col(y) * F.sin(F.lit(angle))
    d = F.lit(amplitude) * F.cos(2.0 * math.pi * u / F.lit(wavelength))
    return d, F.abs(d) > 0.1 * F.lit(amplitude)


def crack_profile(distance, width, depth, least_width=0.0) -> Shape:
    """A groove: depth exp(-(d / (hw / 2))**2) within half the width hw of its line."""
    hw = F.lit(width) / 2.0
    d = col(distance)
    groove = F.when(d <= hw, -F.lit(depth) * F.exp(-F.pow(d / (hw / 2.0), F.lit(2.0)))).otherwise(0.0)
    return groove, d <= F.greatest(hw, F.lit(least_width) / 2.0)


def slab_crack(x, y, cx, cy, angle, depth, joint) -> Shape:
    """A line through a slab's centre that falls off exponentially."""
    d = F.abs(-(col(x) - cx) * F.sin(F.lit(angle)) + (col(y) - cy) * F.cos(F.lit(angle)))
    return -F.lit(depth) * F.exp(-d / (2.0 * F.lit(joint))), d <= 2.0 * F.lit(joint)


def faulting(x, joint_at, offset, joint) -> Shape:
    """A step at a joint: half the offset up on one side and down on the other."""
    d = col(x) - F.lit(joint_at)
    near = F.abs(d) <= 5.0 * F.lit(joint)
    return F.when(near, F.signum(d) * F.lit(offset) / 2.0).otherwise(0.0), near


def pitting(x, y, cx, cy, radius, depth) -> Shape:
    """A half ellipsoid."""
    t = _radius(x, y, cx, cy) / F.lit(radius)
    return F.when(t <= 1, -F.lit(depth) * F.sqrt(F.greatest(1.0 - t * t, F.lit(0.0)))).otherwise(0.0), t <= 1


def blow_up(x, y, cx, cy, reach, height) -> Shape:
    """A bulge height cos(pi r / 2)**2, r in units of the reach and clipped at 1.5."""
    r = clip(_radius(x, y, cx, cy) / F.lit(reach), 0, 1.5)
    c = F.cos(math.pi * r / 2.0)
    d = F.lit(height) * c * c
    return d, d > 0.1 * F.lit(height)


def corner_break(x, y, cx, cy, reach, depth, joint) -> Shape:
    """A corner of a slab sinks beyond its diagonal, with a groove on the diagonal."""
    d = (F.abs(col(x) - cx) + F.abs(col(y) - cy) - F.lit(reach)) / math.sqrt(2.0)
    inside = d <= 0
    return F.when(inside, -0.5 * F.lit(depth)).otherwise(0.0) - F.lit(depth) * F.exp(-F.abs(d) / (2.0 * F.lit(joint))), inside | (F.abs(d) <= 2.0 * F.lit(joint))


def bleeding(x, low, high) -> Shape:
    """A band along y; only the label changes."""
    return F.lit(0.0), col(x).between(low, high)


def patch(x, y, z, cx, cy, half_w, half_l, radius, angle, plane, elevation, edge) -> Shape:
    """Height change that blends a rounded rectangle into the plane (a, b, c) raised by elevation."""
    d = rounded_rectangle(x, y, cx, cy, half_w, half_l, radius, angle)
    a, b, c = plane
    goal = a * col(x) + b * col(y) + c + F.lit(elevation)
    return smoothstep(-d / F.lit(edge)) * (goal - col(z)), d <= 0


def joint_distance(x, y, slab_w, slab_l) -> Column:
    """Distance to the nearest joint of a regular slab grid; by arithmetic, without a join."""
    off = lambda v, s: F.abs(v - F.floor(v / s + 0.5) * s)
    return F.least(off(col(x), F.lit(slab_w)), off(col(y), F.lit(slab_l)))


def slab_index(x, y, slab_w, slab_l) -> tuple[Column, Column]:
    return F.floor(col(x) / F.lit(slab_w)).cast("long"), F.floor(col(y) / F.lit(slab_l)).cast("long")


def pumping(distance, joint) -> Shape:
    return F.lit(0.0), col(distance) <= 8.0 * F.lit(joint)


def joint_damage(distance, depth, joint) -> Shape:
    """A groove in the joint, depth exp(-(d / (joint / 2))**2)."""
    d = col(distance)
    return F.when(d <= F.lit(joint), -F.lit(depth) * F.exp(-F.pow(d / (0.5 * F.lit(joint)), F.lit(2.0)))).otherwise(0.0), d <= F.lit(joint)


def scan_line_keep(y, distance, spacing, r_share, decay=0.3, incidence=None, drop=0.05) -> Column:
    """Probability that a scanner's line sees a point: Gaussian about the line, less with range and slant."""
    d = col(distance) / (0.8 * F.lit(spacing))
    keep = F.exp(-0.5 * d * d) * (1.0 - decay * col(r_share))
    return keep * (1.0 - drop * col(incidence)) if incidence is not None else keep


def dropout(r_share, rate=0.03) -> Column:
    """Probability that a return is lost, growing with the share of the longest range."""
    return F.least(rate + (1.0 - rate) * col(r_share) * 0.2, F.lit(0.99))


# How labels change the reflectance of a surface.
REFLECTANCE = {19: 0.20, 11: -0.10, 12: -0.10, 36: -0.08, 20: 0.15, 37: 0.15, 29: 0.12, 34: -0.05, **{k: -0.05 for k in range(1, 9)}, 9: -0.08, 10: -0.08}


def reflectance(base, label) -> Column:
    shift = F.lit(0.0)
    for k, by in sorted(REFLECTANCE.items()):
        shift = F.when(col(label) == k, by).otherwise(shift)
    return clip(col(base) + shift, 0, 1)


def polyline_groove(x, y, ax, ay, bx, by, width, depth) -> Shape:
    return crack_profile(point_segment(x, y, ax, ay, bx, by)[0], width, depth)
