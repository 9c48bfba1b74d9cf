"""A planned scene of a tile's size as NumPy arrays: the formulas of synthesis, shapes and scenes over all of its points at once.

Columns over points are interpreted point by point, and most of their time goes into draws; here a task takes the scenes of its rows
one by one.  Plans, dealing and everything that looks at several scenes stay with Spark, as do scenes that are larger than a tile.
"""

from __future__ import annotations

import math

import numpy as np

from ..functions.draws import of_scene, point_digits, uniforms
from ..labels import PRIORITY
from . import synthesis, tiles
from .shapes import REFLECTANCE

RANK = np.array(PRIORITY)
SHIFT = np.zeros(len(PRIORITY))
SHIFT[list(REFLECTANCE)] = list(REFLECTANCE.values())
#: The draws of each point that every scene needs; the one without a name is the sample's.
NEEDED = ["", "mixed", "lost", *(f"{n}{k}" for n in "vw" for k in range(4)), *(f"{n}{k}" for n in ("shade", "range", "azimuth", "elevation") for k in "ab")]


def normal(u: dict[str, np.ndarray], name: str) -> np.ndarray:
    return np.sqrt(-2.0 * np.log(u[name + "a"])) * np.cos(2.0 * math.pi * u[name + "b"])


def joint_distance(x, y, slab_w, slab_l):
    off = lambda v, s: np.abs(v - np.floor(v / s + 0.5) * s)
    return np.minimum(off(x, slab_w), off(y, slab_l))


def groove(d, width, depth, least=0.0):
    half = width / 2.0
    return np.where(d <= half, -depth * np.exp(-((d / (half / 2.0)) ** 2)), 0.0), d <= max(half, least / 2.0)


def patch(x, y, z, cx, cy, angle):
    """synthesis' patch: 1 by 1.2 m with round corners, 15 mm up, blended over 8 cm."""
    x, y = x - cx, y - cy
    u, v = x * math.cos(angle) + y * math.sin(angle), -x * math.sin(angle) + y * math.cos(angle)
    qx, qy = np.abs(u) - 0.5 + 0.1, np.abs(v) - 0.6 + 0.1
    d = np.sqrt(np.maximum(qx, 0.0) ** 2 + np.maximum(qy, 0.0) ** 2) + np.minimum(np.maximum(qx, qy), 0.0) - 0.1
    t = np.clip(-d / 0.08, 0, 1)
    return t * t * (3.0 - 2.0 * t) * (0.015 - z), d <= 0


def shape(d: dict, x, y, z, inner, width: float, length: float, step: float, hits) -> tuple[np.ndarray, np.ndarray]:
    """Height change and place of the label of a damage: synthesis.shapes_of and chosen; hits(names) draws for the points."""
    severe, cx, cy, angle = d["severity"] == "severe", d["cx"], d["cy"], d["angle"]
    pick = lambda light, heavy: heavy if severe else light
    kind = d["disease"] if d["variant"] is None else f"{d['disease']}/{d['variant']}"
    slab_w, slab_l, joint = width / 2, length / 2, max(0.008, step)
    none, nowhere = np.zeros(len(x)), np.zeros(len(x), bool)
    line = lambda distance: groove(distance, pick(0.004, 0.012), pick(0.015, 0.04), 2.0 * step)
    radius = lambda: np.sqrt((x - cx) ** 2 + (y - cy) ** 2)
    near = lambda: joint_distance(x, y, slab_w, slab_l)
    if kind in ("crack/alligator", "crack/block"):
        block = pick(0.5, 0.2)
        return line(joint_distance(x + np.sin(y * 3) * 0.05, y + np.sin(x * 3) * 0.05, block, block))
    if kind == "crack/longitudinal":
        return line(np.abs(x - cx - 0.05 * np.sin(y * 2)))
    if kind == "crack/transverse":
        return line(np.abs(y - cy - 0.05 * np.sin(x * 2)))
    if kind == "pothole":
        t = radius() / pick(0.15, 0.30)
        return np.where(t <= 1, -pick(0.025, 0.10) * np.sqrt(np.maximum(1.0 - t * t, 0.0)), 0.0), t <= 1
    if kind == "raveling":
        u = hits(["deep", "gone"])
        where = inner & (u["gone"] < pick(0.15, 0.30))
        return np.where(where, -0.3 * pick(0.002, 0.005) * (1 + u["deep"]), 0.0), where
    if kind == "depression":
        s, r, depth = 0.35 * width / 3.0, radius(), pick(0.02, 0.06)
        deep = depth * np.exp(-r * r / (2.0 * s * s))
        return -deep, deep > 0.01 * depth
    if kind == "rutting":
        s, depth = 0.3 / 3.0, pick(0.015, 0.04)
        tracks = sum(np.exp(-((x - (width / 2 + side * (0.5 * width) / 2.0)) ** 2) / (2.0 * s * s)) for side in (-1.0, 1.0))
        deep = depth * tracks * (1.0 + 0.2 * np.sin(2.0 * math.pi * y / (0.5 * length)))
        return -deep, np.abs(deep) > 0.05 * depth
    if kind == "corrugation":
        high = pick(0.015, 0.035)
        up = high * np.cos(2.0 * math.pi * x / 0.6)
        return up, np.abs(up) > 0.1 * high
    if kind == "bleeding":
        return none, (x >= cx - 0.2) & (x <= cx + 0.2)
    if kind in ("patching", "concrete_damage/patching"):
        return patch(x, y, z, cx, cy, angle)
    if kind == "concrete_damage/slab_shatter":
        where = (np.floor(x / slab_w) == 0) & (np.floor(y / slab_l) == 0)
        return np.where(where, pick(0.01, 0.03) * (np.floor((x + y) / 0.4) % 3 - 1), 0.0), where
    if kind == "concrete_damage/slab_crack":
        off = np.abs(-(x - cx) * math.sin(angle) + (y - cy) * math.cos(angle))
        return -pick(0.015, 0.04) * np.exp(-off / (2.0 * joint)), off <= 2.0 * joint
    if kind == "concrete_damage/corner_break":
        off, depth = (np.abs(x) + np.abs(y) - 0.6) / math.sqrt(2.0), pick(0.015, 0.03)
        return np.where(off <= 0, -0.5 * depth, 0.0) - depth * np.exp(-np.abs(off) / (2.0 * joint)), (off <= 0) | (np.abs(off) <= 2.0 * joint)
    if kind == "concrete_damage/faulting":
        off = x - slab_w
        where = np.abs(off) <= 5.0 * joint
        return np.where(where, np.sign(off) * pick(0.008, 0.02) / 2.0, 0.0), where
    if kind == "concrete_damage/pumping":
        return none, near() <= 8.0 * joint
    if kind == "concrete_damage/edge_spall":
        off = near()
        where = (off <= 10 * joint) & (hits(["spall"])["spall"] < pick(0.3, 0.6))
        return np.where(where, -0.02 * np.exp(-off / joint), 0.0), where
    if kind == "concrete_damage/joint_damage":
        off, filled = near(), hits(["fill"])["fill"] < pick(0.4, 0.8)
        where = off <= joint
        return np.where(filled & where, -0.01 * np.exp(-((off / (0.5 * joint)) ** 2)), 0.0), where & filled
    if kind == "concrete_damage/pitting":
        t = radius() / 0.15
        return np.where(t <= 1, -0.05 * np.sqrt(np.maximum(1.0 - t * t, 0.0)), 0.0), t <= 1
    if kind == "concrete_damage/blowup":
        c = np.cos(math.pi * np.clip(np.sqrt((x - slab_w) ** 2 + (y - slab_l) ** 2) / 0.8, 0, 1.5) / 2.0)
        up = 0.06 * c * c
        return up, up > 0.1 * 0.06
    if kind == "concrete_damage/exposed_aggregate":
        u = hits(["bare", "graina", "grainb"])
        where = inner & (u["bare"] < 0.3)
        return np.where(where, 0.003 * normal(u, "grain"), 0.0), where
    return none, nowhere


class Scenes:
    """Makes scenes of one size, each from its row of the plan."""

    def __init__(self, width, length, step, points, sigma, jitter, rate, mixing, roughness, seed, curved, ravelled, cracks):
        self.width, self.length, self.step, self.points, self.sigma, self.jitter, self.rate, self.mixing, self.seed = width, length, step, points, sigma, jitter, rate, mixing, seed
        self.curved, self.ravelled, self.cracks = curved, ravelled, cracks
        cols, rows = int(width / step), int(length / step)
        self.ids = np.arange(cols * rows)
        self.x, self.y, self.digits = (self.ids % cols) * step, (self.ids // cols) * step, point_digits(self.ids)
        self.inner = (self.x >= 0.1 * width) & (self.x <= 0.9 * width) & (self.y >= 0.1 * length) & (self.y <= 0.9 * length)
        self.waves = synthesis.wave_sizes(width, length, step, roughness)

    def heights(self, scene, u) -> np.ndarray:
        """synthesis.surface and micro_texture."""
        z = np.zeros(len(self.ids))
        for k, (n, amplitude) in enumerate(self.waves):
            angle = of_scene(f"angle{k}", 0, math.pi, self.seed, scene)
            z += amplitude * np.cos(2 * math.pi * n * math.cos(angle) * self.x + 2 * math.pi * n * math.sin(angle) * self.y + of_scene(f"phase{k}", 0, 2 * math.pi, self.seed, scene))
        hurst, total = 0.7, np.zeros(len(z))
        alpha = min(max(2 * hurst, 0.1), 1.9)
        for k in range(4):
            v, w = -math.pi / 2 + math.pi * u[f"v{k}"], -np.log(u[f"w{k}"])
            total += 2.0 ** (-k * hurst) * np.clip(np.sin(alpha * v) / np.cos(v) ** (1 / alpha) * (np.cos((1 - alpha) * v) / w) ** ((1 - alpha) / alpha), -5.0, 5.0)
        return z + 0.001 * total

    def make(self, scene, target: int | None, pavement: str, damages: list[dict] | None) -> dict[str, np.ndarray]:
        """The points that stay, with place before and after the noise, label and intensity carried over."""
        hits = lambda names: uniforms(self.seed, names, scene, self.digits)
        u = hits(NEEDED)
        x, y, z = self.x, self.y, self.heights(scene, u)
        label, gone = np.zeros(len(x), np.int32), np.zeros(len(x), bool)
        for d in damages or ():
            dz, where = shape(d, x, y, z, self.inner, self.width, self.length, self.step, hits)
            z, there = z + dz, where & ~gone
            label[there & (RANK[label] <= RANK[d["label"]])] = d["label"]
            if d["disease"] == "raveling":
                gone = gone | (self.inner & (hits(["out"])["out"] < (0.3 if d["severity"] == "severe" else 0.15)))
        left = np.flatnonzero(~gone)
        before, label = np.stack([x[left], y[left], z[left]], axis=1), label[left]
        tiles.spread(before, label, self.ravelled, 3 * self.step)
        mixed = tiles.mixed(before, np.flatnonzero(u["mixed"][left] < self.mixing), self.curved)
        u = {name: own[left] for name, own in u.items()}
        base = of_scene("base", *((0.30, 0.50) if pavement == "concrete" else (0.10, 0.25)), self.seed, scene)
        intensity = np.clip(base + 0.02 * normal(u, "shade") + SHIFT[label], 0, 1)
        r = np.sqrt((mixed**2).sum(axis=1)) + 1e-12
        a, e = np.arctan2(mixed[:, 1], mixed[:, 0]), np.arcsin(np.clip(mixed[:, 2] / r, -1, 1))
        turn = math.radians(self.jitter)
        far = r.max() if len(r) else 0.0
        stays = np.flatnonzero(u["lost"] > np.minimum(self.rate + (1.0 - self.rate) * (r / far) * 0.2, 0.99)) if len(r) else left
        r, a, e = np.maximum(r + self.sigma * normal(u, "range"), 0.0), a + turn * normal(u, "azimuth"), e + turn * normal(u, "elevation")
        after = np.stack([r * np.cos(e) * np.cos(a), r * np.cos(e) * np.sin(a), r * np.sin(e)], axis=1)[stays]
        # points stand a step apart before the noise, so one that is moved by less than half of it is still the nearest to its place
        source, distance = stays.copy(), np.sqrt(((after - before[stays]) ** 2).sum(axis=1))
        asked = np.flatnonzero(~(distance < 0.49 * self.step))
        if len(asked):
            source[asked], distance[asked] = tiles.nearest_places(after[asked], before)
        found = label[source]
        if self.sigma > 0:
            found = np.where((distance > 3 * self.sigma) & np.isin(found, self.cracks), 0, found).astype(label.dtype)
        made = {"point_id": self.ids[left][stays], **{c: after[:, i] for i, c in enumerate("xyz")}, "label": found, "intensity": intensity[source]}
        return made if self.points is None else self.sampled(target, made, u[""][stays])

    def sampled(self, target: int | None, made: dict[str, np.ndarray], drawn: np.ndarray) -> dict[str, np.ndarray]:
        """sampling.protected and prepare.unit_ball."""
        n, ids = self.points, made["point_id"]
        own = made["label"] == target if target is not None else np.zeros(len(ids), bool)
        order = np.lexsort((ids, drawn))
        place = np.empty(len(ids), np.int64)
        place[order] = np.where(own[order], np.cumsum(own[order]), 0)
        quota, mine = max(1, math.ceil(0.1 * n)), int(own.sum())
        enough = len(ids) - mine >= n - min(mine, quota)
        late = np.where(own & (place <= quota), 0, np.where(own & enough, 2, 1))
        first = np.sort(np.lexsort((ids, drawn, late))[:n])
        made = {c: v[first] for c, v in made.items()}
        if len(first):
            xyz = np.stack([made[c] for c in "xyz"], axis=1)
            centre = xyz.mean(axis=0)
            scale = np.sqrt(((xyz - centre) ** 2).sum(axis=1)).max()
            scale = 1.0 if scale <= 1e-12 else scale
            made |= {c: (xyz[:, i] - centre[i]) / scale for i, c in enumerate("xyz")} | {f"c{c}": np.full(len(first), centre[i]) for i, c in enumerate("xyz")} | {"scale": np.full(len(first), scale)}
        else:
            made |= {c: np.zeros(0) for c in ("cx", "cy", "cz", "scale")}
        return made
