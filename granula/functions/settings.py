"""Settings and names, worked out on the driver: parsed options, column families, labels and colours."""

from __future__ import annotations

import json
import math
import os
import re
from dataclasses import asdict, dataclass, field, fields

#: Fixed kinds of geometry; a structure has one surface at most.
SURFACES = ("mesh", "ellipsoid", "outline", "auto")
LINES = ("skeleton", "tube")
#: Columns of deep rows that readers ask for by name.
DEEP_COLUMNS = {
    "distance": ("object_id", "distance_entity", "distance_label", "distance_target", "distance_um"),
    "contact": ("object_id", "contact_entity", "contact_label_a", "contact_label_b", "contact_gap_um"),
}


def parse_names(text: str | None) -> list[str] | None:
    """A comma list of entity names; an empty text asks for none of them, a missing one for all."""
    return None if text is None else [t.strip() for t in text.split(",") if t.strip()]


def parse_voxel_size(text: str, dims: int | None = None) -> tuple[float, ...]:
    """Two or three positive lengths; with ``dims`` as many as the image has, none is filled in."""
    try:
        found = tuple(float(t) for t in text.split(","))
    except ValueError:
        raise ValueError(f"a voxel size is numbers with commas, not {text!r}") from None
    if len(found) not in (2, 3) or not all(v > 0 and math.isfinite(v) for v in found):
        raise ValueError(f"a voxel size has two or three positive numbers, not {text!r}")
    if dims is not None and len(found) != dims:
        raise ValueError(f"the image has {dims} dimensions, the voxel size {len(found)}")
    return found


def parse_geometry(items: list[str]) -> dict[str, tuple[str, ...]]:
    """NAME=KIND+KIND: the kinds of geometry of each structure; a tube needs its skeleton, so it brings it."""
    out = {}
    for item in items:
        name, eq, kinds = item.partition("=")
        found = [k.strip() for k in kinds.split("+") if k.strip()]
        unknown = [k for k in found if k not in SURFACES + LINES]
        if not eq or not name or not found or unknown:
            raise ValueError(f"geometry is NAME=KIND+KIND of {', '.join(SURFACES + LINES)}, not {item!r}")
        if sum(k in SURFACES for k in found) > 1:
            raise ValueError(f"{name} has more than one surface")
        if "tube" in found and "skeleton" not in found:
            found.append("skeleton")
        out[name] = tuple(dict.fromkeys(found))
    return out


def palette(text: str) -> dict[str, str]:
    """Colours by structure from JSON: #abc becomes #aabbcc, anything but hexadecimal is an error."""
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("a palette is an object of names and colours")
    out = {}
    for name, colour in found.items():
        m = re.fullmatch(r"#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})", str(colour))
        if not m:
            raise ValueError(f"{name}: {colour!r} is no colour")
        digits = m.group(1).lower()
        out[name] = "#" + (digits if len(digits) == 6 else "".join(c * 2 for c in digits))
    return out


def label_map(text: str) -> dict[int, str]:
    """Names by label id from JSON."""
    try:
        return {int(k): str(v) for k, v in json.loads(text).items()}
    except (ValueError, AttributeError):
        raise ValueError("a label map is an object of whole numbers and names") from None


def box_text(box: list[tuple[int, int]] | None) -> str | None:
    return None if box is None else ",".join(f"{a}:{b}" for a, b in box)


def extent_keys(dims: int) -> dict[str, str]:
    """Column names of size, total, boundary and roundness for planes and volumes."""
    if dims == 2:
        return {"size": "area_um2", "total": "total_area_um2", "boundary": "perimeter_um", "roundness": "circularity", "object": "object_area_um2"}
    return {"size": "volume_um3", "total": "total_volume_um3", "boundary": "surface_area_um2", "roundness": "sphericity", "object": "object_volume_um3"}


def extent_terms(dims: int) -> dict[str, str]:
    """The words for it."""
    return {"size": "area", "boundary": "perimeter", "roundness": "circularity", "unit": "µm²"} if dims == 2 else {"size": "volume", "boundary": "surface area", "roundness": "sphericity", "unit": "µm³"}


def choose_object_mask(entities: list[tuple[str, str]], name: str | None) -> str | None:
    """The object mask among (name, kind): never guessed; a missing one, or one of labels, is an error."""
    if name is None:
        return None
    kinds = [k for n, k in entities if n == name]
    if not kinds:
        raise ValueError(f"there is no entity {name!r}; there are {', '.join(sorted({n for n, _ in entities}))}")
    if not set(kinds) & {"mask", "auto"}:
        raise ValueError(f"{name!r} is a label volume and cannot be the object mask")
    return name


def key_by_name(entities: list[tuple[str, str]], name: str) -> tuple[str, str] | None:
    """The first (name, kind) with that name, whatever its kind."""
    return next((e for e in entities if e[0] == name), None)


def readable(columns: list[str]) -> None:
    """Raise with the reason if a table is no report."""
    missing = [c for c in ("obs_level", "row_type", "object_id") if c not in columns]
    if not columns:
        raise ValueError("the file has no columns")
    if "row_type" not in columns and "obs_level" in columns:
        raise ValueError("the report is of an older form without row types")
    if missing:
        raise ValueError(f"this is no report: it lacks {', '.join(missing)}")


def distance_columns(columns: list[str], mask: str | None = None, own: str | None = None) -> list[str]:
    """One column for each target, its mean where there is one: the object mask first, the structure itself last."""
    targets = sorted({m.group(1) for c in columns if (m := re.fullmatch(r"distance_to_(.+?)(?:_mean|_end)?_um", c))})
    order = sorted(targets, key=lambda t: (t != mask, t == own, t))
    pick = lambda t: next(c for c in (f"distance_to_{t}_mean_um", f"distance_to_{t}_um", f"distance_to_{t}_end_um") if c in columns)
    return [pick(t) for t in order]


def shape_columns(columns: list[str]) -> list[str]:
    """Metrics that are no distances; the two families share no column."""
    return [c for c in columns if re.search(r"(_um|_um2|_um3|sphericity|circularity|aspect_ratio_major_minor|branches|tortuosity|_deg)$", c) and not c.startswith("distance_to_")]


def metric_names(dims: int, targets: list[str], histograms: bool = False, skeletons: bool = False) -> list[str]:
    """Metrics that geometry can be coloured by."""
    keys = extent_keys(dims)
    wide = [f"distance_to_{t}{end}_um" for t in targets for end in ("", *(["_mean"] if histograms else []), *(["_end"] if skeletons else []))]
    lines = ["branches", "length_um", "tortuosity"] if skeletons else []
    return [keys["size"], keys["boundary"], keys["roundness"], "aspect_ratio_major_minor", *lines, *wide]


def label_of(metric: str) -> str:
    """How a metric is called: distance_to_nucleus_um is Distance to nucleus (µm)."""
    unit = ""
    for end, shown in (("_um3", " (µm³)"), ("_um2", " (µm²)"), ("_um", " (µm)"), ("_deg", " (°)")):
        if metric.endswith(end):
            metric, unit = metric[: -len(end)], shown
            break
    words = metric.replace("_", " ").strip()
    return words[:1].upper() + words[1:] + unit


def bounding_mask(entities: list[tuple[str, str]], mask: str | None) -> str | None:
    """The mask that bounds a scene: the object mask, else the only mask."""
    masks = [n for n, k in entities if k == "mask"]
    return mask if mask in masks else masks[0] if len(masks) == 1 else None


def noun_of(given: str | None, has_mask: bool) -> str:
    return given or ("object" if has_mask else "dataset")


def with_article(noun: str) -> str:
    one = noun.split("/")[0]
    return ("an " if one[:1].lower() in "aeiou" else "a ") + one


def facet_by(groups: int) -> str:
    """Panels are by group where there is more than one, else by object."""
    return "group" if groups > 1 else "object"


def facet_labels(names: list[str]) -> list[str]:
    """Names without the beginning and end that all of them share; they stay distinct and never become empty."""
    if len(set(names)) < 2:
        return list(names)
    head = len(os.path.commonprefix(names))
    rest = [n[head:] for n in names]
    tail = len(os.path.commonprefix([r[::-1] for r in rest]))
    short = [r[: len(r) - tail] for r in rest]
    return short if all(short) and len(set(short)) == len(set(names)) else list(names)


def metric_help(metric: str, exact: dict[str, str], patterns: list[tuple[str, str]] = ()) -> str | None:
    """The description of a column: by its name, by a pattern, or by the name without its row's prefix."""
    for name in (metric, *[metric[len(p) :] for p in ("instance_", "object_", "entity_") if metric.startswith(p)], *[p + metric for p in ("instance_", "object_", "entity_")]):
        if name in exact:
            return exact[name]
        for pattern, text in patterns:
            if re.fullmatch(pattern, name):
                return text
    return None


def ramp(t: float) -> str:
    """The colour at t of 0 to 1: magenta to cyan."""
    t = min(1.0, max(0.0, t))
    return f"#{round(255 * (1 - t)):02x}{round(255 * t):02x}ff"


def distinct_colour(k: int) -> str:
    """The k-th of many colours far apart: steps of the golden angle around the hues."""
    hue = (k * 137.508) % 360 / 60
    part = 1 - abs(hue % 2 - 1)
    r, g, b = [(1, part, 0), (part, 1, 0), (0, 1, part), (0, part, 1), (part, 0, 1), (1, 0, part)][int(hue)]
    return "#" + "".join(f"{round(55 + 200 * v):02x}" for v in (r, g, b))


@dataclass(frozen=True)
class MeshOptions:
    """Settings of surfaces; all of them enter the digest that decides whether a stored geometry is used again."""

    method: str = "surface_nets"
    smoothing: tuple[float, float] = (0.5, 1.5)
    decimate: float = 0.8
    max_vertices: int | None = None
    step: int = 1


@dataclass(frozen=True)
class RunConfig:
    """Settings of a run, fixed while it lasts."""

    object_mask: str | None = None
    entities: tuple[str, ...] | None = None
    voxel_size: tuple[float, ...] | None = None
    label_map: tuple[tuple[int, str], ...] = ()
    label_map_entity: str | None = None
    clip: bool = True
    auto_label_masks: bool = False
    contact_um: float = 0.5
    histograms: bool = False
    skeletons: tuple[str, ...] = ()
    max_skeleton_voxels: int = 500_000
    skeleton_prune: float = 2.0
    polarity_spread: bool = False
    exclude: tuple[str, ...] = ()
    baseline_excluded: tuple[str, ...] = ()
    geometry: tuple[tuple[str, tuple[str, ...]], ...] = ()
    groups: tuple[str, ...] = ()
    noun: str = "object"
    mesh: MeshOptions = field(default_factory=MeshOptions)

    def fingerprint(self) -> str:
        import hashlib

        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]

    @classmethod
    def of(cls, **given) -> RunConfig:
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"no such settings: {', '.join(sorted(unknown))}")
        return cls(**given)
