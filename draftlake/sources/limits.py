"""Limits of reading, in three sets: a caller picks one by name and may change single values."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

MIB = 1 << 20


@dataclass(frozen=True)
class Limits:
    """What a reader accepts; more is an error that names the limit, never cut short in silence."""

    # The usual set.
    max_file_bytes: int = 1024 * MIB
    max_section_bytes: int = 256 * MIB
    max_handles: int = 1_000_000
    max_scan_bytes: int = 512 * MIB
    max_block_nesting: int = 128
    max_retained_errors: int = 1_000
    max_xdata: int = 256
    max_classes: int = 4_096
    max_polyline: int = 1_000_000
    max_clip_vertices: int = 100_000
    max_leader_points: int = 100_000
    max_spline_points: int = 100_000


# The narrow and the wide set.
SAFE = Limits()
PARANOID = Limits(100 * MIB, 16 * MIB, 100_000, 64 * MIB, 32, 100, 64, 512, 100_000, 10_000, 10_000, 10_000)
PERMISSIVE = Limits(16 * 1024 * MIB, 4 * 1024 * MIB, 10_000_000, 4 * 1024 * MIB, 512, 10_000, 2_560, 40_960, 10_000_000, 1_000_000, 1_000_000, 1_000_000)
SETS = {"safe": SAFE, "paranoid": PARANOID, "permissive": PERMISSIVE}

#: The list of a record that each limit is for.
LISTS = {
    "max_polyline": {"LWPOLYLINE": ("vertices", "bulges", "vertex_ids", "widths")},
    "max_clip_vertices": {"IMAGE": ("clip_boundary",), "WIPEOUT": ("clip_polygon",), "UNDERLAY": ("clip_polygon",)},
    "max_leader_points": {"LEADER": ("points",)},
    "max_spline_points": {"SPLINE": ("fit.points", "control.knots", "control.points")},
    "max_xdata": {"XDATA": ("items",)},
}


def named(name: str = "safe", **changed: int) -> Limits:
    """The set of a name, with single values changed."""
    if name not in SETS:
        raise ValueError(f"no limits {name!r}; there are {', '.join(SETS)}")
    return replace(SETS[name], **changed)


def exceeded(kind: str, record: dict, limits: Limits) -> str | None:
    """What a record has too much of, or None."""
    for limit, kinds in LISTS.items():
        for place in kinds.get(kind, ()):
            at = record
            for k in place.split("."):
                at = (at or {}).get(k)
            if at is not None and len(at) > getattr(limits, limit):
                return f"{len(at)} {place} over {limit} {getattr(limits, limit)}"
    return None


def table() -> list[tuple[str, str, int]]:
    """(set, limit, value) of all sets."""
    return [(name, k, v) for name, limits in SETS.items() for k, v in asdict(limits).items()]
