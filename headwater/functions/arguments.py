"""Rules for the arguments of the pipeline steps; each raises ValueError, FileExistsError or KeyError, or warns."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

SUFFIXES = (".parquet", ".csv", ".json")


def threshold(value: float) -> int:
    """A stream threshold as a whole number; a fraction is cut off with a warning."""
    if int(value) != value:
        warnings.warn(f"the threshold {value} is cut to {int(value)}", stacklevel=2)
    return int(value)


def burning(streams: object, depth: float | None, slope_depth: float | None) -> None:
    if streams is not None and depth is None and slope_depth is None:
        raise ValueError("burning streams needs a depth or a slope depth")


def overlap(value: float) -> float:
    if not 0 < value <= 1:
        raise ValueError("the overlap threshold lies in (0, 1]")
    return value


def correction(value: str) -> str:
    if value not in ("fill", "breach", "none"):
        raise ValueError("depressions are corrected by fill or breach, or not: none")
    return value


def new_output(exists: bool, path: str, temporary: str | None = None) -> str:
    """A path for a new dataset: it does not exist yet and does not lie in the temporary folder."""
    if exists:
        raise FileExistsError(f"{path} exists")
    if temporary and path.rstrip("/").startswith(temporary.rstrip("/") + "/"):
        raise ValueError("the output may not lie in the temporary folder")
    return path


def site_column(name: object, columns: Iterable[str]) -> str:
    if not isinstance(name, str) or not name:
        raise ValueError("the site id column is one name")
    if name == "link_id":
        raise ValueError("the site id column may not be link_id")
    if name not in set(columns):
        raise KeyError(f"the points have no column {name}")
    return name


def snap_distance(value: float | None) -> float:
    """Infinity where none is given."""
    if value is None:
        return float("inf")
    if value <= 0:
        raise ValueError("a snap distance is positive")
    return float(value)


def layer_lists(numeric: Mapping[str, object] | None, categorical: Mapping[str, object] | None) -> tuple[dict, dict]:
    """Layers of interest by name; none may be in both lists, and one has to be given."""
    both = []
    for some in (numeric, categorical):
        if some is not None and not isinstance(some, Mapping):
            raise ValueError("layers are given by name")
        both.append(dict(some or {}))
    if any(not isinstance(n, str) or not n for some in both for n in some):
        raise ValueError("layers are given by name")
    if shared := sorted(set(both[0]) & set(both[1])):
        raise ValueError(f"numeric and categorical layers share names: {', '.join(shared)}")
    if not both[0] and not both[1]:
        raise ValueError("no layer is given")
    return both[0], both[1]


def one_of(**given: object) -> str:
    """The name of the one argument that is not None."""
    have = [n for n, v in given.items() if v is not None]
    if len(have) != 1:
        raise ValueError(f"give one of {', '.join(given)}")
    return have[0]


def known_variables(wanted: Iterable[str], there: Iterable[str]) -> list[str]:
    wanted, there = list(wanted), set(there)
    if missing := [w for w in wanted if w not in there]:
        raise KeyError(f"no layer of interest {', '.join(missing)}")
    return wanted


def quantiles(values: Iterable[float]) -> list[float]:
    values = list(values)
    if any(not 0 <= q <= 1 for q in values):
        raise ValueError("quantiles lie in [0, 1]")
    return values


def memory_fraction(value: float) -> float:
    if not 0.1 < value < 0.9:
        raise ValueError("the memory fraction lies between 0.1 and 0.9")
    return value


def input_path(path: str) -> str:
    """A path of a kind of file that can be read."""
    if not path.lower().rstrip("/").endswith(SUFFIXES):
        raise ValueError(f"a file is one of {', '.join(SUFFIXES)}")
    return path


@dataclass(frozen=True)
class Geometry:
    """Where a grid lies: size, cell width, origin and coordinate system."""

    rows: int
    cols: int
    cell: float
    x0: float = 0.0
    y0: float = 0.0
    crs: str | None = None


def same_geometry(a: Geometry, b: Geometry) -> bool:
    """Whether two grids have the same cells, so that no resampling is needed."""
    return a == b


def coordinate_system(geometry: Geometry) -> str:
    if not geometry.crs:
        raise ValueError("a layer has a coordinate system")
    return geometry.crs
