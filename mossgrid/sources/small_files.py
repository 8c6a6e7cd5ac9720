"""Small files that configure an analysis: footprints, classifiers, parameters."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterable
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import PurePosixPath

from mossgrid.operators.rasters import Footprint


def parse_footprints(text: str) -> dict[str, Footprint]:
    """Blocks of ``KEY rows columns cell-size`` and a grid of codes, with blank lines between."""
    out: dict[str, Footprint] = {}
    lines = [x.split() for x in text.splitlines()]
    at = 0
    while at < len(lines):
        if not lines[at]:
            at += 1
            continue
        key, rows, columns, size = lines[at][0], int(lines[at][1]), int(lines[at][2]), float(lines[at][3])
        grid = tuple(tuple(int(x) for x in row) for row in lines[at + 1 : at + 1 + rows])
        if len(grid) != rows or any(len(row) != columns for row in grid):
            raise ValueError(f"footprint {key}: the grid is not {rows} by {columns}")
        out[key] = Footprint(key, grid, size)
        at += 1 + rows
    return out


@dataclass(frozen=True)
class ClassName:
    value: int
    name: str
    fuzzy: tuple[int, ...]


def read_classifier(path: str) -> dict[int, ClassName]:
    out = {}
    for e in ET.parse(path).getroot().iter("classification"):
        value = int(e.findtext("value"))
        out[value] = ClassName(value, (e.findtext("name") or "").strip(), tuple(int(x.text) for x in e.iter("fuzzy_value")))
    return out


def default_classifier(values: Iterable[int]) -> dict[int, ClassName]:
    """Each class is fuzzy-equal to itself alone."""
    return {v: ClassName(v, str(v), (v,)) for v in sorted(set(values))}


@dataclass(frozen=True)
class Variable:
    """A covariate; one with years counts only in those."""

    name: str
    path: str = ""
    years: tuple[int, ...] = ()


@dataclass(frozen=True)
class OrdinationParameters:
    program: str = "numpy"
    metric: str = "CCA"
    transform: str = "NONE"
    downweighting: int = 0
    variables: tuple[Variable, ...] = ()

    def names(self, year: int | None = None) -> list[str]:
        return [v.name for v in self.variables if not v.years or year in v.years]


@dataclass(frozen=True)
class ImputationParameters:
    axes: int = 8
    axis_weighting: bool = True
    k: int = 1
    weights: str | tuple[float, ...] = "INVERSE_DISTANCES"
    max_neighbors: int = 100

    def weight_list(self) -> str | list[float]:
        """EQUAL and inverse distances by name; a list is checked and normalized."""
        if isinstance(self.weights, str):
            return self.weights
        if len(self.weights) != self.k:
            raise ValueError("as many weights as neighbors are needed")
        total = sum(self.weights)
        return [w / total for w in self.weights]


@dataclass(frozen=True)
class HexLevel:
    column: str
    spacing: float = 0.0
    area: float = 0.0
    min_plots: int = 1


@dataclass(frozen=True)
class AccuracyParameters:
    diagnostics: tuple[str, ...] = ()
    directory: str = ""
    bins: int = 10
    bin_method: str = "EQUAL_INTERVAL"
    hex_levels: tuple[HexLevel, ...] = ()
    k_values: tuple[int, ...] = (1,)
    k_weights: tuple[tuple[int, str | tuple[float, ...]], ...] = ()


@dataclass(frozen=True)
class OutlierParameters:
    diagnostics: tuple[str, ...] = ()
    directory: str = ""
    index_threshold: float = 100.0
    deviations: tuple[tuple[str, float], ...] = ()


@dataclass(frozen=True)
class Parameters:
    """All values that change a computation, and the folder that files belong to."""

    directory: str = ""
    model_type: str = "sppsz"
    model_year: int = 0
    plot_id: str = "FCID"
    files: dict[str, str] = field(default_factory=dict)
    ordination: OrdinationParameters = OrdinationParameters()
    imputation: ImputationParameters = ImputationParameters()
    accuracy: AccuracyParameters = AccuracyParameters()
    outliers: OutlierParameters = OutlierParameters()

    def __post_init__(self) -> None:
        if self.plot_id not in ("FCID", "PLTID"):
            raise ValueError("the id column is FCID or PLTID")

    def path(self, name: str) -> str:
        """Where a file is: below the model's folder, in the sub-folder of its group; a whole
        path stays as it is."""
        if "://" in self.files[name] or self.files[name].startswith("/"):
            return self.files[name]
        group = {"accuracy": self.accuracy.directory, "outlier": self.outliers.directory}.get(name.split(":")[0], "")
        return str(PurePosixPath(self.directory) / group / self.files[name]) if "://" not in self.directory else "/".join(x for x in (self.directory.rstrip("/"), group, self.files[name]) if x)


def from_dict(values: dict, base: Parameters | None = None) -> Parameters:
    """Parameters from nested plain values; unknown names are refused."""
    return _fill(base or Parameters(), values)


def _fill(own, values: dict):
    known = {f.name for f in fields(own)}
    if odd := set(values) - known:
        raise ValueError(f"unknown parameters: {', '.join(sorted(odd))}")
    new = {}
    for name, value in values.items():
        now = getattr(own, name)
        if is_dataclass(now) and isinstance(value, dict):
            value = _fill(now, value)
        elif name == "variables":
            value = tuple(v if isinstance(v, Variable) else Variable(**v) if isinstance(v, dict) else Variable(v) for v in value)
        elif name == "hex_levels":
            value = tuple(v if isinstance(v, HexLevel) else HexLevel(**v) for v in value)
        elif isinstance(now, tuple) and isinstance(value, (list, tuple)):
            value = tuple(tuple(v) if isinstance(v, list) else v for v in value)
        elif isinstance(value, list):
            value = tuple(value)
        new[name] = value
    return replace(own, **new)


def read_parameters(path: str) -> Parameters:
    """Parameters from an XML file: a model's document, whose elements are read by their
    place, or a plain list, whose elements are found by name wherever they stand. Other kinds
    of files are refused."""
    if not path.endswith(".xml"):
        raise NotImplementedError("parameters are read from XML files only")
    root = ET.parse(path).getroot()
    if root.find("file_locations") is not None:
        from .model_parameters import ModelDocument

        return ModelDocument(root).parameters()

    def text(*names: str, default: str = "") -> str:
        for name in names:
            found = root.find(f".//{name}")
            if found is not None and found.text and found.text.strip():
                return found.text.strip()
        return default

    names = []
    for v in root.iter("ordination_variable"):
        years = tuple(int(y.text) for y in v.iter("model_year") if y.text)
        names.append(Variable((v.findtext("variable_name") or "").strip(), (v.findtext("variable_path") or "").strip(), years))
    weights: str | tuple[float, ...] = text("imputation_weights", "weights", default="INVERSE_DISTANCES")
    listed = [float(w.text) for w in root.iter("weight") if w.text and w.text.strip().replace(".", "", 1).isdigit()]
    if listed:
        weights = tuple(listed)
    levels = tuple(HexLevel((h.findtext("field") or "").strip(), float(h.findtext("spacing") or 0), float(h.findtext("area") or 0), int(h.findtext("minimum_plots_per_hex") or 1)) for h in root.iter("hex_resolution"))
    deviations = tuple(((v.findtext("variable_name") or "").strip(), float(v.findtext("min_deviation") or 0)) for v in root.iter("variable") if v.find("min_deviation") is not None)
    files = {e.tag: e.text.strip() for e in root.iter() if e.tag.endswith("_file") and e.text and e.text.strip()}
    accuracy = tuple(e.text.strip() for e in root.findall(".//accuracy_assessment//diagnostic") if e.text)
    outliers = tuple(e.text.strip() for e in root.findall(".//outlier_assessment//diagnostic") if e.text)
    return Parameters(
        directory=text("model_directory"), model_type=text("model_type", default="sppsz"), model_year=int(text("model_year", default="0")), plot_id=text("plot_id_field", default="FCID"), files=files,
        ordination=OrdinationParameters(text("ordination_program", "program", default="numpy"), text("distance_metric", "metric", default="CCA"), text("species_transform", default="NONE"), int(float(text("species_downweighting", default="0"))), tuple(names)),
        imputation=ImputationParameters(int(text("number_axes", default="8")), text("use_axis_weighting", default="1").lower() in ("1", "true"), int(text("k", default="1")), weights, int(text("max_neighbors", default="100"))),
        accuracy=AccuracyParameters(accuracy, text("accuracy_assessment_folder"), int(text("bin_count", default="10")), text("bin_method", default="EQUAL_INTERVAL"), levels),
        outliers=OutlierParameters(outliers, text("outlier_assessment_folder"), float(text("index_threshold", default="100")), deviations),
    )
