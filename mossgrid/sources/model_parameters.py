"""A model's parameter document (XML), read by the place of each element.

A document has groups: file locations, model, ordination, imputation and domain parameters,
accuracy and outlier assessment. Each value has a name, a path from the root and a kind;
files belong to a folder, which may itself lie in another. Absent elements give None (or an
empty list); a value that is there and cannot be read raises and tells its path.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import SparkSession

from .small_files import AccuracyParameters, HexLevel, ImputationParameters, OrdinationParameters, OutlierParameters, Parameters, Variable
from .tables import domain_points

#: Fixed values of the document's format. Folders: the path of each and the folder it lies in.
FOLDERS = {
    "model": ("file_locations/model_directory", None),
    "accuracy": ("accuracy_assessment/accuracy_assessment_folder", "model"),
    "regional": ("accuracy_assessment/diagnostics/regional_accuracy/output_folder", "accuracy"),
    "riemann": ("accuracy_assessment/diagnostics/riemann_accuracy/output_folder", "accuracy"),
    "validation": ("accuracy_assessment/diagnostics/validation_accuracy/output_folder", "accuracy"),
    "outlier": ("outlier_assessment/outlier_assessment_folder", "model"),
}
#: Files by folder ("": as they stand) and path; named by their last element unless a name is given.
FILES = {
    "": {"file_locations": "coordinate_file boundary_raster mask_raster projection_file footprint_file environmental_pixel_file"},
    "model": {
        "file_locations": "id_list_file species_matrix_file environmental_matrix_file plot_independence_crosswalk_file plot_year_crosswalk_file stand_attribute_file stand_metadata_file "
        "independent_predicted_file independent_zonal_pixel_file dependent_predicted_file dependent_zonal_pixel_file dependent_nn_index_file",
    },
    "accuracy": {
        "accuracy_assessment": "accuracy_assessment_report report_metadata_file",
        "accuracy_assessment/diagnostics/local_accuracy": "local_accuracy_file=output_file",
        "accuracy_assessment/diagnostics/error_matrix_accuracy": "error_matrix_accuracy_file=error_matrix_file error_matrix_bin_file=classification_bin_file",
        "accuracy_assessment/diagnostics/species_accuracy": "species_accuracy_file=output_file",
        "accuracy_assessment/diagnostics/vegclass_accuracy": "vegclass_file vegclass_kappa_file vegclass_errmatrix_file",
    },
    "regional": {
        "accuracy_assessment/diagnostics/regional_accuracy": "area_estimate_file regional_accuracy_file=output_file regional_predicted_plot_file=predicted_plot_file "
        "regional_error_matrix_file=error_matrix_file regional_bin_file=classification_bin_file regional_olofsson_file=olofsson_file",
    },
    "riemann": {"accuracy_assessment/diagnostics/riemann_accuracy": "hex_attribute_file hex_id_file hex_statistics_file"},
    "validation": {"accuracy_assessment/diagnostics/validation_accuracy": "validation_attribute_file"},
    "outlier": {
        "outlier_assessment/diagnostics/nn_index_outlier": "nn_index_outlier_file",
        "outlier_assessment/diagnostics/vegclass_outlier": "vegclass_outlier_file",
        "outlier_assessment/diagnostics/vegclass_variety": "vegclass_variety_file",
        "outlier_assessment/diagnostics/variable_deviation_outlier": "variable_deviation_file=output_file",
    },
}
#: Single values by kind and group.
VALUES = {
    str: {
        "": "parameter_set",
        "file_locations": "plot_dsn web_dsn plot_id_field",
        "model_parameters": "model_project",
        "ordination_parameters": "variable_filter",
        "accuracy_assessment/diagnostics/error_matrix_accuracy": "error_matrix_bin_method=bin_method",
    },
    int: {
        "model_parameters": "model_region model_year coincident_plots lump_table buffer",
        "imputation_parameters": "number_axes use_axis_weighting k max_neighbors",
        "domain_parameters": "write_axes write_neighbors write_distances",
        "accuracy_assessment/diagnostics/error_matrix_accuracy": "error_matrix_bin_count=bin_count",
        "accuracy_assessment/diagnostics/regional_accuracy": "regional_assessment_year=assessment_year",
        "accuracy_assessment/diagnostics/riemann_accuracy": "riemann_assessment_year=assessment_year",
    },
    float: {"outlier_assessment/diagnostics/nn_index_outlier": "index_threshold"},
}
ORDINATION_FILES = {"vegan": "vegan_file", "numpy": "numpy_file", "sknnr": "sknnr_file"}
STATIC, TEMPORAL = "STATIC", "TEMPORAL"


def _named(groups: dict[str, str]) -> dict[str, str]:
    """Name and path of each entry of a table above."""
    out = {}
    for group, entries in groups.items():
        for entry in entries.split():
            name, _, element = entry.partition("=")
            out[name] = f"{group}/{element or name}".lstrip("/")
    return out


_FILE_PATHS = {name: (path, folder) for folder, groups in FILES.items() for name, path in _named(groups).items()}
_VALUE_PATHS = {name: (path, kind) for kind, groups in VALUES.items() for name, path in _named(groups).items()}


class ModelDocument:
    """The values of one document: ``doc["k"]``, ``doc.file("stand_attribute_file")`` and the
    lists below."""

    def __init__(self, root: ET.Element):
        self.root = root

    # --- single values ---

    def _text(self, path: str, element: ET.Element | None = None) -> str | None:
        found = (self.root if element is None else element).find(path)
        text = (found.text or "").strip() if found is not None else ""
        return text or None

    def _number(self, kind: type, path: str, element: ET.Element | None = None):
        text = self._text(path, element)
        try:
            return None if text is None else kind(text)
        except ValueError as e:
            raise ValueError(f"{path}: {text!r} is no {kind.__name__}") from e

    def __getitem__(self, name: str):
        if name in _FILE_PATHS:
            return self.file(name)
        path, kind = _VALUE_PATHS[name]
        return self._number(kind, path)

    def names(self) -> list[str]:
        return [*_VALUE_PATHS, *_FILE_PATHS]

    # --- folders and files ---

    def folder(self, name: str) -> str:
        path, parent = FOLDERS[name]
        return _joined(self.folder(parent) if parent else "", self._text(path) or "")

    def file(self, name: str) -> str | None:
        """Where a file is: its folder's path and its name, or as it stands."""
        path, folder = _FILE_PATHS[name]
        text = self._text(path)
        if text is None:
            return None
        return _joined(self.folder(folder) if folder else "", text)

    def neighbor_file(self, number: int) -> str | None:
        prefix = self._text("domain_parameters/window/output/neighbor_file")
        return None if prefix is None else _joined(self.folder("model"), f"{prefix}{number}.tif")

    # --- model ---

    def _first(self, path: str) -> ET.Element | None:
        group = self.root.find(path)
        return None if group is None or not len(group) else group[0]

    @property
    def model_type(self) -> str | None:
        found = self._first("model_parameters/model_type")
        return None if found is None else found.tag

    @property
    def image(self) -> tuple[str, float] | None:
        """Source and version of the imagery that a model with imagery was made from."""
        own = self._first("model_parameters/model_type")
        source = None if own is None else self._text("image_source", own)
        return None if source is None else (source, self._number(float, "image_version", own) or 0.0)

    @property
    def image_years(self) -> str | list[tuple[int, int]]:
        """Plot year and image year pairs, or the keyword that stands for them."""
        own = self._first("model_parameters/model_type")
        group = None if own is None else own.find("plot_image_crosswalk")
        if group is None:
            return []
        return self._text("keyword", group) or [(self._number(int, "plot_year", x), self._number(int, "image_year", x)) for x in group.iter("plot_image_pair")]

    @property
    def plot_years(self) -> list[int]:
        own = self._first("model_parameters/model_type")
        listed = [] if own is None else [int(x.text) for x in own.findall("plot_years/*")]
        pairs = self.image_years
        return listed or ([] if isinstance(pairs, str) else [a for a, _ in pairs])

    def _switches(self, path: str, on: str) -> list[str]:
        group = self.root.find(path)
        return [] if group is None else [x.tag.lower() for x in group if (x.text or "").strip() == on]

    @property
    def plot_types(self) -> list[str]:
        return self._switches("model_parameters/plot_types", "1")

    @property
    def exclusion_codes(self) -> list[str]:
        return self._switches("model_parameters/exclusion_codes", "0")

    # --- ordination and imputation ---

    @property
    def ordination(self) -> dict[str, str | int | None]:
        """program, metric, transform, downweighting and file of the ordination."""
        own = self._first("ordination_parameters")
        if own is None:
            raise ValueError("ordination_parameters: no program")
        if own.tag not in ORDINATION_FILES:
            raise ValueError(f"ordination_parameters: unknown program {own.tag}")
        file = self._text(ORDINATION_FILES[own.tag], own)
        return {
            "program": own.tag, "metric": self._text("distance_metric", own), "transform": self._text("species_transform", own),
            "downweighting": self._number(int, "species_downweighting", own), "file": None if file is None else _joined(self.folder("model"), file),
        }

    @property
    def variables(self) -> str | list[Variable]:
        """The covariates, static ones without years, or the keyword that stands for them."""
        group = self.root.find("ordination_parameters/ordination_variables")
        if group is None:
            return []
        keyword = self._text("keyword", group)
        if keyword:
            return keyword
        years: dict[tuple[str, str], list[int]] = {}
        for x in group.findall("ordination_variable"):
            kind = x.get("variable_type", STATIC)
            if kind not in (STATIC, TEMPORAL):
                raise ValueError(f"ordination_variable: unknown type {kind}")
            own = years.setdefault((self._text("variable_name", x) or "", self._text("variable_path", x) or ""), [])
            if kind == TEMPORAL:
                own.append(int(x.get("model_year", "0")))
        return [Variable(name, path, tuple(y)) for (name, path), y in years.items()]

    def _weights(self, element: ET.Element | None, k: int) -> str | tuple[float, ...]:
        if element is None or not len(element):
            return "INVERSE_DISTANCES"
        keyword = self._text("keyword", element)
        if keyword is not None:
            if keyword not in ("INVERSE_DISTANCES", "EQUAL"):
                raise ValueError(f"weights: unknown keyword {keyword}")
            return keyword
        listed = [float(x.text) for x in element]
        if len(listed) != k:
            raise ValueError(f"weights: {len(listed)} for {k} neighbors")
        return tuple(x / sum(listed) for x in listed)

    @property
    def weights(self) -> str | tuple[float, ...]:
        return self._weights(self.root.find("imputation_parameters/weights"), self["k"] or 1)

    # --- domain ---

    @property
    def domain(self) -> str | None:
        found = self._first("domain_parameters")
        return None if found is None else found.tag

    @property
    def envelope(self) -> list[float] | None:
        """x_min, y_min, x_max, y_max of a window."""
        group = self.root.find("domain_parameters/window/envelope")
        return None if group is None else [self._number(float, c, group) for c in ("x_min", "y_min", "x_max", "y_max")]

    @property
    def window(self) -> dict[str, str | float | None]:
        """Cell size and names of outputs of a window."""
        names = ("axes_file", "neighbor_file", "distance_file", "output_format")
        return {"cell_size": self._number(float, "domain_parameters/window/cell_size")} | {n: self._text(f"domain_parameters/window/output/{n}") for n in names}

    def points(self, spark: SparkSession):
        """x and y of a point or a list of points, None for other domains."""
        own = self._first("domain_parameters")
        if own is None or own.tag not in ("point", "list"):
            return None
        listed = [own] if own.tag == "point" else own.findall("points/*")
        if listed:
            return domain_points(spark, [(self._number(float, "x", p), self._number(float, "y", p)) for p in listed])
        return domain_points(spark, path=(own[0].text or "").strip())

    # --- assessments ---

    def _diagnostics(self, group: str) -> list[ET.Element]:
        return self.root.findall(f"{group}/diagnostics/*")

    @property
    def accuracy_diagnostics(self) -> list[str]:
        return [x.tag for x in self._diagnostics("accuracy_assessment")]

    @property
    def outlier_diagnostics(self) -> list[str]:
        return [x.tag for x in self._diagnostics("outlier_assessment")]

    @property
    def in_report(self) -> list[str]:
        return [x.tag for x in self._diagnostics("accuracy_assessment") if self._text("include_in_report", x) == "1"]

    @property
    def hex_levels(self) -> list[HexLevel]:
        found = self.root.findall("accuracy_assessment/diagnostics/riemann_accuracy/hex_resolutions/*")
        return [HexLevel(self._text("field_name", x) or "", self._number(float, "intercell_spacing", x) or 0.0, self._number(float, "area", x) or 0.0, self._number(int, "minimum_plots_per_hex", x) or 1) for x in found]

    @property
    def k_values(self) -> list[tuple[int, str | tuple[float, ...]]]:
        """k and weights of each scale assessment."""
        found = self.root.findall("accuracy_assessment/diagnostics/riemann_accuracy/k_values/*")
        ks = [(x, self._number(int, "k", x) or 1) for x in found]
        return [(k, self._weights(x.find("weights"), k)) for x, k in ks]

    @property
    def deviations(self) -> list[tuple[str, float]]:
        found = self.root.findall("outlier_assessment/diagnostics/variable_deviation_outlier/variable")
        return [(self._text("variable_name", x) or "", self._number(float, "min_deviation", x) or 0.0) for x in found]

    # --- all that computations need ---

    def parameters(self) -> Parameters:
        own, variables = self.ordination, self.variables
        if isinstance(variables, str):
            raise ValueError(f"ordination_variables: {variables} stands for a list that is not here")
        chosen = lambda value, default: default if value is None else value
        files = {n: p for n in _FILE_PATHS if (p := self.file(n)) is not None} | ({"ordination_file": own["file"]} if own["file"] else {})
        return Parameters(
            directory=self.folder("model"), model_type=self.model_type or "sppsz", model_year=self["model_year"] or 0, plot_id=self["plot_id_field"] or "FCID", files=files,
            ordination=OrdinationParameters(own["program"], own["metric"] or "CCA", own["transform"] or "NONE", own["downweighting"] or 0, tuple(variables)),
            imputation=ImputationParameters(chosen(self["number_axes"], 8), bool(chosen(self["use_axis_weighting"], 1)), chosen(self["k"], 1), self.weights, chosen(self["max_neighbors"], 100)),
            accuracy=AccuracyParameters(
                tuple(self.accuracy_diagnostics), self._text(FOLDERS["accuracy"][0]) or "", chosen(self["error_matrix_bin_count"], 10), self["error_matrix_bin_method"] or "EQUAL_INTERVAL",
                tuple(self.hex_levels), tuple(k for k, _ in self.k_values) or (1,), tuple(self.k_values),
            ),
            outliers=OutlierParameters(tuple(self.outlier_diagnostics), self._text(FOLDERS["outlier"][0]) or "", chosen(self["index_threshold"], 100.0), tuple(self.deviations)),
        )

    # --- changes ---

    def set(self, name: str, value) -> None:
        """Change a single value or a file's name; elements on the way are made."""
        path = (_FILE_PATHS.get(name) or _VALUE_PATHS[name])[0]
        self._made(path).text = str(value)

    def _made(self, path: str) -> ET.Element:
        at = self.root
        for tag in path.split("/"):
            found = at.find(tag)
            at = ET.SubElement(at, tag) if found is None else found
        return at

    def set_variables(self, variables: Sequence[Variable]) -> None:
        group = self._made("ordination_parameters/ordination_variables")
        for x in list(group):
            group.remove(x)
        for v in variables:
            for year in v.years or (None,):
                own = ET.SubElement(group, "ordination_variable", {"variable_type": STATIC} if year is None else {"variable_type": TEMPORAL, "model_year": str(year)})
                ET.SubElement(own, "variable_name").text, ET.SubElement(own, "variable_path").text = v.name, v.path

    def set_plot_years(self, years: Sequence[int]) -> None:
        own = self._first("model_parameters/model_type")
        if own is None or own.find("plot_image_crosswalk") is not None:
            raise ValueError("years of this type of model come from its imagery")
        group = own.find("plot_years")
        group = ET.SubElement(own, "plot_years") if group is None else group
        for x in list(group):
            group.remove(x)
        for y in years:
            ET.SubElement(group, "plot_year").text = str(y)

    def set_envelope(self, envelope: Sequence[float]) -> None:
        for tag, x in zip(("x_min", "y_min", "x_max", "y_max"), envelope, strict=True):
            self._made(f"domain_parameters/window/envelope/{tag}").text = repr(float(x))

    def write(self, path: str) -> None:
        ET.indent(self.root)
        ET.ElementTree(self.root).write(path, encoding="utf-8", xml_declaration=True)


def _joined(folder: str, name: str) -> str:
    if not folder or "://" in name or name.startswith("/"):
        return name if "://" in name else str(PurePosixPath(name))
    return f"{folder.rstrip('/')}/{name}" if "://" in folder else str(PurePosixPath(folder) / name)


def read_document(path: str) -> ModelDocument:
    if not path.endswith(".xml"):
        raise NotImplementedError("parameters are read from XML files only")
    return ModelDocument(ET.parse(path).getroot())
