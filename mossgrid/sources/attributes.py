"""Attribute metadata: field descriptions, selection by flags, schemas, checks, XML."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Declared types and how they are stored; a column that need not be declared.
STORED = {"CONTINUOUS": T.DoubleType(), "CATEGORICAL": T.IntegerType(), "CHARACTER": T.StringType(), "ID": T.LongType()}
UNDECLARED = {"HECTARES": T.DoubleType()}


@dataclass(frozen=True)
class AttributeField:
    name: str
    kind: str
    units: str = ""
    description: str = ""
    species: bool = False
    project: bool = False
    accuracy: bool = False
    codes: tuple[tuple[str, str, str], ...] = ()
    fuzzy: tuple[tuple[int, tuple[int, ...]], ...] = ()

    @property
    def in_area(self) -> bool:
        """Whether regional accuracy takes the field."""
        return self.project and self.accuracy and not self.species and self.kind != "CHARACTER"


def select(fields: Iterable[AttributeField], kinds: Iterable[str] | None = None, not_kinds: Iterable[str] = (), species: bool | None = None, project: bool | None = None, accuracy: bool | None = None) -> list[AttributeField]:
    """Fields that meet every condition that is given; none given: all."""
    wanted = None if kinds is None else set(kinds)
    return [f for f in fields if (wanted is None or f.kind in wanted) and f.kind not in set(not_kinds) and all(want is None or have == want for have, want in ((f.species, species), (f.project, project), (f.accuracy, accuracy)))]


def continuous(fields: Iterable[AttributeField]) -> list[AttributeField]:
    return select(fields, ["CONTINUOUS"], species=False, accuracy=True)


def categorical(fields: Iterable[AttributeField]) -> list[AttributeField]:
    return select(fields, ["CATEGORICAL"], accuracy=True)


def species(fields: Iterable[AttributeField]) -> list[AttributeField]:
    return select(fields, species=True, accuracy=True)


def check(columns: Iterable[str], fields: Iterable[AttributeField]) -> None:
    """Every column must be declared."""
    missing = sorted(set(columns) - {f.name for f in fields} - set(UNDECLARED))
    if missing:
        raise ValueError(f"columns without metadata: {', '.join(missing)}")


def schema(columns: Iterable[str], fields: Iterable[AttributeField]) -> T.StructType:
    """A schema for the columns of a file, in their order; nothing is inferred."""
    own = {f.name: STORED[f.kind] for f in fields} | UNDECLARED
    columns = list(columns)
    check(columns, fields)
    return T.StructType([T.StructField(c, own[c]) for c in columns])


def read_csv(spark: SparkSession, path: str, fields: list[AttributeField], id_col: str) -> DataFrame:
    """A table of attributes, typed by metadata. Only the header is read ahead."""
    header = spark.read.option("header", True).csv(path).columns
    if id_col not in header:
        raise ValueError(f"no column {id_col}")
    return spark.read.schema(schema(header, fields)).option("header", True).csv(path)


def project(df: DataFrame, fields: Iterable[AttributeField], id_col: str, with_id: bool = False, **flags) -> DataFrame:
    """The columns that ``select`` picks, in the table's order, with the id if asked for."""
    names = {f.name for f in select(fields, **flags)}
    return df.select([c for c in df.columns if c in names or (with_id and c == id_col)])


def _text(e: ET.Element, tag: str) -> str:
    found = e.find(tag)
    return (found.text or "").strip() if found is not None else ""


def _flag(e: ET.Element, tag: str) -> bool:
    return _text(e, tag).lower() in ("1", "true")


def read_xml(path: str) -> list[AttributeField]:
    """Fields of a metadata file: every element that has a field_name."""
    out = []
    for e in ET.parse(path).getroot().iter():
        if e.find("field_name") is None:
            continue
        codes = tuple((_text(c, "code_value"), _text(c, "label"), _text(c, "description")) for c in e.findall("codes/*"))
        fuzzy = tuple((int(_text(c, "class_value") or 0), tuple(int(x.text) for x in c.iter("fuzzy_value"))) for c in e.findall("fuzzy_classes/*"))
        out.append(AttributeField(_text(e, "field_name"), _text(e, "field_type"), _text(e, "units"), _text(e, "description"), _flag(e, "species_attr"), _flag(e, "project_attr"), _flag(e, "accuracy_attr"), codes, fuzzy))
    return out
