"""Ordination models as text files: ten sections, each ended by a blank line.

Site sections are written from the distributed table row by row; everything else is small.
Paths go through Spark's file systems, so a model can be in any store.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mossgrid.operators.ordination import Ordination

#: Section titles in order, with row titles and decimals.
EIGEN, MEANS, COEF, BIPLOT = "Eigenvalues", "Variable Means", "Coefficient Loadings", "Biplot Scores"
CENTROIDS, TOLERANCES, SPECIES = "Species Centroids", "Species Tolerances", "Miscellaneous Species Information"
LC, WA, SITES = "Site LC Scores", "Site WA Scores", "Miscellaneous Site Information"
DECIMALS = {EIGEN: 8, MEANS: 5, COEF: 11, BIPLOT: 9, CENTROIDS: 9, TOLERANCES: 6, SPECIES: 5, LC: 11, WA: 10, SITES: 6}


def _rows(title: str, head: str, axes: list[str], rows: Iterable[tuple[object, Iterable[float]]]) -> Iterator[str]:
    yield f"### {title} ###"
    yield ",".join([head, *axes])
    for name, values in rows:
        yield ",".join([str(name), *(f"{x:.{DECIMALS[title]}f}" for x in values)])
    yield ""


def lines(model: Ordination) -> Iterator[str]:
    """The model's text, line by line."""
    axes = [f"{model.prefix}{k + 1}" for k in range(model.rank)]
    yield f"### {EIGEN} ###"
    yield from (f"{a},{e:.{DECIMALS[EIGEN]}f}" for a, e in zip(axes, model.eigenvalues))
    yield ""
    yield f"### {MEANS} ###"
    yield from (f"{v},{m:.{DECIMALS[MEANS]}f}" for v, m in zip(model.variables, model.means))
    yield ""
    yield from _rows(COEF, "VARIABLE", axes, zip(model.variables, model.coefficients))
    yield from _rows(BIPLOT, "VARIABLE", axes, zip(model.variables, model.biplot))
    yield from _rows(CENTROIDS, "SPECIES", axes, zip(model.species, model.centroids))
    yield from _rows(TOLERANCES, "SPECIES", axes, zip(model.species, model.tolerances))
    yield from _rows(SPECIES, "SPECIES", ["WEIGHT", "N2"], ((s, (w, n)) for s, w, n in model.species_info))
    sites = model.sites.orderBy("id")
    yield from _rows(LC, "ID", axes, ((r["id"], r["lc"]) for r in sites.select("id", "lc").toLocalIterator()))
    yield from _rows(WA, "ID", axes, ((r["id"], r["wa"]) for r in sites.select("id", "wa").toLocalIterator()))
    yield from _rows(SITES, "ID", ["WEIGHT", "N2"], ((r["id"], (r["weight"], r["n2"])) for r in sites.select("id", "weight", "n2").toLocalIterator()))


def write(model: Ordination, spark: SparkSession, path: str) -> None:
    """Write the file through the file system that owns the path."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        held: list[str] = []
        for line in lines(model):
            held.append(line)
            if len(held) >= 5000:
                stream.write(bytearray(("\n".join(held) + "\n").encode()))
                held = []
        stream.write(bytearray(("\n".join(held) + "\n").encode()))
    finally:
        stream.close()


def chunks(text_lines: Iterable[str], start: str, end: str, skip: int = 0) -> Iterator[list[str]]:
    """Stretches from a line that matches ``start`` to one that matches ``end`` (left out),
    without the first ``skip`` lines; an open one ends with the text."""
    held: list[str] | None = None
    for line in text_lines:
        if held is None:
            if re.search(start, line):
                held = [line]
        elif re.search(end, line):
            yield held[skip:]
            held = None
        else:
            held.append(line)
    if held is not None:
        yield held[skip:]


def read(spark: SparkSession, path: str, delimiter: str = ",") -> Ordination:
    """A model from its file. Only the sections of axes, variables and species come to the
    driver; site scores stay a table (sorted by id where that matters)."""
    text = spark.read.text(path, wholetext=False)
    numbered = text.select(F.monotonically_increasing_id().alias("n"), "value")  # one file: ids follow its lines
    heads = [(r["n"], r["value"].strip("# \r")) for r in numbered.where(F.col("value").startswith("### ")).orderBy("n").collect()]
    bounds = {t: (n, heads[k + 1][0] if k + 1 < len(heads) else None) for k, (n, t) in enumerate(heads)}

    def part(title: str) -> DataFrame:
        if title not in bounds:
            raise ValueError(f"no section {title}")
        a, b = bounds[title]
        out = numbered.where((F.col("n") > a) & (F.trim("value") != ""))
        return out if b is None else out.where(F.col("n") < b)

    def small(title: str, header: bool = True) -> tuple[list[str], np.ndarray]:
        rows = [r["value"].split(delimiter) for r in part(title).orderBy("n").collect()][1 if header else 0 :]
        return [r[0] for r in rows], np.array([[float(x) for x in r[1:]] for r in rows])

    axes, eigen = small(EIGEN, False)
    means_names, means = small(MEANS, False)
    variables, coef = small(COEF)
    _, biplot = small(BIPLOT)
    species, centroids = small(CENTROIDS)
    _, tolerances = small(TOLERANCES)
    info_names, info = small(SPECIES)
    if means_names != variables or info_names != species:
        raise ValueError("sections name different variables or species")

    def scores(title: str, name: str) -> DataFrame:
        cut = F.split("value", re.escape(delimiter))
        first = part(title).agg(F.min("n").alias("n")).first()["n"]
        return part(title).where(F.col("n") > first).select(cut[0].cast("long").alias("id"), F.transform(F.slice(cut, 2, 10_000), lambda x: x.cast("double")).alias(name))

    about = scores(SITES, "about").select("id", F.col("about")[0].alias("weight"), F.col("about")[1].alias("n2"))
    sites = about.join(scores(LC, "lc"), "id").join(scores(WA, "wa"), "id")
    prefix = re.sub(r"\d+$", "", axes[0]) if axes else "CCA"
    return Ordination(prefix, variables, species, means[:, 0], eigen[:, 0], coef, biplot, centroids, float("nan"), tolerances, [(s, *map(float, x)) for s, x in zip(info_names, info)], sites)
