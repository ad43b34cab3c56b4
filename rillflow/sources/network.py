"""EPANET ``.inp`` network files as vertices and edges in SI units.

A network file is configuration of some thousand lines: it is read as one text (through Spark, so from any store) and parsed on the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators.contracts import ContractError

# Cubic metres a second for one unit of flow; the first five mean US customary lengths.
FLOW_UNITS = {
    "CFS": 0.028316846592, "GPM": 6.30901964e-05, "MGD": 0.0438126363889, "IMGD": 0.0526167824074, "AFD": 0.0142764101568,
    "LPS": 0.001, "LPM": 1.66666666667e-05, "MLD": 0.0115740740741, "CMH": 0.000277777777778, "CMD": 1.15740740741e-05,
}
US = ("CFS", "GPM", "MGD", "IMGD", "AFD")
FOOT, INCH = 0.3048, 0.0254

VERTICES_DDL = (
    "asset_id string, kind string, elevation double, base_demand double, pattern string, base_head double, init_level double, "
    "min_level double, max_level double, diameter double, x double, y double"
)
EDGES_DDL = "asset_id string, kind string, start string, end string, length double, diameter double, roughness double, status string, setting string"


def sections(text: str) -> dict[str, list[list[str]]]:
    """Section name -> its lines as words; comments after ``;`` are dropped."""
    out: dict[str, list[list[str]]] = defaultdict(list)
    name = ""
    for line in text.splitlines():
        line = line.split(";", 1)[0].strip()
        if line.startswith("["):
            name = line.strip("[]").upper()
        elif line and name:
            out[name].append(line.split())
    return out


def _number(words: list[str], i: int, unit: float = 1.0) -> float | None:
    return float(words[i]) * unit if len(words) > i else None


def _text(words: list[str], i: int) -> str | None:
    return words[i] if len(words) > i else None


def parse(text: str) -> tuple[list[tuple], list[tuple]]:
    s = sections(text)
    units = next((w[1].upper() for w in s["OPTIONS"] if w[0].upper() == "UNITS"), "GPM")
    if units not in FLOW_UNITS:
        raise ContractError("units", f"unknown flow unit: {units}")
    flow, us = FLOW_UNITS[units], units in US
    length, pipe = (FOOT, INCH) if us else (1.0, 0.001)
    at = {w[0]: (float(w[1]), float(w[2])) for w in s["COORDINATES"] if len(w) > 2}
    demands: dict[str, tuple[float, str | None]] = {}
    for w in s["DEMANDS"]:  # several categories of one junction add up; the first one's pattern stands
        old = demands.get(w[0], (0.0, _text(w, 2)))
        demands[w[0]] = (old[0] + float(w[1]) * flow, old[1])
    status = {w[0]: w[1].upper() for w in s["STATUS"] if len(w) > 1}

    def xy(name: str) -> tuple[float, float]:
        return at.get(name, (0.0, 0.0))

    vertices = []
    for w in s["JUNCTIONS"]:
        demand, pattern = demands.get(w[0], (_number(w, 2, flow) or 0.0, _text(w, 3)))
        vertices.append((w[0], "junction", _number(w, 1, length), demand, pattern, None, None, None, None, None, *xy(w[0])))
    for w in s["RESERVOIRS"]:
        head = _number(w, 1, length)
        vertices.append((w[0], "reservoir", head, None, _text(w, 2), head, None, None, None, None, *xy(w[0])))
    for w in s["TANKS"]:
        vertices.append((w[0], "tank", _number(w, 1, length), None, None, None, *(_number(w, i, length) for i in (2, 3, 4, 5)), *xy(w[0])))
    edges = []
    for w in s["PIPES"]:
        edges.append((w[0], "pipe", w[1], w[2], _number(w, 3, length), _number(w, 4, pipe), _number(w, 5), status.get(w[0], (_text(w, 7) or "OPEN").upper()), None))
    for w in s["PUMPS"]:
        edges.append((w[0], "pump", w[1], w[2], None, None, None, status.get(w[0], "OPEN"), " ".join(w[3:]) or None))
    for w in s["VALVES"]:
        edges.append((w[0], "valve", w[1], w[2], None, _number(w, 3, pipe), None, status.get(w[0], "ACTIVE"), " ".join(w[4:6]) or None))
    return vertices, edges


def read_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a network file."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return frames(spark, *parse(text))


def frames(spark: SparkSession, vertices: Iterable[tuple], edges: Iterable[tuple]) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(list(vertices), VERTICES_DDL), spark.createDataFrame(list(edges), EDGES_DDL)


def network_summary(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many of each kind of component."""
    kinds = vertices.select("kind").union(edges.select("kind"))
    return kinds.agg(*(F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("junction", "tank", "reservoir", "pipe", "pump", "valve")))
