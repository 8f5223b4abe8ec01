"""Mapping presets: JSON files with key pairs, column pairs and any-of groups."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import AnyOf, Pair, Rule

VERSION = "1"

PRESET = (
    "version string, key_col_pairs array<struct<a:string,b:string>>, "
    "col_pairs array<struct<a:string,b:string,threshold:int,weight:double>>, "
    "composite_map array<struct<a:string,bs:array<string>,weight:double>>"
)


@dataclass(frozen=True)
class Preset:
    """A saved mapping. Thresholds and weights are kept, and default where a file has none."""

    name: str
    keys: tuple[tuple[str, str], ...]
    pairs: tuple[Pair, ...]
    any_of: tuple[AnyOf, ...]

    def to_json(self) -> str:
        return json.dumps({
            "version": VERSION,
            "key_col_pairs": [{"a": a, "b": b} for a, b in self.keys],
            "col_pairs": [{"a": p.a, "b": p.b, "threshold": p.threshold, "weight": p.weight} for p in self.pairs],
            "composite_map": [{"a": g.a, "bs": list(g.bs), "weight": g.weight} for g in self.any_of],
        }, indent=2)


def preset_of(name: str, keys: Sequence[tuple[str, str]], rules: Sequence[Rule]) -> Preset:
    """A preset from a mapping; pairs that lack a side are left out."""
    return Preset(
        name,
        tuple((a, b) for a, b in keys if a and b),
        tuple(r for r in rules if isinstance(r, Pair) and r.a and r.b),
        tuple(r for r in rules if isinstance(r, AnyOf) and r.a and r.bs),
    )


def preset_table(spark: SparkSession, path: str) -> DataFrame:
    """All presets of a folder, one row per file, with incomplete entries left out."""
    read = spark.read.schema(PRESET).option("multiLine", True).json(path)
    both = lambda p: p["a"].isNotNull() & (p["a"] != "") & p["b"].isNotNull() & (p["b"] != "")
    group = lambda p: p["a"].isNotNull() & (p["a"] != "") & (F.size(F.coalesce(p["bs"], F.array())) > 0)
    return read.select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1).alias("preset"),
        "version",
        F.filter("key_col_pairs", both).alias("key_col_pairs"),
        F.filter("col_pairs", both).alias("col_pairs"),
        F.filter("composite_map", group).alias("composite_map"),
    )


def load_presets(spark: SparkSession, path: str) -> list[Preset]:
    """The presets of a folder, by name. A preset is a handful of names, so they come to the driver."""
    out = []
    for row in preset_table(spark, path).orderBy("preset").collect():
        pairs = [
            Pair(p["a"], p["b"], 100 if p["threshold"] is None else p["threshold"], 1.0 if p["weight"] is None else p["weight"])
            for p in row["col_pairs"] or []
        ]
        groups = [AnyOf(g["a"], tuple(g["bs"]), 1.0 if g["weight"] is None else g["weight"]) for g in row["composite_map"] or []]
        keys = [(k["a"], k["b"]) for k in row["key_col_pairs"] or []]
        out.append(Preset(row["preset"], tuple(keys), tuple(pairs), tuple(groups)))
    return out
