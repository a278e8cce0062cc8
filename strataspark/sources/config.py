"""Names of the columns of map layers: defaults, changes from dictionaries and files, older keys, file name templates."""

from __future__ import annotations

import copy
import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What each layer's columns and texts are called unless a configuration says otherwise.
DEFAULTS: dict[str, dict[str, Any]] = {
    "structure": {
        "orientation_type": "dip direction", "dipdir_column": "DIPDIR", "dip_column": "DIP", "description_column": "DESCRIPTION",
        "bedding_text": "bedding", "overturned_column": "DESCRIPTION", "overturned_text": "overturned", "objectid_column": "ID",
    },
    "geology": {
        "unitname_column": "UNITNAME", "alt_unitname_column": "CODE", "group_column": "GROUP", "supergroup_column": "SUPERGROUP",
        "description_column": "DESCRIPTION", "minage_column": "MIN_AGE", "maxage_column": "MAX_AGE", "rocktype_column": "ROCKTYPE1",
        "alt_rocktype_column": "ROCKTYPE2", "sill_text": "sill", "intrusive_text": "intrusive", "volcanic_text": "volcanic",
        "objectid_column": "ID", "ignore_lithology_codes": ["cover"],
    },
    "fault": {
        "structtype_column": "FEATURE", "fault_text": "fault", "dip_null_value": "-999", "dipdir_flag": "num", "dipdir_column": "DIPDIR",
        "dip_column": "DIP", "orientation_type": "dip direction", "dipestimate_column": "DIP_ESTIMATE",
        "dipestimate_text": "'NORTH_EAST','NORTH',<rest of cardinals>,'NOT ACCESSED'", "name_column": "NAME", "objectid_column": "ID",
        "minimum_fault_length": -1.0, "ignore_fault_codes": [None],
    },
    "fold": {
        "structtype_column": "FEATURE", "fold_text": "fold", "description_column": "DESCRIPTION", "synform_text": "syncline",
        "foldname_column": "NAME", "objectid_column": "ID",
    },
}
# Older key to (layer, key).
OLDER = {
    "otype": ("structure", "orientation_type"), "dd": ("structure", "dipdir_column"), "d": ("structure", "dip_column"), "sf": ("structure", "description_column"),
    "bedding": ("structure", "bedding_text"), "bo": ("structure", "overturned_column"), "btype": ("structure", "overturned_text"), "gi": ("structure", "objectid_column"),
    "c": ("geology", "unitname_column"), "u": ("geology", "alt_unitname_column"), "g": ("geology", "group_column"), "g2": ("geology", "supergroup_column"),
    "ds": ("geology", "description_column"), "min": ("geology", "minage_column"), "max": ("geology", "maxage_column"), "r1": ("geology", "rocktype_column"),
    "r2": ("geology", "alt_rocktype_column"), "sill": ("geology", "sill_text"), "intrusive": ("geology", "intrusive_text"), "volcanic": ("geology", "volcanic_text"),
    "f": ("fault", "structtype_column"), "fault": ("fault", "fault_text"), "fdipnull": ("fault", "dip_null_value"), "fdipdip_flag": ("fault", "dipdir_flag"),
    "fdipdir": ("fault", "dipdir_column"), "fdip": ("fault", "dip_column"), "fdipest": ("fault", "dipestimate_column"), "fdipest_vals": ("fault", "dipestimate_text"),
    "n": ("fault", "name_column"), "ff": ("fold", "structtype_column"), "fold": ("fold", "fold_text"), "t": ("fold", "description_column"), "syn": ("fold", "synform_text"),
}
#: The older key that names the id column of three layers.
OLDER_ID = ("o", ("structure", "geology", "fold"))

_TOKEN = re.compile(r"""\s+|(?:\#|//)[^\n]*|(?P<sign>[{}\[\]:,])|"(?P<double>(?:[^"\\]|\\.)*)"|'(?P<single>(?:[^'\\]|\\.)*)'|(?P<bare>[^\s{}\[\]:,"'\#]+)""")


def parse(text: str) -> Any:
    """JSON with comments, single quotes, keys without quotes and commas at ends. Empty text raises ValueError."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"unexpected text at {at}: {text[at : at + 20]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    if not tokens:
        raise ValueError("there is nothing to read")
    place = 0

    def take(sign: str | None = None) -> tuple[str, str]:
        nonlocal place
        if place >= len(tokens) or (sign is not None and tokens[place] != ("sign", sign)):
            raise ValueError(f"expected {sign or 'more'} at token {place}")
        place += 1
        return tokens[place - 1]

    def upto(end: str) -> bool:
        """Whether a list or an object goes on; takes its end and the commas between."""
        nonlocal place
        while place < len(tokens) and tokens[place] == ("sign", ","):
            place += 1
        if place < len(tokens) and tokens[place] == ("sign", end):
            place += 1
            return False
        return True

    def value() -> Any:
        kind, text = take()
        if (kind, text) == ("sign", "{"):
            out = {}
            while upto("}"):
                key = take()[1]
                take(":")
                out[key] = value()
            return out
        if (kind, text) == ("sign", "["):
            items = []
            while upto("]"):
                items.append(value())
            return items
        if kind == "sign":
            raise ValueError(f"unexpected {text}")
        if kind == "bare":
            try:
                return json.loads(text)
            except json.JSONDecodeError:
                return text
        return json.loads(f'"{text}"') if kind == "double" else text.replace("\\'", "'")

    return value()


@dataclass
class Config:
    """Layer to key to value."""

    layers: dict[str, dict[str, Any]] = field(default_factory=lambda: copy.deepcopy(DEFAULTS))

    def update(self, changes: dict[str, dict[str, Any]], lower: bool = False) -> Config:
        """Changes by layer; unknown layers and keys raise. lower: texts in lower case."""
        problems = faults(changes)
        if problems:
            raise ValueError("; ".join(problems))
        for layer, values in changes.items():
            self.layers[layer] |= {k: v.lower() if lower and isinstance(v, str) else v for k, v in values.items()}
        return self

    def update_from_older(self, values: dict[str, Any], lower: bool = False) -> Config:
        """Changes by older keys; others are left out."""
        changes: dict[str, dict[str, Any]] = {}
        for key, (layer, name) in OLDER.items():
            if key in values:
                changes.setdefault(layer, {})[name] = values[key]
        if OLDER_ID[0] in values:
            for layer in OLDER_ID[1]:
                changes.setdefault(layer, {})["objectid_column"] = values[OLDER_ID[0]]
        return self.update(changes, lower)

    def update_from_text(self, text: str, lower: bool = False) -> Config:
        """A file's text: by layers, or by older keys where it has no layer."""
        values = parse(text)
        return self.update(values, lower) if set(values) <= set(DEFAULTS) else self.update_from_older(values, lower)

    def frame(self, spark: SparkSession) -> DataFrame:
        """layer, key and value as JSON."""
        rows = [(layer, k, json.dumps(v)) for layer, values in self.layers.items() for k, v in values.items()]
        return spark.createDataFrame(rows, "layer string, key string, value string")

    def renamed(self, df: DataFrame, layer: str) -> DataFrame:
        """A layer's own columns under their canonical names."""
        own = {v: DEFAULTS[layer][k] for k, v in self.layers[layer].items() if k.endswith("_column") and v in df.columns}
        return df.withColumnsRenamed({a: b for a, b in own.items() if a != b})


def faults(changes: dict[str, dict[str, Any]]) -> list[str]:
    """What is wrong with changes to a configuration."""
    out = []
    for layer, values in changes.items():
        if layer not in DEFAULTS:
            out.append(f"unknown layer {layer}")
            continue
        out += [f"unknown key {layer}.{k}" for k in values if k not in DEFAULTS[layer]]
        least = values.get("minimum_fault_length")
        if least is not None and (isinstance(least, bool) or not isinstance(least, (int, float))):
            out.append(f"{layer}.minimum_fault_length is not a number")
    return out


def missing(values: dict[str, dict[str, Any]], required: tuple[str, ...] = ("structure", "geology")) -> list[str]:
    """Layers and keys that a whole configuration lacks."""
    gone = [f"no layer {layer}" for layer in required if layer not in values]
    return gone + [f"no key {layer}.{k}" for layer in required if layer in values for k in DEFAULTS[layer] if k.endswith("_column") and k not in values[layer]]


def with_box(name: Column, box: tuple[float, float, float, float], crs: str) -> Column:
    """File names and addresses with the bounding box in place of {BBOX_STR} and the projection in place of {PROJ_STR}."""
    text = ",".join(f"{v:g}" for v in (*box,)) + f",{crs}"
    return F.replace(F.replace(name, F.lit("{BBOX_STR}"), F.lit(text)), F.lit("{PROJ_STR}"), F.lit(crs))
