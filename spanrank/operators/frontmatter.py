"""Front matter: YAML between two lines of three dashes, as a flat map.

YAML is read with the core scalars only (null, booleans, integers, floats), so
dates and "yes" stay text; what can't be read gives an empty map, never an error.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanrank.schema import FM


def _loader():
    import re

    import yaml

    class Core(yaml.SafeLoader):
        pass

    Core.yaml_implicit_resolvers = {}
    for tag, pattern, first in (
        ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
        ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
        ("int", r"^[-+]?(?:0|[1-9][0-9]*)$", list("-+0123456789")),
        ("float", r"^[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(?=[eE]))(?:[eE][-+]?[0-9]+)?$", list("-+0123456789.")),
    ):
        Core.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), first)

    def mapping(loader, node, deep=False):
        keys = [k.value for k, _ in node.value]
        if len(set(map(str, keys))) != len(keys):
            raise yaml.YAMLError("a key comes twice")
        return yaml.SafeLoader.construct_mapping(loader, node, deep=True)

    Core.add_constructor("tag:yaml.org,2002:map", mapping)
    return lambda text: yaml.load(text, Core)  # noqa: S506


def scalar_text(value) -> str:
    """A string as it is, anything else as JSON without quotes around it."""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False).strip('"')


def flatten(value, prefix: str = "") -> dict[str, tuple[bool, list[str]]]:
    """Dotted keys; a list of scalars stays one entry, a list with anything nested is numbered."""
    if isinstance(value, dict):
        return {k: v for name, x in value.items() for k, v in flatten(x, f"{prefix}.{name}" if prefix else str(name)).items()}
    if isinstance(value, list) and any(isinstance(x, dict | list) for x in value):
        return {k: v for i, x in enumerate(value) for k, v in flatten(x, f"{prefix}[{i}]").items()}
    if not prefix:
        return {}
    return {prefix: (True, [scalar_text(x) for x in value]) if isinstance(value, list) else (False, [scalar_text(value)])}


def parse(block: str | None) -> dict[str, tuple[bool, list[str]]]:
    try:
        return flatten(_loader()(block or ""))
    except Exception:  # noqa: BLE001 -- any malformed block is no front matter
        return {}


def fm(lines: Column, body: Column) -> Column:
    """The map of a document's lines whose body starts at ``body``; only real blocks go to Python."""
    block = F.array_join(F.slice(lines, 2, F.greatest(body - 2, F.lit(0))), "\n")
    return F.when(body > 1, F.udf(parse, FM, useArrow=True)(block)).otherwise(F.create_map().cast("map<string,struct<is_list:boolean,vals:array<string>>>"))
