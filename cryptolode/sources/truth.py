"""Ground truth in YAML, as the DataFrames that the gate takes; and settings."""

from __future__ import annotations

import dataclasses
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .files import EXTENSIONS

INSTANCES = "id string, file string, line int, algorithm array<string>, bucket string, severity array<string>, quantum_safety array<string>, tier string, language string, rule_id_prefix string"
FORBIDDEN = "file string, line int, line_end int, reason string, allow_safety array<string>, allow_severity string"
SECTIONS = {"instances", "forbidden", "policy_excluded", "deps"}


def several(value: object) -> list[str]:
    """A scalar or a list, as a list."""
    return [] if value is None else [str(x) for x in value] if isinstance(value, list) else [str(value)]


def load_truth(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """instances, forbidden, excluded, expected and must_not_flag; an unknown section, or an instance without what it
    needs, is an error."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text())
    if unknown := set(raw) - SECTIONS - {"version"}:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    by_extension = {x: lang for lang, xs in EXTENSIONS.items() for x in xs.split()}
    rows = []
    for i in raw.get("instances") or []:
        if not i.get("id") or not i.get("file") or not i.get("algorithm"):
            raise ValueError(f"an instance lacks id, file or algorithm: {i}")
        language = by_extension.get(Path(i["file"]).suffix[1:].lower(), "")
        rows.append((i["id"], i["file"], i.get("line"), several(i["algorithm"]), i.get("bucket", ""), several(i.get("severity")), several(i.get("quantum_safety")), i.get("tier", "floor"), language, i.get("rule_id_prefix")))
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("two instances have the same id")
    places = [(f["file"], f.get("line"), f.get("line_end"), f.get("reason", ""), several((f.get("allow") or {}).get("quantum_safety")), (f.get("allow") or {}).get("max_severity")) for f in raw.get("forbidden") or []]
    deps = raw.get("deps") or {}
    return {
        "instances": spark.createDataFrame(rows, INSTANCES),
        "forbidden": spark.createDataFrame(places, FORBIDDEN),
        "excluded": spark.createDataFrame([(x["file"],) for x in raw.get("policy_excluded") or []], "file string"),
        "expected": spark.createDataFrame([(d["manifest"], d["package"], several(d.get("algorithms_include"))) for d in deps.get("expect") or []], "manifest string, package string, algorithms_include array<string>"),
        "must_not_flag": spark.createDataFrame([(d["manifest"], d["package"]) for d in deps.get("must_not_flag") or []], "manifest string, package string"),
    }


@dataclasses.dataclass(frozen=True)
class Config:
    """Settings of a scan. Order of precedence: arguments, environment (CRYPTOLODE_...), nearest file above, defaults."""

    severity_threshold: str = "info"
    exit_on: str = ""
    output_format: str = "text"
    baseline: str = ""

    @classmethod
    def load(cls, folder: str = ".", **arguments: str) -> Config:
        import yaml

        here = Path(folder).resolve()
        file = next((p / ".cryptolode.yaml" for p in (here, *here.parents) if (p / ".cryptolode.yaml").is_file()), None)
        names = [f.name for f in dataclasses.fields(cls)]
        found = {k: v for k, v in ((yaml.safe_load(file.read_text()) or {}) if file else {}).items() if k in names}
        found |= {n: os.environ[f"CRYPTOLODE_{n.upper()}"] for n in names if f"CRYPTOLODE_{n.upper()}" in os.environ}
        return cls(**found | {k: v for k, v in arguments.items() if v is not None})
