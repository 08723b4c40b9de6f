"""Configuration and small JSON inputs."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.text import IMAGE_EXTENSIONS


@dataclass
class Source:
    name: str
    path: str
    recursive: bool = True


@dataclass
class Config:
    sources: list[Source] = field(default_factory=list)
    extensions: list[str] = field(default_factory=lambda: list(IMAGE_EXTENSIONS))
    hydrate_cloud_files: bool = False
    visual_search: bool = True
    meaning_search: bool = False
    visual_model: str = "hash-projection"
    meaning_model: str = "hash-projection"


def differs(previous: Config, following: Config) -> dict[str, bool]:
    """What a new configuration asks to be done again: indexing (sources and extensions in their order), image vectors, meaning vectors."""
    a, b = previous, following
    return {
        "indexing": a.sources != b.sources or [x.lower() for x in a.extensions] != [x.lower() for x in b.extensions] or a.hydrate_cloud_files != b.hydrate_cloud_files,
        "visual": (a.visual_search, a.visual_model) != (b.visual_search, b.visual_model),
        "meaning": (a.meaning_search, a.meaning_model) != (b.meaning_search, b.meaning_model),
    }


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(r.title() for r in rest)


def save(config: Config, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({_camel(k): v for k, v in asdict(config).items()}, f, indent=2, ensure_ascii=False)


def load(path: str) -> Config:
    """Defaults where there is no file; unknown keys are passed over."""
    if not os.path.exists(path):
        return Config()
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    known = {_camel(k): k for k in asdict(Config())}
    values = {known[k]: v for k, v in data.items() if k in known}
    values["sources"] = [Source(**s) for s in values.get("sources", [])]
    return Config(**values)


def unique_name(name: str, taken: set[str]) -> str:
    """``name``, or with -2, -3, ... if it is taken."""
    out, n = name, 1
    while out in taken:
        n += 1
        out = f"{name}-{n}"
    return out


def eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """[{q, a: [...]}] as rows (q, a)."""
    return spark.read.schema("q string, a array<string>").json(path, multiLine=True)
