"""Deployment files and environment files, read on the driver."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SECRET = "api_key"


@dataclass(frozen=True)
class Deployment:
    """One endpoint. The key is kept out of ``repr`` and of every column."""

    label: str
    model: str
    api_base: str | None = None
    api_key: str | None = field(default=None, repr=False)
    extra: dict[str, Any] = field(default_factory=dict)


def secret_path(value: Any, at: str = "") -> str | None:
    """Where a key named ``api_key`` first occurs in nested dicts and lists."""
    pairs = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in pairs:
        here = f"{at}[{k}]" if isinstance(value, list) else f"{at}.{k}" if at else str(k)
        if k == SECRET:
            return here
        deeper = secret_path(v, here)
        if deeper:
            return deeper
    return None


def deployments(path: str) -> list[Deployment]:
    """``[deployments.*]`` tables; secrets in the file are refused."""
    with open(path, "rb") as f:
        data = tomllib.load(f)
    tables = data.get("deployments")
    if not isinstance(tables, dict) or not tables:
        raise ValueError(f"{path}: no [deployments.*] tables")
    secret = secret_path(data)
    if secret:
        raise ValueError(f"{path}: {secret} is a secret; take it from the environment")
    out = []
    for label, table in tables.items():
        if not isinstance(table, dict) or not table.get("model"):
            raise ValueError(f"{path}: deployment {label!r} needs a model")
        rest = {k: v for k, v in table.items() if k not in ("model", "api_base", "extra_kwargs")}
        if rest:
            raise ValueError(f"{path}: unknown keys in {label!r}: {sorted(rest)}")
        out.append(Deployment(label, table["model"], table.get("api_base"), None, table.get("extra_kwargs", {})))
    return out


def replicas(model: str, bases: list[str], key: str | None = None) -> list[Deployment]:
    """``replica-1`` to ``replica-n`` for repeated base URLs."""
    return [Deployment(f"replica-{k}", model, b, key) for k, b in enumerate(bases, 1)]


def coerce(value: Deployment | dict, label: str = "default") -> Deployment:
    if isinstance(value, Deployment):
        return value
    return Deployment(value.get("label", label), value["model"], value.get("api_base"), value.get(SECRET), value.get("extra_kwargs", {}))


def frame(spark: SparkSession, found: list[Deployment]) -> DataFrame:
    """label, model and api_base; never the key."""
    return spark.createDataFrame([(d.label, d.model, d.api_base) for d in found], "label string, model string, api_base string")


def load_env(path: str, environ: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=value lines into the environment, without overriding what is set."""
    env = os.environ if environ is None else environ
    added = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        line = line.strip().removeprefix("export ")
        if not line or line.startswith("#") or "=" not in line:
            continue
        k, v = (x.strip() for x in line.split("=", 1))
        if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"":
            v = v[1:-1]
        if k not in env:
            env[k] = added[k] = v
    return added
