"""Repair back ends behind one interface; external ones report that they are not available."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessera.operators import kernels


class ModelUnavailable(RuntimeError):
    """The back end's program or weights are not here; the next candidate is tried."""

    code, transient = "model_unavailable", False


class OutOfMemory(RuntimeError):
    code, transient = "out_of_memory", True


@dataclass(frozen=True)
class Engine:
    name: str
    available: bool
    repair: Callable[[np.ndarray, np.ndarray], np.ndarray]


def _absent(name: str) -> Engine:
    def repair(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
        raise ModelUnavailable(name)

    return Engine(name, False, repair)


REGISTRY: dict[str, Engine] = {"telea": Engine("telea", True, kernels.diffuse), "navier_stokes": Engine("navier_stokes", True, kernels.diffuse), **{n: _absent(n) for n in ("lama", "migan", "propainter", "sttn")}}


def register(engine: Engine) -> None:
    """Adds a back end or replaces one of the name."""
    REGISTRY[engine.name] = engine


def available(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e.name,) for e in REGISTRY.values() if e.available], "engine string")


def execute(chain: list[str], image: np.ndarray, mask: np.ndarray, registry: dict[str, Engine] | None = None) -> tuple[str, np.ndarray]:
    """The first of the chain that works, and its result. Only a missing or overfull back end moves on; any other error is passed on."""
    failed = []
    for name in chain:
        try:
            return name, (registry or REGISTRY)[name].repair(image, mask)
        except (ModelUnavailable, OutOfMemory) as e:
            failed.append(f"{name}: {e.code}")
    raise ModelUnavailable(", ".join(failed))
