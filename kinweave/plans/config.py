"""Settings of a clustering run."""

from __future__ import annotations

import hashlib
import io
import json
import logging
import sys
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import SparkSession

from kinweave.sources.files import write_text

log = logging.getLogger("kinweave")


@dataclass(frozen=True)
class Config:
    """A run: models, neighbour lists, pair selection, propagation."""

    base: str = "base"
    committee: tuple[str, ...] = ()
    k: int = 15
    metric: str = "cosine"
    knn_strategy: str = "exact"
    strategy: str = "vote"  # vote, mediator or groundtruth
    accept: int | None = None  # by default all of the committee
    th: float = 0.66
    inputs: tuple[str, ...] = ("relationship", "affinity", "structure")
    max_sz: int = 600
    step: float = 0.05
    max_iter: int = 100
    learning: str = "lbfgs"  # of the mediator: lbfgs (spark.ml's perceptron) or sgd (a ReLU network by minibatches)
    epochs: int = 2  # of sgd
    lr: float = 1e-3
    force_retrain: bool = False  # also where a trained mediator is kept
    validate: float = 0.0  # share of the labelled pairs held out to report on the mediator

    def key(self, *names: str, **more) -> str:
        """A stable hash of the settings ``names`` (by default all) and of ``more``, for tables kept between runs."""
        values = {n: v for n, v in asdict(self).items() if not names or n in names}
        return hashlib.sha256(json.dumps({**values, **more}, sort_keys=True).encode()).hexdigest()[:16]

    @classmethod
    def from_dict(cls, values: dict) -> Config:
        known = {f.name for f in fields(cls)}
        if unknown := set(values) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})

    @classmethod
    def from_yaml(cls, text: str) -> Config:
        import yaml

        return cls.from_dict(yaml.safe_load(text) or {})

    def but(self, **changes) -> Config:
        return replace(self, **changes)


_MEMBERS = ("resnet50", "resnet101", "densenet121", "ir")

# Named parameter sets.
PRESETS = {
    "single": Config(base="nas", th=0.66, accept=0),
    "committee": Config(base="nas", committee=_MEMBERS, accept=4, th=0.605),
    "mediator": Config(base="nas", committee=_MEMBERS, strategy="mediator", th=0.9925),
}
API_THRESHOLDS = {"cosine": 0.54, "l1": 0.2, "l2": 0.2, "angular": 0.35}


@contextmanager
def timed(phase: str) -> Iterator[None]:
    """Log how long a phase took."""
    began = time.perf_counter()
    try:
        yield
    finally:
        log.info("%s: %.1f s", phase, time.perf_counter() - began)


@contextmanager
def run_log(spark: SparkSession, path: str) -> Iterator[None]:
    """Lines of this library's log go to standard output, and in the end to the file ``path`` of any file system."""
    held = io.StringIO()
    handlers = [logging.StreamHandler(sys.stdout), logging.StreamHandler(held)]
    before = log.level
    log.setLevel(logging.INFO)
    for handler in handlers:
        handler.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
        log.addHandler(handler)
    try:
        yield
    finally:
        for handler in handlers:
            log.removeHandler(handler)
        log.setLevel(before)
        write_text(spark, path, held.getvalue())


class RunningMean:
    """Mean of the last ``length`` values (of all, for 0)."""

    def __init__(self, length: int = 0):
        self.length, self.values = length, []

    def add(self, value: float) -> float:
        self.values.append(value)
        if self.length:
            self.values = self.values[-self.length:]
        return self.mean

    @property
    def mean(self) -> float:
        return sum(self.values) / len(self.values) if self.values else 0.0
