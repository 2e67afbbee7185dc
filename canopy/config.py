"""Settings of an index."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

#: Names of the settings in files.
NAMES = {
    "nPoint": "n_points", "nPim": "n_parts", "dimensions": "dimensions", "alpha": "alpha", "beta": "beta",
    "leafWrapThreshold": "leaf_size", "oversamplingRate": "oversampling", "sketchHeight": "sketch_height", "chunkSize": "chunk_size",
}


@dataclass(frozen=True)
class Config:
    n_points: int = 10000
    n_parts: int = 64
    dimensions: int = 3
    alpha: float = 2.0
    beta: float = 2.0
    leaf_size: int = 32
    oversampling: int = 32
    sketch_height: int = 6
    chunk_size: int = 64

    def __post_init__(self):
        if self.chunk_size != 2**self.sketch_height:
            raise ValueError("chunk_size must be 2 ** sketch_height")
        for name, most in (("n_parts", 255), ("dimensions", 255), ("sketch_height", 62), ("leaf_size", 65535), ("chunk_size", 65535)):
            if not 1 <= getattr(self, name) <= most:
                raise ValueError(f"{name} must be from 1 to {most}")

    @classmethod
    def load(cls, path: str) -> Config:
        """Read ``key=value`` lines; # starts a comment, unknown keys are passed over, no file means defaults."""
        kinds, got = {f.name: type(f.default) for f in fields(cls)}, {}
        try:
            with open(path) as f:
                lines = f.read().splitlines()
        except FileNotFoundError:
            return cls()
        for line in lines:
            key, mark, value = line.partition("#")[0].partition("=")
            if mark and key.strip() in NAMES:
                name = NAMES[key.strip()]
                got[name] = kinds[name](float(value.strip()))
        return replace(cls(), **got)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(str(v) for v in asdict(self).values())], list(asdict(self)))
