"""Versioned frames: integer versions per symbol, read as of any of them; unchanged states make no version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.mart import state_hash
from weftline.sources import files


class VersionStore:
    """Frames under ``path``, one Parquet folder per version; a version exists once its manifest is committed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self, symbol: str) -> list[dict]:
        """Manifests of a symbol, oldest first."""
        folder = f"{self.path}/{symbol}/_versions"
        return [files.read_json(self.spark, f"{folder}/{n}") for n in files.list_names(self.spark, folder) if n.endswith(".json")]

    def write(self, symbol: str, df: DataFrame, metadata: dict | None = None) -> int:
        """Write a new version (0 first) and return its number.  A frame without columns is an error."""
        if not df.columns:
            raise ValueError("a frame needs columns")
        held = self.versions(symbol)
        number = len(held)
        df.write.parquet(f"{self.path}/{symbol}/v{number:06d}")
        entry = {"version": number, "supersedes": number - 1 if number else None, "metadata": metadata or {}}
        files.commit_json(self.spark, f"{self.path}/{symbol}/_versions/{number:06d}.json", entry)
        return number

    def read(self, symbol: str, as_of: int | None = None) -> DataFrame:
        """The latest version, or that of number ``as_of``; KeyError if there is none."""
        held = self.versions(symbol)
        number = len(held) - 1 if as_of is None else as_of
        if not 0 <= number < len(held):
            raise KeyError(f"{symbol} has no version {as_of}")
        return self.spark.read.parquet(f"{self.path}/{symbol}/v{number:06d}")

    def snapshot(self, symbol: str, df: DataFrame, key: str) -> tuple[int, bool]:
        """(version, whether it is new): an unchanged state gives the existing version."""
        digest = state_hash(df, key, [c for c in df.columns if c != key]).select(F.coalesce("state_hash", F.lit(""))).first()[0]
        held = self.versions(symbol)
        if held and held[-1]["metadata"].get("state_hash") == digest:
            return held[-1]["version"], False
        return self.write(symbol, df, {"state_hash": digest}), True
