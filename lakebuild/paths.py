"""Layered lake paths (raw / bronze / silver) under one root URI (SC6).

Any Hadoop URI works (``file:``, ``s3a:``, ``abfss:``, ``hdfs:``); credentials
come from the Spark/Hadoop configuration, never from this object.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LakePaths:
    root: str
    engine: str = "spark"
    raw_root: str | None = None  # raw layer kept elsewhere (shared landing zone)

    def _join(self, *parts: str, base: str | None = None) -> str:
        base = (base or self.root).rstrip("/")
        return "/".join([base, *[p.strip("/") for p in parts if p]])

    def raw(self, *parts: str) -> str:
        return self._join("raw", *parts, base=self.raw_root)

    def bronze(self, name: str) -> str:
        return self._join("bronze", self.engine, name)

    def silver(self, name: str) -> str:
        return self._join("silver", self.engine, name)

    def batch(self, n: int, filename: str = "") -> str:
        return self.raw(f"Batch{n}", filename)
