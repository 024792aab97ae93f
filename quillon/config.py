"""Constants of the source material and where its tables lie under one base folder."""

from __future__ import annotations

from typing import NamedTuple

from quillon.operators.bars import PRICES, SESSION_BARS, SESSION_END, SESSION_START
from quillon.sources import REQUIRED, VENDOR

#: Bars carry wall-clock times of this zone.
TIME_ZONE = "Asia/Kolkata"
SPLITS = ("train", "test")
TABLES = ("bars", "features", "regimes", "predictions")


class Layout(NamedTuple):
    """Paths under a base folder, which may be of any file system that Spark reads."""

    base: str

    def raw(self, split: str) -> str:
        return f"{self.base}/raw/{split}.csv"

    def table(self, name: str) -> str:
        """Folder of a table that is partitioned by split: bars, features, regimes, predictions."""
        return f"{self.base}/tables/{name}"

    def model(self, name: str) -> str:
        return f"{self.base}/models/{name}"

    def report(self, name: str) -> str:
        return f"{self.base}/reports/{name}.md"


__all__ = ["PRICES", "REQUIRED", "SESSION_BARS", "SESSION_END", "SESSION_START", "SPLITS", "TABLES", "TIME_ZONE", "VENDOR", "Layout"]
