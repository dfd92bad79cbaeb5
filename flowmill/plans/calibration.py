"""Measured throughput, kept as a moving average for each pair of drivers and used by estimates."""

from __future__ import annotations

import json
import os

WEIGHT = 0.3


class Calibration:
    def __init__(self, path: str):
        self.path = path
        self.rates: dict[str, float] = {}
        if os.path.exists(path):
            with open(path) as f:
                self.rates = json.load(f)

    def observe(self, source: str, target: str, rows: int, seconds: float) -> None:
        """Runs without rows or time say nothing."""
        if rows <= 0 or seconds <= 0:
            return
        key, rate = f"{source}->{target}", rows / seconds
        self.rates[key] = rate if key not in self.rates else WEIGHT * rate + (1 - WEIGHT) * self.rates[key]
        with open(f"{self.path}.new", "w") as f:
            json.dump(self.rates, f)
        os.replace(f"{self.path}.new", self.path)

    def rate(self, source: str, target: str, default: float) -> float:
        return self.rates.get(f"{source}->{target}", default)
