"""Messages on standard error, and the exit code that follows from them."""

from __future__ import annotations

import sys
from typing import TextIO


class Reporter:
    """warn() makes the exit code 1; info and debug appear from one and two -v on."""

    def __init__(self, out: TextIO | None = None, verbosity: int = 0):
        self.out, self.verbosity, self.warnings = out or sys.stderr, verbosity, 0
        self.counts: dict[str, int | None] = {"parsed": None, "groups": None, "streets": None}

    def progress(self, text: str) -> None:
        print(text, file=self.out)

    def warn(self, text: str) -> None:
        self.warnings += 1
        self.progress(f"warning: {text}")

    def info(self, text: str) -> None:
        if self.verbosity > 0:
            self.progress(f"info: {text}")

    def debug(self, text: str) -> None:
        if self.verbosity > 1:
            self.progress(f"debug: {text}")

    def set_counts(self, **counts: int | None) -> None:
        self.counts |= {k: v for k, v in counts.items() if v is not None}

    def summary(self) -> None:
        self.progress("summary: " + " ".join(f"{k}={'n/a' if v is None else v}" for k, v in self.counts.items()))
        if self.warnings:
            self.progress(f"warnings: {self.warnings}")

    @property
    def exit_code(self) -> int:
        return int(self.warnings > 0)
