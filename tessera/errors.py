"""Failures by kind, with the exit code that a command line gives each."""

from __future__ import annotations

#: Exit codes by kind.
EXIT = {"usage": 2, "data": 3, "io": 5, "internal": 70}


class Fault(Exception):
    """A failure whose kind callers route on; the message is for people."""

    kind = "internal"

    @property
    def message(self) -> str:
        return str(self.args[0]) if self.args else ""


class DataError(Fault, ValueError):
    """The input, or a value asked for, can't be taken."""

    kind = "data"


class IoError(Fault, OSError):
    kind = "io"

    def __init__(self, message: str):
        super().__init__(message)


class InternalError(Fault, RuntimeError):
    """A step broke its own promise."""

    kind = "internal"


class UsageError(Fault, ValueError):
    """A command line that can't be read."""

    kind = "usage"


def exit_code(fault: Fault) -> int:
    return EXIT[fault.kind]
