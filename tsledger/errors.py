"""Errors of the library.  Each also derives from the builtin that callers would expect."""

from __future__ import annotations


class LedgerError(Exception):
    """Base of all errors of this library."""

    def __str__(self) -> str:  # KeyError would quote the message
        return str(self.args[0]) if self.args else ""


class CorruptedError(LedgerError):
    """A store's files are damaged; ``path`` names the file where that is known."""

    def __init__(self, reason: str, path: str | None = None):
        super().__init__(f"{path}: {reason}" if path else reason)
        self.reason, self.path = reason, path


class NotAStoreError(LedgerError):
    """The folder holds no store."""


class UnsupportedVersionError(LedgerError):
    """The store was written by a later layout."""


class UnsupportedError(LedgerError):
    """A value or conversion that the data model does not have."""


class NotFinalizedError(LedgerError):
    """The store has files of an unfinished commit and strict reading was asked for."""


class LockedError(LedgerError):
    """Another writer has the store."""


class UnknownDeviceError(LedgerError, KeyError):
    def __init__(self, name: str):
        super().__init__(f"no device {name!r}")
        self.name = name


class DeviceExistsError(LedgerError):
    def __init__(self, name: str):
        super().__init__(f"device {name!r} exists")
        self.name = name


class UnknownColumnError(LedgerError, KeyError):
    def __init__(self, device: str, column: str):
        super().__init__(f"device {device!r} has no column {column!r}")
        self.device, self.column = device, column


class TypeMismatchError(LedgerError, TypeError):
    """A value does not fit its column's type."""


class SchemaError(LedgerError, ValueError):
    """A device's schema is not valid."""


class PointNotFoundError(LedgerError, KeyError):
    def __init__(self, device: str, time: int):
        super().__init__(f"device {device!r} has no point at {time}")
        self.device, self.time = device, time


class UnknownAnnotationError(LedgerError, KeyError):
    def __init__(self, number: int):
        super().__init__(f"no annotation {number}")
        self.number = number


class UnknownCommitError(LedgerError, KeyError):
    def __init__(self, number: int):
        super().__init__(f"no commit {number}")
        self.number = number


class InvalidArgumentError(LedgerError, ValueError):
    """An argument outside its range."""


class LimitExceededError(LedgerError, ValueError):
    """A limit of the data model is exceeded."""
