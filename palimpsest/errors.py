"""Errors of the store: five codes, shown as ``Code: message``."""

from __future__ import annotations


class StoreError(Exception):
    code = "StoreError"

    def __init__(self, message: str = ""):
        super().__init__(message)
        self.message = message

    def __str__(self) -> str:
        return f"{self.code}: {self.message}"


class NotFound(StoreError):
    code = "NotFound"


class Corruption(StoreError):
    code = "Corruption"


class NotSupported(StoreError):
    code = "NotSupported"


class InvalidArgument(StoreError):
    code = "InvalidArgument"


class StoreIOError(StoreError):
    code = "IOError"


def from_os_error(target: str, error: OSError) -> StoreError:
    """An operating system error as one of ours, ``target: message``."""
    kind = NotFound if isinstance(error, FileNotFoundError) else StoreIOError
    return kind(f"{target}: {error.strerror or error}")
