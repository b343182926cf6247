"""What can go wrong, with the numeric status of each kind."""

from __future__ import annotations


class StrataError(Exception):
    """Any failure of this library."""

    status = 1


class InvalidBlock(StrataError):
    status = 2


class InvalidData(StrataError):
    status = 3


class FileSeekError(StrataError):
    status = 4


class DecodeError(InvalidData):
    """A program's assertion failed, or it ran out of its budget of steps."""

    status = 5


def status_message(status: int) -> str:
    """The kind of error that a status stands for."""
    kinds = {c.status: c.__name__ for c in (StrataError, InvalidBlock, InvalidData, FileSeekError, DecodeError)}
    return {0: "Ok"}.get(status) or kinds.get(status, "Unknown")
