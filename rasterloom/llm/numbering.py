"""Numbers for the pieces of texts, given as they are first seen, and what a worker remembers between tasks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_slot: dict[Hashable, Any] = {}


def remembered(key: Hashable, make: Callable[[], Any]) -> Any:
    """What make() gave for this key. A worker remembers one thing: another key's goes first, so memory doesn't add up."""
    if key not in _slot:
        _slot.clear()
        give_back()
        _slot[key] = make()
    return _slot[key]


def give_back() -> None:
    """Return freed memory to the system; a worker that serves one stage after another otherwise keeps the most of each."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Numbers(dict):
    """Piece to number; an unknown one gets the next number and is noted in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n

    def fresh(self) -> list[str]:
        """Begin a new list of new pieces."""
        self.new = []
        return self.new

    def forget(self, pieces: list[str]) -> None:
        for piece in pieces:
            del self[piece]
