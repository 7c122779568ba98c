"""Bounded maps that a worker keeps from task to task."""

from __future__ import annotations

import ctypes
import weakref
from sys import getsizeof as _size

import pyarrow as pa

#: Bytes that the maps of one operator may hold in one worker, keys, values and table together.
BUDGET = 48 << 20
#: Longer keys are computed each time and not kept.
LONGEST = 256
#: A slot of a dictionary and its share of the free ones.
SLOT = 104

_MAPS: weakref.WeakSet[Kept] = weakref.WeakSet()
_HELD: dict[tuple, object] = {}
#: Gives freed memory back to the system, where the C library can.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def enter(owner: str) -> None:
    """Called when a task of any operator begins: what other operators have kept
    in this worker goes, so its memory is that of one operator; what earlier tasks
    have freed goes back to the system."""
    for key in [k for k in _HELD if k[0] != owner]:
        del _HELD[key]
    for kept in list(_MAPS):
        if kept.owner != owner:
            kept.clear()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def held(owner: str, name, make):
    """What ``make`` gives, kept in this worker until a task of another operator begins."""
    if (owner, name) not in _HELD:
        _HELD[owner, name] = make()
    return _HELD[owner, name]


class Kept:
    """A map from a string to what ``make`` gives for it, bounded in bytes.

    Two generations: when the newer has used half of the budget it becomes the
    older one, whose entries go unless they are asked for again. ``new`` is the
    newer one; indexing it fills what is missing.
    """

    def __init__(self, make, owner: str, budget: int = BUDGET):
        self.make, self.owner, self.half = make, owner, budget // 2
        outer = self

        class Generation(dict):
            __slots__ = ()

            def __missing__(self, key):
                return outer.fetch(key)

        self._generation = Generation
        self.clear()
        _MAPS.add(self)

    def clear(self) -> None:
        self.new, self.old, self.used = self._generation(), {}, 0

    def fetch(self, key: str):
        # a caller may still index a generation that has been replaced
        value = self.new.get(key)
        if value is not None:
            return value
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > LONGEST:
            return value
        self.used += _size(key) + _size(value) + SLOT
        if self.used > self.half:
            self.new, self.old, self.used = self._generation(), self.new, 0
        self.new[key] = value
        return value
