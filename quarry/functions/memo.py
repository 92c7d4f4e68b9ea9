"""Answers kept on the driver: the least recently used goes first."""

from __future__ import annotations

from collections import OrderedDict
from typing import Any


class Memo:
    def __init__(self, most: int = 256):
        self.most, self._kept = most, OrderedDict()

    def get(self, key: str, default: Any = None) -> Any:
        if key in self._kept:
            self._kept.move_to_end(key)
        return self._kept.get(key, default)

    def put(self, key: str, value: Any) -> None:
        self._kept[key] = value
        self._kept.move_to_end(key)
        while len(self._kept) > self.most:
            self._kept.popitem(last=False)

    def invalidate(self, key: str) -> None:
        self._kept.pop(key, None)

    def clear(self) -> None:
        self._kept.clear()

    def __len__(self) -> int:
        return len(self._kept)

    def __contains__(self, key: str) -> bool:
        return key in self._kept
