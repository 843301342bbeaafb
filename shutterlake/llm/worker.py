"""What a Python worker keeps between its tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable
from typing import Any

_NAME = "_held_between_tasks"


def held(kind: str, key: Hashable, make: Callable[[], Any]) -> Any:
    """One object of each kind, made again when the key differs.

    Task code is pickled by value, so its globals are new in every task. The
    process's table of modules is not.
    """
    kept = sys.modules.setdefault(_NAME, types.ModuleType(_NAME)).__dict__
    if kept.get(kind, (None,))[0] != key:
        kept[kind] = key, make()
    return kept[kind][1]
