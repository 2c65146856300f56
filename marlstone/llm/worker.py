"""State that a Python worker keeps from task to task."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """make(), once in a worker's life for each key. Modules that travel by value start anew with each task; this doesn't."""
    home = sys.modules.setdefault("_marlstone_worker", types.ModuleType("_marlstone_worker"))
    store = home.__dict__.setdefault("store", {})
    if key not in store:
        store[key] = make()
    return store[key]
