"""Objects that a Python worker keeps from task to task.

Functions of this package travel to the workers by value, and module variables with them, so what is worth keeping stands in
a module of its own that only lives in the worker.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any


def kept(name: str, make: Callable[[], Any]) -> Any:
    """The object of this name. Its first word names what it belongs to: an object of another kind lets go of all others, so that
    the operators that a reused worker serves one after the other don't add up."""
    shelf = sys.modules.setdefault("quadrat_kept", types.ModuleType("quadrat_kept"))
    if not hasattr(shelf, name):
        kind = name.split(" ")[0]
        for other in [k for k in vars(shelf) if not k.startswith("__") and k.split(" ")[0] != kind]:
            delattr(shelf, other)
        setattr(shelf, name, make())
    return getattr(shelf, name)
