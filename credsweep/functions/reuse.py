"""Column expressions that every scan of a session shares.

A scan's expressions depend on column names and on its rule and prefix tables
alone, not on the documents, and building them takes thousands of calls to the
JVM.  ``once`` keeps them, so that the second plan of a session, such as that of
each micro-batch of a stream, only has to be analyzed.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

from pyspark import SparkContext

#: Sets of tables whose expressions are kept, the last used ones.
KEPT = 64
_kept: dict[tuple, tuple[Any, Any]] = {}


def once(key: tuple[Hashable, ...], make: Callable[[], Any]) -> Any:
    """What ``make`` builds, from an earlier call with the same ``key`` if the JVM is still the same.

    The key must hold everything that the expressions depend on but column names.
    """
    gateway = SparkContext._gateway
    if gateway is None:
        return make()
    found = _kept.pop(key, None)
    if found is None or found[0] is not gateway:
        found = gateway, make()
    _kept[key] = found
    while len(_kept) > KEPT:
        del _kept[next(iter(_kept))]
    return found[1]
