"""Objects built once per Python worker."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

_built: dict[Hashable, Any] = {}


def built(factory: Callable[[], Any]) -> Any:
    """The object of ``factory``, built at the first call in this worker.

    Factories that compare equal share one object, so a frozen dataclass is a
    good factory: it is sent with every task but builds its model once.
    """
    if factory not in _built:
        _built[factory] = factory()
    return _built[factory]
