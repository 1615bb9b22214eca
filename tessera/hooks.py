"""Lifecycle hooks: callbacks before and after create, update and delete of a model's rows."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import Any, Literal

Event = Literal["before_create", "after_create", "before_update", "after_update", "before_delete", "after_delete"]
EVENTS = ("before_create", "after_create", "before_update", "after_update", "before_delete", "after_delete")


class Hooks:
    """A registry. A hook that raises aborts the write; an after-hook runs before the write is published."""

    def __init__(self) -> None:
        self._lock, self._known = threading.Lock(), {}

    def on(self, model: type, event: Event, call: Callable[[Any], None]) -> Callable[[], None]:
        """Registers a hook and returns what removes it again."""
        if event not in EVENTS:
            raise ValueError(f"no event {event!r}")
        entry = (object(), call)
        with self._lock:
            self._known.setdefault((model, event), []).append(entry)

        def off() -> None:
            with self._lock:
                self._known[model, event] = [e for e in self._known[model, event] if e is not entry]

        return off

    def fire(self, model: type, event: Event, target: Any) -> None:
        """Calls the hooks in order; deletes have no target."""
        with self._lock:
            calls = list(self._known.get((model, event), ()))
        for _, call in calls:
            call(target)
