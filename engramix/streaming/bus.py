"""Events of a running engine, handed to listeners beside the caller's work."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

# Kinds of events.
KINDS = ["chunk.created", "chunk.deleted", "kg.entity.created", "kg.relation.created", "search.executed", "provider.call", "op_audit.started", "op_audit.completed", "health.warning"]
#: Listeners of a kind, at most.
LISTENERS = 50


class Bus:
    """emit() returns before any listener runs; listeners run in order on one thread of the bus's own. A listener that fails is
    counted and doesn't disturb the others."""

    def __init__(self) -> None:
        self._listeners: dict[str, list[Callable[[dict], None]]] = {k: [] for k in KINDS}
        self._thread = ThreadPoolExecutor(1, thread_name_prefix="bus")
        self.failures: Counter[str] = Counter()

    def subscribe(self, kind: str, listener: Callable[[dict], None]) -> Callable[[], None]:
        """Returns what ends the subscription."""
        own = self._listeners[kind]
        if len(own) >= LISTENERS:
            raise ValueError(f"{kind} has {LISTENERS} listeners already")
        own.append(listener)
        return lambda: own.remove(listener) if listener in own else None

    def emit(self, kind: str, event: dict) -> None:
        for listener in list(self._listeners[kind]):
            self._thread.submit(self._run, kind, listener, event)

    def _run(self, kind: str, listener: Callable[[dict], None], event: dict) -> None:
        try:
            listener(event)
        except Exception:  # a listener's own fault
            self.failures[kind] += 1

    def stats(self) -> dict[str, int]:
        return {k: len(own) for k, own in self._listeners.items() if own}

    def drain(self) -> None:
        """Waits until all that was emitted is handed over."""
        self._thread.submit(lambda: None).result()

    def close(self) -> None:
        self._thread.shutdown()
