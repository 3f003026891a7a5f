"""Events of a run by type, and the times of its stages."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field


@dataclass
class Events:
    """Handlers get the events of exactly the type they asked for, at once and in the order they came."""

    handlers: dict[type, list[Callable]] = field(default_factory=dict)

    def subscribe(self, kind: type, handler: Callable) -> None:
        self.handlers.setdefault(kind, []).append(handler)

    def publish(self, event: object) -> None:
        for handler in self.handlers.get(type(event), ()):
            handler(event)


@dataclass(frozen=True)
class StageDone:
    stage: str
    seconds: float


class Timings:
    """Seconds by stage; line() renders them, the known stages first and in order, the others by name."""

    # Fixed values.
    ORDER = ("process_feeds", "process_sources", "align_episodes", "merge_episodes", "write_outputs", "merge_config_total", "podcast_total")

    def __init__(self, events: Events | None = None):
        self.seconds: dict[str, float] = {}
        self.events = events or Events()

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began
            self.events.publish(StageDone(name, self.seconds[name]))

    def line(self, show: str) -> str:
        names = [n for n in self.ORDER if n in self.seconds] + sorted(self.seconds.keys() - set(self.ORDER))
        return f"TIMING {show}: " + " ".join(f"{n}={self.seconds[n] * 1000:.1f}ms" for n in names) if names else ""
