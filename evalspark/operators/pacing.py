"""Waiting in scoring jobs: growing pauses between attempts, and a provider's budget of calls and
tokens that all tasks of a job share.

Tasks cannot talk to each other, so the budget is shared by the clock: time is cut into slots of
one call each, and slot k belongs to lane ``k mod lanes``, a lane being one task.  Whatever
the number of tasks, no two calls of a job start in the same slot.  Clocks of the machines must
agree to within a quarter of a slot."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass


class Refused(RuntimeError):
    """A provider's refusal; ``retry_after`` is the wait that it asks for, in seconds."""

    def __init__(self, message: str = "refused", retry_after: float = 0.0):
        super().__init__(message)
        self.retry_after = retry_after


@dataclass(frozen=True)
class Retry:
    """After attempt k a prompt waits ``k * wait_s`` seconds, or what the refusal asks for if
    that is longer.  Errors that ``retryable`` denies end the attempts."""

    wait_s: float = 0.1
    retryable: Callable[[Exception], bool] | None = None

    def again(self, error: Exception) -> bool:
        return self.retryable is None or self.retryable(error)

    def pause(self, attempt: int, error: Exception) -> float:
        return max(attempt * self.wait_s, getattr(error, "retry_after", None) or 0.0)


#: Attempts that follow each other at once.
AT_ONCE = Retry(wait_s=0.0)


def rough_tokens(prompt: str) -> int:
    """Four letters a token, the usual rule of thumb."""
    return len(prompt) // 4 + 1


@dataclass(frozen=True)
class RateLimit:
    """What one provider allows all tasks together: calls a second, and tokens a second if set."""

    calls_per_s: float
    tokens_per_s: float | None = None
    tokens_of: Callable[[str], int] = rough_tokens

    def __post_init__(self):
        if self.calls_per_s <= 0 or (self.tokens_per_s is not None and self.tokens_per_s <= 0):
            raise ValueError("rates must be above zero")


class Turns:
    """The turns of one lane.  A call starts in the first quarter of a slot of its lane, one call a
    slot; a lane spends its equal share of the tokens, so a long prompt makes it sit out turns."""

    def __init__(self, limit: RateLimit, lane: int, lanes: int, clock: Callable[[], float] = time.time,
                 sleep: Callable[[float], None] = time.sleep):
        self.limit, self.lane, self.lanes, self.clock, self.sleep = limit, lane % lanes, lanes, clock, sleep
        self.slot_s = 1.0 / limit.calls_per_s
        self.last, self.free_at = -1, 0.0

    def _next(self, now: float) -> int:
        """The first slot of this lane that has not begun by more than a quarter."""
        first = max(math.ceil(now / self.slot_s - 0.25), self.last + 1)
        return first + (self.lane - first) % self.lanes

    def take(self, prompts: list[str]) -> float:
        """Wait for a turn that may send ``prompts``; the seconds waited."""
        began = self.clock()
        while True:
            now = self.clock()
            slot = self._next(max(now, self.free_at))
            if (start := slot * self.slot_s) <= now:
                break
            self.sleep(start - now)
        self.last = slot
        if self.limit.tokens_per_s:
            share = self.limit.tokens_per_s / self.lanes
            self.free_at = now + sum(map(self.limit.tokens_of, prompts)) / share
        return now - began
