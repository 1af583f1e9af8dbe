"""Client policy for model calls inside a task (F45, C1, C2, V14): bounded concurrency that adapts, retries with full jitter, a call budget.

The policy lives with the model that ``models.call`` loads once a task; a cluster's total is tasks times the limit.
"""

from __future__ import annotations

import email.utils
import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

ATTEMPTS, BASE, CAP, COOLDOWN, WINDOW = 3, 0.5, 8.0, 1.0, 10


class Throttled(Exception):
    """The provider refused a call for now; retry_after is its header, seconds or an HTTP date."""

    def __init__(self, retry_after: str | None = None):
        super().__init__("throttled")
        self.retry_after = retry_after


class BudgetSpent(Exception):
    pass


def wait_asked(header: str | None, now: float) -> float:
    """Seconds that a Retry-After header asks for; 0 if it says nothing readable."""
    if not header:
        return 0.0
    try:
        return max(0.0, float(header))
    except ValueError:
        pass
    try:
        return max(0.0, email.utils.parsedate_to_datetime(header).timestamp() - now)
    except (TypeError, ValueError):
        return 0.0


def backoff(attempt: int, asked: float = 0.0, draw: Callable[[], float] = random.random) -> float:
    """Full jitter below a doubling cap, never less than asked."""
    return max(asked, draw() * min(CAP, BASE * 2**attempt))


@dataclass
class Limiter:
    """Concurrency limit: halved (at least 1) on a refusal, with a cooldown; one more after a window of successes, up to the most."""

    most: int
    clock: Callable[[], float] = time.monotonic
    limit: int = field(init=False)
    good: int = 0
    blocked_until: float = 0.0
    counters: dict = field(default_factory=lambda: {"calls": 0, "retries": 0, "throttled": 0})

    def __post_init__(self):
        self.limit = self.most

    def refused(self) -> None:
        self.counters["throttled"] += 1
        self.limit, self.good, self.blocked_until = max(1, self.limit // 2), 0, self.clock() + COOLDOWN

    def succeeded(self) -> None:
        self.good += 1
        if self.good >= WINDOW and self.limit < self.most:
            self.limit, self.good = self.limit + 1, 0

    def delay(self) -> float:
        return max(0.0, self.blocked_until - self.clock())


def call_with_policy(f: Callable[[], object], limiter: Limiter, budget: list[int] | None = None, sleep: Callable[[float], None] = time.sleep, draw: Callable[[], float] = random.random):
    """f's result under the limiter, the retries and the budget (a one-item list of calls left)."""
    for attempt in range(ATTEMPTS):
        if budget is not None:
            if budget[0] <= 0:
                raise BudgetSpent("no calls left")
            budget[0] -= 1
        if (wait := limiter.delay()) > 0:
            sleep(wait)
        limiter.counters["calls"] += 1
        try:
            got = f()
        except Throttled as e:
            limiter.refused()
            if attempt == ATTEMPTS - 1:
                raise
            limiter.counters["retries"] += 1
            sleep(backoff(attempt, wait_asked(e.retry_after, time.time()), draw))
            continue
        limiter.succeeded()
        return got
