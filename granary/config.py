"""Policy values: ratified ones carry their grounds, all others refuse to be read."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


class Unratified(ValueError):
    """A policy value was read that nobody has set."""


@dataclass(frozen=True)
class Ratified:
    value: Any
    grounds: str


@dataclass(frozen=True)
class Pending:
    name: str
    owner: str = ""

    @property
    def value(self):
        raise Unratified(f"{self.name} has not been ratified" + (f"; {self.owner} decides" if self.owner else ""))


def read(policy: Ratified | Pending | float | int) -> Any:
    """The value of a policy, before any plan is built with it; plain numbers are their own value."""
    return policy.value if isinstance(policy, Ratified | Pending) else policy
