"""Commands around a backup, with rules for when they apply and a limit on their time; and which snapshot method to take."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Rule:
    """Each part that is given must hold."""

    service: str | None = None
    process: str | None = None
    path: str | None = None

    def holds(self, has_service: Callable[[str], bool], has_process: Callable[[str], bool]) -> bool:
        return (self.service is None or has_service(self.service)) and (self.process is None or has_process(self.process)) and (self.path is None or os.path.exists(self.path))


@dataclass
class Hook:
    name: str
    pre: str | None = None
    post: str | None = None
    rule: Rule = field(default_factory=Rule)
    timeout: float = 60.0


@dataclass
class Outcome:
    hook: str
    phase: str
    success: bool
    stdout: str
    stderr: str
    exit_code: int | None


def run(name: str, phase: str, command: str, timeout: float) -> Outcome:
    try:
        done = subprocess.run(["sh", "-c", command], capture_output=True, text=True, timeout=timeout, check=False)
    except subprocess.TimeoutExpired:
        return Outcome(name, phase, False, "", f"no end after {timeout:g} s", None)
    return Outcome(name, phase, done.returncode == 0, done.stdout, done.stderr, done.returncode)


class HookRunner:
    def __init__(self, hooks: list[Hook], has_service: Callable[[str], bool] = lambda _: False, has_process: Callable[[str], bool] = lambda _: False):
        self.hooks = [h for h in hooks if h.rule.holds(has_service, has_process)]

    def pre(self) -> list[Outcome]:
        """In order, up to the first failure."""
        out: list[Outcome] = []
        for h in self.hooks:
            if h.pre:
                out.append(run(h.name, "pre", h.pre, h.timeout))
                if not out[-1].success:
                    break
        return out

    def post(self) -> list[Outcome]:
        """All of them."""
        return [run(h.name, "post", h.post, h.timeout) for h in self.hooks if h.post]


def pick_snapshotter(choice: str, source: str, supports: dict[str, Callable[[str], bool]]) -> str | None:
    """The method asked for, or, for "auto", the first that supports the source; None takes no snapshot."""
    if choice == "none":
        return None
    if choice != "auto":
        if choice not in supports or not supports[choice](source):
            raise ValueError(f"{choice} does not support {source}")
        return choice
    return next((k for k, test in supports.items() if test(source)), None)
