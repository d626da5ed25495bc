"""Checks of options before anything runs, and small settings files."""

from __future__ import annotations

import json
import os

from .sources.blobs import local_path, put_file

MODES, SNAPSHOTTERS = ("file", "block"), ("auto", "none", "lvm", "btrfs", "zfs")


def backup_options(mode: str = "file", snapshot: str = "auto", device: str | None = None, source: str | None = None, force: bool = False) -> dict:
    """The options with defaults, or ValueError: a block backup needs a device and takes no folder, a file backup the reverse."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if snapshot not in SNAPSHOTTERS:
        raise ValueError(f"snapshot is one of {', '.join(SNAPSHOTTERS)}")
    if mode == "block" and (not device or source):
        raise ValueError("a block backup takes a device and no folder")
    if mode == "file" and (device or not source):
        raise ValueError("a file backup takes a folder and no device")
    return {"mode": mode, "snapshot": snapshot, "device": device, "source": source, "force": force}


def included(parts: list[str], skip: list[str]) -> dict[str, bool]:
    """Which parts a capture takes; a part that doesn't exist can't be left out."""
    if unknown := set(skip) - set(parts):
        raise ValueError(f"no such part: {', '.join(sorted(unknown))}")
    return {p: p not in skip for p in parts}


class Settings:
    """Names and texts in a JSON file."""

    def __init__(self, path: str):
        self.path = local_path(path)

    def all(self) -> dict[str, str]:
        if not os.path.exists(self.path):
            return {}
        with open(self.path, encoding="utf-8") as f:
            return dict(sorted(json.load(f).items()))

    def get(self, name: str) -> str | None:
        return self.all().get(name)

    def set(self, name: str, value: str) -> None:
        put_file(self.path, json.dumps(self.all() | {name: value}).encode())
