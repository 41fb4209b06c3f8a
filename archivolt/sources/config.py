"""Key-value settings files and lists of addresses."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from types import SimpleNamespace
from typing import Any

LEAST_DELAY = 2.0
_TRUE, _FALSE = ("true", "1", "yes", "y"), ("false", "0", "no", "n", "")


def lines(path: Path) -> list[str]:
    """Stripped lines of a file that are neither blank nor comments; a missing file has none."""
    text = path.read_text("utf-8-sig") if path.exists() else ""
    return [line for line in map(str.strip, text.splitlines()) if line and line[0] != "#"]


def boolean(value: str) -> bool:
    """true, 1, yes, y; false, 0, no, n and empty, whatever the case; anything else is an error."""
    word = value.strip().lower()
    if word not in _TRUE + _FALSE:
        raise ValueError(f"not a boolean: {value}")
    return word in _TRUE


# The keys of a settings file; with parser and default, None for required ones.
OPTIONS: dict[str, tuple[str, Callable[[str], Any], str | None]] = {
    "cookie": ("COOKIE", str, None),
    "download_images": ("DOWNLOAD_IMAGES", boolean, "false"),
    "request_delay": ("REQUEST_DELAY", float, "2"),
    "max_retry": ("MAX_RETRY", int, "3"),
}


def key_values(path: Path) -> dict[str, str]:
    """KEY=VALUE lines of a file, split at the first sign; other lines are left out, the last of a key wins."""
    return {key.strip(): value.strip() for key, sign, value in (line.partition("=") for line in lines(path)) if sign}


def load(path: Path, prefix: str = "") -> SimpleNamespace:
    """The settings of a file by option name; ``prefix`` stands before the key of the cookie."""
    given, made = key_values(path), SimpleNamespace()
    for option, (key, parse, default) in OPTIONS.items():
        key = prefix + key if default is None else key
        value = given.get(key) or default
        if value is None:
            raise ValueError(f"{key} is required")
        setattr(made, option, parse(value))
    return made


def addresses(path: Path) -> list[str]:
    """The addresses of a list."""
    return lines(path)


def check_delay(delay: float) -> float:
    """Delays under LEAST_DELAY are an error."""
    if delay < LEAST_DELAY:
        raise ValueError(f"delay must be at least {LEAST_DELAY:g} seconds")
    return delay
