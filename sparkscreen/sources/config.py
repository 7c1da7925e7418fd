"""Settings: an overlay merged into a base leaf by leaf, and values within bounds.

A refusal is a ``ConfigError`` whose text names the reason and at most a key of plain characters, never a value.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Collection
from typing import Any

PLAIN_KEY = re.compile(r"[A-Za-z0-9_.\-]{1,64}")


class ConfigError(ValueError):
    def __init__(self, reason: str, key: object = None):
        self.reason = reason
        named = key if isinstance(key, str) and PLAIN_KEY.fullmatch(key) else None
        super().__init__(f"{reason}: {named}" if named else reason)


def _shape(value: Any) -> str:
    return "block" if isinstance(value, dict) else "list" if isinstance(value, list) else "leaf"


def merged(base: dict[str, Any], overlay: dict[str, Any], known: Collection[str]) -> tuple[dict[str, Any], tuple[str, ...]]:
    """Base and overlay as one mapping, the overlay's leaves winning, and the dotted keys that it sets.

    ``known``: dotted names of leaves and plain names of the top level.  Unknown keys, and values of another shape than
    the base has, are refused; neither input is changed.
    """
    out, told = copy.deepcopy(base), []
    blocks = {k.partition(".")[0] for k in known if "." in k}
    tops = {k for k in known if "." not in k}
    for top, value in sorted(overlay.items(), key=lambda kv: str(kv[0])):
        if top not in tops:
            raise ConfigError("overlay_unknown_key", top)
        if (top in blocks) != isinstance(value, dict):
            raise ConfigError("overlay_shape_mismatch", top)
        for name, leaf in sorted(({f"{top}.{k}": v for k, v in value.items()} if top in blocks else {top: value}).items()):
            if name not in known:
                raise ConfigError("overlay_unknown_key", name)
            place = out.setdefault(top, {}) if top in blocks else out
            key = name.partition(".")[2] or top
            if isinstance(leaf, dict) or place.get(key) is not None and _shape(place[key]) != _shape(leaf):
                raise ConfigError("overlay_shape_mismatch", name)
            place[key] = copy.deepcopy(leaf)
            told.append(name)
    return out, tuple(sorted(told))


def bounded(config: dict[str, Any], key: str, default: Any, least: float | None = None, most: float | None = None) -> Any:
    """A setting of the default's type within its bounds; truth values are no numbers, and whole numbers are numbers."""
    value, wanted = config.get(key, default), type(default)
    fits = isinstance(value, bool) if wanted is bool else not isinstance(value, bool) and isinstance(value, (int, float) if wanted is float else wanted)
    if not fits:
        raise ConfigError("type", key)
    if least is not None and not least <= value or most is not None and not value <= most:
        raise ConfigError("bounds", key)
    return wanted(value)
