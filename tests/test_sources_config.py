"""Settings."""

import pytest

from sparkscreen.sources.config import ConfigError, bounded, merged

BASE = {"cache": {"ttl": 3, "names": ["a"]}, "search": {"depth": 5}, "mode": "fast"}
KNOWN = {"cache", "cache.ttl", "cache.names", "search", "search.depth", "mode"}


def test_overlay():
    out, told = merged(BASE, {"cache": {"ttl": 9}, "mode": "slow"}, KNOWN)
    assert out == {"cache": {"ttl": 9, "names": ["a"]}, "search": {"depth": 5}, "mode": "slow"} and told == ("cache.ttl", "mode")
    assert BASE["cache"]["ttl"] == 3
    assert merged(BASE, {}, KNOWN) == (BASE, ()) and merged(BASE, {"cache": {}}, KNOWN) == (BASE, ())


@pytest.mark.parametrize("overlay,reason", [({"zzz": 1}, "overlay_unknown_key"), ({1: 1}, "overlay_unknown_key"), ({"cache": {"zzz": 1}}, "overlay_unknown_key"), ({"cache": 1}, "overlay_shape_mismatch"), ({"cache": {"names": 1}}, "overlay_shape_mismatch"), ({"mode": {"a": 1}}, "overlay_shape_mismatch"), ({"search": {"depth": [1]}}, "overlay_shape_mismatch")])
def test_overlay_refusals(overlay, reason):
    with pytest.raises(ConfigError) as e:
        merged(BASE, overlay, KNOWN)
    assert e.value.reason == reason


def test_bounds():
    assert bounded({}, "n", 3, 1, 5) == 3 and bounded({"x": 2}, "x", 0.5, 0, 2) == 2.0 and bounded({"b": False}, "b", True) is False
    for config, default in (({"n": True}, 3), ({"n": 9}, 3), ({"n": "3"}, 3), ({"n": 0}, 3), ({"n": "yes"}, True), ({"n": 10**400}, 0.5)):
        with pytest.raises(ConfigError):
            bounded(config, "n", default, 1, 5)
