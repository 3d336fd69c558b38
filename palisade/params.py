"""Parameters of the detectors and reports."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from palisade import fixed_values as fixed

ALL_NAMES = 2_147_483_647


@dataclass(frozen=True)
class Params:
    brute_force_threshold: int = fixed.BRUTE_FORCE_THRESHOLD
    brute_force_window_sec: int = fixed.BRUTE_FORCE_WINDOW_SEC
    spray_threshold: int = fixed.SPRAY_THRESHOLD
    spray_window_sec: int = fixed.SPRAY_WINDOW_SEC
    enumeration_threshold: int = fixed.ENUMERATION_THRESHOLD
    failed_sudo_threshold: int = fixed.FAILED_SUDO_THRESHOLD
    correlation_window_sec: int = fixed.CORRELATION_WINDOW_SEC
    # a tuple of values, or a DataFrame with one string column for long lists
    allowed_ips: object = ()
    allowed_users: object = ()
    # privilege findings are global by default; name columns to split them
    priv_esc_per: tuple[str, ...] = ()
    # length of the sorted name arrays of a finding row: all names by default.  A
    # smaller number makes them previews; the exact counts stand beside them, and
    # the members relation has every name
    names_kept: int = ALL_NAMES
    # length of a time slice: the unit by which a busy source is split
    slice_sec: int = 60

    @classmethod
    def from_mapping(cls, values: Mapping[str, object]) -> "Params":
        """Build from a configuration mapping; unknown keys are ignored and an
        empty entry (None) means the default."""
        known = {f.name for f in fields(cls)}
        picked = {k: v for k, v in values.items() if k in known and v is not None}
        for name in ("allowed_ips", "allowed_users", "priv_esc_per"):
            if isinstance(picked.get(name), (list, set)):
                picked[name] = tuple(picked[name])
        return cls(**picked)
