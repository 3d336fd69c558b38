"""From events to findings: the chosen detectors, then the allowlist."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from palisade.operators.accounts import auth_success, priv_esc
from palisade.operators.allow import split_allowlist
from palisade.operators.detection import Detection
from palisade.operators.sources_of_attack import brute_force, enumeration, password_spray
from palisade.params import Params

Detector = Callable[[DataFrame, Params], Detection]

# in the order in which their findings are listed
DETECTORS: dict[str, Detector] = {
    "brute_force": brute_force,
    "password_spray": password_spray,
    "enumeration": enumeration,
    "priv_esc": priv_esc,
    "auth_success": auth_success,
}


def detect(
    events: DataFrame, params: Params = Params(), rules: Sequence[str] | None = None,
    detectors: dict[str, Detector] | None = None,
) -> Detection:
    """Findings and evidence of the chosen detectors (all by default), without
    those the allowlist suppresses.  Additional detectors are functions from
    events and parameters to a Detection.

    Every detector scans the events again: give it a stored table, not the
    parse of raw lines."""
    available = {**DETECTORS, **(detectors or {})}
    chosen = [n for n in available if rules is None or n in rules]
    if not chosen:
        raise ValueError(f"no such detector: {rules}")
    out = available[chosen[0]](events, params)
    for name in chosen[1:]:
        out = out.union(available[name](events, params))
    return allowed_out(out, params)


def allowed_out(found: Detection, params: Params) -> Detection:
    """Apply the allowlist to findings, and to the evidence of those dropped."""
    listed = [params.allowed_ips, params.allowed_users]
    if not any(isinstance(v, DataFrame) or v for v in listed):
        return found
    kept, suppressed = split_allowlist(found.findings, found.evidence, params)
    evidence = found.evidence.join(
        suppressed.select("finding_id"), "finding_id", "left_anti"
    ).select(found.evidence.columns)
    return Detection(kept, evidence)
