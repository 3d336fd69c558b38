"""The result of a detector, and the ranks that order detectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.schema import EVIDENCE, FINDINGS, conform

# position of each detector's findings among findings of equal time
RANKS = {
    "brute_force": 10, "password_spray": 20, "enumeration": 30,
    "priv_esc": 40, "auth_success": 50,
}
# chains come last, in the order of their rules
CORRELATED_RANK = 100
OTHER_RANK = 80


@dataclass(frozen=True)
class Detection:
    """Findings (one row each) and the events they rest on."""

    findings: DataFrame
    evidence: DataFrame

    def union(self, other: "Detection") -> "Detection":
        return Detection(
            self.findings.unionByName(other.findings),
            self.evidence.unionByName(other.evidence),
        )


def detection(findings: DataFrame, evidence: DataFrame) -> Detection:
    findings = findings.withColumn("is_correlated", F.lit(False)).withColumn(
        "correlated_rules", F.array().cast("array<string>")
    )
    return Detection(conform(findings, FINDINGS), conform(evidence, EVIDENCE))


def metadata(**columns: Column) -> Column:
    """String map of named values; null values stay null."""
    return F.create_map(*[
        x for k, v in columns.items() for x in (F.lit(k), v.cast("string"))
    ])
