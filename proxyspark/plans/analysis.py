"""Analysis of stored uploads: candidates, evidence links, findings."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxyspark.operators import detectors, findings


@dataclass
class Analysis:
    candidates: DataFrame
    report: DataFrame
    findings: DataFrame
    bridge: DataFrame
    samples: DataFrame
    packets: DataFrame


def analyse(entries: DataFrame, uploads: DataFrame, report: DataFrame | None = None,
            baselines: DataFrame | None = None) -> Analysis:
    """Score every upload at once and turn candidates into findings.

    ``report`` holds external narrative rows (upload_id, candidate_id, severity,
    confidence, explanation, recommendation); without it the deterministic
    report is used. ``baselines`` (upload_id, baseline_json) gives runs measured
    against history their organization's figures. Nothing runs before a part of
    the result is read; write ``candidates`` where several parts are wanted.
    """
    candidates = detectors.detect_all(entries)
    rows = report if report is not None else findings.fallback_findings(candidates)
    found = findings.apply_report(rows, candidates).withColumns({
        "analysis_id": F.col("upload_id"),
        "id": F.left(F.sha2(F.concat_ws("/", "upload_id", "candidate_id"), 256), F.lit(32)),
    })
    bridge = detectors.finding_entries(candidates, entries)
    samples = findings.evidence_rows(bridge, entries)
    packets = findings.evidence_packets(
        candidates, findings.upload_overview(entries), samples, baselines=baselines)
    return Analysis(candidates, findings.fallback_report(candidates, uploads), found, bridge, samples, packets)
