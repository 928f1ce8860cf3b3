"""Release documents from small summaries: canonical JSON, one record CSV, manifest, candidate bundle, verification."""

from __future__ import annotations

import hashlib
import json
import math
import os
import subprocess
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of the record file, in order.
RECORD_COLUMNS = ["record_type", "model_id", "season", "metric", "outcome", "bin", "lower", "upper", "n", "week_count", "brier", "log_loss", "rps", "hit_rate", "ece", "macro_ece", "rank", "history_rank", "confidence", "accuracy", "gap", "point", "low", "high", "reference", "replicates", "start_date", "end_date"]


def rounded(value: float | None, digits: int = 10) -> float | None:
    """Half-even on the exact value; refuses what is not finite."""
    if value is None:
        return None
    if not math.isfinite(value):
        raise ValueError("a published number must be finite")
    return round(float(value), digits)


def canonical_json(value: object) -> bytes:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def file_sha256(path: str | Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            digest.update(part)
    return digest.hexdigest()


def record_union(parts: dict[str, DataFrame]) -> DataFrame:
    """All record types as one table of text columns; what a type lacks stays null."""
    out = None
    for kind, df in parts.items():
        have = df.withColumn("record_type", F.lit(kind))
        rows = have.select(*(F.col(c).cast("string").alias(c) for c in RECORD_COLUMNS if c in have.columns))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.select(*(F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in RECORD_COLUMNS))


def csv_text(value: object) -> str:
    text = "" if value is None else str(value)
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\r\n') else text


def record_csv(records: DataFrame) -> bytes:
    """The records (a few hundred aggregates) as RFC 4180 bytes."""
    rows = records.orderBy("record_type", "model_id", "season", "metric", "outcome", F.col("bin").cast("int")).collect()
    return "".join(",".join(map(csv_text, line)) + "\n" for line in [RECORD_COLUMNS, *rows]).encode()


def revision_id(root: str | Path = ".") -> str:
    """The revision that a build runs from: GITHUB_SHA, or else git's head; an error if neither is known."""
    named = os.environ.get("GITHUB_SHA", "").strip()
    if named:
        return named
    found = subprocess.run(["git", "-C", str(root), "rev-parse", "HEAD"], capture_output=True, text=True)
    if found.returncode or not found.stdout.strip():
        raise RuntimeError("no revision is known")
    return found.stdout.strip()


def write_release(directory: str | Path, document: dict, records: DataFrame, pins: list[dict], version: str, code: tuple[str | Path, ...] = (), revision: str | None = None) -> dict:
    """Writes release.json, release.csv and manifest.json, and returns the manifest; ``code`` are files whose digests it pins as well, ``revision`` is that of :func:`revision_id`."""
    home = Path(directory)
    home.mkdir(parents=True, exist_ok=True)
    files = {"release.json": canonical_json(document), "release.csv": record_csv(records)}
    for name, data in files.items():
        (home / name).write_bytes(data)
    manifest = {"version": version, "artifacts": [{"path": n, "bytes": len(d), "sha256": sha256(d)} for n, d in files.items()], "sourceInputs": pins, "revision": revision, "code": [{"path": str(c), "sha256": file_sha256(c)} for c in code]}
    (home / "manifest.json").write_bytes(canonical_json(manifest))
    return manifest


def release_faults(directory: str | Path) -> list[str]:
    """What does not agree with the manifest; empty if the release is as it was written."""
    home = Path(directory)
    faults = []
    manifest = json.loads((home / "manifest.json").read_bytes())
    if canonical_json(manifest) != (home / "manifest.json").read_bytes():
        faults.append("manifest.json is not canonical")
    for a in manifest["artifacts"]:
        path = home / a["path"]
        if not path.exists() or path.stat().st_size != a["bytes"] or file_sha256(path) != a["sha256"]:
            faults.append(f"{a['path']} differs from its pin")
    for c in manifest.get("code", []):
        if not Path(c["path"]).exists() or file_sha256(c["path"]) != c["sha256"]:
            faults.append(f"{c['path']} is not the code that made the release")
    return faults


def document_faults(document: dict, version: str, matches: int, weeks: int, systems: int) -> list[str]:
    """What in a release's document breaks its contract: version, counts, one key set for all systems, and the claims that it must not make."""
    evaluation, board = document.get("evaluation", {}), document.get("leaderboard", [])
    checks = [
        ("version", document.get("version") == version),
        ("matches", evaluation.get("matches") == matches),
        ("weeks", evaluation.get("weeks") == weeks),
        ("full coverage", evaluation.get("fullCoverage") is True),
        ("leaderboard length", len(board) == systems),
        ("matches of each system", all(row.get("n") == matches for row in board)),
        ("key set of each system", {row.get("keySetSha256") for row in board} == {evaluation.get("keySetSha256")}),
        ("activation must be off", document.get("activationEligible") is False),
        ("raw rows must not be included", document.get("rawRowsIncluded") is False),
    ]
    return [name for name, good in checks if not good]


def write_report(directory: str | Path, report: dict) -> Path:
    path = Path(directory) / "backtest.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(report, indent=2, sort_keys=True) + "\n")
    return path


def write_candidate(directory: str | Path, report: dict, parameters: dict, version: str) -> Path | None:
    """A zip of report and model parameters with a pointer to it, or None unless the report's gate has passed."""
    if not report.get("gate", {}).get("passed"):
        return None
    home = Path(directory) / version
    home.mkdir(parents=True, exist_ok=False)
    parts = {"report.json": canonical_json(report), "parameters.json": canonical_json(parameters)}
    parts["metadata.json"] = canonical_json({"version": version, "sha256": {n: sha256(d) for n, d in parts.items()}})
    path = home / "candidate.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    (Path(directory) / "latest-candidate.json").write_bytes(canonical_json({"version": version, "path": f"{version}/candidate.zip", "sha256": file_sha256(path)}))
    return path
