"""Manifests of built artefacts and the checks that read them."""
from __future__ import annotations

import hashlib
import json
import subprocess
from dataclasses import asdict
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..conf import EngineConf


def settings_hash(conf: EngineConf) -> str:
    """A35."""
    return hashlib.sha256(json.dumps(asdict(conf), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def artefact_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length, sha256`` of the files below a folder, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def table_hash(df: DataFrame) -> DataFrame:
    """One row ``n, digest``: a hash of a table's rows that does not depend on their order."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])), 256)
    part = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(part).alias("digest"))


def git_commit(folder: str = ".") -> str:
    try:
        return subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def base(conf: EngineConf, folder: str = ".") -> dict:
    """G15."""
    return {"schema_version": 1, "generated_at_utc": datetime.now(timezone.utc).isoformat(), "git_commit": git_commit(folder), "config_hash": settings_hash(conf), "stages": {}, "artifact_hashes": {}}


def load(path: str) -> dict | None:
    p = Path(path)
    return json.loads(p.read_text()) if p.exists() else None


def update(path: str, stage: str, payload: dict, hashes: dict[str, str], conf: EngineConf) -> dict:
    """The manifest with a stage's payload and the hashes of its artefacts."""
    manifest = load(path) or base(conf)
    manifest["stages"][stage] = payload
    manifest["artifact_hashes"].update(hashes)
    manifest.update(generated_at_utc=datetime.now(timezone.utc).isoformat(), config_hash=settings_hash(conf))
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(manifest, indent=2, sort_keys=True, ensure_ascii=False))
    return manifest


def incompatibilities(manifest: dict | None, *, model: str | None = None, dim: int | None = None, tokenizer: str | None = None) -> list[str]:
    """How a manifest differs from what a retriever expects; a missing manifest or field is none."""
    stages = (manifest or {}).get("stages", {})
    wanted = [("embed", "model_name", model), ("embed", "dim", dim), ("bm25", "tokenizer", tokenizer)]
    found = []
    for stage, key, expected in wanted:
        actual = stages.get(stage, {}).get(key)
        if expected is not None and actual is not None and actual != expected:
            found.append(f"{stage}.{key} is {actual!r}, expected {expected!r}")
    return found


def drifted(manifest: dict | None, conf: EngineConf) -> bool:
    """P28."""
    return bool(manifest) and manifest.get("config_hash") != settings_hash(conf)
