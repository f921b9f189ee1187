"""Publication of a run's stages: tables written aside, moved into place, and a manifest last."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from .files import Folder, digest

#: The stages of a run, each built on the one before.
STAGES = ("edge", "select", "portfolio", "verdict")
COHORTS = uuid.UUID(int=0)


def canonical(value: object) -> str:
    """SHA-256 of the value's JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


class Run:
    """One run's folder. A published stage holds a Parquet table per name and counts only with its manifest."""

    def __init__(self, spark: SparkSession, path: str, stages: tuple[str, ...] = STAGES):
        self.spark, self.stages, self.folder = spark, stages, Folder(spark, path)

    def manifest(self, stage: str) -> dict | None:
        return self.folder.load(f"{stage}.json") if self.folder.exists(f"{stage}.json") else None

    def invalidate(self, stage: str) -> None:
        """Takes away the manifests of the stage and of all that follow."""
        for s in reversed(self.stages[self.stages.index(stage) :]):
            self.folder.delete(f"{s}.json")

    def publish(self, stage: str, tables: dict[str, DataFrame], inputs: dict[str, str] | None = None, facts: dict | None = None) -> dict:
        """Publishes a stage and invalidates those after it. One publication at a time: a lock left by a driver that
        died is to be deleted by hand. A failure before the move leaves the earlier publication valid."""
        before = self.stages[self.stages.index(stage) - 1] if self.stages.index(stage) else None
        above = self.manifest(before) if before else None
        if before and above is None:
            raise ValueError(f"{before} is not published")
        self.folder.create("_lock", stage)
        aside = f"_staging/{uuid.uuid4().hex}"
        try:
            found = {}
            for name, df in tables.items():
                df.write.parquet(f"{self.folder.path}/{aside}/{name}")
                found[name] = digest(self.spark.read.parquet(f"{self.folder.path}/{aside}/{name}"))
            self.invalidate(stage)
            self.folder.delete(stage)
            if tables:
                self.folder.rename(aside, stage)
            said = {"stage": stage, "tables": found, "inputs": inputs or {}, "facts": facts or {}, "above": canonical(above) if above else None}
            self.folder.create(f"{stage}.json", said)
            return said
        finally:
            self.folder.delete(aside)
            self.folder.delete("_lock")

    def table(self, stage: str, name: str) -> DataFrame:
        """A published table; ValueError when the stage isn't published or the table isn't as its manifest says."""
        said = self.manifest(stage)
        if said is None or name not in said["tables"]:
            raise ValueError(f"{stage}/{name} is not published")
        df = self.spark.read.parquet(f"{self.folder.path}/{stage}/{name}")
        if digest(df) != said["tables"][name]:
            raise ValueError(f"{stage}/{name} differs from its manifest")
        return df

    def faults(self, inputs: dict[str, str] | None = None) -> list[str]:
        """What forbids deployment: stages without manifest, tables that differ, stages built on another publication
        of the one before, and inputs (name to digest) that have changed since."""
        out, above = [], None
        for s in self.stages:
            said = self.manifest(s)
            if said is None:
                out.append(f"{s}: not published")
            else:
                if said["above"] != (canonical(above) if above else None):
                    out.append(f"{s}: built on another publication")
                out += [f"{s}: input {k} changed" for k, v in said["inputs"].items() if inputs is not None and inputs.get(k) != v]
                for name in said["tables"]:
                    try:
                        self.table(s, name)
                    except Exception as e:  # a lost table is a fault to report, whatever the reader raises
                        out.append(f"{s}/{name}: {type(e).__name__}: {str(e).splitlines()[0]}")
            above = said
        return out


def register_cohort(spark: SparkSession, path: str, plan: dict, inputs: dict[str, str]) -> str:
    """The cohort's id, a UUIDv5 of the digest of plan and inputs; FileExistsError when it is registered."""
    identity = canonical({"plan": plan, "inputs": inputs})
    name = str(uuid.uuid5(COHORTS, identity))
    Folder(spark, path).create(f"{name}.json", {"plan": plan, "inputs": inputs, "identity": identity})
    return name


#: The kinds of risk policy and the share that a bare kind means.
SHARES = {"flat": 0.15, "throttle": 0.15, "kelly": 0.05}
POLICY = re.compile(rf"\s*({'|'.join(SHARES)})\s*(?::([^,]*)(?:,.*)?)?", re.IGNORECASE)


def risk_policy(spec: str) -> tuple[str, float]:
    """Kind and share of 'throttle:0.2' and the like; what follows a comma is not read."""
    found = POLICY.fullmatch(spec)
    if not found:
        raise ValueError(f"{spec!r} is no risk policy")
    kind, share = found[1].lower(), found[2]
    return kind, float(share) if share else SHARES[kind]
