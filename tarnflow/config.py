"""Application settings with defaults and validation that reports every violation at once."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Mapping
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import SparkSession


class Guarantee(Enum):
    AT_LEAST_ONCE = "at-least-once"
    EXACTLY_ONCE = "exactly-once"


@dataclass
class Config:
    """Times are in milliseconds; zero or empty means the default."""

    application_id: str = ""
    sources: tuple[str, ...] = ()  # paths or brokers
    guarantee: Guarantee = Guarantee.AT_LEAST_ONCE
    state_dir: str = ""
    task_threads: int = 0  # tasks that state is dealt out to
    commit_interval_ms: int = 0
    state_provider: str = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark_conf: Mapping[str, str] = field(default_factory=dict)

    def with_defaults(self) -> Config:
        self.task_threads = self.task_threads or os.cpu_count() or 1
        self.commit_interval_ms = self.commit_interval_ms or 100
        return self

    def state_folder(self, spark: SparkSession) -> str:
        """Where checkpoints and state go. A local temporary folder only if it all runs on this machine: executors elsewhere couldn't see it."""
        if self.state_dir:
            return self.state_dir
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if shared:
            return f"{shared.rstrip('/')}/tarnflow-{self.application_id}"
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"state_dir must name a folder that driver and executors share; the master is {master}")
        return os.path.join(tempfile.gettempdir(), f"tarnflow-{self.application_id}")

    def violations(self) -> list[str]:
        checks = (
            (bool(self.application_id), "application_id must not be empty"),
            (bool(self.sources), "sources must name at least one"),
            (self.task_threads >= 0, f"task_threads must not be negative, is {self.task_threads}"),
            (self.commit_interval_ms > 0, f"commit_interval_ms must be positive, is {self.commit_interval_ms}"),
        )
        return [said for fine, said in checks if not fine]

    def validated(self) -> Config:
        if found := self.with_defaults().violations():
            raise ValueError("; ".join(found))
        return self

    def session(self) -> SparkSession:
        """A session with the state store and time zone that the engine needs."""
        self.validated()
        conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": str(self.task_threads), "spark.sql.streaming.stateStore.providerClass": self.state_provider, "spark.sql.adaptive.enabled": "true"}
        builder = SparkSession.builder.appName(self.application_id)
        for k, v in (conf | dict(self.spark_conf)).items():
            builder = builder.config(k, v)
        return builder.getOrCreate()
