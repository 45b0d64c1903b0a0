"""Session factory and the shared scratch folder used for checkpoints and stream state."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, adaptive execution).

    ``master`` and ``shuffle_partitions`` stay unset on a cluster: the cluster's own values win there
    and adaptive execution coalesces or splits shuffle partitions by size.
    """
    b = (
        SparkSession.builder.appName("tidewire")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        b = b.config(key, value)
    return b.getOrCreate()


_LOCAL: list[str] = []  # the folder of this process, if it has made one


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` that every executor can reach.

    The cluster names that setting. Only a local master may do without: then one folder of this machine serves the process and goes with it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="tidewire-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
