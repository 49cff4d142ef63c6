"""The folder for intermediate tables, and what is kept per session."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from stayrate import session
from stayrate.errors import StorageError


def fake(master, named=None, checkpoint=None):
    folders = {"checkpoint": checkpoint}
    context = SimpleNamespace(
        master=master,
        applicationId=f"app-{master}",
        getCheckpointDir=lambda: folders["checkpoint"],
        setCheckpointDir=lambda path: folders.update(checkpoint=path),
    )
    conf = SimpleNamespace(get=lambda key, default=None: named or default)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_named_folder_is_used():
    assert session.shared_folder(fake("yarn", named="hdfs://shared/checkpoints/")) == "hdfs://shared/checkpoints"
    assert session.shared_folder(fake("yarn", checkpoint="hdfs://other")) == "hdfs://other"


def test_cluster_without_folder_is_an_error():
    with pytest.raises(StorageError):
        session.shared_folder(fake("spark://host:7077"))


def test_local_master_gets_its_own_folder():
    one = fake("local[2]")
    assert session.shared_folder(one) == session.shared_folder(one)


def test_staged_tables_are_written_once_and_dropped(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    first = session.once(spark, ("numbers",), build)
    assert session.once(spark, ("numbers",), build) is first and calls == [1]
    assert first.count() == 5 and "parquet" in first.inputFiles()[0]


def test_own_settings_are_respected(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    kept = spark.conf.get(key)
    try:
        spark.conf.set(key, "4000")
        assert session.tuned(spark).conf.get(key) == "4000"
        spark.conf.set(key, "65535")
        assert session.tuned(spark).conf.get(key) == "8000"
    finally:
        spark.conf.set(key, kept)
