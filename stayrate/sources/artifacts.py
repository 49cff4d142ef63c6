"""Saving and loading fitted parameters and models on any file system Spark reaches."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from stayrate.errors import StorageError
from stayrate.operators.checks import require_fitted
from stayrate.operators.clean import FillValues
from stayrate.operators.encode import OneHotParams, ScaleParams
from stayrate.operators.engagement import EngagementParams
from stayrate.operators.features import FeatureParams
from stayrate.operators.model import Bundle, MatrixParams
from stayrate.operators.rfm import RfmParams


def _features(d: dict) -> FeatureParams:
    return FeatureParams(RfmParams(**d["rfm"]), EngagementParams(**d["engagement"]))


def _matrix(d: dict) -> MatrixParams:
    return MatrixParams(
        _features(d["features"]), OneHotParams(**d["onehot"]), ScaleParams(**d["scaler"]), d["dropped"]
    )


_KINDS = {
    "FillValues": lambda d: FillValues(**d),
    "RfmParams": lambda d: RfmParams(**d),
    "EngagementParams": lambda d: EngagementParams(**d),
    "FeatureParams": _features,
    "OneHotParams": lambda d: OneHotParams(**d),
    "ScaleParams": lambda d: ScaleParams(**d),
    "MatrixParams": _matrix,
    "Bounds": lambda d: {c: tuple(b) for c, b in d.items()},
}


def save_fitted(spark: SparkSession, params: object, path: str) -> None:
    """Write parameters as a one-row table, replacing what is there."""
    require_fitted(params, "the parameters to save")
    kind = "Bounds" if isinstance(params, dict) else type(params).__name__
    body = params if isinstance(params, dict) else asdict(params)
    row = spark.createDataFrame([(kind, json.dumps(body))], "kind string, body string")
    row.coalesce(1).write.mode("overwrite").parquet(path)


def load_fitted(spark: SparkSession, path: str) -> object:
    """Read parameters written by :func:`save_fitted`."""
    try:
        row = spark.read.schema("kind string, body string").parquet(path).first()
    except PySparkException as e:
        raise StorageError(f"no saved parameters at {path}: {e}") from e
    if row is None:
        raise StorageError(f"no saved parameters at {path}")
    return _KINDS[row["kind"]](json.loads(row["body"]))


def _files(spark: SparkSession, path: str):
    """The folder of a path and its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the claimed versions, ascending."""
    folder, system = _files(spark, f"{path}/versions")
    names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
    return sorted(int(n) for n in names if n.isdigit())


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file unless there is one; false if there is. Of several writers the file system lets one do it.

    Hadoop's local file system looks first and writes then, so there the operating system is asked.
    """
    file, system = _files(spark, path)
    if system.getUri().getScheme() == "file":
        local = Path(file.toUri().getPath())
        local.parent.mkdir(parents=True, exist_ok=True)
        try:
            with local.open("x") as out:
                out.write(text)
        except FileExistsError:
            return False
        return True
    try:
        out = system.create(file, False)
    except Py4JJavaError as e:
        if system.exists(file):
            return False
        raise StorageError(f"cannot write {path}: {e}") from e
    out.write(text.encode())
    out.close()
    return True


def _claim(spark: SparkSession, path: str, version: str) -> int:
    """List a finished version under the next free number; no clock takes part."""
    number = max(_listed(spark, path), default=0) + 1
    while not _create(spark, f"{path}/versions/{number:012d}", version):
        number += 1
    return number


def bundle_versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and folder name of every finished version, in the order of their numbers."""
    found = []
    for number in _listed(spark, path):
        name = "".join(r["value"] for r in spark.read.text(f"{path}/versions/{number:012d}").collect())  # one short line
        if len(name) == 32:  # the claim is written; its writer may be just about to
            found.append((number, name))
    return found


def save_bundle(spark: SparkSession, bundle: Bundle, path: str) -> int:
    """Write the model and all parameters as a new version under ``path``; says its number.

    The version is listed only when all its parts are written, so a save that fails leaves the one before it in
    force. Of saves at the same time each gets a number of its own. Earlier versions stay.
    """
    require_fitted(bundle, "the model bundle")
    version = uuid.uuid4().hex
    folder = f"{path}/{version}"
    bundle.model.write().save(f"{folder}/model")
    save_fitted(spark, bundle.matrix, f"{folder}/matrix")
    save_fitted(spark, bundle.fills or FillValues(), f"{folder}/fills")
    save_fitted(spark, bundle.bounds or {}, f"{folder}/bounds")
    return _claim(spark, path, version)


def load_bundle(spark: SparkSession, path: str, number: int | None = None) -> Bundle:
    """Read the version of that number, or the one with the largest."""
    found = dict(bundle_versions(spark, path))
    if not found or (number is not None and number not in found):
        raise StorageError(f"no saved bundle at {path}" if number is None else f"no version {number} at {path}")
    folder = f"{path}/{found[max(found) if number is None else number]}"
    matrix, fills, bounds = (load_fitted(spark, f"{folder}/{n}") for n in ("matrix", "fills", "bounds"))
    model = PipelineModel.load(f"{folder}/model")
    return Bundle(matrix, model, fills if fills != FillValues() else None, bounds or None)
