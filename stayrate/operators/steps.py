"""Fitted steps as ``pyspark.ml`` stages: learnt in ``Pipeline.fit``, saved and loaded with it, and open to users.

A step is a pair of classes. The unfitted one names the columns that it ``needs`` and says in ``learn`` what it takes
from training rows, as a dict that JSON can hold; the fitted one says in ``apply`` what it does with it, as a projection.
Checks, settings and persistence come from the base classes::

    class Shift(FittedStep):
        def apply(self, df, state):
            return df.withColumn("x", F.col("x") - state["mean"])

    class ShiftStep(Step):
        fitted, needs = Shift, ("x",)

        def learn(self, df):
            return {"mean": df.agg(F.avg("x")).first()[0]}
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate import schema
from stayrate.errors import NotFittedError
from stayrate.operators.checks import columns_by_type, require_columns, require_non_empty
from stayrate.operators.clean import FillValues, fill_and_type, fit_fill_values
from stayrate.operators.encode import ScaleParams, apply_scaler, fit_scaler
from stayrate.operators.engagement import EngagementParams
from stayrate.operators.features import FeatureParams, apply_features, fit_features
from stayrate.operators.outliers import cap, fit_bounds
from stayrate.operators.rfm import RfmParams


class _Stage(DefaultParamsReadable, DefaultParamsWritable):
    """What both halves share: needed columns, and settings that are saved with the stage."""

    needs: tuple[str, ...] = ()
    options = Param(Params._dummy(), "options", "settings as JSON", TypeConverters.toString)

    def __init__(self, **options: object):
        super().__init__()
        self._set(options=json.dumps(options))

    def setting(self, name: str, default: object = None) -> object:
        return json.loads(self.getOrDefault(self.options)).get(name, default)


class FittedStep(_Stage, Model):
    """The fitted half: override ``apply``; ``light`` says that repeating it costs less than writing what it makes."""

    light = False
    state = Param(Params._dummy(), "state", "what was learnt, as JSON", TypeConverters.toString)

    def learnt(self) -> dict:
        """What ``learn`` returned; an error before it did."""
        if not self.isDefined(self.state):
            raise NotFittedError(f"{type(self).__name__} must be fitted first")
        return json.loads(self.getOrDefault(self.state))

    def apply(self, df: DataFrame, state: dict) -> DataFrame:
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        state = self.learnt()
        return self.apply(require_columns(dataset, self.needs), state)


class Step(_Stage, Estimator):
    """The unfitted half: set ``fitted`` and ``needs``, override ``learn``."""

    fitted: type[FittedStep]

    def learn(self, df: DataFrame) -> dict:
        raise NotImplementedError

    def _fit(self, dataset: DataFrame) -> FittedStep:
        require_non_empty(require_columns(dataset, self.needs))
        made = self.fitted(**json.loads(self.getOrDefault(self.options)))
        made.needs = self.needs
        return made._set(state=json.dumps(self.learn(dataset)))


class Clean(FittedStep):
    """Fill and type with known medians and modes; rows without id, registration date or label go."""

    def apply(self, df, state):
        critical = self.setting("critical", list(schema.CRITICAL_COLUMNS))
        return fill_and_type(df, FillValues(**state), critical=critical)


class CleanStep(Step):
    """Medians and modes of rows without repeated customers."""

    fitted, needs = Clean, tuple(schema.ALL_COLUMNS)

    def learn(self, df):
        return asdict(fit_fill_values(df))


class Cap(FittedStep):
    """Cap at known bounds."""

    light = True

    def apply(self, df, state):
        return cap(df, {c: tuple(b) for c, b in state.items()})


class CapStep(Step):
    """Bounds at 1.5 quartile distances of the continuous columns."""

    fitted, needs = Cap, tuple(schema.CAPPED_COLUMNS)

    def learn(self, df):
        return {c: list(b) for c, b in fit_bounds(df, list(schema.CAPPED_COLUMNS)).items()}


class Engineer(FittedStep):
    """Recency, segment and engagement from known boundaries, without the columns of the setting ``without``."""

    def apply(self, df, state):
        params = FeatureParams(RfmParams(**state["rfm"]), EngagementParams(**state["engagement"]))
        return apply_features(df, params).drop(*self.setting("without", []))


class EngineerStep(Step):
    """Boundaries of RFM and ranges of engagement."""

    fitted = Engineer

    def learn(self, df):
        return asdict(fit_features(df))


class Scale(FittedStep):
    """Scale in place; a number that is missing counts as the center."""

    light = True

    def apply(self, df, state):
        scaled = apply_scaler(df, ScaleParams(**state))
        return scaled.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in state["columns"]})


class ScaleStep(Step):
    """Center and divisor of all numeric columns but those of the setting ``skip``; setting ``method``."""

    fitted = Scale

    def learn(self, df):
        numeric = columns_by_type(df, self.setting("skip", []))[1]
        return asdict(fit_scaler(df, numeric, self.setting("method", "standard")))
