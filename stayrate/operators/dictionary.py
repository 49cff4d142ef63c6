"""One-hot encoding into sparse vectors, for columns with any number of values.

The dictionary is a table (column, value, place), numbered over value ranges and never gathered: values of a column by
code point, the first, place 0, being the reference that all zeros stand for. A column whose dictionary is measured to
be small is sent to the tasks, any other is joined. ``pyspark.ml`` makes the sparse vectors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, VectorAssembler
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReader, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.functions.modes import pairs_of
from stayrate.functions.running import running_totals
from stayrate.operators.checks import columns_by_type, require_columns, require_some
from stayrate.operators.steps import FittedStep, Step
from stayrate.session import stage

#: Values of a column that are sent to every task; more are joined by a shuffle.
SENT = 100_000


def fit_dictionary(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value, place of every value that occurs; places count from 0 in each column."""
    columns = require_some(columns, "encoding")
    require_columns(train, columns)
    found = pairs_of(train, columns).distinct().select(F.struct("name", "value").alias("pair"), F.lit(1).alias("one"))
    counted = stage(running_totals(found, "pair", {"one": "upto"}).select("pair.name", "pair.value", "upto"), "dictionary")
    # a row a column
    first = F.create_map(*[x for r in counted.groupBy("name").agg(F.min("upto").alias("n")).collect() for x in (F.lit(r["name"]), F.lit(r["n"]))])
    return counted.select(F.col("name").alias("column"), "value", (F.col("upto") - first[F.col("name")]).cast("long").alias("place"))


def dictionary_sizes(dictionary: DataFrame) -> dict[str, int]:
    """Number of values of each column, by name."""
    counts = dictionary.groupBy("column").agg(F.count("*").alias("n")).collect()  # a row a column
    return {r["column"]: r["n"] for r in sorted(counts)}


def with_places(df: DataFrame, dictionary: DataFrame, sizes: dict[str, int], sent: int = SENT, suffix: str = "_place") -> DataFrame:
    """Add the place of each column's value; an unseen or missing value has none."""
    for c, n in sizes.items():
        own = dictionary.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("place").alias(f"{c}{suffix}"))
        own = F.broadcast(own) if n <= sent else own
        df = df.join(own, F.col(c).cast("string") == F.col("_value"), "left").drop("_value")
    return df


class EncodeWriter(MLWriter):
    """The dictionary and the encoder lie beside the settings."""

    def __init__(self, instance: Encode):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.dictionary.write.parquet(f"{path}/dictionary")
        if self.instance.encoder is not None:
            self.instance.encoder.write().save(f"{path}/encoder")


class EncodeReader(MLReader):
    def load(self, path: str) -> Encode:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        made = Encode()
        made._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(made, metadata)
        made.dictionary = self.sparkSession.read.schema("column string, value string, place long").parquet(f"{path}/dictionary")
        made.encoder = OneHotEncoderModel.load(f"{path}/encoder") if made.wide() else None
        made.needs = tuple(made.learnt()["sizes"])
        return made


class Encode(FittedStep):
    """Add a sparse vector, named by the setting ``output``; the encoded columns go."""

    dictionary: DataFrame
    encoder: OneHotEncoderModel | None = None

    def wide(self) -> dict[str, int]:
        """Columns that have more than the reference value."""
        return {c: n for c, n in self.learnt()["sizes"].items() if n > 1}

    def names(self) -> DataFrame:
        """slot, column, value: what each slot of the vector stands for."""
        slot, start = None, 0
        for c, n in self.wide().items():
            own = F.when(F.col("column") == c, F.col("place") - 1 + start)
            slot, start = own if slot is None else F.coalesce(slot, own), start + n - 1
        return self.dictionary.where("place > 0").select(slot.cast("long").alias("slot"), "column", "value")

    def apply(self, df, state):
        wide, output = self.wide(), self.setting("output", "encoded")
        placed = with_places(df, self.dictionary, wide, self.setting("sent", SENT))
        # the first value of a column, an unseen and a missing one take the slot that the encoder drops
        slots = {f"{c}_slot": F.coalesce(F.when(F.col(f"{c}_place") > 0, F.col(f"{c}_place") - 1), F.lit(n - 1)).cast("double") for c, n in wide.items()}
        coded = self.encoder.transform(placed.withColumns(slots)) if wide else placed
        joined = VectorAssembler(inputCols=[f"{c}_vector" for c in wide], outputCol=output).transform(coded) if wide else coded
        return joined.drop(*state["sizes"], *[f"{c}{s}" for c in wide for s in ("_place", "_slot", "_vector")])

    def write(self):
        return EncodeWriter(self)

    @classmethod
    def read(cls):
        return EncodeReader()


class EncodeStep(Step):
    """Dictionary of the columns in the setting ``columns``, or of all text columns but those in ``skip``."""

    fitted = Encode

    def learn(self, df):
        columns = self.setting("columns") or columns_by_type(df, self.setting("skip", []))[0]
        self._dictionary = fit_dictionary(df, columns)
        sizes = dictionary_sizes(self._dictionary)
        return {"sizes": {c: sizes.get(c, 0) for c in columns}}

    def _fit(self, dataset):
        made = super()._fit(dataset)
        made.dictionary, wide = self._dictionary, made.wide()
        made.needs = tuple(made.learnt()["sizes"])
        if wide:  # the encoder only learns the largest slot of each column, which one row says
            row = dataset.sparkSession.createDataFrame([tuple(float(n - 2) for n in wide.values())], [f"{c}_slot" for c in wide])
            one = OneHotEncoder(inputCols=row.columns, outputCols=[f"{c}_vector" for c in wide], handleInvalid="keep", dropLast=True)
            made.encoder = one.fit(row)
        return made
