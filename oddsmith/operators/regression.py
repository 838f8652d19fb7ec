"""Ordinary least squares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame

from oddsmith.operators.evaluate import explained_variance
from oddsmith.sources.small import small_frame

_VECTOR = "_x"


class LinearFit:
    """A least-squares fit of ``y`` on columns ``x``, made on construction.

    The normal equations take one pass over the data; only the small matrix of
    products reaches the driver.
    """

    def __init__(self, df: DataFrame, x: Sequence[str], y: str, fit_intercept: bool = True):
        self.df, self.x, self.y = df, list(x), y
        self._assembler = VectorAssembler(inputCols=self.x, outputCol=_VECTOR)
        self.model = LinearRegression(
            featuresCol=_VECTOR, labelCol=y, solver="normal", fitIntercept=fit_intercept
        ).fit(self._assembler.transform(df.select(*dict.fromkeys([*self.x, y]))))

    @property
    def coefficients(self) -> dict[str, float]:
        return dict(zip(self.x, self.model.coefficients.toArray().tolist()))

    @property
    def intercept(self) -> float:
        return self.model.intercept

    def terms(self) -> DataFrame:
        """Coefficients and intercept as rows."""
        rows = [*self.coefficients.items(), ("intercept", self.intercept)]
        return small_frame(self.df.sparkSession, rows, "term string, value double")

    def predict(self, df: DataFrame | None = None, output: str = "prediction") -> DataFrame:
        rows = self._assembler.transform(self.df if df is None else df)
        return self.model.copy().setPredictionCol(output).transform(rows).drop(_VECTOR)

    def explained_variance(self, df: DataFrame | None = None) -> float:
        scored = self.predict(df, "_prediction")
        return explained_variance(scored, self.y, "_prediction").first()["explained_variance"]
