"""Stored variants of datasets: source, with gaps, filled; each scaled and unscaled.

Data goes to Parquet folders, and a manifest row is appended only after the data
is complete, so a half-written folder is never read. Clearing appends a row as
well: the variant is made anew on next use, files stay until removed by hand.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapweave.model import ROW_ID, Descriptor, with_row_id
from gapweave.operators.ampute import ampute_numeric
from gapweave.operators.impute import impute_numeric
from gapweave.operators.scale import inverse_scale_dataset, scale_dataset
from gapweave.plans.timing import LIMIT_SECONDS, TimedOut, limited
from gapweave.sources.registry import project

MANIFEST = ("dataset string, missing double, mecha string, seed int, imputer string, scaled boolean, status string, "
            "missing_time double, impute_time double, path string, written timestamp, serial long")
KEY = ["dataset", "missing", "mecha", "seed", "imputer", "scaled"]


@dataclass
class VariantStore:
    spark: SparkSession
    root: str
    open: Callable[[str], tuple[Descriptor, DataFrame]]
    time_limit: float = LIMIT_SECONDS

    # --- manifest --------------------------------------------------------------

    def manifest(self) -> DataFrame:
        """Latest row per variant; cleared ones are left out."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], MANIFEST)
        w = Window.partitionBy(*KEY).orderBy(F.desc("written"), F.desc("serial"))
        latest = rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
        return latest.where("status <> 'CLEARED'")

    def _note(self, rows: list[dict]) -> None:
        full = [(r["dataset"], r.get("missing"), r.get("mecha"), r.get("seed"), r.get("imputer"), r["scaled"], r["status"],
                 r.get("missing_time"), r.get("impute_time"), r.get("path"), None, i) for i, r in enumerate(rows)]
        df = self.spark.createDataFrame(full, MANIFEST).withColumn("written", F.current_timestamp())
        df.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def _find(self, **key) -> dict | None:
        cond = F.lit(True)
        for k in KEY:
            cond = cond & F.col(k).eqNullSafe(F.lit(key.get(k)))
        row = self.manifest().where(cond).first()
        return row.asDict() if row else None

    def _write(self, df: DataFrame, label: str) -> str:
        path = f"{self.root}/data/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    # --- read-through -------------------------------------------------------------

    def source(self, name: str, scaled: bool) -> DataFrame:
        got = self._find(dataset=name, scaled=scaled)
        if got is None:
            self._make_source(name)
            got = self._find(dataset=name, scaled=scaled)
        return self.spark.read.parquet(got["path"])

    def missing(self, name: str, percent: float, mecha: str, seed: int, scaled: bool) -> DataFrame:
        key = {"dataset": name, "missing": float(percent), "mecha": mecha, "seed": seed}
        got = self._find(**key, scaled=scaled)
        if got is None:
            self._make_missing(key)
            got = self._find(**key, scaled=scaled)
        return self.spark.read.parquet(got["path"])

    def imputed(self, name: str, percent: float, mecha: str, seed: int, imputer: str, scaled: bool) -> DataFrame:
        key = {"dataset": name, "missing": float(percent), "mecha": mecha, "seed": seed, "imputer": imputer}
        got = self._find(**key, scaled=scaled)
        if got is None:
            self._make_imputed(key)
            got = self._find(**key, scaled=scaled)
        if got["status"] == "TIMED_OUT":
            raise TimedOut(f"{imputer} on {name} timed out before")
        return self.spark.read.parquet(got["path"])

    def timings(self, name: str, percent: float, mecha: str, seed: int, imputer: str) -> dict[str, float]:
        m = self.manifest().where(~F.col("scaled"))
        filled = m.where(F.col("imputer") == imputer).select("dataset", "missing", "mecha", "seed", "impute_time")
        gaps = m.where(F.col("imputer").isNull()).select("dataset", "missing", "mecha", "seed", "missing_time")
        row = filled.join(gaps, ["dataset", "missing", "mecha", "seed"]).where(
            (F.col("dataset") == name) & (F.col("missing") == float(percent)) & (F.col("mecha") == mecha) & (F.col("seed") == seed)).first()
        if row is None:
            raise KeyError("no such variant")
        return {"impute_time": row["impute_time"], "missing_time": row["missing_time"]}

    def build(self, datasets: list[str], percents: list[float], mechas: list[str], base_seed: int, repeat: int,
              imputers: list[str]) -> DataFrame:
        """Make every variant; a timeout abandons the remaining imputers of that seed. Returns the manifest."""
        for name in datasets:
            for percent in percents:
                for mecha in mechas:
                    for seed in range(base_seed, base_seed + repeat):
                        try:
                            for imputer in imputers:
                                self.imputed(name, percent, mecha, seed, imputer, False)
                        except TimedOut:
                            continue
        return self.manifest()

    def clear(self, datasets: list[str] | None = None, mechas: list[str] | None = None, imputers: list[str] | None = None) -> int:
        """Forget variants by dataset, else by mechanism, else by imputer; everything when nothing is named."""
        m = self.manifest()
        for column, wanted in (("dataset", datasets), ("mecha", mechas), ("imputer", imputers)):
            if wanted is not None:
                m = m.where(F.col(column).isin(wanted))
                break
        gone = [r.asDict() | {"status": "CLEARED"} for r in m.collect()]
        if gone:
            self._note(gone)
        return len(gone)

    # --- making variants --------------------------------------------------------------

    def _make_source(self, name: str) -> None:
        d, df = self.open(name)
        df = project(df if ROW_ID in df.columns else with_row_id(df), d, ROW_ID)
        df = df.withColumns({c: F.col(c).cast("double") for c in d.numeric})
        scaled = scale_dataset(df, list(d.numeric), list(d.text))
        self._note([{"dataset": name, "scaled": s, "status": "OK", "path": self._write(f, name)} for s, f in ((False, df), (True, scaled))])

    def _store_both(self, key: dict, scaled: DataFrame, d: Descriptor, times: dict) -> None:
        path = self._write(scaled, key["dataset"])
        plain = inverse_scale_dataset(self.spark.read.parquet(path), self.source(key["dataset"], False), list(d.numeric), list(d.text))
        rows = [{**key, "scaled": True, "status": "OK", "path": path, **times},
                {**key, "scaled": False, "status": "OK", "path": self._write(plain, key["dataset"]), **times}]
        self._note(rows)

    def _make_missing(self, key: dict) -> None:
        d, _ = self.open(key["dataset"])
        src = self.source(key["dataset"], True)
        df, took = limited(self.spark, lambda: ampute_numeric(src, list(d.numeric), key["missing"], key["mecha"], key["seed"]), self.time_limit)
        self._store_both(key, df, d, {"missing_time": took})

    def _make_imputed(self, key: dict) -> None:
        d, _ = self.open(key["dataset"])
        src = self.missing(key["dataset"], key["missing"], key["mecha"], key["seed"], True)
        try:
            df, took = limited(self.spark, lambda: self.spark.read.parquet(self._write(
                impute_numeric(src, key["imputer"], list(d.numeric), list(d.text)), key["dataset"])), self.time_limit)
        except TimedOut:
            self._note([{**key, "scaled": s, "status": "TIMED_OUT"} for s in (True, False)])
            raise
        self._store_both(key, df, d, {"impute_time": took})
