"""Running plan cells: each cell is a chain of distributed steps ending in one result row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.model import ROW_ID, Descriptor, feature_frame, with_row_id
from gapweave.operators import metrics as M
from gapweave.operators.ampute import ampute_preset, transfer_mask
from gapweave.operators.encode import encode_categories, encode_label
from gapweave.operators.impute import get_imputer
from gapweave.operators.metafeatures import meta_features
from gapweave.operators.regress import get_regressor, scores
from gapweave.operators.scale import fit_standard
from gapweave.operators.split import train_test
from gapweave.plans.grid import open_cells
from gapweave.plans.results import load, result_frame, save
from gapweave.plans.timing import LIMIT_SECONDS, TimedOut, limited
from gapweave.session import settle_table

Opener = Callable[[str], tuple[Descriptor, DataFrame]]


@dataclass
class Runner:
    """Opens datasets by name and runs cells; prepared and filled frames are stored once and reused."""

    spark: SparkSession
    open: Opener
    analyze: list[str] = field(default_factory=list)
    impute_test: bool = False
    original_features: bool = False
    fit_test_on_complete: bool = False
    time_limit: float = LIMIT_SECONDS
    imputer_params: dict[str, dict] = field(default_factory=dict)
    regressor_params: dict[str, dict] = field(default_factory=dict)
    ignore_errors: bool = True
    _prepared: dict = field(default_factory=dict)
    _filled: dict = field(default_factory=dict)

    def run(self, seed: int, ds_name: str, missing: float | None, mecha: str | None, imputer: str | None,
            new_imputer: bool | None, regressor: str) -> dict:
        res = {"ds_name": ds_name, "missing": missing, "mecha": mecha, "imputer": imputer, "new_imputer": new_imputer,
               "regressor": regressor, "seed": seed}
        d, train, test, plain = self._prepare(ds_name, seed)
        test_name = "y_test"
        if missing is None:
            filled, gaps = train, train
        else:
            gaps, res["t_missing"] = self._planted(ds_name, seed, missing, mecha, train, d)
            filled = gaps
        filled_test = None
        if missing is not None and imputer is not None:
            try:
                filled, filled_test, extra = self._imputed(ds_name, seed, missing, mecha, imputer, gaps, train, test, d)
            except TimedOut:
                return res | {"timedout": True}
            except Exception as e:
                if not self.ignore_errors:
                    raise
                return res | {"imputer_error": True, "error": str(e)}
            res |= extra
        if self.analyze:
            values, res["t_meta"] = limited(self.spark, lambda: meta_features(gaps, d.features, d.label, self.analyze, seed=seed), self.time_limit)
            res |= values
            if self.original_features and missing is not None:
                raw = transfer_mask(gaps, plain, d.features)
                res |= meta_features(raw, d.features, d.label, self.analyze, prefix="origmf_", seed=seed)
        try:
            model = get_regressor(regressor, d.features, d.label, **self.regressor_params.get(regressor.lower(), {}))
            _, res["t_fit"] = limited(self.spark, lambda: model.fit(filled), self.time_limit)
            for frame, prefix in ((test, test_name), (filled, "y_train"), (filled_test, "y_test_imp")):
                if frame is not None:
                    got, took = limited(self.spark, lambda: scores(model.predict(frame), d.label, prefix), self.time_limit)  # noqa: B023
                    res |= got
                    res[f"t_{prefix}_predict"] = took
            res["regressor_error"] = False
        except Exception as e:
            if not self.ignore_errors:
                raise
            res |= {"regressor_error": True, "error": str(e)}
        return res

    def run_plan(self, plan: DataFrame, root: str | None = None, tag: str | None = None) -> DataFrame:
        """Run open cells, dataset by dataset; with a tag, stored results are skipped and new ones kept."""
        if tag is not None:
            plan = open_cells(plan, load(self.spark, root, tag))
        cells = plan.orderBy("seed", "ds_name", "missing", "mecha", "imputer", "regressor").collect()  # a plan is small
        rows: list[dict] = []
        at, batch = None, []
        for c in cells:
            key = (c["seed"], c["ds_name"])
            if tag is not None and batch and key != at:
                save(result_frame(self.spark, batch), root, tag)
                batch = []
            at = key
            done = self.run(**c.asDict())
            batch.append(done)
            rows.append(done)
        if tag is not None and batch:
            save(result_frame(self.spark, batch), root, tag)
        return result_frame(self.spark, rows)

    # --- steps, each stored once ---------------------------------------------

    def _prepare(self, ds_name: str, seed: int):
        key = (ds_name, seed)
        if key not in self._prepared:
            d, df = self.open(ds_name)
            if ROW_ID not in df.columns:
                df = with_row_id(df)
            df = encode_label(encode_categories(df, list(d.categorical)), d.label)
            frame = feature_frame(df, d).where(F.col(d.label).isNotNull())
            frame = settle_table(frame.withColumns({c: F.col(c).cast("double") for c in d.categorical}), "prepared")
            train, test = train_test(frame, seed)
            scale = fit_standard(train, list(d.numeric)) if d.numeric else None
            plain = train
            if scale:
                train, test = scale.transform(train), scale.transform(test)
            self._prepared[key] = (d, settle_table(train, "train"), settle_table(test, "test"), plain)
        return self._prepared[key]

    def _planted(self, ds_name, seed, missing, mecha, train, d):
        key = (ds_name, seed, missing, mecha)
        if key not in self._filled:
            self._filled[key] = limited(
                self.spark, lambda: settle_table(ampute_preset(train, d.features, missing, mecha, seed, keep_truth=True), "gaps"), self.time_limit)
        return self._filled[key]

    def _imputed(self, ds_name, seed, missing, mecha, imputer, gaps, train, test, d):
        """Filled train frame, filled test frame, quality scores; shared by all regressors."""
        key = (ds_name, seed, missing, mecha, imputer.lower())
        if key not in self._filled:
            params = self.imputer_params.get(imputer.lower(), {})

            def fill():
                model = get_imputer(imputer, columns=d.features, **params).fit(gaps)
                return model, settle_table(model.transform(gaps), "filled")

            (model, filled), took = limited(self.spark, fill, self.time_limit)
            quality = M.score_block(filled, list(d.numeric), list(d.categorical), d.contains_missing).first().asDict()
            extra = {"t_impute": took, **quality}
            filled_test = None
            if self.impute_test:
                gappy = ampute_preset(test, d.features, missing, mecha, seed, keep_truth=True)
                if self.fit_test_on_complete:
                    model = get_imputer(imputer, columns=d.features, **params).fit(train)
                filled_test = settle_table(model.transform(gappy), "filled-test")
                if not d.contains_missing:
                    extra |= M.test_scores(filled_test, d.features).first().asDict()
            self._filled[key] = (filled, filled_test, extra)
        return self._filled[key]
