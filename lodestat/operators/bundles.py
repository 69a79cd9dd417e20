"""The models of one training run as whole records: design, fit, calibrator, signs and where they come from, in a fixed order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean
from . import binning, boosting, calibrators, governance, regression, scorecard, search

#: The order of a run's models, and the setting of boosted ones that were not searched for.
ORDER = ("full", "independent", "level", "leaf", "recalibrated", "reproduced")
SETTING, TREES = search.Setting(rate=0.08, depth=4, leaves=15, least=50, rows=0.8, columns=0.8, ridge=5.0), 250


@dataclass(frozen=True)
class DummyDesign:
    """Ladders and groups that become 0/1 columns, without the levels that are left out."""

    ladders: Mapping[str, Sequence[tuple[float, float]]]
    groups: Mapping[str, Mapping[str, Sequence[str]]]
    references: tuple[str, ...] = ()

    def columns(self) -> dict[str, Column]:
        made = clean.dummy_design({k: [tuple(s) for s in v] for k, v in self.ladders.items()}, {k: {n: list(x) for n, x in v.items()} for k, v in self.groups.items()}, tuple(self.references))
        return {n.replace("-", "m").replace(".", "p"): c for n, c in made.items()}  # names that need no quotes


@dataclass
class Bundle:
    """A model that can be applied as it is. kind: scorecard, boosted or logit; shift moves the margin before it is calibrated."""

    name: str
    kind: str
    features: list[str]
    model: scorecard.Scorecard | boosting.Boosted | regression.Fit
    design: DummyDesign | None = None
    calibrator: calibrators.Calibrator | None = None
    shift: float = 0.0
    signs: dict[str, int] = field(default_factory=dict)
    provenance: dict = field(default_factory=dict)

    def margin(self) -> Column:
        if self.design is None:
            return self.model.margin() + self.shift
        columns, out = self.design.columns(), F.lit(self.model.intercept + self.shift)
        for n, b in zip(self.model.names, self.model.coef):
            out = out + F.lit(b) * F.coalesce(columns[n].cast("double"), F.lit(0.0))
        return out

    def apply(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """Adds the model's probability under its name."""
        name = name or self.name
        if self.calibrator is None:
            return df.withColumn(name, clean.sigmoid(self.margin()))
        out = self.calibrator.apply(df.withColumn("__margin", self.margin()), F.col("__margin"))
        return out.withColumn(name, F.col("calibrated")).select(*df.columns, name)


@dataclass
class Data:
    """What a run learns from: development rows for training and for calibration, later rows for the shift, and the whole population with its lifetime target."""

    train: DataFrame
    holdout: DataFrame
    later: DataFrame
    lifetime: DataFrame
    y: str
    lifetime_y: str
    row_id: str
    year: str


def _scorecard(data: Data, name: str, features: Sequence[str], labels: Sequence[str], selection: Mapping[str, float]) -> Bundle:
    bins = binning.fit_numeric(data.train, [f for f in features if f not in labels], data.y)
    bins |= {f: binning.fit_labels(data.train, f, data.y, data.row_id) for f in features if f in labels}
    card = scorecard.fit_scorecard(data.train, data.y, bins, **selection)
    return Bundle(name, "scorecard", list(features), card, provenance={"target": data.y, "dropped": [list(d) for d in card.dropped]})


def train_all(
    data: Data, features: Sequence[str], independent: Sequence[str], labels: Sequence[str], design: DummyDesign, signs: Mapping[str, int] | None = None, forbidden: Sequence[str] = (),
    validate: Sequence[int] = (), settings: Mapping[str, tuple[search.Setting, int]] | None = None, draws: int = search.DRAWS, seed: int = 0, selection: Mapping[str, float] | None = None,
) -> dict[str, Bundle]:
    """The six models in their order: two scorecards, two boosted models, the first scorecard with its mean moved to the later rows' rate, and the penalised logit on dummies.

    Boosted settings are searched for over the validation years unless settings gives them; both final models are then
    grown side by side, and calibrated on the holdout, never on later rows. The moved scorecard uses later outcomes, and says so.
    """
    governance.assert_no_leakage([*features, *independent], forbidden)
    signs, selection = dict(signs or {}), dict(selection or {})
    own = [f for f in features if f in labels]
    out = {"full": _scorecard(data, "full", features, labels, selection), "independent": _scorecard(data, "independent", independent, labels, selection)}
    chosen, found = dict(settings or {}), {}
    for kind in (search.LEVEL, search.LEAF):
        if kind not in chosen:
            s = search.expanding_search(data.train, data.y, features, data.year, data.row_id, validate, draws, seed=seed, signs=signs, labels=own, kind=kind)
            chosen[kind], found[kind] = (s.best, s.trees), min((t.loss for t in s.trials if t.loss is not None), default=None)
    jobs = [(chosen[k][0].growth(k, chosen[k][1], seed), 0) for k in (search.LEVEL, search.LEAF)]
    grown = boosting.grow(data.train, data.y, features, jobs, [boosting.Fold(F.lit(True))], own, data.row_id, signs=signs)
    for kind, model in zip((search.LEVEL, search.LEAF), grown):
        margins = data.holdout.select(data.row_id, data.y, model.margin().alias("__m"))
        calibrator = calibrators.choose(margins, data.y, F.col("__m"), data.row_id)
        setting, trees = chosen[kind]
        out[kind] = Bundle(kind, "boosted", list(features), model, calibrator=calibrator, signs=signs, provenance={"target": data.y, "setting": setting.__dict__, "trees": trees, "searched_loss": found.get(kind), "calibration": calibrator.kind})
    full = out["full"]
    moved = regression.recalibration_shift(data.later, data.y, full.margin())
    out["recalibrated"] = Bundle("recalibrated", "scorecard", full.features, full.model, shift=moved, provenance={"target": data.y, "note": "the shift is fitted with later outcomes; measures on those rows are in-sample"})
    columns = design.columns()
    fit = regression.penalised_logit(data.lifetime.select(F.col(data.lifetime_y).alias("__y"), *[F.coalesce(c.cast("int"), F.lit(0)).alias(n) for n, c in columns.items()]), "__y", list(columns))
    out["reproduced"] = Bundle("reproduced", "logit", sorted({*design.ladders, *design.groups}), fit, design, provenance={"target": data.lifetime_y})
    return {k: out[k] for k in ORDER}
