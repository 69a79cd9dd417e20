"""Fitted models as JSON text, so that no code is stored: scorecards, boosted trees, and the bundles of a training run."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import SparkSession

from ..operators.binning import Bins
from ..operators.boosting import Boosted, Node
from ..operators.bundles import ORDER, Bundle, DummyDesign
from ..operators.calibrators import Calibrator, Steps
from ..operators.regression import Fit
from ..operators.scorecard import Scorecard
from .tables import read_json, write_json


def _fit(d: dict) -> Fit:
    return Fit(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()})


def _card_text(card: Scorecard) -> dict:
    return {"bins": {n: asdict(b) for n, b in card.bins.items()}, "fit": asdict(card.fit), "dropped": card.dropped}


def _card(got: dict) -> Scorecard:
    return Scorecard({n: Bins(**b) for n, b in got["bins"].items()}, _fit(got["fit"]), tuple(tuple(d) for d in got["dropped"]))


def _boosted_text(model: Boosted) -> dict:
    return {"features": list(model.features), "labels": list(model.labels), "base": model.base, "trees": [asdict(t) for t in model.trees], "losses": list(model.losses)}


def _node(d: dict | None) -> Node | None:
    if d is None:
        return None
    return Node(**{**d, "left": _node(d["left"]), "right": _node(d["right"]), "labels": None if d.get("labels") is None else tuple(d["labels"])})


def _boosted(got: dict) -> Boosted:
    return Boosted(got["features"], got["base"], [_node(t) for t in got["trees"]], tuple(got.get("labels", ())), got.get("losses", []))


def save_scorecard(spark: SparkSession, card: Scorecard, path: str, data_source: str) -> None:
    write_json(spark, _card_text(card), path, data_source)


def load_scorecard(spark: SparkSession, path: str) -> Scorecard:
    return _card(read_json(spark, path))


def save_boosted(spark: SparkSession, model: Boosted, path: str, data_source: str) -> None:
    write_json(spark, _boosted_text(model), path, data_source)


def load_boosted(spark: SparkSession, path: str) -> Boosted:
    return _boosted(read_json(spark, path))


def _bundle_text(b: Bundle) -> dict:
    model = {"scorecard": _card_text, "boosted": _boosted_text, "logit": asdict}[b.kind](b.model)
    calibrator = None if b.calibrator is None else {"kind": b.calibrator.kind, "model": asdict(b.calibrator.model)}
    return {"name": b.name, "kind": b.kind, "features": b.features, "model": model, "design": None if b.design is None else asdict(b.design), "calibrator": calibrator, "shift": b.shift, "signs": b.signs, "provenance": b.provenance}


def _bundle(d: dict) -> Bundle:
    model = {"scorecard": _card, "boosted": _boosted, "logit": _fit}[d["kind"]](d["model"])
    c, design = d["calibrator"], d["design"]
    calibrator = None if c is None else Calibrator(c["kind"], _fit(c["model"]) if c["kind"] == "platt" else Steps(tuple(c["model"]["boundaries"]), tuple(c["model"]["values"])))
    made = None if design is None else DummyDesign({k: [tuple(s) for s in v] for k, v in design["ladders"].items()}, design["groups"], tuple(design["references"]))
    return Bundle(d["name"], d["kind"], d["features"], model, made, calibrator, d["shift"], d["signs"], d["provenance"])


def save_bundles(spark: SparkSession, bundles: dict[str, Bundle], path: str, data_source: str) -> None:
    """All models of a run in one record, in their order: a reader gets the whole run or nothing."""
    if list(bundles) != [n for n in ORDER if n in bundles]:
        raise ValueError(f"bundles are kept in the order {ORDER}")
    write_json(spark, {"bundles": [_bundle_text(b) for b in bundles.values()]}, path, data_source)


def load_bundles(spark: SparkSession, path: str) -> dict[str, Bundle]:
    return {d["name"]: _bundle(d) for d in read_json(spark, path)["bundles"]}
