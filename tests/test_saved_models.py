from lodestat.operators.binning import Bins
from lodestat.operators.boosting import Boosted, Node
from lodestat.operators.regression import Fit
from lodestat.operators.scorecard import Scorecard
from lodestat.sources import models


def test_models_read_back_as_saved(spark, tmp_path):
    card = Scorecard({"a": Bins("a", [1.5], [], [1, 2, 0], [3, 4, 0], [0.1, -0.1, 0.0], 0.3)}, Fit(("a",), (-1.0,), (0.1,), -0.5, 0.2, 10), (("b", "iv"),))
    models.save_scorecard(spark, card, str(tmp_path / "card.json"), "orders")
    assert models.load_scorecard(spark, str(tmp_path / "card.json")) == card
    trees = Boosted(["a"], -0.25, [Node(0.0, 4.0, feature="a", edge=0.5, left=Node(0.1, 1.0), right=Node(-0.1, 3.0, low=-0.2))])
    models.save_boosted(spark, trees, str(tmp_path / "trees.json"), "orders")
    assert models.load_boosted(spark, str(tmp_path / "trees.json")) == trees
