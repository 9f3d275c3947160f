"""The four learners that compete for a table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial
from threading import Lock

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

from tidemill.learning.cells import BINNED, WEIGHT
from tidemill.learning.forests import Forest
from tidemill.learning.preprocessing import FEATURES
from tidemill.learning.trees import Feature, GrownForest

LABEL = "__label"
SEED = 42

# Candidate names in the order in which they are tried.
CANDIDATES = ("xgboost", "random_forest", "extra_trees", "linear")
FORESTS = ("random_forest", "extra_trees")

BINS = 64
#: Extra trees: coarse split points, and the share of the rows that each tree is grown on.
_COARSE_BINS = 16
_SHARE = 0.8
#: Most node ids (rows times trees, four bytes each) kept between tree levels.
_CACHED_NODE_IDS = 250_000_000


@dataclass(frozen=True)
class Sizes:
    """Sizes of the tree models.

    Fixed values: 120 boosted trees of depth 5 with rate 0.1 for classes, 180
    with rate 0.08 for numbers, 220 forest trees.  Spark's deepest tree is 30.
    """

    boosted_classifier: int = 120
    boosted_regressor: int = 180
    boosted_depth: int = 5
    classifier_rate: float = 0.1
    regressor_rate: float = 0.08
    forest: int = 220
    forest_depth: int = 30
    #: Trees grow until leaves are pure or have so many rows, whatever the size of the table.
    min_rows_per_leaf: int = 1


def estimators(classification: bool, classes: int, rows: int, sizes: Sizes, parts: int = 1, tasks: int = 1) -> dict[str, Estimator | Forest]:
    """One estimator per candidate; forests are fitted in ``parts``, each on ``tasks`` tasks, and so many parts of all of them at a time.

    ``xgboost`` is Spark's gradient-boosted trees, which are fitted on cells (:mod:`tidemill.learning.cells`).  Spark has no extremely
    randomised trees: ``extra_trees`` approximates them by trees on unbootstrapped
    subsamples with random feature subsets and coarse split points.
    """
    columns = {"featuresCol": FEATURES, "labelCol": LABEL}
    cells = {"featuresCol": BINNED, "labelCol": LABEL, "weightCol": WEIGHT}
    boosted = {**cells, "maxDepth": sizes.boosted_depth, "maxBins": BINS, "seed": SEED}
    forest = {
        **columns,
        "maxDepth": sizes.forest_depth,
        "minInstancesPerNode": sizes.min_rows_per_leaf,
        # Room for the statistics of many nodes, so that a level takes few passes.
        "maxMemoryInMB": 1024,
        # Deep forests on few rows go faster with each row's node remembered;
        # on many rows that would cost more storage than the table itself.
        "cacheNodeIds": rows * sizes.forest <= _CACHED_NODE_IDS,
    }

    pool = ThreadPoolExecutor(parts)

    def trees(learner: type[Estimator], **options) -> Forest:
        return Forest(partial(learner, **options), sizes.forest, SEED, parts, tasks, pool)

    random = {**forest, "bootstrap": False, "subsamplingRate": _SHARE, "maxBins": _COARSE_BINS}
    if not classification:
        return {
            "xgboost": GBTRegressor(maxIter=sizes.boosted_regressor, stepSize=sizes.regressor_rate, **boosted),
            "random_forest": trees(RandomForestRegressor, featureSubsetStrategy="all", maxBins=BINS, **forest),
            "extra_trees": trees(RandomForestRegressor, featureSubsetStrategy="onethird", **random),
            "linear": LinearRegression(regParam=0.0, **columns),
        }
    boost = GBTClassifier(maxIter=sizes.boosted_classifier, stepSize=sizes.classifier_rate, **boosted)
    return {
        "xgboost": boost if classes <= 2 else OneVsRest(classifier=boost, **cells),
        "random_forest": trees(RandomForestClassifier, featureSubsetStrategy="sqrt", maxBins=BINS, **forest),
        "extra_trees": trees(RandomForestClassifier, featureSubsetStrategy="sqrt", **random),
        # An L2 penalty of 1 on the summed loss, on features that are scaled already.
        "linear": LogisticRegression(maxIter=2000, regParam=1.0 / max(1, rows), standardization=False, **columns),
    }


def grown(names: list[str], features: list[Feature], size: int, sizes: Sizes, tasks: int) -> dict[str, GrownForest]:
    """The forests for numbers once more, as learners whose trees are grown by ``tasks`` tasks, one forest after the other."""
    turn = Lock()

    def forest(bins: int, share: float | None, chosen: int) -> GrownForest:
        return GrownForest(features, size, LABEL, sizes.forest, SEED, sizes.forest_depth, sizes.min_rows_per_leaf, bins, share, chosen, tasks, turn)

    both = {"random_forest": lambda: forest(BINS, None, size), "extra_trees": lambda: forest(_COARSE_BINS, _SHARE, -(-size // 3))}
    return {n: both[n]() for n in names}


def importances(model: Model) -> list[float] | None:
    """Impurity importances, or mean absolute coefficients over the classes."""
    if hasattr(model, "featureImportances"):
        return [float(v) for v in model.featureImportances.toArray()]
    if hasattr(model, "models"):
        each = [importances(m) for m in model.models]
        return [sum(v) / len(each) for v in zip(*each)]
    if hasattr(model, "coefficientMatrix"):
        return [float(v) for v in abs(model.coefficientMatrix.toArray()).mean(axis=0)]
    if hasattr(model, "coefficients"):
        return [abs(float(v)) for v in model.coefficients.toArray()]
    return None
