"""tidemill: prepare, profile, chart and model tables with Spark.

Every operator takes a DataFrame and returns a DataFrame (or a small, bounded
report).  Data is never collected: the driver only ever sees single-row
statistics and top-k results.
"""

from tidemill.plans.cleaning import CleanResult, CleanSpec, clean
from tidemill.plans.profiling import Profile, profile
from tidemill.learning.training import TrainResult, TrainSpec, train
from tidemill.operators.charts import chart_series
from tidemill.roles import ROW, with_row_order

__all__ = [
    "ROW",
    "CleanResult",
    "CleanSpec",
    "Profile",
    "TrainResult",
    "TrainSpec",
    "chart_series",
    "clean",
    "profile",
    "train",
    "with_row_order",
]
