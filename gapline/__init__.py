"""Session analytics on timestamped events, written as Spark jobs.

Events of one user that follow each other within a gap form a *round*. The
package splits event logs into rounds, computes one feature row per round,
trains and applies a boosted-tree forecaster, follows arriving files as a
stream, and reports drift.
"""

from gapline.functions.time import elapsed_seconds, epoch_micros, parse_time
from gapline.operators.features import (
    compute_round_features,
    event_type_labels,
    label_counts,
    label_maps,
    round_features,
)
from gapline.operators.folds import fold_bounds, time_series_folds
from gapline.operators.latest import latest_rounds
from gapline.operators.rank import with_global_rank
from gapline.operators.sessionize import round_bounds, sessionize
from gapline.operators.sessions import session_rounds
from gapline.plans.demo import add_target, run_demo
from gapline.plans.etl import run_etl
from gapline.plans.forecasting import forecast
from gapline.plans.incremental import open_store
from gapline.plans.monitoring import feature_drift, model_degradation, retrain_decision
from gapline.plans.sketches import drift_from_sketches, feature_sketches
from gapline.plans.training import (
    best_iteration,
    feature_columns,
    feature_matrix,
    train_baseline,
)
from gapline.session import make_session
from gapline.sources.recordings import read_features, read_recordings, save_by_user, write_features
from gapline.sources.rejects import split_rejects
from gapline.streaming.rounds import index_closed_rounds, stream_rounds

__version__ = "0.1.0"

__all__ = [
    "add_target",
    "best_iteration",
    "compute_round_features",
    "elapsed_seconds",
    "epoch_micros",
    "drift_from_sketches",
    "event_type_labels",
    "feature_columns",
    "feature_drift",
    "feature_matrix",
    "feature_sketches",
    "fold_bounds",
    "forecast",
    "index_closed_rounds",
    "label_counts",
    "label_maps",
    "latest_rounds",
    "make_session",
    "model_degradation",
    "open_store",
    "parse_time",
    "read_features",
    "read_recordings",
    "retrain_decision",
    "round_bounds",
    "round_features",
    "run_demo",
    "run_etl",
    "save_by_user",
    "session_rounds",
    "sessionize",
    "split_rejects",
    "stream_rounds",
    "time_series_folds",
    "train_baseline",
    "with_global_rank",
    "write_features",
]
