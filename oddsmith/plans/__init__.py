from oddsmith.plans.experiment import (
    ExperimentData,
    PreparedData,
    Run,
    fit_on,
    prepare,
    run_experiment,
    run_experiments,
)
from oddsmith.plans.runlog import RUN_LOG_SCHEMA, append_run_log, best_run, run_log_rows

__all__ = [
    "ExperimentData",
    "PreparedData",
    "RUN_LOG_SCHEMA",
    "Run",
    "append_run_log",
    "best_run",
    "fit_on",
    "prepare",
    "run_experiment",
    "run_experiments",
    "run_log_rows",
]
