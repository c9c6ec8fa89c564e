"""Registered queries, by family."""

from importlib import import_module

FAMILIES = (
    "series_queries",
    "feature_queries",
    "quality_queries",
    "join_queries",
    "rollup_queries",
    "ranking_queries",
    "set_queries",
    "statistics_queries",
    "split_queries",
    "evaluation_queries",
    "model_queries",
    "gate_queries",
    "ingest_queries",
    "streaming_queries",
)


def load_all() -> None:
    for f in FAMILIES:
        try:
            import_module(f"wavetable.plans.{f}")
        except ModuleNotFoundError as e:
            if e.name != f"wavetable.plans.{f}":
                raise
