"""Query catalogue; importing it registers every family."""

import importlib

FAMILIES = [
    "sources", "expressions", "quality", "joins", "aggregates", "windows", "topk", "sets", "scoring",
    "backtest", "inference", "streams", "sites",
]


def load_all() -> None:
    for name in FAMILIES:
        importlib.import_module(f"dayloom.plans.{name}")
