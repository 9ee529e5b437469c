"""sparkprep: table preparation, feature engineering, model training and
evaluation expressed as Spark DataFrame / pyspark.ml jobs.

Every public operator takes a DataFrame and returns a DataFrame.  Only
bounded results (one-row statistics, a vocabulary capped by
``max_features``, per-partition counts, fitted model parameters) ever reach
the driver.
"""

from sparkprep.session import get_spark, scratch_path

_LAZY = {
    "apply_operations": ("sparkprep.plans.operations", "apply_operations"),
    "run_operations": ("sparkprep.plans.operations", "run_operations"),
    "read": ("sparkprep.sources.io", "read"),
    "write": ("sparkprep.sources.io", "write"),
}

__all__ = ["get_spark", "scratch_path", *_LAZY]


def __getattr__(name: str):  # noqa: ANN202 - PEP 562 lazy exports
    if name in _LAZY:
        import importlib
        mod, attr = _LAZY[name]
        return getattr(importlib.import_module(mod), attr)
    raise AttributeError(name)
