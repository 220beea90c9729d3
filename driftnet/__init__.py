"""A PySpark-native engine that scans texts for credentials and prepares text corpora.

The names below load on first use, so that Python workers import only what they run."""

from importlib import import_module

_HOME = {"scan": "operators.scan", "ScanOptions": "operators.scan", "BUILT_IN": "plans.rules", "Rule": "plans.rules", "load_pack": "plans.rules", "select_rules": "plans.rules", "with_pack": "plans.rules"}
__all__ = list(_HOME)


def __getattr__(name: str):  # noqa: ANN202
    if name in _HOME:
        return getattr(import_module(f"driftnet.{_HOME[name]}"), name)
    raise AttributeError(name)
