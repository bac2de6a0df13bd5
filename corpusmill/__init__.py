"""Dataset preparation on PySpark: declared in YAML or Python, planned by Catalyst."""

import importlib

_WHERE = {
    "Context": "operators.base", "Processor": "operators.base", "TokenizerSpec": "functions.tokens", "load_tokenizer": "functions.tokens",
    "apply_all": "operators.pipeline", "create_processor": "operators.pipeline", "register_processor": "operators.pipeline",
    "get_mm_plugin": "functions.media", "register_mm_plugin": "functions.media", "load_config": "plans.config",
    "Prepared": "plans.prepare", "load_datasets": "plans.prepare", "prepare": "plans.prepare", "load_strategy": "plans.strategies", "register_strategy": "plans.strategies",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    """Loaded when used: Python workers import this package for a part of it only."""
    if name not in _WHERE:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"{__name__}.{_WHERE[name]}"), name)
