"""Where a model of a plug-in should run."""

from __future__ import annotations

ORDER = ("cuda", "xpu", "mps")


def pick_device(wanted: str | None = None) -> str:
    """The device asked for, else the best that torch finds, else the CPU; a worker asks, as the driver may have others."""
    if wanted and wanted != "auto":
        return wanted
    try:
        import torch
    except ImportError:
        return "cpu"
    there = {"cuda": lambda: torch.cuda.is_available(), "xpu": lambda: hasattr(torch, "xpu") and torch.xpu.is_available(), "mps": lambda: torch.backends.mps.is_available()}
    return next((d for d in ORDER if there[d]()), "cpu")
