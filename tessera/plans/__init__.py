"""Named queries over the fixture tables; importing ``load`` fills the registry."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
