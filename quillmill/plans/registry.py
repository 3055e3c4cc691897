"""The queries of the library's own operators, by name, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from ..operators import characters, detector, forensics, genre, language, scoring, slop, structure, text, timeline
from ..sources import corpus, ingest, workspace
from ..streaming import logs
from . import engine

MODULES = [text, slop, detector, language, genre, characters, forensics, timeline, structure, scoring, logs, workspace, corpus, ingest, engine]


def queries() -> dict[str, Callable]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
