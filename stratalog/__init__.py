"""A versioned record log and its queries on Spark."""

from __future__ import annotations

import platform
import subprocess
from dataclasses import dataclass
from pathlib import Path

__version__ = "0.2.0"


@dataclass(frozen=True)
class BuildInfo:
    name: str
    version: str
    commit: str | None
    python: str
    spark: str


def build_info() -> BuildInfo:
    """What is running: name, version, commit (None without a repository), Python and Spark."""
    import pyspark

    try:
        commit = subprocess.run(["git", "rev-parse", "HEAD"], cwd=Path(__file__).parent, capture_output=True, text=True, timeout=10).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        commit = None
    return BuildInfo(__name__, __version__, commit, platform.python_version(), pyspark.__version__)
