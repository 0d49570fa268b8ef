"""Run receipts and failure markers around a job that writes a folder."""

from __future__ import annotations

import hashlib
import platform
import sys
import uuid
from contextlib import contextmanager
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

import pyspark

from .storage import Place
from .tables import require_fresh


def receipt(inputs: dict[str, str], outputs: dict[str, str], seed: int | None = None, **extra: Any) -> dict[str, Any]:
    """Who ran what on which content. Inputs and outputs are named digests."""
    return {
        "schema_version": "1.0",
        "run_utc": datetime.now(timezone.utc).isoformat(),
        "command": ["python", *sys.argv],
        "software": {"python": platform.python_version(), "pyspark": pyspark.__version__},
        "seed": seed,
        "input_sha256": inputs,
        "output_sha256": outputs,
        **extra,
    }


def implementation() -> str:
    """SHA-256 over the source files of this package, by name."""
    root = Path(__file__).resolve().parent.parent
    parts = sorted(p for p in root.rglob("*.py") if p.relative_to(root).parts[0] != "llm")
    whole = hashlib.sha256()
    for part in parts:
        whole.update(f"{part.relative_to(root).as_posix()}\0{hashlib.sha256(part.read_bytes()).hexdigest()}\n".encode())
    return whole.hexdigest()


@contextmanager
def guarded_folder(path: str | Path | Place):
    """A folder that a job fills out of sight and that gets its name only when all of it is there.

    The job writes beside the target, in a folder whose name starts with ``_`` and which readers
    therefore skip; one rename makes it visible. So a killed job leaves no target.
    A job that fails leaves a marker in the target and nothing else.
    """
    target = require_fresh(path)
    work = target.parent / f"_{target.name}-{uuid.uuid4().hex}"
    work.make()
    try:
        yield work
        if target.exists():
            target.remove()  # empty, or this fails
        work.rename(target)
    except Exception:
        work.remove(whole=True)
        target.make()
        (target / "FAILED.txt").write_text("This run did not end; there is no output.\n")
        raise
