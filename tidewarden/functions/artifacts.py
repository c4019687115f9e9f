"""JSON artifacts with a manifest that holds their SHA-256."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path


def save_artifact(path: str | Path, content: dict, **facts) -> None:
    """Sorted, indented JSON with a newline, and a manifest with its SHA-256."""
    data = (json.dumps(content, indent=2, sort_keys=True, default=str) + "\n").encode()
    Path(path).write_bytes(data)
    Path(f"{path}.manifest.json").write_text(json.dumps({"sha256": hashlib.sha256(data).hexdigest(), **facts}, indent=2, sort_keys=True) + "\n")


def load_artifact(path: str | Path) -> dict:
    """A JSON artifact whose manifest (path + .manifest.json) holds its SHA-256."""
    data = Path(path).read_bytes()
    manifest = json.loads(Path(f"{path}.manifest.json").read_text())
    if hashlib.sha256(data).hexdigest() != manifest["sha256"]:
        raise ValueError(f"checksum of {path} doesn't match its manifest")
    return json.loads(data)
