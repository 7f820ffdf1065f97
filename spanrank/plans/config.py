"""Where settings come from: argument, environment, project file, user file, default.

A project file applies to the folder it is in and all below it, the nearest one
counting.  Keys of endpoints are never read from or written to a project file.
"""

from __future__ import annotations

import json
import os
from dataclasses import fields
from pathlib import Path

from spanrank.plans.index import Settings

FILE, ENV = ".spanrank.json", "SPANRANK_"
KEYS = {f.name for f in fields(Settings)} | {"endpoint", "model"}
SECRET = "api_key"


def project_file(start: str) -> Path | None:
    """The nearest project file at or above a folder."""
    here = Path(start).resolve()
    return next((p / FILE for p in (here, *here.parents) if (p / FILE).is_file()), None)


def user_file(home: str | None = None) -> Path:
    return Path(home or Path.home()) / ".config" / "spanrank.json"


def read(path: Path | None) -> dict:
    if path is None or not path.is_file():
        return {}
    held = json.loads(path.read_text(encoding="utf-8"))
    unknown = set(held) - KEYS - {SECRET}
    if unknown:
        raise ValueError(f"{path}: unknown {', '.join(sorted(unknown))}")
    return held


def load(start: str, arguments: dict | None = None, environment: dict | None = None, home: str | None = None) -> tuple[Settings, dict]:
    """The settings for a folder, and the endpoint's address, model and key beside them."""
    environment = os.environ if environment is None else environment
    project = {k: v for k, v in read(project_file(start)).items() if k != SECRET}
    env = {k: environment[ENV + k.upper()] for k in KEYS | {SECRET} if ENV + k.upper() in environment}
    env |= {k: int(env[k]) for k in ("max_chars",) if k in env}
    layers = [{k: v for k, v in x.items() if k != "patterns" or v} for x in (arguments or {}, env, project, read(user_file(home)))]
    names = {f.name for f in fields(Settings)}
    rest = {k: next((x[k] for x in layers if x.get(k) is not None), None) for k in ("endpoint", "model", SECRET)}
    return Settings.resolve(*[{k: v for k, v in x.items() if k in names} for x in layers]), rest


def write(start: str, key: str, value, project: bool = False, home: str | None = None) -> Path:
    """Store one setting in the user's file, or in a project file at ``start``."""
    if key not in KEYS | {SECRET} or (project and key == SECRET):
        raise ValueError(f"{key} can't be set here")
    path = Path(start) / FILE if project else user_file(home)
    held = read(path) | {key: value}
    path.parent.mkdir(parents=True, exist_ok=True)
    draft = path.with_suffix(".new")
    draft.write_text(json.dumps(held, indent=1), encoding="utf-8")
    os.replace(draft, path)
    return path
