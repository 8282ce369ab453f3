"""Pipelines: named steps over DataFrames in one session, and command lines for steps that are scripts."""

from __future__ import annotations

import json
import os
import shlex
import subprocess
import sys
import time
from collections.abc import Callable, Mapping
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame


def build_command(step: Mapping[str, Any]) -> list[str]:
    """The step's python (this one, if it names none), its script, and its args as flags: _ becomes -, True a bare flag,
    False nothing, a list its items after one flag."""
    script, args = step.get("script"), step.get("args") or {}
    if not script:
        raise ValueError("a step needs a script")
    if not isinstance(args, Mapping):
        raise ValueError("a step's args are a mapping")
    out = [str(step.get("python") or sys.executable), str(script)]
    for key, value in args.items():
        if value is False:
            continue
        out.append("--" + str(key).replace("_", "-"))
        if value is not True:
            out += [str(v) for v in value] if isinstance(value, (list, tuple)) else [str(value)]
    return out


def command_text(command: list[str]) -> str:
    return shlex.join(command)


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def _save(log: dict, path: str | None) -> None:
    if path:
        log["updated_at"] = _now()
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(log, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def checked_steps(config: Mapping[str, Any]) -> list[tuple[str, list[str]]]:
    """Name (step_N if it has none) and command of each step; ValueError for anything of the wrong kind."""
    steps = config.get("steps") or []
    if not isinstance(steps, list):
        raise ValueError("a configuration's steps are a list")
    for k, step in enumerate(steps, 1):
        if not isinstance(step, Mapping):
            raise ValueError(f"step {k} is not a mapping")
    return [(str(step.get("name") or f"step_{k}"), build_command(step)) for k, step in enumerate(steps, 1)]


def run_commands(config: Mapping[str, Any], dry_run: bool = False, log_file: str | None = None) -> dict:
    """Runs a configuration's steps one after the other under its env. All steps are checked before the first runs. The log
    (at log_file, or where the configuration says) is rewritten after each: its command, status (success, failed, or
    dry_run), return code, times and duration. The first step that fails is logged and raises CalledProcessError."""
    commands, extra = checked_steps(config), config.get("env") or {}
    if not isinstance(extra, Mapping):
        raise ValueError("a configuration's env is a mapping")
    where = log_file or config.get("log_file")
    log: dict = {"name": config.get("name"), "dry_run": dry_run, "started_at": _now(), "updated_at": None, "steps": []}
    env = {**os.environ, **{str(k): str(v) for k, v in extra.items()}}
    for name, command in commands:
        began, clock = _now(), time.monotonic()
        code = None if dry_run else subprocess.run(command, env=env).returncode
        status = "dry_run" if dry_run else "failed" if code else "success"
        log["steps"].append({"name": name, "command": command, "command_text": command_text(command), "status": status, "returncode": code, "started_at": began, "finished_at": _now(), "duration_seconds": round(time.monotonic() - clock, 3)})
        _save(log, where)
        if code:
            raise subprocess.CalledProcessError(code, command)
    _save(log, where)
    return log


Step = tuple[str, Callable[..., DataFrame], dict[str, Any]]


def run_steps(df: DataFrame, steps: list[Step], log_file: str | None = None) -> DataFrame:
    """df through named transforms with their keyword arguments. Nothing is computed in between: Catalyst sees one plan."""
    log: dict = {"steps": []}
    for name, transform, options in steps:
        df = df.transform(transform, **options)
        log["steps"].append({"name": name, "options": {k: str(v) for k, v in options.items()}, "columns": df.columns})
        _save(log, log_file)
    return df
