"""Interfaces to media tools, each with a stub that needs none.

A tool is a command line; :func:`run_tool` runs one with a time limit and turns a missing tool,
a failure and a timeout into :class:`ToolError`. Pipelines take an object with the methods of
:class:`Media`; :class:`StubMedia` answers with constants.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol


class ToolError(RuntimeError):
    pass


@dataclass(frozen=True)
class ToolResult:
    code: int
    out: str
    err: str


def run_tool(command: list[str], timeout: float = 30.0) -> ToolResult:
    if shutil.which(command[0]) is None:
        raise ToolError(f"{command[0]} is not installed")
    try:
        done = subprocess.run(command, capture_output=True, text=True, timeout=timeout)
    except subprocess.TimeoutExpired as e:
        raise ToolError(f"{command[0]} took more than {timeout:g} s") from e
    if done.returncode:
        raise ToolError(f"{command[0]} failed ({done.returncode}): {done.stderr.strip()[:500]}")
    return ToolResult(done.returncode, done.stdout, done.stderr)


class Media(Protocol):
    def duration(self, path: str) -> float: ...
    def frame(self, path: str, at: float) -> bytes: ...
    def text(self, image: bytes) -> tuple[str, list[float]]: ...
    def cut(self, source: str, start: float, seconds: float, target: str) -> None: ...


class StubMedia:
    """Constant answers: 600 seconds, one black pixel, no text, an empty file."""

    def duration(self, path: str) -> float:
        return 600.0

    def frame(self, path: str, at: float) -> bytes:
        return b"\x00"

    def text(self, image: bytes) -> tuple[str, list[float]]:
        return "", []

    def cut(self, source: str, start: float, seconds: float, target: str) -> None:
        open(target, "wb").close()


class ToolMedia:
    """The same by way of installed tools."""

    def duration(self, path: str) -> float:
        return float(run_tool(["ffprobe", "-v", "error", "-show_entries", "format=duration", "-of", "csv=p=0", path]).out)

    def frame(self, path: str, at: float) -> bytes:
        run_tool(["ffmpeg", "-v", "error", "-y", "-ss", f"{at:g}", "-i", path, "-frames:v", "1", f"{path}.frame.png"])
        with open(f"{path}.frame.png", "rb") as f:
            return f.read()

    def text(self, image: bytes) -> tuple[str, list[float]]:
        for mode in ("7", "6"):  # a line, then a block if that reads nothing
            done = subprocess.run(["tesseract", "-", "-", "--psm", mode, "tsv"], input=image, capture_output=True, timeout=60)
            words = [r for r in (line.split("\t") for line in done.stdout.decode().splitlines()[1:]) if len(r) == 12 and r[11].strip()]
            if words:
                return " ".join(r[11] for r in words), [float(r[10]) for r in words for _ in r[11]]
        return "", []

    def cut(self, source: str, start: float, seconds: float, target: str) -> None:
        run_tool(["ffmpeg", "-v", "error", "-y", *input_flags("off"), "-ss", f"{start:g}", "-t", f"{seconds:g}", "-i", source, *output_flags("off"), target], timeout=3600)


#: Flags of the repair modes, before the input and before the output.
REPAIR = {
    "off": ([], ["-c", "copy"]),
    "safe": (["-fflags", "+genpts"], ["-c", "copy", "-avoid_negative_ts", "make_zero"]),
    "aggressive": (["-fflags", "+genpts+igndts", "-err_detect", "ignore_err"], ["-c", "copy", "-avoid_negative_ts", "make_zero", "-max_interleave_delta", "0"]),
}


def _mode(repair: str) -> tuple[list[str], list[str]]:
    if repair not in REPAIR:
        raise ValueError(f"unknown repair mode {repair!r}; there are {', '.join(REPAIR)}")
    return REPAIR[repair]


def input_flags(repair: str) -> list[str]:
    return _mode(repair)[0]


def output_flags(repair: str) -> list[str]:
    return _mode(repair)[1]


def cut_commands(slices: list[tuple[str, float, float]], target: str, repair: str = "off") -> Iterator[list[str]]:
    """One command for one slice; for more, a transport stream each and one that joins them."""
    before, after = _mode(repair)
    if len(slices) == 1:
        path, start, seconds = slices[0]
        yield ["ffmpeg", "-y", *before, "-ss", f"{start:.3f}", "-t", f"{seconds:.3f}", "-i", path, *after, target]
        return
    parts = [f"{target}.{k:03d}.ts" for k in range(len(slices))]
    for part, (path, start, seconds) in zip(parts, slices, strict=True):
        yield ["ffmpeg", "-y", *before, "-ss", f"{start:.3f}", "-t", f"{seconds:.3f}", "-i", path, *after, "-f", "mpegts", part]
    yield ["ffmpeg", "-y", "-i", "concat:" + "|".join(parts), *after, target]


def track_log(media_path: str) -> str:
    return run_tool(["vcd-info", "--no-banner", "-i", media_path]).out
