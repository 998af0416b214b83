"""Watch mode in the background: a process of its own, with its number and its log in the data folder."""

from __future__ import annotations

import os
import signal
import subprocess
import sys
import time
from pathlib import Path


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


def running(data_dir: str) -> int | None:
    """The number of the process that watches, if there is one; a stale note of one is removed."""
    note = Path(data_dir) / "watch.pid"
    try:
        pid = int(note.read_text())
    except (FileNotFoundError, ValueError):
        return None
    if _alive(pid):
        return pid
    note.unlink(missing_ok=True)
    return None


def start(data_dir: str, arguments: list[str], command: list[str] | None = None) -> str:
    """Run the command line again with these arguments, apart from this process."""
    if pid := running(data_dir):
        return f"already watching: process {pid}"
    folder = Path(data_dir)
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / "watch.log", "ab") as log:
        process = subprocess.Popen((command or [sys.executable, "-m", "loamdex.cli"]) + arguments, stdin=subprocess.DEVNULL, stdout=log, stderr=log, start_new_session=True)
    (folder / "watch.pid").write_text(str(process.pid))
    return f"watching: process {process.pid}, log {folder / 'watch.log'}"


def stop(data_dir: str, wait: float = 10.0) -> str:
    """Ask the watching process to end, and wait for it."""
    pid = running(data_dir)
    if pid is None:
        return "not watching"
    os.kill(pid, signal.SIGTERM)
    until = time.monotonic() + wait
    while _alive(pid) and time.monotonic() < until:
        try:  # a child of ours has to be waited for
            os.waitpid(pid, os.WNOHANG)
        except ChildProcessError:
            pass
        time.sleep(0.1)
    (Path(data_dir) / "watch.pid").unlink(missing_ok=True)
    return f"stopped: process {pid}"
