"""Dumps from a web server into a folder: gone on with where a transfer broke, in place only when whole.

Files come to the driver one after another. On a cluster the folder must be one
that the executors see too, as for any input.
"""

from __future__ import annotations

import gzip
import shutil
import time
import zlib
from collections.abc import Callable
from http.client import HTTPException
from pathlib import Path
from urllib.request import Request, urlopen

from marlstone.sources.catalog import DATASETS, select_datasets

#: Transfers tried for a file, the longest wait between two in seconds, and free bytes asked for each byte to come (fixed values).
ATTEMPTS, LONGEST_WAIT, HEADROOM = 6, 30, 1.5
TIMEOUT = 60


def remote_bytes(url: str) -> int:
    """Length of a file, from the server's headers or else from the range it names when asked for one byte."""
    try:
        with urlopen(Request(url, method="HEAD"), timeout=TIMEOUT) as answer:
            if (said := answer.headers.get("Content-Length")) is not None:
                return int(said)
    except (OSError, HTTPException):
        pass  # not every server answers HEAD
    with urlopen(Request(url, headers={"Range": "bytes=0-0"}), timeout=TIMEOUT) as answer:
        whole = answer.headers.get("Content-Range", "").rpartition("/")[2]
    if not whole.isdigit():
        raise ValueError(f"the server does not say how long {url} is")
    return int(whole)


def _go_on(url: str, part: Path, total: int) -> None:
    """Appends what part lacks. A part that is too long, or a server that sends the whole file, starts it anew."""
    held = part.stat().st_size
    if held == total:
        return
    wanted = {"Range": f"bytes={held}-"} if 0 < held < total else {}
    with urlopen(Request(url, headers=wanted), timeout=TIMEOUT) as answer, open(part, "ab" if answer.status == 206 else "wb") as out:
        shutil.copyfileobj(answer, out, 1 << 20)


def fetch(url: str, target: str | Path, *, again: bool = False, wait: Callable[[float], None] = time.sleep) -> str:
    """Brings url to target: "skipped" if target has the server's length, else "downloaded", or "resumed" if it took several transfers.

    Bytes are held in a file named .part, which becomes target when its length is
    the server's and, for a .gz name, its first line is a header with tabs. again
    ignores what is there. After the last transfer that fails the part stays, to
    be gone on with by the next call.
    """
    total, target = remote_bytes(url), Path(target)
    part = target.with_name(target.name + ".part")
    if again:
        part.unlink(missing_ok=True)
    elif target.exists() and target.stat().st_size == total:
        return "skipped"
    part.touch()
    several, fault = part.stat().st_size > 0, None
    for attempt in range(ATTEMPTS):
        if attempt:
            several = True
            wait(min(2**attempt, LONGEST_WAIT))
        try:
            _go_on(url, part, total)
        except (OSError, HTTPException) as e:
            fault = e
        if part.stat().st_size == total:
            break
    else:
        raise OSError(f"{url}: {part.stat().st_size} of {total} bytes after {ATTEMPTS} transfers") from fault
    if target.suffix == ".gz" and not _has_header(part):
        part.unlink()
        raise OSError(f"{url} is no compressed file with a header")
    part.replace(target)
    return "resumed" if several else "downloaded"


def _has_header(path: Path) -> bool:
    try:
        with gzip.open(path) as f:
            return b"\t" in f.readline()
    except (OSError, EOFError, zlib.error):
        return False


def fetch_datasets(base: str, folder: str | Path, names: list[str] | None = None, *, optional: bool = False, again: bool = False, wait: Callable[[float], None] = time.sleep) -> dict[str, str]:
    """fetch() of the datasets' files under the address base, by name. Nothing is fetched unless the free space is HEADROOM times what is missing."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    files = {n: DATASETS[n].file for n in select_datasets(names, optional)}
    url = lambda file: f"{base.rstrip('/')}/{file}"
    missing = sum(remote_bytes(url(file)) for file in files.values() if again or not (folder / file).exists())
    free = shutil.disk_usage(folder).free
    if free < HEADROOM * missing:
        raise OSError(f"{missing} bytes to come, but only {free} free in {folder}")
    return {n: fetch(url(file), folder / file, again=again, wait=wait) for n, file in files.items()}
