"""Saving files to a folder all executors share."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNK = 8192


def check_target(path: str, required_bytes: int = 0) -> dict:
    """What the file system says about a download folder; ``functions.requests.check_path`` judges it."""
    text = path.strip() if path else ""
    if not text:
        return {"path": "", "exists": False, "is_dir": False, "writable": False, "free": None, "required": required_bytes}
    full = os.path.abspath(os.path.expanduser(text))
    near = full
    while not os.path.exists(near) and near != os.path.dirname(near):
        near = os.path.dirname(near)
    return {
        "path": full,
        "exists": os.path.exists(full),
        "is_dir": os.path.isdir(full),
        "writable": os.access(near, os.W_OK),
        "free": shutil.disk_usage(near).free,
        "required": required_bytes,
    }


def create_folder(path: str) -> tuple[bool, str]:
    full = os.path.abspath(os.path.expanduser(path))
    try:
        os.makedirs(full, exist_ok=True)
        return True, full
    except PermissionError:
        return False, "Permission denied"
    except OSError as error:
        return False, str(error)


class StopMarker:
    """A file that tells running tasks to stop: call it to set it, ask ``seen`` in a task.  The path must be shared."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file:")

    def __call__(self) -> None:
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        open(self.path, "w").close()

    def seen(self) -> bool:
        return os.path.exists(self.path)


SAVED = (
    T.StructType()
    .add("url", "string").add("saved_name", "string").add("succeeded", "boolean").add("message", "string")
    .add("bytes", "long")
)


CANCELLED = "Download cancelled"


def save_files(
    files: DataFrame, folder: str, open_stream: Callable[[str], Iterable[bytes]], stopped: Callable[[], bool] = lambda: False
) -> DataFrame:
    """Stream each ``url`` into ``folder/saved_name``: ``url, saved_name, succeeded, message, bytes``.

    Files are written under a temporary name and renamed when complete, so a lost task leaves no
    half file under a final name and its repeat simply writes again.  ``stopped`` is asked in the tasks before each
    file and each piece of one: once it says so no file is finished any more, and the rest are listed as cancelled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, name in zip(batch["url"], batch["saved_name"]):
                final = os.path.join(folder, name)
                part = f"{final}.part-{os.getpid()}"
                size = 0
                try:
                    if stopped():
                        raise InterruptedError(CANCELLED)
                    with open(part, "wb") as out:
                        for chunk in open_stream(url):
                            if stopped():
                                raise InterruptedError(CANCELLED)
                            out.write(chunk)
                            size += len(chunk)
                    os.replace(part, final)
                    rows.append((url, name, True, "Downloaded successfully", size))
                except TimeoutError:
                    rows.append((url, None, False, "Download timed out", None))
                except ConnectionError as error:
                    rows.append((url, None, False, f"Connection error: {error}", None))
                except Exception as error:
                    rows.append((url, None, False, str(error), None))
                if os.path.exists(part):
                    os.remove(part)
            yield pd.DataFrame(rows, columns=SAVED.fieldNames(), dtype="object")

    return files.select("url", "saved_name").mapInPandas(run, SAVED)
