"""Files of Hadoop paths for Python workers, which reach storage through Arrow."""

from __future__ import annotations

from pyarrow import ArrowInvalid, fs

#: Hadoop's schemes that Arrow knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


class NoFileSystem(ValueError):
    pass


def arrow_uri(path: str) -> str:
    """A path as Arrow has it; one without a scheme is a local one."""
    scheme, colon, rest = path.partition(":/")
    if not colon:
        return f"file://{path}"
    return f"{SCHEMES.get(scheme, scheme)}:/{rest if rest.startswith('/') else f'//{rest}'}"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path, and the path in it. Call it on the driver too: a scheme that it doesn't know is refused before a job runs."""
    try:
        return fs.FileSystem.from_uri(arrow_uri(path))
    except (ArrowInvalid, ImportError) as e:
        known = "file, hdfs, s3 (s3a), gs (gcs), abfs, abfss"
        raise NoFileSystem(f"no file system for {path}: workers read and write {known}; give a folder on one of these") from e
