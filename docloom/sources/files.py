"""Files that tasks write and read by themselves, in any folder that Spark and Arrow both know."""

from __future__ import annotations

from pyarrow import fs

#: Names that Spark has for stores and Arrow's names for them.
ALIASES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}
KNOWN = ("file", "hdfs", "viewfs", "s3", "gs", "gcs", "abfs", "abfss")


def arrow_uri(path: str) -> str:
    """A path of Spark's as Arrow names it; a scheme that Arrow doesn't know is refused, on the driver, before a job begins."""
    if path.startswith("file:"):
        return "file:///" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return f"file://{path}"
    scheme, rest = path.split("://", 1)
    scheme = ALIASES.get(scheme.lower(), scheme.lower())
    if scheme not in KNOWN:
        raise ValueError(f"tasks can't write to {path}: set spark.checkpoint.dir to one of {', '.join((*ALIASES, *KNOWN))}")
    return f"{scheme}://{rest}"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it."""
    return fs.FileSystem.from_uri(arrow_uri(path))
