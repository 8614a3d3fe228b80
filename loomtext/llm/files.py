"""Files that Spark lists and tasks read by ranges or as streams."""

from __future__ import annotations

from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame


def opened(uri: str):
    """A file for reading at any place, by the path that Spark lists it with."""
    uri = quote("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri, safe=":/@")
    store, name = pa.fs.FileSystem.from_uri(uri)
    return store.open_input_file(name)


def opens(files: DataFrame) -> bool:
    """Whether Arrow opens the store of a ``binaryFile`` listing; true for an empty one."""
    first = files.select("path").first()
    if first is None:
        return True
    try:
        opened(first["path"]).close()
        return True
    except (pa.ArrowException, OSError, ImportError):
        return False
