"""Files of raw bytes in the shared folder, written by tasks and named in a manifest that Spark stores."""

import os
import uuid
from urllib.parse import unquote, urlparse

from ..functions.storage import ensure_checkpoint_dir


def shared_folder(spark, name):
    """A new folder below the checkpoint folder, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"


def write_bytes(uri, data):
    """Write a whole file. Only a manifest row of the task that succeeds names it, so a lost attempt leaves no trace."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        path = unquote(parsed.path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as out:
            out.write(data)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(path), recursive=True)
        with store.open_output_stream(path) as out:
            out.write(data)


def read_bytes(uri):
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        with open(unquote(parsed.path), "rb") as source:
            return source.read()
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as source:
        return source.read()
