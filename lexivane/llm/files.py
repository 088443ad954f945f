"""Files in the shared folder, opened from executors: local, hdfs, s3 and gs addresses."""

from __future__ import annotations

from pyarrow import fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    fs, path = opened(uri)
    fs.create_dir(path, recursive=True)


def write_bytes(uri: str, data: bytes) -> None:
    fs, path = opened(uri)
    with fs.open_output_stream(path, compression=None) as out:
        out.write(data)


def read_bytes(uri: str) -> bytes:
    fs, path = opened(uri)
    with fs.open_input_stream(path, compression=None) as src:
        return src.read()


def remove(uri: str) -> None:
    """Deletes a file; one that an earlier attempt of the task has deleted is no error."""
    fs, path = opened(uri)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(path)
