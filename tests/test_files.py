"""Folders as Spark names them, opened by tasks."""

import pytest
from docloom.sources.files import arrow_uri, opened


@pytest.mark.parametrize("path, uri", [("/a/b", "file:///a/b"), ("file:/a/b", "file:///a/b"), ("file:///a", "file:///a"), ("s3a://bucket/x", "s3://bucket/x"), ("S3N://bucket/x", "s3://bucket/x"), ("hdfs://n:9000/x", "hdfs://n:9000/x"), ("wasbs://c@a/x", "abfss://c@a/x"), ("gs://b/x", "gs://b/x")])
def test_schemes(path, uri):
    assert arrow_uri(path) == uri


def test_unknown_schemes_are_refused_at_once():
    with pytest.raises(ValueError, match="dbfs"):
        arrow_uri("dbfs://x/y")


def test_a_local_folder(tmp_path):
    files, path = opened(str(tmp_path))
    assert path == str(tmp_path) and files.get_file_info(path).is_file is False
