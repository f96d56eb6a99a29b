"""Malformed input is rejected, not dropped."""

import pytest

from normlens.operators import vectors
from normlens.plans import relational
from normlens.sources.vectors import read_vector_text


def test_malformed_vector_line_raises(spark, tmp_path):
    (tmp_path / "v.txt").write_text("3 2\ngood 1 2\nbad 1 2 3\n")
    with pytest.raises(Exception, match="vector line without 2 values"):
        read_vector_text(spark, str(tmp_path / "v.txt")).collect()
    (tmp_path / "w.txt").write_text("2 2\ngood 1 2\nfine 3 4\n\n")
    assert sorted(tuple(r) for r in read_vector_text(spark, str(tmp_path / "w.txt")).collect()) == [
        ("fine", [3.0, 4.0]), ("good", [1.0, 2.0])]


def test_ragged_vectors_raise(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])], "k int, emb array<float>")
    with pytest.raises(ValueError, match="2 to 3 entries"):
        vectors.dimension(frame)
    with pytest.raises(Exception, match="without 2 entries"):
        vectors.widen(frame, "k", 2).collect()
    assert vectors.dimension(frame.limit(0)) == 0


def test_cluster_without_a_shared_folder_raises():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        relational.shared_folder(Session())
