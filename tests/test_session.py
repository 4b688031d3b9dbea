import subprocess
import sys

import pytest
from pyspark import cloudpickle

from paperloom import session
from paperloom.operators import infer, vectors


def test_functions_need_no_package_on_the_executors(tmp_path):
    """Models and kernels are pickled by value: a process without the package can run them."""
    model, top = infer.KeywordClassifier({"a": "journal"}), vectors._TopK
    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps((model, infer.HashingEmbedder(4), top, infer.CLASSIFICATION)))
    code = (
        "import pickle, numpy as np\n"
        "model, embedder, top, spec = pickle.load(open('f.pkl', 'rb'))\n"
        "assert 'journal' in model.generate(['a'], spec)[0][0]\n"
        "assert len(embedder.embed(['x y'], '')[0]) == 4\n"
        "t = top(np.ones((1, 2)), 1); t.add(np.array([5], dtype=object), np.ones((1, 2)))\n"
        "assert [r[1] for r in t.rows()] == [5]\n"
        "import importlib.util; assert importlib.util.find_spec('paperloom') is None\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


class Stub:
    """A session with given settings."""

    def __init__(self, named, master, set_dir=None):
        self.conf = self.sparkContext = self
        self.named, self.master, self.set_dir = named, master, set_dir

    def get(self, key, default=None):
        return self.named if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return self.set_dir

    def setCheckpointDir(self, path):
        self.set_dir = f"file:{path}/x"


def test_shared_folder_comes_from_the_session():
    assert session.shared_dir(Stub("hdfs://shared/", "yarn")) == "hdfs://shared"
    assert session.shared_dir(Stub(None, "yarn", "s3a://bucket/x")) == "s3a://bucket/x"
    with pytest.raises(ValueError):
        session.shared_dir(Stub(None, "yarn"))
    fallback = Stub(None, "local[4]")
    assert session.shared_dir(fallback) == session.shared_dir(fallback)
    assert session.shared_dir(fallback).startswith("file:")


def test_written_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    rows = session.cut_lineage(spark.range(3), "rows")
    assert rows.count() == 3 and list(tmp_path.glob("rows-*"))
    with session.stored_copy(spark.range(4), "copy") as copy:
        assert copy.count() == 4
    assert not list(tmp_path.glob("copy-*"))
    with pytest.raises(RuntimeError), session.stored_copy(spark.range(4), "kept"):
        raise RuntimeError("stop")
    assert list(tmp_path.glob("kept-*"))
