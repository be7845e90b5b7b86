"""Checkpoint-directory policy: shared folder from the session, local scratch only in local mode."""

import pytest

from answer_eval.session import ensure_checkpoint_dir


class _Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class _Context:
    def __init__(self, master, conf, current=None):
        self.master, self._conf, self._dir = master, _Conf(conf), current

    def getCheckpointDir(self):
        return self._dir

    def getConf(self):
        return self._conf

    def setCheckpointDir(self, path):
        self._dir = path


class _Session:
    def __init__(self, master, conf=None, current=None):
        self.sparkContext = _Context(master, conf or {}, current)
        self.conf = _Conf(conf or {})


def test_cluster_without_shared_dir_is_refused():
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Session("yarn"))


def test_configured_dir_is_used_and_existing_one_kept():
    s = _Session("spark://m:7077", {"spark.checkpoint.dir": "hdfs://nn/ckpt"})
    assert ensure_checkpoint_dir(s) == "hdfs://nn/ckpt"
    assert ensure_checkpoint_dir(_Session("yarn", current="hdfs://nn/other")) == "hdfs://nn/other"


def test_local_mode_gets_a_scratch_dir():
    s = _Session("local[2]")
    path = ensure_checkpoint_dir(s)
    assert path and "answer-eval-ckpt-" in path
