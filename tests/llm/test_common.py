"""What the operators share: values for workers without the package, salted lookups, folders."""

import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from harrow.llm import common, decontaminate, language, toxicity, words


def test_values_need_no_package_on_workers(tmp_path):
    model = language.LanguageModel(["de", "en"], np.ones(1 << language.BUCKETS_LOG2), l1=0.0)
    model.learn(iter([("the cat", 1), ("die katze", 0)]))
    model.dense = model.ftrl.weights()
    severity = toxicity.SeverityModel(l1=0.0)
    severity.learn(iter([("bad words", 2), ("fine", 0)]))
    severity.dense = severity.ftrl.weights()
    index = decontaminate.Windows([("1", "a b c d e f")], 4, 2)
    (tmp_path / "values").write_bytes(cloudpickle.dumps([model.weights_only(), severity.weights_only(), index, words.hashes]))
    code = f"""
import pickle, sys
import pyspark.cloudpickle
sys.path = [p for p in sys.path if p not in ('', {str(sys.path[0])!r})]
model, severity, index, hashes = pickle.load(open({str(tmp_path / "values")!r}, 'rb'))
assert not any(m.split('.')[0] == 'harrow' for m in sys.modules)
print(model.predict('the cat')[0], len(severity.exceeds('bad')), len(index.rows), len(hashes(['a b', None])[0]))"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, timeout=120)
    assert said.stdout.split() == ["en", "2", "3", "2"], said.stderr


def test_matching_by_broadcast_and_by_salt(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 500, 1).otherwise(F.col("id")).alias("k"), "id")
    wanted = spark.createDataFrame([(1,), (600,), (5000,)], "k long")
    got = [sorted(map(tuple, common.matching(rows, wanted, "k", "id", most=most).select("k", "id").collect())) for most in (0, 1 << 20)]
    assert got[0] == got[1] and len(got[0]) == 501


def test_spans_are_merged(spark):
    spans = spark.createDataFrame([([(0, 5), (3, 9), (9, 11), (20, 21)],), ([],)], "s array<struct<start:int,stop:int>>")
    assert [[tuple(x) for x in r.m] for r in spans.select(common.merged(F.col("s")).alias("m")).collect()] == [[(0, 11), (20, 21)], []]


def test_word_hashes_whatever_the_pieces(monkeypatch):
    texts = ["a b", None, "", " ", "Ab aB\tx\ny\r\x0bz\x0c ", "é É", "a" * 200 + " b " + "c" * 49 + " d", "\x1cx y"]
    want = [h.tolist() for h in words.hashes(texts)]
    assert [len(h) for h in want] == [len((t or "").encode().split()) for t in texts]
    assert want[4][0] == want[4][1] and want[5][0] != want[5][1]
    for size in (1, 7, 50):
        monkeypatch.setattr(words, "PIECE", size)
        assert [h.tolist() for h in words.hashes(texts)] == want
    assert words.hashes([]) == []


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    unset = SimpleNamespace(get=lambda name, default=None: default)
    cluster = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="local-cluster[2,1,1024]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(cluster)


def test_batches_of_whole_texts_are_small(spark):
    before = spark.conf.get(common.BATCH_ROWS)
    try:
        for given, want in (("10000", "1000"), ("0", "1000"), ("7", "7")):
            spark.conf.set(common.BATCH_ROWS, given)
            common.small_batches(spark)
            assert spark.conf.get(common.BATCH_ROWS) == want
    finally:
        spark.conf.set(common.BATCH_ROWS, before)


def test_a_task_leaves_no_cycles_behind():
    """Globals of functions that came by value are cycles; an undecorated task leaves them to a later run of the collector."""
    import gc
    import weakref

    left = []

    def task(batches):
        for b in batches:
            cycle = type("Cycle", (), {})()
            cycle.own = cycle
            left.append(weakref.ref(cycle))
            yield b

    gc.disable()
    try:
        assert list(task(iter([1, 2]))) == [1, 2] and left[-1]() is not None
        left.clear()
        assert list(common.tidy(task)(iter([1, 2]))) == [1, 2] and all(x() is None for x in left)
    finally:
        gc.enable()
