"""Stored logs, settings, command line and streams."""

from __future__ import annotations

import io

import pytest
from pyspark.errors import AnalysisException

from kvlake import cli
from kvlake.model import OPS, RESERVED_PREFIX
from kvlake.operators import read
from kvlake.sources import config, store
from kvlake.streaming import ingest

from .model import live, random_ops


def pairs(df) -> dict[bytes, bytes]:
    return {bytes(r.key): bytes(r.value) for r in df.collect()}


def test_write_append_checkpoint_install(spark, tmp_path):
    ops = random_ops(1200, 90, 3)
    path = str(tmp_path / "log")
    store.write_sorted(spark.createDataFrame(ops[:600], OPS), path, partitions=3)
    store.append(spark.createDataFrame(ops[600:], OPS), path)
    log = store.open_ops(spark, path)
    assert pairs(read.latest_live(log)) == live(ops)
    root = str(tmp_path / "versions")
    for name, seq in (("v1", 400), ("v2", 1000)):
        store.checkpoint(log, seq, f"{root}/{name}")
    with pytest.raises(AnalysisException):
        store.checkpoint(log, 5, f"{root}/v1")
    assert store.current(spark, root) is None
    with pytest.raises(FileNotFoundError):
        store.open_current(spark, root)
    for name, seq in (("v1", 400), ("v2", 1000), ("v2", 1000)):
        assert pairs(read.latest_live(store.install(spark, root, name))) == live(ops, seq)
        assert store.current(spark, root) == name


def test_a_broken_swap_keeps_the_old_version(spark, tmp_path):
    store.set_current(spark, str(tmp_path), "v6")
    (tmp_path / "CURRENT.next").write_text("v7")
    assert store.current(spark, str(tmp_path)) == "v6"
    store.set_current(spark, str(tmp_path), "v8")
    assert store.current(spark, str(tmp_path)) == "v8" and not (tmp_path / "CURRENT.next").exists()


def test_checkpoints_hold_bookkeeping_keys(spark, tmp_path):
    rows = [(1, RESERVED_PREFIX + b"applied", 1, b"7"), (2, b"a", 1, b"x"), (3, b"a", 0, None), (4, b"b", 1, b"y")]
    store.checkpoint(spark.createDataFrame(rows, OPS), 4, str(tmp_path / "v"))
    assert {bytes(r.key) for r in store.open_ops(spark, str(tmp_path / "v")).collect()} == {RESERVED_PREFIX + b"applied", b"b"}


def test_server_settings():
    assert config.server_config() == config.ServerConfig()
    found = config.server_config('{"listen": "a:1", "log_level": "warn"}', {"listen": "b:2", "data_dir": ""})
    assert (found.listen, found.log_level, found.data_dir) == ("b:2", "warn", "data")
    for bad in ('{"bogus": 1}', '{"log_level": "loud"}'):
        with pytest.raises(config.ConfigError):
            config.server_config(bad)


NODE = '{"id": %d, "raft": "%s", "client": "%s"}'


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ('{"nodes": [%s]}' % NODE % (1, "a", "b"), ["groups: empty"]),
        ('{"groups": [0], "nodes": [%s]}' % NODE % (1, "a", "b"), ["groups[0]: not set"]),
        ('{"groups": [5, 6, 5], "nodes": [%s]}' % NODE % (1, "a", "b"), ["groups[0], groups[2]: one group 5"]),
        ('{"groups": [1]}', ["nodes: empty"]),
        ('{"groups": [1], "nodes": [%s, %s]}' % (NODE % (1, "a", "b"), NODE % (2, "c", "d")), ["nodes: 2 of them"]),
        ('{"groups": [1], "nodes": [%s]}' % NODE % (0, "a", "b"), ["nodes[0].id: not set"]),
        ('{"groups": [1], "nodes": [%s, %s, %s]}' % (NODE % (1, "a", "b"), NODE % (1, "c", "d"), NODE % (3, "e", "f")), ["nodes[0].id, nodes[1].id: one node 1"]),
        ('{"groups": [1], "nodes": [{"id": 1}]}', ["nodes[0].raft: not set", "nodes[0].client: not set"]),
        ('{"groups": [1], "nodes": [%s, %s, %s]}' % (NODE % (1, "same", "b"), NODE % (2, "c", "same"), NODE % (3, "e", "f")), ["nodes[0].raft, nodes[1].client: one address 'same'"]),
        ('{"groups": [1], "nodes": [], "bogus": 1}', ["field bogus"]),
        ('{"groups": [7, 7], "nodes": [{"raft": "a", "client": "b"}]}', ["one group 7", "nodes[0].id: not set"]),
    ],
)
def test_cluster_settings_name_all_faults(text, said):
    with pytest.raises(config.ConfigError) as e:
        config.cluster_config(text)
    assert all(x in str(e.value) for x in said)


def test_valid_cluster_settings():
    found = config.cluster_config('{"groups": [30, 10, 20], "nodes": [%s, %s, %s]}' % (NODE % (1, "a", "b"), NODE % (3, "c", "d"), NODE % (2, "e", "f")))
    assert found.sorted_groups() == [10, 20, 30] and found.peers() == {1: "a", 3: "c", 2: "e"}


def run(spark, data, *arguments) -> tuple[int, str, str]:
    out, err = io.StringIO(), io.StringIO()
    code = cli.main(["-data", data, *arguments], lambda: spark, out, err)
    return code, out.getvalue(), err.getvalue()


def test_command_line(spark, tmp_path):
    data = str(tmp_path / "data")
    assert run(spark, data, "get", "greeting")[0] == cli.NOT_FOUND
    assert run(spark, data, "put", "greeting", "hello")[0] == cli.OK
    assert run(spark, data, "get", "greeting") == (cli.OK, "hello\n", "")
    assert run(spark, data, "get", "-hex", "greeting")[1] == "68656c6c6f\n"
    for key, value in (("a1", "1"), ("a2", "2"), ("b1", "3")):
        run(spark, data, "put", key, value)
    assert run(spark, data, "scan", "-start", "a", "-end", "b")[1] == "a1\t1\na2\t2\n"
    assert run(spark, data, "scan", "-limit", "1")[1] == "a1\t1\n"
    assert run(spark, data, "del", "a1")[0] == cli.OK and run(spark, data, "get", "a1")[0] == cli.NOT_FOUND
    assert run(spark, data, "put", "", "x")[0] == cli.FAILED
    for wrong in ((), ("get",), ("put", "k"), ("fly",), ("scan", "-limit", "x")):
        assert run(spark, data, *wrong)[0] == cli.USAGE
    code, out, _ = run(spark, data, "bench", "-n", "200", "-value-size", "8")
    assert code == cli.OK and out.startswith("put 100 ops") and "get 100 ops" in out


@pytest.fixture
def folder(spark, tmp_path):
    ops = random_ops(800, 40, 21)
    for i in range(4):
        spark.createDataFrame(ops[i * 200 : (i + 1) * 200], OPS).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    return ops, str(tmp_path / "in" / "*"), tmp_path


def test_micro_batches_append(spark, folder):
    ops, source, at = folder
    for _ in range(2):  # a second start finds nothing new
        ingest.run_to_end(lambda: ingest.append_batches(ingest.log_stream(spark, source, 1), str(at / "log"), str(at / "marks")), 120)
    log = store.open_ops(spark, str(at / "log"))
    assert log.count() == len(ops)
    assert pairs(read.latest_live(log)) == live(ops)


def test_view_kept_as_state(spark, folder):
    ops, source, at = folder
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ingest.run_to_end(lambda: ingest.keep_view(ingest.log_stream(spark, source, 2), str(at / "view"), str(at / "marks")), 180)
    assert pairs(ingest.view_of(spark, str(at / "view"))) == live(ops)
