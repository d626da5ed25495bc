"""Backup, restore, verify, prune of a real folder."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cairn import options
from cairn.repository import CHUNK, Repository
from cairn.sources import blobs, capture, locks, logs, remote


@pytest.fixture
def tree(tmp_path):
    r = random.Random(42)
    src = tmp_path / "src"
    for i in range(12):
        p = src / f"dir_{i % 3}" / f"file {i}+ü%41.bin"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(bytes([65 + i % 26]) * 70_000 + r.randbytes(i * 1000))
    (src / "empty").write_bytes(b"")
    (src / "dir_1" / ".hidden").write_bytes(b"dot")
    (src / "_under").write_bytes(b"score")
    (src / "link").symlink_to(src / "empty")
    (src / "big.bin").write_bytes(r.randbytes(2 * CHUNK + 17))
    return src


def contents(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(folder) for f in fs if not os.path.islink(os.path.join(d, f))}


def test_round_trip_and_increments(spark, tree, tmp_path):
    repo = Repository.create(spark, str(tmp_path / "repo"), "pw")
    first = repo.backup(f"file://{tree}", "a", 1000)
    assert first["files"] == 16 and first["read"] == 16
    n = repo.stored().count()
    (tree / "dir_0" / "new").write_bytes(b"new")
    second = repo.backup(f"file://{tree}", "b", 2000)
    assert second["read"] == 1 and repo.stored().count() == n + 1
    for s in ("a", "b"):
        repo.restore(s, str(tmp_path / "out" / s), 2500)
    assert contents(tmp_path / "out" / "b") == contents(tree)
    assert set(contents(tmp_path / "out" / "a")) == set(contents(tree)) - {"dir_0/new"}
    assert {r.status for r in repo.verify().collect()} == {"ok"}
    with pytest.raises(FileExistsError):
        repo.backup(f"file://{tree}", "b", 1)
    with pytest.raises(FileExistsError):
        Repository.create(spark, str(tmp_path / "repo"), "pw")

    again = Repository.open(spark, str(tmp_path / "repo"), "pw")
    with pytest.raises(PermissionError):
        Repository.open(spark, str(tmp_path / "repo"), "wrong")
    again.change_password("pw2")
    assert Repository.open(spark, str(tmp_path / "repo"), "pw2").keys.data == repo.keys.data

    assert again.prune(1, 0, 3000, dry_run=True) == {"kept": 1, "dropped": 1, "chunks": 0, "bytes": 0}
    assert again.prune(1, 0, 3000)["dropped"] == 1
    assert [r.snapshot_id for r in again.snapshots().collect()] == ["b"]
    assert again.prune(0, 0, 4000)["chunks"] == n + 1 and again.stored().count() == 0
    log = again.history().collect()
    assert [r.operation for r in log] == ["backup", "backup", "restore", "restore", "prune", "prune"]
    assert not any(r.broken or r.tampered for r in log)


def test_damage_is_found(spark, tree, tmp_path):
    repo = Repository.create(spark, str(tmp_path / "repo"), "pw")
    repo.backup(f"file://{tree}", "a", 1)
    paths = sorted(os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "repo/data") for f in fs)
    os.remove(paths[0])
    data = bytearray(open(paths[1], "rb").read())
    data[-1] ^= 1
    open(paths[1], "wb").write(data)
    assert sorted(r.status for r in repo.verify().collect() if r.status != "ok") == ["damaged", "missing"]
    with pytest.raises(Exception, match="missing or altered"):
        repo.restore("a", str(tmp_path / "out"), 2)
    # A log line that was altered, and one that is gone, show at their places.
    repo._log(5, "verify")
    repo._log(6, "verify")
    lines = open(tmp_path / "repo/history.jsonl").read().splitlines()
    open(tmp_path / "repo/history.jsonl", "w").write("\n\n".join([lines[0].replace("backup", "delete"), lines[2]]) + "\n")
    assert [(r.tampered, r.broken) for r in repo.history().orderBy("idx").collect()] == [(True, False), (False, True)]
    open(tmp_path / "repo/history.jsonl", "a").write("no json\n")
    with pytest.raises(Exception, match="line 4"):
        repo.history().collect()


def test_policy(spark, tmp_path):
    repo = Repository.create(spark, str(tmp_path / "r"), "x")
    assert repo.set_policy(enabled=True, days=None, keep_last=2) == {"enabled": True, "mode": "governance", "days": 0, "keep_last": 2, "keep_days": 30}
    with pytest.raises(ValueError):
        repo.set_policy(nonsense=1)


def test_sparse_devices(spark, tmp_path):
    image = tmp_path / "disk.img"
    with open(image, "wb") as f:
        f.truncate(4 << 20)
        f.seek(4096)
        f.write(b"short string")
        f.seek(3 << 20)
        f.write(b"another")
    found = blobs.extents(spark.createDataFrame([(str(image),)], "device string"), 1 << 16)
    rows = found.collect()
    assert 1 <= len(rows) and sum(r.extent_len for r in rows) < 4 << 20 and all(r.extent_len <= 1 << 16 for r in rows)
    read = blobs.read_ranges(found.select("device", F.col("extent_offset").alias("at"), F.col("extent_len").alias("len")))
    blobs.write_device(read, str(tmp_path / "copy.img"), 4 << 20)
    assert (tmp_path / "copy.img").read_bytes() == image.read_bytes()
    with pytest.raises(Exception, match="past the end"):
        blobs.read_ranges(spark.createDataFrame([(str(image), 4 << 20, 1)], "device string, at long, len long")).collect()
    with pytest.raises(Exception, match="past the end"):
        blobs.write_device(spark.createDataFrame([(9, b"xx")], "at long, data binary"), str(tmp_path / "small"), 10)


def test_blobs(spark, tmp_path):
    rows = spark.createDataFrame([("aa/x", b"1"), ("bb/y z", b"22"), ("c+c", b"")], "key string, data binary")
    blobs.put_blobs(rows, f"file://{tmp_path}")
    assert sorted((r.key, bytes(r.data)) for r in blobs.files(spark, f"file://{tmp_path}", empty=True).collect()) == [("aa/x", b"1"), ("bb/y z", b"22"), ("c+c", b"")]
    assert [r.key for r in blobs.files(spark, f"file://{tmp_path}", recursive=False, content=False, empty=True).collect()] == ["c+c"]
    assert blobs.total_bytes(spark, f"file://{tmp_path}") == 3
    small, big = blobs.small_files(spark, f"file://{tmp_path}", 1)
    assert small.count() == 1 and big.first().message == "2 bytes: too large"
    wanted = spark.createDataFrame([("aa/x",), ("gone",)], "key string")
    assert {r.key: r.data for r in blobs.get_blobs(spark, f"file://{tmp_path}", wanted).collect()} == {"aa/x": bytearray(b"1"), "gone": None}
    blobs.delete_blobs(wanted, f"file://{tmp_path}")
    assert [r.key for r in blobs.first_files(spark, f"file://{tmp_path}", 1).collect()] == ["bb/y z"]
    with pytest.raises(Exception, match="does not name"):
        blobs.put_blobs(rows, f"file://{tmp_path}/h", check_hash=True)
    with pytest.raises(Exception, match="leads out"):
        blobs.write_files(spark.createDataFrame([("../evil", 0, b"x")], "path string, ord long, chunk binary"), str(tmp_path / "in"))


def test_remote_blobs_and_reads_by_key(spark, tmp_path):
    """An object store by URI; here the URI of a local folder, read and written by the same calls."""
    far = blobs.Remote(f"file://{tmp_path}/bucket")
    rows = spark.createDataFrame([("aa/x", b"1"), ("bb/y", b"22" * 50)], "key string, data binary")
    blobs.put_blobs(rows, far)
    wanted = spark.createDataFrame([("aa/x", 1), ("gone", 2), (None, 3), ("bb/y", 4)], "key string, n long").coalesce(1)
    for most in (1, 1 << 20):
        assert {(r.key, r.n): r.data and bytes(r.data) for r in blobs.read_blobs(wanted, far, most).collect()} == {("aa/x", 1): b"1", ("gone", 2): None, (None, 3): None, ("bb/y", 4): b"22" * 50}
    blobs.delete_blobs(wanted.filter("key = 'aa/x' or key = 'gone'"), far)
    assert [r.key for r in blobs.read_blobs(rows.select("key"), far).filter("data is null").collect()] == ["aa/x"]
    assert blobs.Remote("s3a://b/p/").folder == "s3://b/p" and isinstance(blobs.store_of("s3a://b/p"), blobs.Remote) and isinstance(blobs.store_of(str(tmp_path)), blobs.Mounted)


def test_metadata_is_applied_or_warned_about(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    rows = spark.createDataFrame([("a", 1000, 0o640, os.getuid(), os.getgid()), ("gone", 1, 0o600, 0, 0)], "path string, mtime long, mode long, uid long, gid long")
    warned = {r.path for r in blobs.apply_metadata(rows, str(tmp_path)).collect()}
    st = os.stat(tmp_path / "a")
    assert (int(st.st_mtime), st.st_mode & 0o777) == (1000, 0o640) and warned == {"gone"}


def test_a_file_that_changes_during_a_backup(spark, tmp_path, monkeypatch):
    """Blobs and manifest come from the same reading: what is backed up can be restored."""
    src = tmp_path / "src"
    src.mkdir()
    (src / "f").write_bytes(b"before")
    repo = Repository.create(spark, str(tmp_path / "repo"), "pw")
    put = blobs.put_blobs

    def changed(*args, **kwargs):
        (src / "f").write_bytes(b"and after, longer")
        return put(*args, **kwargs)

    monkeypatch.setattr(blobs, "put_blobs", changed)
    repo.backup(str(src), "a", 1)
    repo.restore("a", str(tmp_path / "out"), 2)
    assert (tmp_path / "out" / "f").read_bytes() == b"before" and not os.path.exists(tmp_path / "repo/staging/a")


def test_stores(spark, tmp_path):
    store = logs.SecretStore(spark, str(tmp_path / "vault.json"), b"k" * 32)
    assert store.names() == [] and store.get("a") is None
    store.put("a", b"one")
    store.put("b", b"two")
    store.put("a", b"three")
    assert store.names() == ["a", "b"] and store.get("a") == b"three"
    with pytest.raises(PermissionError):
        logs.SecretStore(spark, str(tmp_path / "vault.json"), b"x" * 32).get("a")
    store.delete("a")
    assert store.names() == ["b"]
    (tmp_path / "v.json").write_text('{"version": 9999, "entries": {}}')
    with pytest.raises(ValueError):
        logs.load_store(str(tmp_path / "v.json"))
    (tmp_path / "v1.json").write_text('{"entries": {"x": 1}}')
    assert logs.load_store(str(tmp_path / "v1.json")) == {"x": 1}


def test_remote_reader(spark, tmp_path):
    program = tmp_path / "fake"
    program.write_text("#!/bin/sh\ncase $1 in lsf) printf 'a\\nd/b\\n';; cat) printf 'data of %s' \"$2\";; *) exit 1;; esac\n")
    program.chmod(0o755)
    spark.dataSource.register(remote.RemoteBlobs)
    rows = spark.read.format("cairn_remote").option("remote", "r:base").option("program", str(program)).load().collect()
    assert sorted((r.key, bytes(r.data)) for r in rows) == [("a", b"data of r:base/a"), ("d/b", b"data of r:base/d/b")]
    assert remote.remote_path("r:", "/a/") == "r:a" and remote.remote_path("", "a") == "a"
    with pytest.raises(RuntimeError, match="not installed"):
        remote.run(["/no/such/program"])


def test_capture(spark):
    def broken():
        raise OSError("no such part")

    row = capture.fingerprint(spark, collectors={"a": lambda: {"x": "1"}, "b": broken, "c": lambda: {"y": "2"}}, skip=frozenset({"c"})).first()
    assert row["values"] == {"x": "1"} and [tuple(w) for w in row.warnings] == [("b", "no such part")]
    assert capture.tool_rows(spark, ["printf", "a b"]).first().txt == "a b"


def test_records_and_summaries(spark, tree, tmp_path):
    repo = Repository.create(spark, str(tmp_path / "repo"), "pw")
    name = repo.put_record({"hostname": "h", "disks": [1, 2]})
    hidden = repo.put_record({"shadow": "x"}, kind=b"SHDW", secret=True)
    assert repo.get_record(name) == {"hostname": "h", "disks": [1, 2]} and repo.get_record(hidden, b"SHDW", secret=True) == {"shadow": "x"}
    with pytest.raises(ValueError):
        repo.get_record(hidden, b"SHDW")
    with pytest.raises(ValueError):
        repo.get_record(name, version=2)
    repo.backup(f"file://{tree}", "a", 1)
    repo.backup(f"file://{tree}", "b", 2)
    repo.describe("a", tags=["x"], hostname="h")
    assert [(r.snapshot_id, r.details) for r in repo.summaries().collect()] == [("b", None), ("a", '{"hostname": "h", "tags": ["x"]}')]


def test_locks_canaries_quarantine(spark, tmp_path):
    store = locks.LockedStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("c", b"3")], "key string, data binary")
    store.write_once(rows.filter("key <> 'c'"), {"mode": "compliance", "retain_until": 100})
    store.write_once(rows.filter("key = 'c'"), None)
    assert sorted(r.key for r in store.delete(rows, 50).collect()) == ["a", "b"] and os.listdir(tmp_path / "s").count("c") == 0
    with pytest.raises(PermissionError):
        store.set_lock(["a"], {"mode": "governance", "retain_until": 10})
    store.set_lock(["b"], {"mode": "governance", "retain_until": 100, "legal_hold": True})
    assert [r.key for r in store.delete(rows, 101).collect()] == ["b"]
    with pytest.raises(NotImplementedError):
        locks.LockedStore(spark, str(tmp_path / "t"), can_lock=False).write_once(rows, {"mode": "x"})
    path = locks.deploy_canary(str(tmp_path / "t"))
    assert locks.altered_canaries(blobs.files(spark, f"file://{tmp_path}/t")).count() == 0
    open(path, "ab").write(b"!")
    assert locks.deploy_canary(str(tmp_path / "t")) == path and locks.altered_canaries(blobs.files(spark, f"file://{tmp_path}/t")).count() == 1
    found = spark.createDataFrame([(locks.CANARY_NAME, "CanaryModified", None, None), ("gone", "HighEntropy", 7.9, 7.5)], "path string, kind string, entropy double, threshold double")
    assert locks.quarantine(found, str(tmp_path / "t"), str(tmp_path / "q")) == 1 and spark.read.json(f"file://{tmp_path}/q/manifest").count() == 2


def test_options(tmp_path):
    assert options.backup_options(source="/x")["mode"] == "file"
    for bad in ({"mode": "tape"}, {"mode": "block"}, {"source": "/x", "device": "/dev/a"}, {"source": "/x", "snapshot": "vss"}, {"mode": "block", "device": "/dev/a", "source": "/x"}):
        with pytest.raises(ValueError):
            options.backup_options(**bad)
    assert options.included(["a", "b"], ["b"]) == {"a": True, "b": False}
    with pytest.raises(ValueError):
        options.included(["a"], ["z"])
    s = options.Settings(str(tmp_path / "c.json"))
    assert s.get("x") is None
    s.set("x", "1")
    s.set("a", "2")
    assert s.all() == {"a": "2", "x": "1"}
