"""Operators on small and odd inputs."""

import hashlib
import random
from datetime import datetime, timezone

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn import hooks
from cairn.functions import codec, crypto, hashing, parsers
from cairn.operators import anomaly, catalog, chunking, dedup, graph, integrity, jobs, retention

# --- chunks ---


def scalar_hashes(data, table):
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(table[b])) % (1 << 64)
        out.append(h)
    return out


@given(st.binary(max_size=400))
@settings(max_examples=60, deadline=None)
def test_gear_hashes_are_rolling(data):
    table = chunking.gear_table()
    assert chunking.gear_hashes(np.frombuffer(data, np.uint8), table).tolist() == scalar_hashes(data, table)


@pytest.mark.parametrize("data", [b"", b"x", bytes(100_000), b"\x2a" * 50_000, random.Random(7).randbytes(300_000), b"abc" * 9000, bytes(2048), bytes(2049)])
def test_cdc_bounds_and_coverage(data):
    view, table = np.frombuffer(data, np.uint8), chunking.gear_table()
    mask = chunking.mask_of(chunking.MEAN)
    ends = chunking.cut_points(view, mask, chunking.LEAST, chunking.MOST, table)
    sizes = np.diff([0, *ends])
    assert sizes.sum() == len(data)
    assert all(n <= chunking.MOST for n in sizes) and (len(sizes) <= 1 or all(n >= chunking.LEAST for n in sizes))
    # The same by one byte after another.
    h, at, want = scalar_hashes(data, table), 0, []
    while at < len(data):
        if len(data) - at <= chunking.LEAST:
            end = len(data)
        else:
            end = next((i + 1 for i in range(at + chunking.LEAST, min(at + chunking.MOST, len(data))) if h[i] & mask == 0), min(at + chunking.MOST, len(data)))
            if 0 < len(data) - end < chunking.LEAST:
                end = len(data) if len(data) - at <= chunking.MOST else len(data) - chunking.LEAST
        want.append(end)
        at = end
    assert ends == want


def test_cdc_resists_insertion():
    data = random.Random(1).randbytes(400_000)
    table, mask = chunking.gear_table(), chunking.mask_of(chunking.MEAN)

    def digests(x):
        at, out = 0, set()
        for end in chunking.cut_points(np.frombuffer(x, np.uint8), mask, chunking.LEAST, chunking.MOST, table):
            out.add(hashlib.sha256(x[at:end]).digest())
            at = end
        return out

    a, b = digests(data), digests(data[:1000] + b"inserted" + data[1000:])
    assert len(a & b) > 0.8 * len(a)
    assert 4_000 < len(data) / len(a) < 12_000


def test_fixed_chunks_of_odd_files(spark):
    rows = [(1, b"abcdefg"), (2, b""), (3, None), (4, b"abcd"), (4, b"abcd")]
    files = spark.createDataFrame(rows, "id long, data binary")
    out = chunking.fixed_chunks(files, "data", 4)
    assert sorted((r.id, r.ord, bytes(r.chunk)) for r in out.collect()) == [(1, 0, b"abcd"), (1, 1, b"efg"), (4, 0, b"abcd"), (4, 0, b"abcd")]
    back = chunking.restored(out.filter("id = 1"), ["id"]).first()
    assert bytes(back.content) == b"abcdefg"
    assert [r.hash for r in chunking.manifest(out.filter("id = 1 and ord = 1")).collect()] == [hashlib.sha256(b"efg").hexdigest()]
    assert chunking.content_chunks(files, "data").count() == 3


def test_split_extents(spark):
    out = chunking.split_extents(spark.createDataFrame([(0, 10), (5, 0)], "offset long, length long"), "offset", "length", 3)
    assert [(r.piece_offset, r.piece_len) for r in out.orderBy("piece_offset").collect()] == [(0, 3), (3, 3), (6, 3), (9, 1)]


# --- references and catalog ---


def test_references(spark):
    refs = spark.createDataFrame([("h1", "a"), ("h2", "a"), ("h3", "a")], "chunk_hash string, snapshot_id string")
    refs = dedup.add_references(refs, spark.createDataFrame([("h2", "b"), ("h3", "b"), ("h4", "b"), ("h2", "b")], "chunk_hash string, snapshot_id string"))
    assert {r.chunk_hash: r.refcount for r in dedup.refcounts(refs).collect()} == {"h1": 1, "h2": 2, "h3": 2, "h4": 1}
    assert tuple(dedup.stats(refs).select("unique_chunks", "total_references", "snapshots").first()) == (4, 6, 2)
    assert [r.chunk_hash for r in dedup.newly_unreferenced(refs, F.col("snapshot_id") == "a").collect()] == ["h1"]
    chunks = spark.createDataFrame([(f"h{i}",) for i in range(1, 5)], "hash string")
    assert sorted(r.hash for r in dedup.orphans(chunks, dedup.drop_snapshots(refs, ["a"])).collect()) == ["h1"]
    assert dedup.orphans(chunks, dedup.drop_snapshots(refs, ["a", "b"])).count() == 4


def test_catalog(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "x"), (3, "c"), (3, "c")], "id long, v string")
    assert sorted(tuple(r) for r in catalog.insert_absent(t, new, ["id"]).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(tuple(r) for r in catalog.upsert(t, new.distinct(), ["id"]).collect()) == [(1, "a"), (2, "x"), (3, "c")]
    assert [tuple(r) for r in catalog.delete(t, new, ["id"]).collect()] == [(1, "a")]
    log = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "k string, n long, v string")
    assert catalog.latest(log, ["k"], [F.col("n")]).first().v == "new"
    numbered = catalog.with_ids(t.select("id"), spark.createDataFrame([("z",), ("y",)], "v string"), "id", ["v"])
    assert sorted(tuple(r) for r in numbered.collect()) == [("y", 3), ("z", 4)]
    assert catalog.key_violations(new, ["id"]).first().n == 2


# --- closure ---


def test_closure_with_cycles_and_sharing(spark):
    r = random.Random(3)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(60)] + [(0, 1), (1, 0), (5, 5)]
    roots = [("x", 0), ("y", 7), ("y", 5)]
    got = {(a.root, a.object_id) for a in graph.reachable(spark.createDataFrame(roots, "root string, object_id long"), spark.createDataFrame(edges, "parent long, child long")).collect()}
    want = set()
    for name, start in roots:
        todo = [start]
        while todo:
            n = todo.pop()
            if (name, n) not in want:
                want.add((name, n))
                todo += [c for p, c in edges if p == n]
    assert got == want


def test_deep_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "parent long, child long")
    roots = spark.createDataFrame([("r", 0)], "root string, object_id long")
    assert graph.reachable(roots, edges).count() == 7
    with pytest.raises(ValueError):
        graph.reachable(roots, edges, most_levels=3)


# --- retention ---


def test_retention(spark):
    snaps = spark.createDataFrame([(f"s{i}", 1_000_000 - 86_400 * i) for i in range(6)] + [("tie", 1_000_000)], "snapshot_id string, timestamp long")
    kept = lambda *a: {r.snapshot_id for r in retention.with_keep(snaps, *a, 1_000_000).filter("keep").collect()}
    assert kept(0, 0) == set()
    assert kept(1, 0) == {"s0"} and kept(2, 0) == {"s0", "tie"}
    assert kept(0, 2) == {"s0", "tie", "s1", "s2"} and kept(100, 0) == {*(f"s{i}" for i in range(6)), "tie"}
    policy = spark.createDataFrame([(True, 5)], "enabled boolean, days int")
    assert tuple(retention.patched(policy, spark.createDataFrame([(None, 9)], "enabled boolean, days int")).first()) == (True, 9)


# --- integrity ---


def py_root(nodes):
    level = [hashlib.sha256(b"\0" + bytes.fromhex(x)).digest() for x in nodes]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0].hex() if level else "00" * 32


@pytest.mark.parametrize("levels", [1, 2, 9])
def test_merkle_roots(spark, monkeypatch, levels):
    monkeypatch.setattr(integrity, "LEVELS", levels)
    rows = [(n, i, hashlib.sha256(f"{n}:{i}".encode()).hexdigest()) for n in (1, 2, 3, 4, 5, 7, 8, 9, 33) for i in range(n)]
    out = integrity.merkle_roots(spark.createDataFrame(rows, "k long, i long, node string"), ["k"], "i", "node").collect()
    assert {r.k: (r.root, r.leaves) for r in out} == {n: (py_root([x for k, _, x in rows if k == n]), n) for n in {r[0] for r in rows}}
    assert integrity.merkle_roots(spark.createDataFrame([], "k long, i long, node string"), ["k"], "i", "node").count() == 0


def test_hmac_matches_python(spark):
    import hmac

    for key in (b"k", bytes([9]) * 32, b"long" * 40):
        assert spark.range(1).select(hashing.hmac(key, F.lit("m€ssage"))).first()[0] == hmac.new(key, "m€ssage".encode(), "sha256").hexdigest()


def test_hash_scalars(spark):
    row = spark.createDataFrame([("ab" * 32, "zz" * 32, "ab")], "a string, b string, c string").select(*[hashing.to_hash(F.col(c)) for c in "abc"], hashing.shard_key(F.col("a"))).first()
    assert bytes(row[0]) == b"\xab" * 32 and row[1] is None and row[2] is None and row[3] == "ab/" + "ab" * 32


# --- codec and encryption ---


def test_frames(spark):
    import zstandard

    rows = [(1, b"text " * 100), (2, b"\x89PNG\r\n\x1a\nrest"), (3, b""), (4, None)]
    framed = codec.encode_frames(spark.createDataFrame(rows, "id long, data binary"), "data", "frame")
    got = {r.id: r for r in codec.decode_frames(framed, "frame", "back", "status").collect()}
    assert all(got[i].back == got[i].data for i, _ in rows) and bytes(got[2].frame) == b"LZC1\0" + rows[1][1]
    bad = [(1, b"LZC1"), (2, b"LZC1\x09x"), (3, b"LZC1\x01junk"), (4, zstandard.compress(b"legacy")), (5, b"junk")]
    out = {r.id: (r.status, r.back) for r in codec.decode_frames(spark.createDataFrame(bad, "id long, f binary"), "f", "back", "status").collect()}
    assert [out[i][0] for i in range(1, 6)] == ["short", "unknown flag", "bad payload", "ok", "bad payload"] and bytes(out[4][1]) == b"legacy"


def test_encryption(spark):
    key, other = b"k" * 32, b"o" * 32
    h = F.lit("ab" * 32)
    one = spark.range(1)
    sealed = one.select(crypto.seal_chunk(F.lit(b"data"), h, key, 3).alias("s"))
    assert bytes(sealed.first().s) == bytes(sealed.first().s) and bytes(sealed.first().s)[:5] == b"\x02\x03\0\0\0"
    opened = lambda keys, of=F.col("s"): sealed.select(crypto.open_chunk(of, h, keys)).first()[0]
    assert bytes(opened({3: key, 4: other})) == b"data"
    assert opened({3: other}) is None and opened({4: key}) is None and opened({3: key}, F.substring("s", 1, 10)) is None
    legacy = one.select(crypto.seal_text(F.lit("tëxt"), key).alias("s"))
    row = legacy.select(crypto.open_text(F.col("s"), key), crypto.open_text(F.col("s"), other), crypto.open_text(F.lit(b"short"), key)).first()
    assert tuple(row) == ("tëxt", None, None)
    row = one.select(crypto.header(F.lit(b"MAGC\x01\0\0\0rest"), b"MAGC", 1), crypto.header(F.lit(b"MAGC\x02\0\0\0rest"), b"MAGC", 1), crypto.framing(F.lit(b"\x02x")), crypto.framing(F.lit(b"x"))).first()
    assert (bytes(row[0]), row[1], row[2], row[3]) == (b"rest", None, "streaming", "legacy")


# --- anomalies, jobs ---


def test_entropy(spark):
    rows = [(1, b""), (2, bytes(32)), (3, random.Random(7).randbytes(1024)), (4, bytes(range(256))), (5, None)]
    got = {r.id: r.entropy for r in anomaly.with_entropy(spark.createDataFrame(rows, "id long, data binary"), "data").collect()}
    assert got[1] == 0 and got[2] == 0 and got[3] > 7.5 and got[4] == 8 and got[5] is None


def test_trust_folds_alike_at_any_width(spark, monkeypatch):
    r = random.Random(2)
    rows = [(k, i, r.uniform(0, 8)) for k in range(3) for i in range(1 + 40 * k)]
    want = {}
    for k, _, x in rows:
        want[k] = x if k not in want else want[k] * 0.8 + x * 0.2
    for fold in (2, 3, 512):
        monkeypatch.setattr(anomaly, "FOLD", fold)
        got = {x.k: x.baseline for x in anomaly.trust(spark.createDataFrame(rows, "k long, i long, x double"), ["k"], ["i"], "x").collect()}
        assert got == pytest.approx(want)


def test_percent(spark):
    rows = [(50, 100, 0, 0), (200, 100, 0, 0), (0, 0, 1, 4), (0, 0, 0, 0)]
    got = spark.createDataFrame(rows, "a long, b long, c long, d long").select(anomaly.percent(*[F.col(c) for c in "abcd"])).collect()
    assert [x[0] for x in got] == [50, 100, 25, 100]


def test_schedules():
    at = lambda *a: int(datetime(*a, tzinfo=timezone.utc).timestamp())
    first = lambda s, t: next(jobs.cron_times(s, t, t + 6 * 366 * 86_400), None)
    assert first("0 0 29 2 *", at(2024, 3, 1)) == at(2028, 2, 29)
    assert first("*/15 9-10 * * 1", at(2024, 1, 1, 10, 45)) == at(2024, 1, 8, 9)
    assert first("30 0 0 1 1 *", at(2024, 1, 1)) == at(2024, 1, 1, 0, 0, 30)
    assert first("0 12 13 * 5", at(2024, 9, 13, 12)) == at(2024, 9, 20, 12)
    with pytest.raises(ValueError):
        first("61 * * * *", 0)


def test_claim_takes_no_more_than_asked(spark):
    rows = [(f"j{i}", "Pending", i, None) for i in range(5)] + [("done", "Completed", 0, None)]
    out = jobs.claim(spark.createDataFrame(rows, "id string, status string, scheduled_time long, agent_id string"), F.lit(3), "me", 2)
    assert sorted(r.id for r in out.filter("status = 'Assigned' and agent_id = 'me'").collect()) == ["j0", "j1"]


# --- hooks ---


def test_hooks(tmp_path):
    made = [hooks.Hook("a", pre="echo hi", post="exit 3"), hooks.Hook("slow", pre="sleep 5", timeout=0.2), hooks.Hook("never", pre="true"), hooks.Hook("off", pre="true", rule=hooks.Rule(path=str(tmp_path / "no")))]
    runner = hooks.HookRunner(made)
    pre = runner.pre()
    assert [(o.hook, o.success) for o in pre] == [("a", True), ("slow", False)] and pre[0].stdout == "hi\n" and pre[1].exit_code is None
    assert [(o.hook, o.exit_code) for o in runner.post()] == [("a", 3)]
    assert hooks.pick_snapshotter("auto", "/x", {"lvm": lambda _: False, "zfs": lambda _: True}) == "zfs"
    assert hooks.pick_snapshotter("none", "/x", {}) is None
    with pytest.raises(ValueError):
        hooks.pick_snapshotter("lvm", "/x", {"lvm": lambda _: False})


def test_parser_leftovers(spark):
    outcomes = spark.createDataFrame([("a", "pre", False), ("b", "post", False), ("c", "pre", True)], "hook string, phase string, success boolean")
    assert [r.hook for r in parsers.failures(outcomes, "pre").collect()] == ["a"]
    assert parsers.package_manager(spark.createDataFrame([("/var/lib/rpm",), ("/lib/apk/db/installed",)], "path string")).first().manager == "rpm"
    row = spark.createDataFrame([("quiet root=/dev/nvme0n1p2 ro", "x" * 129)], "c string, n string").select(parsers.root_disk(F.col("c")), parsers.is_safe_lv_name(F.col("n"))).first()
    assert tuple(row) == ("/dev/nvme0n1", False)
