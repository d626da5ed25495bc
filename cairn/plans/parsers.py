"""Parsers on a few lines each, with the expected rows as the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsers as P
from .registry import query, table

# Inputs.
DPKG = "zlib1g\t1.3-1\tamd64\tinstalled\noldlib\t0.9\tamd64\tconfig-files\nnoarch\t2.0\tall\nbad\t1"
RPM = "zlib\t1.3-2.el9\tx86_64\ngpg-pubkey\tabc-1\nx"
PACMAN = "zlib 1.3-1\nsolo"
APK = "zlib-1.3.1-r2\npy3-six-1.16-r9\nodd-1.0-rc1\nnodash-r1"
OS = "ID=\"demo\"\nVERSION_ID='7'\nNAME=Demo"
CPU = "".join(f"processor\t: {i}\nvendor_id\t: Acme\nmodel name\t: Acme One\nphysical id\t: {i // 2}\nflags\t\t: fpu vme de\n\n" for i in range(4))
MOUNTS = "/dev/vda1 / xfs rw 0 0\ntmpfs /run\n/dev/vda15 /boot/efi vfat rw,relatime 0 0"
RESOLV = "nameserver 10.0.0.2 # lan\nsearch a.test b.test\n# nameserver 1.1.1.1"
PVS = '{"report":[{"pv":[{"pv_name":"/dev/vdb","vg_name":"g","pv_uuid":"U","pv_size":"1048576"},{"pv_name":"/dev/vdc"}]}]}'
VGS = '{"report":[{"vg":[{"vg_name":"g","vg_uuid":"V","vg_size":"10","vg_free":"x"}]}]}'
LVS = '{"report":[{"lv":[{"lv_name":"root","vg_name":"g","lv_size":"77","lv_path":"/dev/g/root"}]}]}'
SFDISK = "label: dos\n/dev/vda1 : start= 2048, size= 4096, type=8e, bootable\n/dev/vda2 : start= 8192, size= 0, type=83"
SGDISK = "Disk identifier (GUID): AB-CD\nNumber  Start (sector)    End (sector)  Size       Code  Name\n   1   2048   4095   1.0 MiB   EF00  boot part\n   2   4096   8191   2.0 MiB   8300"
MDADM = "MD_LEVEL=raid5\nMD_DEVICES=3\nMD_UUID=a:b\nMD_DEVNAME=md1"
ROUTES = '[{"dst":"default","gateway":"10.0.0.1","dev":"e0","metric":5},{"dst":"fe80::/64","dev":"e0","family":"inet6"}]'
MEM = "MemTotal:       16384 kB\nMemFree: 1 kB"
UNITS = "ssh.service enabled enabled\ncron.service disabled\nlonely"


def _parsed(parse, text):
    return lambda spark, sf_dir: parse(spark.createDataFrame([(text,)], "txt string"))


def _rows(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) t({columns})"


query("parse_dpkg", _rows("name, version, architecture", "'zlib1g', '1.3-1', 'amd64'", "'noarch', '2.0', 'all'"))(_parsed(P.dpkg, DPKG))
query("parse_rpm", _rows("name, version, architecture", "'zlib', '1.3-2.el9', 'x86_64'", "'gpg-pubkey', 'abc-1', NULL"))(_parsed(P.rpm, RPM))
query("parse_pacman", _rows("name, version", "'zlib', '1.3-1'"))(_parsed(P.pacman, PACMAN))
query("parse_apk", _rows("name, version", "'zlib', '1.3.1-r2'", "'py3-six', '1.16-r9'"))(_parsed(P.apk, APK))
query("parse_os_release", _rows("id, version", "'demo', '7'"))(_parsed(P.os_release, OS))
query("parse_cpuinfo", _rows("vendor, model, physical, logical, n_flags", "'Acme', 'Acme One', 2::BIGINT, 4::BIGINT, 3::BIGINT"))(_parsed(P.cpuinfo, CPU))
query("parse_meminfo", _rows("bytes", "16777216::BIGINT"))(_parsed(P.meminfo, MEM))
query("parse_mounts", _rows("device, mountpoint, fstype, options", "'/dev/vda1', '/', 'xfs', 'rw'", "'/dev/vda15', '/boot/efi', 'vfat', 'rw,relatime'"))(_parsed(P.mounts, MOUNTS))
query("parse_esp", _rows("device, uuid", "'/dev/vda15', ''"))(_parsed(P.esp, MOUNTS))
query("parse_units", _rows("unit, state", "'ssh.service', 'enabled'", "'cron.service', 'disabled'"))(_parsed(P.units, UNITS))
query("parse_resolv", _rows("kind, value", "'nameserver', '10.0.0.2'", "'search', 'a.test'", "'search', 'b.test'"))(_parsed(P.resolv, RESOLV))
query("parse_lvm_json", _rows("name, vg, uuid, size", "'/dev/vdb', 'g', 'U', 1048576::BIGINT", "'/dev/vdc', '', '', 0::BIGINT"))(_parsed(P.pvs, PVS))
query("parse_vgs", _rows("name, uuid, size, free, extent_size", "'g', 'V', 10::BIGINT, 0::BIGINT, 0::BIGINT"))(_parsed(P.vgs, VGS))
query("parse_lvs", _rows("name, vg, uuid, size, path, attr", "'root', 'g', '', 77::BIGINT, '/dev/g/root', ''"))(_parsed(P.lvs, LVS))
query("parse_sfdisk", _rows("number, type, start, size, bootable", "1::BIGINT, 142::BIGINT, 2048::BIGINT, 4096::BIGINT, true").replace("start", '"start"'))(_parsed(P.sfdisk, SFDISK))
query("parse_sgdisk", _rows('guid, number, "start", "end", name', "'AB-CD', 1::BIGINT, 2048::BIGINT, 4095::BIGINT, 'boot part'", "'AB-CD', 2::BIGINT, 4096::BIGINT, 8191::BIGINT, ''"))(_parsed(P.sgdisk, SGDISK))
query("parse_mdadm", _rows("device, uuid, level, raid, total", "'md1', 'a:b', 'raid5', 3::BIGINT, 3::BIGINT"))(_parsed(P.mdadm, MDADM))
query("parse_routes", _rows("dst, gw, dev, metric, family", "'default', '10.0.0.1', 'e0', 5::BIGINT, 2::INT", "'fe80::/64', NULL, 'e0', NULL, 10::INT"))(_parsed(P.routes, ROUTES))


# One text for each supplier, said once in SQL that Spark and DuckDB read alike; the oracle takes the same texts apart by patterns.
_PACKAGE = "replace(s_name, '#', '-') || '{0}' || s_nationkey || '.' || s_suppkey || '-r' || (s_suppkey % 7)"


def _generated(name: str, parse, text: str, sql: str) -> None:
    def run(spark, sf_dir):
        return parse(table(spark, sf_dir, "supplier").select(F.expr(text).alias("txt")))

    query(name, sql.replace("GENERATED", f"(SELECT {text} AS txt FROM supplier)"))(run)


_generated("dpkg_lines", P.dpkg, _PACKAGE.format("\t") + " || '\tamd64\t' || CASE WHEN s_suppkey % 3 = 0 THEN 'config-files' ELSE 'installed' END || '\nbroken line\n'", r"""SELECT regexp_extract(txt, '^([^\t]+)\t', 1) AS name, regexp_extract(txt, '^[^\t]+\t([^\t]+)', 1) AS version, 'amd64' AS architecture FROM GENERATED WHERE contains(txt, 'installed')""")
_generated("rpm_lines", P.rpm, _PACKAGE.format("\t") + " || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE '\tnoarch' END", r"""SELECT regexp_extract(txt, '^([^\t]+)\t', 1) AS name, regexp_extract(txt, '^[^\t]+\t([^\t]+)', 1) AS version, nullif(regexp_extract(txt, '\t(noarch)$', 1), '') AS architecture FROM GENERATED""")
_generated("pacman_lines", P.pacman, _PACKAGE.format(" ") + " || '\nsolo'", r"""SELECT regexp_extract(txt, '^(\S+) ', 1) AS name, regexp_extract(txt, '^\S+ (\S+)', 1) AS version FROM GENERATED""")
_generated("apk_lines", P.apk, _PACKAGE.format("-") + " || '\nnodash'", r"""SELECT regexp_extract(txt, '^(.+)-[^-\n]*-r[0-9]', 1) AS name, regexp_extract(txt, '^.+-([^-\n]*-r[0-9])', 1) AS version FROM GENERATED""")
_generated("mount_lines", P.mounts, "'/dev/sd' || s_suppkey || '  /mnt/' || s_nationkey || ' ext4 ' || CASE WHEN s_suppkey % 2 = 0 THEN 'rw' ELSE 'ro,noatime' END || ' 0 0\nshort line'", r"""SELECT regexp_extract(txt, '^(\S+)', 1) AS device, regexp_extract(txt, '^\S+\s+(\S+)', 1) AS mountpoint, 'ext4' AS fstype, regexp_extract(txt, 'ext4 (\S+)', 1) AS options FROM GENERATED""")
_generated("unit_lines", P.units, "'unit' || s_suppkey || '.service ' || CASE WHEN s_suppkey % 2 = 0 THEN 'enabled enabled' ELSE 'disabled' END || '\nlonely'", r"""SELECT regexp_extract(txt, '^(\S+)', 1) AS unit, regexp_extract(txt, '^\S+ (\S+)', 1) AS state FROM GENERATED""")
_generated("resolv_lines", P.resolv, "'nameserver 10.0.' || s_nationkey || '.' || (s_suppkey % 250) || ' # note\n# nameserver 1.1.1.1\nsearch a' || s_suppkey || '.test b.test'", r"""SELECT 'nameserver' AS kind, regexp_extract(txt, '^nameserver (\S+)', 1) AS value FROM GENERATED UNION ALL SELECT 'search', regexp_extract(txt, 'search (\S+)', 1) FROM GENERATED UNION ALL SELECT 'search', 'b.test' FROM GENERATED""")
_generated("pvs_json", P.pvs, """'{"report":[{"pv":[{"pv_name":"/dev/sd' || s_suppkey || '","vg_name":"g' || s_nationkey || '","pv_size":"' || (s_suppkey * 4096) || '"}]}]}'""", r"""SELECT txt->>'$.report[0].pv[0].pv_name' AS name, txt->>'$.report[0].pv[0].vg_name' AS vg, '' AS uuid, (txt->>'$.report[0].pv[0].pv_size')::BIGINT AS size FROM GENERATED""")


def _sector(kind: int | None, size: int = 512) -> bytes:
    out = bytearray(512)
    if kind is not None:
        out[510:512] = b"\x55\xaa"
        out[0x1BE + 4] = kind
    return bytes(out[:size])


@query("table_kind", _rows("name, kind", "'gpt', 'gpt'", "'mbr', 'mbr'", "'blank', 'none'", "'short', 'none'"))
def table_kind(spark, sf_dir):
    rows = [("gpt", _sector(0xEE)), ("mbr", _sector(0x83)), ("blank", _sector(None)), ("short", _sector(0x83, 100))]
    return spark.createDataFrame(rows, "name string, data binary").select("name", P.table_kind(F.col("data")).alias("kind"))


@query("path_scalars", """SELECT * FROM (VALUES ('/dev/nvme0n1p2', '/dev/nvme0n1', NULL, NULL, false), ('/dev/sda3', '/dev/sda', NULL, NULL, false), ('/dev/mapper/vg-lv', '/dev/mapper/vg-lv', 'vg', 'lv', true),
  ('/dev/vg0/data', '/dev/vg0/data', 'vg0', 'data', true), ('/dev/mapper/a--b-c', '/dev/mapper/a--b-c', NULL, NULL, false)) t(path, disk, vg, lv, lvm)""")
def path_scalars(spark, sf_dir):
    df = spark.createDataFrame([(x,) for x in ("/dev/nvme0n1p2", "/dev/sda3", "/dev/mapper/vg-lv", "/dev/vg0/data", "/dev/mapper/a--b-c")], "path string")
    lv = P.lv_path(F.col("path"))
    return df.select("path", P.disk_of_partition(F.col("path")).alias("disk"), lv["vg"].alias("vg"), lv["lv"].alias("lv"), P.is_lvm_volume(F.col("path")).alias("lvm"))


@query("key_scalars", """SELECT * FROM (VALUES ('/pre/', '/k/1', 'pre/k/1', '/pre/k/1'), ('', 'k', 'k', 'k'), ('rem:', 'a/', 'rem:/a/', 'rem:a')) t(base, key, joined, remote)""")
def key_scalars(spark, sf_dir):
    df = spark.createDataFrame([("/pre/", "/k/1"), ("", "k"), ("rem:", "a/")], "base string, key string")
    return df.select("base", "key", P.join_key(F.col("base"), F.col("key")).alias("joined"), P.join_remote(F.col("base"), F.col("key")).alias("remote"))


@query("metadata_scalars", """SELECT * FROM (VALUES ('{"capture":{"extras":{"manifest_version":2}}}', 2::INT, true), ('{}', 0, false), ('no json', 0, false)) t(m, version, block_restore)""")
def metadata_scalars(spark, sf_dir):
    df = spark.createDataFrame([('{"capture":{"extras":{"manifest_version":2}}}',), ("{}",), ("no json",)], "m string")
    return df.select("m", P.manifest_version(F.col("m")).alias("version"), (P.manifest_version(F.col("m")) >= 2).alias("block_restore"))


@query("hook_rules", """SELECT * FROM (VALUES ('all', true), ('none', true), ('miss', false)) t(hook, applies)""")
def hook_rules(spark, sf_dir):
    df = spark.createDataFrame([("all", True, True, True), ("none", None, None, None), ("miss", True, False, None)], "hook string, a boolean, b boolean, c boolean")
    return df.select("hook", P.rule_matches(F.col("a"), F.col("b"), F.col("c")).alias("applies"))
