"""Tool output to rows: each function takes a frame with a text column ``txt`` (and keeps its other columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(df: DataFrame) -> DataFrame:
    """A row per line: n (from 0) and line, without a trailing carriage return."""
    keep = [c for c in df.columns if c != "txt"]
    return df.select(*keep, F.posexplode(F.split("txt", "\n")).alias("n", "line")).withColumn("line", F.regexp_replace("line", "\r$", ""))


def unquoted(text: Column) -> Column:
    """Without quotes of either kind at both ends."""
    return F.regexp_replace(text, "^[\"']+|[\"']+$", "")


def number(text: Column) -> Column:
    """A whole number, or 0."""
    return F.coalesce(F.trim(text).try_cast("long"), F.lit(0).cast("long"))


def _fields(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def dpkg(df: DataFrame) -> DataFrame:
    p = lines(df).withColumn("p", F.split("line", "\t")).filter((F.size("p") >= 3) & (F.get("p", F.lit(0)) != "") & (F.coalesce(F.get("p", F.lit(3)), F.lit("installed")) == "installed"))
    return p.select(F.get("p", F.lit(0)).alias("name"), F.get("p", F.lit(1)).alias("version"), F.get("p", F.lit(2)).alias("architecture"))


def rpm(df: DataFrame) -> DataFrame:
    p = lines(df).withColumn("p", F.split("line", "\t")).filter((F.size("p") >= 2) & (F.get("p", F.lit(0)) != ""))
    return p.select(F.get("p", F.lit(0)).alias("name"), F.get("p", F.lit(1)).alias("version"), F.get("p", F.lit(2)).alias("architecture"))


def pacman(df: DataFrame) -> DataFrame:
    p = lines(df).withColumn("p", _fields(F.col("line"))).filter(F.size("p") >= 2)
    return p.select(F.get("p", F.lit(0)).alias("name"), F.get("p", F.lit(1)).alias("version"))


def apk(df: DataFrame) -> DataFrame:
    pattern = "^(.+)-([^-]*-r[0-9]*)$"
    return lines(df).filter(F.trim("line").rlike(pattern)).select(F.regexp_extract(F.trim("line"), pattern, 1).alias("name"), F.regexp_extract(F.trim("line"), pattern, 2).alias("version"))


def os_release(df: DataFrame) -> DataFrame:
    value = lambda key: F.coalesce(F.max(F.when(F.col("line").startswith(key + "="), unquoted(F.trim(F.expr(f"substring(line, {len(key) + 2})"))))), F.lit(""))
    return lines(df).agg(value("ID").alias("id"), value("VERSION_ID").alias("version"))


def cpuinfo(df: DataFrame) -> DataFrame:
    rows = lines(df).select("n", F.trim(F.substring_index("line", ":", 1), F.lit(" \t")).alias("k"), F.trim(F.expr("substring(line, instr(line, ':') + 1)"), F.lit(" \t")).alias("v"))
    first = lambda key: F.min_by(F.when(F.col("k") == key, F.col("v")), F.when(F.col("k") == key, F.col("n")))
    out = rows.agg(
        F.coalesce(first("vendor_id"), F.lit("")).alias("vendor"),
        F.coalesce(first("model name"), F.lit("")).alias("model"),
        F.count_distinct(F.when(F.col("k") == "physical id", F.col("v"))).alias("sockets"),
        F.count_if(F.col("k") == "processor").alias("logical"),
        F.coalesce(F.size(F.filter(F.split(first("flags"), r"\s+"), lambda x: x != "")), F.lit(0)).cast("long").alias("n_flags"),
    )
    return out.select("vendor", "model", F.when(F.col("sockets") > 0, F.col("sockets")).otherwise(F.col("logical")).alias("physical"), "logical", F.greatest("n_flags", F.lit(0)).alias("n_flags"))


def meminfo(df: DataFrame) -> DataFrame:
    """Total bytes; 0 if the line is missing."""
    kb = lines(df).filter(F.col("line").startswith("MemTotal:")).agg(F.max(F.regexp_extract("line", r"([0-9]+)", 1)).alias("kb"))
    return kb.select(F.coalesce(F.col("kb").try_cast("long") * 1024, F.lit(0)).cast("long").alias("bytes"))


def mounts(df: DataFrame) -> DataFrame:
    p = lines(df).withColumn("p", _fields(F.col("line"))).filter(F.size("p") >= 4)
    return p.select(*[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(["device", "mountpoint", "fstype", "options"])])


def esp(df: DataFrame) -> DataFrame:
    return mounts(df).filter(F.col("mountpoint").isin("/boot/efi", "/efi")).select("device", F.lit("").alias("uuid"))


def units(df: DataFrame) -> DataFrame:
    p = lines(df).withColumn("p", _fields(F.col("line"))).filter(F.size("p") >= 2)
    return p.select(F.get("p", F.lit(0)).alias("unit"), F.get("p", F.lit(1)).alias("state"))


def resolv(df: DataFrame) -> DataFrame:
    p = lines(df).withColumn("p", _fields(F.substring_index("line", "#", 1))).filter(F.size("p") >= 2)
    rows = p.withColumn("kind", F.get("p", F.lit(0))).filter(F.col("kind").isin("nameserver", "search"))
    values = F.when(F.col("kind") == "nameserver", F.slice("p", 2, 1)).otherwise(F.slice("p", 2, F.size("p")))
    return rows.select("kind", F.explode(values).alias("value"))


def _report(df: DataFrame, kind: str, columns: dict[str, tuple[str, bool]]) -> DataFrame:
    item = ", ".join(f"{c}: string" for c in columns)
    rows = df.select(F.explode(F.from_json("txt", f"report array<struct<{kind}: array<struct<{item}>>>>")["report"][0][kind]).alias("x"))
    return rows.select(*[(number(F.col(f"x.{c}")) if is_number else F.coalesce(F.col(f"x.{c}"), F.lit(""))).alias(name) for c, (name, is_number) in columns.items()])


def pvs(df: DataFrame) -> DataFrame:
    return _report(df, "pv", {"pv_name": ("name", False), "vg_name": ("vg", False), "pv_uuid": ("uuid", False), "pv_size": ("size", True)})


def vgs(df: DataFrame) -> DataFrame:
    return _report(df, "vg", {"vg_name": ("name", False), "vg_uuid": ("uuid", False), "vg_size": ("size", True), "vg_free": ("free", True), "vg_extent_size": ("extent_size", True)})


def lvs(df: DataFrame) -> DataFrame:
    return _report(df, "lv", {"lv_name": ("name", False), "vg_name": ("vg", False), "lv_uuid": ("uuid", False), "lv_size": ("size", True), "lv_path": ("path", False), "lv_attr": ("attr", False)})


def routes(df: DataFrame) -> DataFrame:
    rows = df.select(F.explode(F.from_json("txt", "array<struct<dst: string, gateway: string, dev: string, metric: long, family: string>>")).alias("x"))
    return rows.select("x.dst", F.col("x.gateway").alias("gw"), F.coalesce("x.dev", F.lit("")).alias("dev"), "x.metric", F.when(F.col("x.family") == "inet6", 10).otherwise(2).alias("family"))


def sgdisk(df: DataFrame) -> DataFrame:
    rows = lines(df)
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)  # the lines of one disk's listing
    head = F.col("line").rlike(r"^\s*Number\s+Start")
    rows = rows.withColumn("inside", F.coalesce(F.max(head).over(w), F.lit(False))).withColumn("guid", F.max(F.nullif(F.regexp_extract("line", r"(?i)disk identifier \(GUID\):\s*(\S+)", 1), F.lit(""))).over(Window.partitionBy()))
    rows = rows.withColumn("p", _fields(F.col("line"))).filter(F.col("inside") & (F.size("p") >= 6) & F.get("p", F.lit(0)).rlike("^[0-9]+$"))
    at = lambda i: F.get("p", F.lit(i))
    return rows.select(F.coalesce("guid", F.lit("")).alias("guid"), at(0).cast("long").alias("number"), number(at(1)).alias("start"), number(at(2)).alias("end"), F.array_join(F.slice("p", 7, F.size("p")), " ").alias("name"))


def sfdisk(df: DataFrame) -> DataFrame:
    rows = lines(df).filter(F.col("line").startswith("/dev/") & F.col("line").contains(":"))
    pairs = F.str_to_map(F.regexp_replace(F.expr("substring(line, instr(line, ':') + 1)"), " ", ""), F.lit(","), F.lit("="))
    rows = rows.withColumn("m", pairs)
    at = lambda k: F.try_element_at("m", F.lit(k))
    kind = F.coalesce(F.conv(F.when(at("type").rlike("^[0-9a-fA-F]+$"), at("type")), 16, 10).try_cast("long"), F.lit(0))
    rows = rows.select("n", kind.alias("type"), number(at("start")).alias("start"), number(at("size")).alias("size"), F.array_contains(F.map_keys("m"), "bootable").alias("bootable")).filter("size > 0")
    return rows.select(F.row_number().over(Window.orderBy("n")).cast("long").alias("number"), "type", "start", "size", "bootable")


def mdadm(df: DataFrame) -> DataFrame:
    m = df.select(F.str_to_map("txt", F.lit("\n"), F.lit("=")).alias("m"))
    at = lambda k: F.try_element_at("m", F.lit(k))
    raid = number(at("MD_DEVICES"))
    return m.select(F.coalesce(at("MD_DEVNAME"), F.lit("")).alias("device"), F.coalesce(at("MD_UUID"), F.lit("")).alias("uuid"), F.coalesce(at("MD_LEVEL"), F.lit("")).alias("level"), raid.alias("raid"), F.when(at("MD_TOTAL_DEVICES").isNotNull(), number(at("MD_TOTAL_DEVICES"))).otherwise(raid).alias("total"))


def table_kind(sector: Column) -> Column:
    """gpt, mbr or none of a first sector: its mark, and the type EE in any of four slots."""
    byte = lambda i: F.substring(sector, i + 1, 1)
    marked = (F.octet_length(sector) >= 512) & (F.substring(sector, 511, 2) == F.lit(b"\x55\xaa"))
    kinds = [byte(0x1BE + 16 * k + 4) for k in range(4)]
    gpt, some = F.lit(False), F.lit(False)
    for k in kinds:
        gpt, some = gpt | (k == F.lit(b"\xee")), some | (k != F.lit(b"\x00"))
    return F.when(marked & gpt, "gpt").when(marked & some, "mbr").otherwise("none")


def disk_of_partition(path: Column) -> Column:
    """/dev/nvme0n1p2 -> /dev/nvme0n1, /dev/sda3 -> /dev/sda."""
    return F.when(path.rlike("nvme|mmcblk"), F.regexp_replace(path, "p[0-9]+$", "")).otherwise(F.regexp_replace(path, "[0-9]+$", ""))


def lv_path(path: Column) -> Column:
    """(vg, lv) of /dev/vg/lv or /dev/mapper/vg-lv; null for others and for names with a doubled dash."""
    mapped = path.startswith("/dev/mapper/")
    part = lambda a, b: F.when(mapped, F.regexp_extract(path, "^/dev/mapper/([^/-]+)-([^/-]+)$", a)).otherwise(F.regexp_extract(path, "^/dev/([^/]+)/([^/]+)$", b))
    return F.when(part(1, 1) != "", F.struct(part(1, 1).alias("vg"), part(2, 2).alias("lv")))


def is_safe_lv_name(name: Column) -> Column:
    return name.rlike(r"\A[A-Za-z0-9_.-]{1,128}\z")


def is_lvm_volume(path: Column) -> Column:
    return lv_path(path).isNotNull()


def root_disk(cmdline: Column, by_uuid: Column | None = None) -> Column:
    """The disk of the kernel command line's root= device, or of the device that ``by_uuid`` (a map) has for root=UUID=; else null."""
    device = F.nullif(F.regexp_extract(cmdline, r"(?:^|\s)root=(/dev/\S+)", 1), F.lit(""))
    if by_uuid is not None:
        device = F.coalesce(device, F.try_element_at(by_uuid, F.regexp_extract(cmdline, r"(?:^|\s)root=UUID=(\S+)", 1)))
    return F.when(device.isNotNull(), disk_of_partition(device))


def manifest_version(metadata: Column) -> Column:
    """/capture/extras/manifest_version of JSON metadata, or 0."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(metadata), "$.capture.extras.manifest_version", "int"), F.lit(0))


def rule_matches(service: Column, process: Column, path: Column) -> Column:
    """A hook's rule: each test that it has (not null) holds."""
    return F.coalesce(service, F.lit(True)) & F.coalesce(process, F.lit(True)) & F.coalesce(path, F.lit(True))


def failures(outcomes: DataFrame, phase: str) -> DataFrame:
    return outcomes.filter((F.col("phase") == phase) & ~F.col("success"))


def package_manager(paths: DataFrame) -> DataFrame:
    """The first of the known managers whose marker is among ``paths`` (path); unknown if none is."""
    # Markers, in order of precedence.
    known = [("dpkg", "/var/lib/dpkg/status"), ("rpm", "/var/lib/rpm"), ("pacman", "/var/lib/pacman"), ("apk", "/lib/apk/db/installed")]
    rank = paths.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(known)], "rank int, manager string, path string")
    return paths.join(F.broadcast(rank), "path").agg(F.coalesce(F.min_by("manager", "rank"), F.lit("unknown")).alias("manager"))


def join_key(prefix: Column, key: Column) -> Column:
    """prefix/key with single slashes; an empty prefix leaves the key."""
    a, b = F.regexp_replace(prefix, "^/+|/+$", ""), F.regexp_replace(key, "^/+", "")
    return F.when(a == "", b).otherwise(F.concat(a, F.lit("/"), b))


def join_remote(base: Column, segment: Column) -> Column:
    """As join_key, but nothing is put after a remote's colon."""
    part = F.regexp_replace(segment, "^/+|/+$", "")
    return F.when(part == "", base).when(base == "", part).when(base.endswith(":"), F.concat(base, part)).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), part))
