"""Secret scan by corpus-wide ownership frequency, in built-in expressions only.

Patterns give spans of four kinds. The first three are the base and always stay. The fourth, ``opaque``, is any long run of
mixed characters outside the base spans; alone it says little, so the corpus decides: the hash of each found value is
counted by distinct repositories and owners. A value that many owners hold is a copied example; one that few owners hold looks
like a live credential, and only then is an opaque run reported.

Work on a text grows with its length and its matches (``common.before_each``), however many secrets one text holds.

A value may stand in a third of all rows. (value, owner, repository) is made distinct before the shuffle by value, so the
count of a value reads a row per owner and repository, not per occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, before_each, cut, parts_of, settled

# The patterns of the base kinds, and the least length of what they must hold.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "opaque")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

_RUN = "[A-Za-z0-9+/_-]"
OPAQUE = rf"(?<!{_RUN})(?={_RUN}*[a-z])(?={_RUN}*[A-Z])(?={_RUN}*[0-9]){_RUN}{{24,}}"
#: A value of more owners, or more repositories, than these is a copied example.
MOST_OWNERS, MOST_REPOSITORIES = 2, 4

_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"
#: Beyond any place in a text.
_FAR = (1 << 31) - 1


def _matches(text: Column, pattern: str, group: int) -> Column:
    """gap (characters since the match before), n (characters of the match) and value of the leftmost non-overlapping matches."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sized = F.zip_with(whole, value, lambda w, v: F.struct(F.length(w).alias("n"), v.alias("value")))
    # One gap more than matches: what follows the last match.
    found = F.zip_with(F.split(text, pattern, -1), sized, lambda g, m: F.struct(F.length(g).alias("gap"), m["n"].alias("n"), m["value"].alias("value")))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.filter(found, lambda m: m["n"].isNotNull())).otherwise(F.array().cast("array<struct<gap:int,n:int,value:string>>"))


def _spans(matches: str, kind: int) -> Column:
    """start, kind, end, value of ``_matches`` (a settled column), in code points: gaps and matches add up to the places."""
    before = before_each(F.col(matches), lambda m: m["gap"] + m["n"], lambda a, b: a + b, F.lit(0))

    def span(m: Column, at: Column) -> Column:
        start = at + m["gap"]
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + m["n"]).alias("end"), m["value"].alias("value"))

    return F.when(F.size(matches) > 0, F.zip_with(matches, before, span)).otherwise(F.array().cast(_SPANS))


def _apart(spans: str, back: str) -> Column:
    """The opaque ones of ``spans`` (sorted; ``back``: the other way round; both settled columns) that no base span touches.

    A base span that starts no later than an opaque one touches it if it ends later than that starts: the largest end so far tells.
    Of those that start later the first one tells.
    """
    base = lambda s, c, other: F.when(s["kind"] < 3, c).otherwise(F.lit(other))
    ends = before_each(F.col(spans), lambda s: base(s, s["end"], 0), F.greatest, F.lit(0))
    starts = F.reverse(before_each(F.col(back), lambda s: base(s, s["start"], _FAR), F.least, F.lit(_FAR)))
    around = F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("e"), s.alias("s")))
    kept = F.zip_with(spans, around, lambda s, x: F.when((s["kind"] == 3) & (x["e"] <= s["start"]) & (x["s"] >= s["end"]), s))
    return F.array_compact(kept)


def _scanned(docs: DataFrame, text: Column) -> DataFrame:
    """Adds ``__base`` and ``__opaque``. Every array that a lambda reads is a settled column of a step of its own."""
    own = docs.columns
    docs = docs.select(*own, settled(F.coalesce(text, F.lit(""))).alias("__text"))
    patterns = [(ASSIGN, 2), (ACCESS, 0), (HEX, 0), (OPAQUE, 0)]
    docs = docs.select(*own, *[settled(_matches(F.col("__text"), p, g)).alias(f"__m{k}") for k, (p, g) in enumerate(patterns)])
    long = lambda n: lambda s: F.length(s["value"]) >= n
    spans = [F.filter(_spans(f"__m{k}", k), long(n)) for k, n in enumerate((LEAST_ASSIGN, LEAST_ACCESS, 0, 0))]
    docs = docs.select(*own, settled(F.array_sort(F.concat(*spans[:3]))).alias("__base"), settled(spans[3]).alias("__opaque"))
    docs = docs.select(*own, "__base", "__opaque", settled(F.when((F.size("__base") > 0) & (F.size("__opaque") > 0), F.array_sort(F.concat("__base", "__opaque")))).alias("__all"))
    docs = docs.select(*own, "__base", "__opaque", "__all", settled(F.reverse("__all")).alias("__back"))
    return docs.withColumn("__opaque", F.when(F.col("__all").isNotNull(), _apart("__all", "__back")).otherwise(F.col("__opaque"))).drop("__all", "__back")


def find_secrets(docs: DataFrame, scratch: Scratch, owner: Column, repository: Column, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, kind, end) ordered by start and kind, and n_copied, n_live.

    A null or empty text has no spans. A null owner or repository counts as one of its own. Repeated rows are scanned each, but
    count once for their owner. Columns of ``docs`` named like the four results are replaced; text stays as it is.
    ``keep`` lists the columns of ``docs`` to return (all of them if null).
    """
    docs = docs.drop("base", "spans", "n_copied", "n_live")
    found = _scanned(docs.withColumns({"__owner": F.coalesce(owner.cast("string"), F.lit("\0")), "__repository": F.coalesce(repository.cast("string"), F.lit("\0"))}), F.col(text_col))
    keep = docs.columns if keep is None else keep
    found = scratch.keep(found.select(*keep, "__owner", "__repository", "__base", "__opaque", F.monotonically_increasing_id().alias("__row")), "scanned")
    all_of = F.concat("__base", "__opaque")
    some = found.filter(F.size(all_of) > 0)
    values = some.select("__row", "__owner", "__repository", F.explode(all_of).alias("s")).select("__row", "__owner", "__repository", "s", F.xxhash64("s.value").alias("hash"))
    held = values.select("hash", "__owner", "__repository").distinct()
    count = held.groupBy("hash", "__owner").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))
    copied = (F.col("owners") > MOST_OWNERS) | (F.col("repositories") > MOST_REPOSITORIES)
    judged = values.select("__row", "s", "hash").join(count.select("hash", copied.alias("copied")), "hash")
    shown = F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"))
    own = judged.groupBy("__row").agg(
        F.array_sort(F.collect_list(F.when((F.col("s.kind") < 3) | ~F.col("copied"), shown))).alias("spans"),
        F.count_if(F.col("copied") & (F.col("s.kind") < 3)).alias("n_copied"),
        F.count_if(~F.col("copied")).alias("n_live"),
    )
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    hit = some.join(own, "__row").select(*keep, bare("__base").alias("base"), "spans", "n_copied", "n_live")
    free = found.filter(F.size(all_of) == 0).select(*keep, bare("__base").alias("base"), bare("__base").alias("spans"), F.lit(0).cast("long").alias("n_copied"), F.lit(0).cast("long").alias("n_live"))
    return hit.unionByName(free)


def shown(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(found: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """Puts ``mark`` in the place of each stretch that spans cover, and drops what find_secrets added.

    Texts with spans are cut in parts, so that a place is found without reading all that lies before it.
    """
    own = [c for c in found.columns if c not in ("base", "spans", "n_copied", "n_live")]
    text = F.when(F.size("spans") > 0, F.col(text_col))
    df = found.select(*own, settled(F.col("spans")).alias("__spans"), settled(parts_of(text)).alias("__parts"), F.length(text).alias("__n"))
    ends = before_each(F.col("__spans"), lambda s: s["end"], F.greatest, F.lit(0))
    gaps = F.zip_with("__spans", ends, lambda s, e: F.struct(e.alias("a"), s["start"].alias("z"), s["end"].alias("end")))
    df = df.select(*own, "__parts", "__n", settled(gaps).alias("__gaps"))
    between = F.transform(F.filter("__gaps", lambda g: g["a"] <= g["z"]), lambda g: cut("__parts", g["a"], g["z"]))
    last = F.array_max(F.transform("__gaps", lambda g: g["end"]))
    whole = F.array_join(F.concat(between, F.array(cut("__parts", last, F.col("__n")))), mark)
    out = [F.when(F.col("__parts").isNotNull(), whole).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in own]
    return df.select(*out)
