"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base kinds (assign, access, hex) are found by fixed patterns, leftmost and without overlaps; `split` and
`regexp_extract_all` run the same pattern, so the lengths of the gaps and of the matches, summed up over a window, give
every offset in code points. Further token shapes are candidates too. Each candidate's value is hashed and counted by
distinct owners (`source`) and repositories (`source` and `lang`): a value that several owners carry, or that one owner
carries in many repositories, is a copied example; one that few repositories of a single owner carry is live-looking. Only
live-looking candidates of the further shapes are added to the base spans.

Cases: null and empty texts have no spans; a null owner counts as one owner of its own, and so does a table without a
`source` (or `lang`) column; rows that repeat are reported alike and count once per owner; ties (spans that begin at one
place) are in the order of KINDS; a long text's matches are summed in time linear in their number; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korpusflow.llm.common import hot_keys, materialize, spread_join

#: Pattern, group whose length decides, and least length. The first three are the base kinds.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "forge": (r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    "cloud": (r"AIza[A-Za-z0-9_-]+", 0, 39),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
}
BASE = ("assign", "access", "hex")
#: Owners from which a value counts as a copied example, and repositories of a single owner.
COPIED_OWNERS, COPIED_REPOSITORIES = 2, 4


def pieces_of(text: Column, kind: str) -> Column:
    """What a kind's pattern cuts a text into, in order: kind_no, lengths of the gap and of the match after it, value."""
    pattern, group, least = KINDS[kind]
    quick = pattern
    if kind == "hex":  # the same maximal runs, without visiting every short one
        pattern = quick = f"[0-9a-f]{{{least},}}"
    hits, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (0, group))
    cut = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), values.alias("value"))
    piece = lambda x: F.struct(F.lit(list(KINDS).index(kind)).alias("kind_no"), F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["hit"]), F.lit(0)).alias("length"), x["value"].alias("value"))
    return F.when(text.rlike(quick), F.transform(cut, piece)).otherwise(F.array().cast("array<struct<kind_no:int,gap:int,length:int,value:string>>"))


def scan(docs: DataFrame) -> DataFrame:
    """key, doc_id, owner, repository and pieces of each row; the key is of this run, so it is to be written with it."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), name("source").alias("owner"), name("lang").alias("lang"))
    return rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "owner", F.concat_ws("/", "owner", "lang").alias("repository"), F.concat(*(pieces_of(F.col("text"), k) for k in KINDS)).alias("pieces"))


def candidates(scanned: DataFrame) -> DataFrame:
    """A row for each match that is long enough: key, owner, repository, start, end (code points), kind_no, value_sha256."""
    each = scanned.filter(F.size("pieces") > 0).select("key", "owner", "repository", F.posexplode("pieces").alias("no", "p")).select("key", "owner", "repository", "no", "p.*")
    upto = Window.partitionBy("key", "kind_no").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(upto).cast("int"))
    least = F.create_map(*(F.lit(x) for no, (_, _, n) in enumerate(KINDS.values()) for x in (no, n)))[F.col("kind_no")]
    return placed.filter(F.length("value") >= least).select("key", "owner", "repository", (F.col("end") - F.col("length")).alias("start"), "end", "kind_no", F.sha2("value", 256).alias("value_sha256"))


def ownership(found: DataFrame) -> DataFrame:
    """For each candidate's hash: distinct owners and repositories, rows, and whether it is a copied example."""
    by_repository = found.groupBy("value_sha256", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("value_sha256", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    total = by_owner.groupBy("value_sha256").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n_rows"))
    return total.withColumn("copied", (F.col("owners") >= COPIED_OWNERS) | (F.col("repositories") >= COPIED_REPOSITORIES))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live and n_copied (candidates by ownership) per row."""
    scanned = materialize(scan(docs), "secret-pieces")
    found = materialize(candidates(scanned), "secret-candidates")
    owned = materialize(ownership(found), "secret-owners")
    judged = spread_join(found, owned.select("value_sha256", "copied"), ["value_sha256"], hot_keys(owned, ["value_sha256"], "n_rows"), F.xxhash64("key", "start"))
    kind = F.array(*map(F.lit, KINDS))[F.col("kind_no")]
    span = F.struct("start", "kind_no", F.concat_ws(":", kind, "start", "end").alias("span"), "copied")
    by_row = judged.groupBy("key").agg(F.array_sort(F.collect_list(span)).alias("all"))
    spans = F.coalesce("all", F.array().cast("array<struct<start:int,kind_no:int,span:string,copied:boolean>>"))
    rows = scanned.select("key", "doc_id").join(by_row, "key", "left").select("doc_id", spans.alias("all"))
    joined = lambda keep: F.array_join(F.transform(F.filter("all", keep), lambda s: s["span"]), ",")
    count = lambda keep: F.size(F.filter("all", keep)).cast("long")
    base = lambda s: s["kind_no"] < len(BASE)
    of_kind = lambda no: lambda s: s["kind_no"] == no
    numbers = [count(of_kind(no)).alias(f"n_{k}") for no, k in enumerate(BASE)]
    return rows.select(
        "doc_id", *numbers, F.sha2(joined(base), 256).alias("base_sha256"), joined(lambda s: base(s) | ~s["copied"]).alias("spans"),
        count(lambda s: ~s["copied"]).alias("n_live"), count(lambda s: s["copied"]).alias("n_copied"),
    )
