"""Secret spans, and corpus-wide ownership frequency of what they hold.

Each candidate value is hashed; over the whole corpus the hashes are counted by
distinct repositories and distinct owners.  A value in many repositories or in the
hands of many owners is a widely copied example; one that stays with few is a
live-looking credential.
Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

#: Kinds in the order in which they are listed: pattern, group of the value, least length of the value.
BASE_KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a run is taken whole, so asking for its least length finds the same matches
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Kinds that count only while their value is owner-specific.
ADDED_KINDS = {
    "bearer": (r"\b[Bb]earer\x20+([A-Za-z0-9._~+/-]{16,}=*)", 1, 16),
    "urlpass": (r"://[A-Za-z0-9._-]+:([^\s:/@]{6,})@", 1, 6),
}
#: Values that stand for a secret.
PLACEHOLDER = r"(?i)example|changeme|placeholder|your_|xxxx|\*\*\*\*|^<"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column], block: int = 128) -> Column:
    """What ``join`` makes of each value (a long, not below 0) and all before it, in two steps: within blocks and over blocks."""
    fold = lambda some: F.aggregate(some, F.lit(0).cast("long"), join)
    first = lambda i: (F.floor(i / block) * block).cast("int")

    def combined(v: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), first(F.size(v) - 1), F.lit(block)), lambda at: fold(F.slice(v, at + 1, F.lit(block))))
        before = lambda w: F.transform(w, lambda _, k: fold(F.slice(w, F.lit(1), k)))
        return let(let(whole, before), lambda b: F.transform(v, lambda _, i: join(F.get(b, F.floor(i / block).cast("int")), fold(F.slice(v, first(i) + 1, i - first(i) + 1)))))

    return F.when(F.size(values) > 0, let(values, combined)).otherwise(F.array().cast("array<bigint>"))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def found_spans(text: Column, number: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of a kind's leftmost non-overlapping matches whose value is long enough.

    The text between matches and the matches themselves give the places: code
    points, the end exclusive.  Each of them is cut once and ends are running sums,
    so the work is linear in the text.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.struct(F.split(text, pattern, -1).alias("between"), whole.alias("whole"), values.alias("values"))

    def spans(p: Column) -> Column:
        sizes = F.transform(p["whole"], lambda w, i: (F.length(w) + F.length(F.get(p["between"], i))).cast("long"))

        def one(end: Column, i: Column) -> Column:
            value = F.get(p["values"], i)
            return F.struct(
                (end - F.length(F.get(p["whole"], i))).alias("start"), F.lit(number).alias("number"), end.alias("end"), F.lit(kind).alias("kind"),
                F.sha2(value.cast("binary"), 256).alias("hash"), value.rlike(PLACEHOLDER).alias("placeholder"), F.length(value).alias("size"),
            )

        return F.transform(running(sizes, _sum), one)

    return F.when(text.rlike(pattern), F.filter(let(parts, spans), lambda s: s["size"] >= least))


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row per document with the array of its candidates, sorted by start and kind."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kinds = [*BASE_KINDS.items(), *ADDED_KINDS.items()]
    none = F.array().cast("array<struct<start:bigint,number:int,end:bigint,kind:string,hash:string,placeholder:boolean,size:int>>")
    found = F.concat(*(F.coalesce(found_spans(F.col("body"), n, kind, *spec), none) for n, (kind, spec) in enumerate(kinds)))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("body"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("body").alias("text_key"), "owner", "repository", F.array_sort(found).alias("found"))


def ownership(found: DataFrame) -> DataFrame:
    """Per hash the number of distinct repositories and owners; ``found`` has a row per candidate.

    Three partial aggregations: no task gets more of one hash than a row per task
    before it, however many rows hold it.
    """
    places = found.groupBy("hash", "owner", "repository").agg(F.max("placeholder").alias("placeholder"))
    owners = places.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.max("placeholder").alias("placeholder"))
    return owners.groupBy("hash").agg(F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"), F.max("placeholder").alias("placeholder"))


def judged_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id", most_owners: int = 2, most_repositories: int = 50) -> DataFrame:
    """One row per document with its sorted spans, each marked live-looking or not: ``doc_id, text_key, s``.

    A value looks live while at most ``most_owners`` owners and ``most_repositories``
    repositories hold it and it is no placeholder.
    """
    rows = materialise(candidates(docs, doc_id, text, owner, repository), "secret-candidates")
    exploded = rows.where(F.size("found") > 0).select("row", "doc_id", "text_key", "owner", "repository", F.explode("found").alias("s")).select("row", "doc_id", "text_key", "owner", "repository", "s.*")
    # written, so that the join deals both sides and can split a hash that a third of all rows hold
    frequency = materialise(ownership(exploded.select("hash", "owner", "repository", "placeholder")), "secret-ownership").hint("merge")
    judged = exploded.drop("placeholder", "owner", "repository").join(frequency, "hash")
    live = (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories) & ~F.col("placeholder")
    span = F.struct("start", "number", "end", "kind", live.alias("live"))
    per_row = judged.select("row", "doc_id", "text_key", span.alias("s")).groupBy("row", "doc_id", "text_key").agg(F.array_sort(F.collect_list("s")).alias("s"))
    empty = rows.where(F.size("found") == 0).select("row", "doc_id", "text_key", F.array().cast(per_row.schema["s"].dataType).alias("s"))
    return per_row.unionByName(empty)


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id", most_owners: int = 2, most_repositories: int = 50) -> DataFrame:
    """One row per document: counts and digest of the base spans, all spans, and how many look live or copied.

    Null text is empty: no spans, and the digest of the empty list.  A null owner
    or repository counts as one owner or repository.  Repeated rows are judged row
    by row.  An empty table gives no rows.
    """
    base = lambda s: s["number"] < len(BASE_KINDS)
    listed = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda test: F.size(F.filter("s", test)).cast("long")
    of_kind = lambda kind: n(lambda s: s["kind"] == kind).alias(f"n_{kind}")
    return judged_spans(docs, doc_id, text, owner, repository, most_owners, most_repositories).select(
        "doc_id", *map(of_kind, BASE_KINDS),
        F.sha2(listed(F.filter("s", base)).cast("binary"), 256).alias("base_sha256"), listed(F.filter("s", lambda s: base(s) | s["live"])).alias("spans"),
        n(lambda s: s["live"]).alias("n_live"), n(lambda s: ~s["live"]).alias("n_copied"),
    )


def _redacted(body: Column, spans: Column, mark: str, block: int = 4096) -> Column:
    """The text with its spans (sorted by start) replaced; it is cut in blocks once, so that no slice is sought from its start."""
    # the text up to the next whole block belongs to the block it starts in
    def between(cut: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / block).cast("int")
        some = F.array_join(F.slice(cut, first + 1, F.floor(end / block).cast("int") - first + 1), "")
        return F.substring(some, (start - first * block + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))

    def joined(v: Column) -> Column:
        before = lambda i: F.coalesce(F.get(v["ends"], i - 1), F.lit(0).cast("long"))
        piece = lambda s, i: F.when(s["start"] >= before(i), F.concat(between(v["cut"], before(i), s["start"]), F.lit(mark))).otherwise(F.lit(""))
        rest = between(v["cut"], before(F.size(spans)), F.length(body).cast("long"))
        return F.concat(F.array_join(F.transform(spans, piece), ""), rest)

    ends = running(F.transform(spans, lambda s: s["end"]), _larger)
    return let(F.struct(F.regexp_extract_all(body, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)).alias("cut"), ends.alias("ends")), joined)


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[SECRET]", broadcast_spans: int = 200_000, **options) -> DataFrame:
    """The rows and columns of ``docs`` with every live-looking span of the text replaced by ``mark``.

    Overlapping spans are replaced together.  Other texts, null among them, and
    values that many owners or repositories hold stay as they are.  Columns may
    have any names.
    """
    taken = {c.lower() for c in docs.columns}
    id_, key, spans = (next(n for k in range(len(taken) + 1) if (n := f"_{name}{k}") not in taken) for name in ("id", "key", "spans"))
    found = judged_spans(docs, doc_id, text, **options).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.filter("s", lambda s: s["live"]).alias(spans))
    # a row that repeats needs its spans once
    found = materialise(found.where(F.size(spans) > 0).dropDuplicates([id_, key]), "secret-live")
    total = found.agg(F.sum(F.size(spans))).head(1)[0][0] or 0
    found = F.broadcast(found) if total <= broadcast_spans else found.hint("merge")
    body = F.col(text)
    joined = docs.join(found, F.col(doc_id).cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(body.cast("string"), F.lit(""))) == F.col(key)), "left")
    return joined.withColumn(text, F.when(F.col(spans).isNotNull(), _redacted(body.cast("string"), F.col(spans), mark)).otherwise(body)).select(*docs.columns)
