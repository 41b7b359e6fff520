"""Schemas that drift between files: one consistent table and a log of every change.

A column lifespan catalogue: the top-level keys of every record are exploded with their types, the
type of a field in a file is that of most of its non-null values, and the files of a feed are
numbered in order. Per feed, field and type, runs of consecutive files are the islands. Where one
island of a field follows another without a gap its type has changed; an island that begins after a
gap is a start, one that ends before the feed's last file an ending. A start and an ending of two
fields whose values agree for most rules in both files are a renaming; the rest are additions and
removals.

Which rule a record is about is told by its values: string fields with (nearly) as many values as
the file has records identify, whatever they are called, and two records that share such a value are
about one rule.

Only (file, field, type) counts and the values of identifying, starting and ending fields are
shuffled.

Defined results: bodies that aren't JSON objects have no fields; records delivered again count
once (the latest body stays); null feeds and file numbers are left out; a feed of one file has no
changes; ties between types go to the alphabetically first; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulesieve.session import broadcast_up_to, cut

#: Share of distinct values from which a string field of a file identifies its records; below one, as the count is approximate.
IDENTIFIES = 0.9

#: Canonical field -> (type, keys it is commonly known by); further keys are learned from the renamings.
ALIASES: dict[str, tuple[str, tuple[str, ...]]] = {
    "name": ("string", ("name", "rule_name", "id", "rule_id")),
    "pattern": ("string", ("pattern", "regex", "regexp", "re")),
    "severity": ("string", ("severity", "level")),
    "detector": ("string", ("detector", "type", "category")),
    "enabled": ("boolean", ("enabled",)),
    "tags": ("array<string>", ("tags",)),
    "entropy": ("double", ("entropy",)),
    "priority": ("bigint", ("priority",)),
    "samples": ("bigint", ("samples",)),
    "confidence": ("double", ("confidence",)),
    "description": ("string", ("description",)),
    "owner": ("string", ("owner",)),
    "reviewer": ("string", ("reviewer",)),
}


def delivered_once(records: DataFrame) -> DataFrame:
    """(feed, file_no, record, body): the latest body of each record."""
    number = F.coalesce(F.col("record_no").cast("string"), F.concat(F.lit("#"), F.md5(F.coalesce("body", F.lit("")))))
    keyed = records.where("feed IS NOT NULL AND file_no IS NOT NULL").select("feed", "file_no", number.alias("record"), "body", "loaded_at")
    return keyed.groupBy("feed", "file_no", "record").agg(F.max_by("body", F.struct("loaded_at", "body")).alias("body"))


def exploded(once: DataFrame) -> DataFrame:
    """(feed, file_no, record, field, type, value) of every non-null top-level value."""
    once = once.withColumn("v", F.try_parse_json("body")).drop("body")
    fields = once.lateralJoin(once.sparkSession.tvf.variant_explode(F.col("v").outer()).select("key", "value"))
    of = F.schema_of_variant("value")
    kind = (
        F.when(of == "STRING", "string").when(of == "BOOLEAN", "boolean").when(of.startswith("ARRAY"), "array").when(of.startswith("OBJECT"), "object").otherwise("number")
    )
    told = fields.where(F.col("key").isNotNull() & (of != "VOID"))
    return told.select("feed", "file_no", "record", F.col("key").alias("field"), kind.alias("type"), F.col("value").cast("string").alias("value"))


def catalogue(values: DataFrame) -> DataFrame:
    """(feed, file_no, field, type, share): share is that of distinct values among the field's non-null ones, 0 for no string field."""
    counts = values.groupBy("feed", "file_no", "field", "type").agg(F.count("*").alias("n"), F.approx_count_distinct(F.when(F.col("type") == "string", F.col("value"))).alias("distinct"))
    best = F.min_by(F.struct("type", (F.col("distinct") / F.col("n")).alias("share")), F.struct(-F.col("n"), "type"))
    return counts.groupBy("feed", "file_no", "field").agg(best.alias("b"), F.sum("n").alias("n")).select("feed", "file_no", "field", "b.type", F.when(F.col("b.type") == "string", F.col("b.share")).otherwise(0.0).alias("share"), "n")


def placed_files(once: DataFrame) -> DataFrame:
    """(feed, file_no, at, files): the place of every file within its feed from 1, and how many files the feed has."""
    files = once.select("feed", "file_no").distinct()
    return files.withColumn("at", F.row_number().over(Window.partitionBy("feed").orderBy("file_no"))).withColumn("files", F.count("*").over(Window.partitionBy("feed")))


def lifespans(fields: DataFrame) -> DataFrame:
    """(feed, field, type, begin, finish, files) of fields (feed, field, type, at, files): islands of consecutive files."""
    in_order = Window.partitionBy("feed", "field", "type").orderBy("at")
    steps = fields.withColumn("breaks", F.coalesce(F.col("at") - F.lag("at").over(in_order) > 1, F.lit(False)).cast("int"))
    islands = steps.withColumn("island", F.sum("breaks").over(in_order))
    return islands.groupBy("feed", "field", "type", "island").agg(F.min("at").alias("begin"), F.max("at").alias("finish"), F.max("files").alias("files")).drop("island")


def turns(spans: DataFrame) -> DataFrame:
    """(feed, field, at, what, type, detail) of every start, ending and change of type."""
    of_field = Window.partitionBy("feed", "field").orderBy("begin")
    told = spans.select("*", F.lag("finish").over(of_field).alias("before"), F.lag("type").over(of_field).alias("was"), F.lead("begin").over(of_field).alias("after"))
    event = lambda what, at, detail: F.struct(F.lit(what).alias("what"), at.cast("int").alias("at"), detail.alias("detail"))
    begin, finish = F.col("begin"), F.col("finish")
    joins = F.coalesce(F.col("before") + 1 == begin, F.lit(False))
    events = F.array(
        F.when((begin > 1) & joins, event("type_changed", begin, F.concat_ws(" to ", "was", "type"))),
        F.when((begin > 1) & ~joins, event("start", begin, F.col("type"))),
        F.when((finish < F.col("files")) & ~F.coalesce(F.col("after") == finish + 1, F.lit(False)), event("ending", finish + 1, F.col("type"))),
    )
    return told.select("feed", "field", "type", F.explode(F.array_compact(events)).alias("e")).select("feed", "field", "e.at", "e.what", "type", "e.detail")


def renamings(once: DataFrame, files: DataFrame, fields: DataFrame, events: DataFrame) -> DataFrame:
    """(feed, at, old, new) of endings and starts of one type whose values agree for most rules in both files."""
    ends = events.where("what = 'ending'").select("feed", "at", "type", F.col("field").alias("old"))
    starts = events.where("what = 'start'").select("feed", "at", "type", F.col("field").alias("new"))
    both = cut(ends.join(starts, ["feed", "at", "type"]))
    sides = both.select("feed", "at", F.explode(F.array(F.struct((F.col("at") - 1).alias("here"), F.col("old").alias("field"), F.lit(0).alias("side")), F.struct(F.col("at").alias("here"), F.col("new").alias("field"), F.lit(1).alias("side")))).alias("s"))
    sides = sides.select("feed", "at", F.col("s.here").alias("here"), "s.field", "s.side").distinct()
    # values of a file are wanted as those of a field that goes or comes, and of the fields that identify its records
    told = sides.select("feed", "at", "here", "side").distinct()
    known = fields.where(F.col("share") >= IDENTIFIES).select("feed", F.col("at").alias("here"), "field")
    wanted = cut(sides.withColumn("identifies", F.lit(False)).union(told.join(known, ["feed", "here"]).select("feed", "at", "here", "field", "side", F.lit(True))))
    where = files.select("feed", "file_no", F.col("at").alias("here"))
    wanted = wanted.join(where, ["feed", "here"]).drop("here")
    values = cut(exploded(once).join(broadcast_up_to(wanted, wanted.count()), ["feed", "file_no", "field"]).select("feed", "at", "side", "record", "field", "value", "identifies"))
    who = values.where("identifies").select("feed", "at", "side", "record", F.col("value").alias("rule"))
    # a value that several records of a file have tells nothing
    who = who.groupBy("feed", "at", "side", "rule").agg(F.min("record").alias("record"), F.max("record").alias("other")).where("record = other")
    pairs = who.groupBy("feed", "at", "rule").agg(F.max(F.when(F.col("side") == 0, F.col("record"))).alias("r0"), F.max(F.when(F.col("side") == 1, F.col("record"))).alias("r1")).where("r0 IS NOT NULL AND r1 IS NOT NULL").select("feed", "at", "r0", "r1").distinct()
    of = lambda side, name, value, record: values.where(f"NOT identifies AND side = {side}").select("feed", "at", F.col("record").alias(record), F.col("field").alias(name), F.col("value").alias(value))
    met = pairs.join(of(0, "old", "was", "r0"), ["feed", "at", "r0"]).join(of(1, "new", "is", "r1"), ["feed", "at", "r1"]).join(both.select("feed", "at", "old", "new"), ["feed", "at", "old", "new"], "left_semi")
    close = met.groupBy("feed", "at", "old", "new").agg(F.count_if(F.col("was") == F.col("is")).alias("same"), F.count("*").alias("n")).where("same * 2 > n")
    best = lambda side: Window.partitionBy("feed", "at", side).orderBy(F.desc("same"), "old", "new")
    return close.withColumn("r1", F.row_number().over(best("old"))).withColumn("r2", F.row_number().over(best("new"))).where("r1 = 1 AND r2 = 1").select("feed", "at", "old", "new")


def changes(records: DataFrame) -> DataFrame:
    """(feed, file_no, field_name, drift_kind, detail)."""
    once = cut(delivered_once(records))
    files = cut(placed_files(once))
    fields = cut(catalogue(exploded(once)).join(files, ["feed", "file_no"]))
    events = cut(turns(lifespans(fields)))
    renamed = cut(renamings(once, files, fields, events))
    mark = lambda field, what, was: F.struct(field.alias("field"), F.lit(what).alias("what"), was.alias("was"))
    marks = renamed.select("feed", "at", F.explode(F.array(mark(F.col("old"), "ending", F.lit("")), mark(F.col("new"), "start", F.col("old")))).alias("m")).select("feed", "at", "m.*")
    # of a renaming the start stays, under its new name, and the ending goes
    log = events.join(marks, ["feed", "at", "field", "what"], "left").where("was IS NULL OR was <> ''")
    kind = F.when(F.col("was").isNotNull(), "renamed").when(F.col("what") == "start", "added").when(F.col("what") == "ending", "removed").otherwise(F.col("what"))
    detail = F.when(F.col("was").isNotNull(), F.concat(F.lit("was "), F.col("was"))).otherwise(F.col("detail"))
    out = log.select("feed", "at", F.col("field").alias("field_name"), kind.alias("drift_kind"), detail.alias("detail"))
    return out.join(files.drop("files"), ["feed", "at"]).select("feed", F.col("file_no").cast("bigint").alias("file_no"), "field_name", "drift_kind", "detail")


def learned_aliases(log: DataFrame, aliases: dict[str, tuple[str, tuple[str, ...]]] = ALIASES) -> dict[str, tuple[str, tuple[str, ...]]]:
    """The alias table with every key that renamings of the change log lead to; a key stays with the field that has it first.

    What comes to the driver is one row per pair of field names that replaced one another in any feed.
    """
    pairs = sorted((r["detail"][len("was ") :], r["field_name"]) for r in log.where("drift_kind = 'renamed'").select("field_name", "detail").distinct().toLocalIterator())
    owner = {k: name for name, (_, keys) in aliases.items() for k in keys}
    grown = True
    while grown:
        grown = False
        for a, b in pairs:
            for x, y in ((a, b), (b, a)):
                if x in owner and y not in owner:
                    owner[y], grown = owner[x], True
    return {name: (kind, (*keys, *sorted(k for k, n in owner.items() if n == name and k not in keys))) for name, (kind, keys) in aliases.items()}


def consistent(records: DataFrame, aliases: dict[str, tuple[str, tuple[str, ...]]] = ALIASES) -> DataFrame:
    """(feed, file_no, record, canonical fields): casts generated from the alias table.

    A wrapped value ({"value": …}, {"en": …} or a list for a scalar) is unwrapped; what cannot be
    cast is null.
    """
    once = delivered_once(records).withColumn("v", F.try_parse_json("body"))

    def read(key: str, kind: str):
        path = f'$["{key}"]'
        if kind.startswith("array"):
            one = F.try_variant_get("v", path, "string")
            return F.coalesce(F.try_variant_get("v", path, kind), F.when(one.isNotNull() & ~one.startswith("[") & ~one.startswith("{"), F.array(one)))
        inner = [F.try_variant_get("v", path + tail, "string") for tail in ('["value"]', '["en"]', "[0]")]
        whole = F.try_variant_get("v", path, "string")
        return F.coalesce(*inner, F.when(~(whole.startswith("[") | whole.startswith("{")), whole)).try_cast(kind)

    return once.select("feed", F.col("file_no").cast("bigint").alias("file_no"), "record", *[F.coalesce(*[read(k, kind) for k in keys]).alias(n) for n, (kind, keys) in aliases.items()])
