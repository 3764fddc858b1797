"""Secret scans with multipart credential linking, in DataFrame functions only.

Base patterns find what is a secret by its form. Weak patterns find what may be a part of a credential:
an identifier, a secret, an endpoint. A weak part is reported only where a part that complements it
begins within the same scope, a number of code points of one document. Scopes are joined by interval:
parts are bucketed by where they begin, and a weak part looks into its own bucket and the two beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import col, materialise, others

#: Kinds in order: pattern, a cheaper test that any match passes, what a match must satisfy, part it plays.
#: hex and access are written with their least lengths inside the pattern, which finds the same runs.
BASE = {
    "assign": (r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", None, r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}$""", "secret"),
    "access": (r"AKIA[A-Z0-9]{14,}", "AKIA", None, "identifier"),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{16,}", None, None, None),
}
WEAK = {
    "identifier": (r"""(?i)\b(?:user_?name|user_?id|login|account_?id|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", None, None, "identifier"),
    "secret": (r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}", None, r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])", "secret"),
    "endpoint": (r"""(?i)\b(?:https?|ftps?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{4,}""", None, None, "endpoint"),
}
KINDS = {**BASE, **WEAK}
#: A weak part of the first kind is reported beside a part, weak or base, of one of the others.
COMPLEMENTS = {"identifier": ["secret"], "secret": ["identifier", "endpoint"], "endpoint": ["secret"]}


def _matches(text: Column, kind: str) -> Column:
    """Lengths of what lies before each match, and the matches; null where there are none."""
    pattern, hint, _, _ = KINDS[kind]
    some = text.contains(hint) if hint else text.rlike(pattern)
    return F.when(some, F.struct(F.transform(F.split(text, pattern, -1), F.length).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")))


def find_secrets(docs: DataFrame, text: str = "text", carry: list[str] | None = None, scope: int = 300) -> DataFrame:
    """The carried columns of docs (all but the text, if not named) with n_assign, n_access, n_hex and spans: an array of
    (start, kind, stop) by start, then kind in the order of KINDS; code points, stop exclusive.

    Base matches are leftmost and don't overlap within a kind; all are reported. A weak match that overlaps a base one is
    left out; else it is reported when a complementary part of the document begins at most scope code points from it.
    A null or empty text has no spans. Every row, repeated or not, is scanned for itself; ids aren't read. Carried
    columns with an output's name give way. Work is native: no Python on the executors.
    """
    kept = others(docs.select(*map(col, carry)) if carry is not None else docs.drop(text), ["n_assign", "n_access", "n_hex", "spans"])
    # one row a document without its text, written once: row numbers stay, and texts are scanned once
    found = docs.select(F.struct(*map(col, kept)).alias("row"), F.monotonically_increasing_id().alias("uid"), *[_matches(col(text), k).alias(k) for k in KINDS])
    found = materialise(found, "matches")
    each = found.select("uid", F.explode(F.array(*[F.struct(F.lit(n).alias("no"), F.col(k).alias("m")) for n, k in enumerate(KINDS)])).alias("e")).where("e.m IS NOT NULL")
    each = each.select("uid", "e.no", F.posexplode(F.arrays_zip("e.m.gaps", "e.m.found")).alias("pos", "x")).select("uid", "no", "pos", "x.gaps", "x.found").where("found IS NOT NULL")
    size = F.length("found")
    stop = F.sum(F.col("gaps") + size).over(Window.partitionBy("uid", "no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    names = list(KINDS)
    keep = F.lit(True)
    part = F.lit(None).cast("string")
    for n, (_, _, must, plays) in enumerate(KINDS.values()):
        keep = F.when(F.col("no") == n, F.col("found").rlike(must) if must else F.lit(True)).otherwise(keep)
        part = F.when(F.col("no") == n, F.lit(plays)).otherwise(part)
    parts = each.withColumn("stop", stop).withColumn("start", F.col("stop") - size).where(keep).select("uid", "no", "start", "stop", part.alias("part"))
    parts = materialise(parts, "parts")
    base, weak = parts.where(F.col("no") < len(BASE)), parts.where(F.col("no") >= len(BASE))

    # every stretch of scope code points that a base span touches, so that overlap is an equality and a comparison
    touched = base.select(F.col("uid").alias("b_uid"), F.col("start").alias("b_start"), F.col("stop").alias("b_stop"), F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("stop") - 1) / scope))).alias("b_at"))
    stretches = weak.withColumn("at", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("stop") - 1) / scope))))
    overlaps = (F.col("uid") == F.col("b_uid")) & (F.col("at") == F.col("b_at")) & (F.col("start") < F.col("b_stop")) & (F.col("b_start") < F.col("stop"))
    covered = stretches.join(touched, overlaps, "left_semi").select("uid", "no", "start").distinct()
    free = weak.join(covered, ["uid", "no", "start"], "left_anti").select("uid", "no", "start", "stop", "part")

    pool = base.where("part IS NOT NULL").select("uid", "no", "start", "stop", "part").union(free)
    pool = pool.select(F.col("uid").alias("p_uid"), F.col("start").alias("p_start"), F.col("part").alias("p_part"), F.floor(F.col("start") / scope).alias("p_at"))
    at = F.floor(F.col("start") / scope)
    looking = free.withColumn("at", F.explode(F.array(at - 1, at, at + 1))).withColumn("wants", F.explode(F.when(F.col("part") == "identifier", F.array(*map(F.lit, COMPLEMENTS["identifier"]))).when(F.col("part") == "secret", F.array(*map(F.lit, COMPLEMENTS["secret"]))).otherwise(F.array(*map(F.lit, COMPLEMENTS["endpoint"])))))
    beside = (F.col("uid") == F.col("p_uid")) & (F.col("at") == F.col("p_at")) & (F.col("wants") == F.col("p_part")) & (F.abs(F.col("start") - F.col("p_start")) <= scope)
    linked = looking.join(pool, beside, "left_semi").select("uid", "no", "start", "stop").distinct()

    spans = base.select("uid", "no", "start", "stop").union(linked).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), "no", F.col("stop").cast("long").alias("stop")))).alias("s"))
    rows = found.select("row", "uid").join(spans.withColumnRenamed("uid", "s_uid"), F.col("uid") == F.col("s_uid"), "left")
    none = F.array().cast("array<struct<start: bigint, no: int, stop: bigint>>")
    rows = rows.withColumn("s", F.coalesce("s", none))
    number = lambda n: F.size(F.filter("s", lambda x: x.no == n)).cast("long")
    named = F.transform("s", lambda x: F.struct(x.start.alias("start"), F.element_at(F.array(*map(F.lit, names)), x.no + 1).alias("kind"), x.stop.alias("stop")))
    return rows.select("row.*", *[number(n).alias(f"n_{k}") for n, k in enumerate(BASE)], named.alias("spans"))


def spans_text(spans: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:stop, comma-joined; of some kinds or all."""
    chosen = F.filter(spans, lambda x: x.kind.isin(kinds)) if kinds else spans
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x.kind, x.start, x.stop)), ",")


def redact_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", mark: str = "[secret]", scope: int = 300) -> DataFrame:
    """docs with each reported span, or run of overlapping spans, replaced by mark. No row is dropped; null and clean texts stay.

    Spans find their documents again by id and hash of the text, which need not be unique: equal rows have equal spans.
    """
    id_, hash_, size = col(doc_id).alias("id"), F.xxhash64(col(text)).alias("hash"), F.octet_length(col(text)).alias("size")
    found = find_secrets(docs.select(id_, hash_, size, col(text).alias("t")), "t", ["id", "hash", "size"], scope).where(F.size("spans") > 0)
    found = found.groupBy("id", "hash", "size").agg(F.first("spans").alias("found")).select(F.col("id").alias("f_id"), F.col("hash").alias("f_hash"), F.col("size").alias("f_size"), "found")
    t = F.col("t")
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(t, (acc.pos + 1).cast("int"), F.greatest(s.start - acc.pos, F.lit(0)).cast("int"))
        longer = F.struct(F.greatest(acc.pos, s.stop).alias("pos"), F.when(s.start < acc.pos, acc.out).otherwise(F.concat(acc.out, before, F.lit(mark))).alias("out"))
        return F.when(s.stop <= acc.pos, acc).otherwise(longer)

    rest = lambda acc: F.concat(acc.out, F.substring(t, (acc.pos + 1).cast("int"), F.length(t)))
    # docs' own columns ride in a struct, so that none of them can clash with these
    there = docs.select(F.struct(*map(col, docs.columns)).alias("row"), id_, hash_, size, col(text).alias("t"))
    joined = there.join(found, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("hash") == F.col("f_hash")) & F.col("size").eqNullSafe(F.col("f_size")), "left")
    clean = F.when(F.col("found").isNull(), t).otherwise(F.aggregate("found", start, step, rest))
    return joined.select(*[clean.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
