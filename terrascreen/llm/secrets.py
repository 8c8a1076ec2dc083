"""Secret scan by linking parts of a credential: strong findings stand alone, weak parts only beside what completes them."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascreen.llm.shared import written

#: Kinds in the order in which spans are listed; the first three are always reported.
PATTERNS = {
    "assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "identifier": r"""(?i)\b(?:user(?:name)?|login|account|client_?id|key_?id|tenant)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""",
    "opaque": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])",
    "endpoint": r"""(?i)\b(?:https?|ftps?|ssh|ldaps?|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]{4,}|(?i)\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[a-z0-9-]+(?:\.[a-z0-9-]+)+""",
}
KINDS = tuple(PATTERNS)
BASE = 3
LEAST_ASSIGNED = 8
#: What each role needs nearby. Roles: identifiers, secrets, endpoints; an opaque string that is part of an address is ordinary unless it is named.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "opaque": "secret", "endpoint": "endpoint"}
NEEDS = {"identifier": ("secret", "embedded"), "secret": ("identifier", "endpoint"), "embedded": ("identifier",), "endpoint": ("secret",)}
SCOPE = 200


def _items(kind: int, found: str, gaps: str) -> Column:
    """Per match: what lies between it and the one before, its own length, and whether it counts."""
    good = lambda m: F.lit(True)
    if KINDS[kind] == "assign":
        good = lambda m: F.length(F.regexp_extract(m, PATTERNS["assign"], 1)) >= LEAST_ASSIGNED
    return F.transform(found, lambda m, i: F.struct(
        F.lit(kind).alias("kind"), i.cast("int").alias("i"), F.length(F.col(gaps)[i]).cast("long").alias("gap"),
        F.length(m).cast("long").alias("size"), good(m).alias("good")))


def matches(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """``kept`` (a struct), ``at`` (a row number) and ``items`` (all matches of all kinds by lengths), written once."""
    source = docs.select(F.struct(*[docs[c] for c in keep]).alias("kept"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    found = source.withColumns({f"m{k}": F.regexp_extract_all("text", F.lit(p), 0) for k, p in enumerate(PATTERNS.values())})
    gaps = found.withColumns({f"g{k}": F.when(F.size(f"m{k}") > 0, F.split("text", p, -1)) for k, p in enumerate(PATTERNS.values())})
    items = F.concat(*[_items(k, f"m{k}", f"g{k}") for k in range(len(KINDS))])
    return written(gaps.select("kept", F.monotonically_increasing_id().alias("at"), items.alias("items")), "secret-matches")


def _near(left: DataFrame, right: DataFrame, condition: Column, reach: int) -> DataFrame:
    """Rows of ``left`` that some row of ``right`` in the same document meets.

    An interval join: both sides are laid on buckets of ``SCOPE`` code points, and the condition is checked inside a bucket.
    """
    bucket = lambda position: F.floor(position / SCOPE)
    a = left.withColumn("b", F.explode(F.sequence(bucket(F.col("start") - reach), bucket(F.col("end") + reach))))
    b = right.select(F.col("at").alias("at2"), F.col("role").alias("role2"), F.col("start").alias("start2"), F.col("end").alias("end2"),
                     F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))).alias("b2"))
    return a.join(b, (F.col("at") == F.col("at2")) & (F.col("b") == F.col("b2")) & condition, "left_semi").drop("b").dropDuplicates(["at", "kind", "start"])


def scan(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``spans``: an array of ``start, kind, end, free`` in code points, by start and then kind as in ``KINDS``.

    The first three kinds are always there; a weak part only if a complementary one, apart from it, lies within ``SCOPE`` code points and no
    strong finding covers it. ``free`` is where a span goes on beyond all earlier ones (for masking). A null text counts as empty; texts without findings
    have an empty array; repeated rows each have their own.
    """
    found = matches(docs, text, keep)
    order = Window.partitionBy("at", "kind").orderBy("i")
    parts = found.where(F.size("items") > 0).select("at", F.explode("items").alias("item")).select("at", "item.*")
    parts = parts.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order)).withColumn("start", F.col("end") - F.col("size"))
    role = F.element_at(F.array(*[F.lit(ROLES[k]) for k in KINDS]), F.col("kind") + 1)
    parts = written(parts.where("good").select("at", "kind", "start", "end", role.alias("role")), "secret-parts")
    strong, weak = parts.where(F.col("kind") < BASE), parts.where(F.col("kind") >= BASE)
    overlapping = (F.col("start") < F.col("end2")) & (F.col("start2") < F.col("end"))
    key = ["at", "kind", "start"]
    weak = weak.join(_near(weak, strong, overlapping, 0).select(*key), key, "left_anti").select(*weak.columns)
    # What an identifier consists of is no secret beside it; what an address consists of needs an identifier apart from it.
    opaque = weak.where(F.col("kind") == KINDS.index("opaque"))
    named = _near(opaque, weak, overlapping & (F.col("role2") == "identifier"), 0).select(*key)
    inside = _near(opaque, weak, overlapping & (F.col("role2") == "endpoint"), 0).select(*key, F.lit("embedded").alias("inside"))
    weak = weak.join(named, key, "left_anti").join(inside, key, "left").withColumn("role", F.coalesce("inside", "role")).select(*weak.columns)
    weak = written(weak, "secret-weak")
    complementary = F.lit(False)
    for own, others in NEEDS.items():
        complementary = complementary | ((F.col("role") == own) & F.col("role2").isin(*others))
    # Complements are different text: a part that overlaps another does not complete it.
    apart = F.greatest("start", "start2") - F.least("end", "end2")
    linked = _near(weak, strong.unionByName(weak), complementary & apart.between(0, SCOPE), SCOPE)
    spans = strong.unionByName(linked)
    earlier = Window.partitionBy("at").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("free", F.greatest("start", F.coalesce(F.max("end").over(earlier), F.lit(0))))
    listed = spans.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "free"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,free:bigint>>")
    with_parts = found.where(F.size("items") > 0).select("kept", "at").join(listed, "at", "left")
    everything = (with_parts.select("kept", F.coalesce("spans", empty).alias("spans"))
                  .unionByName(found.where(F.size("items") == 0).select("kept", empty.alias("spans"))))
    return everything.select(*[F.col(f"kept.`{c}`").alias(c) for c in keep if c != "spans"], "spans")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def masked(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with each found span replaced by ``mark`` (overlapping ones once) and, if there is such a column, ``chars`` counted anew.

    Rows without findings come back unchanged, a null text stays null.
    """
    boxed = docs.select(F.struct("*").alias("row"), F.col(f"`{text}`").alias("text"))
    found = scan(boxed, "text", ["row"]).withColumn("text", F.col(f"row.`{text}`"))
    body = found.withColumn("cuts", F.filter("spans", lambda s: s["free"] < s["end"])).withColumn("size", F.size("cuts"))
    until = lambda i: F.when(i > 0, F.get("cuts", i - 1)["end"]).otherwise(0).cast("int")
    piece = lambda i: F.concat(
        F.substring(F.col("text"), until(i) + 1, (F.coalesce(F.get("cuts", i)["free"], F.length("text")) - until(i)).cast("int")),
        F.when((i < F.col("size")) & (F.get("cuts", i)["free"] == F.get("cuts", i)["start"]), mark).otherwise(""))
    rebuilt = F.array_join(F.transform(F.sequence(F.lit(0), F.col("size")), piece), "")
    body = body.withColumn("new", F.when(F.col("size") > 0, rebuilt).otherwise(F.col("text")))
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns}
    columns[text] = F.col("new")
    if chars in columns:
        columns[chars] = F.when(F.col("size") > 0, F.length("new").cast(docs.schema[chars].dataType)).otherwise(columns[chars])
    return body.select(*[column.alias(c) for c, column in columns.items()])
