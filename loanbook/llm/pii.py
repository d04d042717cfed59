"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. They seed a graph: an instance is a value,
a pattern is its left context (the last ``CONTEXT_WORDS`` words before it), an edge joins the two where the value occurs
in the context. Tokens with several digits that no base pattern covers are instances of unknown kind. In rounds, a
pattern's confidence for a kind is the share of its instances that belong to it, and an instance's score is the chance
that at least one of its patterns is right. At the end, unknown tokens in confident patterns are added as spans.
All counts run over distinct edges of all documents, so copies of a text do not vote twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanbook.llm.common import staged

KINDS = ("email", "ip", "card", "phone")
# The base patterns; starting at the first character of a run, or where the last match ended, and never giving back
# what was taken, find the same spans as the plain forms in linear time and constant stack.
MATCHES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
TOKEN = r"(?<![A-Za-z0-9._@+/-])[A-Za-z0-9._@+/-]*[0-9][A-Za-z0-9._@+/-]*"
CONTEXT_WORDS = 2
CONTEXT_CHARS = 60


@dataclass(frozen=True)
class BootSettings:
    rounds: int = 3
    least_support: int = 5  # distinct known values in a pattern
    confidence: float = 0.8
    least_digits: int = 4


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _located(text: Column, pattern: str) -> Column:
    """All matches of a pattern with their places: array of (start, end, value, before), code points, end exclusive.

    Places are sums of the lengths of the matches and of the pieces between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), found.alias("value"))
    start = lambda acc, p: acc["at"] + F.length(p["piece"])
    nothing = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
    walked = F.aggregate(
        F.slice(pairs, 1, F.size(found)),
        F.struct(F.lit(0).alias("at"), nothing.alias("spans")),
        lambda acc, p: F.struct(
            (start(acc, p) + F.length(p["value"])).alias("at"),
            F.array_append(acc["spans"], F.struct(
                start(acc, p).alias("start"), (start(acc, p) + F.length(p["value"])).alias("end"),
                p["value"].alias("value"), F.right(p["piece"], F.lit(CONTEXT_CHARS)).alias("before"))).alias("spans")),
    )
    return F.when(F.size(found) > 0, walked["spans"]).otherwise(nothing)


def _context(before: Column) -> Column:
    """The last words before a value, lower case, without punctuation."""
    parts = F.array_remove(F.split(F.lower(before), r"[^\p{L}\p{N}]+"), "")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - CONTEXT_WORDS + 1), CONTEXT_WORDS), " ")


def base_spans(text: Column) -> Column:
    """Spans of the base patterns: array of (start, rank, end, kind, value, before), by start and then kind."""
    return F.array_sort(F.concat(*[_base_of(kind, rank, text) for rank, kind in enumerate(KINDS)]))


def _base_of(kind: str, rank: int, text: Column) -> Column:
    kept = F.filter(_located(text, MATCHES[kind]), lambda m: _valid(kind, m["value"]))
    return F.transform(kept, lambda m: F.struct(
        m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"),
        m["value"].alias("value"), m["before"].alias("before")))


def _row_key(key: str, text: str) -> list[Column]:
    """Rows of one key and text have the same spans; others are told apart by two hashes of the text."""
    return [F.col(key).alias("_key"), F.xxhash64(text).alias("_text1"), F.xxhash64(F.lit(1), text).alias("_text2")]


def occurrences(docs: DataFrame, key: str, text: str, settings: BootSettings) -> DataFrame:
    """One row per row: the row key, base spans and the unknown tokens outside them, stored without the texts."""
    whole = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    digits = lambda t: F.length(F.regexp_replace(t["value"], "[^0-9]", ""))
    spans = whole.withColumn("base", base_spans(F.col("_text"))).withColumn("tokens", _located(F.col("_text"), TOKEN))
    outside = F.filter("tokens", lambda t: (digits(t) >= settings.least_digits) & (F.length(t["value"]) >= 6) & ~F.exists(
        F.col("base"), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    short = lambda kind: lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), (s["kind"] if kind else F.lit(None).cast("string")).alias("kind"),
        F.lower(s["value"]).alias("value"), _context(s["before"]).alias("context"))
    return staged(
        spans.withColumn("unknown", outside)
        .select(*_row_key(key, "_text"), F.transform("base", short(True)).alias("base"), F.transform("unknown", short(False)).alias("unknown")),
        "pii-spans")


def patterns(found: DataFrame, settings: BootSettings = BootSettings()) -> DataFrame:
    """Confident patterns: (context, kind, confidence, support)."""
    places = found.select(F.explode(F.concat("base", "unknown")).alias("o")).select("o.*").filter("context != ''")
    # A value that is known anywhere is known everywhere.
    edges = staged(places.groupBy("context", "value").agg(F.max("kind").alias("kind")), "pii-edges")
    known = edges.groupBy("value").agg(F.max("kind").alias("known"))
    scores = known.select("value", *[F.when(F.col("known") == k, 1.0).otherwise(0.0).alias(k) for k in KINDS], F.col("known").isNotNull().alias("seed"))
    for turn in range(settings.rounds):
        graded = edges.select("context", "value").join(scores, "value")
        rated = graded.groupBy("context").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("seed").cast("int")).alias("support"), *[F.sum(k).alias(k) for k in KINDS])
        rated = rated.filter(F.col("support") >= settings.least_support).select(
            "context", "support", *[(F.col(k) / (F.col("n") + 1)).alias(k) for k in KINDS])
        rated = staged(rated.filter(F.greatest(*KINDS) >= settings.confidence / 2), f"pii-patterns-{turn}")
        if turn + 1 < settings.rounds:
            reached = edges.join(rated, "context").groupBy("value").agg(
                *[(1 - F.exp(F.sum(F.log(1 - F.least(F.col(k), F.lit(0.999999)))))).alias(f"_{k}") for k in KINDS])
            moved = scores.join(reached, "value", "left")
            scores = staged(moved.select(
                "value", *[F.when(F.col("seed"), F.col(k)).otherwise(F.coalesce(f"_{k}", F.lit(0.0))).alias(k) for k in KINDS], "seed"), f"pii-scores-{turn}")
    best = F.array_max(F.array(*[F.struct(F.col(k).alias("confidence"), F.lit(k).alias("kind")) for k in KINDS]))
    return rated.withColumn("_best", best).select("context", "_best.kind", "_best.confidence", "support").filter(F.col("confidence") >= settings.confidence)


def added_spans(found: DataFrame, confident: DataFrame) -> DataFrame:
    """Unknown tokens in confident patterns: one row per row key with the array ``added`` of (start, rank, end, kind)."""
    places = found.select("_key", "_text1", "_text2", F.explode("unknown").alias("o")).select("_key", "_text1", "_text2", "o.start", "o.end", "o.context")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")) - 1
    hit = places.join(confident.select("context", "kind"), "context")
    return hit.groupBy("_key", "_text1", "_text2").agg(F.array_sort(F.collect_set(
        F.struct("start", rank.cast("int").alias("rank"), "end", "kind"))).alias("added")).toDF("_of", "_of1", "_of2", "added")


def _same() -> Column:
    return F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_text1") == F.col("_of1")) & (F.col("_text2") == F.col("_of2"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: BootSettings = BootSettings()) -> DataFrame:
    """Spans of every text: (key, n_email, n_ip, n_card, n_phone, n_added, base, spans), one row per row.

    The counts and ``base`` are of the base patterns, ``spans`` has the added ones too; both are lists of kind:start:end.
    A null text counts as empty, a null key is kept, repeated rows get the same spans, an empty table gives an empty
    result, and other columns are not read."""
    found = occurrences(docs, key, text, settings)
    added = added_spans(found, patterns(found, settings))
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).cast("int") - 1
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    joined = found.join(added, _same(), "left").select("_key", "base", "added").withColumn("_base", base)
    spans = F.array_sort(F.concat("_base", F.coalesce("added", F.array_except("_base", "_base"))))
    counts = [_count(k).alias(f"n_{k}") for k in KINDS]
    return joined.select(
        F.col("_key").alias(key), *counts, F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"),
        _listed(F.col("_base")).alias("base"), _listed(spans).alias("spans"))


def mask(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: BootSettings = BootSettings()) -> DataFrame:
    """The rows with every span replaced by its kind in brackets; where spans overlap, the first one counts.

    A null text stays null; n_chars, if there is such a column, is counted anew. Other columns pass through, whatever their
    names."""
    added = added_spans(found := occurrences(docs, key, text, settings), patterns(found, settings))
    plain = F.coalesce(F.col(text), F.lit(""))
    # The row travels as one struct, so that none of its names can clash.
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_key"), plain.alias("_plain"))
    keyed = keyed.withColumns({"_text1": F.xxhash64("_plain"), "_text2": F.xxhash64(F.lit(1), "_plain")})
    base = F.transform(base_spans(F.col("_plain")), lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    joined = keyed.join(added, _same(), "left").select("_row", "_plain", "added").withColumn("_base", base)
    spans = F.array_sort(F.concat("_base", F.coalesce("added", F.array_except("_base", "_base"))))
    walked = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(
            acc["out"], F.substring("_plain", acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))).otherwise(acc),
        lambda acc: F.concat(acc["out"], F.substring("_plain", acc["at"] + 1, F.length("_plain"))))
    given = {c: F.col("_row").getField(c) for c in docs.columns}
    new = F.when(given[text].isNotNull() & (F.size(spans) > 0), walked).otherwise(given[text])
    result = joined.select("_row", new.alias("_new"), (F.size(spans) > 0).alias("_changed"))
    out = {**given, text: F.col("_new")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("_changed"), F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(given["n_chars"])
    return result.select(*[value.alias(name) for name, value in out.items()])
