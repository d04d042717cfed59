"""URL verdicts from host rules and, where no rule fits, from words hidden in host and path.

Host labels such as ``cheappills`` are split into words: the most probable split under unigram counts of the words of
all pages, found by Viterbi. Counts, label pieces and labels meet in joins on the word, so no dictionary is sent
anywhere. A multinomial naive Bayes model over the words of host and path, counted on the urls that a rule decides
and on a short list of known bad words, judges the others. Words that the rules themselves name are no evidence: there the
label says nothing but the rule.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanbook.llm.common import ascii_lower, staged

# (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

BLOCK = 1000  # letters of a label that are unfolded together


@dataclass(frozen=True)
class UrlSettings:
    rules: tuple[tuple[str, str, str], ...] = RULES
    longest_word: int = 20
    smoothing: float = 1.0
    bad_words: tuple[str, ...] = ("spam", "casino", "pills", "cheap", "viagra", "porn", "adult", "bet", "gambling", "win", "farm", "ads", "track", "clickbait")
    bad_weight: float = 0.02  # of all counted words, that each bad word is taken to have been seen in blocked urls
    least_odds: float = 1.0  # log odds from which a url is blocked


def parsed(pages: DataFrame, key: str = "page_id", url: str = "url", settings: UrlSettings = UrlSettings()) -> DataFrame:
    """(key, host, path, rule, verdict of the rule); both parts are empty for a null url or one without ``://``."""
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(text, F.lit("://"))
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    raw = F.regexp_extract(F.col("_rest"), r"^[^/?#]*", 0)
    parts = pages.select(F.col(key), rest.alias("_rest")).select(
        key, ascii_lower(raw).alias("host"), F.regexp_extract(F.substring("_rest", F.length(raw) + 1, F.length("_rest")), r"^[^?#]*", 0).alias("path"))
    longest_first = sorted(settings.rules, key=lambda r: -len(r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in reversed(longest_first):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return parts.select(key, "host", "path", rule.alias("rule"), verdict.alias("ruled"))


def word_counts(pages: DataFrame, html: str = "html", settings: UrlSettings = UrlSettings()) -> DataFrame:
    """(word, n) over the visible text of all pages; words longer than a host word can be are left out."""
    text = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), "<[^>]*>", " ")
    found = pages.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word"))
    return found.filter(F.length("word").between(1, settings.longest_word)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def host_parts(host: Column) -> Column:
    """Runs of letters of all labels but the last one."""
    labels = F.split(host, r"\.")
    return F.array_remove(F.split(F.array_join(F.slice(labels, 1, F.greatest(F.lit(0), F.size(labels) - 1)), "."), r"[^\p{L}]+"), "")


def split_words(label: str, pieces: list[tuple[int, int, int]], total: float, longest: int) -> list[str]:
    """Viterbi: the most probable split; ``pieces`` are (start, length, count). A piece without a count has the
    probability of a word seen once, divided by ten for each letter."""
    known = {(a, n): count for a, n, count in pieces}
    best, back = [0.0] + [-math.inf] * len(label), [0] * (len(label) + 1)
    for end in range(1, len(label) + 1):
        for start in range(max(0, end - longest), end):
            n = end - start
            count = known.get((start, n))
            score = best[start] + (math.log(count / total) if count else -math.log(total) - n * math.log(10))
            if score > best[end]:
                best[end], back[end] = score, start
    words, end = [], len(label)
    while end:
        words.append(label[back[end]:end])
        end = back[end]
    return words[::-1]


def segmented(labels: DataFrame, counts: DataFrame, settings: UrlSettings = UrlSettings()) -> DataFrame:
    """(label, words) for distinct labels.

    Labels are cut into blocks before their pieces are unfolded, and pieces carry a number instead of the label, so
    memory and time stay in proportion to a label's length."""
    longest = settings.longest_word
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    labels = staged(labels.select("label", F.monotonically_increasing_id().alias("label_no")), "url-labels")
    whole = labels.select("label_no", "label", F.explode(F.sequence(F.lit(0), F.length("label") - 1, F.lit(BLOCK))).alias("at"))
    blocks = whole.select("label_no", "at", F.substring("label", F.col("at") + 1, F.lit(BLOCK + longest - 1)).alias("block"))
    starts = blocks.select("label_no", "at", "block", F.explode(F.sequence(F.lit(0), F.least(F.length("block"), F.lit(BLOCK)) - 1)).alias("in"))
    starts = starts.select("label_no", (F.col("at") + F.col("in")).alias("start"), F.substring("block", F.col("in") + 1, F.lit(longest)).alias("run"))
    pieces = starts.select("label_no", "start", "run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("len"))
    pieces = pieces.select("label_no", "start", "len", F.substring("run", F.lit(1), F.col("len")).alias("word"))
    met = pieces.join(counts, "word").groupBy("label_no").agg(F.collect_list(F.struct("start", "len", "n")).alias("pieces"))

    def run(label: pd.Series, pieces: pd.Series) -> pd.Series:
        return pd.Series([split_words(a, [(p["start"], p["len"], p["n"]) for p in ([] if b is None else b)], total, longest) for a, b in zip(label, pieces, strict=True)])

    run.__annotations__ = {"label": pd.Series, "pieces": pd.Series, "return": pd.Series}
    return labels.join(met, "label_no", "left").select("label", F.pandas_udf(run, "array<string>")("label", "pieces").alias("words"))


def judged(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", settings: UrlSettings = UrlSettings()) -> DataFrame:
    """(key, host, path, rule, verdict, log_odds), one row per row.

    The verdict is a function of host and path, so urls are judged once each, however often they occur; a url without
    words is allowed. log_odds is null where a rule decides. Null urls have an empty host and path, null keys pass
    through, an empty table gives an empty result, and other columns are not read."""
    urls = parsed(pages, key, url, settings)
    distinct = staged(urls.groupBy("host", "path").agg(F.first("ruled").alias("ruled"), F.count(F.lit(1)).alias("pages")), "urls")
    hosts = distinct.select("host").distinct().withColumn("parts", host_parts(F.col("host")))
    labels = hosts.select(F.explode("parts").alias("label")).distinct()
    words = staged(segmented(labels, word_counts(pages, html, settings), settings), "url-words")
    by_host = hosts.select("host", F.posexplode("parts").alias("at", "label")).join(words, "label").groupBy("host").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda p: p["words"])).alias("words"))
    # Stored, so that the urls of a host that very many share can be split in the join.
    by_host = staged(by_host, "url-hosts")
    path_words = F.array_remove(F.split(F.lower("path"), r"[^\p{L}]+"), "")
    named = sorted({w for _, host, path in settings.rules for w in re.split(r"[^a-z]+", host + path) if w})
    tokens = F.concat(F.coalesce("words", F.array().cast("array<string>")), path_words)
    tokens = F.filter(tokens, lambda t: ~t.isin(named))
    cut = staged(distinct.join(by_host, "host", "left").select("host", "path", "ruled", "pages", tokens.alias("tokens")), "url-tokens")

    a, bad = settings.smoothing, F.lit(0.0)
    seen = cut.filter("ruled IS NOT NULL").select("ruled", "pages", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.sum(F.when(F.col("ruled") == "allow", F.col("pages")).otherwise(0)).cast("double").alias("allow"),
        F.sum(F.when(F.col("ruled") == "block", F.col("pages")).otherwise(0)).cast("double").alias("block"))
    sums = seen.agg(F.sum("allow"), F.sum("block"), F.count(F.lit(1))).first()
    allow, block, vocabulary = float(sums[0] or 0), float(sums[1] or 0), sums[2] + len(settings.bad_words)
    extra = settings.bad_weight * (allow + block) + 1
    known = seen.sparkSession.createDataFrame([(w, extra) for w in settings.bad_words], "token string, extra double")
    block += extra * len(settings.bad_words)
    odds = seen.join(known, "token", "full").select("token", (
        F.log((F.coalesce("block", bad) + F.coalesce("extra", bad) + a) / (block + a * vocabulary))
        - F.log((F.coalesce("allow", bad) + a) / (allow + a * vocabulary))).alias("odds"))
    scored = cut.filter("ruled IS NULL").select("host", "path", F.explode("tokens").alias("token")).join(odds, "token").groupBy("host", "path").agg(F.round(F.sum("odds"), 9).alias("log_odds"))
    verdict = F.coalesce("ruled", F.when(F.col("log_odds") >= settings.least_odds, "block").otherwise("allow"))
    return urls.join(scored, ["host", "path"], "left").select(key, "host", "path", "rule", verdict.alias("verdict"), "log_odds")
