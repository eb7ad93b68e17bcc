"""URL filters: fixed host rules, and association rules mined from labelled URLs.

A URL becomes a set of tokens: its top-level and registered domain, the labels below and their parts, path segments
that are not numbers, file extension, names of query parameters, fragment. Spark's FP-growth mines the sets of
labelled URLs together with their label; what remains are rules "tokens -> label" with enough support and
confidence, more often right than the label alone, and without a shorter rule that is as sure. Tokens that always come
together are mined as one, and fit where any of them is. Rules are matched
by an inverted index: each stands under its rarest token, so only URLs with that token look at it.

Matching works on distinct token sets (URLs that differ in numbers alone share one), and verdicts come back to
URLs by their set; the sets of a host with a third of all pages are as few as any other's. The sets that most pages share,
``HOT_SETS`` at most, are broadcast with their verdicts, and their pages are dealt over all tasks of the join for the rest.

A fixed rule fits its host and all subdomains where the path starts with the rule's path; the longest one that
fits decides. Where none fits, the surest mined rule does, or ``allow``.

Defined cases: a null URL, or one without ``://``, has empty host and path, no tokens and the verdict allow; an
empty path does not start with ``/``, so no rule with a path fits it; without labelled URLs there are no mined
rules; null labels count as clean; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

#: (verdict, host and path) of the fixed rules.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MIN_SUPPORT = 0.002
#: Labelled URLs that a rule must hold for at least, whatever their share; up to 2,500 labelled URLs it decides.
MIN_COUNT = 5
MIN_CONFIDENCE = 0.6
#: More mined rules than this are joined by a shuffle.
BROADCAST_RULES = 20_000
#: A token set of more than one page in so many is hot (so there are no more hot sets than this): its pages get their
#: verdict by a broadcast.
HOT_SETS = 1000
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.translate(F.regexp_extract(url, _URL, 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest of the fixed rules that fits, or null. The rules are few: they become one expression."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def verdict_of(rule: Column, rules: tuple = RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, name in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The sorted set of a URL's tokens; empty without a host."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    below = F.when(n > 2, F.slice(labels, F.lit(1), F.greatest(n - 2, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    parts = F.filter(F.flatten(F.transform(F.filter(below, lambda x: x.contains("-")), lambda x: F.split(x, "-"))), lambda x: x != "")
    segments = F.filter(F.split(F.regexp_replace(F.lower(path), r"\.\w+$", ""), "/"), lambda x: (x != "") & ~x.rlike(r"^\d+$"))
    extension = F.regexp_extract(F.lower(path), r"\.(\w+)$", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0]), lambda x: x != "")
    fragment = F.regexp_extract(url, r"#(.*)$", 1)

    def named(prefix: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.concat(F.lit(prefix + ":"), x))

    def one(prefix: str, value: Column) -> Column:
        return F.when(value != "", F.array(F.concat(F.lit(prefix + ":"), value))).otherwise(F.array().cast("array<string>"))

    domain = F.when(n >= 2, F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")).otherwise("")
    found = F.concat(
        one("tld", F.coalesce(F.try_element_at(labels, F.lit(-1)), F.lit(""))), one("domain", domain), named("label", below), named("part", parts),
        named("path", segments), one("ext", extension), named("query", names), one("fragment", fragment),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))))


_RULE = "items array<string>, label string, confidence double, support double, anchor string"
_ITEM = "token string, item string, freq long, blocked long"


def items_of(labelled: DataFrame, least: int) -> DataFrame:
    """(token, item, freq, blocked) of the tokens that ``least`` labelled URLs or more have. Tokens that the same URLs
    have are one item, named by the first of them: no rule can tell them apart, and mining them apart would count every
    subset of them. The URLs of a token are known by two 64-bit hashes summed over its distinct token sets."""
    n, blocked = F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == "block").cast("long")).alias("blocked")
    sets = labelled.groupBy("tokens").agg(n, blocked)
    words = sets.select(F.explode("tokens").alias("token"), "n", "blocked", F.xxhash64("tokens", F.lit(1)).alias("a"), F.xxhash64("tokens", F.lit(2)).alias("b"))
    found = words.groupBy("token").agg(F.sum("n").alias("freq"), F.sum("blocked").alias("blocked"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    found = materialize(found.where(F.col("freq") >= least), "tokens")
    same = found.groupBy("freq", "a", "b").agg(F.min("token").alias("item"))
    return materialize(found.join(same, ["freq", "a", "b"]).select("token", "item", "freq", "blocked"), "items")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Rules (items, label, confidence, support, anchor) from rows tokens (array), label (allow or block), and the
    items of tokens (``items_of``).

    An item whose URLs all have one label is a rule by itself; no longer rule can be as short and surer, nor can it be
    in one of the other label, so FP-growth gets the items that remain. What it costs grows with the number of sets
    of those that enough URLs share."""
    spark = labelled.sparkSession
    labelled = materialize(labelled.select("tokens", "label"), "labelled")
    n, blocks = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("label") == "block").cast("long")), F.lit(0))).first()
    if blocks in (0, n):  # no rule is more often right than the label alone
        return spark.createDataFrame([], _RULE), spark.createDataFrame([], _ITEM)
    least = max(math.ceil(min_support * n), MIN_COUNT)
    items = items_of(labelled, least)
    pure = (F.col("blocked") == 0) | (F.col("blocked") == F.col("freq"))
    single = items.where(F.col("token") == F.col("item"))
    alone = single.where(pure).select(
        F.array("item").alias("items"), F.when(F.col("blocked") == 0, "allow").otherwise("block").alias("label"),
        F.lit(1.0).alias("confidence"), (F.col("freq") / F.lit(float(n))).alias("support"), F.col("item").alias("anchor"),
    )
    sets = labelled.select("tokens").distinct()
    words = sets.select("tokens", F.explode("tokens").alias("token")).join(single.where(~pure), "token")
    mixed = words.groupBy("tokens").agg(F.collect_list("item").alias("mixed"))  # as many as the URL has tokens
    baskets = labelled.join(mixed, "tokens", "left").select(
        F.array_append(F.coalesce("mixed", F.array().cast("array<string>")), F.concat(F.lit("="), "label")).alias("items")
    )
    baskets = materialize(baskets, "baskets")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n), minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where((F.size("consequent") == 1) & F.col("consequent")[0].startswith("=") & (F.col("lift") > 1))
    found = found.where(~F.exists("antecedent", lambda x: x.startswith("=")))
    found = found.select(
        F.array_sort("antecedent").alias("items"), F.substring(F.col("consequent")[0], 2, 100).alias("label"), "confidence", "support"
    )
    found = materialize(found, "rules")
    # A rule goes where dropping one of its items leaves a rule that is as sure.
    shorter = found.select("label", F.col("items").alias("less"), F.col("confidence").alias("sure"))
    drops = found.withColumn("gone", F.explode("items")).withColumn("less", F.array_remove("items", F.col("gone")))
    needless = drops.join(shorter, ["label", "less"]).where(F.col("sure") >= F.col("confidence")).select("label", "items").distinct()
    found = found.join(needless, ["label", "items"], "left_anti")
    rarest = Window.partitionBy("label", "items").orderBy("freq", "item")
    placed = found.withColumn("item", F.explode("items")).join(single.select("item", "freq"), "item").withColumn("nth", F.row_number().over(rarest))
    placed = placed.where("nth = 1").select("items", "label", "confidence", "support", F.col("item").alias("anchor"))
    return materialize(placed.unionByName(alone), "rules"), items


def in_items(sets: DataFrame, items: DataFrame) -> DataFrame:
    """The distinct token sets (signature, tokens) with the items of their tokens in place of these; sets without any
    item, which no rule fits, go."""
    words = sets.select("signature", F.explode("tokens").alias("token")).join(items.select("token", "item"), "token")
    return words.groupBy("signature").agg(F.collect_set("item").alias("tokens"))


def mined_verdicts(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(signature, mined) of the distinct token sets (signature, tokens) that a rule fits: the surest rule's
    label; of equally sure ones the best supported, then allow."""
    index = F.broadcast(rules) if rules.count() <= BROADCAST_RULES else rules
    asked = sets.withColumn("anchor", F.explode("tokens")).join(index, "anchor")
    fits = asked.where(F.size(F.array_except("items", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", F.when(F.col("label") == "allow", 1).otherwise(0).alias("kind"))).alias("best")
    return fits.groupBy("signature").agg(best).select("signature", F.when(F.col("best.kind") == 1, "allow").otherwise("block").alias("mined"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, source (fixed, mined or default) of every page. ``labels`` (page_id,
    bad boolean) are what rules are mined from."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path")))
    named = labels.select(F.col("page_id").alias("id_"), F.when(F.coalesce("bad", F.lit(False)), "block").otherwise("allow").alias("label"))
    mined, items = mine(parsed.join(named, F.col("page_id") == F.col("id_")).select("tokens", "label"))
    parsed = parsed.withColumn("signature", F.array_join("tokens", " ")).withColumn("rule", fixed_rule(F.col("host"), F.col("path"), rules))
    sets = materialize(parsed.groupBy("signature", "tokens").agg(F.count(F.lit(1)).alias("pages")), "token-sets")
    verdicts = mined_verdicts(in_items(sets, items), mined)
    return with_verdicts(parsed, sets, verdicts).select(
        "page_id", "host", "path", "rule",
        F.coalesce(verdict_of(F.col("rule"), rules), "mined", F.lit("allow")).alias("verdict"),
        F.when(F.col("rule").isNotNull(), "fixed").when(F.col("mined").isNotNull(), "mined").otherwise("default").alias("source"),
    )


def with_verdicts(parsed: DataFrame, sets: DataFrame, verdicts: DataFrame, hot_sets: int = HOT_SETS) -> DataFrame:
    """``parsed`` with the verdict ``mined`` of each row's token set (null without one). ``sets`` (signature, pages) are
    all token sets; those of more than one row in ``hot_sets`` come by a broadcast of at most so many."""
    total = sets.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    judged = materialize(sets.select("signature", "pages").join(verdicts, "signature", "left"), "verdicts")
    hot = F.col("pages") > total / hot_sets
    few = judged.where(hot).select(F.col("signature").alias("hot_"), F.col("mined").alias("hot_mined"))
    others = judged.where(~hot & F.col("mined").isNotNull()).select(F.col("signature").alias("set_"), F.lit(0).alias("part_"), F.col("mined").alias("set_mined"))
    found = parsed.join(F.broadcast(few), F.col("signature") == F.col("hot_"), "left")
    # Rows of a hot set look for nothing in the other join: they go to parts of their own.
    part = F.when(F.col("hot_").isNull(), 0).otherwise(F.lit(1) + F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 16)).cast("int"))
    found = found.withColumn("part", part).join(others, (F.col("signature") == F.col("set_")) & (F.col("part") == F.col("part_")), "left")
    return found.withColumn("mined", F.coalesce("hot_mined", "set_mined")).drop("hot_", "hot_mined", "set_", "part", "part_", "set_mined")


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are those of the documents with the pages' ids: of low quality or toxic is bad."""
    labels = read_table(spark, sf_dir, "labels")
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    return judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


QUERIES = {"op1_url_rules": op1_url_rules}
