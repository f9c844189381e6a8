"""URL filters: allow and block rules, and association rules mined by FP-growth (DataFrame functions only).

Labelled URLs become transactions of tokens (host labels, host name parts, path segments, query keys) with one
more item for their label, bad or good. FP-growth finds the frequent combinations; those are kept as rules that imply
one of the labels with enough support and more confidence than chance gives: the lower end of the confidence's interval
lies above the label's share of all labelled URLs, and the confidence reaches ``MIN_LIFT`` times that share. As every token is
tried, the chance of error is divided by the number of tokens; support is at least the number of rows that would all have the
rarer label by chance that rarely (:func:`chance_rows`), so that a few rows never make a rule, however few are labelled. A rule that
a shorter one of the same label implies, which is at least as strong, goes; so does one that only holds by the URLs of a
longer and stronger one of the same label: without them it would not be a rule.

Tokens that stand in exactly the same labelled URLs are mined as one, so that a long path that many URLs share does not
make every combination of its segments; each rule is then written out for each of the tokens that stand for one.

An inverted index from each rule's rarest token finds the rules that can fit a URL; a rule fits if all its tokens
are there. Of the rules that fit, the strongest (by the interval's lower end over the label's share; block where equal)
decides: bad blocks, good allows. A verdict depends on the URL alone, so that equal URLs are matched once.

Defined cases: a null URL or one without ``://`` has an empty host and path and no tokens (verdict allow unless a
rule fits); a null label is none; without labels of both kinds no rule is mined; repeated pages repeat their verdict; a
URL of any length is matched by all its tokens; an added column whose name is taken gets an underscore behind it.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import free_name, lower_ascii, materialise, table

#: Share of the labelled URLs that must hold a rule's tokens and its label.
MIN_SUPPORT = 0.004
#: Times its label's share of all labelled URLs that a rule's confidence must reach.
MIN_LIFT = 1.05
#: Chance that any rule of one token holds by chance: the confidence's interval (Wilson's) is as wide on one side.
CHANCE = 0.01
BAD, GOOD = "label=bad", "label=good"
RULE = "rule_id long, tokens array<string>, verdict string, confidence double, support double, strength double"
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, empty where there is no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a string such as ``net/``; null without one."""
    fits = []
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits.append(F.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + rest), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: ``h=`` host labels and their parts, ``p=`` path segments, ``q=`` query keys."""
    host, path = host_and_path(url)
    keys = F.transform(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&"), lambda x: F.split(x, "=")[0])
    labels = F.split(host, r"\.")
    parts = F.flatten(F.transform(labels, lambda x: F.split(x, "-")))

    def named(prefix: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.concat(F.lit(prefix), x))

    every = [named("h=", labels), named("h=", parts), named("p=", F.split(path, "/")), named("q=", keys)]
    return F.filter(F.array_distinct(F.concat(*every)), lambda x: F.length(x) > 2)


def interval_width(tokens: int, chance: float = CHANCE) -> float:
    """Standard errors below which a share lies with that chance, divided by the number of tokens tried."""
    return NormalDist().inv_cdf(1 - chance / max(1, tokens))


def chance_rows(tokens: int, share: float, chance: float = CHANCE) -> int:
    """Rows that all have a label of that share with that chance at most, divided by the number of tokens tried."""
    return math.ceil(math.log(chance / max(1, tokens)) / math.log(share))


def lowest(confidence: Column, n: Column, width: float) -> Column:
    """Lower end of Wilson's interval of a share ``confidence`` among ``n``."""
    z2 = width * width
    root = F.sqrt(confidence * (1 - confidence) / n + z2 / (4 * n * n))
    return (confidence + z2 / (2 * n) - width * root) / (1 + z2 / n)


def _merged(items: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Transactions of the tokens on ``least`` rows at least, one for all that stand on the same rows; and (token, of) of these.

    The second table is small: it has at most as many rows as a URL has tokens, over the least support.
    """
    every = items.select("id", "label", F.explode("tokens").alias("token"))
    mark = lambda seed: F.sum(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 31)))
    marks = every.groupBy("token").agg(F.count("*").alias("n"), mark(1).alias("a"), mark(2).alias("b")).where(F.col("n") >= least)
    of = marks.groupBy("n", "a", "b").agg(F.array_sort(F.collect_list("token")).alias("same"))
    of = materialise(of.select(F.explode("same").alias("token"), F.element_at("same", 1).alias("of")), "merged")
    met = every.join(F.broadcast(of), "token").groupBy("id", "label").agg(F.collect_set("of").alias("items"))
    return met.select(F.concat("items", F.array("label")).alias("items")), of


def _written_out(rules: DataFrame, of: DataFrame) -> DataFrame:
    """Each rule once for each choice among the tokens that are mined as one."""
    rest = [c for c in rules.columns if c != "tokens"]
    alike = of.groupBy("of").agg(F.array_sort(F.collect_list("token")).alias("same"))
    sets = rules.select("*", F.explode("tokens").alias("of")).join(alike, "of").groupBy("tokens", *rest).agg(F.collect_list("same").alias("sets"))
    grow = F.aggregate("sets", F.array(F.array().cast("array<string>")), lambda made, same: F.flatten(F.transform(made, lambda m: F.transform(same, lambda t: F.concat(m, F.array(t))))))
    out = sets.select(F.explode(grow).alias("t"), *rest)
    return out.select(F.array_sort("t").alias("tokens"), *rest).withColumn("rule_id", F.xxhash64("tokens", "verdict"))


def mine_rules(labelled: DataFrame, url: str = "url", bad: str = "bad", min_support: float = MIN_SUPPORT, min_lift: float = MIN_LIFT, chance: float = CHANCE) -> DataFrame:
    """(rule_id, tokens, verdict, confidence, support, strength): what implies a bad label (block) or a good one (allow)."""
    spark = labelled.sparkSession
    label = F.when(F.col(bad), BAD).otherwise(GOOD)
    items = materialise(labelled.where(F.col(bad).isNotNull()).select(F.monotonically_increasing_id().alias("id"), label.alias("label"), url_tokens(F.col(url)).alias("tokens")), "transactions")
    total, n_bad = items.agg(F.count("*"), F.count_if(F.col("label") == BAD)).first()
    if not 0 < n_bad < total:
        return spark.createDataFrame([], RULE)
    share = {BAD: n_bad / total, GOOD: 1 - n_bad / total}
    tried = items.select(F.explode("tokens").alias("token")).distinct().count()
    width, least = interval_width(tried, chance), max(min_support * total, chance_rows(tried, min(share.values()), chance))
    merged, of = _merged(items, least)
    rows = materialise(merged, "merged-items")
    n_rows = rows.count()  # a URL without a frequent token is no transaction, but counts
    if not n_rows:
        return spark.createDataFrame([], RULE)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n_rows), minConfidence=min(1.0, min_lift * min(share.values()))).fit(rows)
    found = model.associationRules.withColumn("to", F.element_at("consequent", 1)).where(F.col("to").isin(BAD, GOOD))
    base = F.when(F.col("to") == BAD, share[BAD]).otherwise(share[GOOD])
    found = found.withColumns({"base": base, "hits": F.round(F.col("support") * n_rows)})
    found = found.withColumns({"own": F.round(F.col("hits") / F.col("confidence")), "support": F.col("hits") / total})

    def strength_of(hits: Column, n: Column) -> Column:
        """Lower end of the confidence's interval over the label's share; null where that makes no rule."""
        share_ = F.try_divide(hits, n)
        strength = lowest(share_, n, width) / F.col("base")
        return F.when((strength > 1) & (share_ >= min_lift * F.col("base")), strength)

    kept = found.withColumn("strength", strength_of(F.col("hits"), F.col("own"))).where("strength IS NOT NULL")
    kept = kept.select(F.array_sort("antecedent").alias("tokens"), F.when(F.col("to") == BAD, "block").otherwise("allow").alias("verdict"), "confidence", "support", "strength", "base", "hits", "own")
    kept = materialise(_written_out(kept, of), "rules")
    # A rule is implied by a shorter one made of some of its tokens, which need not have a rule of each length between.
    index = _rarest(kept, kept).select(F.col("rule_id").alias("short"), "token", "need", F.col("strength").alias("s"), F.col("verdict").alias("v"))
    index = index.join(kept.select(F.col("rule_id").alias("short"), F.col("hits").alias("short_hits"), F.col("own").alias("short_own")), "short")
    met = kept.select("rule_id", "tokens", "verdict", "strength", "base", "hits", "own", F.explode("tokens").alias("token")).join(index, "token")
    met = met.where((F.size("need") < F.size("tokens")) & (F.col("v") == F.col("verdict")) & (F.size(F.array_except("need", "tokens")) == 0))
    implied = F.col("s") >= F.col("strength")
    met = met.withColumn("left", strength_of(F.col("short_hits") - F.col("hits"), F.col("short_own") - F.col("own")))
    gone = met.select(F.when(implied, F.col("rule_id")).when(F.col("left").isNull(), F.col("short")).alias("rule_id")).where("rule_id IS NOT NULL").distinct()
    return kept.join(gone, "rule_id", "left_anti").select("rule_id", "tokens", "verdict", "confidence", "support", "strength")


def _rarest(rules: DataFrame, among: DataFrame) -> DataFrame:
    """The rules, with need (their tokens) and of these the token that the fewest ``tokens`` of ``among`` hold; without it no row."""
    rarity = among.select(F.explode("tokens").alias("token")).join(rules.select(F.explode("tokens").alias("token")).distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    held = rules.select("rule_id", "verdict", "strength", "tokens", F.explode("tokens").alias("token")).join(rarity, "token")
    return held.groupBy("rule_id", "verdict", "strength").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.first("tokens").alias("need"))


def decided_urls(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """(u, mined, verdict) of the distinct URLs that a mined rule fits: the strongest one's tokens and verdict."""
    tokens = urls.select(F.col(url).alias("u")).where("u IS NOT NULL").distinct().select("u", url_tokens(F.col("u")).alias("have"))
    index = _rarest(rules, tokens.select(F.col("have").alias("tokens"))).select("rule_id", "token", "need", "verdict", "strength")
    candidates = tokens.select("u", "have", F.explode("have").alias("token")).join(index, "token")
    fits = candidates.where(F.size(F.array_except("need", "have")) == 0)
    best = fits.groupBy("u").agg(F.max_by(F.struct(F.array_join("need", " ").alias("mined"), "verdict"), F.struct("strength", "verdict", "rule_id")).alias("best"))
    return best.select("u", "best.mined", "best.verdict")


def filter_urls(pages: DataFrame, labelled: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` plus host, path, rule, mined (the tokens of the mined rule that fits best, or null) and verdict."""
    found = materialise(mine_rules(labelled), "mined")
    host, path, rule, mined, verdict, hit, says = (free_name(pages, x) for x in ("host", "path", "rule", "mined", "verdict", "hit", "says"))
    out = pages.withColumns(dict(zip((host, path), host_and_path(F.col(url)), strict=True)))
    out = out.withColumn(rule, matching_rule(F.col(host), F.col(path), rules))
    hits = decided_urls(pages, found, url).select(F.col("u").alias(hit), F.col("mined").alias(mined), F.col("verdict").alias(says))
    out = out.join(hits, F.col(url) == F.col(hit), "left")
    verdicts = F.create_map(*[F.lit(x) for v, r in rules for x in (r, v)])
    return out.withColumn(verdict, F.coalesce(verdicts[F.col(rule)], F.col(says), F.lit("allow"))).drop(hit, says)


def query(spark, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    known = labels.groupBy("doc_id").agg((F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)) == 1).alias("bad"))
    labelled = pages.join(known, pages.page_id == known.doc_id).select("url", "bad")
    return filter_urls(pages, labelled).select("page_id", "host", "path", "rule", "verdict", "mined")


def rules_query(spark, sf_dir: str) -> DataFrame:
    """Host, path and the given rule of every page."""
    host, path = host_and_path(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    return pages.withColumn("rule", matching_rule(F.col("host"), F.col("path")))


def _rules_sql() -> str:
    fits = []
    for _, rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN '{rule}'")
    pattern = "'(?s)^.*?://([^/?#]*)([^?#]*)'"
    return f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), {pattern}, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), {pattern}, 2) AS path FROM pages)
SELECT *, CASE {' '.join(fits)} END AS rule FROM p
"""


RULES_ORACLE = _rules_sql()
