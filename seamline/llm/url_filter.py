"""URL filtering by host and path rules, and by association rules mined from labelled URLs.

A stated rule (host, path prefix, verdict) fits its host with all subdomains if the URL's path starts with the rule's;
the longest rule (host and path) wins. Where none fits, the verdict comes from association rules: frequent
combinations of URL tokens that go with ``block`` or ``allow`` among labelled URLs, found by FP-growth and kept by
support and confidence. Each such rule lies in an inverted index under its tokens, and fires for a URL that has them
all; of those that fire, the highest confidence decides, then the higher support, then ``block``; with none, ``allow``.

Labels come with the URLs, or, by default, from weak supervision of the pages at hand, mostly by what the URL does not
say: a page that declares an adult rating, has two and more of the phrases of SALES, or is a farm of links (LINKS of them
and more, which hold LINK_SHARE of the text) is labelled ``block``, as is a host that has one of SEEDS among its words;
any other as the stated rule says, and ``allow`` where none fits. Labels only teach: what is blocked is what mining finds
to go with the label often and surely enough, which takes in pages without evidence of their own and leaves out tokens
that prove nothing.

Combinations. Tokens that the same labelled rows have are one item to FP-growth; infrequent ones are left out before, as
they are in no rule. Each verdict is mined from its own rows, of which every item goes to FP-growth but those that cannot
be in a rule of several items: one that no row of another verdict has is as sure by itself, and one that all such rows
have makes no rule surer. No rule is lost. FP-growth proposes: each proposed rule's support and confidence are then counted over
all labelled rows with all their tokens. Its work grows with the number of frequent combinations.

Everything is DataFrame operations on the JVM. Matching sees distinct token sets, so a host with a third of all rows is
handled once.

Nulls: a null URL, or one without ``://``, has empty host and path, fits no rule and has no tokens: ``allow``. Null
labels count as neither verdict, null pages as no evidence. Repeated rows, and null or repeated page_ids, each get a
verdict. Every segment of a path is a token. Token sets are told apart by two 64-bit hashes. An empty table gives an
empty result. Further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: (host, path prefix, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Words of hosts that label a URL as ``block``. Fixed values.
SEEDS = ["adult", "bet", "bets", "betting", "casino", "escort", "gambling", "poker", "porn", "sex", "spam", "viagra", "warez", "xxx"]
#: Phrases of pages that sell what is to be blocked; two of them label a page. Fixed values.
SALES = ["free spins", "no deposit bonus", "place your bets", "jackpot", "no prescription", "buy viagra", "hot singles", "18+ only", "adults only", "cracked version", "serial key", "work from home and earn"]
#: A farm of links: how many it has at least, and their least share of the text.
LINKS, LINK_SHARE = 40, 0.8
#: Tables of at most so many rows (index, verdicts of token sets) are broadcast, joined by a shuffle beyond.
INDEX_ROWS, SET_ROWS = 100_000, 500_000


def host_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of the URL column; empty without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the rule that wins, or nulls."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, said in sorted(rules, key=lambda r: len(r[0] + r[1])):
        rule_host = rule_host.lower()
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def _words(host: Column) -> Column:
    return F.filter(F.split(host, r"[^\p{L}]+"), lambda x: x != "")


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Sorted distinct tokens: host labels with their distance from the end, words of labels that have several, path
    segments of letters, query keys; numbers count as ``#``, which keeps the sets few."""
    labels = F.reverse(F.split(host, r"\."))
    h = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    several = F.filter(F.split(host, r"\."), lambda x: F.size(_words(x)) > 1)
    w = F.transform(F.flatten(F.transform(several, _words)), lambda x: F.concat(F.lit("w:"), x))
    plain = lambda x: F.regexp_replace(x, r"\p{Nd}+", "#")
    p = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), plain(x)))
    q = F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^([^=]*)", 1)))
    every = F.filter(F.concat(h, w, p, F.coalesce(q, F.array())), lambda x: ~F.rlike(x, F.lit("^(h[0-9]+|w|p|q):$")))
    return F.array_sort(F.array_distinct(every))


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fold_items(labelled: DataFrame, least: float) -> DataFrame:
    """token, item for each token that ``least`` rows (tokens) have: tokens of the same rows share one item, the first
    of them. Row sets are told apart by their size and two sums of hashes."""
    rows = labelled.select(F.monotonically_increasing_id().alias("row"), "tokens")
    same = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("row", F.lit(1)).cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64("row", F.lit(2)).cast("decimal(38,0)")).alias("s2"))
    tokens = rows.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(same.alias("rows")).where(F.col("rows.n") >= least)
    first = tokens.groupBy("rows").agg(F.min("token").alias("item"))
    return tokens.join(first, "rows").select("token", "item")


def set_id(tokens: Column) -> Column:
    """Tells sets of tokens apart."""
    return F.struct(F.xxhash64(tokens), F.xxhash64(F.lit(1), tokens))


def _firing(sets: DataFrame, rules: DataFrame, often: DataFrame) -> DataFrame:
    """sets (set_id, tokens and more) with the rules (rule, antecedent and more) that hold for them: each rule lies in the
    inverted index under the one of its tokens that is least often (token, n), and is held against sets that have it."""
    spread = rules.select("*", F.explode("antecedent").alias("token")).join(_small(often, INDEX_ROWS), "token", "left")
    rarest = spread.groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token"))["token"].alias("token"))
    index = _small(written(rules.join(rarest, "rule"), "url-index"), INDEX_ROWS)
    hits = sets.select("*", F.explode("tokens").alias("token")).join(index, "token")
    return hits.where(F.size(F.array_except("antecedent", "tokens")) == 0)


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8) -> DataFrame:
    """Rules from rows (tokens, verdict): rule long, antecedent array<string>, said string, confidence, support.

    Rows whose verdict is null count against every rule whose tokens they have, so a rule must hold among all URLs.

    Pruned: besides support and confidence, a rule stays only if no rule with a part of its tokens and the same verdict
    is as confident.
    """
    spark = labelled.sparkSession
    labelled = written(labelled.select(set_id(F.col("tokens")).alias("set_id"), "tokens", "verdict"), "url-labels")
    of = {v: F.count_if(F.col("verdict") == v).alias(v) for v in ("block", "allow")}
    sets = written(labelled.groupBy("set_id").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n"), *of.values()), "url-counts")
    seen = sets.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", *of))).first()
    total, least = seen["n"], min_support * seen["n"] * (1 - 1e-9)  # rounding must lose none
    items = fold_items(labelled, least)
    told = sets.select(F.explode("tokens").alias("item"), "n", *of).groupBy("item").agg(*(F.sum(c).alias(c) for c in ("n", *of)))
    items = written(items.join(told, "item"), "url-items")
    own = sets.select("set_id", F.explode("tokens").alias("token")).join(_small(items, INDEX_ROWS), "token")
    own = written(own.groupBy("set_id").agg(F.collect_set(F.struct("item", "n", *of)).alias("items")), "url-sets")  # one URL's items
    none = F.array().cast("array<string>")
    proposed = [items.where(f"token = item and {v} >= {least}").select(F.array("item").alias("antecedent"), F.lit(v).alias("said")) for v in of]
    for v in (v for v in of if seen[v]):
        # items that none or all of the other rows have are in no rule of several items
        helps = lambda x: (x[v] >= least) & (x["n"] > x[v]) & (x["n"] - x[v] < total - seen[v])  # noqa: B023, E731
        helping = own.select("set_id", F.transform(F.filter("items", helps), lambda x: x["item"]).alias("items"))
        rows = labelled.where(F.col("verdict") == v).select("set_id").join(_small(helping, SET_ROWS), "set_id", "left")
        share = min(1.0, least / seen[v])  # of this verdict's rows
        model = FPGrowth(itemsCol="items", minSupport=share, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(rows.select(F.coalesce("items", none).alias("items")))
        proposed.append(model.freqItemsets.where(F.size("items") > 1).select(F.array_sort("items").alias("antecedent"), F.lit(v).alias("said")))
    proposed = reduce(DataFrame.union, proposed)
    proposed = written(proposed.withColumn("rule", F.xxhash64("antecedent")), "url-proposed")
    held = sets.select("set_id", "n", "block", "allow").join(_small(own.select("set_id", F.col("items.item").alias("tokens")), SET_ROWS), "set_id")
    often = items.where("token = item").select("token", "n")
    counted = _firing(held.withColumnRenamed("n", "rows"), proposed.select("rule", "antecedent").distinct(), often)
    counted = counted.groupBy("rule").agg(F.sum("rows").alias("rows"), F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    share = F.when(F.col("said") == "block", F.col("block")).otherwise(F.col("allow"))
    rules = proposed.join(counted, "rule").select(F.xxhash64("antecedent", "said").alias("rule"), "antecedent", "said", (share / F.col("rows")).alias("confidence"), (share / F.lit(max(total, 1))).alias("support"))
    rules = written(rules.where((F.col("confidence") >= min_confidence) & (F.col("support") >= min_support)), "url-rules")
    # a rule holds all tokens of a part of it, so the part is looked for under the one of its tokens that is least often
    parts = rules.select(F.col("rule").alias("part"), F.col("said").alias("part_said"), F.col("confidence").alias("part_confidence"), "antecedent")
    whole = rules.select(F.col("rule").alias("set_id"), F.col("antecedent").alias("tokens"), "said", "confidence")
    weaker = _firing(whole, parts.withColumnRenamed("part", "rule"), often).where("rule != set_id and part_said = said and size(antecedent) < size(tokens) and part_confidence >= confidence")
    kept = rules.join(weaker.select(F.col("set_id").alias("rule")).distinct(), "rule", "left_anti")
    unfolded = kept.select("*", F.explode("antecedent").alias("item")).join(_small(items.select("token", "item"), INDEX_ROWS), "item")
    return unfolded.groupBy("rule", "said", "confidence", "support").agg(F.array_sort(F.collect_set("token")).alias("antecedent"))


def match(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """For each row (set_id, tokens): the best rule that fires: set_id, said, confidence. By an inverted index."""
    rules = written(rules, "url-mined")
    often = rules.select(F.explode("antecedent").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    best = F.max(F.struct("confidence", "support", (F.col("said") == "block").alias("blocks"), "said"))
    fired = _firing(token_sets.select("set_id", "tokens"), rules, often).groupBy("set_id").agg(best.alias("best"))
    return fired.select("set_id", F.col("best.said").alias("said"), F.col("best.confidence").alias("confidence"))


def evidence(html: Column) -> Column:
    """Whether a page's own text and markup say that it is to be blocked."""
    page = F.coalesce(html, F.lit(""))
    rated = F.rlike(page, F.lit(r"(?i)<meta\b[^>]{0,300}\b(?:rating|rta)\b[^>]{0,300}\b(?:adult|mature|restricted|RTA-5042-1996-1400-1577-RTA)\b"))
    sold = sum((F.contains(F.lower(page), F.lit(p)).cast("int") for p in SALES), F.lit(0)) >= 2
    links = F.regexp_extract_all(page, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), 1)
    plain = lambda x: F.length(F.regexp_replace(x, r"<[^>]*>|\s+", ""))
    linked = F.aggregate(links, F.lit(0), lambda t, x: t + plain(x))
    farm = (F.size(links) >= LINKS) & (linked >= LINK_SHARE * plain(F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")))
    return rated | sold | farm


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, min_support: float = 0.002, min_confidence: float = 0.8) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_confidence of every row of pages (page_id, url, and html if there is one).

    labelled (url, verdict) are the URLs to mine from; without it, all of pages, labelled by evidence and stated rules.
    """
    host, path = host_path()
    html = F.col("html") if "html" in pages.columns else F.lit(None).cast("string")
    shown = (evidence(html) if labelled is None else F.lit(False)).alias("shown")
    rows = pages.select("page_id", F.col("url").alias("_url"), shown)
    rows = rows.select("page_id", *(x.alias(n) for x, n in zip(host_path("_url"), ("host", "path"))), url_tokens(*host_path("_url"), F.col("_url")).alias("tokens"), "shown")
    name, said = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", name.alias("rule"), said.alias("stated"), F.col("tokens"), set_id(F.col("tokens")).alias("set_id"), "shown")
    if labelled is None:
        seeded = F.arrays_overlap(_words(F.col("host")), F.array(*map(F.lit, SEEDS)))
        known = rows.where("host != ''").select("tokens", F.when(seeded | F.col("shown"), "block").otherwise(F.coalesce("stated", F.lit("allow"))).alias("verdict"))
    else:
        known = labelled.where("url is not null").select(url_tokens(host, path, F.col("url")).alias("tokens"), F.when(F.col("verdict").isin("block", "allow"), F.col("verdict")).alias("verdict"))
    mined = mine(known, min_support, min_confidence)
    sets = rows.where("stated is null").groupBy("set_id").agg(F.first("tokens").alias("tokens"))
    found = _small(written(match(sets, mined), "url-verdicts"), SET_ROWS)
    joined = rows.join(found, "set_id", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("stated", "said", F.lit("allow")).alias("verdict"), F.when(F.col("stated").isNull(), F.col("confidence")).alias("mined_confidence"))
