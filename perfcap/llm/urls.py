"""Operator 7: url filter from a tree of path templates per host. DataFrame functions only.

1. Segments that vary by form (they hold a digit) become `{n}`; pages are counted per host and shape, so that the tree
   grows with the number of shapes, not of pages.
2. From the root down, a branch below a node keeps its own name only if it is told apart from the other branches: the
   rate of bad labels below it must differ from that of the other branches by a two-proportion z of `Z`, whatever its
   share of the node. All other branches merge into `*`. Below `DEPTH` levels the rest of a path is `**`.
3. A template's purity is its rate of bad labels, smoothed by `WEIGHT` labels at the host's rate, which is smoothed in
   the same way towards the rate of all pages. Templates over `LIMIT` are blocked.

Listed rules go before the tree: a rule fits its host and all subdomains if the path starts with the rule's; the longest
wins. A null url, or one without `://`, has empty host and path. Repeated rows are judged alike, each gives a row; null
ids stay. Labels of one page that disagree count as bad. Empty tables give no rows; extra columns are not read.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfcap.llm.common import ascii_lower

DEPTH, Z, WEIGHT, LIMIT = 6, 1.96, 4.0, 0.5

#: Rule (host, then path) and verdict.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(F.coalesce(rest, F.lit("")), F.length(host) + 1, F.length(url)), "^[^?#]*", 0)
    return ascii_lower(host), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        own, slash, start = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """Segments with a digit as `{n}`, at most DEPTH segments and `**`; joined by `/`."""
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(s.rlike("[0-9]"), "{n}").otherwise(s))
    more = F.when(F.size(segments) > DEPTH, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.slice(segments, 1, DEPTH), more), "/")


def template_tree(shapes: DataFrame) -> DataFrame:
    """(host, shape, template) for counted shapes (host, shape, pages, labelled, bad)."""
    rows = shapes.withColumn("segments", F.split("shape", "/")).withColumn("template", F.lit(""))
    for level in range(DEPTH):
        node, branch = Window.partitionBy("host", "template"), Window.partitionBy("host", "template", "segment")
        total = lambda c, w: F.sum(c).over(w)
        rows = rows.withColumn("segment", F.get("segments", F.lit(level)))
        rows = rows.withColumns({"l": total("labelled", branch), "b": total("bad", branch)})
        rows = rows.withColumns({"ol": total("labelled", node) - F.col("l"), "ob": total("bad", node) - F.col("b")})
        pooled = (F.col("b") + F.col("ob")) / (F.col("l") + F.col("ol"))
        spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("l") + 1 / F.col("ol")))
        differs = (F.col("l") > 0) & (F.col("ol") > 0) & (pooled > 0) & (pooled < 1) & (
            F.abs(F.col("b") / F.col("l") - F.col("ob") / F.col("ol")) > Z * spread)
        name = F.when(F.col("segment").isin("{n}", "**"), F.col("segment")).when(differs, F.col("segment")).otherwise("*")
        rows = rows.withColumn("template", F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), name)))
    return rows.select("host", "shape", F.when((F.size("segments") > DEPTH), F.concat("template", F.lit("/**"))).otherwise(F.col("template")).alias("template"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every page; labels: (page_id, bad boolean or null)."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("shape", shape(F.col("path")))
    known = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    counted = (parsed.join(known, "page_id", "left").groupBy("host", "shape")
               .agg(F.count("*").alias("pages"), F.count("bad").alias("labelled"), F.count_if("bad").alias("bad")))
    tree = template_tree(counted)
    every = Window.partitionBy("host")
    rates = (counted.join(tree, ["host", "shape"]).join(F.broadcast(counted.agg(
        F.coalesce(F.sum("bad") / F.nullif(F.sum("labelled"), F.lit(0)), F.lit(0.0)).alias("rate"))))
        .withColumn("host_rate", (F.sum("bad").over(every) + WEIGHT * F.col("rate")) / (F.sum("labelled").over(every) + WEIGHT)))
    of = Window.partitionBy("host", "template")
    pure = rates.select("host", "shape", "template", (
        (F.sum("bad").over(of) + WEIGHT * F.col("host_rate")) / (F.sum("labelled").over(of) + WEIGHT)).alias("purity"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return parsed.join(pure, ["host", "shape"]).select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("purity") > LIMIT, "block").otherwise("allow")).alias("verdict"), "template", "purity")
