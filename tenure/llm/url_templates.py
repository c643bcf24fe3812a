"""URL filter from a tree of path templates.

Per host, paths form a tree of segments. Level by level, a segment is generalised to a
wildcard when it is variable by its form (numbers, hashes, dates) or when its parent has
many children that hardly ever recur; the remaining sibling branches whose labels do not
differ significantly from those of their siblings are merged into one wildcard branch. A
template is rejected when its smoothed purity, the labelled share of unwanted urls drawn
towards a prior, reaches a limit. Everything is a grouped count, so a host with a third
of all urls is combined before each shuffle; rows meet their templates only through
joins that adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import LOWER, UPPER, col, others
from tenure.session import stage

#: Segments of a template; the rest of longer paths is one tail wildcard. None takes all.
DEPTH = 5
#: A node is variable when it has at least so many children and at most so many urls for each.
MANY_CHILDREN, URLS_PER_CHILD = 20, 3.0
#: Deviation (in standard errors) up to which a branch counts as similar to its siblings.
SIMILAR = 1.96
#: Prior share of unwanted urls, its weight in urls, and the smoothed purity that rejects.
PRIOR, PRIOR_WEIGHT, PURITY = 0.2, 2.0, 0.7
PRODUCED = ("host", "path", "rule", "verdict", "template", "purity")
#: (verdict, host, path) of the fixed rules of the query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

# Forms of variable segments, most specific first; a file extension stays.
FORMS = [
    ("{date}", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("{number}", r"^[0-9]+$"),
    ("{uuid}", r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"),
    ("{hex}", r"^(?=.*[0-9])[0-9A-Fa-f]{8,}$"),
    ("{mixed}", r"^(?=.*[0-9].*[0-9])[0-9A-Za-z_-]{12,}$"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without '://'."""
    start = F.instr(url, "://")
    after = F.when(start > 0, F.substr(url, start + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Longest rule that fits the host or one of its parent domains and the start of the path; its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for decision, domain, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(domain + start)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _form(segment: Column) -> Column:
    """The segment, or the wildcard for its form; an extension after the last dot is kept."""
    extension = F.regexp_extract(segment, r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", 1)
    stem = F.substr(segment, F.lit(1), F.length(segment) - F.length(extension))
    wildcard = F.lit(None).cast("string")
    for name, pattern in reversed(FORMS):
        wildcard = F.when(stem.rlike(pattern), F.lit(name)).otherwise(wildcard)
    return F.coalesce(F.concat(wildcard, extension), segment)


def _templates(paths: DataFrame, depth: int | None, by_rules: bool) -> DataFrame:
    """Distinct (host, path) with counts ``n``, ``n_labelled``, ``n_bad`` and the template of each.

    Labels ``by_rules`` cover whole branches and say nothing about the siblings of a branch
    that they decide: it is not generalised together with undecided ones.
    """
    steps = F.filter(F.split("path", "/"), lambda s: s != "")
    tree = stage(
        paths.select("*", F.transform(steps if depth is None else F.slice(steps, 1, depth), _form).alias("steps"), (F.lit(False) if depth is None else F.size(steps) > depth).alias("deeper"), F.lit("").alias("template"))
    )
    for level in count(1) if depth is None else range(1, depth + 1):
        step = F.get("steps", F.lit(level - 1))
        if tree.where(step.isNotNull()).isEmpty():
            break
        tree = tree.withColumn("step", step)
        children = stage(
            tree.where("step is not null").groupBy("host", "template", "step").agg(F.sum("n").alias("n"), F.sum("n_labelled").alias("n_labelled"), F.sum("n_bad").alias("n_bad"))
        )
        parents = children.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("n_children"), F.sum("n").alias("all_n"), F.sum("n_labelled").alias("all_labelled"), F.sum("n_bad").alias("all_bad")
        )
        # Difference between the labelled share of a branch and that of its siblings, in standard errors.
        own, rest = F.col("n_labelled"), F.col("all_labelled") - F.col("n_labelled")
        pooled = (F.col("all_bad") + PRIOR) / (F.col("all_labelled") + 1.0)
        gap = F.abs(F.col("n_bad") / own - (F.col("all_bad") - F.col("n_bad")) / rest)
        similar = F.when((own == 0) | (rest == 0), F.lit(False)).otherwise(gap <= SIMILAR * F.sqrt(pooled * (1 - pooled) * (1 / own + 1 / rest)))
        variable = (F.col("n_children") >= MANY_CHILDREN) & (F.col("all_n") <= URLS_PER_CHILD * F.col("n_children"))
        decided = F.lit(by_rules) & (own == F.col("n")) & (F.col("all_labelled") < F.col("all_n"))
        branches = stage(
            children.join(parents, ["host", "template"]).select(
                "host", "template", "step",
                F.when(F.col("step").startswith("{"), F.col("step")).when(variable & ~decided, F.lit("{any}")).when(similar, F.lit("{similar}")).otherwise(F.col("step")).alias("branch"),
            )
        )
        tree = stage(
            tree.join(branches, ["host", "template", "step"], "left").select(
                *[F.col(c) for c in paths.columns], "steps", "deeper",
                F.when(F.col("branch").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "branch")).alias("template"),
            )
        )
    return tree.withColumn("template", F.concat(F.when(F.col("template") == "", F.lit("/")).otherwise(F.col("template")), F.when(F.col("deeper"), F.lit("/{tail}")).otherwise(F.lit(""))))


def judge_urls(
    pages: DataFrame,
    labels: DataFrame | None = None,
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    depth: int | None = DEPTH,
    prior: float = PRIOR,
    weight: float = PRIOR_WEIGHT,
    purity: float = PURITY,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict``, ``template`` and ``purity`` to every row.

    A fitting rule decides; else a url is blocked when its template has a smoothed purity
    of at least ``purity``. ``labels`` has columns ``url`` and ``unwanted`` (boolean);
    without it the verdicts of the rules are the labelled urls, and a template without one
    keeps the prior. Null urls and urls
    without '://' have an empty host and path and are allowed like any template without
    labels. Repeated rows count as often as they occur, repeated or null labels count
    as given or not at all. An empty table gives an empty table. Columns named like a
    produced one are replaced.
    """
    passed = others(pages, *PRODUCED)
    host, path = host_and_path(col(url_col))
    rule, decided = matching_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(*[col(c) for c in passed], host.alias("host"), path.alias("path")).withColumns({"rule": rule, "verdict": decided})
    one = F.lit(1).cast("long")
    counted = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("verdict").isNotNull(), one).otherwise(0)).alias("n_labelled"), F.sum(F.when(F.col("verdict") == "block", one).otherwise(0)).alias("n_bad"))
    if labels is not None:
        host, path = host_and_path(F.col("url"))
        known = labels.where("unwanted is not null").select(host.alias("host"), path.alias("path"), F.col("unwanted").cast("long").alias("bad"))
        known = known.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n_labelled"), F.sum("bad").alias("n_bad"))
        counted = counted.drop("n_labelled", "n_bad").join(known, ["host", "path"], "left").fillna(0, ["n_labelled", "n_bad"])
    tree = _templates(counted, depth, labels is None)
    smoothed = (F.sum("n_bad") + prior * weight) / (F.sum("n_labelled") + weight)
    judged = tree.groupBy("host", "template").agg(smoothed.alias("purity"))
    by_path = stage(tree.select("host", "path", "template").join(judged, ["host", "template"]))
    return rows.join(by_path, ["host", "path"], "left").select(
        *[col(c) for c in passed], "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("purity") >= purity, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template", "purity",
    )
