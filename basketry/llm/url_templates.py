"""URL filter by a tree of path templates.

Urls that a rule judges are labelled examples.  Per host, paths become
templates from the first segment on.  A segment that looks like a number or an
identifier, or that stands under a node with many different, rarely repeated
segments, becomes the wildcard ``*``.  Branches under one node whose labelled
shares do not differ significantly from the node's are merged into the wildcard
too; those that do differ stay apart.  A template is blocked when its smoothed
share of blocked examples (drawn towards its host's, and that towards the whole
table's) is at least ``min_impurity``, and a url without a rule gets its template's
verdict.

Counts are made per (host, path) first, so a host with a third of all pages is
added up before any shuffle; each level of the tree is one aggregation by
(host, template so far, segment).
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import ascii_lower
from basketry.session import staged

WILDCARD, DEEPER = "*", "**"
# Segments that name one item whatever their frequency: numbers with an optional ending, long hexadecimal, dates.
IDENTIFIER = r"^(?:\d+(?:\.[a-z0-9]{1,5})?|[0-9a-fA-F]{8,}(?:-[0-9a-fA-F]+)*|\d{4}-\d{2}(?:-\d{2})?)$"


@dataclass(frozen=True)
class Settings:
    depth: int = 6  # segments beyond are one "**"
    max_children: int = 20
    min_repeat: float = 5.0  # pages for each different segment, below which a node with many of them is variable
    similar_z: float = 2.58
    template_prior: float = 4.0
    host_prior: float = 20.0
    min_impurity: float = 0.5


@dataclass(frozen=True)
class Rule:
    verdict: str  # "allow" or "block"
    host: str
    path: str  # with its leading "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path): A-Z of the host lower-cased, the path up to ``?`` or ``#``; empty where there is no ``://``."""
    begin = F.instr(url, "://")
    rest = F.when(begin > 0, F.substring(url, begin + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    of_host = (host == rule.host) | host.endswith("." + rule.host)
    return of_host & path.startswith(rule.path)


def ruled(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds host, path, rule and its verdict; the longest rule that fits wins."""
    host, path = parsed(F.col("url"))
    found = urls.withColumn("host", host).withColumn("path", path)
    longest_first = sorted(rules, key=lambda r: (-len(r.name), r.name))

    def first(value) -> Column:
        whens = [F.when(fits(r, F.col("host"), F.col("path")), F.lit(value(r))) for r in longest_first]
        return F.coalesce(*whens, F.lit(None).cast("string"))

    return found.withColumns({"rule": first(lambda r: r.name), "by_rule": first(lambda r: r.verdict)})


def significant(blocked: Column, labelled: Column, all_blocked: Column, all_labelled: Column, z: float) -> Column:
    """Whether a branch's share of blocked examples differs from that of its siblings together."""
    others, others_blocked = all_labelled - labelled, all_blocked - blocked
    pooled = all_blocked / F.greatest(all_labelled, F.lit(1.0))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(labelled, F.lit(1.0)) + 1 / F.greatest(others, F.lit(1.0))))
    gap = F.abs(blocked / F.greatest(labelled, F.lit(1.0)) - others_blocked / F.greatest(others, F.lit(1.0)))
    return (labelled > 0) & (others > 0) & (gap > z * spread)


def templates(paths: DataFrame, settings: Settings) -> DataFrame:
    """Adds ``template`` to (host, path, n, labelled, blocked), a row a path."""
    cut = F.split(F.regexp_replace("path", "^/", ""), "/")
    tail = F.when(F.size(cut) > settings.depth, F.lit("/" + DEEPER)).otherwise(F.lit(""))
    rows = paths.withColumns({"segments": cut, "tail": tail, "template": F.lit("")})
    counts = ("n", "labelled", "blocked")
    for level in range(settings.depth):
        if level and rows.filter(F.size("segments") > level).isEmpty():
            break
        raw = F.get(F.col("segments"), F.lit(level))
        rows = rows.withColumn("segment", F.when(raw.rlike(IDENTIFIER), F.lit(WILDCARD)).otherwise(raw))
        here = rows.filter(F.col("segment").isNotNull())
        children = here.groupBy("host", "template", "segment").agg(*[F.sum(c).alias(c) for c in counts])
        children = staged(children, "children")
        nodes = children.groupBy("host", "template").agg(
            F.count("*").alias("different"), *[F.sum(c).alias(f"all_{c}") for c in counts]
        )
        variable = (F.col("different") > settings.max_children) & (
            F.col("all_n") < settings.min_repeat * F.col("different")
        )
        apart = significant(*[F.col(c) for c in ("blocked", "labelled", "all_blocked", "all_labelled")], settings.similar_z)
        # Branches without examples say nothing and stay as they are; similar ones that have some are merged.
        merged = (F.col("labelled") > 0) & ~apart & (F.col("different") > 1)
        renamed = children.join(nodes, ["host", "template"]).filter((variable & ~apart) | merged)
        renamed = staged(renamed.select("host", "template", "segment", F.lit(WILDCARD).alias("as")), "renamed")
        rows = rows.join(renamed, ["host", "template", "segment"], "left")
        name = F.coalesce("as", "segment")
        step = F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), name))
        rows = staged(rows.withColumn("template", F.concat("template", step)).drop("segment", "as"), "templates")
    return rows.withColumn("template", F.concat("template", "tail")).drop("segments", "tail")


def judged_templates(paths: DataFrame, settings: Settings) -> DataFrame:
    """(host, template, impurity): the share of blocked examples, smoothed towards host and table."""
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    of_template = staged(paths.groupBy("host", "template").agg(*sums), "judged")
    of_host = of_template.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("blocked").alias("host_blocked"))
    whole = of_host.agg(F.sum("host_labelled").alias("labelled"), F.sum("host_blocked").alias("blocked")).first()
    prior = (whole["blocked"] or 0) / max(whole["labelled"] or 0, 1)
    host_share = (F.col("host_blocked") + settings.host_prior * prior) / (F.col("host_labelled") + settings.host_prior)
    impurity = (F.col("blocked") + settings.template_prior * host_share) / (F.col("labelled") + settings.template_prior)
    return of_template.join(of_host, "host").select(
        F.col("host").alias("of_host"), F.col("template").alias("of_template"), "labelled", impurity.alias("impurity")
    )


def judge(urls: DataFrame, rules: list[Rule], settings: Settings = Settings()) -> DataFrame:
    """One row per url: host, path, rule, verdict, and the template with its impurity.

    Needs ``page_id`` and ``url``.  A null url, or one without ``://``, has an
    empty host and path and is judged like any other (by its template).
    Repeated rows get equal verdicts and count as often as they occur; an empty
    table gives no rows; other columns are not read.
    """
    known = ruled(urls.select(F.col("page_id").cast("bigint").alias("page_id"), "url"), rules)
    known = staged(known.drop("url"), "urls")
    labelled = F.col("by_rule").isNotNull().cast("double")
    blocked = (F.coalesce("by_rule", F.lit("")) == "block").cast("double")
    paths = known.groupBy("host", "path").agg(
        F.count("*").cast("double").alias("n"), F.sum(labelled).alias("labelled"), F.sum(blocked).alias("blocked")
    )
    paths = templates(staged(paths, "paths"), settings)
    paths = staged(paths, "paths")
    judged = staged(judged_templates(paths, settings), "judged")
    of_path = paths.join(
        judged, (paths["host"] == judged["of_host"]) & (paths["template"] == judged["of_template"])
    ).select(paths["host"], "path", "template", "impurity")
    by_template = F.when(F.col("impurity") >= settings.min_impurity, F.lit("block")).otherwise(F.lit("allow"))
    return known.join(of_path, ["host", "path"]).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", by_template).alias("verdict"),
        "template",
        F.round("impurity", 9).alias("impurity"),
    )
