"""Accept or reject URLs by host rules and by learned path templates.

Per host the path segments form a tree.  A segment that is a number, a long
hex string or a date is a wildcard by its shape; where a node still has more than
``max_children`` children, the rare ones become the wildcard ``*``.  Sibling
branches whose pooled block rates do not differ significantly are merged, the
closest first.  A
root-to-leaf path of the result is a template; its purity is the block rate of
its labelled urls, smoothed towards the rate of all labelled urls.  Urls of
templates that are pure enough are blocked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.session import materialize

ALLOW, BLOCK = "allow", "block"
MAX_RULES = 1000
MAX_CHILDREN = 64
MIN_SHARE = 0.01
MIN_SUPPORT = 5
MAX_DEPTH = 8
PRIOR_WEIGHT = 4.0
THRESHOLD = 0.9
Z = 1.96

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the (verdict, rule) pairs that fits, else nulls.

    A rule is a host and the start of a path, written together; it fits the host
    and all its subdomains.  Of equally long rules the first one wins.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rest)
        text = F.when(fits, F.lit(rule)).otherwise(text)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return text, verdict


def shaped_segments(path: Column) -> Column:
    """The segments of a path, those of variable shape replaced by the name of the shape."""

    def shape(segment: Column) -> Column:
        stem = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 1)
        ending = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 2)
        name = (
            F.when(stem.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{date}")
            .when(stem.rlike(r"^[0-9]+$"), "{number}")
            .when(stem.rlike(r"^[0-9A-Fa-f]{8}(-?[0-9A-Fa-f]{4}){3}-?[0-9A-Fa-f]{12}$"), "{uuid}")
            .when(stem.rlike(r"^(?=.*[0-9])[0-9A-Fa-f]{8,}$"), "{hex}")
        )
        # Signs that wildcards, shapes and merged branches are written with.
        plain = F.regexp_replace(segment, r"([\\*|{}])", r"\\$1")
        return F.coalesce(F.concat(name, ending), plain)

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), shape)


def merge_branches(counts: list[tuple[str, int, int]], min_support: int, z: float) -> list[list[str]]:
    """Groups of sibling branches (name, labelled, blocked) whose block rates do not differ.

    The two groups with the smallest test statistic of their pooled rates are merged
    first, until every two groups differ by more than ``z``; so a chain of small steps
    does not join what lies far apart.  Branches with few labels stay alone.
    """
    out = [[name] for name, labelled, _ in counts if labelled < min_support]
    known = sorted((b / n, name, n, b) for name, n, b in counts if n >= min_support)
    groups = [([name], n, b) for _, name, n, b in known]

    def differ(one: tuple, two: tuple) -> float:
        (_, n, b), (_, m, c) = one, two
        pooled = (b + c) / (n + m)
        spread = math.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
        return abs(b / n - c / m) / spread if spread else 0.0

    # A pooled rate lies between those it joins, so only neighbours can be closest in rate.
    apart = [differ(a, b) for a, b in zip(groups, groups[1:])]
    while apart:
        k = min(range(len(apart)), key=apart.__getitem__)
        if apart[k] > z:
            break
        (names, n, b), (more, m, c) = groups[k : k + 2]
        groups[k : k + 2] = [(names + more, n + m, b + c)]
        apart.pop(k)
        for j in (k - 1, k):
            if 0 <= j < len(apart):
                apart[j] = differ(groups[j], groups[j + 1])
    return out + [names for names, _, _ in groups]


def _merged(branches: DataFrame, min_support: int, z: float) -> DataFrame:
    """(host, template, branch, name): the name of the group that a branch is merged into."""
    kind = "host string, template string, branch string, name string"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, template, members in zip(*(column.to_pylist() for column in batch.columns)):
                counts = sorted((m["branch"], m["l"], m["b"]) for m in members)
                for names in merge_branches(counts, min_support, z):
                    name = "|".join(sorted(names))
                    rows += [(host, template, branch, name) for branch in names]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["host", "template", "branch", "name"])

    members = F.collect_list(F.struct("branch", "l", "b")).alias("members")
    return branches.groupBy("host", "template").agg(members).mapInArrow(merge, kind)


def path_templates(
    paths: DataFrame,
    max_children: int = MAX_CHILDREN,
    min_share: float = MIN_SHARE,
    min_support: int = MIN_SUPPORT,
    max_depth: int = MAX_DEPTH,
    z: float = Z,
) -> DataFrame:
    """(host, segments, template) of every distinct row of ``paths``.

    ``paths`` has one row per host and segments with the sums ``urls``, ``labelled``
    and ``blocked``.  The tree is built level by level for all hosts at once, so no
    host is gathered anywhere: children are counted with partial aggregation, and
    merging sees the at most ``max_children + 1 / min_share + 1`` siblings that
    are left after rare children became ``*``.  What lies below ``max_depth`` levels
    is one wildcard, ``**``.
    """
    rows = paths.withColumn("template", F.lit(""))
    deepest = paths.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(min(deepest, max_depth)):
        rows = rows.withColumn("segment", F.get("segments", F.lit(level)))
        children = rows.where(F.col("segment").isNotNull()).groupBy("host", "template", "segment").agg(
            *[F.sum(c).alias(c) for c in ("urls", "labelled", "blocked")]
        )
        nodes = children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("n"), F.sum("urls").alias("all_urls"))
        rare = (F.col("n") > max_children) & (F.col("urls") < min_share * F.col("all_urls"))
        named = children.join(nodes, ["host", "template"]).withColumn("branch", F.when(rare, "*").otherwise(F.col("segment")))
        branches = named.groupBy("host", "template", "branch").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
        merged = _merged(branches, min_support, z)
        names = named.join(merged, ["host", "template", "branch"]).select("host", "template", "segment", "name")
        rows = materialize(
            rows.join(names, ["host", "template", "segment"], "left")
            .withColumn("template", F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name")))
            .select(*paths.columns, "template")
        )
    deeper = F.when(F.size("segments") > max_depth, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))
    return rows.withColumn("template", deeper)


def judge_templates(
    templates: DataFrame,
    min_support: int = MIN_SUPPORT,
    prior_weight: float = PRIOR_WEIGHT,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(host, template, urls, labelled, blocked, purity, verdict) of every template."""
    counts = materialize(
        templates.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("urls", "labelled", "blocked")])
    )
    whole = counts.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()
    prior = whole["b"] / whole["l"] if whole["l"] else 0.0
    purity = (F.col("blocked") + prior_weight * prior) / (F.col("labelled") + prior_weight)
    pure = (F.col("labelled") >= min_support) & (purity >= threshold)
    return counts.withColumn("purity", purity).withColumn("verdict", F.when(pure, BLOCK).otherwise(ALLOW))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    id_column: str = "page_id",
    url_column: str = "url",
    **tree,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) of every row.

    The verdicts of the rules label the urls from which templates are learned; a url
    without a rule gets the verdict of its template.

    Null urls and those without ``://`` have empty host and path: no rule fits, and
    they share the empty template.  Null ids and repeated rows are carried along;
    other columns are not read; an empty table gives no rows.
    """
    url = F.col("url")
    judged = pages.select(pages[id_column].alias("page_id"), pages[url_column].alias("url")).select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path")
    )
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = judged.select("*", rule.alias("rule"), verdict.alias("rule_verdict"), shaped_segments(F.col("path")).alias("segments"))
    blocked = F.col("rule_verdict") == BLOCK
    paths = materialize(
        judged.groupBy("host", "segments").agg(
            F.count(F.lit(1)).alias("urls"),
            F.count("rule_verdict").alias("labelled"),
            F.coalesce(F.sum(blocked.cast("long")), F.lit(0)).alias("blocked"),
        )
    )
    templates = path_templates(paths, **tree)
    verdicts = judge_templates(templates)
    learned = templates.join(verdicts.select("host", "template", "verdict"), ["host", "template"]).select(
        F.col("host").alias("of_host"), F.col("segments").alias("of_segments"), "template", "verdict"
    )
    return judged.join(
        learned, (F.col("host") == F.col("of_host")) & (F.col("segments") == F.col("of_segments")), "left"
    ).select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "verdict").alias("verdict"), "template")
