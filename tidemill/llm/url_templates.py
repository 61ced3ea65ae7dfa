"""URL verdicts from rules, and from a tree of path templates with labels.

Every host has a tree of its URLs' path segments, built level by level over distinct paths.
Below a node a segment is a branch if it leads to ``FREQUENT`` paths or has as many labels;
the others are values (ids, slugs, dates) and become the wildcard ``*``. Each branch's
labels are tested against those of the whole group it is in (likelihood ratio of two shares,
corrected for the number of branches): first of all branches of the node, then of those that
had too many bad labels, too few, or neither, until no branch differs from its group. A
group of several branches is merged into one, named ``+`` and what its tests said (``<``,
``>``, ``=``); a branch alone keeps its name. What a URL has become when its segments are
used up is its template.

A template is rejected by the share of bad labels among its URLs, smoothed towards its
host's share, which is smoothed towards that of all hosts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.stages import staged, unstage
from tidemill.session import delete, workspace

#: (host and path, verdict): fits the host and its subdomains and paths that begin so.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: A segment is a branch from so many distinct paths, or labels, on.
FREQUENT = 5
#: The chance of telling a branch from a group that it is like, over all branches of the group.
ALPHA = 0.05
#: How many labels the prior counts for, and the share of bad ones that rejects.
PRIOR, REJECT = 10.0, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What lies between the first ``://`` and ``/``, ``?``, ``#`` or the end, with A-Z folded,
    and from there up to ``?``, ``#`` or the end; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """``rule, verdict`` of the longest rule that fits, or NULL."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{start}"))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _ratio(bad: Column, own: Column, all_bad: Column, all_own: Column) -> Column:
    """How much better two shares explain the labels than one does: ``bad`` of ``own``, and
    the rest of ``all_bad`` of ``all_own`` (twice the logarithm of the likelihood ratio)."""

    def weigh(n: Column) -> Column:
        return F.when(n > 0, n * F.ln(n.cast("double"))).otherwise(0.0)

    def of(bad: Column, own: Column) -> Column:
        return weigh(bad) + weigh(own - bad) - weigh(own)

    return 2 * (of(bad, own) + of(all_bad - bad, all_own - own) - of(all_bad, all_own))


def _named(branches: DataFrame) -> DataFrame:
    """``host, node, segment, name`` of ``branches`` (host, node, segment, bad, own)."""
    group = ["host", "node", "group"]
    rounds = staged(branches.withColumn("group", F.lit("")).withColumn("members", F.lit(0).cast("long")), "url-groups")
    while True:
        sums = rounds.groupBy(*group).agg(F.sum("bad").alias("all_bad"), F.sum("own").alias("all_own"), F.count("*").alias("members"))
        tested = rounds.drop("members").join(sums, group)
        differs = _ratio(F.col("bad"), F.col("own"), F.col("all_bad"), F.col("all_own")) > 2 * F.ln(F.col("members") / ALPHA)
        above = F.col("bad") * F.col("all_own") > F.col("all_bad") * F.col("own")
        mark = F.when(differs, F.when(above, ">").otherwise("<")).otherwise("=")
        tested = staged(tested.select("host", "node", "segment", "bad", "own", F.concat("group", mark).alias("group"), "members"), "url-groups")
        unstage(rounds)
        rounds = tested
        if rounds.where("group not like '%='").isEmpty():
            break
    merged = F.concat(F.lit("+"), F.rtrim("group", F.lit("=")))
    return rounds.select("host", "node", "segment", F.when(F.col("members") > 1, merged).otherwise(_literal(F.col("segment"))).alias("name"))


def _literal(segment: Column) -> Column:
    """A segment that can't be taken for a wildcard or a group."""
    return F.when(segment.rlike(r"^[*+\\]"), F.concat(F.lit("\\"), segment)).otherwise(segment)


def path_templates(paths: DataFrame) -> DataFrame:
    """``host, path, template`` of ``paths`` (host, path, bad, own), whose rows differ in
    host and path. ``own`` counts a path's labels, ``bad`` the bad ones.

    There are as many levels as the deepest node has that leads to a branch; below it all
    segments are wildcards.
    """
    segments = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.substring("path", 2, 1 << 30), "/", -1))
    level = staged(paths.select("host", "path", "bad", "own", segments.alias("segments"), F.lit("").alias("node")), "url-level")
    done = workspace(paths.sparkSession, "url-done")
    depth = 0
    while True:
        going = F.size("segments") > depth
        # a node without a branch has none further down either
        nodes = level.where(going).groupBy("host", "node").agg(F.count("*").alias("n"), F.sum("own").alias("labels"))
        nodes = nodes.where((F.col("n") >= FREQUENT) | (F.col("labels") >= FREQUENT)).select("host", "node", F.lit(True).alias("wide"))
        marked = staged(level.join(nodes, ["host", "node"], "left").withColumn("wide", going & F.coalesce("wide", F.lit(False))), "url-nodes")
        unstage(level)
        rest = F.repeat(F.lit("/*"), F.greatest(F.size("segments") - depth, F.lit(0)))
        marked.where("not wide").select("host", "path", "bad", "own", F.concat("node", rest).alias("template")).write.mode("append").parquet(done)
        wide = marked.where("wide").withColumn("segment", F.get("segments", F.lit(depth)))
        if wide.isEmpty():
            unstage(marked)
            break
        branches = wide.groupBy("host", "node", "segment").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("own").alias("own"))
        names = _named(branches.where((F.col("n") >= FREQUENT) | (F.col("own") >= FREQUENT)).drop("n"))
        grown = F.concat("node", F.lit("/"), F.coalesce("name", F.lit("*")))
        joined = wide.join(names, ["host", "node", "segment"], "left")
        level = staged(joined.select("host", "path", "bad", "own", "segments", grown.alias("node")), "url-level")
        unstage(marked)
        depth += 1
    found = paths.sparkSession.read.parquet(done)
    templates = staged(found, "url-templates")
    delete(paths.sparkSession, done)
    return templates


def judged_urls(
    rows: DataFrame, url_column: str = "url", bad_column: str | None = None, rules: Sequence[tuple[str, str]] = RULES
) -> DataFrame:
    """``rows`` with ``host, path, rule, verdict, template, purity``.

    ``bad_column`` holds labels: true or false, NULL where there is none. Where a rule fits,
    its verdict is also the label. ``verdict`` is the rule's, else ``block`` if the smoothed
    share of bad labels of the URL's template (``purity``) is ``REJECT`` or more, else
    ``allow``. Without any labels nothing is rejected by its template.

    A NULL url, or one without ``://``, has an empty host and path; those share a template.
    Repeated rows are one path, whose labels all count. An empty table gives an empty
    result, columns with the names of new ones are replaced, others may have any name.
    """
    new = ["host", "path", "rule", "verdict", "template", "purity"]
    plain = [c for c in rows.columns if c.lower() not in new]
    url = F.col(f"`{url_column}`").cast("string")
    host, path = host_and_path(url)
    label = F.lit(None).cast("boolean") if bad_column is None else F.col(f"`{bad_column}`").cast("boolean")
    # the columns of the table stay packed, so their names meet none of those used here
    packed = rows.select(F.struct(*(F.col(f"`{c}`") for c in plain)).alias("row"), label.alias("label"), host.alias("host"), path.alias("path"))
    packed = packed.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    bad = F.coalesce(F.col("fit.verdict") == "block", F.col("label"))
    paths = packed.groupBy("host", "path").agg(F.count_if(bad).alias("bad"), F.count(bad).alias("own"))
    found = path_templates(paths)
    counts = staged(found.groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum("own").alias("own")), "url-purity")
    hosts = counts.groupBy("host").agg(F.sum("b").alias("host_b"), F.sum("own").alias("host_own"))
    everything = counts.agg(F.sum("b").alias("b"), F.sum("own").alias("own")).first()
    overall = (everything["b"] or 0) / everything["own"] if everything["own"] else 0.0
    of_host = (F.col("host_b") + PRIOR * overall) / (F.col("host_own") + PRIOR)
    purity = (F.col("b") + PRIOR * of_host) / (F.col("own") + PRIOR)
    pure = counts.join(hosts, "host").select("host", "template", purity.alias("purity"))
    judged = found.select("host", "path", "template").join(pure, ["host", "template"])
    return packed.join(judged, ["host", "path"], "left").select(
        *(F.col(f"row.`{c}`") for c in plain), "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"),
        "template", "purity",
    )
