"""URL filtering by a path-template tree.

Rules decide what they cover, and label the URLs that the tree learns from.
Per host the tree generalises variable path segments into wildcards, level by
level, merges sibling branches whose labels do not differ significantly, and
rejects a branch whose smoothed share of allowed URLs is too low.  Everything
works on counts per distinct path; DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

#: A node with more children is variable: only those with at least this
#: part of its URLs stay apart.
MAX_CHILDREN = 32
#: A branch joins its siblings if its labels differ from theirs by fewer
#: standard errors than this.
SIMILAR_Z = 1.96
SMOOTHING = 4.0
MIN_PURITY = 0.5


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; null or no ``://``: empty."""
    host = F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), "^([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def matching_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its action (both null if none does).
    ``rules``: ``(action, "host/path")``; a rule fits its host and all
    subdomains if the path starts with the rule's."""
    name = action = F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: len(r[1])):
        of, slash, start = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + start)
        name, action = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def _variable(segment: Column) -> Column:
    """Numbers, hashes and ids are variable whatever their count."""
    return segment.rlike(r"[0-9]") | (F.length(segment) > 40)


def path_templates(paths: DataFrame) -> DataFrame:
    """``template`` and its ``parent`` for the distinct ``(host, path, n, ...)``.

    Level by level: a segment is ``*`` if it holds a digit or is very long,
    or if its node has more than ``MAX_CHILDREN`` children and it is none of
    the frequent ones (that share of the node's URLs).  Below a node of no
    more paths than ``MAX_CHILDREN`` no node has more children, so its paths
    are finished at once; the tree goes on, to any depth, below the others."""
    work = materialise(paths.withColumn("rest", F.expr("slice(split(path, '/'), 2, size(split(path, '/')))"))
                       .withColumn("template", F.lit("")).withColumn("parent", F.lit("")), "url-templates")
    done = []
    while True:
        nodes = work.groupBy("host", "template").agg(F.count("*").alias("paths")).filter(F.col("paths") > MAX_CHILDREN) \
            .select(F.col("host").alias("h"), F.col("template").alias("t"))
        in_node = (F.col("host") == F.col("h")) & (F.col("template") == F.col("t"))
        open_ = F.col("h").isNotNull() & (F.size("rest") > 0)
        marked = materialise(work.join(nodes, in_node, "left").withColumn("open", open_).drop("h", "t"), "url-open")
        literal = F.transform("rest", lambda s: F.when(_variable(s), F.lit("*")).otherwise(s))

        def joined(parts: Column) -> Column:
            return F.concat("template", F.array_join(F.transform(parts, lambda s: F.concat(F.lit("/"), s)), ""))
        ends = marked.filter("NOT open").withColumn("literal", literal)
        some = F.size("literal") > 0
        done.append(ends.withColumn("parent", F.when(some, joined(F.slice("literal", F.lit(1), F.size("literal") - 1))).otherwise(F.col("parent")))
                    .withColumn("template", joined(F.col("literal"))).drop("rest", "open", "literal"))
        step = marked.filter("open").drop("open").withColumn("segment", F.col("rest")[0])
        if not step.limit(1).count():
            break
        step = step.withColumn("segment", F.when(_variable(F.col("segment")), F.lit("*")).otherwise(F.col("segment")))
        kids = step.filter("segment <> '*'").groupBy("host", "template", "segment").agg(F.sum("n").alias("n"))
        wide = (kids.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("n").alias("total"))
                .filter(F.col("children") > MAX_CHILDREN).drop("children"))
        rare = (kids.join(wide, ["host", "template"]).filter(F.col("n") * MAX_CHILDREN < F.col("total"))
                .select(F.col("host").alias("h"), F.col("template").alias("t"), F.col("segment").alias("s")))
        step = (step.join(rare, in_node & (F.col("segment") == F.col("s")), "left")
                .withColumn("segment", F.when(F.col("s").isNotNull(), F.lit("*")).otherwise(F.col("segment"))).drop("h", "t", "s"))
        work = materialise(step.withColumn("parent", F.col("template")).withColumn("template", F.concat("template", F.lit("/"), "segment"))
                           .withColumn("rest", F.expr("slice(rest, 2, size(rest))")).drop("segment"), "url-templates")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def branch_of(template: Column) -> tuple[Column, Column]:
    """The tree's branching point of a template: its last literal segment, and
    the node above it (what follows is wildcards)."""
    literal = F.regexp_extract(template, r"^(.*?)((?:/\*{1,2}|/)*)$", 1)
    return literal, F.regexp_extract(literal, r"^(.*)/[^/]*$", 1)


def branch_purity(templates: DataFrame) -> DataFrame:
    """``host, template, purity, merged`` from label counts ``allowed`` and
    ``blocked`` per ``(host, template)``.

    Siblings under one node of a host are compared with the rest of the node;
    those within ``SIMILAR_Z`` standard errors pool their labels.  The share
    of allowed URLs is smoothed towards the same template's share on all
    hosts, and that towards the share of all labelled URLs."""
    literal, above = branch_of(F.col("template"))
    t = materialise(templates.groupBy("host", "template").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
                    .withColumn("literal", literal).withColumn("above", above), "url-labels")
    total = t.agg(F.sum("allowed"), F.sum("blocked")).first()
    overall = ((total[0] or 0) + 1) / ((total[0] or 0) + (total[1] or 0) + 2)
    branch = t.groupBy("host", "above", "literal").agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"))
    node = branch.groupBy("host", "above").agg(F.sum("a").alias("node_a"), F.sum("b").alias("node_b"),
                                               F.count("*").alias("siblings"))
    n, m = F.col("a") + F.col("b"), F.col("node_a") + F.col("node_b") - F.col("a") - F.col("b")
    rest_a = F.col("node_a") - F.col("a")
    pooled = (F.col("node_a") + 1) / (F.col("node_a") + F.col("node_b") + 2)
    z = F.abs((F.col("a") + pooled) / (n + 1) - (rest_a + pooled) / (m + 1)) / F.sqrt(
        pooled * (1 - pooled) * (1 / (n + 1) + 1 / (m + 1)))
    # a branch without labels shows no likeness to its siblings
    branch = (branch.join(node, ["host", "above"])
              .withColumn("merged", (n > 0) & (m > 0) & (z < SIMILAR_Z)).select(
                  "host", "above", "literal", "a", "b", "merged"))
    pool = branch.filter("merged").groupBy("host", "above").agg(F.sum("a").alias("pool_a"), F.sum("b").alias("pool_b"))
    branch = branch.join(pool, ["host", "above"], "left").select(
        "host", "above", "literal", "merged",
        F.when(F.col("merged"), F.col("pool_a")).otherwise(F.col("a")).alias("a"),
        F.when(F.col("merged"), F.col("pool_b")).otherwise(F.col("b")).alias("b"))
    everywhere = t.groupBy("template").agg(F.sum("allowed").alias("all_a"), F.sum("blocked").alias("all_b"))
    prior = (F.col("all_a") + SMOOTHING * overall) / (F.col("all_a") + F.col("all_b") + SMOOTHING)
    purity = (F.col("a") + SMOOTHING * prior) / (F.col("a") + F.col("b") + SMOOTHING)
    return (t.join(branch, ["host", "above", "literal"]).join(everywhere, "template")
            .select("host", "template", purity.alias("purity"), "merged"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
               min_purity: float = MIN_PURITY) -> DataFrame:
    """Per row: the id, ``host``, ``path``, ``rule`` (null: none fits),
    ``verdict`` (allow or block), ``template`` and ``purity`` (null where a
    rule decides).

    A null URL or one without ``://`` has an empty host and path and is judged
    like any other; repeated rows are judged alike and come back each; without
    any label the tree allows."""
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    name, action = matching_rule(rules, F.col("host"), F.col("path"))
    paths = materialise(urls.groupBy("host", "path").agg(F.count("*").alias("n"))
                        .withColumn("rule", name).withColumn("action", action), "url-paths")
    templates = materialise(path_templates(paths), "url-tree")
    labelled = templates.select("host", "template", F.when(F.col("action") == "allow", F.col("n")).otherwise(0).alias("allowed"),
                                F.when(F.col("action") == "block", F.col("n")).otherwise(0).alias("blocked"))
    judged = templates.join(branch_purity(labelled), ["host", "template"])
    verdict = F.coalesce("action", F.when(F.col("purity") >= min_purity, F.lit("allow")).otherwise(F.lit("block")))
    judged = judged.select(F.col("host").alias("h"), F.col("path").alias("p"), "rule", verdict.alias("verdict"), "template",
                           F.when(F.col("rule").isNull(), F.col("purity")).alias("purity"))
    return (urls.join(judged, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")))
            .select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "template", "purity"))
