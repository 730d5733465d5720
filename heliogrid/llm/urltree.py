"""URL filter: explicit host/path rules first, a template tree for all other urls.

All of it is DataFrame operations.  Per host, path segments with a digit and segments
that are not frequent at their depth become ``*``; what remains is the url's template.
Templates hang in a tree by their prefixes, per host, and a second tree, of host ``*``,
joins the branches of equal template over all hosts.  Urls that a rule decides are the
labelled ones.  A branch whose blocked share does not differ from its parent's (score
test, chi-square of one degree) is merged into the parent.  A template is rejected by the
smoothed purity of the deepest branch above it that stands on its own.

Scale.  Counts are aggregated before any shuffle.  Frequent segments are at most
1 / MIN_SHARE per host and depth, so a host's list of them is bounded.  The lists and the
verdicts are written tables, so that the joins back to all urls are plain joins whose hot
keys Spark can split.

Defined results.  A null url, or one without ``://``, has empty host and path, and no
rule fits it; its template is the root of host ``''``.  Depths beyond MAX_DEPTH share the
segment ``**``.  An empty table gives an empty result.  Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
MAX_DEPTH = 12
MIN_COUNT = 20
MIN_SHARE = 0.02
SMOOTHING = 10.0
CHI_SQUARE = 3.84
THRESHOLD = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls.  A rule list is configuration, hence literals."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, max_depth: int = MAX_DEPTH, min_count: int = MIN_COUNT, min_share: float = MIN_SHARE, smoothing: float = SMOOTHING, chi_square: float = CHI_SQUARE, threshold: float = THRESHOLD) -> DataFrame:
    """Judge every url.  Returns per row: id_col, host, path, rule, verdict, template, purity.

    ``purity`` is the smoothed blocked share by which the method judges the template; it
    is given for rows with a rule too, whose verdict is the rule's.
    """
    host, path = split_url(F.col(url_col))
    base = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    segments = F.transform(segments, lambda s: F.when(s.rlike("[0-9]"), F.lit("*")).otherwise(s))
    deep = F.concat(F.slice(segments, 1, max_depth), F.array(F.lit("**")))
    base = base.select("id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), F.when(F.size(segments) > max_depth, deep).otherwise(segments).alias("segs"))
    base = written(base, "url-parts")

    # Frequent literal segments, as one short list per host.
    at_depth = base.select("host", F.posexplode("segs").alias("depth", "seg")).groupBy("host", "depth", "seg").agg(F.count(F.lit(1)).alias("n"))
    at_depth = written(at_depth, "url-segments")
    totals = at_depth.groupBy("host", "depth").agg(F.sum("n").alias("total"))
    often = at_depth.join(totals, ["host", "depth"]).filter((F.col("n") >= min_count) & (F.col("n") >= F.col("total") * min_share))
    often = written(often.groupBy("host").agg(F.collect_set(F.concat_ws(":", "depth", "seg")).alias("often")), "url-frequent")

    literal = F.transform("segs", lambda s, i: F.when(F.array_contains(F.coalesce("often", F.array().cast("array<string>")), F.concat_ws(":", i.cast("string"), s)), s).otherwise(F.lit("*")))
    rows = base.join(often, "host", "left").select("id", "host", "path", "rule", "by_rule", literal.alias("segs"))
    rows = rows.select("id", "host", "path", "rule", "by_rule", "segs", F.concat(F.lit("/"), F.array_join("segs", "/")).alias("template"))
    templates = rows.groupBy("host", "template", "segs").agg(F.count("by_rule").alias("labelled"), F.count_if(F.col("by_rule") == "block").alias("blocked"))
    templates = written(templates, "url-templates")

    # The trees: each template adds its counts to its prefixes, in its host's tree and in that of all hosts.
    prefixes = F.transform(F.sequence(F.lit(0), F.size("segs")), lambda d: F.struct(d.alias("depth"), F.concat(F.lit("/"), F.array_join(F.slice("segs", 1, d), "/")).alias("node")))
    trees = F.explode(F.array("host", F.lit("*"))).alias("tree")
    paths = templates.select("host", "template", trees, "labelled", "blocked", prefixes.alias("prefixes")).select("host", "template", "tree", "labelled", "blocked", F.inline("prefixes").alias("depth", "node"))
    nodes = paths.groupBy("tree", "depth", "node").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    nodes = written(nodes, "url-nodes")
    parent = nodes.select(F.col("tree").alias("p_tree"), F.col("depth").alias("p_depth"), F.col("node").alias("p_node"), F.col("labelled").alias("p_labelled"), F.col("blocked").alias("p_blocked"))
    # A host's root hangs below the root of all hosts.
    child = nodes.withColumn("up_tree", F.when(F.col("depth") == 0, F.lit("*")).otherwise(F.col("tree"))).withColumn("up_depth", F.greatest(F.col("depth") - 1, F.lit(0))).withColumn("up_node", F.when(F.col("depth") == 0, F.lit("/")).otherwise(F.expr("CASE WHEN depth = 1 THEN '/' ELSE substring_index(node, '/', depth) END")))
    both = child.join(parent, (F.col("up_tree") == F.col("p_tree")) & (F.col("up_depth") == F.col("p_depth")) & (F.col("up_node") == F.col("p_node")))
    p = F.when(F.col("p_labelled") > 0, F.col("p_blocked") / F.col("p_labelled")).otherwise(0.0)
    apart = F.pow(F.col("blocked") - F.col("labelled") * p, F.lit(2.0)) > F.lit(chi_square) * F.col("labelled") * p * (1 - p)
    root = (F.col("tree") == "*") & (F.col("depth") == 0)
    overall = F.when(F.col("g_labelled") > 0, F.col("g_blocked") / F.col("g_labelled")).otherwise(0.0)
    whole = nodes.filter(root).select(F.col("labelled").alias("g_labelled"), F.col("blocked").alias("g_blocked"))  # one row
    own = both.filter(root | ((F.col("labelled") > 0) & apart)).join(F.broadcast(whole))
    own = own.select("tree", "depth", "node", ((F.col("blocked") + smoothing * overall) / (F.col("labelled") + smoothing)).alias("purity"))

    # Of the branches above a template that stand on their own: the host's before all hosts', then the deepest.
    rank = F.struct((F.col("tree") != "*").alias("own"), F.col("depth"))
    verdicts = paths.select("host", "template", "tree", "depth", "node").join(own, ["tree", "depth", "node"]).groupBy("host", "template").agg(F.max_by("purity", rank).alias("purity"))
    verdicts = written(verdicts, "url-verdicts")
    judged = rows.join(verdicts, ["host", "template"], "left")
    by_tree = F.when(F.col("purity") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", by_tree).alias("verdict"), "template", "purity")
