"""URL filter: per host a tree of path templates, judged by the labels that rules give.

Level by level, under each (host, template so far), a segment that is one of many rare ones becomes the wildcard
``*``; literal branches whose share of blocked pages does not differ from their siblings' (two-proportion test) are
merged into ``~``; a last ``$`` closes a path.  A template is rejected if its purity exceeds a half.  Purity is the
blocked share of labelled pages, backed off along a chain: all pages, the template's ancestors and the template itself
over all hosts, the host, the template's ancestors there, the template; each is drawn towards the one before, so one
without labels has that one's.  Over all hosts a merged branch counts by its segment.  A page's verdict is its longest
rule's, else its template's.

What is joined back to pages at each level is the list of a node's literal branches, at most ``1 / RARE`` of them, so
hosts of any size are aggregated and never gathered; a host with a third of all pages is spread by its segments.

Defined results: null urls and such without ``://`` have an empty host and path; ids may be null or repeat (rows are
judged by themselves); segments beyond ``DEPTH`` stay together as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.scratch import materialise

#: Fixed values: (verdict, host and path); the longest that fits wins.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DEPTH = 6
#: A segment is variable if its node has this many different ones or more, and it makes up no more than this share of them.
MANY, RARE = 8, 0.05
SAME_Z, SMOOTHING, PURITY = 1.96, 4.0, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def ruled(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule of columns host and path, and its verdict; null where none fits."""
    rule = verdict = None
    for what, name in sorted(rules, key=lambda r: len(r[1])):  # later ones are longer and win
        host, path = name.split("/", 1)
        fits = (F.col("host").eqNullSafe(host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule = F.when(fits, F.lit(name)).otherwise(F.lit(None) if rule is None else rule)
        verdict = F.when(fits, F.lit(what)).otherwise(F.lit(None) if verdict is None else verdict)
    return rule, verdict


def read_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    rule, verdict = ruled(rules)
    return pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "ruled": verdict})


def segments(depth: int) -> Column:
    """The path's segments: ``depth`` at most, the last with all that follows, and the mark of the end."""
    parts = F.split(F.regexp_replace("path", "^/", ""), "/", depth)
    return F.concat(parts, F.array(F.lit("$")))


def branches(rows: DataFrame, many: int, rare: float, z: float) -> DataFrame:
    """(host, node, kept, merged): literal segments of each node, and which of them are alike, over rows (host, node,
    seg, n, labelled, blocked)."""
    by_seg = rows.groupBy("host", "node", "seg").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked")))
    total = by_seg.groupBy("host", "node").agg(F.count("*").alias("k"), *(F.sum(c).alias(f"{c}_all") for c in ("n", "labelled", "blocked")))
    both = by_seg.join(total, ["host", "node"])
    literal = (F.col("k") < many) | (F.col("n") > rare * F.col("n_all"))
    others, b_others = F.col("labelled_all") - F.col("labelled"), F.col("blocked_all") - F.col("blocked")
    pooled = F.col("blocked_all") / F.nullif(F.col("labelled_all"), F.lit(0))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.nullif("labelled", F.lit(0)) + 1 / F.nullif(others, F.lit(0))))
    apart = F.col("blocked") / F.nullif("labelled", F.lit(0)) - b_others / F.nullif(others, F.lit(0))
    alike = (F.col("labelled") > 0) & (others > 0) & (F.abs(apart) <= z * spread) & (F.col("k") > 1) & (F.col("seg") != "$")
    return (both.where(literal).groupBy("host", "node")
            .agg(F.collect_set("seg").alias("kept"), F.collect_set(F.when(alike, F.col("seg"))).alias("merged")))


def templates(paths: DataFrame, depth: int = DEPTH, many: int = MANY, rare: float = RARE, z: float = SAME_Z) -> DataFrame:
    """paths (host, path, n, labelled, blocked) with their template ``node``, and ``shape``, the same without merging."""
    rows = paths.withColumns({"segs": segments(depth), "node": F.lit(""), "shape": F.lit("")})
    for level in range(1, depth + 2):
        seg = F.get("segs", F.lit(level - 1))
        inner = rows.withColumn("seg", seg)
        known = branches(inner.where(F.col("seg").isNotNull()), many, rare, z)
        joined = inner.join(known, ["host", "node"], "left")
        own = F.when(F.col("seg").isNotNull(), F.when(F.array_contains("kept", F.col("seg")), F.col("seg")).otherwise(F.lit("*")))
        name = F.when(F.array_contains("merged", F.col("seg")), F.lit("~")).otherwise(own)
        named = joined.withColumns({"node": F.concat_ws("/", F.col("node"), name), "shape": F.concat_ws("/", F.col("shape"), own)})
        rows = materialise(named.select(rows.columns), "url-level")
    return rows


def backed_off(nodes: DataFrame, within: list[str], name: str, depth: int) -> DataFrame:
    """within, name and purity of nodes (within, name, labelled, blocked, start): ``start`` drawn towards the blocked share
    of each ancestor in turn, and last of the node itself."""
    parts = F.split(name, "/", depth + 1)
    line = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(parts, 1, i), "/").alias("above")))
    lines = nodes.select(*within, name, "labelled", "blocked", "start", F.inline(line))
    tree = lines.groupBy(*within, "above").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    chains = (lines.drop("labelled", "blocked").join(tree, [*within, "above"]).groupBy(*within, name)
              .agg(F.first("start").alias("start"), F.sort_array(F.collect_list(F.struct("at", "labelled", "blocked"))).alias("chain")))
    purity = F.aggregate("chain", F.col("start"), lambda p, c: (c.blocked + SMOOTHING * p) / (c.labelled + SMOOTHING))
    return chains.select(*within, name, F.round(purity, 9).alias("purity"))


def purities(paths: DataFrame, depth: int) -> DataFrame:
    """host, node and purity of every template of paths."""
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    leaves = materialise(paths.groupBy("host", "node", "shape").agg(*sums), "url-leaves")
    prior = leaves.agg((F.sum("blocked") / F.nullif(F.sum("labelled"), F.lit(0))).alias("prior")).scalar()
    shapes = leaves.groupBy("shape").agg(*sums[1:]).withColumn("start", F.coalesce(prior, F.lit(0.0)))
    anywhere = backed_off(materialise(shapes, "url-shapes"), [], "shape", depth).withColumnRenamed("purity", "anywhere")
    start = (F.sum(F.col("n") * F.col("anywhere")) / F.sum("n")).alias("start")
    nodes = leaves.join(anywhere, "shape").groupBy("host", "node").agg(*sums[1:], start)
    return backed_off(materialise(nodes, "url-nodes"), ["host"], "node", depth)


def judged(pages: DataFrame, rules=RULES, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row of pages."""
    read = read_pages(pages, rules)
    counts = read.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    paths = templates(materialise(counts, "url-paths"), **options)
    node = purities(paths, options.get("depth", DEPTH))
    by_path = paths.select("host", "path", "node").join(node, ["host", "node"])
    verdict = F.coalesce("ruled", F.when(F.col("purity") > PURITY, F.lit("block")).otherwise(F.lit("allow")))
    return (read.join(by_path, ["host", "path"], "left")
            .select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("node").alias("template"), "purity"))


def url_digest(pages: DataFrame) -> DataFrame:
    return judged(pages).select("page_id", "host", "path", "rule", "verdict", "template")


def allowed(pages: DataFrame, rules=RULES) -> DataFrame:
    """The rows of pages whose url is allowed; columns as they are."""
    blocked = judged(pages.select("page_id", "url"), rules).where("verdict = 'block'").select("host", "path").distinct()
    host, path = host_and_path(F.col("url"))
    keyed = pages.withColumns({"__host": host, "__path": path})
    blocked = blocked.select(F.col("host").alias("__host"), F.col("path").alias("__path"))
    return keyed.join(blocked, ["__host", "__path"], "left_anti").select(pages.columns)
