"""URL filter with a tree of path templates, in DataFrame functions only.

Each host has a tree: below it the segments of its paths. Segments that are numbers, hexadecimal or very long are
variable and become wildcards that keep their extension (``{n}.html``). Then, level by level, the branches below a node
are compared: a branch whose share of bad pages doesn't differ from that of its siblings merges into ``*``; one that
differs clearly stays. A template is judged by its labelled purity, smoothed towards that of its parent, and so on up to
the host and the whole table; templates with too large a share of bad pages are rejected.

Fixed rules of host and path come before the tree.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm import urls
from llm.frames import BROADCAST_ROWS, column, stored

#: Rounds of smoothing of a template that ends higher up; a deeper one is smoothed once a level.
ROUNDS = 6
#: A branch is kept apart if its share differs by so many standard errors, from at least so many labelled pages.
APART, LEAST = 3.0, 20
#: Labelled pages that a parent's share weighs as much as.
SMOOTHING = 10.0
#: A template is rejected from this share of bad pages.
REJECT = 0.5

VARIABLE = r"^(?:[0-9]+|[0-9a-f]*[0-9][0-9a-f]{7,}|[^.]{40,}|[0-9]{1,4}(?:-[0-9]{1,2}){1,2}|[A-Za-z]*[0-9]{3,})((?:\.[A-Za-z0-9]{1,5})?)$"


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct of rule and verdict; null: none. Rules: host, path, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's. Ties go to the first in the list.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """The path's segments, variable ones generalised."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    end = F.when(path.endswith("/"), F.array(F.lit("/"))).otherwise(F.array().cast("array<string>"))
    general = F.transform(parts, lambda s: F.when(s.rlike("(?i)" + VARIABLE), F.concat(F.lit("{v}"), F.regexp_extract(s, "(?i)" + VARIABLE, 1))).otherwise(s))
    return F.concat(general, end)


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_ROWS // 4 + 1).count() <= BROADCAST_ROWS // 4 else table


def templates(pages: DataFrame, apart: float = APART, least: int = LEAST, smoothing: float = SMOOTHING) -> DataFrame:
    """The tree's leaves: host, ``segments`` as they come, ``template``, pages, labelled, bad, smoothed share of bad pages.

    ``pages``: host, segments, bad (0, 1 or null), one row for each page. The tree is as deep as the longest path.
    """
    # From here on, one row for each host and sequence of segments.
    leaves = stored(pages.groupBy("host", "segments").agg(F.count("*").alias("pages"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad")))
    total, deepest = leaves.agg((F.sum("bad") + 0.5) / (F.sum("labelled") + 1), F.max(F.size("segments"))).first()
    sums = [F.sum("labelled").alias("n"), F.sum("bad").alias("b")]
    now = leaves.withColumn("template", F.lit("")).withColumn("share", F.lit(0.5 if total is None else total))
    ended = None
    for level in range(max(ROUNDS, deepest or 0) + 1):
        if level > ROUNDS:
            # Only paths that reach the node take part in deeper levels, so that a few long ones cost little.
            over = now.filter(F.size("segments") < level - 1)
            ended, now = over if ended is None else ended.union(over), now.filter(F.size("segments") >= level - 1)
        if level:
            # Branches of a node: those that differ from the rest of the node stay, the others become one.
            here = now.withColumn("part", F.when(F.size("segments") >= level, F.element_at("segments", level)))
            branches = here.groupBy("host", "template", "part").agg(*sums)
            nodes = branches.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b"))
            both = branches.join(nodes, ["host", "template"])
            rest_n, rest_b = F.col("all_n") - F.col("n"), F.col("all_b") - F.col("b")
            pooled = (F.col("all_b") + 1) / (F.col("all_n") + 2)
            error = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(F.col("n"), F.lit(1)) + 1 / F.greatest(rest_n, F.lit(1))))
            differs = (F.col("n") >= least) & (rest_n >= least) & (F.abs(F.col("b") / F.col("n") - rest_b / F.greatest(rest_n, F.lit(1))) > apart * error)
            name = F.when(F.col("part").startswith("{v}") | (F.col("part") == "/") | differs, F.col("part")).otherwise("*")
            grown = F.when(F.col("part").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), name))
            merged = stored(both.select("host", "template", "part", grown.alias("grown")))
            key = [here["host"].eqNullSafe(merged["host"]), here["template"] == merged["template"], here["part"].eqNullSafe(merged["part"])]
            now = here.join(_small(merged), key).select(here["host"], "segments", "pages", "labelled", "bad", "share", merged["grown"].alias("template"))
        shares = now.groupBy("host", "template").agg(*sums, F.max("share").alias("parent")).select("host", "template", ((F.col("b") + smoothing * F.col("parent")) / (F.col("n") + smoothing)).alias("new_share"))
        # What ends at the node keeps its share, however deep other paths are.
        share = F.when((F.size("segments") >= level) | (F.lit(level) <= ROUNDS), F.col("new_share")).otherwise(F.col("share"))
        now = stored(now.join(shares, ["host", "template"]).select("host", "segments", "pages", "labelled", "bad", "template", share.alias("share")))
    return now if ended is None else ended.union(now)


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[tuple[str, str, str]],
    key: str = "page_id",
    url: str = "url",
    reject: float = REJECT,
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` (allow or block), ``template``, ``bad_share`` of every page.

    ``labels`` (``page_id``, ``bad``: 0 or 1) covers some pages; a page with several labels is bad if one is. Null urls and
    urls without ``://`` have an empty host and path, which are a host like any other; a null page has no label. Repeated
    rows are judged each and count each. Other columns are ignored; an empty table gives an empty table.
    """
    rows = pages.select(column(key).cast("long").alias("page_id"), urls.host(column(url)).alias("host"), urls.path(column(url)).alias("path"))
    rows = rows.withColumn("host", F.coalesce("host", F.lit(""))).withColumn("path", F.coalesce("path", F.lit(""))).withColumn("segments", segments(F.col("path")))
    once = labels.filter("bad is not null").groupBy("page_id").agg(F.max("bad").cast("int").alias("bad"))
    tree = templates(rows.join(once, "page_id", "left").select("host", "segments", "bad"))
    # A hot host has few templates after generalising; the rows to judge are joined to them, not gathered.
    judged = rows.join(_small(tree.select("host", "segments", "template", F.col("share").alias("bad_share"))), ["host", "segments"], "left")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    return judged.withColumn("_rule", rule).select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("bad_share") >= reject, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("template", F.lit("")).alias("template"),
        "bad_share",
    )
