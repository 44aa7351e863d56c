"""URL filters: listed rules first, else a tree of path templates judged by labelled purity.

Pages that a rule decides are the labelled ones.  Per host, variable parts of path segments
become wildcards; sibling branches with the same rest whose block shares do not differ significantly are
merged into one, however many they are, so that unlabelled siblings become a wildcard and a section whose labels differ
stays a branch of its own.  A template is rejected when its share of blocked labels, smoothed by
that of the same path on all hosts, is high.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.stage import staged

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_RULES = 1_000
Rule = tuple[str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` with A-Z lowered, and path; both empty without one."""

    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ASCII_UPPER, ASCII_LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(rules: Sequence[Rule], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls; of equal texts the first listed holds."""

    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in sorted(reversed(list(rules)), key=lambda r: len(r[0])):
        own, slash, rest = text.partition("/")
        fits = ((F.col(host) == own) | F.endswith(F.col(host), F.lit("." + own))) & F.startswith(F.col(path), F.lit(slash + rest))
        name, verdict = F.when(fits, F.lit(text)).otherwise(name), F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def path_shape(path: str = "path") -> Column:
    """Segments with digits, long hexadecimal and over-long segments generalised, joined by ``/``.

    Empty segments are left out, all others are kept.
    """

    lower = f"translate({path}, '{ASCII_UPPER}', '{ASCII_LOWER}')"
    segment = (
        "case when s rlike '^[0-9a-f-]{16,}$' then '{h}' when length(s) > 40 then '{s}' "
        "else regexp_replace(s, '[0-9]+', '{n}') end"
    )
    return F.expr(f"transform(filter(split({lower}, '/'), s -> s <> ''), s -> {segment})")


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    strength: float = 4.0,
    max_z: float = 1.645,
    reject_from: float = 0.7,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, block_share`` of every page.

    ``rules`` are ``(host/path, allow or block)``; a rule fits its host and all subdomains when the
    path starts with the rule's, the longest decides.  The rest is decided by template:
    ``strength`` pseudo-labels come from the same shape on all hosts, and a template whose block
    share reaches ``reject_from`` is blocked.  Null urls, and those without ``://``, have an empty host
    and path and the empty template.  Repeated rows are judged alike.  Without any labelled page
    every template has the share one half, and is allowed.  Paths may have any depth.

    The tree is built on the distinct shapes per host, counted before anything is shuffled.
    """

    host, path = host_and_path(F.col("url"))
    rule, verdict = matching_rule(rules)
    parsed = (
        pages.select("page_id", host.alias("host"), path.alias("path"))
        .withColumns({"rule": rule, "listed": verdict})
        .withColumn("shape", path_shape())
    )
    counted = parsed.groupBy("host", "shape").agg(
        F.count(F.when(F.col("listed") == "allow", 1)).alias("allowed"),
        F.count(F.when(F.col("listed") == "block", 1)).alias("blocked"),
    )
    branches = staged(with_prior(staged(counted, "url-branches").withColumn("template", F.col("shape")), strength), "url-prior")
    branches = merged_branches(branches, max_z)
    judged = branches.groupBy("host", "template").agg(
        F.round(F.sum("pseudo_blocked") / F.sum(F.col("pseudo_blocked") + F.col("pseudo_allowed")), 6).alias("block_share")
    )
    found = branches.join(judged, ["host", "template"]).select(
        F.col("host").alias("h"), F.col("shape").alias("s"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "block_share"
    )
    by_template = F.when(F.col("block_share") >= reject_from, F.lit("block")).otherwise(F.lit("allow"))
    return parsed.join(found, (F.col("host") == F.col("h")) & (F.col("shape") == F.col("s")), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("listed", by_template).alias("verdict"), "template", "block_share"
    )


def open_levels(branches: DataFrame) -> DataFrame:
    """``host, levels``: the places, from 0, at which two shapes of a host differ.

    Elsewhere there is nothing to generalise.
    """

    each = branches.select("host", F.posexplode("shape").alias("at", "segment"))
    ends = each.groupBy("host", "at").agg(F.min("segment").alias("low"), F.max("segment").alias("high"))
    return ends.where("low <> high").groupBy("host").agg(F.sort_array(F.collect_list("at")).alias("levels"))


def starred(places: Column) -> Column:
    """The template with ``*`` at ``places``."""

    return F.transform("template", lambda s, i: F.when(F.array_contains(places, i), F.lit("*")).otherwise(s))


def with_prior(branches: DataFrame, strength: float) -> DataFrame:
    """Add label counts with pseudo-labels from the same template on all hosts."""

    total = branches.agg(F.coalesce(F.sum("allowed"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    base = (total[1] + 1.0) / (total[0] + total[1] + 2.0)
    world = branches.groupBy("template").agg(F.sum("allowed").alias("ga"), F.sum("blocked").alias("gb"))
    prior = (F.col("gb") + F.lit(strength * base)) / (F.col("ga") + F.col("gb") + F.lit(strength))
    return branches.join(world, "template").select(
        *branches.columns,
        (F.col("allowed") + F.lit(strength) * (1 - prior)).alias("pseudo_allowed"),
        (F.col("blocked") + F.lit(strength) * prior).alias("pseudo_blocked"),
    )


def merged_branches(branches: DataFrame, max_z: float) -> DataFrame:
    """Branches with the templates that are left when no more siblings are alike.

    Every round tests all levels of all hosts at once, so the rounds follow the
    merges that depend on each other and not the depth of the paths.
    """

    levels = staged(open_levels(branches), "url-levels")
    while True:
        marks = staged(alike_siblings(branches.join(levels, "host"), max_z), "url-marks")
        if not marks.limit(1).count():
            return branches
        named = marks.withColumnsRenamed({"host": "h", "template": "t"})
        joined = branches.join(named, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")), "left")
        template = F.when(F.col("places").isNull(), F.col("template")).otherwise(starred(F.col("places")))
        branches = staged(joined.select(*[c for c in branches.columns if c != "template"], template.alias("template")), "url-merged")


def alike_siblings(branches: DataFrame, max_z: float) -> DataFrame:
    """``host, template, places``: where the block share of a template does not differ from that of its siblings.

    Siblings differ in one segment only and are compared with what they have together; a segment is
    starred if at least two of them are alike.
    """

    one = branches.groupBy("host", "template", "levels").agg(F.sum("pseudo_allowed").alias("a"), F.sum("pseudo_blocked").alias("b"))
    each = one.select("host", "template", "a", "b", F.explode("levels").alias("at")).where(F.col("at") < F.size("template"))
    each = each.withColumn("rest", starred(F.array("at")))
    sibling = ["host", "at", "rest"]
    pooled = each.groupBy(*sibling).agg(F.count("*").alias("siblings"), (F.sum("b") / F.sum(F.col("a") + F.col("b"))).alias("p"))
    n = F.col("a") + F.col("b")
    z = F.abs(F.col("b") / n - F.col("p")) / F.sqrt(F.col("p") * (1 - F.col("p")) / n)
    alike = each.join(pooled.where("siblings > 1"), sibling).where(F.round(z, 6) <= max_z)
    several = alike.groupBy(*sibling).count().where("count > 1").drop("count")
    own = F.get("template", F.col("at")) != "*"
    return alike.join(several, sibling).where(own).groupBy("host", "template").agg(F.sort_array(F.collect_list("at")).alias("places"))
