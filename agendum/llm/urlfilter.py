"""URL filters: rules by host and path, and for the rest a ratio of character language models. DataFrame code only.

A rule is a host and a path like `example.com/en/`; it fits that host and its subdomains if the URL's path starts with
the rule's. The longest fitting rule decides. Where none fits, two variable-order Markov models of characters decide,
one learned from the URLs that rules accept and one from those they reject. Each has contexts of 0 to `ORDER` characters
with Witten-Bell smoothing: a context seen n times with q next characters gives its own counts n parts and the next
shorter context q parts. A URL's score is the difference of its log-likelihoods over its length. The threshold is
calibrated on URLs kept from learning: it lies between the two classes' mean scores at as many of their standard
deviations from either.

Learning takes every URL that a rule judges, of any length: by a hash of the URL, three quarters go into the counts and the
rest into the threshold. Equal URLs are laid into characters once, with their number. As a shorter n-gram is the end of a
longer one, only those of ORDER + 1 characters are counted over characters. Every URL without a rule is scored, equal
ones once. A character's value depends on its longest n-gram alone, so values are found once an n-gram; their table is
broadcast up to `BROADCAST_ROWS` rows and shuffled beyond.

Defined results: bytes that aren't UTF-8 are read as U+FFFD; a null URL, or one without `://`, has an empty host and path, and no rule fits it; the models score its
whole text, an empty one 0. Without accepted or without rejected URLs to learn from, what no rule judges is allowed.
Repeated rows are judged each; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from agendum.llm.common import Workspace, cut_lineage, text_of, unit_hash

ORDER = 3
#: Rows of the largest table of n-grams that is broadcast.
BROADCAST_ROWS = 200_000
ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("com/", ALLOW), ("example.com/en/", BLOCK), ("www.example.com/en/", ALLOW), ("net/es/", BLOCK), ("net/fr/", BLOCK))


@dataclass(frozen=True)
class Fit:
    #: Share of the judged URLs that is kept from the counts, for the threshold.
    calibrate: float = 0.25


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({u}, instr({u}, '://') + 3)".format(u="url")))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule, verdict): the last two null where no rule fits."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), text_of("url").alias("url")).withColumns({"host": host, "path": path})
    rule = verdict = F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is asked first
        own, slash, way = name.partition("/")
        fits = ((F.col("host") == own) | F.col("host").endswith("." + own)) & F.col("path").startswith(slash + way)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rows.withColumns({"rule": rule, "verdict": verdict})


def model_text(url: Column) -> Column:
    """What the models read: the URL in lower case without its scheme."""
    return F.translate(F.coalesce(F.regexp_replace(url, r"(?s)^.*?://", ""), F.lit("")), UPPER, LOWER)


def _places(texts: DataFrame) -> DataFrame:
    """A row a character: `gram`, the ORDER + 1 characters that end there."""
    padded = F.concat(F.lit("\n" * ORDER), "text")
    rows = texts.where(F.length("text") > 0).select("*", padded.alias("s")).select("*", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("at"))
    return rows.withColumn("gram", F.col("s").substr(F.col("at"), F.lit(ORDER + 1))).drop("s", "at")


def learn(texts: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """From (text, verdict) and perhaps n, how often a row counts, for each order: (gram, d), the difference of the models'
    log-likelihoods of a gram's last character, and (context, w), the difference of the log weights with which they leave a
    context."""
    n = F.col("n") if "n" in texts.columns else F.lit(1)
    counts = [F.sum(F.when(F.col("verdict") == v, n).otherwise(0)).alias(f"n{x}") for x, v in (("a", ALLOW), ("b", BLOCK))]
    grams = cut_lineage(_places(texts).groupBy("gram").agg(*counts))
    events, contexts, lower = [], [], None
    for k in range(ORDER + 1):
        own = grams.groupBy(F.right("gram", F.lit(k + 1)).alias("gram")).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")).withColumn("context", F.expr(f"substring(gram, 1, {k})"))
        whole = own.groupBy("context").agg(*(f(x) for x in "ab" for f in (lambda x: F.sum(f"n{x}").alias(f"t{x}"), lambda x: F.count_if(F.col(f"n{x}") > 0).alias(f"q{x}"))))
        rows = own.join(whole, "context")
        rows = rows.withColumns({"ba": F.lit(1 / 256), "bb": F.lit(1 / 256)}) if lower is None else rows.withColumn("shorter", F.expr("substring(gram, 2)")).join(lower, "shorter")
        p = {x: F.when(F.col(f"t{x}") == 0, F.col(f"b{x}")).otherwise((F.col(f"n{x}") + F.col(f"q{x}") * F.col(f"b{x}")) / (F.col(f"t{x}") + F.col(f"q{x}"))) for x in "ab"}
        found = cut_lineage(rows.select("gram", p["a"].alias("pa"), p["b"].alias("pb")))
        lower = found.select(F.col("gram").alias("shorter"), F.col("pa").alias("ba"), F.col("pb").alias("bb"))
        events.append(found.select(F.col("gram").alias(f"g{k}"), (F.log("pa") - F.log("pb")).alias(f"d{k}")))
        if k:
            leave = {x: F.when(F.col(f"t{x}") == 0, 0.0).otherwise(F.log(F.col(f"q{x}") / (F.col(f"t{x}") + F.col(f"q{x}")))) for x in "ab"}
            contexts.append(cut_lineage(whole.select(F.col("context").alias(f"c{k}"), (leave["a"] - leave["b"]).alias(f"w{k}"))))
    return events, contexts


def scores(texts: DataFrame, model: tuple[list[DataFrame], list[DataFrame]]) -> DataFrame:
    """(text, score) of the distinct texts: log-likelihood difference a character; no row for an empty text."""
    events, contexts = model
    distinct = cut_lineage(texts.select("text").distinct())
    ends = {f"g{k}": F.right("gram", F.lit(k + 1)) for k in range(ORDER + 1)} | {f"c{k}": F.substring("gram", ORDER + 1 - k, k) for k in range(1, ORDER + 1)}
    rows = _places(distinct).select("gram").distinct().withColumns(ends)
    for name, tables, first in (("g", events, 0), ("c", contexts, 1)):
        for k, table in enumerate(tables, first):
            rows = rows.join(table, f"{name}{k}", "left")
    value = F.coalesce(F.col("d0"), F.lit(0.0))
    for k in range(1, ORDER + 1):  # a longer gram that was seen replaces the shorter; else its context's weight is added
        value = F.when(F.col(f"d{k}").isNotNull(), F.col(f"d{k}")).otherwise(value + F.coalesce(f"w{k}", F.lit(0.0)))
    values, seen = Workspace(texts.sparkSession).put("values", rows.select("gram", value.alias("value")))
    values = F.broadcast(values) if seen["n"] <= BROADCAST_ROWS else values
    return _places(distinct).join(values, "gram").groupBy("text").agg(F.avg("value").alias("score"))


def judge(pages: DataFrame, rules=RULES, fit: Fit = Fit()) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, score): every page's verdict; score is null where a rule judged."""
    rows = by_rules(pages, rules).withColumn("text", model_text(F.col("url")))
    usable = rows.where(F.col("verdict").isNotNull() & (F.length("text") > 0))
    known = cut_lineage(usable.groupBy("text", "verdict").agg(F.count(F.lit(1)).alias("n")))
    sizes = {r["verdict"] for r in known.select("verdict").distinct().collect()}
    if len(sizes) < 2:
        return rows.select("page_id", "url", "host", "path", "rule", F.coalesce("verdict", F.lit(ALLOW)).alias("verdict"), F.when(F.col("rule").isNull(), 0.0).alias("score"))
    kept = unit_hash(F.col("text"), F.lit("fold")) < fit.calibrate
    model = learn(known.where(~kept))
    judged = cut_lineage(known.where(kept).join(scores(known.where(kept), model), "text").select("verdict", "n", "score"))
    n, score = F.sum("n"), F.col("score")
    means = {r["verdict"]: r["m"] for r in judged.groupBy("verdict").agg((F.sum(F.col("n") * score) / n).alias("m")).collect()}
    mean = F.when(F.col("verdict") == ALLOW, means.get(ALLOW, 0.0)).otherwise(means.get(BLOCK, 0.0))
    at = {r["verdict"]: (means[r["verdict"]], r["s"]) for r in judged.groupBy("verdict").agg(F.sqrt(F.sum(F.col("n") * (score - mean) ** 2) / n).alias("s")).collect()}
    (a, sa), (b, sb) = at.get(ALLOW, (0.0, 1.0)), at.get(BLOCK, (0.0, 1.0))
    threshold = (a * sb + b * sa) / (sa + sb) if sa + sb > 0 else (a + b) / 2
    open_ = rows.where("rule is null")
    judged = open_.join(scores(open_, model), "text", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    judged = judged.withColumn("verdict", F.when(F.col("score") >= threshold, ALLOW).otherwise(BLOCK))
    columns = ["page_id", "url", "host", "path", "rule", "verdict", "score"]
    return rows.where("rule is not null").withColumn("score", F.lit(None).cast("double")).select(*columns).unionAll(judged.select(*columns))
