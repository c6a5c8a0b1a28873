"""URL filter with DataFrame functions only: host and path rules, then a character language-model ratio.

Rules judge what they fit. The URLs that rules accept and reject, over all pages, train two variable-order Markov
models of characters (interpolated Witten-Bell smoothing up to ``ORDER`` characters of context, down to an even share
for every code point, so that each context's probabilities sum to 1). A URL that no rule fits is accepted if its
length-normalised log-likelihood difference reaches a threshold that was calibrated on the rule-judged URLs of one
fold, which the counts leave out.

The models keep all n-grams, and apart from them all contexts. A character's probabilities depend on its longest n-gram
alone, so they are worked out once per distinct n-gram, from short to long by joins on unique keys. Positions then look
their n-gram up, and pages their URL: by a broadcast of at most ``MOST_BROADCAST`` rows (of ``MOST_CHARS`` on average), else by a shuffle join, from
which only the keys of more than a share of 1 / ``HOT`` of the rows are kept out by a broadcast. Results do not depend
on the way.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits no rule and is judged as empty text,
by its end mark alone; URLs may be of any length; without URLs of both classes the threshold is 0 and every difference
is 0 (accepted); equal URLs are judged alike, repeated rows are kept; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import partitions, written

#: (rule, verdict): host and all its subdomains, then a path's beginning.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER, FOLDS = 4, 5
#: All code points: what an even share is one of.
ALPHABET = 0x110000
#: Rows that may be broadcast and their mean key length; the share of rows that makes a key hot.
MOST_BROADCAST, MOST_CHARS, HOT = 400_000, 80, 1_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _positions(df: DataFrame) -> DataFrame:
    """A row for each character of ``body``, with its n-grams g0 (alone) to gK (K characters before it)."""
    padded = F.concat(F.lit("\u0001" * ORDER), F.col("body"), F.lit("\u0002"))
    at = df.withColumn("padded", padded).withColumn("at", F.explode(F.sequence(F.lit(ORDER + 1), F.length("padded"))))
    return at.select("*", *[F.substring(F.col("padded"), F.col("at") - F.lit(k), F.lit(k + 1)).alias(f"g{k}") for k in range(ORDER + 1)]).drop("padded", "at")


def gram_counts(labelled: DataFrame) -> DataFrame:
    """Per n-gram its counts under both verdicts (a: accepted, r: rejected)."""
    rows = _positions(labelled).select("good", F.explode(F.array(*[F.col(f"g{k}") for k in range(ORDER + 1)])).alias("gram"))
    return rows.groupBy("gram").agg(F.sum(F.col("good").cast("long")).alias("a"), F.sum((~F.col("good")).cast("long")).alias("r"))


def context_counts(counts: DataFrame) -> DataFrame:
    """Per context of n-grams its counts (ca, cr) and its kinds of next characters (ta, tr) under both verdicts."""
    context = F.expr("substring(gram, 1, length(gram) - 1)").alias("context")
    return counts.groupBy(context).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"), F.sum((F.col("a") > 0).cast("long")).alias("ta"), F.sum((F.col("r") > 0).cast("long")).alias("tr"))


def gram_scores(grams: DataFrame, counts: DataFrame, contexts: DataFrame) -> DataFrame:
    """Rows (gram, pg, pb) of distinct n-grams of ORDER + 1 characters: both models' probabilities of the last one.

    A context's own counts discount what comes from the shorter one, whether or not this character was seen after it.
    """
    found = None
    for k in range(ORDER + 1):
        ends = grams.select(F.substring("gram", ORDER + 1 - k, k + 1).alias("gram")).distinct()
        own = contexts.where(F.length("context") == k)
        at = ends.join(counts.where(F.length("gram") == k + 1), "gram", "left").withColumn("context", F.substring("gram", 1, k))
        at = at.join(F.broadcast(own) if k < 2 else own, "context", "left")  # one row, or one a character
        if found is None:
            at = at.withColumn("pg", F.lit(1.0 / ALPHABET)).withColumn("pb", F.lit(1.0 / ALPHABET))
        else:
            at = at.withColumn("shorter", F.substring("gram", 2, k)).join(found.withColumnRenamed("gram", "shorter"), "shorter")
        good, bad = (F.when(F.col(c) > 0, (F.coalesce(n, F.lit(0)) + F.col(t) * F.col(p)) / (F.col(c) + F.col(t))).otherwise(F.col(p)).alias(p) for n, c, t, p in (("a", "ca", "ta", "pg"), ("r", "cr", "tr", "pb")))
        found = at.select("gram", good, bad)
    return found


def looked_up(rows: DataFrame, table: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """The rows with ``value`` of a written table (key, value, n) of unique keys, n rows of each; null where there is none."""
    count, total, chars = table.agg(F.count("*"), F.sum("n"), F.sum(F.length(key))).first()
    if count <= most and (chars or 0) <= most * MOST_CHARS:
        return rows.join(F.broadcast(table.select(key, value)), key, "left")
    often = F.col("n") * HOT > (total or 0)  # fewer than HOT rows
    marked = rows.join(F.broadcast(table.where(often).select(key, F.col(value).alias("__often"), F.lit(True).alias("__hot"))), key, "left")
    rest = marked.where("__hot is null").drop("__often", "__hot").join(table.where(~often).select(key, value), key, "left")
    return marked.where("__hot").withColumn(value, F.col("__often")).select(*rest.columns).union(rest)


def ratios(urls: DataFrame, counts: DataFrame, contexts: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Rows (body, ratio) of distinct urls: mean log-likelihood difference per character, accepted minus rejected."""
    at = _positions(urls).select("body", F.col(f"g{ORDER}").alias("gram"))
    grams = written(at.groupBy("gram").agg(F.count("*").alias("n")), "url-positions")
    scores = written(gram_scores(grams, counts, contexts).join(grams, "gram").select("gram", (F.log("pg") - F.log("pb")).alias("gain"), "n"), "url-gains")
    return looked_up(at, scores, "gram", "gain", most).groupBy("body").agg(F.avg("gain").alias("ratio"))


def threshold(scored: DataFrame) -> float:
    """The cut of (good, ratio) with the best mean of both classes' accuracies; the one nearest 0 among equals."""
    step = 100
    binned = scored.groupBy(F.greatest(F.lit(-500), F.least(F.lit(500), F.floor(F.col("ratio") * step))).cast("int").alias("bin")).agg(F.sum(F.col("good").cast("long")).alias("a"), F.sum((~F.col("good")).cast("long")).alias("r"))
    bins = sorted((x["bin"], x["a"], x["r"]) for x in binned.collect())  # 1,001 rows at most
    a, r = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not a or not r:
        return 0.0
    choices, below_a, below_r = [], 0, 0
    for at, na, nr in [*bins, (bins[-1][0] + 1, 0, 0)]:
        choices.append((-((a - below_a) / a + below_r / r), abs(at), at))
        below_a, below_r = below_a + na, below_r + nr
    return min(choices)[2] / step


def filter_urls(df: DataFrame, *, key: str = "page_id", url: str = "url", rules=RULES, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, ratio) of every page."""
    host, path = host_and_path(F.col("url"))
    pages = df.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url")).withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.withColumn("rule", rule).withColumn("verdict", verdict).withColumn("body", F.concat("host", "path")).drop("url")
    bodies = judged.groupBy("body", (F.col("verdict") == "allow").alias("good")).agg(F.count("*").alias("n")).withColumn("tuning", F.crc32(F.col("body").cast("binary")) % FOLDS == 0)
    bodies = written(bodies.repartition(partitions(df.sparkSession), "body"), "url-bodies")  # a URL may have thousands of characters
    counts = written(gram_counts(bodies.where("good is not null and not tuning")), "url-grams")
    contexts = written(context_counts(counts), "url-contexts")
    wanted = bodies.where("good is null or tuning")
    scores = written(ratios(wanted, counts, contexts, most_broadcast).join(wanted.select("body", "good", "n"), "body"), "url-scores")
    cut = threshold(scores.where("good is not null"))
    found = looked_up(judged, scores.where("good is null").select("body", "ratio", "n"), "body", "ratio", most_broadcast)
    by_model = F.when(F.coalesce("ratio", F.lit(0.0)) >= cut, "allow").otherwise("block")
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_model).alias("verdict"), F.when(F.col("rule").isNull(), F.coalesce("ratio", F.lit(0.0))).alias("ratio"))
