"""URL filter: allow and block rules, and two character models for the rest.

Rules decide the urls they fit. From these, one variable-order Markov model of
accepted and one of rejected urls is estimated. A url that no rule fits is
allowed if the mean log-likelihood ratio of its characters reaches a threshold.
The models are estimated on every url that a rule decides. The threshold is
calibrated on all of these too, each scored by models without its host's fold
(without its url's fold where the hosts of a kind are all in one).

Characters fall into 32 classes (a-z, any digit, ``.``, ``-``, ``/``, any other,
and the border of a url), so that a model over contexts of up to three characters
is at most 32**4 rows, whatever the input, and can be broadcast.

Main path: DataFrame functions only.

Defined results: a null url, or one without ``://``, has an empty host and path;
no rule fits it and it is judged by what text it has. Repeated urls get equal
verdicts; each row counts in the estimate. An empty table gives an empty result;
without rule-decided urls of both kinds every ratio is compared with zero. Input
columns named like an output column are replaced; all others are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tideline.llm.common import keeping_columns
from tideline.llm.quality_votes import let
from tideline.session import materialize

LETTERS_UP, LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLASSES, ORDER = 32, 3
#: Every character is rewritten to one whose code, modulo 32, is its class; 0 is the border.
DIGIT, DOT, DASH, SLASH, OTHER = "{", "|", "}", "~", "\x7f"
FOLDS, BINS_PER_NAT, WIDEST = 5, 64, 16

#: (verdict, rule); a rule is a host and a path.
PRODUCTION_RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
    ("block", "net/es/"), ("block", "net/fr/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), LETTERS_UP, LETTERS)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def apply_rules(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct of rule and verdict of the longest rule that fits, or null."""
    chosen = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, below = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + below))
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _classes(url: Column) -> Column:
    """Character classes of a url, with ORDER borders before it and one behind."""
    lower = F.translate(F.coalesce(url, F.lit("")), LETTERS_UP, LETTERS)
    plain = F.regexp_replace(F.regexp_replace(lower, "(?s)[^a-z0-9./-]", OTHER), "[0-9]", DIGIT)
    chars = F.array_remove(F.split(F.translate(plain, "./-", DOT + SLASH + DASH), ""), "")
    codes = F.transform(chars, lambda c: F.ascii(c).bitwiseAND(CLASSES - 1))
    border = F.array(*[F.lit(0)] * ORDER)
    return F.concat(border, codes, F.array(F.lit(0)))


def _gram(codes: Column, i: Column) -> Column:
    """Number of the four classes that start at i."""
    out = F.get(codes, i)
    for k in range(1, ORDER + 1):
        out = F.shiftleft(out, 5).bitwiseOR(F.get(codes, i + k))
    return out


def _grams(url: Column) -> Column:
    return let(_classes(url), lambda c: F.transform(
        F.sequence(F.lit(0), F.size(c) - F.lit(ORDER + 1)), lambda i: _gram(c, i)
    ))


def count_grams(urls: DataFrame) -> DataFrame:
    """fold, gram and how often it occurs in accepted (yes) and rejected (no) ``urls``: url, accepted, fold."""
    grams = urls.select("accepted", "fold", F.explode(_grams(F.col("url"))).alias("gram"))
    return grams.groupBy("fold", "gram").agg(
        F.count_if(F.col("accepted")).cast("double").alias("yes"),
        F.count_if(~F.col("accepted")).cast("double").alias("no"),
    )


def smooth_counts(counts: DataFrame, models: int, narrow: int = 0) -> DataFrame:
    """From model, gram, yes and no: model, context and the log-likelihood ratios of the class behind it.

    Witten-Bell smoothing: a context trusts its own counts as far as it has been
    seen, by how many different characters followed it, and the next shorter
    context for the rest. The models below ``narrow`` have only the contexts
    that some model has seen, others all.
    """
    kinds = ("yes", "no")
    session = counts.sparkSession
    each = counts.groupBy("model", "gram").agg(*[F.sum(k).alias(k) for k in kinds])

    def level(order: int) -> DataFrame:
        """Counts by model and context of ``order`` classes: an array of what follows, for yes and for no."""
        size = CLASSES ** order
        grams = each.groupBy("model", (F.col("gram") % (size * CLASSES)).alias("gram")).agg(*[F.sum(k).alias(k) for k in kinds])
        rows = grams.groupBy("model", F.floor(F.col("gram") / CLASSES).cast("int").alias("context")).agg(
            F.map_from_entries(F.collect_list(F.struct(
                (F.col("gram") % CLASSES).cast("int"), F.struct(*kinds)
            ))).alias("next")
        )
        full = session.range(models * size).select(
            F.floor(F.col("id") / size).cast("int").alias("model"), (F.col("id") % size).cast("int").alias("context")
        )
        if narrow and order == ORDER:
            some = each.select(F.floor(F.col("gram") / CLASSES).cast("int").alias("context")).distinct()
            full = full.where(F.col("model") >= narrow).unionByName(
                full.where(F.col("model") < narrow).join(some, "context", "left_semi").select("model", "context")
            )
        classes = F.sequence(F.lit(0), F.lit(CLASSES - 1))
        follows = F.transform(classes, lambda c: F.element_at("next", c))
        rows = rows.withColumn("next", follows).select("model", "context", *[
            F.transform(F.col("next")[k], lambda x: F.coalesce(x, F.lit(0.0))).alias(k) for k in kinds
        ])
        return full.join(rows, ["model", "context"], "left")  # null where the context was never seen

    def smooth(counted: Column, shorter: Column) -> Column:
        whole = F.aggregate(counted, F.lit(0.0), lambda s, x: s + x)
        followers = F.greatest(F.size(F.filter(counted, lambda x: x > 0)), F.lit(1)).cast("double")
        return let(F.struct(whole.alias("n"), followers.alias("d")), lambda w: F.zip_with(
            counted, shorter, lambda x, p: (x + w["d"] * p) / (w["n"] + w["d"])
        ))

    below = None
    for order in range(ORDER + 1):
        here = level(order)
        if below is None:
            here = here.withColumns({f"_{k}": F.array_repeat(F.lit(1.0 / CLASSES), CLASSES) for k in kinds})
        else:
            shorter = below.select(
                F.col("model").alias("_m"), F.col("context").alias("_c"), *[F.col(k).alias(f"_{k}") for k in kinds]
            )
            here = here.join(shorter, (F.col("model") == F.col("_m")) & (F.col("context") % CLASSES ** (order - 1) == F.col("_c")))
        below = here.select("model", "context", *[
            F.when(F.col(k).isNull(), F.col(f"_{k}")).otherwise(smooth(F.col(k), F.col(f"_{k}"))).alias(k) for k in kinds
        ])
    return below.select("model", "context", F.zip_with("yes", "no", lambda a, b: F.log(a / b)).alias("ratios"))


def all_models(counts: DataFrame) -> DataFrame:
    """Model, context and ratios: of the folds but ``model``, and of all folds as model ``FOLDS``."""
    others = F.array(*[F.lit(k) for k in range(FOLDS + 1)])
    return smooth_counts(counts.select(
        F.explode(F.filter(others, lambda k: k != F.col("fold"))).alias("model"), "gram", "yes", "no"
    ), FOLDS + 1, narrow=FOLDS)


def _mean_ratio(urls: DataFrame, models: DataFrame, *keys: str) -> DataFrame:
    """``urls`` with ``score`` by ``models`` (keys, context, ratios), which are broadcast.

    A row of the models is a context with the ratios of all that may follow, so
    that the driver builds a table of 32**3 rows, not of 32**4.
    """
    grams = urls.select("*", F.explode(_grams(F.col("url"))).alias("gram")).withColumn(
        "context", F.floor(F.col("gram") / CLASSES).cast("int"))
    ratio = F.get("ratios", (F.col("gram") % CLASSES).cast("int"))
    return grams.join(F.broadcast(models), [*keys, "context"]).groupBy(*urls.columns).agg(F.avg(ratio).alias("score"))


def fit_models(urls: DataFrame) -> DataFrame:
    """For each gram of four classes the log-likelihood ratio of its last: gram, ratio. ``urls`` has url and accepted."""
    counts = count_grams(urls.select("url", "accepted", F.lit(0).alias("fold")))
    return smooth_counts(counts.withColumn("model", F.lit(0)), 1).select(
        F.posexplode("ratios").alias("last", "ratio"), "context"
    ).select((F.col("context") * CLASSES + F.col("last")).alias("gram"), "ratio")


def unseen_scores(urls: DataFrame, counts: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """``urls`` (url, accepted, fold, n) with the score by the model of the other folds' counts.

    Only contexts that are counted in some fold, as all of ``urls`` are, are broadcast.
    """
    models = all_models(counts) if models is None else models
    return _mean_ratio(urls, models.where(F.col("model") < FOLDS).withColumnRenamed("model", "fold"), "fold")


def _distinct(urls: DataFrame) -> DataFrame:
    return urls.select(F.coalesce("url", F.lit("")).alias("url")).distinct()


def ratios(urls: DataFrame, models: DataFrame) -> DataFrame:
    """Distinct urls with ``score``, the mean log-likelihood ratio per character and closing border.

    ``models`` as of fit_models; a url's grams stay in the task that holds the url.
    """
    follower = F.struct((F.col("gram") % CLASSES).alias("last"), "ratio")
    rows = models.groupBy(F.floor(F.col("gram") / CLASSES).cast("int").alias("context")).agg(
        F.transform(F.array_sort(F.collect_list(follower)), lambda x: x["ratio"]).alias("ratios")
    )
    return _mean_ratio(_distinct(urls), rows)


def calibrate(scored: DataFrame) -> float:
    """Threshold on ``score`` with the largest sum of the rates of right verdicts; a row counts ``n`` times.

    Scores are counted in bins of 1/64 nat within 16 nats of zero, so the table
    of cuts is bounded. The cut nearest to zero wins a tie.
    """
    edge = F.floor(F.col("score") * BINS_PER_NAT)
    limit = WIDEST * BINS_PER_NAT
    bins = scored.groupBy(F.greatest(F.least(edge, F.lit(limit)), F.lit(-limit)).alias("bin")).agg(
        F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("yes"),
        F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("n"))).alias("no"),
    )
    upward = W.orderBy("bin").rowsBetween(0, W.unboundedFollowing)
    downward = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy("bin").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cuts = bins.select(
        (F.col("bin") / BINS_PER_NAT).alias("cut"),
        F.try_divide(F.sum("yes").over(upward), F.sum("yes").over(everything))
        + F.try_divide(F.coalesce(F.sum("no").over(downward), F.lit(0)), F.sum("no").over(everything)),
    ).toDF("cut", "gain")
    best = cuts.where("gain IS NOT NULL").agg(F.max_by("cut", F.struct("gain", -F.abs("cut"), F.col("cut"))).alias("cut")).first()
    return best["cut"] if best["cut"] is not None else 0.0


@keeping_columns("_ruled", "_key", "_url")
def filter_urls(
    pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = PRODUCTION_RULES
) -> DataFrame:
    """All input rows and columns with host, path, rule, score and verdict."""
    raw = F.col(url)
    ruled = pages.withColumns({
        "host": F.coalesce(host_of(raw), F.lit("")), "path": F.coalesce(path_of(raw), F.lit(""))
    }).withColumn("_ruled", apply_rules(F.col("host"), F.col("path"), rules))
    known = ruled.where(F.col("_ruled").isNotNull()).select(
        raw.alias("url"), (F.col("_ruled.verdict") == "allow").alias("accepted"),
        F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int").alias("fold"),
    )
    spread = known.agg(*[F.count_distinct(F.when(F.col("accepted") == kind, F.col("fold"))) for kind in (True, False)]).first()
    if min(spread) == 1:  # the models without that fold would know nothing of a kind
        known = known.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int"))
    counts = materialize(count_grams(known), "url-grams")
    models = materialize(all_models(counts), "url-models")
    whole = models.where(F.col("model") == FOLDS).select("context", "ratios")
    scores = materialize(_mean_ratio(_distinct(pages.select(raw.alias("url"))), whole), "url-scores")
    repeated = known.groupBy("url", "accepted", "fold").agg(F.count("*").alias("n"))
    threshold = calibrate(unseen_scores(repeated, counts, models))
    found = scores.select(F.col("url").alias("_url"), "score")
    return ruled.drop("score").withColumn("_key", F.coalesce(raw, F.lit(""))).join(
        found, F.col("_key") == F.col("_url"), "left"
    ).withColumns({
        "rule": F.col("_ruled.rule"),
        "verdict": F.coalesce("_ruled.verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block")),
    }).drop("_ruled", "_key", "_url")
