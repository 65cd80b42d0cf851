"""Mixing sources to target shares of all tokens.

Tokens are added up per source; the total is the greatest for which no source needs more than its documents times their
permitted repetitions, so every source that has documents reaches its share. A source's rate is its part of the total over
its tokens. A document comes out floor(rate) times, and once more if its hash-seeded number u in [0, 1) lies below the
fraction: a Bernoulli draw that is the same on every run and at every partitioning. As documents differ in length, that hits
the share on average, the closer the more documents a source has; what is reached is in the report.

With calibrated=True the threshold for u is not the fraction itself: per source the tokens are added up in BINS bins of u, and
the threshold is where the running sum reaches fraction x tokens. It tends to the fraction as documents become many, and misses
the target by about one document instead of by chance.

Sources without documents cannot reach their share; the others then share the total in proportion. Sources without a target,
and documents without tokens, are not used. All are in the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import small_side

BINS = 1024
SEED = "mix-1"


def seeded(key: str, seed: str = SEED) -> Column:
    """u in [0, 1) from 52 bits of a hash of seed and key: the same on every run and at every partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def _tokens(docs: DataFrame, seed: str) -> DataFrame:
    sized = docs.withColumn("n_tokens", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    return sized.filter((F.col("n_tokens") > 0) & F.col("source").isNotNull()).withColumn("__u", seeded("doc_id", seed))


def mix_plan(docs: DataFrame, targets: DataFrame, seed: str = SEED, calibrated: bool = False) -> DataFrame:
    """(source, target_share, max_repeats, available, rate, copies, threshold), a row per target; shares or repeats not above
    0 give rate 0. Tokens are combined per source, or to BINS sums per source, before anything else; only these meet the
    targets, whose rows are counted before they are broadcast."""
    of = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    of = small_side(of.filter(F.col("source").isNotNull()), "mix-targets")
    bin_no = F.floor(F.col("__u") * BINS) if calibrated else F.lit(0).cast("bigint")
    binned = _tokens(docs, seed).groupBy("source", bin_no.alias("bin")).agg(F.sum("n_tokens").alias("in_bin"))
    binned = small_side(binned.join(of.select("source"), "source", "left_semi"), "mix-bins")
    sums = of.join(binned.groupBy("source").agg(F.sum("in_bin").alias("available")), "source", "left")
    usable = (F.col("target_share") > 0) & (F.col("max_repeats") > 0) & (F.col("available") > 0)
    most = F.when(usable, F.col("available") * F.col("max_repeats") / F.col("target_share"))
    total = F.lit(sums.agg(F.min(most)).first()[0]).cast("double")  # one number
    rate = F.when(usable, F.least(F.round(F.col("target_share") * total / F.col("available"), 12), F.col("max_repeats").cast("double")))
    rates = sums.withColumn("rate", F.coalesce(rate, F.lit(0.0))).withColumn("copies", F.floor("rate").cast("int"))
    columns = ["source", "target_share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available"), "rate", "copies"]
    if not calibrated:
        return rates.select(*columns, (F.col("rate") - F.col("copies")).alias("threshold"))
    rates = rates.withColumn("wanted", (F.col("rate") - F.col("copies")) * F.col("available"))
    upto = F.sum("in_bin").over(Window.partitionBy("source").orderBy("bin"))
    running = binned.withColumn("upto", upto).join(rates.select("source", "wanted"), "source")
    hit = (F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("in_bin") < F.col("wanted"))
    place = (F.col("bin") + (F.col("wanted") - (F.col("upto") - F.col("in_bin"))) / F.col("in_bin")) / BINS
    thresholds = running.filter(hit).groupBy("source").agg(F.max(place).alias("threshold"))
    return rates.join(thresholds, "source", "left").select(*columns, F.coalesce("threshold", F.lit(0.0)).alias("threshold"))


def _used(docs: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """docs with n_tokens and __n, how often each is used, of those that are."""
    named = plan.select(F.col("source").alias("__source"), F.col("copies").alias("__copies"), F.col("threshold").alias("__threshold"))
    used = _tokens(docs, seed).join(named, F.col("source") == F.col("__source"))
    n = F.col("__copies") + F.when(F.col("__u") < F.col("__threshold"), 1).otherwise(0)
    return used.withColumn("__n", n).filter("__n > 0").drop("__source", "__u", "__copies", "__threshold")


def mix(docs: DataFrame, targets: DataFrame, seed: str = SEED, calibrated: bool = False) -> DataFrame:
    """The columns of docs with n_tokens and copy_no (from 1; both replace columns so named): a row for every use of a document."""
    used = _used(docs, small_side(mix_plan(docs, targets, seed, calibrated), "mix-plan"), seed)
    return used.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")


def share_report(docs: DataFrame, targets: DataFrame, seed: str = SEED, calibrated: bool = False) -> DataFrame:
    """Per source, with or without target or documents: what was aimed at and what was reached."""
    plan = small_side(mix_plan(docs, targets, seed, calibrated), "mix-plan")
    used = _used(docs.select("doc_id", "source", "text"), plan, seed)
    reached = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("__n")).alias("used"), F.sum(F.col("__n").cast("bigint")).alias("uses"))
    all_tokens = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")).alias("tokens"))
    joined = all_tokens.filter(F.col("source").isNotNull()).join(plan, "source", "full").join(reached, "source", "left")
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0).cast(kind)).alias(c)
    filled = joined.select("source", zero("target_share", "double"), zero("max_repeats", "int"), zero("tokens", "bigint"), zero("rate", "double"), zero("uses", "bigint"), zero("used", "bigint"))
    whole = F.lit(reached.agg(F.sum("used")).first()[0]).cast("double")  # one number
    return filled.withColumn("actual_share", F.round(F.coalesce(F.col("used") / F.when(whole > 0, whole), F.lit(0.0)), 9))


def properties(docs: DataFrame, targets: DataFrame, seed: str = SEED, deviations: float = 4.0) -> DataFrame:
    """Per target whether no document (a row; rows that repeat are documents of their own) is used more often than permitted, and the tokens used lie within `deviations` standard
    deviations of rate x tokens, as independent draws would."""
    plan = small_side(mix_plan(docs, targets, seed), "mix-plan")
    sized = _tokens(docs.select("doc_id", "source", "text"), seed).groupBy("source").agg(F.sum("n_tokens").alias("all_tokens"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("squares"))
    uses = mix(docs.select("doc_id", "source", "text"), targets, seed)
    used = uses.groupBy("source").agg(F.sum("n_tokens").alias("used"), F.max("copy_no").alias("most"))
    joined = plan.join(sized, "source", "left").join(used, "source", "left")
    fraction = F.col("rate") - F.col("copies")
    spread = deviations * F.sqrt(fraction * (1 - fraction) * F.coalesce("squares", F.lit(0)))
    missed = F.abs(F.coalesce("used", F.lit(0)) - F.col("rate") * F.coalesce("all_tokens", F.lit(0)))
    return joined.select("source", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), (missed <= spread + 1).alias("near_target"))
