"""Usage, quality and latency reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careline.functions import segments as S
from careline.functions.core import any_of, nz, total
from careline.functions.lexicon import any_keyword, keyword_count
from careline.rules import care


# ---- usage ------------------------------------------------------------------------

def usage_summary(turns: DataFrame, user: str = "conv_id", role: str = "role") -> DataFrame:
    return turns.agg(
        F.countDistinct(user).alias("n_users"),
        F.count_if(F.col(role) == "user").alias("n_user_turns"),
        F.count("*").alias("n_messages"))


def log_period(logs: DataFrame, local_time: Column) -> DataFrame:
    day = F.date_format(local_time, "yyyy-MM-dd")
    return logs.agg(F.count("*").alias("n_turns"), F.min(day).alias("first_day"),
                    F.max(day).alias("last_day"))


def top_users(df: DataFrame, user: str, n: int = 10) -> DataFrame:
    return df.groupBy(user).agg(F.count("*").alias("n_turns")).orderBy(
        F.col("n_turns").desc(), user).limit(n)


def distribution(df: DataFrame, value: str, digits: int = 1) -> DataFrame:
    """Count and share of each non-empty value. Shares come from the grouped counts."""
    # The test for empty values is an aggregate: as a filter it would be pushed below the
    # projection and compute an expensive value (an intent, a risk level) a second time.
    counts = df.groupBy(value).agg(F.count_if(nz(value) != "").alias("n")).filter("n > 0")
    whole = counts.agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(whole)).select(
        value, "n", F.round(F.col("n") / F.col("_all") * 100, digits).alias("percent"))


def flag_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags])


def store_stats(df: DataFrame, session: str, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct(session) if approximate else F.countDistinct(session)
    return df.agg(F.count("*").alias("n_rows"), distinct.alias("n_sessions"))


def dataset_stats(samples: DataFrame, messages: str = "messages") -> DataFrame:
    """Samples by number of turns (without the system message) and estimated tokens."""
    turns = F.size(F.filter(messages, lambda m: m["role"] != "system"))
    chars = F.aggregate(F.transform(messages, lambda m: F.length(m["content"])),
                        F.lit(0), lambda a, x: a + x)
    return samples.groupBy(turns.alias("n_turns")).agg(
        F.count("*").alias("n_samples"),
        (F.sum(chars) * care.TOKENS_PER_CHAR).alias("est_tokens"))


def file_stats(conversations: DataFrame, file: str, n_turns: str = "n_turns") -> DataFrame:
    return conversations.groupBy(file).agg(
        F.count("*").alias("total"), F.count_if(F.col(n_turns) > 2).alias("multi"),
        F.count_if(F.col(n_turns) == 2).alias("single"))


# ---- detection quality -------------------------------------------------------------

def _scores(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    scored = counts.withColumn("precision", p).withColumn("recall", r)
    both = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", F.when(
        both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))


def _by_type_and_all(rows: DataFrame, kind: str) -> DataFrame:
    """Sums of tp, fp, fn per type; the null type holds the micro total."""
    return _scores(rows.rollup(kind).agg(
        *[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")]))


def prf_by_type(gold: DataFrame, found: DataFrame, case: str = "case_id", kind: str = "pii_type",
                span: str = "span", text: str = "text", start: str = "start") -> DataFrame:
    """Precision, recall and F1 per type with a micro total.

    A gold span counts as found if some detection of its case and type contains it or is
    contained in it; the first such detection is then used up. Detections that no gold
    span chose are false positives.
    """
    g = gold.select(case, kind, span).withColumn("_gid", F.monotonically_increasing_id())
    d = found.select(case, kind, text, start)
    met = F.contains(F.col(text), F.col(span)) | F.contains(F.col(span), F.col(text))
    chosen = g.join(d, [case, kind]).filter(met).groupBy("_gid", case, kind).agg(
        F.min(start).alias(start))
    golds = gold.groupBy(case, kind).agg(F.count("*").alias("g"))
    hits = chosen.groupBy(case, kind).agg(
        F.count("*").alias("h"), F.countDistinct(start).alias("u"))
    dets = d.groupBy(case, kind).agg(F.count("*").alias("d"))
    rows = golds.join(dets, [case, kind], "full").join(hits, [case, kind], "left")

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    return _by_type_and_all(rows.select(
        kind, zero("h").alias("tp"), (zero("d") - zero("u")).alias("fp"),
        (zero("g") - zero("h")).alias("fn")), kind)


def set_prf(expected: DataFrame, detected: DataFrame, case: str = "case_id",
            kind: str = "category") -> DataFrame:
    """Precision, recall and F1 of category sets per case."""
    e = expected.select(case, kind).distinct().withColumn("e", F.lit(1))
    d = detected.select(case, kind).distinct().withColumn("d", F.lit(1))
    has = e.join(d, [case, kind], "full")

    def flag(c: Column) -> Column:
        return c.cast("int")

    e_, d_ = F.col("e").isNotNull(), F.col("d").isNotNull()
    return _by_type_and_all(has.select(
        kind, flag(e_ & d_).alias("tp"), flag(~e_ & d_).alias("fp"), flag(e_ & ~d_).alias("fn")),
        kind)


def level_accuracy(df: DataFrame, actual_rank: Column, expected_rank: Column,
                   latency: Column | None = None) -> DataFrame:
    extra = [] if latency is None else [F.avg(latency).alias("avg_latency_ms")]
    return df.agg(F.count("*").alias("n_cases"),
                  F.avg((actual_rank >= expected_rank).cast("int")).alias("level_accuracy"),
                  *extra)


def preservation_rate(df: DataFrame, required: Column, redacted: Column) -> DataFrame:
    """Share of required terms that are still in the redacted text (1 if none is asked)."""
    kept = F.size(F.filter(required, lambda t: F.contains(redacted, t)))
    return df.agg(F.sum(F.size(required)).alias("n_required"), F.sum(kept).alias("n_kept")
                  ).withColumn("rate", F.when(
                      F.col("n_required") > 0, F.col("n_kept") / F.col("n_required")
                  ).otherwise(F.lit(1.0)))


# ---- response quality --------------------------------------------------------------

def response_scores(response: Column, intent: Column, empathy: Sequence[str] | None = None,
                    advice: Sequence[str] | None = None,
                    endings: Sequence[str] | None = None) -> dict[str, Column]:
    """Heuristic scores of a response; ``emergency_119`` only exists for emergencies."""
    r = nz(response)
    tail = F.regexp_replace(r, r"(?U)\s+\z", "")

    def ends(suffixes: Sequence[str]) -> Column:
        return any_of([F.endswith(tail, F.lit(s)) for s in suffixes])

    def score(cond: Column, yes: float, no: float) -> Column:
        return F.when(cond, F.lit(yes)).otherwise(F.lit(no))

    n = F.length(r)
    marks = any_of([r.rlike(p) for p in (care.LIST_PATTERN, care.BOLD_PATTERN,
                                         care.NUMBERED_PATTERN)])
    hits = keyword_count(r, advice or care.ADVICE_WORDS)
    return {
        "length": F.when((n >= 20) & (n <= 300), 1.0).when(n < 20, 0.3).otherwise(0.7),
        "honorific": score(ends(endings or care.HONORIFIC_ENDINGS), 1.0, 0.5),
        "empathy": score(any_keyword(r, empathy or care.EMPATHY_WORDS), 1.0, 0.0),
        "no_list": score(marks, 0.0, 1.0),
        "no_forbidden": score(any_keyword(r, care.FORBIDDEN_PHRASES), 0.0, 1.0),
        "emergency_119": F.when(intent == "emergency", score(F.contains(r, F.lit("119")), 1.0, 0.0)),
        "privacy": score(any_keyword(r, care.INVASIVE_PHRASES), 0.0, 1.0),
        "specific_advice": F.least(F.lit(1.0), hits / 3.0),
        "natural_ending": score(ends(care.SOFT_ENDINGS), 1.0, 0.5),
    }


def with_quality(df: DataFrame, response: Column, intent: Column, **packs) -> DataFrame:
    """Adds the scores and their mean over the scores present."""
    scored = df.select("*", *[c.alias(k) for k, c in response_scores(response, intent,
                                                                      **packs).items()])
    names = list(response_scores(response, intent, **packs))
    present = total([F.col(n).isNotNull().cast("int") for n in names])
    added = total([F.coalesce(F.col(n), F.lit(0.0)) for n in names])
    return scored.withColumn("quality", added / present)


def winner(base: Column, other: Column, margin: float) -> Column:
    return F.when(other > base + margin, "ft").when(base > other + margin, "base").otherwise("tie")


def compare_models(trials: DataFrame, base: str, other: str, margin: float,
                   keys: Sequence[str] = (), digits: int = 6,
                   latencies: tuple[str, str] | None = None) -> DataFrame:
    """Means, sample deviations and wins of two score columns, overall or per key.

    Per key the winner is judged by the means."""
    w = winner(F.col(base), F.col(other), margin)
    aggs = [
        F.count("*").alias("n"),
        F.round(F.avg(base), digits).alias("base_mean"),
        F.round(F.coalesce(F.stddev_samp(base), F.lit(0.0)), digits).alias("base_sd"),
        F.round(F.avg(other), digits).alias("ft_mean"),
        F.round(F.coalesce(F.stddev_samp(other), F.lit(0.0)), digits).alias("ft_sd"),
        F.count_if(w == "base").alias("base_wins"), F.count_if(w == "ft").alias("ft_wins"),
        F.count_if(w == "tie").alias("ties")]
    if latencies:
        aggs += [F.round(F.avg(latencies[0]), digits).alias("base_latency"),
                 F.round(F.avg(latencies[1]), digits).alias("ft_latency")]
    grouped = trials.groupBy(*keys).agg(*aggs) if keys else trials.agg(*aggs)
    return grouped.withColumn("winner", winner(F.col("base_mean"), F.col("ft_mean"), margin))


def by_criterion(trials: DataFrame, base: str, other: str, digits: int = 6) -> DataFrame:
    """Mean of each entry of two score maps and their difference; a criterion must occur
    on both sides."""
    def long(name: str, side: int) -> DataFrame:
        return trials.select(F.explode(name).alias("criterion", "v"), F.lit(side).alias("s"))

    rows = long(base, 0).unionByName(long(other, 1)).filter("v is not null")
    return rows.groupBy("criterion").agg(
        F.avg(F.when(F.col("s") == 0, F.col("v"))).alias("b"),
        F.avg(F.when(F.col("s") == 1, F.col("v"))).alias("f"),
    ).filter("b is not null and f is not null").select(
        "criterion", F.round("b", digits).alias("base_mean"),
        F.round("f", digits).alias("ft_mean"), F.round(F.col("f") - F.col("b"), digits)
        .alias("diff"))


# ---- latency ----------------------------------------------------------------------

def latency_stats(df: DataFrame, keys: Sequence[str], value: str,
                  percentiles: Sequence[int] = (50, 95), digits: int = 6,
                  buckets: int | None = None, bucket_rows: int = 65_536) -> DataFrame:
    """Count, nearest-rank percentiles, maximum and mean per group, exact.

    The rank is ``p (n - 1) / 100`` rounded half to even. Equal values are counted first;
    the counts then run up inside value ranges of about equal size, so a group of any
    size is spread over tasks. There are as many ranges as the largest group, which is counted
    first, has times ``bucket_rows``.
    """
    rows = df.filter(F.col(value).isNotNull())
    if buckets is None:
        largest = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        buckets = max(2, -(-largest // bucket_rows))
    edges = [i / buckets for i in range(1, buckets)]
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max(value).alias("max"), F.avg(value).alias("avg"),
        F.percentile_approx(value, edges, max(1000, 10 * buckets)).alias("_edges"))
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    placed = counted.join(base.select(*keys, "n", "_edges"), list(keys)).withColumn(
        "_b", F.size(F.filter("_edges", lambda e: e < F.col(value))).cast("long")).drop("_edges")
    up = S.running(placed, keys, [value], {"_cum": ("sum", F.col("_c"))}, F.col("_b"))
    picks = []
    for p in percentiles:
        rank = F.bround(F.lit(p / 100.0) * (F.col("n") - 1), 0)
        inside = (F.col("_cum") - F.col("_c") <= rank) & (rank < F.col("_cum"))
        picks.append(F.max(F.when(inside, F.col(value))).alias(f"p{p}"))
    picked = up.groupBy(*keys).agg(*picks)
    return base.drop("_edges").join(picked, list(keys)).select(
        *keys, "n", *[f"p{p}" for p in percentiles], "max",
        F.round("avg", digits).alias("avg"))


def error_kinds(df: DataFrame, error: str = "error") -> DataFrame:
    return df.filter(F.col(error).isNotNull()).groupBy(
        F.substring_index(error, ":", 1).alias("kind")).agg(F.count("*").alias("n"))


def throughput(df: DataFrame, wall_seconds: Column, error: str = "error",
               digits: int = 6) -> DataFrame:
    ok = F.count_if(F.col(error).isNull())
    return df.agg(ok.alias("ok_turns"), F.count_if(F.col(error).isNotNull()).alias("failed_turns"),
                  F.round(ok / wall_seconds, digits).alias("turns_per_second"))


def generation_metrics(df: DataFrame, generated: Column, expected: Column,
                       words: Sequence[str] = tuple(care.MODEL_WORDS),
                       digits: int = 6) -> DataFrame:
    return df.agg(
        F.count("*").alias("num_samples"),
        F.round(F.avg(F.length(generated)), digits).alias("avg_generated_length"),
        F.round(F.avg(F.length(expected)), digits).alias("avg_expected_length"),
        F.round(F.avg(any_keyword(F.lower(generated), words).cast("int")), digits)
        .alias("keyword_match_rate"))
