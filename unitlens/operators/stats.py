"""Counts over a store or a pass. Each table is read once; the results are single rows or one row per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitlens import fixed_values as fv
from unitlens.criteria import FallbackCriteria

COVERAGE_FIELDS = tuple(fv.COVERAGE_CONSEQUENCES)


def multi_source_units(sightings: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """Units carried by more than one source. (unit, source) is made distinct first, which spreads a hot unit."""
    return sightings.select(key, "source").distinct().groupBy(key).agg(F.count("*").alias("n_sources")).where("n_sources > 1")


def store_stats(units: DataFrame, sightings: DataFrame, history: DataFrame, alerts: DataFrame, runs: DataFrame) -> DataFrame:
    """The eight counts of a store as one row."""
    def named(df: DataFrame, **counts: Column) -> DataFrame:
        one = df.agg(*[c.alias(n) for n, c in counts.items()])
        return one.select(F.explode(F.map_from_arrays(
            F.array(*[F.lit(n) for n in counts]), F.array(*[F.col(n) for n in counts]))).alias("stat", "n"))

    active = F.col("is_active")
    long = (
        named(units, listings_total=F.count("*"), listings_active=F.count_if(active),
              listings_matched=F.count_if(active & F.col("matched")))
        .unionByName(named(sightings, sightings=F.count("*")))
        .unionByName(named(multi_source_units(sightings), multi_portal_units=F.count("*")))
        .unionByName(named(history, price_changes=F.count("old_price")))
        .unionByName(named(alerts, alerts_sent=F.count_if(F.col("ok"))))
        .unionByName(named(runs, runs=F.count("*"))))
    names = ("listings_total", "listings_active", "listings_matched", "sightings", "multi_portal_units", "price_changes",
             "alerts_sent", "runs")
    return long.agg(*[F.max(F.when(F.col("stat") == n, F.col("n"))).alias(n) for n in names])


def rejection_histogram(verdicts: DataFrame) -> DataFrame:
    """How often each constraint failed; a row may fail several."""
    names = F.btrim(F.split_part(F.col("failure"), F.lit(":"), F.lit(1)))
    return verdicts.select(F.explode("failures").alias("failure")).groupBy(names.alias("reason")).agg(F.count("*").alias("n"))


def top_rejections(verdicts: DataFrame, limit: int = 8) -> DataFrame:
    return rejection_histogram(verdicts).orderBy(F.desc("n"), "reason").limit(limit)


def pass_totals(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count("*").alias("evaluated"), F.count_if(F.col("passed")).alias("passed"))


def top_matches(units: DataFrame, limit: int = 100, tie: tuple = ("dedupe_key",)) -> DataFrame:
    """Current matches, best first."""
    return units.where("matched and is_active").orderBy(F.desc("match_score"), F.desc("last_seen_at"), *tie).limit(limit)


def first_per_source(df: DataFrame, n: int, order: str = "ingest_seq") -> DataFrame:
    """The first n rows of every source. The rank limit is applied before the shuffle, so a source holding most
    rows sends only n per task."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(order))
    return df.withColumn("rank_in_source", rank).where(F.col("rank_in_source") <= n)


def detail_budget(candidates: DataFrame, budget: int = 40) -> DataFrame:
    """Per source: how many candidates lie beyond the detail budget."""
    per = candidates.groupBy("source").agg(F.count("*").alias("candidates"))
    return per.where(F.col("candidates") > budget).select("source", (F.col("candidates") - budget).alias("not_detailed"))


def source_coverage(rows: DataFrame, sample: int | None = None, order: str = "ingest_seq") -> DataFrame:
    """How many rows of each source carry each critical field; of all rows when ``sample`` is None."""
    seen = first_per_source(rows, sample, order) if sample else rows
    kinds = dict(rows.dtypes)

    def populated(name: str) -> Column:
        if name == "description" and "has_prose" in kinds:
            return F.col("has_prose")
        blank = F.lit("") if kinds[name] == "string" else F.lit(0)
        return F.col(name).isNotNull() & (F.col(name) != blank)

    return seen.groupBy("source").agg(
        F.count("*").alias("sampled"), *[F.count_if(populated(f)).alias(f) for f in COVERAGE_FIELDS])


def coverage_gaps(coverage: DataFrame) -> DataFrame:
    """Fields a source never carries, and what that means."""
    long = coverage.unpivot("source", list(COVERAGE_FIELDS), "field", "n").where("n = 0")
    meaning = F.coalesce(*[F.when(F.col("field") == k, F.lit(v)) for k, v in fv.COVERAGE_CONSEQUENCES.items()])
    return long.select("source", "field", meaning.alias("consequence"))


def staleness(health: DataFrame, criteria: FallbackCriteria | None = None) -> DataFrame:
    """One row: whether the primary sources are too unhealthy or too thin, and why.

    ``health`` has one row per source: source, records, ok, skipped.
    """
    c = criteria or FallbackCriteria()
    tried = ~F.col("skipped")
    failed = tried & ~F.col("ok")
    totals = health.agg(
        F.count_if(tried).alias("attempted"), F.count_if(failed).alias("failed"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
        F.array_join(F.array_sort(F.collect_list(F.when(failed, F.col("source")))), ", ").alias("names"))
    n, bad, rows = F.col("attempted"), F.col("failed"), F.col("records")
    reason = (
        F.when(F.lit(c.always), "always_run_scraper is enabled")
        .when(n == 0, "no primary source was configured")
        .when(bad / n >= c.error_ratio, F.concat(
            bad.cast("string"), F.lit("/"), n.cast("string"), F.lit(" primary sources failed ("), F.col("names"), F.lit(")")))
        .when(rows < c.min_results, F.concat(
            F.lit("only "), rows.cast("string"), F.lit(f" candidates from primary APIs (expected at least {c.min_results})")))
        .otherwise(""))
    return totals.select("attempted", "failed", "records", reason.alias("reason")).withColumn("use_fallback", F.col("reason") != "")


def skipped_sources(spark: SparkSession, health: DataFrame, configured) -> DataFrame:
    """Health rows of the configured sources that were not tried."""
    names = spark.createDataFrame([(n,) for n in configured], "source string")
    return names.join(health.select("source"), "source", "left_anti").select(
        "source", F.lit(0).cast("long").alias("records"), F.lit(True).alias("ok"), F.lit(True).alias("skipped"))


def with_fallback(primary: DataFrame, fallback: DataFrame, health: DataFrame, criteria: FallbackCriteria | None = None) -> DataFrame:
    """The sightings of a pass: the primary sources' and, where their health says so, the fallback's. The decision is
    one row, joined to the fallback's rows; it does not come to the driver."""
    decision = staleness(health, criteria).select(F.lit(1).alias("__on"), "use_fallback").where("use_fallback")
    used = fallback.withColumn("__on", F.lit(1)).join(decision.select("__on"), "__on", "left_semi").drop("__on")
    return primary.unionByName(used, allowMissingColumns=True)


def health_json(health: DataFrame, errors: DataFrame) -> DataFrame:
    """Per-source health as one JSON text: count, ok and the first three errors. ``errors``: source, seq, error."""
    first = first_per_source(errors, 3, "seq").groupBy("source").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "error"))), lambda e: e["error"]).alias("errors"))
    none = F.array().cast("array<string>")
    entry = F.struct("source", F.struct(F.col("records").alias("count"), "ok", F.coalesce("errors", none).alias("errors")).alias("h"))
    return health.join(first, "source", "left").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("source_health"))


def run_summary(fetched: DataFrame, verdicts: DataFrame, changes: DataFrame, alerts: DataFrame) -> DataFrame:
    """The counts of one pass as a row."""
    ok = F.col("passed")
    long = [
        fetched.agg(F.count("*").alias("n")).select(F.lit("fetched").alias("k"), "n"),
        verdicts.agg(F.count("*").alias("n")).select(F.lit("deduped").alias("k"), "n"),
        changes.agg(F.count_if(ok & F.col("seen")).alias("n")).select(F.lit("matched").alias("k"), "n"),
        changes.agg(F.count_if(ok & F.col("is_new")).alias("n")).select(F.lit("new_listings").alias("k"), "n"),
        changes.agg(F.count_if(ok & F.col("price_drop")).alias("n")).select(F.lit("price_drops").alias("k"), "n"),
        alerts.agg(F.count("*").alias("n")).select(F.lit("alerts_sent").alias("k"), "n"),
    ]
    out = long[0]
    for part in long[1:]:
        out = out.unionByName(part)
    names = ("fetched", "deduped", "matched", "new_listings", "price_drops", "alerts_sent")
    return out.agg(*[F.max(F.when(F.col("k") == n, F.col("n"))).alias(n) for n in names])
