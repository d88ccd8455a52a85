"""Run logs, the universe to work on, and what is still to do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import values as V

FAILED = ("error", "timeout", "crash")


def _status(name: str) -> Column:
    return F.count_if(F.col("status") == name).alias(name)


def phase_health(events: DataFrame) -> DataFrame:
    """Outcome counts, pass rate, mean duration and companies per phase; start marks do not count."""
    done = events.filter(F.col("status") != "start")
    duration = F.when(F.col("duration_ms") != 0, F.col("duration_ms"))
    per = done.groupBy(F.coalesce("phase", F.lit("unknown")).alias("phase")).agg(
        F.count(F.lit(1)).alias("total"),
        *[_status(s) for s in ("ok", *FAILED)],
        F.avg(duration).alias("mean_duration_ms"),
        F.count_distinct(F.coalesce("code", F.lit(""))).alias("codes"),
    )
    return per.withColumn("pass_rate_pct", V.ratio_pct("ok", "total"))


def expert_health(events: DataFrame) -> DataFrame:
    """The same per analyst role; only finished outcomes count, durations of successes only."""
    done = events.filter(
        F.col("status").isin("ok", *FAILED) & (F.coalesce(F.col("expert_id"), F.lit("")) != "")
    )
    duration = F.when((F.col("status") == "ok") & (F.col("duration_ms") != 0), F.col("duration_ms"))
    per = done.groupBy("expert_id").agg(
        F.count(F.lit(1)).alias("total"), _status("ok"), _status("error"), F.avg(duration).alias("mean_duration_ms")
    )
    return per.withColumn("pass_rate_pct", V.ratio_pct("ok", "total"))


def recent_failures(events: DataFrame, n: int = 5) -> DataFrame:
    """The newest failed events."""
    failed = events.filter(F.col("status").isin(*FAILED))
    order = [F.col("at").desc_nulls_last(), F.col("code"), F.col("phase"), F.col("msg")]
    return failed.orderBy(*order).limit(n)


def durations(events: DataFrame, closed_at: Column | None = None, busy: int = 100_000) -> DataFrame:
    """Start marks matched with the event that ends them.

    A start takes the next event of the same code, phase and role.  One that is
    never ended is a timeout at ``closed_at`` (default: the last event of that code).

    A code may own much of the log, so its events are put in order hour by
    hour, and second by second in hours of more than ``busy`` events.  Each such
    block tells its first event; what follows the last event of a block is the
    first one of the next block of the hour, or else of the next hour that has any.
    """
    seq = F.col("seq") if "seq" in events.columns else F.lit(0)
    line = ["code", "phase", "expert_id"]
    keyed = events.filter("at is not null").select(
        "code", "phase", F.coalesce("expert_id", F.lit("")).alias("expert_id"), "status", "at", seq.alias("seq"),
        F.date_trunc("hour", "at").alias("hour"),
    )
    mark = F.struct("at", "seq", "status")
    hours = keyed.groupBy(*line, "hour").agg(F.min(mark).alias("first"), F.count("*").alias("n"))
    following = F.lead("first").over(Window.partitionBy(*line).orderBy("hour"))
    later = hours.select(*line, "hour", following.alias("later"))
    crowded = hours.where(F.col("n") > busy).select(*line, "hour", F.lit(True).alias("crowded"))
    dealt = keyed.join(crowded, [*line, "hour"], "left").withColumn(
        "block", F.when(F.col("crowded"), F.date_trunc("second", "at")).otherwise(F.col("hour")))
    inside = dealt.withColumn("after", F.lead(mark).over(Window.partitionBy(*line, "hour", "block").orderBy("at", "seq")))
    seconds = dealt.where("crowded").groupBy(*line, "hour", "block").agg(F.min(mark).alias("first"))
    soon = seconds.select(*line, "hour", "block", F.lead("first").over(Window.partitionBy(*line, "hour").orderBy("block")).alias("soon"))
    last = keyed.groupBy("code").agg(F.max("at").alias("last_at"))
    starts = inside.filter("status = 'start'").join(soon, [*line, "hour", "block"], "left").join(later, [*line, "hour"]).join(last, "code")
    ended = F.coalesce("after", "soon", "later")
    closing = F.col("last_at") if closed_at is None else closed_at
    micros = F.unix_micros(F.coalesce(F.col("ended.at"), closing)) - F.unix_micros("at")
    # a start right after a start is overwritten, not ended
    return starts.withColumn("ended", ended).filter("ended is null or ended.status <> 'start'").select(
        *line,
        F.col("at").alias("started_at"),
        F.coalesce("ended.status", F.lit("timeout")).alias("status"),
        F.round(micros / 1000).cast("bigint").alias("duration_ms"),
    )


def daily_digest(events: DataFrame) -> DataFrame:
    """Per day: finished reports, failures and the companies that failed."""
    rows = events.filter("at is not null").withColumn("day", F.date_format("at", "yyyyMMdd"))
    failed = F.col("status").isin(*FAILED)
    return rows.groupBy("day").agg(
        F.count_if((F.col("phase") == "report") & (F.col("status") == "ok")).alias("reports"),
        F.count_if(failed).alias("failures"),
        F.count_distinct(F.when(failed, F.col("code"))).alias("failed_codes"),
    )


def day_failures(events: DataFrame) -> DataFrame:
    """The failure list of every day: when, which company, in which phase, how and with what message.

    Undated events belong to no day.  A name is listed where the log has one.
    """
    name = F.col("name") if "name" in events.columns else F.lit(None).cast("string")
    return events.filter("at is not null").filter(F.col("status").isin(*FAILED)).select(
        F.date_format("at", "yyyyMMdd").alias("day"), "at", "code", name.alias("name"), "phase", "status", "msg")


def day_reports(reports: DataFrame, at: str = "modified_at", text: str = "text") -> DataFrame:
    """Every report file with its day, name, score and rating, as the first line that speaks of each says.

    A quoted value stands between the quotes, a score behind the last ``: ``; what is missing or no number is null.
    """
    def line(field: str) -> Column:
        return F.regexp_extract(text, f"(?m)^.*{field}:.*$", 0)

    def quoted(field: str) -> Column:
        return F.nullif(F.regexp_extract(line(field), ': "(.*)"', 1), F.lit(""))
    score = F.regexp_extract(line("composite_score"), "^.*: (.*)$", 1)
    return reports.select(
        F.date_format(at, "yyyyMMdd").alias("day"), "code", quoted("stock_name").alias("name"),
        score.try_cast("double").alias("score"), quoted("rating").alias("rating"))


def run_summary(events: DataFrame) -> DataFrame:
    """Companies per final outcome: the newest report event of each decides."""
    final = events.filter("phase = 'report' and at is not null").groupBy("code").agg(
        F.max(F.struct("at", "status")).alias("e")
    )
    outcome = F.when(F.col("e.status") == "ok", "succeeded").otherwise("failed")
    return final.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("companies"))


# --- universe ----------------------------------------------------------------------


def investable(stocks: DataFrame, code: str = "ts_code", name: str = "name") -> DataFrame:
    """Named companies outside the science board, the Beijing exchange and special treatment."""
    c, n = F.col(code), F.col(name)
    return stocks.filter(
        n.isNotNull() & (n != "") & ~c.startswith("688") & ~c.startswith("8") & ~n.ilike("%ST%") & ~c.ilike("%ST%")
    )


def seeded_sample(universe: DataFrame, n: int, seed: str, code: str = "ts_code") -> DataFrame:
    """The same *n* companies for the same seed, whatever the partitioning."""
    return universe.orderBy(F.sha2(F.concat(F.lit(seed), F.col(code)), 256), F.col(code)).limit(n)


def cooled_down(pool: DataFrame, last_run: DataFrame, today: Column, days: int = 5) -> DataFrame:
    """Companies not analysed within the last ``days`` days."""
    joined = pool.join(last_run, "ts_code", "left")
    age = F.datediff(today, F.col("last_analyzed"))
    return joined.filter(F.col("last_analyzed").isNull() | (age > days))


def next_in_rotation(pool: DataFrame, last_run: DataFrame, next_index: int, today: Column, days: int = 5) -> DataFrame:
    """The first company from ``next_index`` on, wrapping around, that has cooled down.

    ``pool`` carries its 0-based place in ``pos``.  Only two aggregates are
    needed: the smallest eligible place from the index on, else the smallest at all.
    """
    ready = cooled_down(pool, last_run, today, days)
    wrapped = F.col("pos") < next_index
    return ready.orderBy(wrapped, F.col("pos")).limit(1)


def item_choice(batch: Column, expert: Column, bank_size: Column) -> Column:
    """Position in an item bank, decided by the content of the batch."""
    digest = F.sha2(F.concat_ws(":", batch, expert), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), bank_size)


def pending(prepared: DataFrame, reported: DataFrame, key: str = "ts_code") -> DataFrame:
    """Companies that were prepared but have no report."""
    return prepared.select(key).distinct().join(reported.select(key).distinct(), key, "left_anti")


def missing_results(companies: DataFrame, experts: Sequence[str], results: DataFrame) -> DataFrame:
    """Role and company combinations without a result; the expected side is exploded, not cross joined."""
    expected = companies.select("ts_code", F.explode(F.array(*[F.lit(e) for e in experts])).alias("expert_id"))
    return expected.join(results.select("ts_code", "expert_id"), ["ts_code", "expert_id"], "left_anti")
