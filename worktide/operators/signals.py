"""Signals: typed traces with a weight, and the ledger of what was left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from worktide.functions.config import Settings


def label_map(settings: Settings, attribute: str) -> Column:
    """A literal map from source to one attribute of its label."""
    return F.create_map(*(x for l in settings.labels for x in (F.lit(l.source), F.lit(getattr(l, attribute)))))


def signals_of_events(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """owner, ts, day, minute, source, family, weight, width, active, productive, text.

    The label table is a handful of literals: a map lookup, not a join.
    """
    pick = lambda name: F.element_at(label_map(settings, name), F.col("event_type"))
    return events.select(
        F.col("user_id").alias("owner"),
        "ts",
        F.to_date("ts").alias("day"),
        (F.hour("ts") * 60 + F.minute("ts")).alias("minute"),
        F.col("event_type").alias("source"),
        pick("family").alias("family"),
        pick("weight").alias("weight"),
        pick("minutes").alias("width"),
        pick("active").alias("active"),
        pick("productive").alias("productive"),
        F.col("props").alias("text"),
    )


def is_night(minute: Column, settings: Settings = Settings()) -> Column:
    return (minute >= settings.day_window[1]) | (minute < settings.day_window[0])


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds, else null."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def strongest_of_key(signals: DataFrame, key: list[str], weight: str = "weight", tie: str = "ts") -> DataFrame:
    """One signal for each key: the heaviest, the earliest of equals. The
    aggregate combines before the shuffle; a window would move every row."""
    rest = [c for c in signals.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct((-F.col(weight)).alias("w"), F.col(tie).alias("t"), *(F.col(c).alias(f"x_{c}") for c in rest if c not in (weight, tie)))).alias("best")
    return signals.groupBy(*key).agg(best).select(*key, *(F.col("best").getField(c).alias(c) for c in rest))


def ledger(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """How many rows each reason left out; rows that stay have none."""
    return rows.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


def ingest(rows: DataFrame, key: list[str], first: str, last: str, private: Column, non_work: Column, order: str) -> tuple[DataFrame, DataFrame]:
    """One funnel for all sources: the signals that count, and the ledger of the rest.

    rows: at, source, text, weight, the columns of ``key`` and a unique ``order``. Of
    equal keys (several machines, histories) the heaviest row counts, of equals the
    first; then it must have a text, lie in the period, be not private and, but for
    files, not be about leave or the like. private and non_work name what was hit, or
    are null. The aggregate combines before the shuffle.
    """
    whole = rows.withColumns({"_no": F.coalesce(F.length(F.trim("text")) == 0, F.lit(True)) | F.col("at").isNull(), "_private": private, "_other": F.when(F.col("source") != "file", non_work)})
    rest = [c for c in whole.columns if c not in key]
    best = whole.where("not _no").groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct((-F.col("weight")).alias("w"), F.col(order).alias("o"))).alias("best"), F.count(F.lit(1)).alias("_n"))
    one = best.select(*key, *(F.col("best").getField(c).alias(c) for c in rest), "_n")
    inside = F.to_date("at").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    reason = first_reason(("period", ~inside), ("private", F.col("_private").isNotNull()), ("non-work", F.col("_other").isNotNull()))
    judged = one.withColumn("reason", reason)
    word = F.when(F.col("reason") == "private", F.col("_private")).when(F.col("reason") == "non-work", F.col("_other"))
    counts = judged.select("reason", word.alias("word"), F.lit(1).alias("n")).where("reason IS NOT NULL")
    counts = counts.union(judged.select(F.lit("duplicate").alias("reason"), F.lit(None).cast("string").alias("word"), (F.col("_n") - 1).cast("int").alias("n")).where("n > 0"))
    counts = counts.union(whole.where("_no").select(F.lit("empty"), F.lit(None).cast("string"), F.lit(1)))
    left = counts.groupBy("reason", "word").agg(F.sum("n").alias("n"))
    return judged.where("reason IS NULL").drop("reason", "_n", "_no", "_private", "_other"), left


def notices(mail: DataFrame, sender: str, notice: Column, replied: DataFrame) -> DataFrame:
    """Mail with whether it is a notice; a sender we have exchanged mail with is never one."""
    known = replied.select(sender).distinct().withColumn("_replied", F.lit(True))
    return mail.join(known, sender, "left").withColumn("notice", notice & F.col("_replied").isNull()).drop("_replied")


def simulation_outputs(files: DataFrame, keys: list[str], outputs: list[str]) -> DataFrame:
    """The groups of files that a solver wrote: nine in ten have an output's ending, and
    there are two endings at most or half of the files share their base name. files:
    keys, ext, base."""
    bases = files.groupBy(*keys, "base").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ext").isin(*outputs)).alias("out"))
    shared = F.sum(F.when(F.col("n") >= 2, F.col("n")).otherwise(0)).alias("shared")
    groups = bases.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("out").alias("out"), shared)
    kinds = files.groupBy(*keys).agg(F.count_distinct("ext").alias("kinds"))
    few = (F.col("kinds") <= 2) | (F.col("shared") * 2 >= F.col("n"))
    return groups.join(kinds, keys).where((F.col("out") * 10 >= F.col("n") * 9) & few).select(*keys, "n", "kinds")


def non_projects(names: DataFrame, name: str, overrides: DataFrame, rule: Column) -> DataFrame:
    """Names with whether they are no project: a decision once made (name,
    is_project) wins over the rule."""
    known = overrides.groupBy(F.col("name").alias(name)).agg(F.max("is_project").alias("_is"))
    return names.join(known, name, "left").withColumn("nonproject", F.coalesce(~F.col("_is"), rule)).drop("_is")


def one_way_senders(mail: DataFrame, conversation: str, sender: str, sent: Column, least: int = 5) -> DataFrame:
    """Senders of at least ``least`` messages in conversations that never got one
    from us: a semi join gives the replied senders, an anti join drops them."""
    replied = mail.where(sent).select(conversation).distinct()
    answered = mail.where(~sent).join(replied, conversation, "left_semi").select(sender).distinct()
    return mail.where(~sent).join(answered, sender, "left_anti").groupBy(sender).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def exclude(rows: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(excluded, keys, "left_anti")


def history_upsert(old: DataFrame, new: DataFrame, key: list[str], at: str, newest: Column, retention_days: int = Settings().retention_days, cap_key: list[str] | None = None, cap: int = 40) -> DataFrame:
    """Union of two snapshots: the new row wins, old rows expire, and at most
    ``cap`` rows of a cap key stay (by key order)."""
    both = old.withColumn("_run", F.lit(0)).unionByName(new.withColumn("_run", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in key]
    kept = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("_run", *(F.col(c).alias(f"x_{c}") for c in rest if c != "_run"))).alias("row"))
    kept = kept.select(*key, *(F.col("row").getField(c).alias(c) for c in rest)).where(F.col(at) >= newest - F.expr(f"INTERVAL {retention_days} DAYS"))
    if cap_key:
        kept = kept.withColumn("_n", F.row_number().over(W.partitionBy(*cap_key).orderBy(*key))).where(F.col("_n") <= cap).drop("_n")
    return kept.drop("_run")


