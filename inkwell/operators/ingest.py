"""From feeds to pages: candidates, what is known already, robots rules, error budgets, gates and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from .numbering import in_order

PER_FEED = 30
MIN_WORDS = 100
MAX_ERRORS = 4
PAUSE_SECONDS = 4


def candidates(entries: DataFrame, url: str = "url") -> DataFrame:
    """Entries with their clean address, if it is valid and looks like a post; each once per feed."""
    cleaned = entries.withColumn(url, U.clean(F.col(url)))
    return cleaned.where(F.col(url).isNotNull() & U.is_valid(F.col(url)) & U.is_post(F.col(url))).distinct()


def seen_urls(pages: DataFrame, skipped: DataFrame) -> DataFrame:
    """stripped_url: what is stored or was skipped, once each. Addresses that can't be cleaned are left out."""
    stored = pages.where(F.coalesce(F.col("url"), F.lit("")) != "").select(U.stripped(U.clean(F.col("url"))).alias("stripped_url"))
    both = stored.unionByName(skipped.select("stripped_url"))
    return both.where(F.coalesce(F.col("stripped_url"), F.lit("")) != "").distinct()


def _with_key(found: DataFrame) -> DataFrame:
    return found.withColumn("stripped_url", U.stripped(U.clean(F.col("url"))))


def known(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates that are known in their stripped form."""
    return _with_key(found).join(seen, "stripped_url", "left_semi").drop("stripped_url")


def new(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates that aren't."""
    return _with_key(found).join(seen, "stripped_url", "left_anti").drop("stripped_url")


def capped(found: DataFrame, group: str = "feed_url", most: int = PER_FEED) -> DataFrame:
    """At most so many addresses a group: the first in order. The limit is applied before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy("url"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def allowed(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Addresses whose path no rule (base_url, prefix) of their host forbids; the longest matching prefix decides.

    A rule has allow true or false; ties go to allow. Hosts without rules allow all.
    """
    path = F.concat(F.lit("/"), F.regexp_extract("url", r"^https?://[^/]+/(.*)$", 1))
    keyed = found.withColumn("_base", U.base(F.col("url"))).withColumn("_path", path)
    by_host = rules.where(F.col("prefix") != "").groupBy("base_url").agg(F.collect_list(F.struct("prefix", "allow")).alias("_rules")).withColumnRenamed("base_url", "_base")
    hits = F.filter("_rules", lambda r: F.col("_path").startswith(r["prefix"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r["prefix"]).alias("n"), r["allow"].alias("allow"))))
    return keyed.join(by_host, "_base", "left").where(F.coalesce(best["allow"], F.lit(True))).drop("_base", "_path", "_rules")


def within_budget(attempts: DataFrame, group: str, seq: str, failed: Column, most: int = MAX_ERRORS) -> DataFrame:
    """Attempts made before so many errors in their group; what comes after is abandoned."""
    before = Window.partitionBy(group).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    errors = F.coalesce(F.sum(failed.cast("int")).over(before), F.lit(0))
    return attempts.withColumn("errors_before", errors.cast("long")).where(F.col("errors_before") < most)


def backoff(attempts: DataFrame, group: str, seq: str, failed: Column, pause: int = PAUSE_SECONDS) -> DataFrame:
    """Adds run, the errors in a row up to here, and wait_seconds: twice the pause on top after two in a row."""
    upto = Window.partitionBy(group).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    island = attempts.withColumn("_island", F.sum((~failed).cast("int")).over(upto))
    inside = Window.partitionBy(group, "_island").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    out = island.withColumn("run", F.sum(failed.cast("int")).over(inside).cast("long")).drop("_island")
    return out.withColumn("wait_seconds", F.when(F.col("run") >= 2, 3 * pause).otherwise(pause))


def gate(extracted: DataFrame, least: int = MIN_WORDS, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(pages, skipped) of functions.html.extract's rows, with the columns keep: skipped has stripped_url and reason. Failed and empty extractions are in neither."""
    read = extracted.where(~F.col("failed"))
    few = T.word_count(F.col("text")) < least
    reason = F.when(~F.col("readable"), "not_readerable").when(F.col("text").isNotNull() & few, "too_short")
    marked = read.withColumn("reason", reason)
    skipped = marked.where(F.col("reason").isNotNull()).select(U.stripped(U.clean(F.col("page_url"))).alias("stripped_url"), "reason", *keep)
    pages = marked.where(F.col("reason").isNull() & F.col("text").isNotNull()).select("id", "title", U.clean(F.col("url")).alias("url"), "fingerprint", "date", "text", *keep)
    return pages, skipped.where(F.coalesce(F.col("stripped_url"), F.lit("")) != "")


def last_by(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).where("_n = 1").drop("_n")


def first_by(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The first row of each key; a row without key is its own."""
    whole = rows.where(F.col(key).isNull())
    ranked = rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(seq)))
    return ranked.where("_n = 1").drop("_n").unionByName(whole)


def upsert(stored: DataFrame, batch: DataFrame, key: str, seq: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """stored with batch's last row per key in place of its own; columns in keep stay as they were stored."""
    last = last_by(batch.where(F.coalesce(F.col(key), F.lit("")) != ""), key, seq).drop(seq)
    fresh = last.select(*[F.col(c).alias(f"_{c}") for c in last.columns])
    both = stored.join(fresh, stored[key] == fresh[f"_{key}"], "full_outer")
    new_row = F.col(f"_{key}").isNotNull()
    old_row = F.col(key).isNotNull()
    pick = lambda c: F.when(new_row & ~(old_row if c in keep else F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c))
    return both.select(*[(pick(c) if c in last.columns else F.col(c)).alias(c) for c in stored.columns])


def save_pages(stored: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """pages after a batch (url, title, fingerprint, date, text, seq): last row per url wins, ids stay.

    Then a row whose fingerprint another row holds is refused: a stored one comes first, else the earlier of the batch. This is exact if
    no fingerprint moves from one url to another within the batch; a refused row leaves what was stored.
    """
    last = last_by(batch.where(F.coalesce(F.col("url"), F.lit("")) != ""), "url", seq)
    taken = stored.where(F.col("fingerprint").isNotNull()).select(F.col("fingerprint").alias("_f"), F.col("url").alias("_u"))
    clash = (last["fingerprint"] == taken["_f"]) & (last["url"] != taken["_u"])
    good = first_by(last.join(taken, clash, "left_anti"), "fingerprint", seq)
    slim = good.select("url", "title", "fingerprint", "date", "text", seq)
    fresh = slim.select(*[F.col(c).alias(f"_{c}") for c in slim.columns])
    both = stored.join(fresh, stored["url"] == fresh["_url"], "full_outer")
    is_new = F.col("url").isNull()
    cols = [F.when(F.col("_url").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("title", "url", "fingerprint", "date", "text")]
    stamped = both.select("id", *cols, F.when(F.col("_url").isNotNull(), F.current_timestamp()).otherwise(F.col("scraped_on_date")).alias("scraped_on_date"), is_new.alias("_new"), F.col(f"_{seq}").alias("_seq"))
    old = stamped.where(~F.col("_new")).drop("_new", "_seq")
    return old.unionByName(number(stamped.where("_new"), stored, "_seq").select(*old.columns))


def number(rows: DataFrame, stored: DataFrame, seq: str) -> DataFrame:
    """rows with ids after the largest that is stored, in order of seq; a batch is what one run brings in."""
    top = stored.agg(F.max("id")).first()[0] or 0
    return in_order(rows.drop("id"), seq, "id", top)


def record_skipped(stored: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """skipped_urls after a batch (stripped_url, reason, seq): the last reason wins, the time of the first stays."""
    stamped = batch.select("stripped_url", "reason", F.current_timestamp().alias("created_at"), seq)
    return upsert(stored, stamped, "stripped_url", seq, keep=("created_at",))


def log_rows(requests: DataFrame, next_id: int) -> DataFrame:
    """query_logs rows of requests (query, forwarded_for, peer, user_agent, timestamp): the forwarded address, else the peer's."""
    ip = F.coalesce(F.nullif(T.strip(F.col("forwarded_for")), F.lit("")), F.col("peer"))
    rows = requests.select("query", ip.alias("ip_address"), "user_agent", "timestamp")
    return in_order(rows, "timestamp", "id", next_id - 1).select("id", "query", "ip_address", "user_agent", "timestamp")
