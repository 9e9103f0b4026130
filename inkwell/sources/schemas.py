"""The tables, declared; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


_text, _long, _day, _time = T.StringType(), T.LongType(), T.DateType(), T.TimestampType()

PAGES = _struct(id=_long, title=_text, url=_text, fingerprint=_text, date=_day, text=_text, scraped_on_date=_time)
SKIPPED_URLS = _struct(stripped_url=_text, reason=_text, created_at=_time)
FEEDS = _struct(feed_url=_text, last_check_date=_day, is_active=T.BooleanType(), date_added=_time)
DOMAINS = _struct(domain=_text, scrape_error_count=T.IntegerType(), next_allowed_scrape=_time)
QUERY_LOGS = _struct(id=_long, query=_text, ip_address=_text, user_agent=_text, timestamp=_time)
MESSAGE = _struct(urls=T.ArrayType(_text))
INDEX_DOCUMENT = _struct(id=_text, title=_text, url=_text, text=_text, date=_day, scraped_on_date=_text, original_url=_text)
RESPONSE = "struct<results:array<struct<title:string,url:string,date:date,text:string>>,total:bigint,page:int,total_pages:int>"

TABLES = {"pages": PAGES, "skipped_urls": SKIPPED_URLS, "feeds": FEEDS, "domains": DOMAINS, "query_logs": QUERY_LOGS}


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Makes what is missing; running it again changes nothing."""
    for name, schema in TABLES.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
