"""The SQL surface: views with the published policy, and functions that answer a question, give a page, or a pace.

The functions read a table of payloads (slug, bib, dob, payload), whose files are sorted by slug and bib, so that a
question or a page is a small part of each; a filter on both reaches the scan, and a page is taken as the first rows in
order. They run with the rights of who registers them: the private table has a view of its own, and nothing else shows
it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemark.operators.publishing import public_events, public_races

PRIVATE = "stridemark_private_galleries"
#: Reasons of refusals, roles that see only events that are searched, and sizes of pages.
PLAIN_FUNCTIONS = """
CREATE OR REPLACE TEMPORARY FUNCTION runner_clock(seconds BIGINT) RETURNS STRING
RETURN format_string('%d:%02d:%02d', seconds div 3600, seconds div 60 % 60, seconds % 60);

CREATE OR REPLACE TEMPORARY FUNCTION runner_pace(seconds BIGINT, km DOUBLE) RETURNS STRING
RETURN CASE WHEN seconds IS NOT NULL AND km IS NOT NULL AND km <> 0
  THEN format_string('%d:%02d', CAST(round(seconds / km) AS BIGINT) div 60 % 60, CAST(round(seconds / km) AS BIGINT) % 60) END
"""
FUNCTIONS = f"""
CREATE OR REPLACE TEMPORARY FUNCTION runner_refusal(reason STRING) RETURNS STRING
RETURN to_json(named_struct('ok', false, 'reason', reason));

CREATE OR REPLACE TEMPORARY FUNCTION find_runner(event STRING, number STRING, born DATE DEFAULT NULL, caller STRING DEFAULT NULL) RETURNS STRING
RETURN coalesce(
  CASE WHEN regexp_replace(coalesce(number, ''), '[^0-9]', '') = '' THEN runner_refusal('missing_input') END,
  CASE WHEN coalesce((SELECT max(CASE WHEN db_search THEN 2 ELSE 1 END) FROM public_events WHERE slug = event), 0)
    < CASE WHEN coalesce(caller, '') IN ('anon', 'authenticated') THEN 2 ELSE 1 END THEN runner_refusal('no_event') END,
  CASE WHEN born IS NOT NULL AND NOT born <=> (SELECT max(dob) FROM {PRIVATE} WHERE slug = event AND bib = regexp_replace(coalesce(number, ''), '[^0-9]', ''))
    AND (SELECT count(*) FROM {PRIVATE} WHERE slug = event AND bib = regexp_replace(coalesce(number, ''), '[^0-9]', '')) > 0 THEN runner_refusal('dob_mismatch') END,
  (SELECT max(payload) FROM {PRIVATE} WHERE slug = event AND bib = regexp_replace(coalesce(number, ''), '[^0-9]', '')),
  runner_refusal('no_bib'));

CREATE OR REPLACE TEMPORARY FUNCTION export_event(event STRING, after STRING DEFAULT '', most INT DEFAULT 500) RETURNS TABLE (bib STRING, payload STRING)
RETURN SELECT bib, payload FROM (
  SELECT bib, payload, row_number() OVER (ORDER BY bib) AS place FROM {PRIVATE} WHERE slug = event AND bib > after) WHERE place <= most
"""


def write_galleries_table(payloads: DataFrame, events: DataFrame, runners: DataFrame, folder: str, block_bytes: int = 16 << 20, block_rows: int = 64) -> None:
    """Keep the payloads (event_id, bib, payload) of published events as the functions read them.

    Payloads are long, so they are sorted where they are made and dealt out no more: each file has the bibs in order, by
    which a page reads a few of its pages, and filters of its bibs, by which a question reads one row group of all.
    Readers keep up to 4,096 rows of a row group at once, which for payloads is hundreds of MB, and the size of a row group is
    counted as it is compressed: so row groups have few rows, and filters as small as those, since a writer keeps all of a file's.
    """
    born = runners.select("event_id", "bib", "dob")
    rows = payloads.join(public_events(events).select("event_id", "slug"), "event_id").join(born, ["event_id", "bib"], "left")
    options = {"compression": "zstd", "parquet.block.size": block_bytes, "parquet.block.row.count.limit": block_rows, "parquet.page.size.row.check.min": 8, "parquet.bloom.filter.enabled#bib": "true", "parquet.bloom.filter.expected.ndv#bib": block_rows}
    rows.select("slug", "bib", "dob", "payload").sortWithinPartitions("slug", "bib").write.mode("overwrite").options(**options).parquet(folder)


def register_views(spark: SparkSession, events: DataFrame, races: DataFrame) -> None:
    """Define the views public_events and public_races, and the functions of clock and pace, which need no galleries."""
    public_events(events).createOrReplaceTempView("public_events")
    public_races(races, events).createOrReplaceTempView("public_races")
    for statement in PLAIN_FUNCTIONS.split(";\n"):
        spark.sql(statement)


def register(spark: SparkSession, events: DataFrame, races: DataFrame, galleries: DataFrame) -> None:
    """Define the views and functions of ``register_views``, and the functions that read galleries, in the session.

    galleries: the table that ``write_galleries_table`` keeps. Runners, photos and reads have no view.
    """
    register_views(spark, events, races)
    galleries.select("slug", "bib", F.col("dob").cast("date").alias("dob"), "payload").createOrReplaceTempView(PRIVATE)
    for statement in FUNCTIONS.split(";\n"):
        spark.sql(statement)
