"""What the public may see, and taking things down again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemark.functions.times import clock_label


def public_events(events: DataFrame) -> DataFrame:
    """Events that anybody may read. Runners, photos and reads have no public view: they would give all galleries."""
    return events.filter("published")


def public_races(races: DataFrame, events: DataFrame) -> DataFrame:
    return races.join(public_events(events).select("event_id"), "event_id", "left_semi")


def public_views(events: DataFrame, races: DataFrame, payloads: DataFrame | None = None) -> dict[str, DataFrame]:
    """The views that readers get by name; ``gallery`` answers a bib where payloads (event_id, bib, payload) are given."""
    views = {"events": public_events(events), "races": public_races(races, events)}
    if payloads is not None:
        views["gallery"] = payloads.join(public_events(events).select("event_id", "slug"), "event_id").select("slug", "bib", "payload")
    return views


def readiness(stats: DataFrame) -> DataFrame:
    """slug and the problems of each event that keep it from being published, in order; none if it is ready."""
    rules = [
        (F.col("finishers") == 0, "no results imported yet"),
        (F.col("photos") == 0, "no photos published yet"),
        ((F.col("photos") > 0) & (F.col("tagged_bibs") == 0), "photos have no bibs yet"),
    ]
    return stats.select("slug", F.filter(F.array(*[F.when(is_so, text) for is_so, text in rules]), lambda x: x.isNotNull()).alias("problems"))


def upcoming(stats: DataFrame, now: Column) -> DataFrame:
    """slug and whether its page says that photos come after the race: until race day is over, or while it has none.

    stats: slug, race_date, photos.
    """
    over = F.to_timestamp(F.date_add("race_date", 1)) - F.expr("INTERVAL 1 SECOND")
    return stats.select("slug", (F.coalesce(now < over, F.lit(False)) | (F.coalesce("photos", F.lit(0)) == 0)).alias("upcoming"))


def preview_url(path: Column, store: str | None) -> Column:
    """Where a preview is: paths that are addresses or begin with a slash stay, others are below the store's address."""
    inside = F.lit(None).cast("string") if store is None else F.concat(F.lit(f"{store.rstrip('/')}/"), path)
    return F.when(F.nullif(path, F.lit("")).isNull(), F.lit(None)).when(path.rlike("^(https?:|/)"), path).otherwise(inside)


def gallery_labels(photos: DataFrame, zone: str = "UTC", store: str | None = None) -> DataFrame:
    """Photos of a gallery, with place from 1, as a page shows them: src, thumb, clock, hint, dims and ratio."""
    src = preview_url(F.col("preview_path"), store)
    blank = F.lit("")
    hint = F.concat_ws(" · ", F.nullif("course_point", blank), F.nullif("photographer", blank))
    known = (F.coalesce("width", F.lit(0)) > 0) & (F.coalesce("height", F.lit(0)) > 0)
    side = lambda c, n: F.coalesce(c, F.lit(n)).cast("string")
    return photos.select(
        "*",
        F.coalesce(src, blank).alias("src"),
        F.coalesce(preview_url(F.col("thumb_path"), store), src, blank).alias("thumb"),
        clock_label(F.col("captured_at"), zone, ((F.col("place") - 1) * 20).cast("int")).alias("clock"),
        F.coalesce(F.nullif(hint, blank), F.lit("Race photo")).alias("hint"),
        F.when(known, F.concat_ws(" ", "width", F.lit("×"), "height", F.lit("px"))).otherwise("—").alias("dims"),
        F.concat_ws("/", side("width", 3), side("height", 2)).alias("ratio"),
    )


def named_photos(names: DataFrame, events: DataFrame, photos: DataFrame, slug: str) -> DataFrame:
    """photo_id of an event's photos whose names are written out in a list (file_name)."""
    event = events.filter(F.col("slug") == slug).select("event_id")
    return photos.join(event, "event_id", "left_semi").join(names.select("file_name").distinct(), "file_name", "left_semi").select("photo_id")


def take_down_photo(photos: DataFrame, detections: DataFrame, event_id, file_name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Photos and reads without a photo and its reads, and the paths of its pictures in the store that are to go too."""
    hit = (F.col("event_id") == event_id) & (F.col("file_name") == file_name)
    gone = photos.filter(hit)
    paths = gone.select(F.explode(F.array("preview_path", "thumb_path")).alias("path")).filter(F.col("path").startswith("/media/")).select(F.substring("path", 2, 1 << 20).alias("path"))
    return photos.filter(~F.coalesce(hit, F.lit(False))), detections.join(gone.select("photo_id"), "photo_id", "left_anti"), paths


def take_down_runner(runners: DataFrame, photos: DataFrame, detections: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runners and reads without those asked for (event_id, bib) and without all reads of their bibs in their events.

    Reads go whether or not the bib has a runner. Photos are met by the reads of a bib that is asked for: by event alone
    each of its photos would meet each of its bibs.
    """
    keys = asked.select("event_id", F.regexp_replace("bib", "[^0-9]", "").alias("bib")).distinct()
    named = keys.withColumnRenamed("bib", "bib_text")
    read = detections.select("photo_id", "bib_text").join(named.select("bib_text").distinct(), "bib_text", "left_semi")
    theirs = read.join(photos.select("photo_id", "event_id"), "photo_id").join(named, ["event_id", "bib_text"], "left_semi").select("photo_id", "bib_text")
    return runners.join(keys, ["event_id", "bib"], "left_anti"), detections.join(theirs, ["photo_id", "bib_text"], "left_anti")
