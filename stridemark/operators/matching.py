"""Which photos show a runner: one plan for all runners of all events.

Tables: events (event_id, slug, published, db_search, ...), races, runners (event_id, bib, ...), photos (photo_id,
event_id, ...), detections (photo_id, bib_text, confidence, source). A photo with reads that a person confirmed
matches by those alone; other reads match exactly, or within one edit if they are nobody's bib.

Ties between reads of one photo and runner that score the same go to the smaller read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridemark.functions.text import one_deletions, within_one_edit
from stridemark.functions.times import clock, pace
from stridemark.operators.lookup import LISTED, Reads, concerned, counts_nearly, is_confirmed, likeness


def gated(reads: DataFrame) -> DataFrame:
    """Without rejected reads; of photos with confirmed reads only those. One window, no self join."""
    some = F.max(is_confirmed()).over(Window.partitionBy("photo_id"))
    return reads.filter("source <> 'rejected'").withColumn("gate", some).filter(is_confirmed() | ~F.col("gate")).drop("gate")


def near_texts(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of distinct texts (a, b) within one edit, and not equal.

    Two such texts share a text made by taking at most one character away: an equality join on those, then the edit
    distance. Both sides are small dictionaries of distinct texts, whatever the number of reads.
    """
    x = left.select(a).distinct().withColumn("k", F.explode(one_deletions(F.col(a))))
    y = right.select(b).distinct().withColumn("k", F.explode(one_deletions(F.col(b))))
    return x.join(y, "k").filter(within_one_edit(F.col(a), F.col(b)) & (F.col(a) != F.col(b))).select(a, b).distinct()


def counted(detections: DataFrame) -> DataFrame:
    """Reads with ``gate`` (a person confirmed one of the photo's) and ``bibs_in_photo``, from one window by photo.

    bibs_in_photo is the number of bibs that a person confirmed, or of all that were read if there are none.
    """
    photo = Window.partitionBy("photo_id")
    sure, every = F.size(F.collect_set(F.when(is_confirmed(), F.col("bib_text"))).over(photo)), F.size(F.collect_set("bib_text").over(photo))
    return detections.withColumn("gate", sure > 0).withColumn("bibs_in_photo", F.when(F.col("gate"), sure).otherwise(every).cast("bigint"))


def bib_texts(runners: DataFrame, detections: DataFrame, least: float = 0.30) -> DataFrame:
    """event_id, bib, bib_text, exact and like: the texts that count for a bib. Distinct texts, whatever the number of reads.

    A text that is somebody's bib in every event is near to nobody's: it is left out before pairs are made.
    """
    bibs = runners.select("event_id", "bib").distinct()
    known = bibs.filter("event_id IS NOT NULL")
    all_over = known.groupBy(F.col("bib").alias("bib_text")).agg(F.count("*").alias("k")).crossJoin(known.agg(F.count_distinct("event_id").alias("n"))).filter("k = n")  # one row of n
    read = detections.filter(counts_nearly(least)).select("bib_text").distinct().join(all_over, "bib_text", "left_anti")
    pairs = near_texts(bibs.filter(F.length("bib") >= 3), read, "bib", "bib_text").withColumn("like", likeness(F.col("bib"), F.col("bib_text")))
    someone = bibs.select("event_id", F.col("bib").alias("bib_text"))
    fuzzy = bibs.join(pairs, "bib").join(someone, ["event_id", "bib_text"], "left_anti")
    exact = bibs.select("event_id", "bib", F.col("bib").alias("bib_text"), F.lit(True).alias("exact"), F.lit(1.0).alias("like"))
    return exact.unionByName(fuzzy.select("event_id", "bib", "bib_text", F.lit(False).alias("exact"), "like"))


def candidates(runners: DataFrame, photos: DataFrame, detections: DataFrame | Reads, least: float = 0.30, only: DataFrame | None = None) -> DataFrame:
    """Every read that counts for a runner: the photo's columns, bib, read_as, exact, score and bibs_in_photo.

    The reads are joined once to their photos and once to the texts that count. only: (event_id, bib) of the runners
    that are asked for; the plan is then one over the photos that hold one of their texts, as long as those are few.
    """
    some = None if only is None else concerned(runners, photos, detections, only, least)
    if some is not None:
        texts, photos, detections = some
        texts = F.broadcast(texts)
    else:
        detections = Reads.of(detections).by_photo
        texts = bib_texts(runners, detections, least)
        texts = texts if only is None else texts.join(only.select("event_id", "bib").distinct(), ["event_id", "bib"], "left_semi")
    reads = counted(detections).filter((F.col("source") != "rejected") & (is_confirmed() | ~F.col("gate"))).join(photos, "photo_id")
    found = reads.join(texts, ["event_id", "bib_text"]).filter(F.col("exact") | (~is_confirmed() & (F.col("confidence") >= least)))
    score = (F.coalesce("confidence", F.lit(0.5)) * F.col("like")).cast("double")
    return found.select(*photos.columns, "bib", F.col("bib_text").alias("read_as"), "exact", score.alias("score"), "bibs_in_photo")


def best_reads(found: DataFrame) -> DataFrame:
    """One read a runner and photo: exact ones first, then by score."""
    order = Window.partitionBy("event_id", "bib", "photo_id").orderBy(F.desc("exact"), F.desc("score"), "read_as")
    return found.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def gallery(runners: DataFrame, photos: DataFrame, detections: DataFrame | Reads, only: DataFrame | None = None) -> DataFrame:
    """One row a runner and photo, with how it matches and its place in the gallery.

    What counts for a runner is dealt out by bib once, which serves both windows, whether there is one event or many.
    """
    found = candidates(runners, photos, detections, only=only).repartition("bib")
    order = Window.partitionBy("event_id", "bib").orderBy(F.asc_nulls_last("course_km"), F.asc_nulls_last("captured_at"), "file_name", "photo_id")
    return best_reads(found).select("*", F.when(F.col("exact"), "exact").otherwise("fuzzy").alias("match_kind"), F.round("score", 4).alias("match_score"), F.row_number().over(order).alias("place"))


PHOTO_FIELDS = ("id", "file_name", "preview_path", "thumb_path", "width", "height", "captured_at", "photographer", "course_point", "course_km", "match_kind", "match_score", "read_as", "bibs_in_photo")


def export(runners: DataFrame, races: DataFrame, photos: DataFrame, detections: DataFrame | Reads, use_chip_time: bool = False, only: DataFrame | None = None) -> DataFrame:
    """event_id, bib and payload: the whole answer for each runner as JSON, nulls kept, photos in order.

    only: (event_id, bib) of the runners that are asked for.
    """
    rows = gallery(runners, photos, detections, only).withColumnRenamed("photo_id", "id")
    asked = runners if only is None else runners.join(only.select("event_id", "bib").distinct(), ["event_id", "bib"], "left_semi")
    have = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in PHOTO_FIELDS]
    listed = rows.groupBy("event_id", "bib").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.struct(*have).alias("p")))), lambda x: x["p"]).alias("photos"))
    finish = F.coalesce("chip_s", "finish_s") if use_chip_time else F.col("finish_s")
    km = F.coalesce(F.col("distance_km").cast("double"), F.lit(42.195))
    runner = F.struct("bib", F.col("full_name").alias("name"), "category", "club", "nationality", F.coalesce("race", F.lit("Marathon")).alias("race"), F.coalesce("code", F.lit("marathon")).alias("race_code"), km.alias("distance_km"), "status", F.when(finish.isNotNull(), clock(finish)).alias("time"), pace(finish, km).alias("pace"), "place_overall", "place_category")
    known = races.select("race_id", "code", F.col("name").alias("race"), "distance_km")
    everyone = asked.join(known, "race_id", "left").join(listed, ["event_id", "bib"], "left")
    photos_or_none = F.coalesce("photos", F.filter("photos", lambda x: F.lit(False)), F.from_json(F.lit("[]"), listed.schema["photos"].dataType))
    return everyone.select("event_id", "bib", F.to_json(F.struct(F.lit(True).alias("ok"), runner.alias("runner"), photos_or_none.alias("photos")), {"ignoreNullFields": "false"}).alias("payload"))


def find_runner(asked: DataFrame, events: DataFrame, runners: DataFrame) -> DataFrame:
    """The reason for each question (slug, bib, dob, caller_role), a row each, in the order the checks are made."""
    bib = F.regexp_replace(F.coalesce("bib", F.lit("")), "[^0-9]", "")
    q = asked.withColumn("bib", bib)
    e = events.filter("published").select("slug", "event_id", "db_search")
    r = runners.select("event_id", "bib", F.col("dob").alias("known_dob"), F.lit(True).alias("known"))
    rows = q.join(e, "slug", "left").join(r, ["event_id", "bib"], "left")
    shut = ~F.col("db_search") & F.coalesce("caller_role", F.lit("")).isin("anon", "authenticated")
    reason = (
        F.when(F.col("bib") == "", "missing_input")
        .when(F.col("event_id").isNull() | shut, "no_event")
        .when(F.col("known").isNull(), "no_bib")
        .when(F.col("dob").isNotNull() & ~F.col("dob").eqNullSafe(F.col("known_dob")), "dob_mismatch")
        .otherwise("ok")
    )
    return rows.select("slug", "bib", "dob", "caller_role", reason.alias("reason"))


def answers(asked: DataFrame, events: DataFrame, runners: DataFrame, races: DataFrame, photos: DataFrame, detections: DataFrame | Reads, use_chip_time: bool = False) -> DataFrame:
    """The whole answer to each question (slug, bib, dob, caller_role): reason, and payload as JSON.

    The payload of an answered question has ok, runner and photos, and else ok and the reason. Galleries are made of
    the runners that are asked for, each once.
    """
    rows = find_runner(asked, events, runners).join(events.select("slug", "event_id").filter("slug IS NOT NULL"), "slug", "left")
    fine = rows.filter("reason = 'ok'").select("event_id", "bib").distinct()
    found = export(runners, races, photos, detections, use_chip_time, only=fine)
    refused = F.to_json(F.struct(F.lit(False).alias("ok"), "reason"))
    out = rows.join(found, ["event_id", "bib"], "left")
    return out.select("slug", "bib", "dob", "caller_role", "reason", F.when(F.col("reason") == "ok", F.col("payload")).otherwise(refused).alias("payload"))


def export_page(events: DataFrame, runners: DataFrame, races: DataFrame, photos: DataFrame, detections: DataFrame | Reads, slug: str, after: str = "", n: int = 100) -> DataFrame:
    """bib and payload of the next n runners of a published event by bib, which sorts as text."""
    shown = runners.join(events.filter(F.col("published") & (F.col("slug") == slug)).select("event_id"), "event_id", "left_semi")
    some = page(shown.select("event_id", "bib"), after, n)
    return export(runners, races, photos, detections, only=some).select("bib", "payload").orderBy("bib")


def event_stats(events: DataFrame, races: DataFrame, runners: DataFrame, photos: DataFrame, detections: DataFrame) -> DataFrame:
    """One row a published event. Test photos and test runners open in a search but don't count."""
    reads = detections.join(photos.select("photo_id", "event_id"), "photo_id")
    read = reads.groupBy("event_id", F.col("bib_text").alias("bib")).agg(F.count_if(is_confirmed()).alias("confirmed"))  # the reads are gone through once
    finishers = runners.groupBy("event_id").agg(F.count_if(F.col("status") == "finished").alias("finishers"))
    shown = photos.groupBy("event_id").agg(F.count_if(~F.col("file_name").startswith("_test/")).alias("photos"))
    real = runners.filter(~F.col("status").eqNullSafe("test")).groupBy("event_id", "bib").agg(F.count("*").alias("runners"))
    seen = read.join(real, ["event_id", "bib"], "left").groupBy("event_id").agg(F.sum(F.coalesce("runners", F.lit(0))).alias("tagged_bibs"), F.sum("confirmed").alias("recognitions"))
    far = races.groupBy("event_id").agg(F.max("distance_km").alias("distance_km"))
    record = runners.filter("status = 'finished'").join(races.filter("code = 'marathon'").select("race_id"), "race_id", "left_semi").groupBy("event_id").agg(F.min("finish_s").alias("record_s"))
    out = events.filter("published")
    for part in (finishers, shown, seen, far, record):
        out = out.join(part, "event_id", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("finishers", "photos", "tagged_bibs", "recognitions")]
    return out.select("slug", *counts, "distance_km", F.when(F.col("record_s").isNotNull(), clock(F.col("record_s"))).alias("course_record"))


def page(rows: DataFrame, after: str, n: int) -> DataFrame:
    """The next n rows by bib, which sorts as text."""
    return rows.filter(F.col("bib") > after).orderBy("bib").limit(n)


def without_confirmed(photos: DataFrame, detections: DataFrame) -> DataFrame:
    return photos.join(detections.filter(is_confirmed()), "photo_id", "left_anti")


def one_digit_apart(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of texts of equal length that differ in one place, by an equality join on texts with one place hidden."""
    from stridemark.functions.text import one_hidden

    x = left.select(a).distinct().withColumn("k", F.explode(one_hidden(F.col(a))))
    y = right.select(b).distinct().withColumn("k", F.explode(one_hidden(F.col(b))))
    return x.join(y, "k").filter(F.col(a) != F.col(b)).select(a, b)


def masks_of(patterns: DataFrame, pattern: str) -> DataFrame:
    """mask: the places that patterns hide, as x and ?, each once."""
    mask = F.concat_ws("", F.transform(F.split(pattern, ""), lambda c: F.when(c == "?", "?").otherwise("x")))
    return patterns.filter(F.contains(pattern, F.lit("?"))).select(mask.alias("mask")).distinct()


def masked(numbers: DataFrame, number: str, masks: DataFrame, also: Column | None = None) -> DataFrame:
    """The number, and k: it with the digits hidden that a mask of its length hides, and what ``also`` lists, each once.

    There are as many masks as ways to hide digits, however many patterns; up to ``LISTED`` of them are part of the
    expression, so that no join deals the numbers out by their length. More of them go to the numbers by such a join.
    """
    hide = lambda m: F.concat_ws("", F.zip_with(F.split(m, ""), F.split(number, ""), lambda c, x: F.when(c == "?", "?").otherwise(x)))
    more = F.array().cast("array<string>") if also is None else also
    known = [r["mask"] for r in masks.limit(LISTED + 1).collect()]
    if len(known) <= LISTED:
        fitting = F.filter(F.array(*map(F.lit, known)).cast("array<string>"), lambda m: F.length(m) == F.length(number))
        return numbers.select(number, F.explode(F.array_distinct(F.concat(more, F.transform(fitting, hide)))).alias("k"))
    by_mask = numbers.join(masks, F.length("mask") == F.length(number)).select(number, hide(F.col("mask")).alias("k"))
    return by_mask.unionByName(numbers.select(number, F.explode(more).alias("k"))).distinct()


def complete_patterns(patterns: DataFrame, known: DataFrame, pattern: str, number: str) -> DataFrame:
    """Pairs of a pattern with hidden digits and a number that it fits, joined on length and what is not hidden.

    The numbers' digits at the pattern's places that are not hidden make the key, once for each mask that occurs. A pattern that hides
    nothing fits itself.
    """
    p = patterns.select(pattern).distinct()
    return p.join(masked(known.select(number).distinct(), number, masks_of(p, pattern), F.array(number)), F.col(pattern) == F.col("k")).select(pattern, number)
