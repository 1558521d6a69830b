"""Result lists and bib exports: CSV files whose headers and values come in many forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemark.functions import text as t
from stridemark.functions import times

#: Headers that mean a field, after accents, case and punctuation are taken away; the first that has a
#: value in a row is used.
FIELDS = {
    "bib": ["bib", "bib_number", "bibnumber", "bibno", "number", "no", "startno", "start_number", "startnumber", "broj", "startni_broj", "st_br", "stbr"],
    "dob": ["dob", "birthdate", "birth_date", "dateofbirth", "date_of_birth", "born", "birthday", "datum_rodenja", "datum_rodjenja", "datumrodjenja", "rodjen", "geburtsdatum"],
    "birth_year": ["birthyear", "birth_year", "yob", "year_of_birth", "godina", "godina_rodenja"],
    "full_name": ["name", "full_name", "fullname", "runner", "athlete", "imeiprezime", "ime_i_prezime", "participant"],
    "first_name": ["firstname", "first_name", "given_name", "ime", "vorname"],
    "last_name": ["lastname", "last_name", "surname", "family_name", "prezime", "nachname"],
    "gender": ["gender", "sex", "spol", "m_f", "mf", "kat_spol"],
    "category": ["category", "cat", "kategorija", "agegroup", "age_group", "ag", "class", "klasa"],
    "club": ["club", "klub", "team", "tim", "ekipa", "society"],
    "nationality": ["nationality", "nat", "country", "nacionalnost", "drzava", "ctry", "noc"],
    "race": ["race", "distance", "event", "discipline", "disciplina", "trka", "dionica", "staza"],
    "finish_time": ["finish_time", "finishtime", "chip_time", "chiptime", "net_time", "nettime", "gun_time", "guntime", "official_time", "time", "result", "rezultat", "vrijeme", "ukupno"],
    "chip_time": ["chip_time", "chiptime", "net_time", "nettime", "neto"],
    "place_overall": ["place", "rank", "position", "pos", "overall", "overall_place", "mjesto", "plasman", "ukupno_mjesto"],
    "place_gender": ["gender_place", "place_gender", "genderrank", "mjesto_spol"],
    "place_category": ["category_place", "place_category", "cat_place", "catplace", "agrank", "mjesto_kategorija", "kategorija_mjesto", "mjesto u kategoriji", "plasman_kategorija"],
    "status": ["status", "finished", "dnf"],
}


def read(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text under their header keys. The separator is ; if the header has more than one of them.

    Quoted values may have line breaks, for which a file is read by one task, in order.
    """
    head = spark.read.text(path).first()
    separator = ";" if head and head[0].count(";") > 1 else ","
    rows = spark.read.csv(path, sep=separator, header=True, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=True)
    return rows.toDF(*[t.header_key(c.lstrip("﻿")) or f"column{i}" for i, c in enumerate(rows.columns)])


def pick(rows: DataFrame, aliases: list[str]) -> Column:
    """The first alias that is not blank in the row, trimmed; empty if none is."""
    have = [F.nullif(F.trim(F.col(k)), F.lit("")) for k in dict.fromkeys(map(t.header_key, aliases)) if k in rows.columns]
    return F.coalesce(*have, F.lit(""))


def runners(rows: DataFrame, overrides: dict[str, str] | None = None, date_order: str = "dmy", pivot: int = 26) -> tuple[DataFrame, DataFrame]:
    """(runners, problems): rows without a bib or name are problems, those without a full date of birth are both.

    overrides maps a field to a header of the file, which is looked at first.
    """
    of = lambda field: pick(rows, [*([overrides[field]] if overrides and field in overrides else []), *FIELDS[field]])
    bib = t.only_digits(of("bib"))
    name = F.coalesce(F.nullif(of("full_name"), F.lit("")), F.concat_ws(" ", *[F.nullif(of(c), F.lit("")) for c in ("first_name", "last_name")]))
    dob, year = times.parse_date(of("dob"), date_order, pivot), t.integer_in(of("birth_year"))
    problem = F.when(bib == "", "no bib").when(name == "", "no name").when(dob.isNull() & year.isNotNull(), "birth year only").when(dob.isNull(), "unparseable birthdate")
    none = lambda c: F.nullif(c, F.lit(""))
    out = rows.withColumn("line", F.monotonically_increasing_id()).select(
        "line", bib.alias("bib"), name.alias("full_name"), dob.alias("dob"), t.gender(of("gender")).alias("gender"), none(of("category")).alias("category"), none(of("club")).alias("club"), none(F.upper(of("nationality"))).alias("nationality"),
        times.parse_duration(of("finish_time")).alias("finish_s"), times.parse_duration(of("chip_time")).alias("chip_s"), *[t.integer_in(of(c)).alias(c) for c in ("place_overall", "place_gender", "place_category")],
        t.finish_status(F.coalesce(none(of("status")), of("finish_time"))).alias("status"), t.race_code(of("race"), bib).alias("race_code"), problem.alias("problem"),
    )
    good = out.filter(~F.coalesce(F.col("problem").isin("no bib", "no name"), F.lit(False)))
    latest = good.groupBy("bib").agg(F.max_by(F.struct(*[c for c in good.columns if c != "problem"]), "line").alias("r")).select("r.*").drop("line")
    twice = good.groupBy("bib").agg(F.count("*").alias("n"), F.max("line").alias("line")).filter("n > 1").select("line", "bib", F.lit("duplicate bib, the later row counts").alias("problem"))
    return latest, out.filter("problem IS NOT NULL").select("line", "bib", "problem").unionByName(twice)


def bundle(rows: DataFrame, meta: DataFrame | None = None, review: DataFrame | None = None, point: str | None = None, km: float | None = None) -> DataFrame:
    """file_name, bibs, model_numbers, reviewed and course point of a bib export, with metadata and reviews if given."""
    name = pick(rows, ["image_name", "file_name", "filename", "image", "photo"])
    out = rows.select(name.alias("file_name"), pick(rows, ["bib_numbers", "bibs", "bib_number", "numbers", "bib"]).alias("bibs")).filter("file_name <> ''")
    if meta is not None:
        of = lambda *names: F.nullif(pick(meta, list(names)), F.lit(""))
        known = meta.select(pick(meta, ["file_name", "image_name", "filename", "image", "photo"]).alias("file_name"), of("course_point", "point").alias("meta_point"), of("course_km", "km").try_cast("double").alias("meta_km"), of("photographer", "author", "photo_by").alias("photographer"), of("captured_at", "timestamp", "time", "datetime").try_cast("timestamp").alias("captured_at"), F.monotonically_increasing_id().alias("line"))
        out = out.join(known.groupBy("file_name").agg(*[F.max_by(c, "line").alias(c) for c in ("meta_point", "meta_km", "photographer", "captured_at")]), "file_name", "left")
    else:
        out = out.select("*", *[F.lit(None).cast(k).alias(c) for c, k in (("meta_point", "string"), ("meta_km", "double"), ("photographer", "string"), ("captured_at", "timestamp"))])
    inferred, at = t.course_point(F.col("file_name"), point, km)
    out = out.withColumn("course_point", F.coalesce("meta_point", inferred)).withColumn("course_km", F.coalesce(F.nullif("meta_km", F.lit(0.0)), at)).drop("meta_point", "meta_km")
    if review is None:
        return out.withColumn("model_numbers", F.array().cast("array<string>")).withColumn("reviewed", F.lit(False))
    return out.join(review.select("file_name", "model_numbers", "reviewed"), "file_name", "left")


def with_race_ids(runners_: DataFrame, races: DataFrame) -> DataFrame:
    """The payload of an upsert: race_id in place of race_code, null for a code that the event hasn't."""
    known = races.select(F.col("code").alias("race_code"), "race_id")
    return runners_.join(known, "race_code", "left").drop("race_code")


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """file_name, numbers, model_numbers and reviewed from the JSON object of a review bundle; none if it is missing."""
    from stridemark.sources.files import json_map

    rows = json_map(spark, path, "struct<numbers: array<string>, model_numbers: array<string>, reviewed: boolean>")
    return rows.select(F.col("key").alias("file_name"), "value.*")


def without_bibs(spark: SparkSession, path: str) -> DataFrame:
    """Distinct file_name of a reviewer's CSV (image_name, bib_numbers) whose list of bibs is empty."""
    rows = read(spark, path)
    return rows.select(pick(rows, ["image_name"]).alias("file_name"), pick(rows, ["bib_numbers"]).alias("bibs")).filter((F.col("file_name") != "") & (F.size(F.filter(F.split("bibs", "[,;]"), lambda x: F.trim(x) != "")) == 0)).select("file_name").distinct()
