"""The second reader's pipeline as tables: survey, tiles, zoom, judge, results.

Each step has a log of rows (photo, key, reply, error), which only grows. A step asks for what its log has no good row
for, the reader's answers and errors are added, and the next step reads the latest good rows. Nothing is asked twice:
a second run over the same photos sends nothing, and one after an error sends what failed.

A reader takes requests (photo, key, step, request) and gives rows (photo, key, reply, error). It may be a plug-in over
the photos' bytes, or ``Batches`` below, which registers requests, and collects replies when they come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemark.functions.geometry import box, box_key, clean_boxes, quarters
from stridemark.operators import bursts
from stridemark.operators.evidence import nothing
from stridemark.operators.merge import latest_good
from stridemark.sources.logs import append, follow_log

SEEN = "struct<bibs: array<struct<box: array<double>, number: string, legibility: string, cut: string>>>"
LOOK = "struct<is_bib: boolean, number: string, legibility: string, cut: string>"
LOG = "photo string, key string, reply string, error string, seq bigint"
REQUESTS = "chunk string, custom_id string, photo string, key string, step string, request string, attempt int, at timestamp"
Reader = Callable[[DataFrame], DataFrame]


class Stages:
    """The logs of one root folder, and the steps over photos (folder, position, photo, width, height)."""

    def __init__(self, spark: SparkSession, root: str, photos: DataFrame, reader: Reader, start: DataFrame | None = None, crowded: int = 4, tiles: str = "auto") -> None:
        self.spark, self.root, self.photos, self.reader, self.start = spark, root, photos, reader, start
        self.crowded, self.when = crowded, tiles
        self.sent: dict[str, int] = {}

    def log(self, step: str) -> DataFrame:
        """The latest good row of each key."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{step}")
        if not path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return self.spark.createDataFrame([], LOG)
        return latest_good(self.spark.read.schema(LOG).json(f"{self.root}/{step}"), "key", "seq")

    def _step(self, step: str, jobs: DataFrame) -> None:
        """Ask for the jobs (photo, key, request) that have no good row, and add what comes back."""
        todo = jobs.join(self.log(step).select("key"), "key", "left_anti").select("photo", "key", F.lit(step).alias("step"), "request")
        run = self.spark.sql("SELECT unix_micros(current_timestamp())").first()[0]
        self.sent[step] = todo.count()
        if self.sent[step]:
            append(self.reader(todo).select("photo", "key", "reply", "error", F.lit(run).alias("seq")), f"{self.root}/{step}")

    def survey(self) -> None:
        size = F.to_json(F.struct("width", "height"))
        self._step("survey", self.photos.select("photo", F.col("photo").alias("key"), size.alias("request")))

    def surveyed(self) -> DataFrame:
        """photo, width, height and bibs of photos that have a good survey."""
        rows = self.photos.join(self.log("survey").select("photo", F.from_json("reply", SEEN).alias("r")), "photo")
        return rows.select("folder", "position", "photo", "width", "height", clean_boxes(F.col("r.bibs"), F.lit(1.0), F.col("width").cast("double"), F.col("height").cast("double")).alias("bibs"))

    def wanted(self) -> DataFrame:
        """Surveyed photos with ``split``: whether their quarters are looked at as well."""
        rows = self.surveyed()
        as_reads = F.transform("bibs", lambda b: F.struct(F.lit("survey").alias("source"), b["number"].alias("number"), b["legibility"].alias("legibility"), b["cut"].alias("cut"), F.lit(True).alias("is_bib")))
        doubtful = (F.size("bibs") >= self.crowded) | (F.size("bibs") == 0) | F.exists(as_reads, lambda r: (r["legibility"] != "clear") | (r["cut"] != "none"))
        return rows.withColumn("split", {"always": F.lit(True), "off": F.lit(False), "auto": doubtful}[self.when])

    def tiles(self) -> None:
        rows = self.wanted().filter("split").select("photo", F.posexplode(quarters(F.col("width"), F.col("height"))).alias("i", "tile"))
        self._step("tiles", rows.select("photo", F.concat_ws("#", "photo", "i").alias("key"), F.to_json("tile").alias("request")))

    def found(self) -> DataFrame:
        """photo, bib (its box's key), box and reads of each bib, of photos all of whose looks have come."""
        wanted = self.wanted()
        tiles = self.log("tiles").select("photo", F.regexp_extract("key", "#([0-9]+)$", 1).cast("int").alias("i"), F.from_json("reply", SEEN).alias("r"))
        tiles = tiles.join(wanted.select("photo", "width", "height"), "photo").withColumn("tile", F.get(quarters(F.col("width"), F.col("height")), F.col("i")))
        seen = tiles.select("photo", F.concat(F.lit("tile"), "i").alias("source"), (F.col("i") + 1).alias("look"), clean_boxes(F.col("r.bibs"), F.lit(1.0), F.col("width").cast("double"), F.col("height").cast("double"), F.col("tile.x0"), F.col("tile.y0")).alias("bibs"))
        complete = wanted.join(tiles.groupBy("photo").agg(F.count("*").alias("n")), "photo", "left").filter(~F.col("split") | (F.col("n") == 4)).select("photo")
        looks = wanted.select("photo", F.lit("survey").alias("source"), F.lit(0).alias("look"), "bibs").unionByName(seen).join(complete, "photo", "left_semi")
        rows = looks.select("photo", "source", "look", F.posexplode("bibs").alias("n", "b"))
        boxes = rows.select("photo", F.struct("look", "n").alias("pos"), *[F.col(f"b.box.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")], "source", "b.number", "b.legibility", "b.cut", F.lit(True).alias("is_bib"))
        found = bursts.clusters(boxes)
        b = box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
        return found.select("photo", box_key(b).alias("bib"), b.alias("box"), "reads")

    def _ask(self, step: str, bibs: DataFrame) -> None:
        self._step(step, bibs.select("photo", F.concat_ws("@", "photo", "bib").alias("key"), F.to_json(F.struct("box", "reads")).alias("request")))

    def zoom(self) -> None:
        self._ask("zoom", self.found())

    def decided(self) -> DataFrame:
        """photo, bib, box, d (decision) and complete, whether the close-up has come, of each bib."""
        look = lambda step: self.log(step).select(F.col("key").alias("__key"), F.from_json("reply", LOOK).alias("__r")).select("__key", F.struct(F.lit(step).alias("source"), *[F.col(f"__r.{c}").alias(c) for c in ("number", "legibility", "cut", "is_bib")]).alias(step))
        rows = self.found().withColumn("__key", F.concat_ws("@", "photo", "bib"))
        rows = rows.join(look("zoom"), "__key", "left").join(look("judge"), "__key", "left")
        return rows.select("photo", "bib", "box", "reads", bursts.decide(F.col("reads"), F.col("zoom"), F.col("judge")).alias("d"), F.col("zoom").isNotNull().alias("complete"))

    def judge(self) -> None:
        self._ask("judge", self.decided().filter("complete AND d.status = 'judge'"))

    def results(self) -> DataFrame:
        """folder, photo, numbers, needs_human and complete of each surveyed photo, after what neighbours settle."""
        decided = self.decided()
        frames = self.photos.select("folder", "position", "photo")
        settled = bursts.results(bursts.resolve(decided.select("photo", "bib", "d"), frames, self.start))
        whole = decided.groupBy("photo").agg(F.min("complete").alias("complete"))
        rows = self.wanted().select("folder", "photo").join(settled, "photo", "left").join(whole, "photo", "left")
        return rows.select("folder", "photo", F.coalesce("numbers", nothing()).alias("numbers"), F.coalesce("needs_human", F.lit(0)).alias("needs_human"), F.coalesce("complete", F.lit(True)).alias("complete"))

    def run(self) -> DataFrame:
        for step in (self.survey, self.tiles, self.zoom, self.judge):
            step()
        return self.results()


class Batches:
    """Requests that are answered later, as tables: chunks of them are registered, and their replies collected.

    submit(chunk) hands the requests of a chunk to a service, once. collect(replies) takes what has come (custom_id,
    reply, error) and gives the reader's rows of chunks that are not done; a reply to a request that nobody waits for
    any more is left out.

    ``settled`` joins the requests, as they are registered, with a stream of replies: a request that has no reply in
    time comes out without one, and ``ask_again`` registers it once more under another name, ``attempts`` times in all.
    A reply that comes after that belongs to nobody. now: microseconds of the time that replays of old streams go by.
    """

    def __init__(self, spark: SparkSession, root: str, most: int = 2000, most_bytes: int = 150_000_000, attempts: int = 2, now: Callable[[], int] | None = None) -> None:
        self.spark, self.root, self.most, self.most_bytes, self.attempts = spark, root, most, most_bytes, attempts
        self.now = now or (lambda: spark.sql("SELECT unix_micros(current_timestamp())").first()[0])

    def requests(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/requests")
        if not path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return self.spark.createDataFrame([], REQUESTS)
        return self.spark.read.schema(REQUESTS).json(f"{self.root}/requests").drop("batch")

    def _register(self, rows: DataFrame) -> DataFrame:
        """Add requests (photo, key, step, request, attempt) in chunks of so many rows and bytes at most; those added."""
        from stridemark.operators.windows import byte_chunks, chunks

        fresh = rows.withColumn("size", F.octet_length("request")).withColumn("order", F.xxhash64("key"))
        cut = byte_chunks(chunks(fresh, "step", "order", self.most).withColumnRenamed("chunk", "rows"), "step", ["rows", "order", "key"], "size", self.most_bytes)
        run = self.now()
        name = F.concat(F.lit("r"), F.sha1("key"), F.when(F.col("attempt") > 1, F.concat(F.lit("-"), "attempt")).otherwise(""))
        named = cut.select(F.concat_ws("-", "step", F.lit(run), "rows", "chunk").alias("chunk"), name.alias("custom_id"), "photo", "key", "step", "request", "attempt", F.timestamp_micros(F.lit(run)).alias("at"))
        before = self.requests().select("chunk").distinct()
        append(named, f"{self.root}/requests")
        return self.requests().join(before, "chunk", "left_anti")

    def submit(self, jobs: DataFrame) -> DataFrame:
        """The newly registered requests (photo, key, step, request); what was ever registered isn't again."""
        fresh = jobs.join(self.requests().select("step", "key"), ["step", "key"], "left_anti")
        return self._register(fresh.withColumn("attempt", F.lit(1)))

    def collect(self, replies: DataFrame, done: DataFrame) -> DataFrame:
        """photo, key, reply and error of replies to registered requests that the log (key) has no good row for."""
        known = self.requests().select("custom_id", "photo", "key").distinct().join(done.select("key"), "key", "left_anti")
        return replies.join(known, "custom_id").select("photo", "key", "reply", "error")

    def settled(self, replies: DataFrame, patience: str = "24 hours", late: str = "10 minutes", clock: DataFrame | None = None) -> DataFrame:
        """Requests with their reply, or without one when it hasn't come in time, each once; a stream.

        replies: a stream (custom_id, reply, error, at). A reply is in time up to ``patience`` after the request; event
        time is both streams', so that ``clock``, a stream (at), lets it go on where neither has anything new.
        """
        asked = follow_log(self.spark, f"{self.root}/requests", REQUESTS).drop("seq")
        if clock is not None:
            # Its rows have names of their own, of their time: Spark would take rows without a name, or with one that can't
            # match, away before it looks at their time.
            named = lambda prefix: clock.select("at", F.concat(F.lit(prefix), F.unix_micros("at")).alias("custom_id"))
            asked = asked.unionByName(named("tick"), allowMissingColumns=True)
            replies = replies.unionByName(named("tock"), allowMissingColumns=True)
        asked = asked.withWatermark("at", late)
        came = replies.select(F.col("custom_id").alias("to"), "reply", "error", F.col("at").alias("came_at")).withWatermark("came_at", late)
        in_time = F.expr(f"custom_id = to AND came_at >= at AND came_at <= at + INTERVAL {patience}")
        both = asked.join(came, in_time, "left_outer").filter("custom_id NOT LIKE 'tick%' OR at < TIMESTAMP '1900-01-01'")  # of the time too, for the same reason
        return both.select("custom_id", "photo", "key", "step", "request", "attempt", "reply", "error", F.col("to").isNull().alias("timed_out"))

    def ask_again(self, settled: DataFrame) -> DataFrame:
        """The requests that are registered once more, of a batch of those that timed out; a batch done again adds none."""
        lost = settled.filter("timed_out").filter(F.col("attempt") < self.attempts).withColumn("attempt", F.col("attempt") + 1)
        fresh = lost.join(self.requests().select("step", "key", "attempt"), ["step", "key", "attempt"], "left_anti")
        return self._register(fresh.select("photo", "key", "step", "request", "attempt"))

    def run(self, replies: DataFrame, checkpoint: str, sink: Callable[[DataFrame], None], **times):
        """Go through what is new: sink gets rows (photo, key, reply, error) of replies, the rest is asked again or given up.

        A request that is given up reaches the sink with the error ``no reply``.
        """

        def step(batch: DataFrame, number: int) -> None:
            rows = batch.persist()
            given_up = F.col("timed_out") & (F.col("attempt") >= self.attempts)
            sink(rows.filter(~F.col("timed_out") | given_up).select("photo", "key", "reply", F.when(given_up, "no reply").otherwise(F.col("error")).alias("error")))
            if not rows.filter("timed_out").isEmpty():
                self.ask_again(rows)
            rows.unpersist()

        return self.settled(replies, **times).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
