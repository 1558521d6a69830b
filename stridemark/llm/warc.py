"""WARC archives: a deterministic sharded writer and its reader.

Records are range-partitioned and sorted by page_id. The ranges' borders are quantiles of the keys that a hash chooses,
SAMPLE at most in expectation, and their number goes by the payloads' bytes, so that neither the order of the input nor
its partitions nor the session's settings change a file. Each task writes its range to gzip files, a member a record, and
starts the next file once the compressed size passes a limit. Headers and digests are made anew from the payload. A
file gets a temporary name and is renamed when complete; then the manifest (name, records, bytes, SHA-256, first and
last key) is written by Spark's own committer, and readers take only files that it names. A task that runs again
writes the same bytes to the same names.

Of records whose equal payloads have ``least`` bytes or more, the one with the smallest page_id is the response and
the others are revisits. Only page_id and digest travel for that decision, salted; the decisions then meet the
records in the range sort, so that payloads are shuffled once. Readers deal out the manifest's rows and open the named
files in the tasks; contents are not shuffled.

Defined cases. Null html: an empty payload. Very long payloads: a record is in one task's memory. Null page_id: always a
response, spread over the shards by payload. Null url: no target header. Ties and repeated rows: rows of one page_id are
in order of payload and url; of equal payloads the first is as any row of that page_id, later ones revisit it or what it
revisits. Empty table: an empty archive. Only page_id, url and html are read, so that other columns may have any name.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Keys that decide the ranges, and bytes of payload that a range has.
SAMPLE, SHARD_BYTES = 1 << 16, 16 << 20
READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string"


def record_id(key: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'page:{key}'.encode()).digest()[:16], version=4)}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, nth: int, shard: int = 0) -> bytes:
    """One record; nth counts records with the same page_id, and those without one in a shard."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    key = "-" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(f'-{shard}:{nth}' if page_id is None else f'{key}:{nth}' if nth else key)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {key}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Roller:
    """Writes members to files of a folder; a file is renamed when it is full or the task ends."""

    def __init__(self, folder: str, roll_bytes: int, level: int) -> None:
        from pyarrow import fs

        context = TaskContext.get()
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.roll, self.level, self.part, self.attempt = roll_bytes, level, context.partitionId(), context.taskAttemptId()
        self.files, self.sink, self.rows = 0, None, []

    def add(self, key: int | None, record: bytes) -> None:
        if self.sink is None:
            self.name = f"part-{self.part:06d}-{self.files:05d}.warc.gz"
            self.temporary = f"{self.folder}/_temporary-{self.name}-{self.attempt}"
            self.sink, self.sha, self.size, self.count, self.first = self.fs.open_output_stream(self.temporary), hashlib.sha256(), 0, 0, key
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        data = packer.compress(record) + packer.flush()
        self.sink.write(data)
        self.sha.update(data)
        self.size, self.count, self.last = self.size + len(data), self.count + 1, key
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            final = f"{self.folder}/{self.name}"
            try:
                self.fs.move(self.temporary, final)
            except OSError:  # some stores refuse a name that an earlier attempt of the same task has taken
                if not self.fs.get_file_info(final).is_file:
                    raise
                self.fs.delete_file(self.temporary)
            self.rows.append((self.name, self.count, self.size, self.sha.hexdigest(), self.first, self.last))
            self.files, self.sink = self.files + 1, None


def revisits(pages: DataFrame, least: int = 100, salts: int = 32) -> DataFrame:
    """page_id, digest and the response's page_id, for pages whose payload a smaller page_id has."""
    payload = F.coalesce("html", F.lit(""))
    digests = pages.filter("page_id IS NOT NULL").select("page_id", F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).alias("n")).filter(F.col("n") >= least)
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last")
    salted = firsts.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    keyed = digests.select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int").alias("salt"))
    return keyed.join(salted, ["digest", "salt"]).filter("page_id > first").select("page_id", "digest", "first").distinct()


def borders(pages: DataFrame, shards: int, sample: int = SAMPLE) -> list[int]:
    """The least keys of all shards but the first; the same for the same keys."""
    n = pages.filter("page_id IS NOT NULL").count()
    if shards == 1 or not n:
        return []
    u = F.shiftrightunsigned(F.xxhash64(F.lit("shard"), "page_id"), 11) / float(1 << 53)
    keys = sorted(r["page_id"] for r in pages.filter("page_id IS NOT NULL").select("page_id").filter(u < min(1.0, sample / n)).distinct().collect())
    return sorted({keys[i * len(keys) // shards] for i in range(1, shards)}) if keys else []


def write_archives(pages: DataFrame, folder: str, least: int = 100, roll_bytes: int = 16 << 20, level: int = 4, shards: int | None = None) -> DataFrame:
    """Write folder/data and folder/manifest; the manifest."""
    spark = pages.sparkSession
    bounded_batches(spark, rows=500)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/data")
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    data = f"{folder}/data"
    payload = F.coalesce("html", F.lit("")).cast("binary")
    given = pages.select(F.col("page_id").cast("bigint"), "url", payload.alias("payload"))
    if shards is None:
        shards = max(1, -(-(given.agg(F.sum(F.octet_length("payload"))).first()[0] or 0) // SHARD_BYTES))
    least_keys = np.array(borders(given, shards), np.int64)
    shards = max(1, shards if not len(least_keys) else len(least_keys) + 1)

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(least_keys, page_id.to_numpy(np.int64), "right").astype(np.int32))

    spread = F.pmod(F.xxhash64("payload", "url"), F.lit(shards)).cast("int")
    rows = given.select("page_id", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("bigint").alias("first"), spread.alias("spread"))
    known = revisits(pages, least).select(F.col("page_id").cast("bigint"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "first", F.lit(0).alias("spread"))
    dealt = rows.unionByName(known).withColumn("shard", F.when(F.col("page_id").isNull(), F.col("spread")).otherwise(shard_of(F.coalesce("page_id", F.lit(0)))))
    ranged = dealt.drop("spread").repartitionById(shards, F.col("shard")).sortWithinPartitions("page_id", "kind", "payload", "url")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, now, refers, nth = _Roller(data, roll_bytes, level), object(), {}, 0
        for batch in batches:
            ids = batch["page_id"].astype("Int64")
            for page_id, kind, url, body, digest, first in zip(ids, batch["kind"], batch["url"], batch["payload"], batch["digest"], batch["first"], strict=True):
                key = None if page_id is pd.NA else int(page_id)
                if key is None or key != now:
                    now, refers, nth = key, {}, nth + 1 if key is None and now is None else 0
                if not kind:
                    refers[digest] = int(first)
                    continue
                body = bytes(body)
                digest = hashlib.sha256(body).hexdigest()
                out.add(key, record_bytes(key, url, body, digest, refers.get(digest), nth, out.part))
                if len(body) >= least and key is not None:
                    refers.setdefault(digest, key)
                nth += key is not None
        out.close()
        yield pd.DataFrame(out.rows, columns=["file", "records", "bytes", "sha256", "first_key", "last_key"]).astype({"first_key": "Int64", "last_key": "Int64"})

    ranged.mapInPandas(write, "file string, records bigint, bytes bigint, sha256 string, first_key bigint, last_key bigint").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            head[name.lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record's end is missing")
        yield head, block


class _Hashed(io.RawIOBase):
    """A stream that is read once, and its digest."""

    def __init__(self, stream) -> None:
        self.stream, self.sha = stream, hashlib.sha256()

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.stream.read(len(into))
        self.sha.update(data)
        into[: len(data)] = data
        return len(data)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row a record of the files that the manifest names; digests are computed again and must agree."""
    names = spark.read.parquet(f"{folder}/manifest").select("file", "sha256")
    dealt = names.repartitionByRange(max(1, min(names.count(), 1 << 16)), "file")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(f"{folder}/data")
        for name, sha in ((n, s) for b in batches for n, s in zip(b["file"], b["sha256"], strict=True)):
            with store.open_input_stream(f"{path}/{name}", compression=None) as raw:
                hashed, rows, size = _Hashed(raw), [], 0
                for head, block in _records(gzip.GzipFile(fileobj=io.BufferedReader(hashed, 1 << 20))):
                    digest, payload = head["warc-payload-digest"].removeprefix("sha256:"), None
                    if head["warc-type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha256(payload).hexdigest() != digest or str(len(payload)) != head["x-payload-length"]:
                            raise ValueError(f"a payload in {name} is not what its header says")
                    key, refers = head["x-page-id"], head.get("x-refers-to-page")
                    rows.append((None if key == "-" else int(key), head.get("warc-target-uri"), int(head["x-payload-length"]), digest, head["warc-type"], None if refers is None else int(refers), name, payload))
                    size += len(block) if with_payload else 0
                    if len(rows) == 2000 or size > 16 << 20:
                        yield frame(rows)
                        rows, size = [], 0
                if hashed.sha.hexdigest() != sha:
                    raise ValueError(f"{name} is not what the manifest says")
                yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "payload"])
        out = out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})
        return out if with_payload else out.drop(columns="payload")

    return dealt.mapInPandas(parse, READ + ", payload binary" * with_payload)
