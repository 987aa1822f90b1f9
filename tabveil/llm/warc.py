"""A deterministic sharded WARC writer, and a reader.

Records are ranged by page_id and payload digest into shards of about equal bytes. Running sums of bytes over the
range-sorted keys place the cuts; they depend on the rows alone, not on how Spark holds them, so a rerun writes the
same files, however page_ids are spread. Inside a shard a task writes the records in order, remembering one key at a
time, and rolls to a new file by compressed size. Files get temporary names
that differ from attempt to attempt; the manifest lists those of the attempts that succeeded, and the commit
renames them, so lost executors and repeated tasks leave nothing behind but temporary files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabveil.llm.common import cut, file_system, qualified, small_batches

LEAST_REVISIT = 1000
#: Partitions of the writing step at most; more shards share them, neighbours with neighbours.
MOST_PARTITIONS = 50_000
SHARD_BYTES = 64 << 20
ROLL_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MANIFEST = "shard int, file int, temp string, name string, bytes long, sha1 string, records long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"


def _id(page) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page}')}>"


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Date", DATE), *headers, ("WARC-Block-Digest", _digest(block)), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member of its own, without a time stamp
    return squeeze.compress(head.encode("utf-8", "replace") + block + b"\r\n\r\n") + squeeze.flush()


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(s: str | None) -> str:
    return "".join(c if c > " " else "%%%02X" % ord(c) for c in s or "")


def page_record(page, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response or, without its payload, a revisit. Payload length and digest are those of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", _id(page)), ("WARC-Target-URI", _one_line(url)), ("WARC-Payload-Digest", _digest(payload)), ("Content-Type", "application/http; msgtype=response"), ("X-Page-Id", "" if page is None else str(page)), ("X-Payload-Length", str(len(payload)))]
    if not revisit:
        return _record("response", headers, http + payload)
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _id(refers_to)), ("X-Refers-To-Page", "" if refers_to is None else str(refers_to))]
    return _record("revisit", headers, http)


def _write(folder: str, prefix: str, roll: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = file_system(folder)
        done: list[tuple] = []
        state = {"shard": None, "file": 0, "out": None}

        def close() -> None:
            if state["out"] is not None:
                state["out"].close()
                done.append((state["shard"], state["file"], state["temp"], state["name"], state["bytes"], state["sum"].hexdigest(), state["n"]))
                state["out"] = None

        def put(shard: int, data: bytes, record: bool = True) -> None:
            state["out"].write(data)
            state["sum"].update(data)
            state["bytes"] += len(data)
            state["n"] += record

        def ready(shard: int) -> None:
            if state["out"] is not None and (state["shard"] != shard or state["bytes"] >= roll):
                close()
                state["file"] = state["file"] + 1 if state["shard"] == shard else 0
            elif state["out"] is None:
                state["file"] = 0
            if state["out"] is None:
                name = f"{prefix}-{shard:06d}-{state['file']:05d}.warc.gz"
                temp = f"{name}.{uuid.uuid4().hex}"
                state.update(shard=shard, name=name, temp=temp, bytes=0, n=0, sum=hashlib.sha1(), out=fs.open_output_stream(f"{root}/_temporary/{temp}", compression=None))
                info = f"software: tabveil\r\nformat: WARC File Format 1.1\r\nisPartOf: {prefix}\r\n".encode()
                put(shard, _record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info), False)

        key, mark, seen = None, None, False
        for part in parts:
            for shard, p, kind, url, html, digest, refers in zip(*(part[c] for c in ("shard", "page_id", "kind", "url", "html", "digest", "refers_to")), strict=True):
                p = None if pd.isna(p) else int(p)
                if (p, digest) != key:
                    key, mark, seen = (p, digest), None, False
                if kind == 0:  # this page's payload has its response elsewhere
                    mark = int(refers)
                    continue
                payload = (html or "").encode("utf-8", "surrogatepass")
                again = mark is not None or seen and len(payload) >= LEAST_REVISIT
                ready(shard)
                put(shard, page_record(p, url, payload, p if mark is None else mark, again))
                seen = True
        close()
        yield pd.DataFrame(done, columns=[c.split()[0] for c in MANIFEST.split(", ")])

    return run


def _commit(folder: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as afs

        fs, root = file_system(folder)
        for part in parts:
            for temp, name, size in zip(part["temp"], part["name"], part["bytes"], strict=True):
                final = fs.get_file_info(f"{root}/{name}")
                if final.type == afs.FileType.NotFound:  # else an earlier attempt of this task has renamed it
                    fs.move(f"{root}/_temporary/{temp}", f"{root}/{name}")
                    final = fs.get_file_info(f"{root}/{name}")
                if final.size != size:
                    raise OSError(f"{name} has {final.size} bytes; the manifest says {size}")
            yield part

    return run


def _key(page_id: str, digest: str):
    """A text that sorts as (page_id, nulls first; digest)."""
    upper = F.lpad(F.hex(F.col(page_id).cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")  # sign bit flipped: unsigned order
    return F.concat(F.coalesce(F.concat(F.lit("1"), upper), F.lit("0")), F.col(digest))


def _placed(small: DataFrame, shard_bytes: int):
    """(number of shards, a function from keys to shards). Keys are added up range by range and then inside each; a key
    goes to the shard that its first byte falls into."""
    spark = small.sparkSession
    keys = small.groupBy(_key("page_id", "digest").alias("key")).agg(F.sum("bytes").alias("bytes"))
    keys = cut(keys.repartitionByRange("key").withColumn("range", F.spark_partition_id()), "warc-keys")
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = keys.groupBy("range").agg(F.sum("bytes").alias("sum")).select("range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))  # a row a partition
    inside = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = keys.withColumn("at", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(F.broadcast(sums), "range")
    starts = placed.groupBy(F.floor((F.col("at") + F.col("offset")) / shard_bytes).alias("shard")).agg(F.min("key").alias("key")).orderBy("key").toArrow()  # a row a shard
    cuts = spark.sparkContext.broadcast(np.array(starts.column("key").to_pylist(), dtype="S57"))

    @F.pandas_udf("int")
    def shard_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts.value, key.to_numpy().astype("S57"), side="right") - 1).astype("int32")

    return max(1, starts.num_rows), shard_of


def write_warc(pages: DataFrame, folder: str, prefix: str = "pages", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) below folder; returns the manifest, a row per file.

    Of rows with equal payloads of LEAST_REVISIT bytes or more the largest page_id is a response, the rest are
    revisits of it. Null html is an empty payload, null url an empty URI. Null page_ids sort first and count as
    the smallest; rows that repeat page_id and payload are one response and revisits of their own page_id. An
    empty table gives an empty manifest. Other columns are ignored. folder must not hold archives yet.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = qualified(spark, folder)
    fs, root = file_system(folder)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    small = cut(pages.select("page_id", F.sha1(raw).alias("digest"), F.octet_length(raw).alias("bytes")), "warc-digests")

    shards, shard_of = _placed(small, shard_bytes)
    same = small.filter(F.col("bytes") >= LEAST_REVISIT).groupBy("digest", "bytes").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null")
    marks = small.join(same, ["digest", "bytes"]).filter("page_id is null or page_id <> refers_to")
    marks = marks.select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to").distinct()
    rows = pages.select("page_id", F.lit(1).alias("kind"), "url", "html", F.sha1(raw).alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    rows = rows.unionByName(marks).withColumn("shard", shard_of(_key("page_id", "digest")))
    n = min(shards, MOST_PARTITIONS)
    rows = rows.repartitionById(n, (F.col("shard").cast("long") * n / shards).cast("int")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "kind", "url")
    written = cut(rows.mapInPandas(_write(folder, prefix, roll_bytes), MANIFEST), "warc-manifest")
    written.repartition(max(1, min(shards, 1000))).mapInPandas(_commit(folder), MANIFEST).orderBy("name").write.parquet(f"{folder}/manifest")
    fs.delete_dir(f"{root}/_temporary")
    return spark.read.parquet(f"{folder}/manifest")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.lower()] = v.strip()
        block = stream.read(int(head["content-length"]))
        if head.get("warc-block-digest", _digest(block)) != _digest(block):
            raise ValueError(f"block digest of {head.get('warc-record-id')} differs")
        yield head, block


def _read(folder: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = file_system(folder)
        names = [c.split()[0] for c in RECORDS.split(", ")]
        number = lambda s: int(s) if s else None
        for part in parts:
            for name in part["name"]:
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in _records(stream):
                        if (kind := head["warc-type"]) not in ("response", "revisit"):
                            continue
                        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if kind == "response" and hashlib.sha1(block.partition(b"\r\n\r\n")[2]).hexdigest() != digest:
                            raise ValueError(f"payload digest of {head['warc-record-id']} differs")
                        rows.append((number(head["x-page-id"]), head["warc-target-uri"], int(head["x-payload-length"]), digest, kind, number(head.get("x-refers-to-page")), name))
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows = []
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return run


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row per response or revisit below folder; block and payload digests are checked while reading."""
    folder = qualified(spark, folder)
    files = spark.read.parquet(f"{folder}/manifest").select("name")
    return files.repartition(max(1, min(files.count(), 10_000))).mapInPandas(_read(folder), RECORDS)
