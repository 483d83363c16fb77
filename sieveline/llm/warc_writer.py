"""A deterministic, sharded WARC writer and its reader.

Pages are range-sorted by id into shards whose bounds depend on the ids alone. A task writes each of its shards as a
series of files, rolled by compressed size, under temporary names; headers, record ids and digests are regenerated
from the page, so a repeated task writes the same bytes. What tasks report is kept as a manifest; committing renames
the files it lists and drops whatever failed attempts left. One gzip member holds one record.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm._shared import partitions, work_path, written

#: Equal payloads of at least so many bytes are written once; later pages revisit the first.
MIN_REVISIT_BYTES = 100
ROLL_BYTES = 16 << 20
SHARD_BYTES = 256 << 20
#: Ids for each shard from which the shards' bounds are taken, about, and at least for all (every page is written all the same).
BOUND_IDS, LEAST_BOUND_IDS = 16, 50_000
#: Bytes of an archive that are unpacked at once.
UNPACKED_BYTES = 64 << 10
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard namespace of addresses


def record_id(page_id: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None, level: int) -> bytes:
    """One compressed record. A revisit keeps the HTTP headers, whose length tells the payload's; control characters of the address, which would break the header, are left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(c for c in url if c >= " ")),
        ("X-Page-ID", str(page_id)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to)), ("WARC-Profile", PROFILE)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)  # a gzip member without name or time
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _writer(folder: str, roll_bytes: int, level: int):
    names = ["shard", "part", "temporary", "n_records", "n_bytes", "sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        attempt = uuid.uuid4().hex
        shard, part, name, out, count, size, digest = None, 0, "", None, 0, 0, None
        at, first, seen = None, {}, set()  # of the page at hand: first pages by digest, digests written

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([name]), pa.array([count], pa.int64()), pa.array([size], pa.int64()), pa.array([digest.hexdigest()])], names=names)

        for batch in batches:
            for s, page, url, html, sha, refers in zip(*(batch.column(c) for c in range(6))):
                if (page := page.as_py()) != at:
                    at, first, seen = page, {}, set()
                if refers.is_valid:
                    first[sha.as_py()] = refers.as_py()
                    continue
                html = (html.as_py() or "").encode("utf-8", "surrogatepass")
                sha = hashlib.sha256(html).hexdigest()
                refers = first.get(sha)
                if refers == page and sha not in seen:  # rows that repeat the first page revisit it
                    seen.add(sha)
                    refers = None
                packed = record(page, url.as_py() or "", html, sha, refers, level)
                if out is not None and (s.as_py() != shard or size + len(packed) > roll_bytes):
                    yield close()
                    part = part + 1 if s.as_py() == shard else 0
                    out = None
                if out is None:
                    shard = s.as_py()
                    name = f"_temporary/{attempt}/{shard:05d}-{part:05d}.warc.gz"
                    fs.create_dir(f"{root}/_temporary/{attempt}", recursive=True)
                    out, count, size, digest = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0, hashlib.sha256()
                out.write(packed)
                digest.update(packed)
                count, size = count + 1, size + len(packed)
        if out is not None:
            yield close()

    return run


def _renamed(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("name").to_pylist()):
                if fs.get_file_info(f"{root}/{temporary}").type == pyarrow.fs.FileType.File:  # else an earlier attempt has moved it
                    fs.move(f"{root}/{temporary}", f"{root}/{name}")
                elif fs.get_file_info(f"{root}/{name}").type != pyarrow.fs.FileType.File:
                    raise FileNotFoundError(name)
            yield batch.select(["name"])

    return run


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload of ``MIN_REVISIT_BYTES`` occurs more than once; the first page refers to itself."""
    digests = pages.where(F.octet_length("html") >= MIN_REVISIT_BYTES).select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "refers_to")
    first = written(first, "warc-firsts")  # a table, so the join can split the pages of a payload that very many share
    return digests.join(first, "digest").select("page_id", "digest", "refers_to").distinct()


def bounds(pages: DataFrame, id_col: str, shards: int) -> list[int]:
    """Ids that start the second and later shards, at equal ranks of a sample chosen by the ids' hashes; none for an empty table, null ids don't count."""
    ids = pages.select(F.col(id_col).cast("long").alias("i")).where("i is not null")
    every = max(1, ids.count() // max(LEAST_BOUND_IDS, BOUND_IDS * shards))
    some = sorted(r[0] for r in ids.where(F.pmod(F.xxhash64("i"), F.lit(every)) == 0).distinct().collect())
    return sorted({some[len(some) * k // shards] for k in range(1, shards)} - {some[0]}) if some else []


def shard_of(page_id: str, starts: list[int]) -> Column:
    """How many of the ascending ``starts`` a column reaches: looked up among every so many of them first, then among those that follow."""
    if not starts:
        return F.lit(0)
    step = math.isqrt(len(starts) - 1) + 1
    groups = [starts[i : i + step] for i in range(0, len(starts), step)]
    listed = lambda xs: f"array({','.join(f'{x}L' if x > -(2**63) else '-9223372036854775807L - 1L' for x in xs)})"
    reached = lambda xs: f"size(filter({xs}, b -> b <= {page_id}))"
    group = reached(listed(g[0] for g in groups))
    return F.expr(f"CASE WHEN {page_id} < {listed(starts[:1])}[0] THEN 0 ELSE ({group} - 1) * {step} + {reached(f'element_at(array({",".join(map(listed, groups))}), {group})')} END")


def write(
    pages: DataFrame, to: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shards: int | None = None, roll_bytes: int = ROLL_BYTES, level: int = 6
) -> str:
    """Writes the archives and their manifest, and returns the folder.

    A null page is an empty payload, a null address an empty one; rows whose id is null are left out. Rows that repeat
    an id are records of their own: the first with a payload is the response, the others revisit it. An empty table
    gives an empty manifest; further columns are ignored.
    """
    spark = pages.sparkSession
    to = to or work_path(spark, "warc")
    if shards is None:
        total = pages.agg(F.sum(F.octet_length(html_col))).first()[0] or 0
        shards = max(partitions(spark), -(-total // SHARD_BYTES))
    starts = bounds(pages, id_col, shards)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).where("page_id is not null")
    # what a page refers to travels as a row before it, so the payloads are dealt once and joined with nothing
    told = revisits(rows).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to")
    both = told.unionByName(rows.withColumn("digest", F.lit(None).cast("string")).withColumn("refers_to", F.lit(None).cast("long"))).withColumn("shard", shard_of("page_id", starts).cast("int"))
    dealt = both.repartitionById(len(starts) + 1, "shard").sortWithinPartitions("shard", "page_id", F.desc_nulls_last("refers_to"), "url", "html").select("shard", "page_id", "url", "html", "digest", "refers_to")
    files = dealt.mapInArrow(_writer(to, roll_bytes, level), "shard int, part int, temporary string, n_records long, n_bytes long, sha256 string")
    manifest = written(files, "warc-manifest").withColumn("name", F.format_string("part-%05d-%05d.warc.gz", "shard", "part"))
    commit(manifest, to)
    return to


def commit(manifest: DataFrame, to: str) -> None:
    """Renames what the manifest lists, writes the manifest itself, and drops the temporary folder. May be repeated."""
    moved = manifest.repartition(partitions(manifest.sparkSession)).mapInArrow(_renamed(to), "name string")
    moved.agg(F.count(F.lit(1))).collect()
    manifest.drop("temporary").coalesce(1).sortWithinPartitions("shard", "part").write.mode("overwrite").json(f"{to}/manifest")
    fs, root = pyarrow.fs.FileSystem.from_uri(to)
    if fs.get_file_info(f"{root}/_temporary").type == pyarrow.fs.FileType.Directory:
        fs.delete_dir(f"{root}/_temporary")


def members(archive: bytes) -> Iterator[bytes]:
    """What each gzip member of an archive holds, in time that grows with its bytes alone."""
    view, at = memoryview(archive), 0
    while at < len(view):
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a record")
            out.append(unpacker.decompress(view[at : at + UNPACKED_BYTES]))
            at += min(UNPACKED_BYTES, len(view) - at) - len(unpacker.unused_data)
        yield b"".join(out)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Header fields, HTTP headers and body of each record of an archive; none for an empty one, an error for a broken one."""
    for raw in members(archive):
        head, _, tail = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no WARC record")
        fields = dict(line.split(": ", 1) for line in lines)
        block = tail[: int(fields["Content-Length"])]
        if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:"):
            raise ValueError(f"the block of {fields['WARC-Record-ID']} doesn't match its digest")
        http, _, body = block.partition(b"\r\n\r\n")
        yield fields, http, body


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            out: list[tuple] = []
            for fields, http, body in parse(content.as_py()):
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                    raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't match its digest")
                size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
                refers = fields.get("X-Refers-To-Page-ID")
                out.append((int(fields["X-Page-ID"]), fields.get("WARC-Target-URI", ""), size, digest, kind, refers and int(refers), body.decode("utf-8", "replace") if kind == "response" else None))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate(kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).

    Block digests and the payload digests of responses are verified.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder).select("content")
    return files.mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")
