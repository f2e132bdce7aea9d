"""WARC archives compressed with Zstandard: one frame per record, a dictionary in the leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from freshet.functions.series import salted_lookup
from freshet.session import checkpoint_root, discard, materialize

FORMAT = "warc_zst"
SUFFIX = ".warc.zst"
# Fixed values of the Zstandard and WARC formats.
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_FRAME_MAGIC = b"\x5d\x2a\x4d\x18"
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
DICTIONARY_ID_BYTES = (0, 1, 2, 4)
CONTENT_SIZE_BYTES = (0, 2, 4, 8)
BREAK = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SOURCE_ID = "warc-x-source-id"

LEAST_BYTES = 1000
FILE_BYTES = 256 << 20
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 32 << 10
BATCH_BYTES = 4 << 20
LOOKUP_ROWS = 100_000
COPY_BLOCK = 4096

SCHEMA = (
    "record_id string, record_type string, target_uri string, source_id bigint, refers_to string, "
    "payload_bytes bigint, payload_digest string, payload binary"
)
_ARROW = pa.schema(
    [
        ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("source_id", pa.int64()),
        ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
    ]
)


class WarcError(ValueError):
    """A frame, header, length or digest of an archive that does not hold."""


# ---- bytes of one record ----


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(row: dict, date: str) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP header alone, and the digest of the payload it refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + (row["payload"] or b"")
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:uuid:{row['record_id']}>", f"WARC-Date: {date}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_field(row['target_uri'])}")
    if row["source_id"] is not None:
        lines.append(f"WARC-X-Source-ID: {row['source_id']}")
    if row["refers_to"] is not None:
        lines += [f"WARC-Refers-To: <urn:uuid:{row['refers_to']}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    lines += [
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: {_sha1(block)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + BREAK + block + BREAK


def _hex(digest: str) -> str:
    """Bare lower-case hex of a `sha1:` header value, which may be Base32 or hex."""
    algorithm, _, value = digest.partition(":")
    if algorithm.lower() != "sha1":
        raise WarcError(f"digest algorithm {algorithm!r}")
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def _headers(lines: list[bytes]) -> dict[str, str]:
    found = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"header line {line[:80]!r}")
        found[name.strip().lower().decode()] = value.strip().decode()
    return found


def _bare(identifier: str | None) -> str | None:
    return identifier if identifier is None else identifier.strip("<>").removeprefix("urn:uuid:")


def parse_record(data: bytes) -> dict:
    """Fields of one record, after its version, mandatory headers, lengths and digests were checked."""
    head, found, rest = data.partition(BREAK)
    first, *lines = head.split(b"\r\n")
    if not found or first not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"version line {first[:40]!r}")
    fields = _headers(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"no {name} header")
    length = int(fields["content-length"]) if fields["content-length"].isdigit() else -1
    if len(rest) != length + len(BREAK) or not rest.endswith(BREAK):
        raise WarcError(f"block of {len(rest) - len(BREAK)} bytes, header says {fields['content-length']}")
    block = rest[:length]
    if "warc-block-digest" in fields and _hex(fields["warc-block-digest"]) != hashlib.sha1(block).hexdigest():
        raise WarcError("block digest")
    kind, payload, size = fields["warc-type"], block, length
    if fields.get("content-type", "").startswith("application/http"):
        http, cut, payload = block.partition(BREAK)
        if not cut:
            raise WarcError("HTTP header without end")
        declared = _headers(http.split(b"\r\n")[1:]).get("content-length")
        size = int(declared) if declared is not None else len(payload)
        if kind != "revisit" and size != len(payload):
            raise WarcError(f"payload of {len(payload)} bytes, HTTP header says {size}")
    digest = _hex(fields["warc-payload-digest"]) if "warc-payload-digest" in fields else None
    if kind == "revisit":
        payload = None
    else:
        own = hashlib.sha1(payload).hexdigest()
        if digest not in (None, own):
            raise WarcError("payload digest")
        digest = own
    source = fields.get(SOURCE_ID)
    return {
        "record_id": _bare(fields["warc-record-id"]), "record_type": kind, "target_uri": fields.get("warc-target-uri"),
        "source_id": int(source) if source is not None else None, "refers_to": _bare(fields.get("warc-refers-to")),
        "payload_bytes": size, "payload_digest": digest, "payload": payload,
    }


# ---- frames of one file ----


def _exactly(stream, count: int) -> bytes:
    data = stream.read(count)
    if len(data) != count:
        raise WarcError(f"file ends {count - len(data)} bytes early")
    return data


def _number(data: bytes) -> int:
    return int.from_bytes(data, "little")


def frames(stream) -> Iterator[tuple[bool, bytes]]:
    """(skippable, bytes) of each frame in turn, found by its block headers; only one frame is held at a time.

    Of a skippable frame the bytes are its content and only the dictionary's kind is given out.
    """
    while magic := stream.read(4):
        if len(magic) == 4 and magic[1:] == DICTIONARY_FRAME_MAGIC[1:] and magic[0] >> 4 == 5:
            content = _exactly(stream, _number(_exactly(stream, 4)))
            if magic == DICTIONARY_FRAME_MAGIC:
                yield True, content
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"frame magic {magic.hex()}")
        flags = _exactly(stream, 1)
        single = flags[0] >> 5 & 1
        size_bytes = CONTENT_SIZE_BYTES[flags[0] >> 6] or single
        parts = [magic, flags, _exactly(stream, (not single) + DICTIONARY_ID_BYTES[flags[0] & 3] + size_bytes)]
        last = False
        while not last:
            header = _exactly(stream, 3)
            bits = _number(header)
            last, kind, size = bool(bits & 1), bits >> 1 & 3, bits >> 3
            parts += [header, _exactly(stream, 1 if kind == 1 else size)]
        parts.append(_exactly(stream, 4 if flags[0] >> 2 & 1 else 0))
        yield False, b"".join(parts)


def read_records(stream, strict: bool = True) -> Iterator[dict]:
    """The records of one archive. What cannot be read raises, or is left out if not `strict`.

    A frame that does not decode or parse costs that record; broken frame borders end the file.
    """
    import zstandard

    plain = zstandard.ZstdDecompressor()
    decoder, leading = plain, True
    walk = frames(stream)
    while True:
        try:
            item = next(walk, None)
        except WarcError:
            if strict:
                raise
            return
        if item is None:
            return
        skippable, data = item
        if skippable:
            if leading:
                if data[:4] == FRAME_MAGIC:
                    data = plain.decompressobj().decompress(data)
                if data[:4] != DICTIONARY_MAGIC:
                    raise WarcError("leading frame holds no dictionary")
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
            leading = False
            continue
        leading = False
        try:
            record = decoder.decompressobj().decompress(data)
            size = zstandard.frame_content_size(data)
            if size not in (-1, len(record)):
                raise WarcError(f"frame of {len(record)} bytes, header says {size}")
            yield parse_record(record)
        except (WarcError, UnicodeDecodeError, zstandard.ZstdError) as error:
            if strict:
                raise WarcError(str(error)) from error


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes | None:
    """A dictionary for records like `samples`, or None where they are too few or too short for one."""
    import zstandard

    try:
        # fixed segment and hash sizes keep the trainer from trying many
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return None


def write_records(out, records: Iterator[bytes], dictionary: bytes | None) -> None:
    """A leading skippable frame with the compressed dictionary, then one checksummed frame per record."""
    import zstandard

    trained = None
    if dictionary is not None:
        held = zstandard.ZstdCompressor().compress(dictionary)
        out.write(DICTIONARY_FRAME_MAGIC + len(held).to_bytes(4, "little") + held)
        trained = zstandard.ZstdCompressionDict(dictionary)
    coder = zstandard.ZstdCompressor(dict_data=trained, write_checksum=True, write_content_size=True)
    for record in records:
        out.write(coder.compress(record))


# ---- the Spark source ----


@dataclass
class Archive(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class WarcSource(DataSource):
    """`spark.read/write.format("warc_zst")` with `path`; columns as in SCHEMA.

    Reading takes one task per archive and holds one record and one batch at a time. `payload=false`
    leaves payloads out after they were checked; `mode=permissive` leaves out records that fail a
    check, where the default raises. Tasks write to a folder of attempts, and files move to their
    place when the job commits, so lost and repeated tasks leave no record behind.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.strict = str(options.get("mode", "failfast")).lower() != "permissive"

    def partitions(self):
        from pyarrow import fs

        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [Archive(f.path) for f in found if f.is_file and f.path.endswith(SUFFIX)] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = _store(self.path)
        rows, held = [], 0
        with store.open_input_stream(partition.path, compression=None, buffer_size=1 << 20) as stream:
            try:
                for record in read_records(stream, self.strict):
                    held += len(record["payload"] or b"") + 300 if self.payload else 300
                    rows.append(record if self.payload else record | {"payload": None})
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
            except WarcError as error:
                raise WarcError(f"{partition.path}: {error}") from error
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.date = options.get("date", "2000-01-01T00:00:00Z")
        self.limit = int(options.get("filebytes", FILE_BYTES))
        self.attempts = f"_attempts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        store.create_dir(f"{root}/{self.attempts}")
        names = []
        records = (record_bytes(row, self.date) for batch in iterator for part in _parts(batch) for row in part.to_pylist())
        sample = _sample(records)
        dictionary = train_dictionary(sample)
        while sample:
            names.append(f"{uuid.uuid4().hex}{SUFFIX}")
            with store.open_output_stream(f"{root}/{self.attempts}/{names[-1]}", compression=None) as out:
                write_records(out, _upto(out, sample, records, self.limit), dictionary)
            sample = [r for r in [next(records, None)] if r is not None]
        return Written(tuple(names))

    def commit(self, messages) -> None:
        store, root = _store(self.path)
        for message in messages:
            for name in message.names if message else ():
                store.move(f"{root}/{self.attempts}/{name}", f"{root}/{name}")
        self._clear(store, root)

    def abort(self, messages) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store, root) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/{self.attempts}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.attempts}")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, some megabytes at a time."""
    step = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def _sample(records: Iterator[bytes], size: int = SAMPLE_BYTES) -> list[bytes]:
    """The first records of a task, of about `size` bytes: they train the dictionary and are then written."""
    taken, held = [], 0
    for record in records:
        taken.append(record)
        held += len(record)
        if held >= size:
            break
    return taken


def _upto(out, first: list[bytes], records: Iterator[bytes], limit: int) -> Iterator[bytes]:
    """`first` and then more records until the file holds `limit` bytes."""
    yield from first
    while out.tell() < limit:
        record = next(records, None)
        if record is None:
            return
        yield record


# ---- tables to archives and back ----


def _uuid(*parts: Column) -> Column:
    """A name-based identifier of the parts."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def response_holders(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(sha, holder, holder_rows) for each payload of at least `least` bytes that several rows have.

    Payloads are told apart by SHA-256. Counts combine before each shuffle, so a payload that very
    many pages share is no hot group.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    large = pages.where(F.octet_length(payload) >= least)
    per_page = large.groupBy(F.unhex(F.sha2(payload, 256)).alias("sha"), "page_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_page.groupBy("sha")
        .agg(
            F.sum("n").alias("rows"), F.max("page_id").alias("holder"),
            F.coalesce(F.max_by("n", "page_id"), F.sum("n")).alias("holder_rows"),
        )
        .where("rows > 1")
        .drop("rows")
    )


def page_records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """A record (SCHEMA) for every row of `pages` (page_id, url, html).

    Of rows with equal payloads of at least `least` bytes, the one with the largest page_id is the
    response and the others revisit it; smaller payloads are always responses. A null html is an empty
    payload. Null page_ids count as smaller than all others; of repeated rows that all have the largest
    page_id, one is the response. A null url leaves its header out. Other columns are ignored, and an
    empty table gives no records.
    """
    holders = materialize(response_holders(pages, least).select(F.col("sha").alias("sha_"), "holder", "holder_rows"))
    counted = holders.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(F.col("holder_rows") > 1), F.lit(False)).alias("again")).first()
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").alias("source_id"), F.col("url").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("sha_", F.unhex(F.sha2("payload", 256)))
    if counted.n <= LOOKUP_ROWS:  # some dozens of bytes a row
        placed = rows.join(F.broadcast(holders), "sha_", "left")
    else:
        placed = salted_lookup(rows, holders, ["sha_"], ["source_id"])
    shared = F.col("holder_rows").isNotNull()
    holds = F.col("source_id").eqNullSafe(F.col("holder"))
    placed = placed.withColumn("record_type", F.when(shared & ~holds, "revisit").otherwise("response"))
    if not counted.again:
        return _records(placed)
    # Repeated rows of a holder: one carries the payload, the others are counted and revisit it.
    repeated = shared & holds & (F.col("holder_rows") > 1)
    heads = (
        placed.where(repeated)
        .groupBy("sha_", "source_id", "holder", "holder_rows")
        .agg(F.min("target_uri").alias("target_uri"), F.any_value("payload").alias("payload"), F.count(F.lit(1)).alias("n"))
        .withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha1("payload")})
    )
    blocks = F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / COPY_BLOCK) - 1)
    inside = F.sequence(F.col("block") * COPY_BLOCK, F.least(F.col("n"), (F.col("block") + 1) * COPY_BLOCK) - 1)
    laid = heads.select("*", F.explode(blocks).alias("block")).withColumn("payload", F.when(F.col("block") == 0, F.col("payload")))
    copies = laid.select("*", F.explode(inside).alias("copy")).withColumns(
        {
            "record_type": F.when(F.col("copy") == 0, "response").otherwise("revisit"),
            "payload": F.when(F.col("copy") == 0, F.col("payload")),
        }
    )
    return _records(placed.where(~repeated)).unionByName(_records(copies))


def _records(placed: DataFrame) -> DataFrame:
    response = F.col("record_type") == "response"
    held = _uuid(F.hex("sha_"), F.col("holder"))
    size = F.col("payload_bytes") if "payload_bytes" in placed.columns else F.octet_length("payload").cast("bigint")
    digest = F.col("payload_digest") if "payload_digest" in placed.columns else F.sha1("payload")
    shared = F.col("holder_rows").isNotNull()
    return placed.select(
        F.when(response & shared, held).otherwise(F.uuid()).alias("record_id"), "record_type", "target_uri", "source_id",
        F.when(~response, held).alias("refers_to"), size.alias("payload_bytes"), digest.alias("payload_digest"),
        F.when(response, F.col("payload")).alias("payload"),
    )


def write_archives(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Append `records` (SCHEMA) to the archives under `path`, one file or more per task."""
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format(FORMAT).option("fileBytes", str(file_bytes)).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True, strict: bool = True) -> DataFrame:
    """All records (SCHEMA) of the archives under `path`, each checked."""
    spark.dataSource.register(WarcSource)
    mode = "failfast" if strict else "permissive"
    return spark.read.format(FORMAT).option("payload", str(payload).lower()).option("mode", mode).load(path)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """`records` with `response_id`, the source_id of the response that a revisit refers to.

    A revisit must find its response, with its digest and length; else the job fails.
    """
    answers = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("source_id").alias("response_id"),
        F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"),
    )
    revisits = records.where("record_type = 'revisit'").join(answers, "refers_to", "left")
    same = (F.col("_digest") == F.col("payload_digest")) & (F.col("_bytes") == F.col("payload_bytes"))
    wrong = F.raise_error(F.concat(F.lit("revisit without its response: "), F.col("record_id"))).cast("bigint")
    checked = revisits.withColumn("response_id", F.when(F.coalesce(same, F.lit(False)), F.col("response_id")).otherwise(wrong))
    rest = records.where("record_type <> 'revisit'").withColumn("response_id", F.lit(None).cast("bigint"))
    return rest.unionByName(checked.drop("_digest", "_bytes").select(*rest.columns))


def archive_pages(pages: DataFrame, path: str | None = None, least: int = LEAST_BYTES) -> DataFrame:
    """Write `pages` as archives, read them back and give a row per page: page_id, payload_bytes,
    payload_digest, record_type, refers_to (the page_id of a revisit's response), target_uri.

    The archives stay under `path`, by default a folder of its own under the checkpoint folder.
    """
    spark = pages.sparkSession
    path = path or f"{checkpoint_root(spark)}/freshet-warc-{uuid.uuid4().hex}"
    write_archives(page_records(pages, least), path)
    records = materialize(read_archives(spark, path, payload=False).drop("payload"))
    return resolve_revisits(records).select(
        F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("response_id").alias("refers_to"), "target_uri",
    )


ORACLE = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
o AS (SELECT *, strlen(html) AS b, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS k,
             max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, b AS payload_bytes, sha1(html) AS payload_digest, url AS target_uri,
       CASE WHEN b >= {LEAST_BYTES} AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b >= {LEAST_BYTES} AND k > 1 THEN top END AS refers_to
FROM o
"""
