"""Token ids as binary files with a minimal perfect hash index.

Documents are range-partitioned by id; each task encodes its documents in ascending order and streams the raw ids into one
file of the shared folder (a 16-byte header, then unsigned little-endian integers of 2 or 4 bytes). A file's name holds the
task attempt, and only the attempt whose rows are committed is named in the table of entries, so lost executors, retries and
speculative tasks leave no harm.

The index maps a key (id, and its ordinal where an id repeats) to file, offset and length. Keys are hashed to 128 bits and dealt
to index blocks of about ``BLOCK`` keys; each block gets its own minimal perfect hash by hash-and-displace: keys fall into small
buckets, each bucket gets the first pilot that sends its keys to free slots of a table a little larger than the block, and slots
beyond the block's size are remapped to the gaps. A slot stores a 64-bit fingerprint from the other half of its key's hash, so that
foreign keys are recognised (but for one in 2**64), and one lookup costs one pilot, one slot and one ranged read. Keys of a block
that agree in the half that places them, or in both, are listed with their text beside the slots and looked up there.

Ordinals of a repeated id are counted in the tasks that write it; what earlier files hold of it is added from counts by file, so a
frequent id (null ids, say) never meets in one task.

Defined results: a null text counts as empty and holds the end id only; null ids come first and differ from any text; rows that
repeat an id are stored in the order of their texts' hashes; ids may be of any type that sorts; an empty table gives no files and
no rows.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from admeridian.llm.common import fresh_path, one_by_one, staged, text_or_empty, tidy
from admeridian.llm.segments import encoder

END_ID, FILE_BYTES, BLOCK, READ_BYTES, HEADER = 2, 32 << 20, 20_000, 8 << 20, 16
MAGIC = b"ADMTOK01"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _filesystem(uri: str):
    """Any store pyarrow knows (a plain path, file://, hdfs://, s3://, gs://)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + uri if uri.startswith("/") else uri)


@dataclass
class TokenFiles:
    folder: str
    width: int
    entries: DataFrame  # doc_id, ordinal, shard, file, start (ids before it in the file), n_tokens
    index: DataFrame  # one row per block


def write_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, width: int = 2, file_bytes: int = FILE_BYTES) -> TokenFiles:
    """Encodes and writes all documents; ``width`` is 2 for vocabularies of at most 65,536 ids, else 4."""
    path = path or tokenizer_path()
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    slim = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["doc_id", "tie"]
    ranged = slim.withColumn("tie", F.xxhash64("text")).repartitionByRange(int(total // file_bytes) + 1, *order).sortWithinPartitions(*order)

    def write(batches):
        from pyspark import TaskContext

        encode = encoder(path, True, width).encode
        end = int(end_id).to_bytes(width, "little")
        shard = TaskContext.get().partitionId()
        name, out, at, last, same = f"ids-{shard:06d}-{uuid.uuid4().hex}.bin", None, 0, (), 0
        store, base = _filesystem(folder)
        try:
            for batch in batches:
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", buffer_size=1 << 20)
                    out.write(MAGIC + width.to_bytes(4, "little") + bytes(4))
                starts, lengths, places = [], [], []
                for key, text in zip(one_by_one(batch.column(0)), one_by_one(batch.column(1)), strict=True):
                    same, last = (same + 1 if last == (key,) else 0), (key,)
                    places.append(same)
                    payload = encode(text) + end
                    out.write(payload)
                    starts.append(at)
                    lengths.append(len(payload) // width)
                    at += lengths[-1]
                n = batch.num_rows
                columns = [batch.column(0), pa.array([shard] * n, pa.int32()), pa.array([name] * n), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(places, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shard", "file", "start", "n_tokens", "place"])
        finally:
            if out is not None:
                out.close()
            tidy()

    entries = staged(ranged.mapInArrow(write, f"doc_id {kind}, shard int, file string, start long, n_tokens long, place long"), "entries")
    entries = with_ordinals(entries)
    return TokenFiles(folder, width, entries, staged(build_index(entries), "index"))


def with_ordinals(entries: DataFrame) -> DataFrame:
    """``ordinal`` of each row among those of its id: its place in its file, and what earlier files hold of the id."""
    ends = F.min(F.struct("start", "doc_id")).alias("first"), F.max(F.struct("start", "doc_id", "place")).alias("last")
    files = entries.groupBy("shard").agg(*ends).select("shard", F.col("first.doc_id").alias("again"), F.col("last.doc_id").alias("last"), (F.col("last.place") + 1).alias("n"))
    # one row per file; an id goes on in the next file only if it ends one
    files = files.withColumn("so_far", F.sum("n").over(Window.partitionBy("last").orderBy("shard")))
    order = Window.partitionBy(F.lit(0)).orderBy("shard")
    files = files.select(F.col("shard").alias("to"), "again", F.lag("last").over(order).alias("last"), F.lag("so_far").over(order).alias("before"))
    before = files.filter("before IS NOT NULL AND again <=> last").select("to", "again", "before")
    joined = entries.join(before, (F.col("shard") == F.col("to")) & F.col("doc_id").eqNullSafe(F.col("again")), "left")
    return joined.select("doc_id", "shard", "file", "start", "n_tokens", (F.col("place") + F.coalesce("before", F.lit(0))).cast("long").alias("ordinal"))


# --- the index ---


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def _unsigned(x) -> np.ndarray:
    return np.asarray(x, np.int64).view(np.uint64)


def build_block(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pilots, remap, slot of each key) of the distinct 64-bit hashes ``h``; slots are exactly 0..len(h)-1."""
    n = len(h)
    table = max(n, int(n / 0.95) + 1)
    n_buckets = n // 4 + 1
    bucket = (_mix(h) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=n_buckets)
    starts = np.cumsum(sizes) - sizes
    free = np.ones(table, np.bool_)
    pilots, slots = np.zeros(n_buckets, np.int64), np.zeros(n, np.int64)
    for b in np.argsort(-sizes, kind="stable"):
        if not sizes[b]:
            break
        rows = order[starts[b] : starts[b] + sizes[b]]
        at, tries = 0, 32
        while True:
            seeds = _mix(np.arange(at, at + tries, dtype=np.uint64) + np.uint64(1))
            spots = (_mix(h[rows][None, :] ^ seeds[:, None]) % np.uint64(table)).astype(np.int64)
            good = free[spots].all(axis=1)
            if len(rows) > 1:
                s = np.sort(spots, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if (hit := good.nonzero()[0]).size:
                pilots[b] = at + hit[0]
                slots[rows] = spots[hit[0]]
                free[spots[hit[0]]] = False
                break
            at, tries = at + tries, min(2 * tries, 4096)
    remap = np.zeros(table - n, np.int64)
    beyond = (~free[n:]).nonzero()[0]
    remap[beyond] = free[:n].nonzero()[0][: len(beyond)]
    high = slots >= n
    slots[high] = remap[slots[high] - n]
    return pilots, remap, slots


def slots_of(h: np.ndarray, n: int, pilots: np.ndarray, remap: np.ndarray) -> np.ndarray:
    table = n + len(remap)
    bucket = (_mix(h) % np.uint64(len(pilots))).astype(np.int64)
    seeds = _mix(pilots[bucket].astype(np.uint64) + np.uint64(1))
    slots = (_mix(h ^ seeds) % np.uint64(table)).astype(np.int64)
    high = slots >= n
    slots[high] = remap[slots[high] - n]
    return slots


def _hashed(keys: DataFrame, blocks: int) -> DataFrame:
    """``key`` (the id, marked if null, and the ordinal), ``h`` that places it, ``mark`` that knows it, and its ``block``."""
    key = F.concat(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("null")), F.lit("#"), F.col("ordinal").cast("string"))
    half = lambda at: F.conv(F.substring(F.md5("key"), at, 16), 16, -10).cast("long")
    keys = keys.withColumn("key", key).withColumns({"h": half(1), "mark": half(17)})
    return keys.withColumn("block", F.pmod(F.shiftright("h", 20), F.lit(blocks)).cast("int"))


INDEX = "block int, blocks int, n int, pilots array<long>, remap array<long>, mark array<long>, shard array<int>, start array<long>, n_tokens array<long>, file array<string>, file_no array<int>, listed array<string>"


def build_index(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per block with its pilots and, slot by slot, fingerprint, file, start and length. The keys in ``listed`` share
    their hash with another one; their entries stand behind the slots, in the order of the list."""
    blocks = int(entries.count() // block) + 1

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        again = rows["h"].duplicated(keep=False).to_numpy()
        rows = pd.concat([rows[~again], rows[again]])
        n = int((~again).sum())
        pilots, remap, slots = build_block(_unsigned(rows["h"].iloc[:n]))
        back = np.concatenate([np.argsort(slots), np.arange(n, len(rows))])
        files, file_no = np.unique(rows["file"].to_numpy(str), return_inverse=True)
        own = lambda x: np.asarray(x)[back].tolist()
        return pd.DataFrame([[rows["block"].iloc[0], blocks, n, pilots.tolist(), remap.tolist(), own(rows["mark"]), own(rows["shard"]), own(rows["start"]), own(rows["n_tokens"]), files.tolist(), own(file_no), rows["key"].iloc[n:].tolist()]], columns=[x.split()[0] for x in INDEX.split(", ")])

    keyed = _hashed(entries.select("doc_id", "ordinal", "shard", "file", "start", "n_tokens"), blocks)
    # the text of a key is needed only where its hash repeats
    return keyed.select("block", "h", "mark", "key", "shard", "file", "start", "n_tokens").groupBy("block").applyInPandas(build, INDEX)


def lookup(keys: DataFrame, files: TokenFiles) -> DataFrame:
    """``keys`` (doc_id, ordinal) with ``shard, file, start, n_tokens`` of those that the index holds."""
    first = files.index.select("blocks").first()
    hashed = _hashed(keys.select("doc_id", "ordinal"), first[0] if first else 1)
    kind = keys.schema["doc_id"].dataType.simpleString()

    def find(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            rows = rows.slice(0, 0)
        b = blocks.slice(0, 1).to_pydict()
        take = lambda k: np.array(b[k][0], np.int64)
        h = _unsigned(rows.column("h").to_numpy())
        if not len(h):
            ints = pa.array([], pa.int64())
            return pa.table({"doc_id": rows.column("doc_id"), "shard": ints.cast(pa.int32()), "file": pa.array([], pa.string()), "start": ints, "n_tokens": ints})
        n, listed = b["n"][0], {key: b["n"][0] + i for i, key in enumerate(b["listed"][0])}
        slots, marks = np.full(len(h), -1, np.int64), take("mark")
        if n:
            spots = slots_of(h, n, take("pilots"), take("remap"))
            slots = np.where(marks[spots] == rows.column("mark").to_numpy(), spots, slots)
        if listed:
            slots = np.array([listed.get(key, slot) for key, slot in zip(rows.column("key").to_pylist(), slots, strict=True)], np.int64)
        good = slots >= 0
        slots = slots[good]
        names = np.array(b["file"][0], object)[take("file_no")[slots]]
        return pa.table({"doc_id": rows.column("doc_id").filter(pa.array(good)), "shard": pa.array(take("shard")[slots], pa.int32()), "file": pa.array(names, pa.string()), "start": pa.array(take("start")[slots]), "n_tokens": pa.array(take("n_tokens")[slots])})

    return hashed.groupBy("block").cogroup(files.index.groupBy("block")).applyInArrow(find, f"doc_id {kind}, shard int, file string, start long, n_tokens long")


def read_payloads(places: DataFrame, files: TokenFiles) -> DataFrame:
    """``doc_id, shard, start, n_tokens, ids_crc32`` of looked-up places, by ranged reads; neighbours share one read."""
    folder, width = files.folder, files.width
    kind = places.schema["doc_id"].dataType.simpleString()

    def read(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("start")
        starts, lengths = rows.column("start").to_numpy(), rows.column("n_tokens").to_numpy()
        store, base = _filesystem(folder)
        sums, at = [], 0
        with store.open_input_file(f"{base}/{rows.column('file')[0].as_py()}") as f:
            if f.read_at(HEADER, 0)[:8] != MAGIC:
                raise ValueError("not a file of token ids")
            while at < len(starts):
                to = max(at + 1, int(np.searchsorted(starts, starts[at] + READ_BYTES // width)))
                low, high = starts[at], starts[to - 1] + lengths[to - 1]
                block = np.frombuffer(f.read_at(int(high - low) * width, HEADER + int(low) * width), f"<u{width}")
                if len(block) < high - low:
                    raise ValueError("a file of token ids is too short")
                for s, n in zip(starts[at:to] - low, lengths[at:to], strict=True):
                    sums.append(zlib.crc32(block[s : s + n].astype("<u4").tobytes()))
                at = to
        return rows.select(["doc_id", "shard", "start", "n_tokens"]).append_column("ids_crc32", pa.array(sums, pa.int64()))

    return places.groupBy("file").applyInArrow(read, f"doc_id {kind}, shard int, start long, n_tokens long, ids_crc32 long")


def stored_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Writes all documents, then reads each back by key: ``doc_id, start, n_tokens, ids_crc32``."""
    files = write_files(docs, id_col, text_col, **options)
    found = read_payloads(lookup(files.entries.select("doc_id", "ordinal"), files), files)
    totals = files.entries.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row per file
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return found.join(offsets, "shard").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
