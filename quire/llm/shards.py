"""Training order: token sequences at keyed pseudo-random slots of fixed-stride shards.

Every text becomes token ids and an end token, cut into sequences of `length` ids, the last one padded. The
sequences of all texts are numbered densely, 0 to M - 1, in order of a hash of their document's id and text,
which does not depend on how the input is split. A Feistel network on the smallest even number of bits that
covers M, with cycle-walking for numbers beyond M, gives each number its slot: a permutation that needs no
table, only the key. Slot s is record s mod `shard` of shard s div `shard`, so a reader finds any position by
arithmetic and can go on from it.

Tokens are made once, dealt into ranges of that hash and written; each range's count, one row, gives the
offsets. Shards are then written in passes over consecutive ranges of slots: a pass shuffles only its own
records, to ranges of whole shards, and a job that was stopped goes on after its last finished pass. All files
go through Spark's writers, so any store that Spark can write to will do.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import text_bytes
from ._order import row_key
from ._storage import delete_on_exit, shared_dir, staged, sweeping
from ._tokens import constants, mix

_U = np.uint64
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits texts for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Long runs of the characters that the pattern takes for white space.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2048,}")
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The byte-level tokenizer of a file of base64 tokens and ranks, one for each process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("quire", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def encoded(enc, text: str) -> np.ndarray:
    """Token ids of a text. Runs of white space that the pattern's matcher has no room for are cut where the
    pattern cuts them anyway: at their start, and before their last character if more text follows."""
    try:
        return enc.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
    except ValueError:
        parts, at = [], 0
        for run in _BLANKS.finditer(text):
            end = run.end() - (run.end() < len(text))
            parts.append(enc.encode_to_numpy(text[at : run.start()], allowed_special=set(), disallowed_special=()))
            parts.append(np.array(enc._encode_single_piece(text[run.start() : end].encode()), parts[-1].dtype))
            at = end
        if not parts:
            raise
        parts.append(enc.encode_to_numpy(text[at:], allowed_special=set(), disallowed_special=()))
        return np.concatenate(parts)


def _halves(n: int) -> int:
    """Bits of half a block of the smallest even number of bits that covers 0 to n - 1."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def feistel(x: np.ndarray, n: int, key: int, rounds: int = 6, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0 to n - 1 (n up to 2^62), of each entry of x, by cycle-walking."""
    half = _halves(n)
    mask, shift = _U((1 << half) - 1), _U(half)
    keys = constants(rounds, key % (1 << 61) + 1)
    x = np.asarray(x).astype(_U)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> shift, x[todo] & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (mix(left * _U(0x9E3779B97F4A7C15) + k) & mask), left
            else:
                left, right = right, left ^ (mix(right * _U(0x9E3779B97F4A7C15) + k) & mask)
        x[todo] = (left << shift) | right
        todo = todo[x[todo] >= _U(n)]
    return x.astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """What a reader has to know about a folder of shards; `data` stands for the texts and their order."""

    records: int
    shard: int
    length: int
    key: int
    wide: bool
    passes: int
    data: int

    @property
    def files(self) -> int:
        return -(-self.records // self.shard)

    def first_shard(self, at: int) -> int:
        """The first shard of a pass; passes hold equal numbers of shards, but for rounding."""
        return self.files * at // self.passes

    def pass_of(self, shard: int) -> int:
        return next(p for p in range(self.passes) if shard < self.first_shard(p + 1))

    def record(self) -> np.dtype:
        """A record: the document, the place of the sequence in it, its ids before the padding, whether the
        document's id is known, the ids, and a line feed."""
        ids = ("tokens", "<u4" if self.wide else "<u2", (self.length,))
        return np.dtype([("doc_id", "<i8"), ("sequence", "<i4"), ("n_tokens", "<i4"), ("known", "u1"), ids, ("end", "u1")])


def numbered(df: DataFrame, id_col: str, text_col: str, length: int, path: str) -> DataFrame:
    """(id, task, start, count, ids, hash): tokens of each row, written in order of (hash, id, a second hash),
    with the number of the row's first sequence in its range. Equal rows may change places."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        dtype = np.uint16 if enc.max_token_value + 1 < (1 << 16) else np.uint32
        end = np.array([enc.max_token_value + 1], dtype)
        for batch in batches:
            buf, off = text_bytes(batch.column(3))
            raw = buf.tobytes()
            found = [encoded(enc, raw[off[i] : off[i + 1]].decode()) for i in range(batch.num_rows)]
            count = pa.array([-(-(len(x) + 1) // length) for x in found], pa.int32())
            payload = pa.array([np.concatenate([x.astype(dtype), end]).tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], count, payload], ["id", "hash", "again", "count", "ids"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("count").to_numpy().astype(np.int64)
            first = start + np.cumsum(n) - n
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([task] * len(n), pa.int32()), pa.array(first, pa.int64()), *(batch.column(c) for c in ("count", "ids", "hash"))],
                ["id", "task", "start", "count", "ids", "hash"],
            )

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", row_key("id", "text").alias("hash"), F.xxhash64("text", F.lit(7)).alias("again"), F.coalesce("text", F.lit("")).alias("text"))
    made = rows.mapInArrow(tokens, "id bigint, hash bigint, again bigint, count int, ids binary")
    part = F.expr(f"cast(((hash >> 33) + 1073741824) * {parts} div 2147483648 as int)")
    made = made.repartitionById(parts, part).sortWithinPartitions("hash", "id", "again")
    return staged(made.mapInArrow(number, "id bigint, task int, start bigint, count int, ids binary, hash bigint"), "tokens")


def _placed(made: DataFrame, layout: Layout, offsets: dict[int, int], first: int, last: int, path: str) -> DataFrame:
    """(slot, record) of the slots first to last - 1."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = layout.record()
        ids, stride = kind["tokens"].base, layout.length * kind["tokens"].base.itemsize
        end = encoder(path).max_token_value + 1
        for batch in batches:
            n = batch.column("count").to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            seq = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            base = np.array([offsets[t] for t in batch.column("task").to_pylist()], np.int64) + batch.column("start").to_numpy()
            slot = feistel(base[row] + seq, layout.records, layout.key)
            own = np.flatnonzero((slot >= first) & (slot < last))
            if not len(own):
                continue
            row, seq, slot = row[own], seq[own], slot[own]
            out = np.zeros(len(own), kind)
            id_of = batch.column("id")
            out["doc_id"] = id_of.fill_null(0).to_numpy()[row]
            out["known"] = id_of.is_valid().to_numpy(zero_copy_only=False)[row]
            out["sequence"], out["tokens"] = seq, end
            raw, off = text_bytes(batch.column("ids"))
            data = raw.tobytes()
            size = np.minimum(off[row + 1] - off[row] - seq * stride, stride)
            out["n_tokens"] = size // ids.itemsize
            tokens = out["tokens"]
            for i, (a, b) in enumerate(zip((off[row] + seq * stride).tolist(), size.tolist(), strict=True)):
                tokens[i, : b // ids.itemsize] = np.frombuffer(data, ids, b // ids.itemsize, a)
            whole = out.view(np.uint8).reshape(len(own), kind.itemsize)[:, :-1].tobytes()  # the writer adds the line feed
            cuts = np.arange(len(own) + 1, dtype=np.int32) * (kind.itemsize - 1)
            record = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(cuts), pa.py_buffer(whole)])
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), record], ["slot", "record"])

    return made.mapInArrow(place, "slot bigint, record binary")


def write_shards(
    df: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 512,
    shard: int = 4096,
    key: int = 20_240_601,
    path: str = VOCABULARY,
    passes: int = 4,
) -> Layout:
    """Write the sequences of all rows as fixed-stride records (see Layout.record) into files
    `folder/pass=P/shard=S/part-*`, one for each shard, and the layout into `folder/layout`.

    A folder that already has the same layout is gone on with: passes that finished are left as they are. A
    pass becomes visible as a whole, so neither a lost executor nor a stopped job leaves half a shard in a
    finished one. Another layout raises. `path` is a vocabulary file that each executor can open. Defined
    cases: those of training_order.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = numbered(df, id_col, text_col, length, path)
    # a row for each task
    counts = {x[0]: x[1:] for x in made.groupBy("task").agg(F.sum("count"), F.bit_xor(F.xxhash64("hash", "start"))).collect()}
    digest = int(made.agg(F.bit_xor(F.xxhash64("hash", "count"))).first()[0] or 0)
    offsets, total = {}, 0
    for task in sorted(counts):
        offsets[task] = total
        total += counts[task][0]
    layout = Layout(total, shard, length, key, encoder(path).max_token_value + 1 >= (1 << 16), passes, digest)
    if _exists(spark, f"{folder}/layout/_SUCCESS"):
        if read_layout(spark, folder) != layout:
            raise ValueError(f"{folder} holds shards of another table or layout")
    else:
        spark.createDataFrame([(json.dumps(asdict(layout)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/layout")
    for p in range(passes):
        low, high = layout.first_shard(p), layout.first_shard(p + 1)
        if low == high or _exists(spark, f"{folder}/pass={p}/_SUCCESS"):
            continue
        rows = _placed(made, layout, offsets, low * shard, high * shard, path).withColumn("shard", F.expr(f"slot div {shard}"))
        dealt = rows.repartitionById(parts, F.expr(f"cast((shard - {low}) * {parts} div {high - low} as int)")).sortWithinPartitions("shard", "slot")
        # bytes go to the file as they are
        lines = dealt.select("shard", F.col("record").cast("string").alias("value"))
        with sweeping(spark):
            lines.write.mode("overwrite").partitionBy("shard").option("compression", "none").text(f"{folder}/pass={p}")
    return layout


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_layout(spark: SparkSession, folder: str) -> Layout:
    return Layout(**json.loads(spark.read.text(f"{folder}/layout").first()[0]))


_ROWS = "slot bigint, shard bigint, place int, doc_id bigint, sequence int, n_tokens int, tokens binary"


def read_slots(spark: SparkSession, folder: str, first: int = 0, n: int | None = None) -> DataFrame:
    """The records of the slots first to first + n - 1 (all from first on, if n is None; fewer at the end).

    Only the shards that hold them are read: their paths follow from the layout.
    """
    layout = read_layout(spark, folder)
    last = layout.records if n is None else min(layout.records, first + n)
    if first >= last:
        return spark.createDataFrame([], _ROWS)
    shards = range(first // layout.shard, (last - 1) // layout.shard + 1)
    if len(shards) == layout.files:
        paths = [f"{folder}/pass={p}" for p in range(layout.passes) if layout.first_shard(p) < layout.first_shard(p + 1)]
    else:
        paths = [f"{folder}/pass={layout.pass_of(s)}/shard={s}" for s in shards]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = layout.record()
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = int(re.findall(r"shard=(\d+)", name)[-1])
                data, want = raw.as_buffer(), min(layout.shard, layout.records - s * layout.shard)
                rows = np.frombuffer(data, kind) if data.size == want * kind.itemsize else np.empty(0, kind)
                if len(rows) != want or (rows["end"] != 10).any():
                    raise ValueError(f"shard {s} does not hold {want} records")
                slot = s * layout.shard + np.arange(len(rows))
                keep = (slot >= first) & (slot < last)
                rows, slot = rows[keep], slot[keep]
                width = kind["tokens"].itemsize
                ids = np.ascontiguousarray(rows["tokens"]).tobytes()
                cuts = np.arange(len(rows) + 1, dtype=np.int32) * width
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slot, pa.int64()),
                        pa.array(np.full(len(rows), s), pa.int64()),
                        pa.array(slot - s * layout.shard, pa.int32()),
                        pa.array(rows["doc_id"], pa.int64(), mask=rows["known"] == 0),
                        pa.array(rows["sequence"], pa.int32()),
                        pa.array(rows["n_tokens"], pa.int32()),
                        pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(cuts), pa.py_buffer(ids)]),
                    ],
                    ["slot", "shard", "place", "doc_id", "sequence", "n_tokens", "tokens"],
                )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(paths)
    return files.select("path", "content").mapInArrow(records, _ROWS)


def training_order(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 512, shard: int = 4096, key: int = 20_240_601, path: str = VOCABULARY, passes: int = 4
) -> DataFrame:
    """The shards of df, written to the shared folder (and removed with the application) and read back.

    One row for each sequence: `slot`, `shard`, `place` (of the record in its shard), `doc_id`, `sequence` (of
    the document, from 0), `n_tokens`, `tokens` (fixed length, little-endian, 2 bytes an id if the vocabulary
    allows, else 4; padded with the end token, which also ends each text).

    Slots are 0 to M - 1 without gaps, and depend on the rows and the key alone. Defined cases: a null or
    empty text is one sequence that holds only the end token; rows with equal ids are separate texts, and
    equal rows share their slots in any order; a null id stays null; an empty table has no slots; texts are
    tokenised whole, runs of white space of any length included; other columns are not looked at.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/quire-shards-{uuid.uuid4().hex}"
    write_shards(df, folder, id_col, text_col, length, shard, key, path, passes)
    delete_on_exit(spark, folder)
    return read_slots(spark, folder)
