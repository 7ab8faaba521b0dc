"""Exact duplicates by cuckoo-filter indexes of live digests.

A document's SHA-256 is its key. An index has buckets of four slots; a slot holds a 16-bit fingerprint and, beside it, the whole digest and
what is known of its group. A fingerprint hit is only a hint: it is verified against the digests stored in the bucket. A row that
outranks the live one of its group (larger id) deletes it and is inserted in its place. When no slot can be freed by moving entries
around, the index doubles and is rebuilt from the stored digests.

Every task first folds its own rows through an index, so a group of copies, however large, leaves one row per task; those rows are
shuffled to shards of digests, each of which folds them through an index of its own. Shard sizes are set by the row count, so an
index has a bounded number of entries. Rows learn their group's survivor by a join; the few digests that hold a large part of all rows
(at most ``HOT`` can exist) are broadcast.

Defined cases: a null text is the empty text; a null id ranks below every other; of rows with the same id and text exactly one stays and
all count; an empty table gives an empty result; other columns are only read if they are asked for.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, durable

SLOTS = 4
#: Moves of one insertion before the index is doubled.
MOVES = 128
#: Digests of one shard, on average.
SHARD = 250_000
#: A digest on at least one row in HOT is joined by broadcast.
HOT = 1_024
_SPREAD = 0x9E3779B1


class CuckooIndex:
    """Digest to value, with insertion and deletion."""

    def __init__(self, buckets: int = 256):
        self._empty(buckets)

    def _empty(self, buckets: int):
        self.mask = buckets - 1
        self.prints = [0] * (buckets * SLOTS)
        self.keys: list[bytes | None] = [None] * (buckets * SLOTS)
        self.values: list = [None] * (buckets * SLOTS)
        self.size = 0

    def __len__(self):
        return self.size

    def _other(self, bucket: int, print_: int) -> int:
        return bucket ^ (print_ * _SPREAD >> 8 & self.mask | 1 & self.mask)

    def _place(self, key: bytes) -> tuple[int, int]:
        return int.from_bytes(key[:2], "little") or 1, int.from_bytes(key[2:10], "little") & self.mask

    def find(self, key: bytes) -> int:
        """Slot of the digest, -1 if it is not live."""
        print_, bucket = self._place(key)
        for b in (bucket, self._other(bucket, print_)):
            for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.prints[slot] == print_ and self.keys[slot] == key:
                    return slot
        return -1

    def insert(self, key: bytes, value):
        """Add a digest that is not live."""
        print_, bucket = self._place(key)
        for move in range(MOVES):
            for b in (bucket, self._other(bucket, print_)):
                for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                    if not self.prints[slot]:
                        self.prints[slot], self.keys[slot], self.values[slot] = print_, key, value
                        self.size += 1
                        return
            slot = self._other(bucket, print_) * SLOTS + move % SLOTS  # its entry gives way and looks for its own other bucket
            bucket = slot // SLOTS
            print_, self.prints[slot] = self.prints[slot], print_
            key, self.keys[slot] = self.keys[slot], key
            value, self.values[slot] = self.values[slot], value
        live = [*self.items(), (key, value)]
        self._empty(2 * (self.mask + 1))
        for k, v in live:
            self.insert(k, v)

    def delete(self, key: bytes):
        """Remove a live digest and return its value; ``KeyError`` if it is not live."""
        slot = self.find(key)
        if slot < 0:
            raise KeyError(key)
        value = self.values[slot]
        self.prints[slot], self.keys[slot], self.values[slot] = 0, None, None
        self.size -= 1
        return value

    def items(self):
        return [(k, v) for k, v in zip(self.keys, self.values) if k is not None]


def fold(index: CuckooIndex, digests: list[bytes], ids: list, rows: list[int], counts: list[int]):
    """Bring rows into an index of (rank, rows in the group): the row of the largest id, then row number, is the live one."""
    for key, id_, row, n in zip(digests, ids, rows, counts):
        slot = index.find(key)
        rank = (id_ is not None, id_, row)
        if slot < 0:
            index.insert(key, (rank, n))
            continue
        live, seen = index.values[slot]
        if rank > live:
            index.delete(key)
            index.insert(key, (rank, seen + n))
        else:
            index.values[slot] = live, seen + n


def _rows_of(index: CuckooIndex, shard: int | None, kind: pa.DataType) -> pa.RecordBatch:
    live = index.items()
    cols = dict(digest=pa.array([k for k, _ in live], pa.binary()), id=pa.array([v[0][1] for _, v in live], kind), row=pa.array([v[0][2] for _, v in live], pa.int64()),
                n=pa.array([v[1] for _, v in live], pa.int64()))
    return batch(**(cols if shard is None else cols | {"shard": pa.array([shard] * len(live), pa.int64())}))


def fold_rows(df: DataFrame, by_shard: bool) -> DataFrame:
    """(digest, id, row, n[, shard]) with equal digests of a task (or of a shard, rows being sorted by it) folded into one row."""
    def run(batches):
        index, at, kind = CuckooIndex(), None, None
        for b in batches:
            kind = b.schema.field("id").type
            shards = b.column("shard").to_pylist() if by_shard else None
            cuts = [0, *(i for i in range(1, b.num_rows) if shards[i] != shards[i - 1]), b.num_rows] if by_shard else [0, b.num_rows]
            for a, z in zip(cuts[:-1], cuts[1:]):
                here = shards[a] if by_shard and z > a else at
                if len(index) and (here != at or not by_shard and len(index) >= SHARD):
                    yield _rows_of(index, at if by_shard else None, kind)
                    index = CuckooIndex()
                at = here
                part = b.slice(a, z - a)
                fold(index, *(part.column(c).to_pylist() for c in ("digest", "id", "row", "n")))
        if len(index):
            yield _rows_of(index, at if by_shard else None, kind)
    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"digest binary, id {kind}, row long, n long" + (", shard long" if by_shard else ""))


def groups(rows: DataFrame, total: int) -> DataFrame:
    """(digest, id, row, n) of every digest on two rows or more: the survivor and the group's size."""
    shards = -(-total // SHARD) or 1
    own = fold_rows(rows.withColumn("n", F.lit(1).cast("long")).select("digest", "id", "row", "n"), False)
    placed = own.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(64 * shards)))
    return fold_rows(placed.repartition("shard").sortWithinPartitions("shard"), True).drop("shard").filter("n > 1")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: the id, ``keep_id`` (id of the group's survivor), ``group_size``, ``kept``, ``digest`` and a struct ``carried`` of the columns asked for."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    extra = [F.struct(*carry).alias("carried")] if carry else []
    rows = durable(df.select(F.unhex(F.sha2(text, 256)).alias("digest"), F.col(id_col).alias("id"), *extra).withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()
    g = durable(groups(rows, total)).select("digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"))
    hot = F.broadcast(g.filter(F.col("group_size") * HOT >= total))
    warm = rows.join(hot, "digest")
    rest = rows.join(hot.select("digest"), "digest", "left_anti").join(g.filter(F.col("group_size") * HOT < total), "digest", "left")
    both = warm.unionByName(rest)
    alone = F.col("group_size").isNull()
    keep, size = F.when(alone, F.col("id")).otherwise(F.col("keep_id")), F.coalesce("group_size", F.lit(1).cast("long"))
    return both.select(F.col("id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"), (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "digest",
                       *(["carried"] if carry else []))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The surviving rows with all their columns."""
    names = [f"c{i}" for i in range(len(df.columns))]
    at, text = (names[df.columns.index(c)] for c in (id_col, text_col))
    out = exact_duplicates(df.toDF(*names), at, text, tuple(names)).filter("kept")
    return out.select(*(F.col(f"carried.{n}").alias(c) for n, c in zip(names, df.columns)))
