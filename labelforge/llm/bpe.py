"""Byte-level BPE encoding and decoding by a hierarchical-bitmap queue of merge ranks.

Every text is cut into pre-tokens by a pattern, and no merge crosses a pre-token. The queue has one bucket of linked-list positions
per merge rank and a two-level bitmap of the ranks whose bucket is filled: find-first-set gives the next rank, and an entry whose
position has meanwhile died or changed its pair is stale and skipped. Finding the next merge costs a few bit operations whatever the
length, so pre-tokens of many thousand bytes stay cheap; the new pre-tokens of a batch share one queue.

Defined cases: a null text is the empty text and has no ids; an empty text has no ids; repeated rows are encoded each on its own;
an empty table gives an empty result; other columns are never read.
"""
from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import TooLarge, batch, map_texts, slices

#: Largest vocabulary file that is broadcast.
MAX_RANK_BYTES = 64 << 20
#: Pre-tokens and words that a worker remembers in one generation; what the last two generations have not met is forgotten.
CACHE = 120_000
#: Text whose new words share one queue; texts are cut and encoded a smaller slice at a time.
GROUP_BYTES = 4 << 20
#: Pieces longer than this are not remembered beyond their group.
CACHE_CHARS = 40
_GROUP = 256
#: Stands for the ids of a word beside which the pattern may cut elsewhere; no list of ids has one byte.
OPEN = b"?"


def read_ranks(path: str) -> bytes:
    """Content of a rank file (base64 token, rank per line) on the driver, size-checked for the broadcast."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise TooLarge(f"rank file over {MAX_RANK_BYTES} bytes")
    return data


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Merges:
    """Pair table of a vocabulary: which two tokens make which token, and which merges may uncover a lower rank than their own."""

    def __init__(self, data: bytes):
        self.ranks = parse_ranks(data)
        self.size = max(self.ranks.values(), default=0) + 1
        known = self.ranks.get
        keys, made = [], []
        for token, rank in self.ranks.items():
            for at in range(1, len(token)):
                left, right = known(token[:at]), known(token[at:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    made.append(rank)
        keys, made = np.array(keys, np.int64), np.array(made, np.int64)
        order = np.argsort(keys)
        self.keys, self.made = np.append(keys[order], np.iinfo(np.int64).max), np.append(made[order], -1)
        self.uncovers = np.zeros(self.size, bool)
        for part in (keys // self.size, keys % self.size):
            self.uncovers[part[made < part]] = True
        self.byte = np.array([known(bytes([c]), -1) for c in range(256)], np.int64)
        self.tokens = {i: t for t, i in self.ranks.items()}

    def pair(self, left, right):
        """Rank of each pair, -1 where the pair makes no token or a side is missing (-1)."""
        want = left * self.size + right
        at = np.searchsorted(self.keys, want)
        return np.where((self.keys[at] == want) & (left >= 0) & (right >= 0), self.made[at], -1)


class RankQueue:
    """Buckets of positions by rank under a two-level bitmap of the filled ranks."""

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.groups: dict[int, int] = {}
        self.summary = 0

    def push(self, rank: int, positions: list[int]):
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += positions
            return
        self.buckets[rank] = positions
        g = rank // _GROUP
        self.groups[g] = self.groups.get(g, 0) | 1 << rank % _GROUP
        self.summary |= 1 << g

    def pop(self) -> tuple[int, list[int]]:
        """Lowest filled rank, by find-first-set on both levels, and its whole bucket."""
        g = (self.summary & -self.summary).bit_length() - 1
        word = self.groups[g]
        rank = g * _GROUP + (word & -word).bit_length() - 1
        word &= word - 1
        self.groups[g] = word
        if not word:
            self.summary &= self.summary - 1
        return rank, self.buckets.pop(rank)


def merge_pieces(pieces: list[bytes], m: Merges) -> list[bytes]:
    """Packed ids of each pre-token. The pre-tokens lie in one linked list with no links between them and share one queue.

    The lowest rank of the queue is the lowest of every pre-token that has it, so its bucket is merged at once: of overlapping pairs the
    leftmost wins, and a rank whose token may take part in a lower-ranked pair is merged one place per pre-token and step.
    """
    lengths = np.array([len(p) for p in pieces], np.int64)
    text = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(text)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(pieces)), lengths)
    token = m.byte[text]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends[lengths > 0] - 1] = -1
    before[(ends - lengths)[lengths > 0]] = -1
    alive = np.ones(n, bool)
    nxt_token = np.append(token[1:], -1)
    nxt_token[after < 0] = -1
    rank_at = m.pair(token, nxt_token) if n else np.zeros(0, np.int64)
    queue = RankQueue()
    order = np.argsort(rank_at, kind="stable")
    order = order[np.searchsorted(rank_at[order], 0):]
    starts = np.flatnonzero(np.diff(rank_at[order], prepend=-1))
    for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
        queue.push(int(rank_at[order[a]]), order[a:z].tolist())
    while queue.summary:
        rank, bucket = queue.pop()
        at = np.array(bucket)
        at = at[rank_at[at] == rank]  # the others are stale
        if len(at) > 1:
            at = np.unique(at)
            if m.uncovers[rank]:
                first = np.append(True, owner[at[1:]] != owner[at[:-1]])
                if not first.all():
                    queue.push(rank, at[~first].tolist())
                    at = at[first]
            elif (linked := np.append(False, after[at[:-1]] == at[1:])).any():
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
                at = at[run % 2 == 0]  # of overlapping pairs every other one, from the left
        if not len(at):
            continue
        gone = after[at]
        far = after[gone]
        token[at] = rank
        after[at] = far
        alive[gone] = False
        rank_at[gone] = -1
        has = far >= 0
        before[far[has]] = at[has]
        near = before[at]
        touched = np.concatenate((at, near[near >= 0]))
        right = after[touched]
        fresh = m.pair(token[touched], np.where(right >= 0, token[right], -1))
        rank_at[touched] = fresh
        ok = fresh >= 0
        buckets = queue.buckets
        for r, i in zip(fresh[ok].tolist(), touched[ok].tolist()):
            if r in buckets:
                buckets[r].append(i)
            else:
                queue.push(r, [i])
    ids = token[alive].astype("<u4")
    cut = np.concatenate(([0], np.cumsum(np.bincount(owner[alive], minlength=len(pieces))))).tolist() if pieces else [0]
    packed = ids.tobytes()
    return [packed[4 * a:4 * z] for a, z in zip(cut[:-1], cut[1:])]


class Memory(dict):
    """Packed ids by text. A miss looks in the generation before and notes what is in neither."""

    def __init__(self):
        super().__init__()
        self.before: dict[str, bytes] = {}
        self.unknown: list[str] = []

    def __missing__(self, k: str) -> bytes | None:
        v = self[k] = self.before.get(k)
        if v is None:  # stays None until it is learnt
            self.unknown.append(k)
        return v

    def take_unknown(self) -> set[str]:
        out = set(self.unknown)
        self.unknown.clear()
        return out

    def turn(self):
        """Begin a new generation if this one is full."""
        if len(self) > CACHE:
            self.before = dict(self)
            self.clear()

    def forget(self, keys):
        for k in keys:
            self.pop(k, None)


#: One character of each kind that patterns tell apart.
_KINDS = "aZ\u00e9\u01321\u0664!'_-\u6f22\u0301\u20ac\U0001F600/s"


class Encoder:
    """Encodes texts to packed little-endian 32-bit ids and back; remembers pre-tokens and words it has met."""

    def __init__(self, data: bytes, pattern: str):
        self.m = Merges(data)
        self.cut = regex.compile(pattern).findall
        self.pieces, self.words = Memory(), Memory()
        # the words of a text may be cut each on its own only if the pattern always begins a pre-token at a single space
        self.by_word = all("".join(cut) == x + " " + y + y and len(x) in np.cumsum([len(c) for c in cut])
                           for x in _KINDS for y in _KINDS if (cut := self.cut(x + " " + y + y)) is not None)

    def learn(self, pieces: set[str]):
        list(map(self.pieces.__getitem__, pieces))
        new = self.pieces.take_unknown()
        whole = [(p, self.m.ranks.get(p.encode())) for p in new]
        self.pieces.update((p, r.to_bytes(4, "little")) for p, r in whole if r is not None)
        rest = [p for p, r in whole if r is None]
        self.pieces.update(zip(rest, merge_pieces([p.encode() for p in rest], self.m)))

    def _cut_text(self, text: str) -> tuple[list[str], list[str], list[bytes | None]]:
        """Pre-tokens of the text's head, the words behind it, and their ids as far as they are known.

        A single space between two characters that are no white space begins a pre-token, so a text is cut there into words. A text with
        another kind of space is all head, and so is every text if the pattern does not treat a single space so.
        """
        rest = text.split(" ") if self.by_word else [text]
        head = rest.pop(0)
        ids = list(map(self.words.__getitem__, rest))
        if rest and (not head or head[-1].isspace()) or OPEN in ids:
            return self.cut(text), [], []
        return self.cut(head), rest, ids

    def note(self, texts: list[str]) -> list[str]:
        """Collect the new words of some texts; their other pre-tokens are given back."""
        return [p for t in texts for p in self._cut_text(t)[0]]

    def learn_words(self, others: list[str]):
        """Merge all words noted and the other pre-tokens, each once and all in one queue."""
        fresh = self.words.take_unknown()
        open_ = [w for w in fresh if not w or w[0].isspace() or w[-1].isspace()]
        self.words.update((w, OPEN) for w in open_)
        closed = list(fresh.difference(open_))
        cut = self.cut(" " + " ".join(closed)) if closed else []
        start = [i for i, p in enumerate(cut) if p[0] == " "]  # no word holds a space
        if len(start) != len(closed):
            raise ValueError("the pattern does not begin a pre-token at every single space")
        self.learn({*cut, *others})
        known = self.pieces.__getitem__
        self.words.update((w, known(cut[a]) if z == a + 1 else b"".join(map(known, cut[a:z]))) for w, a, z in zip(closed, start, [*start[1:], len(cut)]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of every text; words that were not learnt before are learnt first."""
        parts = [self._cut_text(t) for t in texts]
        if self.words.unknown or any(self.pieces.get(p) is None for ps, _, _ in parts for p in ps):
            self.learn_words([p for ps, _, _ in parts for p in ps])
            parts = [(ps, ws, ids) if None not in ids else self._cut_text(t) for (ps, ws, ids), t in zip(parts, texts)]
            if any(self.pieces.get(p) is None for ps, _, _ in parts for p in ps):  # texts that turned out to be all head
                self.learn({p for ps, _, _ in parts for p in ps})
        known = self.pieces.__getitem__
        return [b"".join(map(known, ps)) + b"".join(ids) for ps, _, ids in parts]

    def turn(self):
        """Begin new generations where the present ones are full, and forget texts too long to keep."""
        for seen in (self.words, self.pieces):
            seen.forget([k for k in seen if len(k) > CACHE_CHARS])
            seen.turn()

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.m.tokens.__getitem__, memoryview(packed).cast("I")))


@lru_cache(maxsize=1)
def encoder(data: bytes, pattern: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(data, pattern)


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_tokens``, ``ids`` (packed little-endian unsigned 32-bit) and ``decoded`` (bytes decoded from those ids).

    A map without a shuffle. The vocabulary is broadcast once, after a check of its size.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def make():
        enc = encoder(shared.value, pattern)

        def texts(b):
            return [t or "" for t in b.column(1).to_pylist()]

        def step(b):
            enc.turn()
            parts = list(slices([b], "text"))
            enc.learn_words([p for part in parts for p in enc.note(texts(part))])
            ids = [i for part in parts for i in enc.encode(texts(part))]
            return batch(id=b.column(0), n_tokens=pa.array([len(x) // 4 for x in ids], pa.int64()), ids=pa.array(ids, pa.binary()),
                         decoded=pa.array(list(map(enc.decode, ids)), pa.binary()))
        return step
    cols = [id_col, text_col]
    named = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    out = map_texts(named, ["id", "text"], "text", make, f"id {kind}, n_tokens long, ids binary, decoded binary", GROUP_BYTES)
    return out.withColumnRenamed("id", cols[0])
