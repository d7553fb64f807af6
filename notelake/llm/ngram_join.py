"""N-gram Jaccard join by filters under several global token orders.

Two texts link when their sets of five-word shingles overlap in at least 75 % of the union.
If so, they share a token among the first ``n - ceil(0.75 n) + 1`` tokens of each *under any
global order of all tokens*. Here there are three orders; each puts tokens that look rare
first (a fixed-size sketch of what is frequent decides) and breaks ties by its own hash.

1. Texts with equal sets are one node (they link by definition).
2. Prefix tokens of the first order meet by token. A pair's first common token must also stand so
   early in both texts that the rest could still make up the overlap, and their parity bitmaps
   (``signature``) must differ in no more bits than linked sets can. Pairs that pass are edges of a
   candidate graph. For each token a node is first tried against a hub and a few neighbours, then
   against others; at last *every* pair of different parts of the graph that shares a token is
   tried. So no two parts of the graph can link, and pairs inside a part are not listed.
3. In each part every pair is tested: prefixes must meet under all three orders, then the exact
   overlap counts. The texts of a part come together once; a large part is cut into blocks of
   bounded size, and blocks meet two by two, so no task holds more than two of them. Only counts
   of links and one edge a node leave a task, never pairs.

So no link between different texts is lost, and each row has its number of links. What is
quadratic is the comparing of sets inside a part, as for any exact count of its links.

Edge cases: null, empty and blank texts have the empty set and link with nothing; fewer than
five words are one shingle; very long texts are taken whole (one is held at a time beside its
block); repeated rows (same id, same or other text) are rows of their own in the result and
count as links of each other; ids are whole numbers (others are cast); a null ``doc_id`` links
like others but is never a component's least id unless all are null; ties of size or frequency
are broken by hash, which shapes the search only. An empty table gives an empty result. Further
columns are ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from notelake.llm.bitmap import bitmap, in_bitmap
from notelake.llm.components import components
from notelake.llm.decontaminate import shingle_sql, words_sql
from notelake.llm.lean import lean
from notelake.llm.shingles import Sets, of_column, overlap
from notelake.llm.words import mix
from notelake.storage import Scratch, materialize, table

#: Two sets link when ``100 * overlap >= PERCENT * union``.
PERCENT = 75
ORDERS = 3
#: The frequency sketch has 2 ** SKETCH_BITS cells, whatever the corpus; it counts all tokens of
#: all texts and shapes the orders only. A larger one tells rarer tokens apart.
SKETCH_BITS, CHUNK_BITS = 22, 16
#: A task's count c is kept as round(CODE * log2(1 + c)) in one byte.
CODE = 12
#: A token whose cell counts more than this is dealt over several tasks.
SALT_FROM = 4096
#: Prefix tokens are met in buckets of about so many; so many are packed at once.
BUCKET, FLUSH, MOST_TASKS = 1 << 19, 1 << 19, 1 << 15
#: Neighbours by size that a set is tried against for each of its early tokens in the first round.
NEAR = 3
#: Least bits of a signature.
SIGNATURE = 512
#: Shingles and sets of a block of a large part of the candidate graph, about.
BLOCK_SHINGLES, BLOCK_SETS = 1 << 19, 2048
#: Columns of a dense product; a token that more than 1 / SPARSE of all pairs share is dense.
WIDTH, SPARSE = 2048, 50


def prefix_length(n: int | np.ndarray) -> int | np.ndarray:
    return n - -(-PERCENT * n // 100) + 1


def reach(n: int | np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The largest set that one of size ``n`` can link to if their first common token is at ``pos``.

    Linked sets share at least ``PERCENT / (100 + PERCENT)`` of their summed sizes; with none
    shared before, the token and what follows it must hold that many. It holds for both sets."""
    return (100 * n - (100 + PERCENT) * pos) // PERCENT


def linked(inter: int | np.ndarray, a: int | np.ndarray, b: int | np.ndarray) -> bool | np.ndarray:
    return 100 * inter >= PERCENT * (a + b - inter)


def signature(tokens: np.ndarray) -> bytes:
    """Bits that say whether an odd number of tokens falls on each; about one a token."""
    bits = max(SIGNATURE, 1 << (max(1, len(tokens)) - 1).bit_length())
    odd = np.bincount((mix(tokens, 61) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Two sets with these signatures differ in at least so many tokens."""
    (x, p), (y, q) = sorted(((int.from_bytes(s, "little"), 8 * len(s)) for s in (a, b)), key=lambda s: s[1])
    while q > p:
        q //= 2
        y = (y & ((1 << q) - 1)) ^ (y >> q)
    return (x ^ y).bit_count()


@dataclass
class Orders:
    """Global token orders: (frequency class, hash with the order's own seed)."""

    level: np.ndarray
    #: seed of the fingerprints that name the sets
    seed: int = 0

    def classes(self, tokens: np.ndarray) -> np.ndarray:
        return self.level[(tokens & np.uint64(len(self.level) - 1)).astype(np.int64)]

    def prefix(self, tokens: np.ndarray, order: int) -> np.ndarray:
        """The first tokens of a set (their indexes), in order, under an order."""
        p = prefix_length(len(tokens))
        key = (self.classes(tokens).astype(np.uint64) << np.uint64(56)) | (mix(tokens, 31 + order) >> np.uint64(8))
        first = np.argpartition(key, p - 1)[:p] if p < len(tokens) else np.arange(len(tokens))
        return first[np.argsort(key[first])]


def names_of(s: Sets, seed: int) -> np.ndarray:
    """What names the sets; two sets with one name are found and named anew with another seed."""
    return s.fingerprints(seed)


def _fresh(prints: np.ndarray, sizes: np.ndarray, known: set[int]) -> list[int]:
    """Rows with a set that isn't empty and that this task meets for the first time."""
    return [i for i, x in enumerate(prints.tolist()) if sizes[i] and not (x in known or known.add(x))]


def marked(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Rows (doc_id, n, fp, check, sig) for documents; and rows (chunk, cells) of each task's sketch.

    ``sig`` stands in one row of each set and task only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, known = np.zeros(1 << SKETCH_BITS, np.uint32), set()
        for b in batches:
            for s in of_column(b.column(1)):
                prints, sizes = names_of(s, seed), s.sizes()
                sigs: list[bytes | None] = [None] * len(s)
                for i in _fresh(prints, sizes, known):
                    row = s.row(i)
                    sigs[i] = signature(row)
                    np.add.at(cells, (row & np.uint64(len(cells) - 1)).astype(np.int64), np.uint32(1))
                columns = [pa.array(sizes.astype(np.int64)), pa.array(prints.view(np.int64)), pa.array(names_of(s, seed + 1).view(np.int64)), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, len(s)), *columns, pa.nulls(len(s), pa.int32()), pa.nulls(len(s), pa.binary())], names=names)
        some, codes = [], []
        for i, x in enumerate(cells.reshape(-1, 1 << CHUNK_BITS)):
            if x.any():
                some.append(i)
                codes.append(pa.compress(np.minimum(np.rint(CODE * np.log2(1.0 + x)), 255).astype(np.uint8).tobytes(), "zstd", asbytes=True))
        none = [pa.nulls(len(some), kind) for kind in (pa.int64(),) * 4 + (pa.binary(),)]
        yield pa.RecordBatch.from_arrays([*none, pa.array(some, pa.int32()), pa.array(codes, pa.binary())], names=names)

    names = ["doc_id", "n", "fp", "check", "sig", "chunk", "cells"]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n long, fp long, check long, sig binary, chunk int, cells binary")


def frequency_orders(marks: DataFrame, seed: int = 0) -> Orders:
    """The summed sketch as classes: log2 of how far a cell's count is above its chunk's mean.

    Sums are streamed, a chunk's arrays never being held together; one byte a cell comes to the
    driver, however large the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        count = 2.0 ** (np.arange(256) / CODE) - 1
        for b in batches:
            for chunk, cells in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total = held.setdefault(chunk, np.zeros(1 << CHUNK_BITS))
                total += count[np.frombuffer(pa.decompress(cells.as_py(), 1 << CHUNK_BITS, "zstd", asbytes=True), np.uint8)]
        levels = [np.log2(1 + np.maximum(0, x - x.mean())).astype(np.uint8).tobytes() for x in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(levels, pa.binary())], names=["chunk", "level"])

    rows = marks.where("chunk is not null").select("chunk", "cells").repartition(1 << (SKETCH_BITS - CHUNK_BITS), "chunk").mapInArrow(lean(run), "chunk int, level binary").collect()
    level = np.zeros((1 << (SKETCH_BITS - CHUNK_BITS), 1 << CHUNK_BITS), np.uint8)
    for r in rows:
        level[r["chunk"]] = np.frombuffer(r["level"], np.uint8)
    return Orders(level.ravel(), seed)


@dataclass
class Prefixes:
    """Prefix tokens of sets: ``key`` (48 bits of the token, 16 of its salt) and ``place`` (position
    in 256ths of the prefix, rounded down) belong to set ``owner``, which has ``fp`` and ``n``.

    Tokens cut to 48 bits can only meet too often, and a place too early only lets more pass."""

    key: np.ndarray
    place: np.ndarray
    owner: np.ndarray
    fp: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, s: Sets, prints: np.ndarray, orders: Orders, known: set[int], salt_from: int) -> Prefixes | None:
        fresh = _fresh(prints, s.sizes(), known)
        if not fresh:
            return None
        rows = [s.row(i) for i in fresh]
        parts = [row[orders.prefix(row, 0)] for row in rows]
        sizes = np.array([len(x) for x in parts])
        token, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes)
        place = np.concatenate([np.arange(p) * 256 // p for p in sizes.tolist()]).astype(np.uint8)
        fp = prints[fresh]
        ways = np.clip((2 << orders.classes(token).astype(np.int64)) // salt_from, 1, 65535)
        salt = np.where(ways > 1, mix(fp[owner], 41) % ways.astype(np.uint64) + np.uint64(1), np.uint64(0))
        return cls((token & np.uint64(2**48 - 1)) | (salt << np.uint64(48)), place, owner, fp, np.array([len(x) for x in rows], np.uint32))

    def pack(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """(bucket, bytes): a bucket's sets, then their tokens, column by column."""
        bucket = mix(self.key, 43) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        ends = np.flatnonzero(np.diff(bucket[order])) + 1
        for at in np.split(order, ends):
            sets, count = np.unique(self.owner[at], return_counts=True)
            key = self.key[at]
            columns = [self.fp[sets], self.n[sets], count.astype(np.uint32), (key & np.uint64(2**32 - 1)).astype(np.uint32), ((key >> np.uint64(32)) & np.uint64(2**16 - 1)).astype(np.uint16), (key >> np.uint64(48)).astype(np.uint16), self.place[at]]
            yield int(bucket[at[0]]), struct.pack("<II", len(sets), len(at)) + b"".join(c.tobytes() for c in columns)

    @classmethod
    def unpack(cls, data: bytes) -> Prefixes:
        (sets, rows), at, columns = struct.unpack_from("<II", data), 8, []
        for kind, k in ((np.uint64, sets), (np.uint32, sets), (np.uint32, sets), (np.uint32, rows), (np.uint16, rows), (np.uint16, rows), (np.uint8, rows)):
            columns.append(np.frombuffer(data, kind, k, at))
            at += columns[-1].nbytes
        fp, n, count, low, high, salt, place = columns
        key = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)) | (salt.astype(np.uint64) << np.uint64(48))
        return cls(key, place, np.repeat(np.arange(sets), count), fp, n)

    @classmethod
    def together(cls, parts: list[Prefixes]) -> Prefixes:
        shift = np.cumsum([0] + [len(p.fp) for p in parts])
        return cls(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("key", "place")), np.concatenate([p.owner + k for p, k in zip(parts, shift, strict=False)]), *(np.concatenate([getattr(p, c) for p in parts]) for c in ("fp", "n")))

    def shared(self) -> pa.RecordBatch:
        """Rows of tokens that several sets hold, each with its hub and its neighbours by size.

        Sets that the token could link to others of their size come first, so that hubs and
        neighbours are likely to be real candidates."""
        fp, n = self.fp[self.owner], self.n[self.owner].astype(np.int64)
        far = reach(n, -(-self.place.astype(np.int64) * prefix_length(n) // 256))
        order = np.lexsort((fp, n, far < n, self.key))
        key, fp, n, far = self.key[order], fp[order], n[order], far[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
        key, fp, n, far = key[fresh], fp[fresh], n[fresh], far[fresh]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        first = np.repeat(starts, sizes)
        salt = (key >> np.uint64(48)).astype(np.int32)
        low, high = (np.repeat(f.reduceat(x, starts), sizes) for f, x in ((np.minimum, n), (np.maximum, far)))
        at = np.flatnonzero((salt > 0) | ((np.repeat(sizes, sizes) > 1) & (low <= far) & (n <= high)))
        partners = []
        for k in range(NEAR + 1):
            other = at - k if k else first[at]
            fits = (other > first[at] if k else other < at) & (n[at] <= far[other]) & (n[other] <= far[at])
            partners.append(pa.array(fp[other].view(np.int64), mask=~fits))
        return pa.RecordBatch.from_arrays([pa.array((key[at] & np.uint64(2**48 - 1)).view(np.int64)), pa.array(salt[at]), pa.array(fp[at].view(np.int64)), pa.array(n[at]), pa.array(far[at]), *partners], names=TOKEN_NAMES)


TOKEN_NAMES = ["token", "salt", "fp", "n", "reach", *[f"near{k}" for k in range(NEAR + 1)]]
TOKEN_DDL = "token long, salt int, fp long, n long, reach long, " + ", ".join(f"{c} long" for c in TOKEN_NAMES[5:])


def packed_prefixes(docs: DataFrame, orders: Orders, buckets: int) -> DataFrame:
    """(bucket, data): the first order's prefix of each different set of a task."""
    shared = docs.sparkSession.sparkContext.broadcast(orders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, known, held, size = shared.value, set(), [], 0
        for b in batches:
            for s in of_column(b.column(0)):
                part = Prefixes.of(s, names_of(s, orders.seed), orders, known, SALT_FROM)
                if part:
                    held.append(part)
                    size += len(part.key)
                if size >= FLUSH:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    def packed(held: list[Prefixes]) -> pa.RecordBatch:
        rows = list(Prefixes.together(held).pack(buckets))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "data"])

    return docs.select("text").mapInArrow(lean(run), "bucket int, data binary")


def shared_tokens(packs: DataFrame, buckets: int) -> DataFrame:
    """Prefix tokens of at least two sets, see ``Prefixes.shared``; one bucket is held at a time.

    Each bucket has a task of its own, as long as there are no more than ``MOST_TASKS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for bucket, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if held and bucket != now:
                    yield Prefixes.together(held).shared()
                    held = []
                now = bucket
                held.append(Prefixes.unpack(data.as_py()))
        if held:
            yield Prefixes.together(held).shared()

    return packs.repartitionById(min(buckets, MOST_TASKS), F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(lean(run), TOKEN_DDL)


def _pairs(rows: DataFrame, partners: list[str]) -> DataFrame:
    """Different pairs (u, v) of each row's ``fp`` and its partners."""
    rows = rows.select("fp", F.explode(F.filter(F.array(*partners), lambda x: x.isNotNull())).alias("other")).where("fp <> other")
    return rows.select(F.least("fp", "other").alias("u"), F.greatest("fp", "other").alias("v")).distinct()


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose signatures don't rule out a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, a, c = b.column(2).to_pylist(), b.column(3), b.column(4)
            near = [i for i in range(len(b)) if (100 + PERCENT) * apart(a[i].as_py(), c[i].as_py()) <= (100 - PERCENT) * n[i]]
            yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(near, pa.int64())) for k in (0, 1)], names=["u", "v"])

    side = lambda c: nodes.select(F.col("fp").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"sig{c}"))
    rows = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", (F.col("nu") + F.col("nv")).alias("n"), "sigu", "sigv")
    return rows.mapInArrow(lean(run), "u long, v long")


def node_texts(docs: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """(fp, text): one text for each node of each task (and for a few other sets).

    A bitmap of fixed size tells which texts to send on, so that only those are shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(nodes.select("fp")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = shared.value, set()
        for b in batches:
            for s in of_column(b.column(0)):
                prints = names_of(s, seed).view(np.int64)
                wanted = _fresh(prints, np.where(in_bitmap(bits, prints), s.sizes(), 0), known)
                yield pa.RecordBatch.from_arrays([pa.array(prints[wanted]), b.column(0).take(pa.array([s.first + i for i in wanted], pa.int64())).cast(pa.string())], names=["fp", "text"])

    return docs.select("text").mapInArrow(lean(run), "fp long, text string")


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all sets of ``b``."""
    out = np.zeros((len(a), len(b)), np.int32)
    x, y = np.concatenate(a), np.concatenate(b)
    tokens = np.intersect1d(x, y)
    if not len(tokens):
        return out
    i, j = (np.repeat(np.arange(len(s)), [len(r) for r in s]) for s in (a, b))
    sides = []
    for values, row in ((x, i), (y, j)):
        at = np.minimum(np.searchsorted(tokens, values), len(tokens) - 1)
        known = np.flatnonzero(tokens[at] == values)
        known = known[np.argsort(at[known], kind="stable")]
        sides.append((at[known], row[known]))
    (x, i), (y, j) = sides
    held = [np.bincount(s, minlength=len(tokens)) for s in (x, y)]
    dense = held[0] * held[1] * SPARSE > len(a) * len(b)
    number = np.cumsum(dense) - 1
    for lo in range(0, int(dense.sum()), WIDTH):
        parts = []
        for values, row, rows in ((x, i, len(a)), (y, j, len(b))):
            here = dense[values] & (number[values] >= lo) & (number[values] < lo + WIDTH)
            part = np.zeros((rows, WIDTH), np.float32)
            part[row[here], number[values[here]] - lo] = 1
            parts.append(part)
        out += (parts[0] @ parts[1].T).astype(np.int32)
    rare = ~dense[x]
    x, i = x[rare], i[rare]
    begin, many = np.searchsorted(y, x), held[1][x]
    done, flat = np.cumsum(many), out.ravel()
    for part in np.split(np.arange(len(x)), np.searchsorted(done, np.arange(1 << 22, done[-1] if len(done) else 0, 1 << 22))):
        k = many[part]
        at = np.repeat(begin[part] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        np.add.at(flat, np.repeat(i[part] * len(b), k) + j[at], 1)
    return out


@dataclass
class Block:
    """Sets of a block with the sorted prefixes of each under all orders."""

    fp: list[int]
    copies: np.ndarray
    sets: list[np.ndarray]
    prefixes: list[list[np.ndarray]]

    def sizes(self) -> np.ndarray:
        return np.array([len(s) for s in self.sets], np.int64)


def block_links(a: Block, b: Block) -> np.ndarray:
    """Which sets of ``a`` link with which of ``b``: prefixes meet under all orders, then the overlap."""
    n, m = a.sizes(), b.sizes()
    near = 100 * np.minimum(n[:, None], m[None, :]) >= PERCENT * np.maximum(n[:, None], m[None, :])
    if near.size > 1024:
        for x, y in zip(a.prefixes, b.prefixes, strict=True):
            near &= common(x, y) > 0
        if near.sum() * 64 > near.size:
            return near & linked(common(a.sets, b.sets), n[:, None], m[None, :])
    else:
        for i, j in np.argwhere(near).tolist():
            near[i, j] = all(overlap(x[i], y[j]) for x, y in zip(a.prefixes, b.prefixes, strict=True))
    for i, j in np.argwhere(near).tolist():
        near[i, j] = linked(overlap(a.sets[i], b.sets[j]), len(a.sets[i]), len(b.sets[j]))
    return near


def _leaders(link: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The least node that each row and each column of a table of links reaches in it."""
    rows, columns = np.arange(link.shape[0]), np.arange(link.shape[1]) + (0 if same else link.shape[0])
    while True:
        c = np.minimum(columns, np.where(link, rows[:, None], 1 << 40).min(axis=0, initial=1 << 40))
        r = np.minimum(rows, np.where(link, c[None, :], 1 << 40).min(axis=1, initial=1 << 40))
        if same:
            r = c = np.minimum(r, c)
        if (r == rows).all() and (c == columns).all():
            return rows, columns
        rows, columns = r, c


def part_links(docs: DataFrame, places: DataFrame, orders: Orders) -> DataFrame:
    """(fp, links, leader): in each meeting of two blocks of a part, how many rows a set links to
    and the least set that it reaches. ``places`` are rows (fp, root, ways, copies)."""
    shared = docs.sparkSession.sparkContext.broadcast(orders)
    block = F.pmod(F.xxhash64("fp"), F.col("ways")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("ways") - 1))
    rows = node_texts(docs, places, orders.seed).dropDuplicates(["fp"]).join(places, "fp").withColumn("block", block)
    rows = rows.select("root", "fp", "copies", "block", "text", other.alias("other"))
    rows = rows.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "copies", "block", "text")
    rows = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, now, sides, done = shared.value, None, {}, []
        for b in batches:
            root, i, j, fp, copies, side = (b.column(k).to_pylist() for k in range(6))
            for s in of_column(b.column(6)):
                for k in range(len(s)):
                    at = s.first + k
                    if (root[at], i[at], j[at]) != now:
                        done += links(now, sides)
                        now, sides = (root[at], i[at], j[at]), {}
                        if len(done) > 100_000:
                            yield batch(done)
                            done = []
                    x, row = sides.setdefault(side[at], Block([], [], [], [[] for _ in range(ORDERS)])), s.row(k).copy()
                    x.fp.append(fp[at])
                    x.copies.append(copies[at])
                    x.sets.append(row)
                    for o in range(ORDERS):
                        x.prefixes[o].append(np.sort(row[orders.prefix(row, o)]))
        yield batch(done + links(now, sides))

    def links(now: tuple[int, int, int] | None, sides: dict[int, Block]) -> list[tuple[int, int, int]]:
        if now is None or now[1] not in sides or now[2] not in sides:
            return []
        a, b, same = sides[now[1]], sides[now[2]], now[1] == now[2]
        link = block_links(a, b)
        if same:
            np.fill_diagonal(link, False)
        rows, columns = _leaders(link, same)
        names = a.fp if same else a.fp + b.fp
        found = list(zip(a.fp, (link @ np.array(b.copies)).tolist(), (names[k] for k in rows), strict=True))
        if not same:
            found += zip(b.fp, (np.array(a.copies) @ link).tolist(), (names[k] for k in columns), strict=True)
        return [x for x in found if x[1]]

    def batch(done: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.int64()) for k in range(3)], names=["fp", "links", "leader"])

    return rows.mapInArrow(lean(run), "fp long, links long, leader long")


def _open(tokens: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of tokens that several parts of the candidate graph hold, with their ``root``."""
    placed = tokens.select("token", "salt", "fp", "n", "reach").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    by = Window.partitionBy("token", "salt")
    return placed.withColumn("a", F.min("root").over(by)).withColumn("b", F.max("root").over(by)).where("a <> b or salt > 0").drop("a", "b")


def _both(roots: DataFrame, edges: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(edges)


def candidate_parts(tokens: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): parts of a graph that no link leaves."""
    near = [c for c in TOKEN_NAMES if c.startswith("near")]
    roots = components(scratch.write(plausible(_pairs(tokens, near), nodes), "join-edges"), scratch, "join-parts")

    # a second round over what is still apart: other neighbours, of other parts
    order = Window.partitionBy("token", "salt").orderBy(F.col("reach") < F.col("n"), F.xxhash64("fp"), "fp")
    rows = _open(tokens, roots)
    for k in range(1, 2 * NEAR + 1):
        other = F.lag(F.struct("fp", "n", "reach", "root"), k).over(order)
        fits = (other["root"] != F.col("root")) & (F.col("n") <= other["reach"]) & (other["n"] <= F.col("reach"))
        rows = rows.withColumn(f"near{k}", F.when(fits, other["fp"]))
    near = [f"near{k}" for k in range(1, 2 * NEAR + 1)]
    rows = scratch.write(rows, "join-open")
    roots = components(_both(roots, scratch.write(plausible(_pairs(rows, near), nodes), "join-edges")), scratch, "join-parts")

    # parts meet first, then their members: pairs inside a part are never formed
    open_ = scratch.write(_open(rows, roots), "join-open")
    groups = open_.groupBy("token", "root").agg(F.min("n").alias("low"), F.max("reach").alias("reach"))
    x, y = (groups.select("token", *[F.col(c).alias(f"{c}{i}") for c in ("root", "low", "reach")]) for i in "ab")
    meet = x.join(y, "token").where("roota < rootb and lowa <= reachb and lowb <= reacha").drop("lowa", "reacha")
    a, b = (open_.select("token", *[F.col(c).alias(f"{c}_{i}" if c != "root" else f"root{i}") for c in ("root", "fp", "n", "reach")]) for i in "ab")
    rest = meet.join(a, ["token", "roota"]).where("n_a <= reachb and lowb <= reach_a").drop("lowb", "reachb")
    rest = rest.join(b, ["token", "rootb"]).where("n_a <= reach_b and n_b <= reach_a")
    rest = scratch.write(rest.select(F.least("fp_a", "fp_b").alias("u"), F.greatest("fp_a", "fp_b").alias("v")).distinct(), "join-rest")
    scratch.drop("join-open")
    return components(_both(roots, scratch.write(plausible(rest, nodes), "join-edges")), scratch, "join-parts")


def join_sets(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Tables (doc_id, n, fp) of all rows and (fp, copies, least, root, component_id, n_links) of
    all different sets that aren't empty; ``least`` is the least id of a set's rows. And the seed
    of ``fp``."""
    seed = 0
    while True:
        marks = scratch.write(marked(docs, seed), "join-marks")
        nodes = marks.where("n > 0").groupBy("fp").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.max("sig").alias("sig"), F.min("check").alias("a"), F.max("check").alias("b"))
        nodes = scratch.write(nodes, "join-nodes")
        if nodes.where("a <> b").isEmpty():
            break
        seed += 2  # two different sets have the same 64 bits: other hashes tell them apart
    orders = frequency_orders(marks, seed)
    size = nodes.agg(F.sum(F.expr(f"n - ceil({PERCENT} * n / 100) + 1"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // BUCKET))
    tokens = scratch.write(shared_tokens(packed_prefixes(docs, orders, buckets), buckets), "join-tokens")
    parts = candidate_parts(tokens, nodes, scratch)
    scratch.drop("join-tokens")

    places = parts.withColumnRenamed("node", "fp").join(nodes.select("fp", "n", "copies"), "fp")
    ways = places.groupBy("root").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count(F.lit(1)) / BLOCK_SETS)).cast("int").alias("ways"))
    places = scratch.write(places.join(ways, "root").select("fp", "root", "ways", "copies"), "join-places")
    found = scratch.write(part_links(docs, places, orders), "join-links")
    roots = components(found.where("fp <> leader").select(F.col("fp").alias("u"), F.col("leader").alias("v")), scratch, "join-roots")
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    sets = nodes.select("fp", "copies", "least").join(roots.withColumnRenamed("node", "fp"), "fp", "left").join(links, "fp", "left")
    sets = sets.select("fp", "copies", "least", F.coalesce("root", "fp").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    least = sets.groupBy("root").agg(F.min("least").alias("component_id"))
    sets = scratch.write(sets.join(least, "root").select("fp", "copies", "least", "root", "component_id", "n_links"), "join-sets")
    scratch.drop("join-links", "join-places", "join-nodes", "join-edges", "join-rest", "join-parts", "join-roots")
    return marks.where("n is not null").select("doc_id", "n", "fp"), sets, seed


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of ``docs``.

    ``n_links`` counts the other rows that the row's set links to, copies of it included."""
    with Scratch(docs.sparkSession) as scratch:
        rows, sets, _ = join_sets(docs, scratch)
        some = rows.where("n > 0").join(sets, "fp").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
        return materialize(some.union(rows.where("n = 0").select("doc_id", "n", "doc_id", F.lit(0).cast("long"))), "join-rows")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of linked rows (that of the least id); texts without words all stay.

    Rows that are alone in their group pass without a shuffle; a bitmap of fixed size tells them.
    Of the others one row for each set is gathered (pre-aggregated in each task, so copies don't
    travel) and stays if its set is the group's choice."""
    with Scratch(docs.sparkSession) as scratch:
        _, sets, seed = join_sets(docs, scratch)
        crowd = sets.groupBy("root").agg(F.sum("copies").alias("rows"), F.min(F.struct(F.col("least").isNull().alias("no_id"), "least", "fp")).alias("choice")).where("rows > 1")
        crowd = materialize(sets.join(crowd, "root").select("fp", (F.col("fp") == F.col("choice.fp")).alias("__chosen")), "join-crowd")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(crowd.select("fp")))
    at, print_ = docs.columns.index("text"), "__fp"

    def run(batches: Iterator[pa.RecordBatch], inside: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in of_column(b.column(at)):
                prints = names_of(s, seed).view(np.int64)
                some = pa.array(((s.sizes() > 0) & in_bitmap(shared.value, prints)) == inside)
                part = b.slice(s.first, len(s))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(prints)], names=[*b.schema.names, print_]).filter(some)

    schema = StructType([*docs.schema.fields, StructField(print_, LongType())])
    alone = docs.mapInArrow(lean(lambda batches: run(batches, False)), schema)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    first = docs.mapInArrow(lean(lambda batches: run(batches, True)), schema).groupBy(print_).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), rank).alias("row"))
    picked = first.join(crowd.withColumnRenamed("fp", print_), print_, "left").where("__chosen is null or __chosen").select("row.*")
    return alone.drop(print_).unionByName(picked)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {words_sql('text')} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, r, coalesce({shingle_sql('w')}, []) AS sh FROM d),
e AS MATERIALIZED (SELECT r, len(sh) AS n, unnest(sh) AS t FROM s),
c AS (SELECT x.r AS a, y.r AS b, x.n AS na, y.n AS nb, count(*) AS k FROM e x JOIN e y ON x.t = y.t AND x.r < y.r GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c WHERE 100 * k >= {PERCENT} * (na + nb - k)),
ways AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(r, x) AS (SELECT r, r FROM s UNION SELECT reach.r, ways.b FROM reach JOIN ways ON reach.x = ways.a)
SELECT ANY_VALUE(s.doc_id) AS doc_id, CAST(ANY_VALUE(len(s.sh)) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id,
  CAST((SELECT count(*) FROM ways WHERE ways.a = reach.r) AS BIGINT) AS n_links
FROM reach JOIN s ON s.r = reach.r JOIN s o ON o.r = reach.x GROUP BY reach.r
"""
