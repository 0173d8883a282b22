"""Near-duplicate vectors: cross-polytope hashing with multiprobe and verified pairs.

Equal vectors form a class first. Each class's vector is rotated by sign flips and
fast Hadamard transforms; the nearest signed axis is its hash, and several hashes
make the key of a bucket. In every table a vector is at home in its own bucket and
visits those of its next best axes; a pair meets where one is at home. The number of
hashes follows from the rows; tables and probes follow from it, by simulated pairs at
the threshold, so that a pair meets with probability ``RECALL`` at any number of rows.

A pair counts in the first bucket in which it meets: a member of a bucket carries its
keys of the tables up to that one, so each pair is known there as first met or not.
Buckets are looked at twice. First with 128 sign bits a member: a member stays only if
a pair that it first meets there is close by bits. What stays, about one bucket a link,
is joined to its vector and compared exactly, in double precision. Links are counted
without ever being written as pairs; a cell returns each member's number of links and a
star of edges for the components.

A bucket larger than a block is cut into cells (pairs of salted parts, one of them of
vectors at home), so no task ever holds more than two blocks, whatever share of the
rows one bucket has.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .arrow import arrow_schema, release, slices
from .graph import connected_components

#: Probability that a pair at the threshold meets in some bucket.
RECALL = 0.98
#: Numbers of buckets a table, its own included, that a vector may enter.
PROBES = (1, 2, 4, 8, 16, 32)
#: Pairs, and tables, that the probability of meeting in a table is estimated on.
TRIAL_PAIRS = 1000
TRIAL_TABLES = 4
#: Vectors a bucket, on average, from which keys get another hash: sign bits tell them apart fast, while each hash multiplies the tables.
PER_BUCKET = 1024
MOST_HASHES = 8
BLOCK = 1024
BITS = 128


def padded(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


@lru_cache(maxsize=256)
def _signs(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([dim, seed]).choice([-1.0, 1.0], (3, dim))


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random rotation of each row: three rounds of sign flips and transform."""
    for s in _signs(x.shape[1], seed):
        x = hadamard(x * s)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bucket_keys(u: np.ndarray, hashes: int, tables: int, probes: int, seed: int = 0) -> np.ndarray:
    """Buckets (32 bits) that each unit row enters: rows x tables x probes, the one it is at home in first."""
    n, dim = u.shape
    wide = np.pad(u, ((0, 0), (0, padded(dim) - dim)))
    near = min(max(2, probes), wide.shape[1])
    out = np.empty((n, tables, probes), np.uint64)
    for t in range(tables):
        key, loss = np.zeros((n, 1), np.uint64), np.zeros((n, 1))
        for j in range(hashes):
            r = rotate(wide, 1 + (seed + t) * 64 + j)
            a = np.abs(r)
            top = np.argsort(-a, axis=1, kind="stable")[:, :near]
            v = np.take_along_axis(a, top, 1)
            axis = (2 * top + (np.take_along_axis(r, top, 1) > 0)).astype(np.uint64)
            key = (key[:, :, None] * np.uint64(2 * wide.shape[1]) + axis[:, None, :]).reshape(n, -1)
            loss = (loss[:, :, None] + (v[:, :1] - v)[:, None, :] ** 2).reshape(n, -1)
            best = np.argsort(loss, axis=1, kind="stable")[:, :near]
            key, loss = np.take_along_axis(key, best, 1), np.take_along_axis(loss, best, 1)
        have = key.shape[1]
        out[:, t] = key[:, [min(i, have - 1) for i in range(probes)]]
    mixed = (out + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(32)).astype(np.uint32)


def meeting(keys: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For rows of pairs and each table: whether one is at home in a bucket that the other enters."""
    return (keys[:, :, :1] == others).any(axis=2) | (others[:, :, :1] == keys).any(axis=2)


def pairs_at(cosine: float, dim: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors with that cosine."""
    rng = np.random.default_rng([seed, dim])
    x = unit(rng.normal(size=(n, dim)))
    y = rng.normal(size=(n, dim))
    y = unit(y - (x * y).sum(axis=1, keepdims=True) * x) if dim > 1 else y * 0
    return x, cosine * x + math.sqrt(1 - cosine * cosine) * y


@lru_cache(maxsize=64)
def tables_and_probes(dim: int, hashes: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """The fewest buckets a vector, as tables and probes, by which pairs at the threshold meet with that probability."""
    x, y = pairs_at(threshold, dim, TRIAL_PAIRS, 1)
    most = bucket_keys(x, hashes, TRIAL_TABLES, PROBES[-1], 1000), bucket_keys(y, hashes, TRIAL_TABLES, PROBES[-1], 1000)
    found = []
    for probes in PROBES:
        # Two standard errors less than what was seen.
        n = TRIAL_PAIRS * TRIAL_TABLES
        p = float(meeting(most[0][:, :, :probes], most[1][:, :, :probes]).mean())
        p = min(p - 2 * math.sqrt(p * (1 - p) / n), 1 - 1 / n)
        if p > 0:
            tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))
            found.append((tables * probes, tables, probes))
    cost, tables, probes = min(f for f in found if f[1] < 256)
    return tables, probes


def sign_bits(u: np.ndarray) -> np.ndarray:
    """Signs of rotated rows as 64-bit words, as many rotations as fill BITS."""
    wide = np.pad(u, ((0, 0), (0, padded(u.shape[1]) - u.shape[1])))
    turns = -(-BITS // wide.shape[1])
    r = np.concatenate([rotate(wide, (1 << 20) + k) for k in range(turns)], axis=1)[:, :BITS] > 0
    return np.packbits(r, axis=1).view(np.uint64)


def bit_limit(threshold: float) -> int:
    """Sign bits in which vectors at the threshold differ at most, but for a chance below 1 in 100,000."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return min(BITS, math.ceil(BITS * p + 4.5 * math.sqrt(BITS * p * (1 - p))))


def hash_count(rows: int, dim: int) -> int:
    """Hashes a key: enough for at most about PER_BUCKET vectors a bucket were they spread evenly."""
    return max(1, min(MOST_HASHES, math.ceil(math.log(max(2, rows / PER_BUCKET)) / math.log(2 * padded(dim)))))


def _usable(values: list | None) -> tuple[bytes, bytes] | None:
    """A vector's digest and bytes: of 32-bit floats where these hold it exactly."""
    if not values or any(x is None for x in values):
        return None
    v = np.array(values, float) + 0.0  # no negative zeros
    if not np.isfinite(v).all() or not v.any():
        return None
    with np.errstate(over="ignore"):
        short = v.astype("<f4")
    return xxhash.xxh3_128_digest(v.astype("<f8").tobytes()), (short if (short == v).all() else v.astype("<f8")).tobytes()


def _vectors(raw: list[bytes], dim: int) -> np.ndarray:
    return unit(np.stack([np.frombuffer(b, "<f4" if len(b) == 4 * dim else "<f8") for b in raw]).astype(float))


def _groups(batches, keys: int):
    """Runs of rows with equal first ``keys`` columns, which may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    release()
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
            key = tuple(int(c[a]) for c in cols)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def _cells(members: DataFrame, block: int) -> DataFrame:
    """Deal bucket members (key, rep, own, ...) to cells (key, i, j) of at most about two blocks.

    A bucket of a block or less is one cell. Of a larger one, vectors at home and
    visitors are cut into parts; every two parts of which one is at home share a cell.
    """
    sizes = members.groupBy("key").agg(F.count_if("own").alias("owners"), F.count(F.lit(1)).alias("size")).where("owners > 0 and size > 1")
    dealt = members.join(sizes, "key")
    whole, drawn = F.col("size") <= block, F.xxhash64("rep")
    homes = F.when(whole, 1).otherwise(F.ceil(F.col("owners") / block)).cast("int")
    guests = F.when(whole, 0).otherwise(F.ceil((F.col("size") - F.col("owners")) / block)).cast("int")
    dealt = dealt.withColumn("homes", homes).withColumn("guests", guests)
    guest = F.when(whole, 0).otherwise(F.col("homes") + F.pmod(drawn, F.greatest("guests", F.lit(1))))
    dealt = dealt.withColumn("salt", F.when(F.col("own"), F.pmod(drawn, F.col("homes"))).otherwise(guest).cast("int"))
    last = F.when(F.col("own"), F.col("homes") + F.col("guests")).otherwise(F.col("homes")) - 1
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last))).withColumn("i", F.least("salt", "other")).withColumn("j", F.greatest("salt", "other"))
    dealt = dealt.drop("owners", "size", "homes", "guests", "other")
    return dealt.repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j")


def _first_met(near: np.ndarray, own: np.ndarray, salt: np.ndarray, key: int, across: bool) -> np.ndarray:
    """Pairs of a cell that first meet in its bucket; ``near``: members x tables up to this one x probes."""
    new = own[:, None] | own[None, :]
    np.fill_diagonal(new, False)
    if across:
        new &= salt[:, None] != salt[None, :]
    here = np.uint32(key & 0xFFFFFFFF)
    for t in range(near.shape[1]):
        if not new.any():
            break
        home, last = near[:, t, 0], t == near.shape[1] - 1
        visits = np.zeros_like(new)  # a row enters the home of a column
        for p in range(near.shape[2]):
            visits |= near[:, t, p, None] == home[None, :]
        if last:
            visits &= (home < here)[None, :]
        new &= ~(visits | visits.T)
    return new


def _roots(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each row reaches in a symmetric boolean matrix."""
    root = np.full(len(linked), -1)
    for s in range(len(linked)):
        if root[s] < 0:
            front = np.zeros(len(linked), bool)
            front[s] = True
            seen = front
            while front.any():
                front = linked[front].any(axis=0) & ~seen
                seen = seen | front
            root[seen] = s
    return root


def link_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """Find pairs with cosine >= ``threshold`` and their components.

    Returns ``id_col``, n_links (other rows linked directly, equal vectors included),
    component_id (the smallest id reachable by links, itself included) and kept (it is
    its own component's smallest id), one row per input row. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing, nor do
    vectors of different lengths. A row with a null id takes part in no link; its
    component is null and it is not kept. Other columns are ignored; an empty table
    gives an empty table.
    """
    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(id_col).alias("k"), F.col(vector_col).cast("array<double>").alias("v"))

    def read(batches):
        schema = arrow_schema([("k", pa.int64()), ("digest", pa.binary()), ("dim", pa.int32()), ("v", pa.binary())])
        for rows in slices(batches):
            values = rows.column(1).to_pylist()
            raw = [_usable(v) for v in values]
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array([r and r[0] for r in raw], pa.binary()), pa.array([r and len(v) for r, v in zip(raw, values, strict=True)], pa.int32()), pa.array([r and r[1] for r in raw], pa.binary())], schema=schema)

    seen = src.mapInArrow(read, "k long, digest binary, dim int, v binary")
    rows = stage(seen.withColumn("v", F.when(F.col("k").isNotNull(), F.col("v"))), "vectors")
    usable = rows.where("v is not null")
    classes = stage(usable.groupBy("digest").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("v").alias("v")), "classes")
    shape = {}
    for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect():
        hashes = hash_count(r["n"], r["dim"])
        shape[r["dim"]] = (hashes, *tables_and_probes(r["dim"], hashes, threshold))

    def by_dim(part, dim_at, v_at):
        dims = np.asarray(part.column(dim_at))
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            yield d, at, _vectors(part.column(v_at).take(pa.array(at)).to_pylist(), d)

    def enter(batches):
        schema = arrow_schema([("key", pa.int64()), ("rep", pa.int64()), ("own", pa.bool_()), ("near", pa.binary()), ("bits", pa.binary())])
        for part in slices(batches):
            reps = np.asarray(part.column(0))
            for d, at, u in by_dim(part, 1, 2):
                keys, bits = bucket_keys(u, *shape[d]), sign_bits(u)
                words = [b.tobytes() for b in bits]
                for t in range(keys.shape[1]):
                    # A bucket that a vector enters more than once, it enters first by the better probe.
                    new = np.stack([~(keys[:, t, :p] == keys[:, t, p, None]).any(axis=1) for p in range(keys.shape[2])], axis=1)
                    row, p = np.nonzero(new)
                    near = [k.tobytes() for k in np.ascontiguousarray(keys[:, : t + 1])]
                    key = keys[row, t, p].astype(np.int64) | (t << 32) | (d << 40)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(reps[at][row]), pa.array(p == 0), pa.array([near[i] for i in row.tolist()], pa.binary()), pa.array([words[i] for i in row.tolist()], pa.binary())], schema=schema)

    def first_met(key, i, j, part, own_at, near_at, salt_at):
        """The pairs of a cell that first meet in its bucket."""
        own, salt = (np.asarray(part.column(c)) for c in (own_at, salt_at))
        near = np.frombuffer(b"".join(part.column(near_at).to_pylist()), np.uint32)
        return _first_met(near.reshape(len(own), (key >> 32 & 255) + 1, -1), own, salt, key, i != j)

    def close(batches):
        schema = arrow_schema([("key", pa.int64()), ("rep", pa.int64()), ("own", pa.bool_()), ("near", pa.binary())])
        for (key, i, j), part in _groups(batches, 3):
            bits = np.frombuffer(b"".join(part.column(6).to_pylist()), np.uint64).reshape(part.num_rows, -1)
            apart = np.zeros((len(bits), len(bits)), np.uint8)
            for w in range(bits.shape[1]):
                apart += np.bitwise_count(bits[:, w, None] ^ bits[None, :, w])
            near = apart <= bit_limit(threshold)
            np.fill_diagonal(near, False)
            some = np.flatnonzero(near.any(axis=1))
            if not len(some):
                continue
            part = part.take(pa.array(some))
            stay = (near[np.ix_(some, some)] & first_met(key, i, j, part, 4, 5, 7)).any(axis=1)
            if stay.any():
                part = part.filter(pa.array(stay))
                yield pa.RecordBatch.from_arrays([part.column(c).combine_chunks() for c in (0, 3, 4, 5)], schema=schema)

    def verify(batches):
        schema = arrow_schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        for (key, i, j), part in _groups(batches, 3):
            u = _vectors(part.column(8).to_pylist(), key >> 40)
            linked = (u @ u.T >= threshold) & first_met(key, i, j, part, 4, 5, 6)
            if linked.any():
                reps, copies = np.asarray(part.column(3)), np.asarray(part.column(7)).astype(float)
                links, hit = (linked @ copies).astype(np.int64), np.flatnonzero(linked.any(axis=1))
                roots = hit[_roots(linked[np.ix_(hit, hit)])]
                yield pa.RecordBatch.from_arrays([pa.array(reps[hit]), pa.array(links[hit]), pa.array(reps[roots])], schema=schema)

    postings = classes.select("rep", "dim", "v").mapInArrow(enter, "key long, rep long, own boolean, near binary, bits binary")
    cells = _cells(postings, block).select("key", "i", "j", "rep", "own", "near", "bits", "salt")
    survivors = stage(cells.mapInArrow(close, "key long, rep long, own boolean, near binary").distinct(), "survivors")
    met = _cells(survivors.join(classes.select("rep", "copies", "v"), "rep"), block // 2)
    found = stage(met.select("key", "i", "j", "rep", "own", "near", "salt", "copies", "v").mapInArrow(verify, "rep long, links long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found, "rep", "root").withColumnRenamed("node", "rep")
    per_class = classes.select("digest", "rep", "copies").join(links, "rep", "left").join(parts, "rep", "left")
    per_class = per_class.select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    keyed = rows.select("k", F.when(F.col("v").isNotNull(), F.col("digest")).alias("digest"))
    out = keyed.join(per_class, "digest", "left").select(
        F.col("k").cast(kind).alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "k").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
