"""Exact Jaccard self-join of word n-gram sets, by partition of the token universe.

Sets are banded by size. Two sets that reach the threshold differ in at most H
tokens, H following from the largest sizes of their band. A scheme of a band hashes
the universe into segments; by the pigeonhole principle some segment i has at most
e_i differences once the sum of (e_i + 1) exceeds H. A segment is skipped (e = -1),
indexed by its subset (0) or by the subset and its one-deletion neighbourhood (1);
the allocation takes the cheapest segments, costs being estimated on a bounded
sample. It steers cost only: any allocation with that sum loses no pair. With a sum
greater by a slack, a set may leave out as many segments whose subset is empty or
common in the sample (a passage that many texts share): a pair agrees in more segments
than that, and an agreeing subset is common for both sets or for neither.

Set ids that meet under a signature are candidates. They are verified in two rounds,
so that a large group of near copies never becomes all its pairs. Every member of a
signature's group is paired with the smallest one; of its pairs from groups of three and
more a member keeps the one that most of its signatures name, as the second round looks
at these groups again. Sizes and parity sketches, whose distance can't exceed the number
of differing tokens, drop most wrong pairs; one pair a member is verified exactly, and
components are formed. Then only pairs and groups
that still hold several components are looked at again: their members are compared
across components, in cells of bounded size, by sizes and sketches; a task gets each
sketch once, and the groups as ids. What passes connects families, whose sets are read
and verified exactly. Equal sets are one class from the start.
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
from .embeddings import _groups, _roots
from .fingerprints import MEMO_ENTRIES, _STEP, mix
from .graph import connected_components

_LOW = np.uint64((1 << 48) - 1)

WORDS = 4
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
BAND_RATIO = 1.6
#: Sets (expected) on which the costs of segments are estimated; they never change results.
COST_SAMPLE = 4000
#: Slacks that are tried for a band, as parts of the least sum of its allocation.
SLACKS = (0.02, 0.1, 0.2, 0.35, 0.6, 1.0)
#: A subset is common that so many sampled sets have, and by the sample so many sets of all.
COMMON_SAMPLED = 3
COMMON_SETS = 32
#: Postings that a group costs a member, and members that it may have for each more.
GROUP_COST = 4
GROUP_SETS = 64
#: Postings that a task holds before it deals them out, and that a deal is meant to hold.
FLUSH = 1 << 20
DEAL_POSTINGS = 1 << 22
#: Class ids of a group in one row.
GROUP_IDS = 1 << 16
BLOCK = 1024
CODE_RATIO = 1.056
#: Tokens and sets of a part of a family: a comparing task holds two parts.
CELL_TOKENS = 1 << 20
CELL_SETS = 1 << 11
#: Cells of the sketches of the index, and of those made of read sets, to one of a plain sketch.
SKETCH = 4
FINE = 8
#: Pairs of sets that a task looks at together.
PAIRS = 1 << 20
#: Group rows of one family that a task compares, on average.
FAMILY = 1 << 13
#: Class ids up to which the ids of candidates are broadcast to the second reading of the texts.
BROADCAST_IDS = 1 << 20


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[word] = h
        return h


_WORDS = _Words()


def shingle_set(text: str | None, width: int = WORDS) -> np.ndarray:
    """Distinct hashes of the runs of ``width`` words, ascending; fewer words: of them all.

    A-Z are lower-cased and words end at ASCII white space only. No words: empty.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - width + 1)
    total = np.zeros(n, np.uint64)
    for j in range(min(width, len(w))):
        total = total * _STEP + w[j : j + n]
    return np.unique(mix(total))


def band_start(k: int) -> int:
    return math.ceil(BAND_RATIO**k)


@lru_cache(maxsize=1 << 16)
def band_of(n: int) -> int:
    k = int(math.log(max(1, n)) / math.log(BAND_RATIO))
    while band_start(k + 1) <= n:
        k += 1
    while band_start(k) > n:
        k -= 1
    return k


def most_different(total: int, percent: int = PERCENT) -> int:
    """Most tokens by which two sets differ that reach the threshold, their sizes adding up to ``total``."""
    return (100 - percent) * total // (100 + percent)


class Scheme:
    """Segments and allocation of one band; ``skip``: its slack and, ascending, the keys of common subsets."""

    def __init__(self, band: int, percent: int, costs: tuple[np.ndarray, np.ndarray] | None = None, skip: tuple[int, np.ndarray] | None = None):
        self.band = band
        self.limit = most_different(2 * (band_start(band + 1) - 1), percent)
        base = self.limit + 1
        self.slack, self.common = skip if skip is not None else (1 + base // 50, np.empty(0, np.uint64))
        need = base + self.slack
        self.segments = need + 1 + need // 10
        zero, one = costs if costs is not None else (np.ones(self.segments), np.full(self.segments, np.inf))
        # Marginal costs of the two steps; the second is never taken before the first.
        steps = np.concatenate([zero, np.maximum(one - zero, zero)])
        taken = np.argsort(steps, kind="stable")[:need]
        self.level = np.bincount(taken % self.segments, minlength=self.segments) - 1
        self.seed = np.uint64((band + 1) << 32)

    def split(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment of each token, its value, and each segment's sum of values."""
        seg = (((tokens >> np.uint64(32)) * np.uint64(self.segments)) >> np.uint64(32)).astype(np.int64)
        value = mix(tokens ^ np.uint64(0x5851F42D4C957F2D))
        total = np.zeros(self.segments, np.uint64)
        np.add.at(total, seg, value)
        return seg, value, total

    def key(self, total: np.ndarray, seg: np.ndarray) -> np.ndarray:
        return mix(total + (self.seed + seg.astype(np.uint64)) * np.uint64(0xD1342543DE82EF95))

    def signatures(self, tokens: np.ndarray) -> np.ndarray:
        seg, value, total = self.split(tokens)
        size = np.bincount(seg, minlength=self.segments)
        at = np.flatnonzero(self.level >= 0)
        keys = self.key(total[at], at)
        common = size[at] == 0
        if len(self.common):
            common |= self.common[np.minimum(np.searchsorted(self.common, keys), len(self.common) - 1)] == keys
        # Only where subsets must be equal: there they are common for both sets or for neither.
        common &= self.level[at] == 0
        out = [keys[~common] if common.sum() <= self.slack else keys]
        if (self.level > 0).any():
            pick = self.level[seg] > 0
            out.append(self.key(total[seg[pick]] - value[pick], seg[pick]))
        return np.concatenate(out)


class Plan:
    """The schemes that a set of a given size is indexed under."""

    def __init__(self, percent: int, costs: dict[int, tuple[np.ndarray, np.ndarray]], skips: dict[int, tuple[int, np.ndarray]] | None = None):
        self.percent, self.costs, self.skips, self.made = percent, costs, skips or {}, {}

    def scheme(self, band: int) -> Scheme:
        if band not in self.made:
            self.made[band] = Scheme(band, self.percent, self.costs.get(band), self.skips.get(band))
        return self.made[band]

    def bands(self, n: int) -> list[int]:
        """Its own band, and the next one if a partner may lie there."""
        k = band_of(n)
        near = [k, k + 1] if 100 * n >= self.percent * band_start(k + 1) else [k]
        return [b for b in near if most_different(2 * (band_start(b + 1) - 1), self.percent)]

    def signatures(self, tokens: np.ndarray) -> np.ndarray:
        found = [self.scheme(b).signatures(tokens) for b in self.bands(len(tokens))] if len(tokens) else []
        return np.concatenate(found) if found else np.empty(0, np.uint64)


def _cost(postings: np.ndarray, met: np.ndarray) -> np.ndarray:
    """The mean cost a set of each segment: postings, and what groups with others cost."""
    return (postings + (met > 0) * GROUP_COST + met / GROUP_SETS).mean(axis=0)


def tuned_plan(sample: list[np.ndarray], percent: int, scale: float) -> Plan:
    """The plan that costs least on sampled sets, each standing for ``scale`` sets.

    For each band a slack is chosen by the postings that are left and the groups they
    meet in; then the segments' costs: postings and sets met, for subset and neighbourhood.
    """
    plain, by_band = Plan(percent, {}), {}
    for tokens in {x.tobytes(): x for x in sample}.values():
        for b in plain.bands(len(tokens)) if len(tokens) else []:
            by_band.setdefault(b, []).append(tokens)
    costs, skips = {}, {}
    for b, sets in by_band.items():
        base, best = plain.scheme(b).limit + 1, None
        for slack in sorted({1 + int(base * share) for share in SLACKS}):
            scheme = Scheme(b, percent, None, (slack, np.empty(0, np.uint64)))
            split = [scheme.split(x) for x in sets]
            total, size = np.stack([t for _, _, t in split]), np.stack([np.bincount(g, minlength=scheme.segments) for g, _, _ in split])
            keys = scheme.key(total, np.arange(scheme.segments)[None, :])
            values, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
            counts = counts[inverse.reshape(-1)].reshape(keys.shape)
            common = (size == 0) | (counts >= COMMON_SAMPLED) & (counts * scale >= COMMON_SETS)
            kept = ~(common & (common.sum(axis=1) <= slack)[:, None])
            zero = _cost(kept, np.where(kept, (counts - 1) * scale, 0.0))
            # All of the segments that a scheme has are looked at; the dearest tenth will be left out.
            if best is None or zero.sum() < best[0]:
                # A neighbourhood is never left out, and sets with one token or none meet under its empty subset.
                few = ((size <= 1).sum(axis=0) - 1) * scale
                one = _cost(1 + size, np.where(size <= 1, np.maximum(few, 0), (counts - 1) * scale))
                best = (zero.sum(), slack, np.unique(keys[common & (size != 0)]), (zero, one))
        skips[b], costs[b] = best[1:3], best[3]
    return Plan(percent, costs, skips)


def size_code(n: int) -> int:
    """A size in one byte, on a scale of logarithms."""
    return min(255, int(math.log(max(1, n)) / math.log(CODE_RATIO)))


def code_span(percent: int) -> int:
    """By how much the codes of sizes may differ whose sets can reach the threshold."""
    return math.ceil(math.log(100 / percent) / math.log(CODE_RATIO) + 1e-6)


def _digest(tokens: np.ndarray) -> tuple[bytes, int]:
    """A set's 128-bit digest, and the id it has in postings: 56 bits of it and its size code."""
    d = xxhash.xxh3_128_digest(tokens.tobytes())
    return d, int.from_bytes(bytes([size_code(len(tokens))]) + d[:7], "little", signed=True)


def _odd(tokens: np.ndarray, fine: int = 1) -> bytes:
    """Parities of the tokens by hash cell, one cell for two tokens or more, a power of two in all.

    The cells in which two sets' parities differ are at most the tokens in which the
    sets differ. Halves laid over each other are the parities for half the cells.
    ``fine``, a power of two, multiplies the cells.
    """
    cells = fine << max(6, (len(tokens) - 1).bit_length() - 1)
    at = ((tokens >> np.uint64(7)) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=cells) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(odd: np.ndarray, size: int) -> np.ndarray:
    while len(odd) > size:
        odd = odd[: len(odd) // 2] ^ odd[len(odd) // 2 :]
    return odd


def _block(sig: np.ndarray, doc: np.ndarray, cid: np.ndarray) -> bytes:
    """Postings as bytes: the class ids met, and by ascending signature its low 48 bits and the class's place.

    Bytes of equal weight lie together, so that the leading ones, which ascend, compress.
    """
    order = np.argsort(sig & _LOW, kind="stable")
    ids, place = np.unique(doc[order], return_inverse=True)
    low = np.ascontiguousarray((sig[order] & _LOW).view(np.uint8).reshape(-1, 8)[:, :6].T)
    place = np.ascontiguousarray(place.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : 2 if len(ids) <= 1 << 16 else 4].T)
    return np.array([len(sig), len(ids)], "<i8").tobytes() + cid[ids].tobytes() + low.tobytes() + place.tobytes()


def _unblock(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (low 48 bits) and class ids of a block."""
    n, classes = np.frombuffer(data, "<i8", 2).tolist()
    cid, rest = np.frombuffer(data, np.int64, classes, 16), np.frombuffer(data, np.uint8, offset=16 + 8 * classes)
    sig, place = np.zeros((n, 8), np.uint8), np.zeros((n, 4), np.uint8)
    sig[:, :6] = rest[: 6 * n].reshape(6, n).T
    wide = rest[6 * n :].reshape(-1, n)
    place[:, : len(wide)] = wide.T
    return sig.view("<u8")[:, 0], cid[place.view("<u4")[:, 0]]


def _index(docs: DataFrame, plan: Plan, deals: int, width: int) -> DataFrame:
    """Rows of documents (doc, n, digest, class id) and of packed postings (deal, postings)."""
    kind = [("deal", pa.int32()), ("doc", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("cid", pa.int64()), ("odd", pa.binary()), ("postings", pa.binary())]
    schema = arrow_schema(kind)

    def run(batches):
        held, cids, size, done = [], [], 0, set()

        def flush():
            sig = np.concatenate(held)
            doc = np.repeat(np.arange(len(held)), list(map(len, held)))
            deal = (sig >> np.uint64(40)) % np.uint64(deals)
            order = np.argsort(deal, kind="stable")
            sig, doc, cid = sig[order], doc[order], np.array(cids, np.int64)
            ends = np.searchsorted(deal[order], np.arange(deals + 1))
            some = np.flatnonzero(np.diff(ends))
            none = [None] * len(some)
            blocks = [_block(sig[ends[i] : ends[i + 1]], doc[ends[i] : ends[i + 1]], cid) for i in some.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([some.astype(np.int32), none, none, none, none, none, blocks], schema, strict=True)], schema=schema)

        for rows in slices(batches):
            out = []
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                tokens = shingle_set(text, width)
                digest, cid = _digest(tokens)
                out.append((hash(doc) % deals, doc, len(tokens), digest, cid, _odd(tokens, SKETCH), None))
                if digest in done or not len(tokens):
                    continue
                if len(done) < 1 << 20:
                    done.add(digest)
                sig = plan.signatures(tokens)
                if len(sig):
                    held.append(sig)
                    cids.append(cid)
                    size += len(sig)
                if size >= FLUSH:
                    yield flush()
                    held, cids, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if held:
            yield flush()

    src = docs.mapInArrow(run, "deal int, doc long, n long, digest binary, cid long, odd binary, postings binary")
    return src.repartitionById(deals, F.col("deal"))


def _meet(indexed: DataFrame, percent: int) -> DataFrame:
    """Pass documents on; turn a deal's postings into stars (a, b) and groups (key, members) of three and more ids.

    Of the ids under a signature each is paired with the one of the smallest size that it can link with;
    ``votes`` are the signatures that name a pair, ``alone`` tells that a group of two is among them.
    """
    schema = arrow_schema([("doc", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("cid", pa.int64()), ("odd", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("votes", pa.int64()), ("alone", pa.bool_()), ("key", pa.int64()), ("members", pa.binary())])

    def rows_of(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

    def run(batches):
        blocks: list[bytes] = []
        release()
        for rows in batches:
            part = rows.filter(rows.column(6).is_null())
            if part.num_rows:
                yield rows_of(part.num_rows, **{schema.field(i - 1).name: part.column(i).cast(schema.field(i - 1).type) for i in range(1, 6)})
            blocks += [b for b in rows.column(6).to_pylist() if b is not None]
        if not blocks:
            return
        sig, cid = (np.concatenate(x) for x in zip(*map(_unblock, blocks), strict=True))
        blocks.clear()
        order = np.argsort(sig, kind="stable")
        sig, cid = sig[order], cid[order]
        new = np.concatenate([[True], sig[1:] != sig[:-1]])
        count = np.diff(np.append(np.flatnonzero(new), len(sig)))
        many = np.repeat(count > 1, count)
        sig, cid = sig[many], cid[many]
        order = np.lexsort((cid, cid & 255, sig))
        sig, cid = sig[order], cid[order]
        keep = np.concatenate([[True], (sig[1:] != sig[:-1]) | (cid[1:] != cid[:-1])]) if len(sig) else np.zeros(0, bool)
        sig, cid = sig[keep], cid[keep]
        if not len(sig):
            return
        new = np.concatenate([[True], sig[1:] != sig[:-1]])
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(sig)))
        place = np.cumsum(new) * 1024 + (cid & 255)
        hub = cid[np.searchsorted(place, place - code_span(percent))]
        two = np.repeat(count == 2, count)[cid != hub]
        pair, named, votes = np.unique(np.stack([cid, hub], axis=1)[cid != hub], axis=0, return_inverse=True, return_counts=True)
        alone = np.bincount(named.reshape(-1)[two], minlength=len(pair)) > 0
        for i in range(0, len(pair), 1 << 16):
            w = slice(i, i + (1 << 16))
            p = pair[w]
            yield rows_of(len(p), a=pa.array(np.ascontiguousarray(p[:, 0])), b=pa.array(np.ascontiguousarray(p[:, 1])), votes=pa.array(votes[w], pa.int64()), alone=pa.array(alone[w]))
        done, held, size = set(), [], 0
        for s, c in zip(start[count > 2].tolist(), count[count > 2].tolist(), strict=True):
            ids = cid[s : s + c]
            key = xxhash.xxh3_64_intdigest(ids.tobytes())
            if key in done:
                continue
            done.add(key)
            held += [(key - (1 << 63), ids[k : k + GROUP_IDS].tobytes()) for k in range(0, c, GROUP_IDS)]
            size += c
            if size >= FLUSH:
                yield rows_of(len(held), key=pa.array([k for k, _ in held], pa.int64()), members=pa.array([m for _, m in held], pa.binary()))
                held, size = [], 0
        if held:
            yield rows_of(len(held), key=pa.array([k for k, _ in held], pa.int64()), members=pa.array([m for _, m in held], pa.binary()))

    return indexed.mapInArrow(run, "doc long, n long, digest binary, cid long, odd binary, a long, b long, votes long, alone boolean, key long, members binary")


def _first_pairs(stars: DataFrame) -> DataFrame:
    """Of stars (a, b, votes, alone) the pairs (a, b) of the first round: those of a group of two, and each a's most named one.

    A group of two has no other row; the pairs left out are in groups that ``_across`` compares.
    """
    each = stars.groupBy("a", "b").agg(F.sum("votes").alias("votes"), F.bool_or("alone").alias("alone"))
    kept = each.groupBy("a").agg(F.max(F.struct("votes", "b")).alias("most"), F.collect_list(F.when(F.col("alone"), F.col("b"))).alias("alone"))
    return kept.select("a", F.explode(F.array_union("alone", F.array("most.b"))).alias("b"))


def _open_pair(na: int, nb: int, oa: bytes, ob: bytes, percent: int) -> bool:
    """Whether sizes and parities leave it open that two sets reach the threshold."""
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    x, y = (np.frombuffer(o, np.uint8) for o in (oa, ob))
    size = min(len(x), len(y))
    apart = int(np.bitwise_count((_folded(x, size) ^ _folded(y, size)).view(np.uint64)).sum())
    return (100 + percent) * apart <= (100 - percent) * (na + nb)


def _near_pairs(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Of pairs of class ids, as pairs of documents (a > b), those that sizes and parities leave open."""
    one = pairs.join(info.select(F.col("cid").alias("a"), F.col("doc").alias("da"), F.col("n").alias("na"), F.col("odd").alias("oa")), "a")
    both = one.join(info.select(F.col("cid").alias("b"), F.col("doc").alias("db"), F.col("n").alias("nb"), F.col("odd").alias("ob")), "b")

    def run(batches):
        for rows in slices(batches):
            good = [_open_pair(*x, percent) for x in zip(*(rows.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(i).filter(pa.array(good, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    return both.where("da != db").select(F.greatest("da", "db").alias("a"), F.least("da", "db").alias("b"), "na", "nb", "oa", "ob").mapInArrow(run, "a long, b long")


def _read_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Token sets of documents, read again.

    ``wanted``: doc and other ids, kept beside n, the set's size, and tokens.
    """
    wanted = stage(wanted, "wanted")
    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    names = wanted.columns

    def run(batches):
        for rows in slices(batches):
            sets = [shingle_set(t, width) for t in rows.column(len(names)).to_pylist()]
            n = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(names)], n, pa.array([x.tobytes() for x in sets], pa.binary())], names=[*names, "n", "tokens"])

    fields = ", ".join(f"{n} long" for n in names)
    return docs.join(ids, "doc").select(*names, "text").mapInArrow(run, f"{fields}, n long, tokens binary")


def _reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets of distinct tokens reach the threshold."""
    merged = np.concatenate([x, y])
    merged.sort()
    common = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return 100 * common >= percent * (len(merged) - common)


def _compared(both: DataFrame, percent: int) -> DataFrame:
    """Of (a, b, ta, tb) the pairs whose sets reach the threshold."""

    def run(batches):
        for rows in slices(batches):
            sets = (map(lambda t: np.frombuffer(t, np.uint64), rows.column(i).to_pylist()) for i in (2, 3))
            good = [_reaches(x, y, percent) for x, y in zip(*sets, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(i).filter(pa.array(good, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _verified_star(docs: DataFrame, star: DataFrame, percent: int, width: int) -> DataFrame:
    """Verify pairs that hold each ``a`` once: every set crosses the network once."""
    leaves = _read_sets(docs, star.withColumnRenamed("a", "doc"), width).withColumnsRenamed({"doc": "a", "tokens": "ta"})
    hubs = _read_sets(docs, star.select(F.col("b").alias("doc")).distinct(), width).withColumnsRenamed({"doc": "b", "tokens": "tb"})
    return _compared(leaves.join(hubs, "b"), percent)


class _Sketches:
    """Sketches by their length, folded to half of it where asked."""

    def __init__(self, odd: list):
        odd = [np.frombuffer(o, np.uint8) for o in odd]
        self.length = np.array([len(o) for o in odd], np.int64)
        self.place, self.by = np.zeros(len(odd), np.int64), {}
        for size in np.unique(self.length).tolist():
            at = np.flatnonzero(self.length == size)
            self.place[at] = np.arange(len(at))
            self.by[size, size] = np.stack([odd[i] for i in at.tolist()])

    def rows(self, at: np.ndarray, size: int, to: int) -> np.ndarray:
        """Sketches ``at``, all of ``size`` bytes, folded to ``to``, as 64-bit words."""
        if (size, to) not in self.by:
            half = self.by[size, size]
            while half.shape[1] > to:
                half = half[:, : half.shape[1] // 2] ^ half[:, half.shape[1] // 2 :]
            self.by[size, to] = np.ascontiguousarray(half)
        return self.by[size, to][self.place[at]].view(np.uint64)


def _open_pairs(odd: list | _Sketches, n: np.ndarray, group: np.ndarray, side: np.ndarray | None, percent: int, members: np.ndarray | None = None):
    """Blocks (p, q) of pairs of different groups, and sides if given, that sizes and sketches leave open.

    ``n`` and ``group`` go by member, as p and q do; ``members`` are their places among the
    sketches (all of them). ``group`` may change between two blocks; what is one group by then is left out.
    """
    sketches = odd if isinstance(odd, _Sketches) else _Sketches(odd)
    members = np.arange(len(n)) if members is None else members
    length = sketches.length[members]
    for size in np.unique(length).tolist():
        # A set more than twice as large can't reach the threshold of another.
        mine, twice = np.flatnonzero(length == size), np.flatnonzero(length == 2 * size)
        rest = np.concatenate([mine, twice])
        if len(rest) < 2:
            continue
        levels = []
        for s in sorted({max(8, size // FINE), size}):
            x = sketches.rows(members[mine], size, s)
            levels.append((x, np.concatenate([x, sketches.rows(members[twice], 2 * size, s)]) if len(twice) else x))
        step = max(1, PAIRS // len(rest))
        for at in range(0, len(mine), step):
            i = mine[at : at + step, None]
            near = (group[i] != group[rest]) & ((length[rest] > size) | (rest > i))
            near &= 100 * np.minimum(n[i], n[rest]) >= percent * np.maximum(n[i], n[rest])
            if side is not None:
                near &= side[i] != side[rest]
            p, q = np.nonzero(near)
            p += at
            for u, v in levels:
                most = (100 - percent) * (n[mine[p]] + n[rest[q]])
                keep = np.zeros(len(p), bool)
                some = max(1, (PAIRS << 4) // u.shape[1])
                for k in range(0, len(p), some):
                    w = slice(k, k + some)
                    keep[w] = (100 + percent) * np.bitwise_count(u[p[w]] ^ v[q[w]]).sum(axis=1, dtype=np.int64) <= most[w]
                p, q = p[keep], q[keep]
            if len(p):
                yield mine[p], rest[q]


def _stars(pairs, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves and roots (places below ``n``) of the parts that blocks of pairs connect."""
    linked = None
    for p, q in pairs:
        linked = np.zeros((n, n), bool) if linked is None else linked
        linked[p, q] = linked[q, p] = True
    if linked is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    leaf = np.flatnonzero(linked.any(axis=1))
    root = leaf[_roots(linked[np.ix_(leaf, leaf)])]
    return leaf[leaf != root], root[leaf != root]


def _lowest(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the lowest one that pairs (p, q) connect it with."""
    low = np.arange(n)
    while (low[p] != low[q]).any():
        least = np.minimum(low[p], low[q])
        np.minimum.at(low, low[p], least)
        np.minimum.at(low, low[q], least)
        while (low[low] != low).any():
            low = low[low]
    return low


class _Cell:
    """What one task compares of a family: of one part all members, of two parts those of different parts."""

    def __init__(self, rows: pa.Table, percent: int):
        self.percent = percent
        self.doc, comp, side = (np.asarray(rows.column(i)) for i in (3, 4, 5))
        self.n, self.data = np.asarray(rows.column(6)), rows.column(7).to_pylist()
        self.group = np.unique(comp, return_inverse=True)[1]
        self.side = side if len(np.unique(side)) > 1 else None

    def _pairs(self, odd: list[bytes]):
        return _open_pairs(odd, self.n, self.group, self.side, self.percent)

    def links(self) -> np.ndarray:
        """Links that join what is still apart; none is missing that joins more."""
        sets = [np.frombuffer(x, np.uint64) for x in self.data]
        out = []
        for some in self._pairs([_odd(x, FINE) for x in sets]):
            for x, y in zip(*(v.tolist() for v in some), strict=True):
                if self.group[x] != self.group[y] and _reaches(sets[x], sets[y], self.percent):
                    self.group[self.group == self.group[y]] = self.group[x]
                    out.append((self.doc[x], self.doc[y]))
        return np.array(out, np.int64).reshape(-1, 2)


def _families(docs: DataFrame, info: DataFrame, edges: DataFrame, parts: DataFrame, percent: int, width: int) -> DataFrame:
    """Links within families, a family being what ``edges`` connect, verified exactly.

    A family's sets go to one task, once; a large family is cut into cells of two parts of about CELL_TOKENS tokens and CELL_SETS sets, and a set goes
    to the cells of its part. A task compares what is in different components, joins them
    as it finds links, and returns the links that joined: no list of pairs is ever made.
    """
    each = info.groupBy(F.col("doc").alias("node")).agg(F.sum("n").alias("n"))
    family = stage(connected_components(edges).withColumnRenamed("component", "family").join(each, "node"), "families")
    cut = family.groupBy("family").agg(F.ceil(F.greatest(F.sum("n") / CELL_TOKENS, F.count(F.lit(1)) / CELL_SETS)).cast("long").alias("parts"))
    known = parts.withColumnRenamed("component", "known")
    salt = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("long").alias("salt")
    placed = family.join(cut, "family").join(known, "node", "left").select(F.col("node").alias("doc"), "family", F.coalesce("known", "node").alias("known"), salt, "parts")
    sets = _read_sets(docs, placed, width).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    # With two parts and more, the cell of a part with itself is needed once, and each two parts' cell once.
    sets = sets.select("family", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "doc", "known", "salt", "n", "tokens")
    dealt = sets.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")

    def run(batches):
        for _, part in _groups(batches, 3):
            found = _Cell(part, percent).links()
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _members(groups: DataFrame, info: DataFrame) -> DataFrame:
    """Groups of class ids (key, members) as rows (key, rep): the group and a class's document."""

    def spread(batches):
        for rows in batches:
            for key, g in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(g, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), key)), pa.array(ids)], names=["key", "cid"])

    members = groups.mapInArrow(spread, "key long, cid long")
    return members.join(info.select("cid", "doc"), "cid").select("key", F.col("doc").alias("rep")).distinct()


def _across(members: DataFrame, info: DataFrame, parts: DataFrame, percent: int, block: int) -> DataFrame:
    """What sizes and sketches leave open between different components of a group, as stars (a, b).

    Of a group's graph of open pairs each connected part is returned as a star, so its
    size is that of the group. Groups with the same smallest member mostly are one
    family's; they go to one lane, or by their number of rows to several, and a group
    larger than ``block`` to the lanes of its cells. A lane gets the sketch of each of
    its members once and its groups as ids; it returns one star for what its groups'
    stars connect, so its rows are fewer than its members.
    """
    labelled = members.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("rep").alias("hub"), F.count(F.lit(1)).alias("rows")).where("x < y").drop("x", "y")
    sizes = stage(sizes, "groups")
    lanes = sizes.groupBy("hub").agg(F.ceil(F.sum("rows") / FAMILY).cast("int").alias("lanes"))
    lane = F.pmod(F.xxhash64("key"), F.col("lanes")).cast("long")
    mixed = sizes.join(lanes, "hub").select("key", "hub", lane.alias("lane"), F.ceil(F.col("rows") / block).cast("int").alias("parts"))
    rows = labelled.join(mixed, "key").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    i, j = F.least("salt", "other"), F.greatest("salt", "other")
    rows = rows.select(F.xxhash64("hub", "lane", i, j).alias("lane"), "key", "rep", F.when(i != j, (F.col("salt") == j).cast("int")).alias("side"), "component")
    rows = stage(rows, "group-rows")
    known = rows.select("lane", "rep", "component").distinct().join(info.select(F.col("doc").alias("rep"), "n", "odd"), "rep")
    none = F.lit(None)
    dealt = rows.select("lane", "key", "rep", "side", none.cast("long").alias("component"), none.cast("long").alias("n"), none.cast("binary").alias("odd"))
    dealt = dealt.unionByName(known.select("lane", none.cast("long").alias("key"), "rep", none.cast("int").alias("side"), "component", "n", "odd"))
    dealt = dealt.repartition("lane").sortWithinPartitions("lane", "key")

    def compare(batches):
        for _, part in _groups(batches, 1):
            mine = part.filter(part.column(1).is_null()).sort_by("rep")
            asked = part.filter(part.column(1).is_valid())
            reps, comp, n = (np.asarray(mine.column(c)) for c in (2, 4, 5))
            sketches = _Sketches(mine.column(6).to_pylist())
            key, at = np.asarray(asked.column(1)), np.searchsorted(reps, np.asarray(asked.column(2)))
            side = np.asarray(asked.column(3).fill_null(-1))
            ends = np.flatnonzero(np.append(key[1:] != key[:-1], True)) + 1
            held = []
            for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                m, sides = at[s:e], side[s:e] if side[s] >= 0 else None
                leaf, root = _stars(_open_pairs(sketches, n[m], comp[m], sides, percent, m), len(m))
                held.append((m[leaf], m[root]))
            low = _lowest(len(reps), *(np.concatenate(x) for x in zip(*held, strict=True)))
            leaf = np.flatnonzero(low != np.arange(len(reps)))
            if len(leaf):
                yield pa.RecordBatch.from_arrays([pa.array(reps[leaf]), pa.array(reps[low[leaf]])], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def _other_parts(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    one = pairs.join(parts.select(F.col("node").alias("a"), F.col("component").alias("x")), "a", "left")
    both = one.join(parts.select(F.col("node").alias("b"), F.col("component").alias("y")), "b", "left")
    return both.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def _several_sets(seen: DataFrame) -> DataFrame | None:
    """The ids (doc) whose rows have different sets, or None."""
    again = stage(seen.groupBy("doc").count().where("count > 1").select("doc"), "repeated")
    if again.isEmpty():
        return None
    several = stage(seen.join(again, "doc", "left_semi").select("doc", "digest").distinct().groupBy("doc").count().where("count > 1").select("doc"), "several")
    return None if several.isEmpty() else several


def components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WORDS, block: int = BLOCK
) -> DataFrame:
    """Components of documents whose shingle sets have Jaccard >= ``percent`` / 100.

    Returns ``id_col`` (long), n_shingles and component_id (the smallest id reachable by
    links, itself included), one row per input row. A null or empty text, or one
    without words, has an empty set and links with nothing; a text of fewer words than
    a shingle is one shingle. Equal sets link. Rows that repeat an id are one document
    whose links add up; a row with a null id links with nothing and its component is null. Other
    columns are ignored; an empty table gives an empty table.
    """
    spark = df.sparkSession
    deals = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = docs.count()
    if rows > COST_SAMPLE:
        few = docs.where(F.pmod(F.xxhash64("doc"), F.lit(1 << 30)) < int((1 << 30) * COST_SAMPLE / rows))
    else:
        few = docs

    def sample(batches):
        for part in slices(batches):
            sets = [shingle_set(t, width).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary())], names=["tokens"])

    drawn = [np.frombuffer(b, np.uint64) for b in few.mapInArrow(sample, "tokens binary").toArrow()["tokens"].to_pylist()]
    scale = rows / max(1, len(drawn))
    plan = tuned_plan(drawn, percent, scale)
    deals = max(deals, math.ceil(scale * sum(len(plan.signatures(x)) for x in drawn) / DEAL_POSTINGS))
    met = stage(_meet(_index(docs.where("doc is not null"), plan, deals, width), percent), "met")
    seen = met.where("cid is not null").select("doc", "n", "digest", "cid", "odd")
    # A class is known by its digest and stands for its documents by the smallest. Different sets under one
    # 64-bit id are different classes, so a clash of ids costs comparisons only.
    info = stage(seen.where("n > 0").groupBy("digest").agg(F.min("doc").alias("doc"), F.first("cid").alias("cid"), F.first("n").alias("n"), F.first("odd").alias("odd")), "classes")
    clash = info.groupBy("cid").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x != y").select(F.col("y").alias("a"), F.col("x").alias("b"))
    near = stage(_near_pairs(_first_pairs(met.where("a is not null").select("a", "b", "votes", "alone")), info, percent).unionByName(clash), "pairs")
    links = stage(_verified_star(docs, near.groupBy("a").agg(F.min("b").alias("b")), percent, width), "links")
    several = _several_sets(seen)
    if several is not None:
        own = seen.join(several, "doc", "left_semi").select(F.col("doc").alias("a"), "digest").join(info.select("digest", F.col("doc").alias("b")), "digest")
        links = stage(links.unionByName(own.select("a", "b").distinct()), "links")
    parts = connected_components(links)
    members = stage(_members(met.where("members is not null").select("key", "members").distinct(), info), "members")
    pairs = stage(_other_parts(near, parts).unionByName(_across(members, info, parts, percent, block)).distinct(), "pairs")
    if not pairs.isEmpty():
        links = links.unionByName(stage(_families(docs, info, pairs, parts, percent, width), "links"))
        parts = connected_components(links)
    by_class = info.join(parts, info["doc"] == parts["node"], "left").select("digest", F.coalesce("component", "doc").alias("lowest"))
    placed = seen.join(by_class, "digest", "left")
    if several is not None:
        # Rows of such an id without words are in no class, but the same document.
        whole = parts.join(several.withColumnRenamed("doc", "node"), "node").withColumnRenamed("component", "whole")
        placed = placed.join(whole, placed["doc"] == whole["node"], "left").withColumn("lowest", F.coalesce("lowest", "whole"))
    placed = placed.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("lowest", "doc").alias("component_id"))
    unnamed = docs.where("doc is null")

    def sizes(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(shingle_set(t, width)) for t in part.column(1).to_pylist()], pa.int64()), part.column(0)], names=[id_col, "n_shingles", "component_id"])

    return placed.unionByName(unnamed.mapInArrow(sizes, f"`{id_col}` long, n_shingles long, component_id long"))
