"""N-gram Jaccard join by partitions of the token universe.

Texts are sets of word shingles. Two sets with Jaccard similarity of at least t, the smaller one of s
shingles, differ in at most H = (1-t)/t * s. Sizes fall into bands; for the largest H of a band, the
universe of shingles is hashed into H + 1 segments, so that by the pigeonhole principle similar sets
have one segment subset in common. A set is indexed under its own band, and asks in that of the
smallest sets it can be similar to.

A segment subset that very many sets share (an empty one, above all) would be dear. So each band also
allots r segments a one-deletion neighbourhood: subsets that differ in one shingle meet there too, and
such a segment counts twice. Any segments of together r counts may then be given up, and every set gives
up the subsets that most rows share, down an order that is the same for all sets, as far as r counts go
and more than ``HOT`` rows share them. ``allocate`` takes the r of least cost, from the histogram of sizes
over all documents.

What meets in a subset is first compared with its smallest document only, a star. Links found make
components. Subsets that hold several components beside that document are looked at again: there, documents
of different components are compared by parity sketches, of which no more bits can differ than shingles
do. Sketches are compared inside a task, in blocks of at most ``BLOCK`` documents a side, so no pair
leaves it that is not near. Where very many are near, a forest of the nearest ones is followed up first,
which is fewer pairs than rows; with the components that it makes, all near pairs that are left. So no
link is lost, while copies
and near copies cost comparisons of words in proportion to their number. What is taken for a link is
compared exactly, on the words themselves.

Rows travel packed, about eight bytes each. Before they are shuffled by subset, each task reduces those
of equal subset to one, so a subset that a third of all documents share is not a third of the rows of
one task.

Defined results: a text with fewer words than a shingle is one shingle; null text and text without
words has none and is linked with nothing; equal rows are linked; rows with a null key take no part in
links and are their own component, null; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlatlas.llm.common import CHUNK, discard, materialize, tidy
from crawlatlas.llm.components import components

#: Ratio of the sizes in a band, rows of a subset that is never given up, documents that one task reduces together.
RATIO, HOT, TOGETHER = 1.5, 1, 1024
#: Documents a side that one task compares by sketches; least bits of a sketch, and bits a shingle;
#: what comparing a word of two sketches costs, a row being 1.
BLOCK, BITS, WIDTH, COMPARED = 4096, 512, 2, 0.01
SEGMENTS = 4096
#: Near pairs a row, beyond which a forest of them is followed up first.
MANY = 2
#: Rows of units that are compared all at once, and rows that a task holds for that.
SMALL, HELD = 16, 30_000
#: Bands that a key has numbers for, up to 10^11 shingles.
BANDS = 63
ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    """A to Z lower-cased; words are parted by blanks and the five control characters for space."""
    return text.lower().split() if text else []


def shingles(words: list[bytes], n: int) -> set:
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(n)), strict=False))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Different 64-bit hashes of each text's shingles, in ascending order."""
    words = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    with np.errstate(over="ignore"):
        w = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
        # Runs of n words from each place on; those that cross the end of a text are left out below.
        h = np.full(max(0, len(w) - n + 1), n + 1000, np.uint64)
        for i in range(n):
            h = _mix(h * ODD + w[i:i + len(h)])
        out = []
        for size, end in zip(sizes.tolist(), ends.tolist(), strict=True):
            if size >= n:
                own = np.sort(h[end - size:end - n + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif size:
                whole = np.full(1, size, np.uint64)
                for x in w[end - size:end]:
                    whole = _mix(whole * ODD + x)
                out.append(whole)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


@dataclass(frozen=True)
class Band:
    number: int
    segments: int
    near: int       # the first so many segments have one-deletion neighbourhoods


@dataclass(frozen=True)
class Scheme:
    """Bands of one similarity and the allocation of each."""
    threshold: Fraction
    bands: dict[int, Band]

    def roles(self, size: int) -> list[Band]:
        """The bands in which a set has rows: its own, and those in which it asks."""
        least = math.ceil(self.threshold * size)
        return [self.bands[b] for b in range(band_of(max(1, least)), band_of(size) + 1) if b in self.bands]


def band_of(size: int) -> int:
    """Bands begin at the whole powers of ``RATIO``."""
    b = max(0, int(math.log(size, RATIO)) - 1) if size > 1 else 0
    while size >= first_of(b + 1):
        b += 1
    return b


def first_of(band: int) -> int:
    return math.ceil(RATIO ** band)


def most_different(band: int, threshold: Fraction) -> int:
    """The most shingles in which similar sets can differ, the smaller being in the band."""
    return math.floor((1 - threshold) / threshold * (first_of(band + 1) - 1))


def allocate(sizes: dict[int, tuple[int, int]], threshold: Fraction) -> Scheme:
    """The segments of each band and how many of them have neighbourhoods.

    ``sizes`` has, by band, the number of sets and of their shingles. A neighbourhood costs one row a
    shingle of its segment. A set with more empty segments than it may give up keeps them; each then
    costs as many comparisons as there are such sets.
    """
    bands = {}
    log_factorials = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, SEGMENTS)))])
    for b, (sets, total) in sizes.items():
        segments = most_different(b, threshold) + 1
        each = total / max(1, sets) / segments
        best = None
        for near in range(0, min(segments, SEGMENTS - 1) + 1):
            if best is not None and near * (each + 1) >= best[0]:
                break
            # Dear are empty segments, and with a neighbourhood those of one shingle, which count twice.
            empty = max(1e-300, math.exp(-each) * (segments - near + 2 * near * (1 + each)))
            within = np.exp(np.arange(near + 1) * math.log(empty) - empty - log_factorials[:near + 1]).sum()
            over = max(0.0, 1.0 - float(within))
            partners = sets * over * math.exp(-each)
            cost = near * (each + 1) + COMPARED * bits_for(total // max(1, sets)) / 64 * over * empty * partners
            if best is None or cost < best[0]:
                best = (cost, near)
        bands[b] = Band(b, segments, best[1])
    return Scheme(threshold, bands)


def rows_of(sets: list[np.ndarray], scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Key and owner (position in ``sets``) of all subset rows.

    A key has the band (6 bits), the segment (12 bits, the last number standing for all beyond) and
    40 bits of the subset's hash. Keys that are equal by chance only cost a comparison.
    """
    groups: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        if len(s):
            for band in scheme.roles(len(s)):
                groups.setdefault(band.number, []).append(i)
    keys, owners = [], []
    with np.errstate(over="ignore"):
        for number, members in groups.items():
            band = scheme.bands[number]
            if band.segments == 1 and not band.near:
                continue  # only equal sets can be similar, and those are found by their name
            tokens = np.concatenate([sets[i] for i in members])
            owner = np.repeat(np.arange(len(members)), [len(sets[i]) for i in members])
            spread = _mix(tokens + np.uint64(number + 1) * ODD)
            segment = (spread >> np.uint64(20)) % np.uint64(band.segments)
            place = owner * band.segments + segment.astype(np.int64)
            order = np.argsort(place, kind="stable")
            place, value = place[order], _mix(spread[order] ^ ODD)
            starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            sums = np.zeros(len(members) * band.segments, np.uint64)
            sums[place[starts]] = np.add.reduceat(value, starts)
            numbers = np.arange(band.segments, dtype=np.uint64)
            salts = _mix((numbers + np.uint64((number << 32) + 1)) * ODD)
            heads = np.uint64(number << 52) | np.minimum(numbers, np.uint64(SEGMENTS - 1)) << np.uint64(40)
            all_segments = np.tile(np.arange(band.segments), len(members))
            keys.append(_mix(sums + salts[all_segments]) >> np.uint64(24) | heads[all_segments])
            owners.append(np.repeat(np.array(members), band.segments))
            if band.near:
                own_segment = place % band.segments
                held = own_segment < band.near
                near = sums[place[held]] - value[held] + salts[own_segment[held]]
                keys.append(_mix(near) >> np.uint64(24) | heads[own_segment[held]])
                owners.append(np.array(members)[place[held] // band.segments])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def bits_for(size: int) -> int:
    """Bits of the sketch of a set: a power of two."""
    return max(BITS, 1 << (WIDTH * size - 1).bit_length()) if size else BITS


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the numbers of tokens that fall on each bit."""
    bits = bits_for(len(tokens))
    with np.errstate(over="ignore"):
        at = (_mix(tokens * ODD + np.uint64(7)) >> np.uint64(30)) % np.uint64(bits)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches as rows of ``width`` bytes: longer ones are what they would be with fewer bits."""
    out = np.empty((len(sketches), width // 8), np.uint64)
    lengths = np.array([len(s) for s in sketches])
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        own = np.frombuffer(b"".join(sketches[i] for i in at.tolist()), np.uint64).reshape(len(at), n // width, width // 8)
        out[at] = np.bitwise_xor.reduce(own, axis=1)
    return out


def near_in_unit(own: np.ndarray, size: np.ndarray, component: np.ndarray, asks: np.ndarray, bits: np.ndarray,
                 threshold: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second place, and differing bits, of the near pairs of different components in a unit.

    ``own`` tells the two blocks of a unit apart; rows of one block are compared with each other only
    if the unit has no other.
    """
    first, second, bit_counts = [], [], []
    parts, whole = threshold.numerator, threshold.numerator + threshold.denominator
    crossed = len(own) and own.min() != own.max()
    # Half of the bits rules out nearly all that is not near.
    few = np.ascontiguousarray(bits[:, :bits.shape[1] // 2])
    step = max(1, min(32, 1_000_000 // max(1, few.size)))
    for at in range(0, len(size), step):
        one, rest = slice(at, at + step), slice(at + 1, None)
        both = size[one, None] + size[None, rest]
        most = both - 2 * -(-both * parts // whole)
        good = np.bitwise_count(few[one, None, :] ^ few[None, rest, :]).sum(axis=2, dtype=np.int32) <= most
        good &= component[one, None] != component[None, rest]
        good &= ~(asks[one, None] & asks[None, rest])
        if crossed:
            good &= own[one, None] != own[None, rest]
        i, j = np.nonzero(good)
        i, j = i[j + 1 > i], j[j + 1 > i]
        for k in np.array_split(np.arange(len(i)), max(1, len(i) * bits.shape[1] // 4_000_000)):
            differ = np.bitwise_count(bits[at + i[k]] ^ bits[at + 1 + j[k]]).sum(axis=1, dtype=np.int64)
            near = differ <= most[i[k], j[k]]
            first.append(at + i[k][near])
            second.append(at + 1 + j[k][near])
            bit_counts.append(differ[near])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, second, bit_counts))


def near_in_small(own: np.ndarray, size: np.ndarray, component: np.ndarray, asks: np.ndarray, sketches: list[bytes],
                  starts: np.ndarray, length: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near pairs of different components in all units of at most ``SMALL`` rows, at once."""
    parts, whole = threshold.numerator, threshold.numerator + threshold.denominator
    least, most_own = np.minimum.reduceat(own, starts), np.maximum.reduceat(own, starts)
    small = length <= SMALL
    first, second = [], []
    for step in range(1, SMALL):
        units = np.flatnonzero(small & (length > step))
        if not len(units):
            break
        # Each row of a unit but its last ``step`` ones, with the row ``step`` places on.
        counts = length[units] - step
        i = np.repeat(starts[units] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        j = i + step
        crossed = np.repeat(least[units] != most_own[units], counts)
        good = (component[i] != component[j]) & ~(asks[i] & asks[j]) & (~crossed | (own[i] != own[j]))
        first.append(i[good])
        second.append(j[good])
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(first), np.concatenate(second)
    both = size[i] + size[j]
    most = both - 2 * -(-both * parts // whole)
    widths = np.array([len(s) for s in sketches])
    width = np.minimum(widths[i], widths[j])
    near = np.zeros(len(i), bool)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        for k in np.array_split(at, max(1, len(at) * w // 20_000_000)):
            x, y = (folded([sketches[r] for r in side[k].tolist()], w) for side in (i, j))
            near[k] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most[k]
    return i[near], j[near]


def forest(first: np.ndarray, second: np.ndarray, distance: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Places of pairs, nearest first, of which each joins components that those before it do not."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for k in np.argsort(distance, kind="stable").tolist():
        a, b = root(int(component[first[k]])), root(int(component[second[k]]))
        if a != b:
            parent[a] = b
            kept.append(k)
    return np.array(kept, np.int64)


def near_pairs(rows: DataFrame, threshold: Fraction, again: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of different components that share a subset and whose sketches are near.

    ``rows`` are key, rep, size, component, asks, sketch and shared (the rows of the key). A unit with
    many more near pairs than rows gives a forest of them, and a row (its number, null) that says so;
    of the units in ``again`` all near pairs come.
    """
    whole_units = again is not None
    blocks = F.ceil(F.col("shared") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    units = rows.withColumn("own", own).select("*", other.alias("other")).select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
        "own", "rep", "size", "component", "asks", "sketch")
    if whole_units:
        units = units.join(again, "unit", "left_semi")

    @tidy
    def run(batches):
        held: list[list] = []
        rows_held, unfinished, found = 0, [], []

        def out():
            a, b = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
            found.clear()
            both = np.unique(np.stack([a, b]), axis=1)
            left, right = pa.array(both[0], pa.int64()), pa.array(both[1], pa.int64())
            more = pa.array(unfinished, pa.int64())
            unfinished.clear()
            return pa.RecordBatch.from_arrays([pa.concat_arrays([left, more]), pa.concat_arrays([right, pa.nulls(len(more), pa.int64())])],
                                              ["a", "b"])

        def compare(last: bool):
            """Compare what is held, but for the last unit, which may go on."""
            nonlocal rows_held
            unit, own, rep, size, component, asks = (np.concatenate([h[i] for h in held]) for i in range(6))
            sketches = [s for h in held for s in h[6]]
            starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            ends = np.append(starts[1:], len(unit))
            held.clear()
            if not last:
                keep = slice(starts[-1], None)
                held.append([unit[keep], own[keep], rep[keep], size[keep], component[keep], asks[keep], sketches[keep]])
                starts, ends = starts[:-1], ends[:-1]
            rows_held = sum(len(h[0]) for h in held)
            if not len(starts):
                return
            length = ends - starts
            a, b = near_in_small(own, size, component, asks, sketches, starts, length, threshold)
            found.append((np.minimum(rep[a], rep[b]), np.maximum(rep[a], rep[b])))
            for x, y in zip(starts[length > SMALL].tolist(), ends[length > SMALL].tolist(), strict=True):
                one = slice(x, y)
                bits = folded(sketches[one], min(map(len, sketches[one])))
                a, b, distance = near_in_unit(own[one], size[one], component[one], asks[one], bits, threshold)
                if not whole_units and len(a) > MANY * (y - x):
                    kept = forest(a, b, distance, component[one])
                    a, b = a[kept], b[kept]
                    unfinished.append(int(unit[x]))
                found.append((np.minimum(rep[one][a], rep[one][b]), np.maximum(rep[one][a], rep[one][b])))

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)] + [batch.column(6).to_pylist()])
                rows_held += batch.num_rows
                if rows_held >= HELD:
                    compare(last=False)
                    if sum(len(f[0]) for f in found) > 100_000:
                        yield out()
        if held:
            compare(last=True)
        yield out()

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long").distinct()


def described(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc (key), size (of its set), p1, p2 (128 bits that name the set) and its sketch."""

    @tidy
    def run(batches):
        for batch in batches:
            sizes, p1, p2, sketches = [], [], [], []
            for at in range(0, batch.num_rows, CHUNK):
                for h in hashed(batch.column(1).slice(at, CHUNK).to_pylist(), n):
                    digest = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                    sizes.append(len(h))
                    p1.append(int.from_bytes(digest[:8], "little", signed=True))
                    p2.append(int.from_bytes(digest[8:], "little", signed=True))
                    sketches.append(sketch(h))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, p1, p2)), pa.array(sketches, pa.binary())],
                ["doc", "size", "p1", "p2", "sketch"])

    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("binary").alias("text")).mapInArrow(
        run, "doc long, size long, p1 long, p2 long, sketch binary")


def packed(numbers: np.ndarray) -> bytes:
    """Numbers by byte planes, which leaves those that vary little to the shuffle's compression."""
    return np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def dealt_rows(docs: DataFrame, scheme: Scheme, n: int, parts: int, key: str, text: str) -> DataFrame:
    """part, alone, keys and docs: the subset rows that a task has for each part, packed in order.

    Of rows of equal key in a task only that of the smallest document is dealt by its key. All of them
    are also known to be shared, so they are dealt anywhere (``alone`` is false).
    """

    @tidy
    def run(batches):
        def some(ids, sets):
            keys, owners = rows_of(sets, scheme)
            own = np.array(ids, np.int64)[owners]
            order = np.lexsort((own, keys))
            keys, own = keys[order], own[order]
            first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
            runs = np.diff(np.append(np.flatnonzero(first), len(keys)))
            shared = np.repeat(runs > 1, runs)
            out = []
            with np.errstate(over="ignore"):
                by_key = _mix(keys.view(np.uint64))
                anywhere = _mix(by_key ^ _mix(own.view(np.uint64)))
            for alone, mask, spread in ((True, first, by_key), (False, shared, anywhere)):
                if not mask.any():
                    continue
                part = (spread[mask] % np.uint64(parts)).astype(np.int32)
                by_part = np.argsort(part, kind="stable")
                part, of_part, own_part = part[by_part], keys[mask][by_part], own[mask][by_part]
                cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
                out += [(int(part[x]), alone, packed(of_part[x:y]), packed(own_part[x:y]))
                        for x, y in zip(cuts, [*cuts[1:], len(part)], strict=True)]
            kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary())
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                              ["part", "alone", "keys", "docs"])

        ids, sets, size = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK // 4):
                part = batch.slice(at, CHUNK // 4)
                new = hashed(part.column(1).to_pylist(), n)
                sets += new
                ids += part.column(0).to_pylist()
                size += sum(map(len, new))
                if len(ids) >= TOGETHER or size > 600 * TOGETHER:
                    yield some(ids, sets)
                    ids, sets, size = [], [], 0
        if ids:
            yield some(ids, sets)

    return docs.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("doc"), F.col(text).cast("binary").alias("text")).mapInArrow(
        run, "part int, alone boolean, keys binary, docs binary")


def shared_rows(dealt: DataFrame, parts: int) -> DataFrame:
    """key and doc of the subset rows whose key another row has.

    A task holds one part of the keys, in 16 bytes a row. The setting for shuffle partitions bounds it,
    as it does what any join or sort gets at once; no key is large in it, since each task before it has
    sent one row of a key at most.
    """

    @tidy
    def run(batches):
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for part, alone, keys, docs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                rows = unpacked(keys), unpacked(docs)
                if alone:
                    held.setdefault(part, []).append(rows)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1])], ["key", "doc"])
        while held:
            keys, docs = (np.concatenate(c) for c in zip(*held.popitem()[1], strict=True))
            order = np.argsort(keys, kind="stable")
            keys, docs = keys[order], docs[order]
            same = keys[1:] == keys[:-1]
            met = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            keys, docs = keys[met], docs[met]
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at:at + 100_000]), pa.array(docs[at:at + 100_000])], ["key", "doc"])

    return dealt.repartition(parts, "part").mapInArrow(run, "key long, doc long")


def linked(docs: DataFrame, pairs: DataFrame, n: int, threshold: Fraction, key: str, text: str) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar, by their words; pairs must be written ones.

    Texts of documents without a pair are left out first; Spark broadcasts the ids while they are few.
    """
    over, under = threshold.numerator, threshold.denominator
    wanted = materialize(pairs.select(F.col("a").alias("w")).unionByName(pairs.select(F.col("b").alias("w"))).distinct(),
                         "wanted")
    texts = docs.select(F.col(key).cast("long").alias("t_doc"), F.col(text).cast("binary").alias("t"))
    texts = texts.join(wanted, F.col("t_doc") == F.col("w"), "left_semi")
    # Rows of equal key may differ in text; each then counts.
    left = pairs.join(texts, F.col("a") == F.col("t_doc")).select("a", "b", F.col("t").alias("a_text"))
    both = left.join(texts, F.col("b") == F.col("t_doc")).select("a", "b", "a_text", F.col("t").alias("b_text"))

    @tidy
    def run(batches):
        # Pairs come grouped by one side, and few other texts meet it.
        set_of = lru_cache(maxsize=64)(lambda t: shingles(words_of(t), n))
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = set_of(batch.column(2)[i].as_py()), set_of(batch.column(3)[i].as_py())
                common = len(x & y)
                keep.append(common > 0 and under * common >= over * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long").distinct()


def _fitting(pairs: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs (a, b) whose sizes (a_size, b_size) allow the similarity."""
    small, large = F.least("a_size", "b_size"), F.greatest("a_size", "b_size")
    return pairs.where(small * threshold.denominator >= large * threshold.numerator).select("a", "b")


def _spokes(hits: DataFrame) -> DataFrame:
    """``hits`` but for the smallest class of each subset, its centre, which stands beside each other row."""
    least = hits.groupBy("key").agg(F.min(F.struct("rep", "size")).alias("least"))
    return hits.join(least, "key").where(F.struct("rep", "size") != F.col("least")).select(
        "key", "rep", "size", F.col("least.rep").alias("centre"), F.col("least.size").alias("centre_size"))


def _stars(spokes: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs of each class and the smallest one that shares a subset with it."""
    return _fitting(spokes.where("rep != centre").select(
        F.col("centre").alias("a"), F.col("rep").alias("b"), F.col("centre_size").alias("a_size"),
        F.col("size").alias("b_size")), threshold).distinct()


def promising(pairs: DataFrame, sketches: DataFrame, threshold: Fraction) -> DataFrame:
    """Those of the pairs (a, b) whose sketches are near."""
    over, whole = threshold.numerator, threshold.numerator + threshold.denominator
    side = {x: sketches.select(F.col("rep").alias(x), F.col("size").alias(f"{x}_size"), F.col("sketch").alias(f"{x}_sketch"))
            for x in "ab"}

    @tidy
    def run(batches):
        for batch in batches:
            left, right = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            width = np.array([min(len(x), len(y)) for x, y in zip(left, right, strict=True)], np.int64)
            differ = np.zeros(len(both), np.int64)
            for w in np.unique(width).tolist():
                for at in np.array_split(np.flatnonzero(width == w), max(1, len(both) * w // 50_000_000)):
                    x, y = (folded([side[i] for i in at.tolist()], w) for side in (left, right))
                    differ[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(differ <= both - 2 * -(-both * over // whole)))

    both = pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "a_size", "b_size", "a_sketch", "b_sketch")
    return both.mapInArrow(run, "a long, b long").distinct()


def _without_dearest(hits: DataFrame, scheme: Scheme, hot: int) -> DataFrame:
    """``hits`` without subsets of one class only, and without the dearest ones of each set, which it may give up.

    The order, by rows and then by key, is the same for all sets. Of what two similar sets share, the last
    subset in it comes after more counts than a set may give up, so neither of them gives it up.
    """
    if not scheme.bands:
        return hits
    near = F.create_map(*[F.lit(x) for b in scheme.bands.values() for x in (b.number, b.near)])
    shared = hits.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    segment = F.shiftright("key", 40).bitwiseAND(SEGMENTS - 1)
    met = hits.join(shared, "key").withColumns({"band": _band("key"), "segment": segment, "most": near[_band("key")]})
    met = met.repartition("rep", "band")
    dearest = F.col("rows").desc(), F.col("key")
    # A segment with a neighbourhood counts twice, however many rows it has; each other has one row.
    turn = F.row_number().over(Window.partitionBy("rep", "band", "segment").orderBy(*dearest))
    counts = F.when(F.col("segment") >= F.col("most"), 1).when(F.col("turn") == 1, 2).otherwise(0)
    so_far = F.sum("counts").over(Window.partitionBy("rep", "band").orderBy(*dearest).rowsBetween(Window.unboundedPreceding, 0))
    return (met.withColumn("turn", turn).withColumn("counts", counts).withColumn("so_far", so_far)
            .where((F.col("so_far") > F.col("most")) | (F.col("rows") <= hot)).select("key", "rep", "size"))


def _band_of(size: str):
    """``band_of`` as a column."""
    return F.size(F.filter(F.array(*[F.lit(first_of(b)) for b in range(BANDS)]), lambda f: f <= F.col(size))) - 1


def _band(key: str):
    return F.shiftright(key, 52).cast("int")


def near_duplicates(docs: DataFrame, n: int, threshold: Fraction, key: str = "doc_id", text: str = "text",
                    hot: int = HOT) -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links) of every row."""
    known = materialize(described(docs, n, key, text), "sets")
    keyed = known.where(F.col("doc").isNotNull() & (F.col("size") > 0))

    # Sets that are equal are one class, named by its smallest document.
    classes = materialize(keyed.groupBy("p1", "p2", "size").agg(F.min(F.struct("doc", "sketch")).alias("m")).select(
        "p1", "p2", "size", F.col("m.doc").alias("rep"), "m.sketch"), "classes")
    of_class = materialize(keyed.drop("sketch").join(classes.drop("sketch"), ["p1", "p2", "size"])
                           .select("doc", "rep", "size").distinct(), "members")

    sizes = {r["band"]: (r["sets"], r["total"]) for r in keyed.groupBy(_band_of("size").alias("band")).agg(
        F.count(F.lit(1)).alias("sets"), F.sum("size").alias("total")).collect()}
    scheme = allocate(sizes, threshold)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = materialize(shared_rows(dealt_rows(docs, scheme, n, parts, key, text), parts), "met")
    hits = materialize(met.join(of_class, "doc").select("key", "rep", "size").distinct(), "hits")
    discard(met)
    kept = materialize(_without_dearest(hits, scheme, hot), "kept")
    discard(hits)
    spokes = materialize(_spokes(kept), "spokes")
    discard(kept)

    stars = materialize(promising(_stars(spokes, threshold), classes, threshold), "pairs")
    links = linked(docs, stars, n, threshold, key, text)
    # A key whose rows differ is one document.
    first = of_class.groupBy("doc").agg(F.min("rep").alias("a"))
    same = of_class.join(first, "doc").where("rep != a").select("a", F.col("rep").alias("b"))
    links = materialize(links.unionByName(same), "links")
    joined = components(links)

    # Subsets that still hold different components beside the centre, first by a forest, then by all that is near.
    sketches = classes.select(F.col("rep").alias("s_rep"), F.col("size").alias("s_size"), "sketch")
    known_pairs = stars
    again = None
    for _ in range(2):
        placed = spokes.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
            "key", "rep", "size", F.coalesce("component", "rep").alias("component"),
            (_band("key") != _band_of("size")).alias("asks"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                          F.count(F.lit(1)).alias("shared")).where("lo != hi").select("key", "shared")
        rest = placed.join(mixed, "key").join(
            sketches, (F.col("rep") == F.col("s_rep")) & (F.col("size") == F.col("s_size")))
        found = materialize(near_pairs(rest, threshold, again), "near")
        again = materialize(found.where(F.col("b").isNull()).select(F.col("a").alias("unit")), "again")
        pairs = materialize(found.where(F.col("b").isNotNull()).join(known_pairs, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            links = materialize(links.unionByName(linked(docs, pairs, n, threshold, key, text)), "links")
            joined = components(links)
            known_pairs = known_pairs.unionByName(pairs)
        if again.isEmpty():
            break

    reps = of_class.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").groupBy(
        F.col("doc").alias("c_doc")).agg(F.min(F.coalesce("component", "rep")).alias("component"))
    return (known.join(reps, known["doc"] == reps["c_doc"], "left")
            .select(F.col("doc").alias(key), F.col("size").alias("n_shingles"),
                    F.coalesce("component", "doc").alias("component_id")))
