"""Operator 7: n-gram Jaccard join by parity sketches.

A document's set holds its distinct word shingles. Two sets A, B with 100 |A n B| >= 100 t |A u B| differ
in at most d = (1 - t) / (1 + t) (|A| + |B|) shingles. A parity sketch XORs one bit for each shingle into k
words of 64 bits, so the Hamming distance of two sketches is never above the size of the symmetric
difference, and of k = d + 1 + g words at least g + 1 are the same (pigeonhole). k is fixed per size band;
a document also makes a sketch for each higher band that a partner may fall into. A sketch's word at its place is
a join key. As g + 1 keys are the same, a document may leave out g of its own in an order that holds for all of
them: first those of words with hardly any shingle, then the keys that most sets have.

Steps: each block of documents packs its distinct keys for hash bins -> a bin counts its keys over all blocks and
tells each block which of its keys others have too -> the block drops the last g keys of each sketch and packs the
rest, with their size and a folded sketch, for bins again -> a bin finds the sets that share a key and are within the
Hamming bound, and tells which of them hang together, as one pair for each set and not as all pairs -> what hangs together in any
bins is a cluster of candidates, whose sets come to one task, which verifies pairs of different components on the sets and
gives a link for each two components that it joins. Larger clusters are dealt in parts, two of which meet in a task.
Folded sketches of long documents are too wide to travel with each key: their shingles are dealt to slices by hash, and in at
least one slice a pair differs in at most its share of d (pigeonhole again), so each slice has sketches and keys of its own.
Links give components. Keys that very many sets hold are dealt in parts of bounded size, and those are
kept as rows: their sets then meet one of their key's largest component for some rounds, which joins most
of a large group, and at last those of different components within the bound are candidates. Every pair that qualifies shares
a key, so both sets are in one cluster, and pairs inside a component need no test: no link between components is lost, and
what is sent grows with the sets and not with their pairs.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import WordHashes, bins_for, blocks, bounded_batches, components, discard, from_planes, joined_components, list_array, materialize, materialize_kinds, mix, pack, planes, remove, small, stretches, task, text_bytes, unpack

#: Sizes of a band run from its bound to 1.25 times the bound.
STEP = 1.25
#: Bytes of text in a block.
BLOCK = 4 << 20
#: Ids of so many documents (8 bytes each) at most are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Sets of a key up to which all its pairs are compared at once.
SMALL = 16
#: Sets of a key that meet in one task.
PART = 4096
#: Sets that those of a dealt key meet at once, and the rounds in which they meet one of their key's largest component before
#: the others.
LEADERS, ROUNDS = 2, 2
#: Sets of a cluster, and bytes of them, that are in one part; two parts meet in a task.
CLUSTER, CLUSTER_BYTES = 2048, 16 << 20
#: Sets of a cluster up to which its pairs are verified without a look at sketches, and the bits of those for each shingle of
#: the largest difference.
FEW, SKETCH_BITS = 6, 32
#: Bits of a folded sketch for each shingle of the largest difference, the 64-bit words of it that travel with each key, those
#: over which a set is cut into slices, and the words of a slice.
FOLD_BITS, CARRIED, WIDE, SLICE = 4, 12, 22, 6
LIGHT = np.uint64(1 << 47)
MADE = "kind int, doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, block string, head binary, who binary, folds binary, bin int, keys binary"
HELD = "key bigint, part int, parts int, n int, band int, h1 bigint, fold binary"
HELD_ARROW = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("n", pa.int32()), ("band", pa.int32()), ("h1", pa.int64()), ("fold", pa.binary())])
MET = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), *HELD_ARROW])


class Bands:
    """Size bands for a threshold of num / den, with the number of sketch words of each."""

    def __init__(self, num: int, den: int, wide: int):
        self.num, self.den, self.wide = num, den, wide
        low = 1  # the first band holds the sizes where only equal sets qualify
        while (2 * low * (den - num)) // (den + num) < 1:
            low += 1
        self.bounds, self.shapes = [1, low], {}

    def difference(self, total: int) -> int:
        return total * (self.den - self.num) // (self.den + self.num)

    def at(self, size: int) -> int:
        while self.bounds[-1] <= size:
            self.bounds.append(max(self.bounds[-1] + 2, int(self.bounds[-1] * STEP)))
        return int(np.searchsorted(self.bounds, size, side="right")) - 1

    def most(self, band: int) -> int:
        """The largest difference of two sets that meet in a band."""
        while len(self.bounds) <= band + 1:
            self.at(self.bounds[-1])
        return self.difference(2 * (self.bounds[band + 1] - 1))

    def slices(self, band: int) -> int:
        """How many slices the sets of a band are cut into: of a qualifying pair one slice differs in at most the largest difference
        divided by their number."""
        fold = max(1, -(-FOLD_BITS * self.most(band) // 64))
        return 1 if fold <= self.wide else -(-fold // max(1, min(self.wide, SLICE)))

    def shape(self, band: int) -> tuple[int, int, int, int]:
        """Of a slice: words k of the sketch, spare words g, bits up to which a word is light, words of the folded sketch.

        Of k = d + 1 + g words at least 1 + g are the same, so with at most g light words a document's heavy
        words are enough. k is the least for which the band's smallest sets have rarely more light words."""
        if band not in self.shapes:
            slices = self.slices(band)
            low, d = self.bounds[band] / slices, self.most(band) // slices
            fold = max(1, -(-FOLD_BITS * d // 64))
            self.shapes[band] = (d + 1, 0, 0, fold)
            for light, k in ((x, k) for x in (1, 0) for k in range(d + 2, 2 * d + 8)):
                mean = low / k
                share = math.exp(-mean) * (1 + mean * light)  # Poisson
                if k - d - 1 >= k * share + 2.5 * math.sqrt(k * share * (1 - share)):
                    self.shapes[band] = (k, k - d - 1, light, fold)
                    break
        return self.shapes[band]

    def carried(self, band: int) -> int:
        """Words of a folded sketch that travel with each key. Fewer words bound the difference less well but still tell
        unrelated sets apart."""
        return min(self.shape(band)[3], CARRIED)

    def of(self, size: int) -> range:
        """Bands in which a set of this size takes part: those of its own and of larger partners."""
        return range(max(1, self.at(size)), self.at(size * self.den // self.num) + 1)


LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text: bytes, n: int, hashes: WordHashes) -> np.ndarray:
    """Distinct hashes of the word n-grams, sorted; a shorter text is one shingle, one without words has none."""
    words = text.translate(LOWER).split()  # bytes.split() cuts at \x20 and \x09-\x0D only
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    m = min(n, len(words))
    count = len(words) - m + 1
    acc = np.full(count, m, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(m):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + count])
    return np.unique(acc)


def sketch(u: np.ndarray, k: int, light: int, fold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, which of them are heavy, and the words folded by XOR."""
    word = ((u & np.uint64(0xFFFFFFFF)) * np.uint64(k)) >> np.uint64(32)
    bits = np.bincount((word * np.uint64(64) + (u >> np.uint64(58))).astype(np.int64), minlength=k * 64) & 1
    words = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)
    padded = np.zeros(-(-k // fold) * fold, np.uint64)
    padded[:k] = words
    return words, bits.reshape(k, 64).sum(1) > light, np.bitwise_xor.reduce(padded.reshape(-1, fold), axis=0)


def in_slices(u: np.ndarray, slices: int) -> list[np.ndarray]:
    """The shingles of each slice, by bits of their hashes that sketches don't use."""
    if slices == 1:
        return [u]
    no = (((u >> np.uint64(32)) & np.uint64(0x3FFFFFF)) * np.uint64(slices)) >> np.uint64(26)
    order = np.argsort(no, kind="stable")
    return np.split(u[order], np.searchsorted(no[order], np.arange(1, slices, dtype=np.uint64)))


def set_hashes(u: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, as signed numbers; an empty set has zeros."""
    sums = [np.add.reduce(mix(u ^ np.uint64(seed))) if len(u) else np.uint64(0) for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return int(sums[0].view(np.int64)), int(sums[1].view(np.int64))


@task
def _sketches(batches: Iterator[pa.RecordBatch], n: int, bands: Bands, bins: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, one for a block's distinct sets and one of its distinct keys for each bin."""
    hashes = WordHashes()
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in MADE.split(", ")])
    for t in blocks(batches, limit=BLOCK):
        doc_ids, sizes, ones, twos = t.column("doc_id").to_pylist(), [], [], []
        seen, of_set, of_sketch, keys, folds = set(), [], [], [], [np.zeros(0, np.uint64)]
        for doc_id, text in zip(doc_ids, text_bytes(t.column("text")), strict=True):
            u = shingles(text, n, hashes)
            h1, h2 = set_hashes(u)
            sizes.append(len(u))
            ones.append(h1)
            twos.append(h2)
            if not len(u) or doc_id is None or (len(u), h1, h2) in seen:
                continue
            seen.add((len(u), h1, h2))
            of_set.append((h1, len(u)))
            for band in bands.of(len(u)):
                k, g, light, _ = bands.shape(band)
                for no, own in enumerate(in_slices(u, bands.slices(band))):
                    words, heavy, folded = sketch(own, k, light, bands.carried(band))
                    spare = g - (k - np.count_nonzero(heavy))
                    at = np.flatnonzero(heavy) if spare >= 0 else np.arange(k)
                    key = mix(words[at] ^ mix((at + no * 1009 + band * 1_000_003).astype(np.uint64))) >> np.uint64(17)
                    keys.append(key | np.where(heavy[at], np.uint64(0), LIGHT))
                    of_sketch.append((len(of_set) - 1, band, spare if spare >= 0 else g, len(at)))
                    folds.append(folded)
        block = uuid.uuid4().hex
        none = lambda kind: pa.nulls(len(sizes), kind)
        made = {"kind": pa.array([0] * len(sizes), pa.int32()), "doc_id": t.column("doc_id").combine_chunks(), "n_shingles": pa.array(sizes, pa.int64()), "h1": pa.array(ones, pa.int64()), "h2": pa.array(twos, pa.int64())}
        yield pa.RecordBatch.from_arrays([made.get(f.name, none(f.type)) for f in schema], schema=schema)
        if not keys:
            continue
        sets, sketches = np.array(of_set, np.int64), np.array(of_sketch, np.int32)
        key, who = np.concatenate(keys), np.repeat(np.arange(len(sketches), dtype=np.uint32), sketches[:, 3])
        q, b = np.divmod(key, np.uint64(bins))
        order = np.lexsort((q, b))
        q, b, who = q[order], b[order].astype(np.int64), who[order]
        start = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (b[1:] != b[:-1])]))
        run = np.diff(np.append(start, len(q))).astype(np.uint32)
        q, b = q[start], b[start]
        edges = np.searchsorted(b, np.arange(bins + 1))
        head = pack(*(planes(np.ascontiguousarray(x)) for x in (sets[:, 0], sets[:, 1], sketches[:, 0], sketches[:, 1], sketches[:, 2])))
        rows = [{"kind": 1, "block": block, "head": head, "who": pack(planes(who), planes(run)), "folds": np.concatenate(folds).tobytes()}]
        for x in np.flatnonzero(np.diff(edges)).tolist():
            own = slice(edges[x], edges[x + 1])
            rows.append({"kind": 2, "block": block, "bin": x, "keys": pack(planes(np.diff(q[own], prepend=np.uint64(0))), planes(run[own]))})
        yield pa.RecordBatch.from_pylist(rows, schema)


@task
def _count(t: pa.Table) -> pa.Table:
    """For each block of a bin: how many keys it has there, which of them another set has too, and in how many sets."""
    parts = [unpack(x, 2) for x in t.column("keys").to_pylist()]
    keys = [np.cumsum(from_planes(p[0], np.uint64)) for p in parts]
    sizes = [len(k) for k in keys]
    every, runs = np.concatenate(keys), np.concatenate([from_planes(p[1], np.uint32) for p in parts]).astype(np.int64)
    order = np.argsort(every, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]]))
    total = np.empty(len(every), np.int64)
    total[order] = np.repeat(np.add.reduceat(runs[order], start), np.diff(np.append(start, len(order))))
    out, done = [], 0
    for key, size in zip(keys, sizes, strict=True):
        n = np.minimum(total[done : done + size], 0xFFFFFFFF).astype(np.uint32)
        at = np.flatnonzero(n > 1)
        out.append(pack(planes(np.diff(at, prepend=0).astype(np.uint32)), planes(np.diff(key[at], prepend=np.uint64(0))), planes(n[at])))
        done += size
    return pa.table({"block": t.column("block"), "bin": t.column("bin"), "size": pa.array(sizes, pa.int32()), "live": pa.array(out, pa.binary())})


@task
def _trim(batches: Iterator[pa.RecordBatch], bins: int, part: int, bands: Bands) -> Iterator[pa.RecordBatch]:
    """The keys that each sketch keeps, packed for bins with the set's hash, size and folded sketch."""
    for batch in batches:
        for r in range(batch.num_rows):
            head = unpack(batch.column("head")[r].as_py(), 5)
            h1, size = from_planes(head[0], np.int64), from_planes(head[1], np.int64)
            of, band, drop = (from_planes(x, np.int32).astype(np.int64) for x in head[2:])
            who, run = (from_planes(x, np.uint32) for x in unpack(batch.column("who")[r].as_py(), 2))
            places, keys, counts, done = [], [], [], 0
            for x in sorted(batch.column("back")[r].as_py(), key=lambda x: x["bin"]):
                at, q, n = unpack(x["live"], 3)
                places.append(np.cumsum(from_planes(at, np.uint32).astype(np.int64)) + done)
                keys.append(np.cumsum(from_planes(q, np.uint64)) * np.uint64(bins) + np.uint64(x["bin"]))
                counts.append(from_planes(n, np.uint32).astype(np.int64))
                done += x["size"]
            if done != len(run):
                raise ValueError("a block has not got the counts of all its keys")
            place, key, count = np.concatenate(places), np.concatenate(keys), np.concatenate(counts)
            start, each = np.cumsum(run.astype(np.int64)) - run, run[place].astype(np.int64)
            own, key, count = who[stretches(start[place], each)].astype(np.int64), np.repeat(key, each), np.repeat(count, each)
            order = np.lexsort((key, count, key >> np.uint64(47), own))
            own, key, count = own[order], key[order], count[order]
            live = np.bincount(own, minlength=len(of))
            rank = np.arange(len(own)) - np.repeat(np.cumsum(live) - live, live)
            stay = rank < live[own] - drop[own]
            own, key, parts = own[stay], key[stay], -(-count[stay] // part)
            own_part = (mix(h1[of[own]].view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
            bin_ = (mix(key + own_part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bins)).astype(np.int64)
            order = np.lexsort((key, bin_))
            own, key, parts, own_part, bin_ = own[order], key[order], parts[order], own_part[order], bin_[order]
            width = np.array([bands.carried(b) for b in range(int(band.max()) + 1)], np.int64)[band]
            fold, first = np.frombuffer(batch.column("folds")[r].as_py(), np.uint64), np.cumsum(width) - width
            edges = np.searchsorted(bin_, np.arange(bins + 1))
            out = []
            for x in np.flatnonzero(np.diff(edges)).tolist():
                s = slice(edges[x], edges[x + 1])
                who_ = own[s]
                numbers = [planes(y) for y in (np.diff(key[s], prepend=np.uint64(0)), own_part[s].astype(np.int32), parts[s].astype(np.int32), size[of[who_]].astype(np.int32), band[who_].astype(np.int32))]
                out.append((x, pack(*numbers) + np.ascontiguousarray(h1[of[who_]]).tobytes() + fold[stretches(first[who_], width[who_])].tobytes(), len(who_)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["bin", "rows", "packed"])


class Held:
    """Rows of sets that hold a key, as columns; rows of a band have folds of the same width."""

    def __init__(self, key, part, parts, n, band, h1, fold, component=None):
        self.columns = [key, part, parts, n, band, h1]
        self.key, self.part, self.parts, self.n, self.band, self.h1 = self.columns
        self.fold, self.component = fold, component  # fold: (rows, words)

    def near(self, a: np.ndarray, b: np.ndarray, bands: Bands) -> np.ndarray:
        """Which of the rows (a, b) of a band may qualify by their sizes and by the Hamming bound of a slice."""
        small, large = np.minimum(self.n[a], self.n[b]), np.maximum(self.n[a], self.n[b])
        out = (small * bands.den >= large * bands.num) & (self.h1[a] != self.h1[b])
        at = np.flatnonzero(out)
        if not len(at):
            return out
        slices = bands.slices(int(self.band[0]))
        step = 1 + 500_000 // self.fold.shape[1]
        for k in range(0, len(at), step):
            s = at[k : k + step]
            distance = np.bitwise_count(self.fold[a[s]] ^ self.fold[b[s]]).sum(axis=1, dtype=np.int64)
            out[s] = distance <= bands.difference(small[s] + large[s]) // slices
        return out

    def with_leaders(self, at: np.ndarray, no: np.ndarray, bands: Bands) -> list[np.ndarray]:
        """The near pairs of rows at `at` of one key (no) each with one set of it, and of those that aren't near with a second one."""
        found = []
        for turn in range(LEADERS):
            if not len(at):
                break
            order = at[np.lexsort((mix(self.h1[at].view(np.uint64) ^ np.uint64(turn)), no[at]))]
            first, size = _runs(no[order])
            lead = np.repeat(order[first], size)
            near = np.zeros(len(order), bool)
            near[order != lead] = self.near(lead[order != lead], order[order != lead], bands)
            found.append(np.sort(np.stack([self.h1[lead[near]], self.h1[order[near]]]), axis=0))
            at = np.sort(order[~near & (order != lead)])
        return found

    def stars(self, own: np.ndarray, left: np.ndarray, bands: Bands) -> np.ndarray:
        """What hangs together by near pairs of a row at `left` with another one at `own` (places, left among them), as pairs of
        the first set with each other one. Rows of two parts meet if left isn't all of own; sets of one component don't."""
        label = np.arange(len(own))
        across = len(left) < len(own)
        places = np.searchsorted(own, left)
        for k in range(0, len(places), 64):
            a, b = (x.ravel() for x in np.meshgrid(places[k : k + 64], np.arange(0 if across else k, len(own)), indexing="ij"))
            good = label[a] != label[b]
            good &= self.part[own[a]] != self.part[own[b]] if across else a < b
            if self.component is not None:
                good &= self.component[own[a]] != self.component[own[b]]
            a, b = a[good], b[good]
            near = self.near(own[a], own[b], bands)
            label = _together(label, a[near], b[near])
        other = np.flatnonzero(label != np.arange(len(own)))
        return np.stack([self.h1[own[label[other]]], self.h1[own[other]]])


def _together(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least place of what hangs together) after the places a and b are joined too."""
    label = label.copy()
    a, b = label[a], label[b]
    while (apart := a != b).any():
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((up := label[label]) != label).any():
            label = up
        a, b = label[a], label[b]
    return label


def _stars(pairs: np.ndarray) -> np.ndarray:
    """What hangs together by pairs (2, n) of sets, as pairs of the least set with each other one."""
    sets, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(pairs.shape)
    label = _together(np.arange(len(sets)), at[0], at[1])
    other = np.flatnonzero(label != np.arange(len(sets)))
    return np.stack([sets[label[other]], sets[other]])


def _unpacked(rows: list[int], packed: list[bytes], bands: Bands) -> Iterator[Held]:
    """The packed rows of a bin by bands, sorted by key, part and set, each once."""
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]
    folds: dict[int, list[np.ndarray]] = {}
    for n, data in zip(rows, packed, strict=True):
        parts = unpack(data, 5)
        key, band = np.cumsum(from_planes(parts[0], np.uint64)).view(np.int64), from_planes(parts[4], np.int32).astype(np.int64)
        rest = np.frombuffer(data, np.uint64, offset=len(data) - 8 * (n + int(sum(bands.carried(b) * c for b, c in enumerate(np.bincount(band).tolist()) if c))))
        width = np.array([bands.carried(b) for b in range(int(band.max()) + 1)], np.int64)[band]
        first = n + np.cumsum(width) - width
        for b in np.unique(band).tolist():
            w = bands.carried(b)
            folds.setdefault(b, []).append(rest[stretches(first[band == b], width[band == b])].reshape(int(np.count_nonzero(band == b)), w))
        for c, x in zip(columns, [key, *(from_planes(p, np.int32).astype(np.int64) for p in parts[1:4]), band, rest[:n].view(np.int64)], strict=True):
            c.append(x)
    key, part, parts, n, band, h1 = (np.concatenate(c) for c in columns)
    for b, fold in folds.items():
        at = np.flatnonzero(band == b)
        order = np.lexsort((h1[at], part[at], key[at]))
        at, fold = at[order], np.concatenate(fold)[order]
        once = np.concatenate([[True], (key[at][1:] != key[at][:-1]) | (h1[at][1:] != h1[at][:-1])])
        at = at[once]
        yield Held(key[at], part[at], parts[at], n[at], band[at], h1[at], fold[once])


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of rows with the same values."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(new)))


@task
def _met(t: pa.Table, small: int, bands: Bands) -> pa.Table:
    """Of a bin: what hangs together by pairs (a, b) near enough that share a key (kind 0), and the rows of dealt keys (kind 1)."""
    pairs, held = [np.zeros((2, 0), np.int64)], []
    for rows in _unpacked(t.column("rows").to_pylist(), t.column("packed").to_pylist(), bands):
        start, run = _runs(rows.key, rows.part)
        few = (rows.parts == 1) & (np.repeat(run, run) <= small)
        after, found = np.repeat(start + run, run), []
        for lag in range(1, small):
            a = np.flatnonzero(few[: max(len(few) - lag, 0)] & (np.arange(lag, len(few)) < after[: max(len(few) - lag, 0)]))
            if not len(a):
                break
            a = a[rows.near(a, a + lag, bands)]
            found.append(np.stack([rows.h1[a], rows.h1[a + lag]]))
            if len(found) > 1:
                found = [_stars(np.concatenate(found, axis=1))]
        more = rows.parts > 1
        found += rows.with_leaders(np.flatnonzero(more), np.repeat(np.arange(len(start)), run), bands)
        for at, n in zip(start.tolist(), run.tolist()):
            if n > small and not more[at]:
                own = np.arange(at, at + n)
                found.append(rows.stars(own, own, bands))
        pairs += found
        more = np.flatnonzero(more)
        held.append(pa.table([*(pa.array(c[more], f.type) for c, f in zip(rows.columns, HELD_ARROW)), pa.array([x.tobytes() for x in rows.fold[more]], pa.binary())], schema=HELD_ARROW))
    both = _stars(np.concatenate(pairs, axis=1))
    out = {"kind": pa.array(np.zeros(both.shape[1], np.int32)), "a": pa.array(both[0]), "b": pa.array(both[1])}
    tables = [pa.table([out.get(f.name, pa.nulls(both.shape[1], f.type)) for f in MET], schema=MET)]
    for h in held:
        tables.append(pa.table([pa.array(np.full(h.num_rows, 1), pa.int32()), *[pa.nulls(h.num_rows, pa.int64())] * 2, *h.columns], schema=MET))
    return pa.concat_tables(tables)


def _whole_runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole runs of rows with the same values in `names`; the rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        start, _ = _runs(*(np.asarray(batch.column(c)) for c in names))
        cut = int(start[-1])
        if held and cut == 0 and all(held[-1].column(c)[held[-1].num_rows - 1] == batch.column(c)[0] for c in names):
            held.append(batch)
            continue
        if held and all(held[-1].column(c)[held[-1].num_rows - 1] == batch.column(c)[0] for c in names):
            cut_first = int(start[1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut_first)])
            if cut > cut_first:
                yield pa.Table.from_batches([batch.slice(cut_first, cut - cut_first)])
        else:
            if held:
                yield pa.Table.from_batches(held)
            if cut:
                yield pa.Table.from_batches([batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _of_table(t: pa.Table) -> Iterator[tuple[Held, np.ndarray]]:
    """Rows by bands, with their places in the table."""
    band = np.asarray(t.column("band"), dtype=np.int64)
    for b in np.unique(band).tolist():
        at = np.flatnonzero(band == b)
        own = t.take(pa.array(at))
        cols = [np.asarray(own.column(c), dtype=np.int64) for c in ("key", "part", "parts", "n", "band", "h1", "component")]
        fold = np.frombuffer(b"".join(own.column("fold").to_pylist()), np.uint64).reshape(len(at), -1)
        yield Held(*cols[:6], fold, cols[6]), at


@task
def _with_one(batches: Iterator[pa.RecordBatch], turn: int, bands: Bands) -> Iterator[pa.RecordBatch]:
    """Pairs near enough of one set of each key's largest component with the sets of its other components."""
    for t in _whole_runs(batches, ["key", "part"]):
        for rows, _ in _of_table(t):
            start, run = _runs(rows.key, rows.part)
            no = np.repeat(np.arange(len(start)), run)
            order = np.lexsort((mix(rows.h1.view(np.uint64) ^ np.uint64(turn)), rows.component, no))
            first, size = _runs(no[order], rows.component[order])
            best = np.lexsort((size, no[order][first]))  # the last of a key is its largest component
            last = np.append(np.flatnonzero(np.diff(no[order][first][best])), len(best) - 1)
            lead = order[first[best[last]]]
            a, b = lead[no], np.arange(len(no))
            other = np.flatnonzero(rows.component[a] != rows.component[b])
            other = other[rows.near(a[other], b[other], bands)]
            yield pa.RecordBatch.from_arrays([pa.array(f(rows.h1[a[other]], rows.h1[b[other]])) for f in (np.minimum, np.maximum)], names=["a", "b"])


@task
def _across(batches: Iterator[pa.RecordBatch], bands: Bands) -> Iterator[pa.RecordBatch]:
    """What hangs together by pairs near enough of different components of a key, or of two parts of a key."""
    for t in _whole_runs(batches, ["key", "i", "j"]):
        i, j = np.asarray(t.column("i"), dtype=np.int64), np.asarray(t.column("j"), dtype=np.int64)
        for rows, at in _of_table(t):
            out = [np.zeros((2, 0), np.int64)]
            start, run = _runs(rows.key, i[at], j[at])
            for s, n in zip(start.tolist(), run.tolist()):
                own = np.arange(s, s + n)
                left = own[rows.part[own] == i[at][s]]
                if i[at][s] == j[at][s] or len(left) < n:  # else only one of two parts has rows
                    out.append(rows.stars(own, left, bands))
            both = _stars(np.concatenate(out, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])


@task
def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for t in blocks(batches):
        sets = [shingles(x, n, hashes) for x in text_bytes(t.column("text"))]
        sizes = [len(x) for x in sets]
        yield pa.RecordBatch.from_arrays([pa.array([set_hashes(u)[0] for u in sets], pa.int64()), pa.array(sizes, pa.int64()), list_array(np.concatenate(sets).view(np.int64), sizes, pa.int64())], names=["h1", "size", "items"])


def _common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many items a sorted set shares with each other one; none is empty."""
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    sizes = np.array([len(x) for x in others])
    return np.add.reduceat((one[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)


def _joins(sets: list[np.ndarray], component: np.ndarray, part: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Places of sets of a cluster that meet the threshold, for each two components that they join. Of two parts only sets of
    different ones meet. Sketches as wide as the sets need rule out pairs, the others are counted."""
    size = np.array([len(x) for x in sets])
    top, found, words = np.unique(component, return_inverse=True)[1], [], None
    first = np.flatnonzero(part == part[0])
    across = len(first) < len(sets)
    if len(sets) > FEW:
        words = 1 + SKETCH_BITS * (2 * int(size.max()) * (den - num) // (den + num)) // 64
        bits = np.zeros((len(sets), 8 * words), np.uint8)
        for k, x in enumerate(sets):
            place = ((x & np.uint64(0xFFFFFFFF)) * np.uint64(64 * words)) >> np.uint64(32)
            bits[k] = np.packbits((np.bincount(place.astype(np.int64), minlength=64 * words) & 1).astype(np.uint8))
        bits = bits.view(np.uint64)
    for a in first.tolist():
        b = np.flatnonzero(part != part[0]) if across else np.arange(a + 1, len(sets))
        b = b[top[b] != top[a]]
        b = b[np.minimum(size[a], size[b]) * den >= np.maximum(size[a], size[b]) * num]
        if words:
            most = (size[a] + size[b]) * (den - num) // (den + num)
            step = 1 + 4_000_000 // words
            apart = [np.bitwise_count(bits[b[k : k + step]] ^ bits[a]).sum(axis=1, dtype=np.int64) for k in range(0, len(b), step)]
            b = b[np.concatenate(apart) <= most] if apart else b
        for k in range(0, len(b), 256):
            some = b[k : k + 256]
            some = some[top[some] != top[a]]
            if not len(some):
                continue
            some = some[_common(sets[a], [sets[x] for x in some.tolist()]) * (num + den) >= (size[a] + size[some]) * num]
            for x in some.tolist():
                if top[x] != top[a]:
                    top[top == top[x]] = top[a]
                    found.append((a, x))
    return found


@task
def _links(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Links (u, v) between components of a cluster, or of two parts of it."""
    for t in _whole_runs(batches, ["cluster", "i", "j"]):
        cluster, i, j, h1, component, part = (np.asarray(t.column(c), dtype=np.int64) for c in ("cluster", "i", "j", "h1", "component", "part"))
        items = t.column("items").combine_chunks()
        values = np.asarray(items.flatten()).view(np.uint64)
        ends = np.cumsum(np.asarray(pc.list_value_length(items), dtype=np.int64))
        sets = [values[x:y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        u, v = [], []
        for s, n in zip(*(x.tolist() for x in _runs(cluster, i, j))):
            if i[s] != j[s] and (part[s : s + n] == part[s]).all():
                continue
            for a, b in _joins(sets[s : s + n], component[s : s + n], part[s : s + n], num, den):
                u.append(h1[s + a])
                v.append(h1[s + b])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _verified(pairs: DataFrame, labels: DataFrame | None, docs: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (u, v) of sets that meet the threshold, as many as join what all pairs would join of the clusters in which the
    candidates (a, b) hang together; `labels` has the components so far. Sets are made only of documents in a cluster."""
    clusters = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    rows = clusters.rows["n"]
    if not rows:
        none = clusters.select(F.col("node").alias("u"), F.col("component").alias("v"))
        none.rows = clusters.rows
        return none
    clusters_ = clusters.select(F.col("node").alias("h1"), F.col("component").alias("cluster"))
    ids = materialize(classes.join(small(clusters_, rows, BROADCAST_ROWS), "h1", "left_semi").select(F.col("rep").alias("doc_id")), "jaccard-ids")
    few = small(ids, ids.rows["n"], BROADCAST_ROWS)
    sets = materialize(docs.join(few, "doc_id", "left_semi").mapInArrow(partial(_sets, n=n), "h1 bigint, size bigint, items array<bigint>"), "jaccard-sets")
    of = sets.select("h1", "size").dropDuplicates(["h1"]).join(small(clusters_, rows, BROADCAST_ROWS), "h1")
    if labels is not None:
        of = of.join(small(labels, labels.rows["n"], BROADCAST_ROWS).withColumnRenamed("node", "h1"), "h1", "left")
    of = of.withColumn("component", F.coalesce("component", "h1") if labels is not None else F.col("h1"))
    parts = F.greatest(F.ceil(F.count("*") / CLUSTER), F.ceil(F.sum("size") * 8 / CLUSTER_BYTES)).cast("int")
    per = of.groupBy("cluster").agg(parts.alias("parts")).where("parts > 1")  # few rows: a cluster has thousands of sets or megabytes
    of = of.join(F.broadcast(per), "cluster", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    of = materialize(of.withColumn("part", F.pmod(F.xxhash64("h1"), F.col("parts")).cast("int")).select("h1", "cluster", "component", "part", "parts"), "jaccard-clusters")
    met = of.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("h1", "cluster", "component", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    met = small(met, of.agg(F.sum("parts")).first()[0], BROADCAST_ROWS // 4)
    dealt = sets.select("h1", "items").join(met, "h1").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    edges = materialize(dealt.mapInArrow(partial(_links, num=num, den=den), "u bigint, v bigint"), "jaccard-links")
    for made in (clusters, ids, sets, of):
        discard(made)
    return edges


def jaccard_classes(documents: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents (doc_id, text), one row for each input row.

    Words are runs of characters other than \\x20 and \\x09-\\x0D with A-Z lower-cased; a set holds the
    distinct n-word shingles, or the whole sequence if it is shorter. Documents link when
    den * |intersection| >= num * |union|; component_id is the smallest doc_id reachable by links. A null,
    empty or wordless text has n_shingles 0 and its own doc_id as component. A null doc_id takes part in no
    link and has a null component_id. Rows that repeat a doc_id count as the same document. An empty table
    gives no rows. Other columns of the input are ignored. Sets are compared by 64-bit shingle hashes and told
    apart by 64 bits.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bands, bins = Bands(num, den, WIDE), bins_for(docs)
    tables = materialize_kinds(docs.mapInArrow(partial(_sketches, n=n, bands=bands, bins=bins), MADE), "jaccard-sketches", 3)
    made, held_blocks, keys = (t for t, _ in tables)
    made = made.select("doc_id", "n_shingles", "h1", "h2")
    counts = materialize(keys.select("block", "bin", "keys").groupBy("bin").applyInArrow(lambda t: _count(t), "block string, bin int, size int, live binary"), "jaccard-counts")
    remove(spark, tables[2][1])
    back = counts.groupBy("block").agg(F.collect_list(F.struct("bin", "size", "live")).alias("back"))
    trimmed = held_blocks.select("block", "head", "who", "folds").join(back, "block").mapInArrow(partial(_trim, bins=bins, part=PART, bands=bands), "bin int, rows int, packed binary")
    meet = partial(_met, small=SMALL, bands=bands)
    (pairs, pairs_path), (large, large_path) = materialize_kinds(trimmed.groupBy("bin").applyInArrow(lambda t: meet(t), f"kind int, a bigint, b bigint, {HELD}"), "jaccard-met", 2)
    discard(counts)
    remove(spark, tables[1][1])

    # A set is one node, whatever the number of its documents; a document of several sets joins them.
    sets = made.where("n_shingles > 0 and doc_id is not null").groupBy("h1").agg(F.min("doc_id").alias("rep"))
    classes = materialize(sets, "jaccard-classes")
    edges = _verified(pairs.select("a", "b"), None, docs, classes, n, num, den)
    of_doc = made.where("n_shingles > 0").groupBy("doc_id").agg(F.min("h1").alias("v"), F.max("h1").alias("top")).where("v < top").select("doc_id", "v")
    repeats = materialize(made.where("n_shingles > 0").join(of_doc, "doc_id").select(F.col("h1").alias("u"), "v"), "jaccard-repeats")
    labels = components(edges.unionByName(repeats) if repeats.rows["n"] else edges)
    large = large.select("key", "part", "parts", "n", "band", "h1", "fold")
    for turn in range(0 if large.isEmpty() else ROUNDS + 1):
        # Keys whose sets lie in more than one component may hide a link between components.
        few = small(labels, labels.rows["n"], BROADCAST_ROWS).withColumnRenamed("node", "h1")
        tagged = large.join(few, "h1", "left").withColumn("component", F.coalesce("component", "h1"))
        split = materialize(tagged.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("key"), "jaccard-split")
        if not split.rows["n"]:
            discard(split)
            continue
        rest = tagged.join(small(split, split.rows["n"], BROADCAST_ROWS), "key", "left_semi")
        if turn < ROUNDS:
            dealt = rest.repartition("key", "part").sortWithinPartitions("key", "part")
            near = dealt.mapInArrow(partial(_with_one, turn=turn, bands=bands), "a bigint, b bigint")
        else:
            met = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
            dealt = met.drop("other").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            near = dealt.mapInArrow(partial(_across, bands=bands), "a bigint, b bigint")
        more = _verified(near, labels, docs, classes, n, num, den)
        discard(split)
        if more.rows["n"]:
            labels = joined_components(labels, more)
    for path in (pairs_path, large_path):
        remove(spark, path)

    linked = classes.join(labels.withColumnRenamed("node", "h1"), "h1", "left").withColumn("component", F.coalesce("component", "h1"))
    linked = materialize(linked, "jaccard-linked")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_set = linked.join(least, "component").select(F.col("h1").alias("of_h1"), "component_id")
    out = made.join(by_set, (made["h1"] == by_set["of_h1"]) & (made["n_shingles"] > 0), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
