"""Exact Jaccard join of word n-gram sets by partitioning the universe.

A document is the set of the hashes of its word n-grams; equal sets are one
node from the start. The space of hashes (the universe) is cut into segments,
more of them the larger the sets: for a band of sizes, two sets that link
differ in at most d elements, so where the segments' allowances add up to more
than d, some segment differs by no more than it allows. A segment that allows
nothing is indexed by the hash of its elements; one that allows a single
difference by that and by its one-deletion neighbourhood. How many segments of
either kind a band gets is a choice by cost: rows to index against pairs of
sets that meet, which are counted beforehand on a few segments of each cut.

Sets that share an index key form a bucket. Buckets with the same members are
one. Inside a bucket, sizes and parity sketches (bit i is the parity of the
elements that hash to i, so the sketches of two sets differ in at most as many
bits as the sets differ in elements) discard pairs without error. The rest is
verified on the sets themselves, first one spanning forest per bucket, then
every pair whose ends are still in different components.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import (checkpointed, connected_components, documents, held, matching,
                                 tidied)

WINDOW = 1 << 20  # bytes of text hashed at a time
BLOCK = 1024  # members of a bucket compared at a time
RATIO = 1.5  # upper over lower size of a band
PAIR_COST = 0.04  # of a pair compared in a bucket, in index rows
# Shares of the allowance that may fall to one-deletion segments.
SHARES = (0.0, 0.5, 1.0)
PROBED = 2  # segments of either kind whose meetings are counted
PROBED_KEYS = 8  # one in so many of a one-deletion segment's keys
# For the number of files alone: buckets a set is usually in, pairs of sets in a file.
BUCKETS = 8
PAIRS_PER_FILE = 5_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


# ---- sets of n-gram hashes -----------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser: spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word, A-Z lower-cased; words end at ASCII white
    space. A word's hash is the mixed sum of a mixed value for every byte at its
    place in the word, taken from prefix sums."""
    data = text.encode("utf-8").lower()
    found, at = [], 0
    while at < len(data):
        upto = min(len(data), at + WINDOW)
        while upto < len(data) and not _SPACE[data[upto]]:
            upto += 1
        part = np.frombuffer(data, np.uint8, upto - at, at)
        edge = np.diff(np.concatenate(([0], ~_SPACE[part], [0])).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begin = np.zeros(len(part), np.int64)
        begin[start] = start
        place = (np.arange(len(part)) - np.maximum.accumulate(begin)).astype(np.uint64)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(mix(_BYTE[part] + place * _ODD), out=sums[1:])
        found.append(mix(sums[end] - sums[start] + (end - start).astype(np.uint64) * _ODD))
        at = upto
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def gram_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word grams; with fewer words, of the
    whole sequence as one; empty without words."""
    words = word_hashes(text or "")
    width = min(k, len(words))
    if not width:
        return words
    n = len(words) - width + 1
    grams = np.full(n, width, np.uint64)
    for i in range(width):
        grams = mix(grams * _ODD + words[i:i + n])
    return np.unique(grams)


def _node(elements: np.ndarray) -> int:
    """Name of a set: equal sets have equal names."""
    return int(mix(mix(elements ^ _ODD).sum(keepdims=True) + np.uint64(len(elements))).view(np.int64)[0])


# ---- size bands and segments ------------------------------------------------------

@dataclass(frozen=True)
class Similarity:
    """Sets link when den * |intersection| >= num * |union|."""

    num: int
    den: int

    def apart(self, total):
        """Most elements two linked sets of ``total`` elements together differ in."""
        return total - 2 * -(-self.num * total // (self.num + self.den))


@dataclass(frozen=True)
class Band:
    low: int  # sizes of the smaller set
    high: int
    apart: int  # most elements in which a linked pair differs
    exact: int  # segments that allow no difference
    single: int  # segments that allow one
    bits: int  # of a parity sketch

    @functools.cached_property
    def bounds(self) -> np.ndarray:
        """Upper ends of the segments in the universe; a segment that allows
        one difference is twice as wide."""
        width = np.concatenate([np.ones(self.exact), np.full(self.single, 2.0)])
        ends = np.cumsum(width)[:-1] / width.sum() * 2.0 ** 64
        return ends.astype(np.uint64)

    @functools.cached_property
    def probed(self) -> list[tuple]:
        """The first segments of either kind: (kind, segment, place in its kind,
        lower and upper end)."""
        ends = [np.uint64(0), *self.bounds, None]
        return [(kind, first + i, i, ends[first + i], ends[first + i + 1])
                for kind, first, n in ((0, 0, self.exact), (1, self.exact, self.single))
                for i in range(min(n, PROBED))]

    @property
    def spare(self) -> int:
        """Empty segments that a pair may share without needing them."""
        return self.exact + 2 * self.single - self.apart - 1


def cuts(low: int, apart: int) -> list[tuple[int, int]]:
    """Possible cuts of a band, one per share: (segments that allow no
    difference, segments that allow one); their allowances add up to more than
    ``apart`` plus the empty segments that are likely to be shared."""
    made = []
    for share in SHARES:
        single = int(share * (apart + 1) / 2)
        exact = apart + 1 - 2 * single
        if exact:
            segment = low / (exact + 2 * single)
            empty = exact * math.exp(-segment)
            exact += math.ceil(empty + 4 * math.sqrt(empty)) if segment < 30 else 0
        made.append((exact, single))
    return made


@functools.cache
def possible_bands(similarity: Similarity, number: int) -> list[Band]:
    """The band of this number under every possible cut."""
    low, high = _band_sizes(number)
    apart = similarity.apart(high + high * similarity.den // similarity.num)
    bits = max(64, 1 << (8 * max(1, apart) - 1).bit_length())
    return [Band(low, high, apart, exact, single, bits) for exact, single in cuts(low, apart)]


def chosen_bands(similarity: Similarity, largest: int, sets: dict[int, int],
                 met: dict[int, float]) -> list[Band]:
    """Bands for all sizes up to ``largest`` with the cheapest cut each; ``sets``
    is the number by band, ``met`` the pairs that meet by tag (see probes)."""
    made = []
    for number in range(_band_number(largest) + 1 if largest else 0):
        near = sets.get(number, 0) + sets.get(number + 1, 0)

        def cost(option: int) -> float:
            band = possible_bands(similarity, number)[option]  # noqa: B023
            one = math.sqrt(band.low * band.high) / max(1, band.exact + 2 * band.single)
            pairs = sum(met.get(_tag(number, option, kind), 0.0) for kind in (0, 1))  # noqa: B023
            return near * (band.exact + band.single * (2 * one + 1)) + PAIR_COST * pairs  # noqa: B023

        made.append(possible_bands(similarity, number)[min(range(len(SHARES)), key=cost)])
    return made


def _tag(number: int, option: int, kind: int) -> int:
    return (number * len(SHARES) + option) * 2 + kind


def probes(elements: np.ndarray, similarity: Similarity) -> tuple[list[int], list[int]]:
    """Keys of a few segments under every possible cut, with the tag of band,
    cut and kind of segment. Segments of a kind are alike (the universe is one
    of hashes), so pairs that share a key on some show how many do on all."""
    keys, tags = [], []
    size = len(elements)
    number = _band_number(size)
    smallest = -(-size * similarity.num // similarity.den)
    while number >= 0 and _band_sizes(number)[1] >= smallest:
        for option, band in enumerate(possible_bands(similarity, number)):
            if not band.apart:
                continue
            for kind, segment, place, lower, upper in band.probed:
                a = int(elements.searchsorted(lower))
                b = size if upper is None else int(elements.searchsorted(upper))
                part = mix(elements[a:b] + _ODD)
                whole = part.sum(keepdims=True, dtype=np.uint64)
                if kind:
                    found = mix(np.concatenate([whole, whole - part]) ^ np.uint64(segment))
                    found = found[found % np.uint64(PROBED_KEYS) == 0]
                else:
                    found = mix(whole) if b > a else whole[:0]
                keys += found.view(np.int64).tolist()
                tags += [_tag(number, option, kind) * PROBED + place] * len(found)
        number -= 1
    return keys, tags


def meetings(described: DataFrame, similarity: Similarity) -> dict[int, float]:
    """Pairs of different sets that would meet in the buckets of every possible
    cut, by tag, from the probes of all sets (a row per band, cut and kind)."""
    probed = described.where("node is not null").select(
        "node", F.explode(F.arrays_zip("probes", "tags")).alias("p"))
    each = (probed.select("node", "p.probes", "p.tags").distinct()
            .groupBy("tags", "probes").agg(F.count(F.lit(1)).cast("double").alias("n"))
            .groupBy(F.expr(f"tags div {PROBED}").alias("tag"))
            .agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")))
    met = {}
    for row in each.collect():
        band, kind = row["tag"] // 2, row["tag"] % 2
        cut = possible_bands(similarity, band // len(SHARES))[band % len(SHARES)]
        n = cut.single if kind else cut.exact
        met[row["tag"]] = row["pairs"] * n / min(n, PROBED) * (PROBED_KEYS if kind else 1)
    return met


def schemes(size: int, bands: list[Band], similarity: Similarity) -> list[int]:
    """The bands in which a set of this size is indexed: its own, and those of
    smaller sets it can link with."""
    smallest = -(-size * similarity.num // similarity.den)
    return [i for i, b in enumerate(bands) if b.low <= size and b.high >= smallest and b.apart]


def index_keys(elements: np.ndarray, number: int, band: Band) -> np.ndarray:
    """Keys of a set's segments under one band's cut of the universe."""
    cut = np.concatenate(([0], np.searchsorted(elements, band.bounds), [len(elements)]))
    spread = mix(elements + _ODD)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)))
    whole = sums[cut[1:]] - sums[cut[:-1]]
    segment = np.arange(len(whole), dtype=np.uint64)
    salt = mix((np.uint64(number << 32) + segment) * _ODD + np.uint64(1))
    filled = np.diff(cut) > 0
    filled[band.exact:] = True
    if int((~filled).sum()) > band.spare:
        filled[:] = True  # so many empty segments may be all that a pair shares
    keys = [mix(whole[filled] ^ salt[filled])]
    if band.single:
        first = cut[band.exact]
        of = np.repeat(segment[band.exact:].astype(np.int64), np.diff(cut)[band.exact:])
        keys.append(mix((whole[of] - spread[first:]) ^ salt[of]))
    return np.concatenate(keys)


def sketch(elements: np.ndarray, bits: int) -> bytes:
    counts = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, folded to the narrowest of them."""
    width = min(map(len, sketches))
    rows = np.empty((len(sketches), width // 8), np.uint64)
    for i, s in enumerate(sketches):
        parts = np.frombuffer(s, np.uint64).reshape(-1, width // 8)
        rows[i] = np.bitwise_xor.reduce(parts, axis=0)
    return rows


# ---- comparing the members of a bucket -----------------------------------------------

def possible_pairs(sizes: np.ndarray, words: np.ndarray, component: np.ndarray, first: int,
                   similarity: Similarity, forest: bool):
    """Pairs (i, j) of members that may link and are in different components.

    Members before ``first`` are compared with those from it on; with ``first``
    0 all are compared. With ``forest`` only pairs that join two components
    made so far, the most alike first for each member.
    """
    component = component.copy()
    out = []
    n = len(sizes)
    for i in range(first or n - 1):
        j = np.arange(first or i + 1, n)
        j = j[component[j] != component[i]]
        if not len(j):
            continue
        most = similarity.apart(sizes[i] + sizes[j])
        j, most = j[np.abs(sizes[j] - sizes[i]) <= most], most[np.abs(sizes[j] - sizes[i]) <= most]
        differ = np.bitwise_count(words[j] ^ words[i]).sum(axis=1, dtype=np.int64)
        live = differ <= most
        j = j[live]
        if not len(j):
            continue
        if forest:
            j = j[np.argsort(differ[live], kind="stable")]
            merged, at = np.unique(component[j], return_index=True)
            j = j[at]
            component[np.isin(component, merged)] = component[i]
        out += [(i, int(x)) for x in j]
    return out


def _runs(batches, keys):
    """Consecutive rows with equal ``keys``, gathered over batch borders."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        columns = [np.asarray(table.column(k).to_numpy()) for k in keys]
        change = np.zeros(table.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = np.concatenate(([0], np.flatnonzero(change) + 1))
        for start, end in zip(cuts[:-1], cuts[1:]):
            if end - start > 1:
                yield table.slice(start, end - start)
        held = table.slice(cuts[-1]).combine_chunks()
    if held is not None and held.num_rows > 1:
        yield held


def candidate_pairs(members: DataFrame, nodes: DataFrame, components: DataFrame | None,
                    similarity: Similarity) -> DataFrame:
    """Distinct pairs (a, b) of nodes that share a bucket and may link.

    Without ``components``, a spanning forest of them per bucket; with them,
    every pair whose ends are in different components. A bucket of several
    blocks is compared as pairs of blocks, each a piece of work of its own.
    """
    info = nodes.select("node", "size", "bits")
    if components is None:
        info = info.withColumn("component", F.col("node"))
    else:
        info = (info.join(components.withColumnRenamed("id", "node"), "node", "left")
                .withColumn("component", F.coalesce("component", "node")))
    blocks = members.where("block > 0").groupBy("bucket").agg((F.max("block") + 1).alias("blocks"))
    # The sketches come last, so that they are shuffled by bucket once.
    work = (members.join(blocks, "bucket", "left").join(info, "node")
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
            .select("bucket", F.least("block", "other").alias("low"),
                    F.greatest("block", "other").alias("high"), "block", "node", "size", "bits",
                    "component"))
    forest = components is None

    def compare(batches):
        for run in _runs(batches, ("bucket", "low", "high")):
            component = run.column("component").to_numpy()
            if (component == component[0]).all():
                continue
            block = run.column("block").to_numpy()
            node = run.column("node").to_numpy()
            first = int(np.searchsorted(block, block[0], "right")) if block[0] != block[-1] else 0
            found = possible_pairs(run.column("size").to_numpy().astype(np.int64),
                                   _folded(run.column("bits").to_pylist()), component, first,
                                   similarity, forest)
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))],
                    names=["a", "b"])

    return (work.repartition("bucket", "low", "high")
            .sortWithinPartitions("bucket", "low", "high", "block", "node")
            .mapInArrow(tidied(compare), "a long, b long").distinct())


def verified(pairs: DataFrame, sets: DataFrame, similarity: Similarity) -> DataFrame:
    """The pairs whose sets link, counted on the sets themselves."""
    def check(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(similarity.den * shared
                            >= similarity.num * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return (pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("left")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("elements").alias("right")), "b")
            .select("a", "b", "left", "right").mapInArrow(tidied(check), "a long, b long"))


def row_key(id_col: str, text_col: str):
    """Hash of a row's id and text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.lit("|"), text_col)


# ---- the join -------------------------------------------------------------------------

def similarity_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                      k: int = 5, num: int = 80, den: int = 100,
                      single_percent: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, row_key, group for every row of ``docs``.

    Documents link when ``den * |A & B| >= num * |A | B|`` for their sets of
    k-word grams; component_id is the smallest id reachable by links. A null
    or empty text, or one without words, has an empty set and links with
    nothing. A null id stays null and never is a component's id unless nothing
    else is reachable. Repeated rows link with each other as equal texts do.
    row_key is the hash of id and text, group a name of the component (null for
    an empty set); they tell rows apart whose ids are null or repeated.
    Other columns are ignored; an empty table gives an empty result. Sets are
    named and grams counted by 64-bit hashes. ``single_percent`` (of
    the allowance that falls to one-deletion segments) replaces the choice by
    cost.
    """
    similarity = Similarity(num, den)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                        row_key(id_col, text_col).alias("row_key"))

    def describe(batches):
        held("ngram_join", dict)  # let go of another operator's tables
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                elements = gram_set(text, k)
                size = len(elements)
                if not size:
                    rows.append((None, 0, 0, [], []))
                    continue
                rows.append((_node(elements), size, _band_number(size), *probes(elements, similarity)))
            node, size, band, keys, tags = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(node, pa.int64()),
                 pa.array(size, pa.int64()), pa.array(band, pa.int32()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(tags, pa.list_(pa.int32()))],
                names=["doc_id", "row_key", "node", "size", "band", "probes", "tags"])

    described = checkpointed(texts.mapInArrow(
        tidied(describe), "doc_id long, row_key long, node long, size long, band int, "
        "probes array<long>, tags array<int>"), "sets")
    by_band = {r["band"]: (r["n"], r["largest"]) for r in described.where("node is not null")
               .groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("largest")).collect()}
    largest = max((v[1] for v in by_band.values()), default=0)
    total = sum(v[0] for v in by_band.values())
    bands = chosen_bands(similarity, largest, {b: v[0] for b, v in by_band.items()},
                         meetings(described, similarity))
    if single_percent is not None:
        bands = [_with_single(b, single_percent) for b in bands]

    def index(batches):
        held("ngram_join", dict)
        seen: set[int] = set()
        for batch in batches:
            keys, names = [], []
            for text in batch.column(0).to_pylist():
                elements = gram_set(text, k)
                if not len(elements):
                    continue
                node = _node(elements)
                if node in seen:  # an equal set, indexed by this task already
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(node)
                for number in schemes(len(elements), bands, similarity):
                    found = index_keys(elements, number, bands[number])
                    keys.append(found)
                    names.append(np.full(len(found), node, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(names))],
                    names=["key", "node"])

    def bucket(batches):
        """Members of keys that several nodes share; equal member lists are one bucket."""
        made: set[int] = set()

        open_key, block, held = None, 0, np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.ones(len(key), bool)  # repeated rows of a node have come as neighbours
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            if open_key is not None and len(held) and key[0] == open_key and node[0] == held[-1]:
                new[0] = False
            key, node = key[new], node[new]
            if not len(key):
                continue
            cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            long_runs = np.flatnonzero(np.diff(cuts) > 1)
            # the first run may go on from the batch before, the last into the next
            wanted = sorted({0, len(cuts) - 2, *long_runs.tolist()})
            out = []
            for r in wanted:
                run = node[cuts[r]:cuts[r + 1]]
                if open_key is not None and key[cuts[r]] == open_key:
                    held = np.concatenate((held, run))
                else:
                    if open_key is not None:
                        out.append(_close(open_key, block, held, made))
                    open_key, block, held = key[cuts[r]], 0, run
                while len(held) > BLOCK:
                    # too many to name by their members: blocks under the key's name
                    out.append(_rows(open_key, block, held[:BLOCK]))
                    block, held = block + 1, held[BLOCK:]
            out = [o for o in out if o is not None]
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if open_key is not None:
            last = _close(open_key, block, held, made)
            if last is not None:
                yield last

    keyed = texts.select("text").mapInArrow(tidied(index), "key long, node long")
    members = checkpointed(
        keyed.repartition("key").sortWithinPartitions("key", "node")
        .mapInArrow(tidied(bucket), "bucket long, block int, node long").distinct(), "buckets", total * BUCKETS)

    # Size and sketch of every node that is in a bucket, from one of its rows.
    firsts = (described.where("node is not null").groupBy("node")
              .agg(F.min("doc_id").alias("doc_id"), F.min("row_key").alias("row_key")))
    in_bucket = members.select("node").distinct()

    def sketches(batches):
        for batch in batches:
            names, sizes, bits = [], [], []
            for text in batch.column(0).to_pylist():
                elements = gram_set(text, k)
                if len(elements):
                    names.append(_node(elements))
                    sizes.append(len(elements))
                    bits.append(sketch(elements, bands[_band_number(len(elements))].bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(bits, pa.binary())], names=["node", "size", "bits"])

    def elements_of(batches):
        for batch in batches:
            names, sets = [], []
            for text in batch.column(0).to_pylist():
                elements = gram_set(text, k)
                if len(elements):
                    names.append(_node(elements))
                    sets.append(elements.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["node", "elements"])

    def of_nodes(wanted, fill, schema, name):
        # A key finds one row unless rows repeat (id and text); only then is there
        # something to drop, and the wide rows are shuffled for it.
        keys = firsts.join(wanted, "node", "left_semi").select("row_key")
        made = checkpointed(matching(texts, keys, "row_key", rows=total).select("text")
                            .mapInArrow(tidied(fill), schema), name)
        once = made.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
        return made if once else checkpointed(made.dropDuplicates(["node"]), name)

    nodes = of_nodes(in_bucket, sketches, "node long, size long, bits binary", "sketches")
    pairs = checkpointed(candidate_pairs(members, nodes, None, similarity), "pairs", members.count())
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = of_nodes(ends, elements_of, "node long, elements binary", "elements")
    links = checkpointed(verified(pairs, sets, similarity), "links", pairs.count(), PAIRS_PER_FILE)
    reached = connected_components(links, "a", "b", links.count())
    # Only nodes with a possible partner can gain a link.
    again = members.join(ends, "node", "left_semi")
    left = candidate_pairs(again, nodes, reached, similarity).join(pairs, ["a", "b"], "left_anti")
    more = checkpointed(verified(left, sets, similarity), "links")
    links = links.unionByName(more)
    groups = connected_components(links, "a", "b", links.count())

    named = (firsts.join(groups.withColumnRenamed("id", "node"), "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = named.join(smallest, "component").select("node", "component_id", "component")
    return (described.join(of_node, "node", "left")
            .select("doc_id", F.col("size").alias("n_shingles"),
                    F.coalesce("component_id", "doc_id").alias("component_id"), "row_key",
                    F.col("component").alias("group")))


def _rows(name, block, members):
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(members), name, np.int64)),
         pa.array(np.full(len(members), block, np.int32)), pa.array(members)],
        names=["bucket", "block", "node"])


def _close(key, block, held, made: set[int]):
    """The rows of a bucket that is complete, or its last block."""
    if block:
        return _rows(key, block, held) if len(held) else None
    if len(held) < 2:
        return None
    # Named by its members, so that buckets with the same members are one.
    name = int(mix(mix(held.view(np.uint64)).sum(keepdims=True)).view(np.int64)[0])
    if name in made:
        return None
    if len(made) >= 200_000:
        made.clear()
    made.add(name)
    return _rows(name, 0, held)


@functools.cache
def _band_sizes(number: int) -> tuple[int, int]:
    """Smallest and largest size of the sets of a band."""
    low = 1 if not number else _band_sizes(number - 1)[1] + 1
    return low, max(low, int(low * RATIO))


def _band_number(size: int) -> int:
    """Number of the band whose sizes include ``size``."""
    number = 0
    while size > _band_sizes(number)[1]:
        number += 1
    return number


def _with_single(band: Band, percent: int) -> Band:
    single = percent * (band.apart + 1) // 200
    exact = max(0, band.apart + 1 - 2 * single) + band.exact // 8
    return Band(band.low, band.high, band.apart, exact, single, band.bits)


def op2_ngram_join(spark, sf_dir):
    return similarity_groups(documents(spark, sf_dir), k=3, num=90, den=100).select(
        "doc_id", "n_shingles", "component_id")
