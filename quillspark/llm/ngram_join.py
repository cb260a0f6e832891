"""N-gram Jaccard join, exact, as a blocked sparse product of the document by n-gram incidence with its own transpose.

The product is never formed as a whole. What makes its blocks is a bound on sizes: for sets of sizes a and b to reach similarity s, at most
d = (1 - s) / (1 + s) * (a + b) n-grams may be in one of them only. The n-grams are dealt by hash into m column parts, m being the same for all pairs
in a band of sizes and greater than any d there, so m - d parts at least are equal in both sets. Put in one order for all rows (parts of many n-grams first,
then by digest), two such rows share one of their first d + 1 parts; the digests of these are a row's signatures, and parts of few n-grams, which
chance makes equal, are no signatures. Rows that share no signature can't reach s and never meet. Rows that do, in a band, are linked into
candidate groups, which are the blocks: in a block pairs with fewer than m - d equal parts are discarded, overlap counts of the others are accumulated row by
row over the columns, pairs below their size-derived bound are discarded, and a spanning forest of the links is returned, never all pairs.

A group too large for one task is cut into tiles. Each tile and each pair of it with the group's first tile is a block; the links found so make classes. Rows of
one class need no more links among themselves, so the group is cut anew: a class larger than a tile has its own tiles, all smaller classes share others, and
only pairs of tiles of different classes, and those of the smaller ones, are blocks. If nearly all rows of a group are near copies, its sets are thus
shuffled a few times, not once for each tile.

Sets are compared as 64-bit hashes of the n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import hot_limit, in_arrow, small_enough, spread_join, texts_of, without, written
from quillspark.llm.graph import components
from quillspark.llm.word_arrays import mix, parts

#: Hashed n-grams in a tile; a block holds two tiles at most.
TILE = 1_000_000
#: Sizes from BAND ** i to BAND ** (i + 1) share a number of parts.
BAND = 1.5
_A = np.uint64(0x9E3779B97F4A7C15)
#: A signature's low bits are its band, of which there are fewer than BANDS.
BANDS = 64
_BAND_BITS = np.uint64(BANDS - 1)


def ngrams(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles, A-Z lower-cased; the whole sequence as one if it is shorter; none without words."""
    for row, end, words in parts(column, lower=True):
        h, first = words.hashes, words.first
        full = np.full(max(0, len(h) - n + 1), n, np.uint64)
        for k in range(n):
            full = mix(full * _A + h[k : k + len(full)])
        for i in range(end - row):
            a, e = first[i], first[i + 1]
            if e - a >= n:
                out = full[a : e - n + 1].copy()
                out.sort()
                yield out[np.concatenate([[True], out[1:] != out[:-1]])]
            elif e > a:
                short = np.full(1, e - a, np.uint64)  # the length counts, so a short sequence is no shingle
                for k in range(a, e):
                    short = mix(short * _A + h[k : k + 1])
                yield short
            else:
                yield h[:0]


class Bounds:
    """Size-derived bounds of a similarity of percent / 100, in whole numbers."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("percent must be from 50 to 100")
        self.percent = percent

    def reached(self, common, a, b):
        """Whether sets of sizes a and b with `common` n-grams in both are linked; for numbers or arrays."""
        return common * (100 + self.percent) >= self.percent * (a + b)

    def band(self, n: int) -> int:
        b = int(math.log(n) / math.log(BAND))
        while self.least(b + 1) <= n:
            b += 1
        while self.least(b) > n:
            b -= 1
        return b

    @staticmethod
    def least(band: int) -> int:
        """The smallest size of a band."""
        return math.ceil(BAND**band - 1e-9)

    def apart(self, a, b):
        """How many n-grams at most are in one only of linked sets of sizes a and b; for numbers or arrays."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def parts(self, band: int) -> int:
        """m for pairs whose smaller set is in the band: a quarter more than any such pair's `apart`, and two."""
        small = self.least(band + 1) - 1
        most = self.apart(small, small * 100 // self.percent)
        return most + most // 4 + 2

    def most_apart(self, n: int, band: int) -> int:
        """The greatest `apart` of a set of n and a partner, the smaller of them being in the band."""
        small = self.least(band + 1) - 1
        return self.apart(n, n * 100 // self.percent if n <= small else small)

    def bands(self, n: int) -> list[int]:
        """The bands in which a set of n looks for partners: its own, and those of smaller sets that may reach it."""
        own = self.band(n)
        out = [own]
        smallest = -(-self.percent * n // 100)
        while self.least(out[-1]) > smallest:
            out.append(out[-1] - 1)
        return out


def part_digests(grams: np.ndarray, band: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of a set's m column parts, and how many n-grams each part holds; the band is in a digest's low bits."""
    part = ((grams >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    held = np.bincount(part, minlength=m)
    sums = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(mix(grams ^ _A)[order], out=sums[1:])
    ends = np.cumsum(held)
    total = sums[ends] - sums[ends - held]
    digest = mix(total * _A + mix((np.arange(m) + 1_000_003 * band).astype(np.uint64) + (held.astype(np.uint64) << np.uint64(40))))
    return (digest & ~_BAND_BITS) | np.uint64(band), held


def signatures(grams: np.ndarray, bounds: Bounds) -> np.ndarray:
    """For each band in which the set looks for partners the digests of its first parts, one more than may differ."""
    out = []
    for band in bounds.bands(len(grams)):
        digest, held = part_digests(grams, band, bounds.parts(band))
        out.append(digest[np.lexsort((digest, -held))[: bounds.most_apart(len(grams), band) + 1]])
    return np.unique(np.concatenate(out))


def described(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, digest (128 bits of the set, null without words), signatures.

    Of rows with equal sets in one task only the first carries signatures, so a group of copies is no group of candidates.
    """
    bounds = Bounds(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            sizes, keys, signs = [], [], []
            for doc, grams in zip(b["doc_id"].to_pylist(), ngrams(b["text"], n), strict=True):
                sizes.append(len(grams))
                key = xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None
                keys.append(key)
                if key is None:
                    signs.append(None)
                    continue
                signs.append(None if key in seen or doc is None else signatures(grams, bounds).view(np.int64))
                if doc is not None:
                    seen.add(key)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "signatures"])

    return in_arrow(texts_of(docs), run, "doc_id long, n_shingles long, digest binary, signatures array<long>")


def block_links(docs: list[int], grams: list[np.ndarray], bounds: Bounds, tiles: list | None = None, linked: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among docs; with tiles, only of those between rows of different tiles; with classes of rows that are `linked`, only of those between classes.

    Rows are taken by size, so each is the smaller one of its pairs with later rows. Its equal parts with them are counted; those with enough, of a
    size that may reach it and not in its own set already are its possible partners, and only for them overlap counts are accumulated.
    """
    if len(docs) == 2 and linked is None:
        common = np.intersect1d(grams[0], grams[1], assume_unique=True).size
        return [(docs[0], docs[1])] if bounds.reached(common, len(grams[0]), len(grams[1])) else []
    order = sorted(range(len(docs)), key=lambda i: len(grams[i]))
    docs, grams = [docs[i] for i in order], [grams[i] for i in order]
    n, sizes = len(docs), np.array([len(g) for g in grams])
    tile = np.unique(tiles, return_inverse=True)[1][order] if tiles else None
    own = [bounds.band(int(x)) for x in sizes]
    parts_of = {b: bounds.parts(b) for x in sizes for b in bounds.bands(int(x))}
    every = [{b: part_digests(g, b, parts_of[b])[0] for b in bounds.bands(len(g))} for g in grams]
    digests = np.concatenate([d for row in every for d in row.values()])
    names, column = np.unique(digests, return_inverse=True)
    owner = np.repeat(np.arange(n), [sum(map(len, row.values())) for row in every])
    rows = owner[np.argsort(column, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(column))])
    _, flat = np.unique(np.concatenate(grams), return_inverse=True)
    places = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(int(flat.max()) + 1, bool)
    label, out = (np.unique(linked, return_inverse=True)[1][order] if linked else np.arange(n)), []
    sets = int(label.max()) + 1
    members = np.split(np.argsort(label, kind="stable"), np.cumsum(np.bincount(label))[:-1])  # of each label; the smaller of two sets is relabelled, so a row is at most log2(n) times
    for i in range(n - 1):
        if sets == 1:
            break
        mine = np.searchsorted(names, every[i][own[i]])
        count = starts[mine + 1] - starts[mine]
        at = np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        equal = np.bincount(rows[at], minlength=n)[i + 1 :]
        later = sizes[i + 1 :]
        maybe = (equal >= parts_of[own[i]] - bounds.apart(sizes[i], later)) & (later * bounds.percent <= sizes[i] * 100) & (label[i + 1 :] != label[i])
        if tile is not None:
            maybe &= tile[i + 1 :] != tile[i]
        found = np.flatnonzero(maybe) + i + 1
        if not len(found):
            continue
        marked[flat[places[i] : places[i + 1]]] = True
        for j in found.tolist():
            if label[j] != label[i] and bounds.reached(np.count_nonzero(marked[flat[places[j] : places[j + 1]]]), sizes[i], sizes[j]):
                small, large = sorted((int(label[i]), int(label[j])), key=lambda k: len(members[k]))
                label[members[small]] = large
                members[large] = np.concatenate([members[large], members[small]])
                sets -= 1
                out.append((docs[i], docs[j]))
        marked[flat[places[i] : places[i + 1]]] = False
    return out


def equal_sets(facts: DataFrame) -> DataFrame:
    """digest, rep (the least doc_id of the sets that are equal), written."""
    return written(facts.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "equal")


def links(docs: DataFrame, facts: DataFrame, same: DataFrame, n: int, percent: int) -> DataFrame:
    """(u, v): links among the smallest documents of equal sets that connect whatever is connected. facts: described(), written; same: equal_sets(facts)."""
    bounds = Bounds(percent)
    known = facts.where("doc_id is not null and digest is not null")
    reps = written(spread_join(known.select("doc_id", "digest", "n_shingles"), same.where("rep is not null"), "digest").select("doc_id", "rep", "n_shingles"), "reps")
    rows = known.where("signatures is not null").select("doc_id", F.explode("signatures").alias("signature"))
    shared = written(rows.groupBy("signature").agg(F.min("doc_id").alias("other"), F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    # the total is that of shared signatures, whose rows all are among rows
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [r["signature"] for r in shared.where(F.col("n") > hot_limit(total)).select("signature").collect()]  # HOT_KEYS at most
    met = spread_join(rows, shared.drop("n"), "signature", hot).where("other <> doc_id").select("doc_id", "other", F.col("signature").bitwiseAND(F.lit(BANDS - 1)).cast("int").alias("band")).distinct()
    left, right = reps.select("doc_id", F.col("rep").alias("u")), reps.select(F.col("doc_id").alias("other"), F.col("rep").alias("v"))
    # a node is a document in a band, so groups of short texts and of long ones don't grow together
    met = met.join(left, "doc_id").join(right, "other").select(F.struct(F.col("u").alias("id"), "band").alias("u"), F.struct(F.col("v").alias("id"), "band").alias("v"))
    groups = written(components(met).select(F.col("node.id").alias("node"), "component"), "groups")
    weight = written(groups.join(reps.where("doc_id = rep").groupBy(F.col("doc_id").alias("node")).agg(F.max("n_shingles").alias("n_shingles")), "node"), "weights")
    total = weight.groupBy("component").agg(F.ceil(F.sum("n_shingles") / F.lit(TILE)).cast("int").alias("tiles"))
    dealt = spread_join(weight, total, "component").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    pairs = F.expr("CASE WHEN tile > 0 THEN array(struct(0 AS a, tile AS b), struct(tile AS a, tile AS b)) ELSE transform(sequence(0, tiles - 1), t -> struct(0 AS a, t AS b)) END")
    first = multiplied(docs, written(dealt.select("node", "component", "tile", F.explode(pairs).alias("p")).select("node", "component", "tile", F.col("node").alias("linked"), "p.a", "p.b"), "dealt"), n, bounds, False)
    large = total.where("tiles > 1").select("component")
    if not large.limit(1).count():
        return first
    found = components(first)
    found = written(found.select(F.col("node").alias("u"), F.col("component").alias("v")), "found")
    rest = spread_join(weight, large, "component").join(found.select(F.col("u").alias("node"), F.col("v").alias("linked")).distinct(), "node", "left")
    rest = written(rest.select("node", "component", "n_shingles", F.coalesce("linked", "node").alias("linked")), "rest")
    return found.unionByName(multiplied(docs, written(between_classes(rest), "dealt"), n, bounds, True))


def between_classes(rows: DataFrame) -> DataFrame:
    """rows (node, component, n_shingles, linked), cheap to read again -> (node, component, tile, linked, a, b): the blocks, pairs of tiles a and b of a component, in which all classes of linked rows meet all others."""
    sums = rows.groupBy("component", "linked").agg(F.sum("n_shingles").alias("n"))
    own = F.when(F.col("n") > TILE, F.col("linked"))  # null: a class that shares tiles with others
    bins = written(sums.groupBy("component", own.alias("own")).agg(F.ceil(F.sum("n") / F.lit(TILE)).cast("int").alias("tiles")), "bins")
    # there is one bin at most for each TILE n-grams, and one more for each group
    own_bins = bins.where("own IS NOT NULL").select("component", F.col("own").alias("linked"), "own")
    placed = rows.join(small_enough(own_bins), ["component", "linked"], "left")
    placed = placed.join(small_enough(bins), (placed["component"] == bins["component"]) & placed["own"].eqNullSafe(bins["own"])).select("node", placed["component"], "linked", placed["own"], "tiles")
    placed = placed.withColumn("tile", F.struct("own", F.pmod(F.xxhash64("node"), F.col("tiles")).alias("k")))
    # bins meet by component and tiles are told apart only then, so a class of many tiles isn't joined to itself
    one, two = (bins.select("component", F.col("own").alias(f"own{i}"), F.col("tiles").alias(f"tiles{i}")) for i in (1, 2))
    met = one.join(two, "component").where("own1 < own2 OR own1 IS NULL")
    met = met.select("component", "own1", "own2", F.explode(F.expr("sequence(0L, tiles1 - 1L)")).alias("k1"), "tiles2")
    met = met.select("component", "own1", "own2", "k1", F.explode(F.expr("sequence(0L, tiles2 - 1L)")).alias("k2")).where("own1 IS NOT NULL OR own2 IS NOT NULL OR k1 <= k2")
    met = written(met.select("component", F.struct(F.col("own1").alias("own"), F.col("k1").alias("k")).alias("a"), F.struct(F.col("own2").alias("own"), F.col("k2").alias("k")).alias("b")), "pairs")
    ends = met.select("component", F.col("a").alias("tile"), "a", "b").unionByName(met.where("a <> b").select("component", F.col("b").alias("tile"), "a", "b"))

    def name(c: str) -> Column:
        return F.concat_ws(":", F.coalesce(F.col(f"{c}.own").cast("string"), F.lit("")), F.col(f"{c}.k").cast("string"))

    placed, ends = placed.select("node", "component", "linked", name("tile").alias("tile")), ends.select("component", name("tile").alias("tile"), name("a").alias("a"), name("b").alias("b"))
    return placed.join(ends, ["component", "tile"]).select("node", "component", "tile", "linked", "a", "b")


def multiplied(docs: DataFrame, dealt: DataFrame, n: int, bounds: Bounds, known: bool) -> DataFrame:
    """(u, v): links found in the blocks (component, a, b). dealt: node, component, tile, linked, a, b, cheap to read again; known: whether rows of one `linked` need no links."""
    wanted = texts_of(docs).join(small_enough(dealt.select(F.col("node").alias("doc_id")).distinct()), "doc_id", "left_semi")

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([g.tobytes() for g in ngrams(b["text"], n)], pa.binary())], names=["node", "grams"])

    sets = in_arrow(wanted, grams_of, "node long, grams binary")
    # with the deal broadcast, if it is counted small, sets are shuffled once, to their blocks
    blocks = sets.join(small_enough(dealt), "node").repartition("component", "a", "b").sortWithinPartitions("component", "a", "b", "node")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs_, grams, tiles, linked = None, [], [], [], []

        def done() -> pa.RecordBatch:
            u, v = [], []
            if len(docs_) > 1:
                found = block_links(docs_, grams, bounds, tiles if key[1] != key[2] else None, linked if known else None)
                u, v = [x for x, _ in found], [x for _, x in found]
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for b in batches:
            for node, tile, group, a, c, of, raw in zip(*(b[k].to_pylist() for k in ("node", "tile", "component", "a", "b", "linked")), b["grams"], strict=True):
                if (group, a, c) != key:
                    if docs_:
                        yield done()
                    key, docs_, grams, tiles, linked = (group, a, c), [], [], [], []
                docs_.append(node)
                tiles.append(tile)
                linked.append(of)
                grams.append(np.frombuffer(raw.as_py(), np.uint64))
        if docs_:
            yield done()

    return in_arrow(blocks, product, "u long, v long")


def classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id: one row for each row.

    component_id is the smallest doc_id that links reach; documents link if their sets of n-word shingles have a Jaccard similarity of at least
    percent / 100. Texts that are null or without words have the empty set and are linked with nothing. Rows with a null doc_id link nothing and
    have the smallest doc_id of an equal set, or null. Rows that share a doc_id are one document whose texts all link. Any 64-bit doc_id will do.
    """
    facts = written(described(docs, n, percent), "sets")
    same = equal_sets(facts)
    labels = components(links(docs, facts, same, n, percent)).select(F.col("node").alias("rep"), F.col("component").alias("linked"))
    named = written(same.join(labels, "rep", "left").select("digest", F.coalesce("linked", "rep").alias("class")), "classes")
    out = spread_join(facts.where("digest is not null").select("doc_id", "n_shingles", "digest"), named, "digest").select("doc_id", "n_shingles", "class")
    out = out.unionByName(facts.where("digest is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("class")))
    return out.select("doc_id", "n_shingles", F.coalesce("class", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that aren't the smallest of their class; columns unchanged. Rows with a null doc_id can't be named and all stay; so do all rows of a smallest doc_id that is there twice."""
    gone = written(classes(docs, n, percent).where("doc_id <> component_id").select("doc_id"), "copies")
    return without(docs, gone)
