"""Best-fit packing of token sequences, bulk-synchronous.

Documents are tokenized, closed with one end id and cut into pieces of at most `capacity` tokens. Pieces are taken in classes by halves of the
capacity, longest first; pieces over half of it open sequences of their own. For each further class there is a round:

1. Its pieces and the gaps of all open sequences that may hold one are range-sorted together by size, descending, a gap before pieces of its size. A gap of several times the
   class's longest piece takes part as several slots. Ranges are cut at the exact counts by size, within a size too, so a common length spreads over as many ranges as its share needs.
2. In each range a successor sweep goes down the order and keeps the gaps that it has passed and that are free. Each piece takes the last of these, which is the smallest gap that holds it.
   Where several pieces have the same smallest gap, the one of the higher rank (the longer one, then the lesser key) has it and the others take the next larger ones.
3. What a range has left is handed over: its pieces without a gap take the free gaps of the ranges before it, nearest first. As ranks in a range are known, that is a list of intervals of ranks,
   whose number is bounded by the number of ranges; the driver sees only two counts for each range.
4. Pieces that no gap holds open sequences, in the order of ranks. Gaps are updated by a sum by sequence, and the next round follows; the last class repeats until all pieces are placed.

A round is written in the shared folder before the next one begins, and every order ends with a unique key, so a task that runs again gives the same rows.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import in_arrow, texts_of, unused_name, worker_cache, written

CAPACITY = 2048
#: Words that a worker remembers at most, and the longest one that it remembers (bytes).
CACHE_WORDS, CACHE_BYTES = 200_000, 48


#: Marks that the pre-tokenizer splits off a word of letters, as one piece.
_MARKS = ".,;:!?|#$%&*"
#: Byte-level alphabets write printable bytes of Latin-1 as themselves and number the others from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


class WordIds:
    """Ids as little-endian unsigned 32-bit bytes, word by word.

    Words are what ASCII white space separates. The tokenizer must treat them apart (its normalizer and pre-tokenizer drop white
    space and nothing crosses it), as the constructor checks on a sample. A word of Latin-1 letters, with marks at its end or not, goes to the
    tokenizer's model in lower case, which is what its normalizer and pre-tokenizer make of it; all others go through the whole tokenizer.
    Special tokens' strings in a text, such as <|endoftext|>, are ordinary text (encode_special_tokens is set).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        probe = "It's A  tést,\n\x0b 12\tİx ΣΣ ́b c d"
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}
        self.direct = all([t.id for t in self.tokenizer.model.tokenize(w)] == self.tokenizer.encode(w.upper(), add_special_tokens=False).ids for w in ("a", "probe", "qzxv", "international"))
        whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
        self.apart = self(probe.encode()) == b"".join(i.to_bytes(4, "little") for i in whole)
        if not self.apart:
            raise ValueError(f"{path} does not treat words apart")

    def __call__(self, raw: bytes) -> bytes:
        """The ids of a text in UTF-8."""
        words = raw.split()
        out = list(map(self.known.get, words))
        if None in out:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            if len(self.parts) > CACHE_WORDS // 2:
                self.parts.clear()
            for i, ids in enumerate(out):
                if ids is None:
                    w = words[i]
                    out[i] = ids = self.known.get(w) or self._word(w)
                    if len(w) <= CACHE_BYTES:
                        self.known[w] = ids
        return b"".join(out)

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode("utf-8", "replace")
        core = word.rstrip(_MARKS)
        if core and core.isalpha() and self.direct:
            low = core.lower()
            if low.isascii() or ord(max(low)) < 256:
                ids = self.parts.get(low)
                if ids is None:
                    symbols = low if low.isascii() else low.encode().decode("latin-1").translate(_ALPHABET)
                    ids = self.parts[low] = b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(symbols)])
                marks = word[len(core) :]
                return ids + self._other(marks) if marks else ids
        return self._other(word)

    def _other(self, text: str) -> bytes:
        ids = self.parts.get(text)
        if ids is None:
            ids = b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])
            if len(text) <= CACHE_BYTES:
                self.parts[text] = ids
        return ids


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32, and with keep_ids the ids. A null or empty text is its end id alone."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_cache(f"words {tokenizer}", lambda: WordIds(tokenizer))
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].cast(pa.binary()), strict=True):
                ids = encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
            if keep_ids:
                arrays.append(pa.array(columns[5], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    return in_arrow(texts_of(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


#: Classes by halves end here; shorter pieces are one class.
LEAST_CLASS = 128
#: Pieces and gaps in a range, at least.
RANGE_ROWS = 100_000
_SWEPT = "kind int, range int, rank long, key long, size int, seq long"
_PLACED, _PIECE, _GAP = 0, 1, 2


def ranges_of(counts: list[tuple[int, int, int]], rows: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """counts (size, kind, n) -> (size, kind, rows before it in the descending order, n), and how many ranges of `rows` there are."""
    out, before = [], 0
    for size, kind, n in sorted(counts, key=lambda c: (-c[0], -c[1])):
        out.append((size, kind, before, n))
        before += n
    return out, -(-before // rows)


def sweep(items: Iterator[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int, int | None]]:
    """One range: (size, kind, key, slot) in descending order -> (kind, rank, key, size, seq): pieces with the gap that they took, then what is left, with ranks from 0 on."""
    free: list[tuple[int, int]] = []
    left = 0
    for size, kind, key, _ in items:
        if kind == _GAP:
            free.append((key, size))
        elif free:
            yield _PLACED, 0, key, size, free.pop()[0]
        else:
            yield _PIECE, left, key, size, None
            left += 1
    for rank, (key, size) in enumerate(free):
        yield _GAP, rank, key, size, None


def handed_over(left: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """left: range -> (pieces without a gap, free gaps). Intervals (range, lo, hi, gaps' range, top): its piece of rank r in lo..hi takes the gap of rank top - (r - lo)."""
    out, stack = [], []
    for at in sorted(left):
        pieces, gaps = left[at]
        done = 0
        while done < pieces and stack:
            there, n = stack.pop()
            used = min(n, pieces - done)
            out.append((at, done, done + used, there, n - 1))
            done += used
            if used < n:
                stack.append((there, n - used))
        if gaps:
            stack.append((at, gaps))
    return out


def _by_range(df: DataFrame, order: list, function, schema: str) -> DataFrame:
    """function(range, its rows) on the rows of each range, which meet in one task in the given order; it yields rows of the schema."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int32() if c.endswith(" int") else pa.int64() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
        results = itertools.chain.from_iterable(function(at, (r[1:] for r in own)) for at, own in itertools.groupby(rows, key=lambda r: r[0]))
        while block := list(itertools.islice(results, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block, strict=True), kinds, strict=True)], names=names)

    return in_arrow(df.repartition("range").sortWithinPartitions("range", *order), run, schema, rows=10_000)


def _opened(at: int, rows: Iterator[tuple[int, int, int]], capacity: int) -> Iterator[tuple[int, int, int]]:
    """(rank, key, length) by rank -> (key, length, seq): pieces go on in one new sequence while they fit. A sequence's number is the key of its first piece."""
    seq, room = None, 0
    for _, key, length in rows:
        if length > room:
            seq, room = key, capacity
        room -= length
        yield key, length, seq


def _round(pieces: DataFrame, gaps: DataFrame, longest: int, counts: dict[int, int], capacity: int, last: bool) -> tuple[DataFrame, bool]:
    """One round over pieces (key, length; none longer than longest) and gaps (seq, free) -> placed (key, length, seq) and whether all pieces are placed now. counts: pieces by length."""
    spark = pieces.sparkSession
    several = F.floor(F.col("free") / longest).cast("int")
    sizes = F.when(several > 1, F.array_repeat(F.lit(longest), several)).otherwise(F.array(F.col("free").cast("int")))
    slots = gaps.select("seq", F.posexplode(sizes).alias("slot", "size"))
    cells = [(n, _PIECE, k) for n, k in counts.items()] + [(r["size"], _GAP, r["count"]) for r in slots.groupBy("size").count().collect()]  # capacity sizes at most
    total = sum(n for *_, n in cells)
    per_range = max(RANGE_ROWS, -(-total // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts, _ = ranges_of(cells, per_range)
    # bounded by the capacity, not by the rows
    cuts = F.broadcast(spark.createDataFrame(cuts, "size int, kind int, before long, n long"))
    items = pieces.select(F.col("length").cast("int").alias("size"), F.lit(_PIECE).alias("kind"), "key", F.lit(0).alias("slot")).unionByName(slots.select("size", F.lit(_GAP).alias("kind"), F.col("seq").alias("key"), "slot"))
    # rows of one size and kind are dealt over its stretch of the order; any order among equals is right, as long as ranges keep it
    share = F.pmod(F.xxhash64("key", "slot"), F.lit(1 << 20)) / float(1 << 20)
    ranged = items.join(cuts, ["size", "kind"]).select(F.floor((F.col("before") + F.floor(share * F.col("n"))) / per_range).cast("int").alias("range"), "size", "kind", "key", "slot")
    swept = _by_range(ranged, [F.desc("size"), F.desc("kind"), "key", "slot"], lambda at, rows: ((kind, at, rank, key, size, seq) for kind, rank, key, size, seq in sweep(rows)), _SWEPT)
    swept = written(swept, "swept")
    left: dict[int, tuple[int, int]] = {}
    for r in swept.where(f"kind <> {_PLACED}").groupBy("range").agg(F.count_if(F.col("kind") == _PIECE).alias("p"), F.count_if(F.col("kind") == _GAP).alias("g")).collect():  # a row for each range
        left[r["range"]] = (r["p"], r["g"])
    placed = swept.where(f"kind = {_PLACED}").select("key", F.col("size").alias("length"), "seq")
    waiting = sum(p for p, _ in left.values())
    if not waiting:
        return placed, True
    steps = handed_over(left)
    rest = swept.where(f"kind = {_PIECE}").select("range", "rank", "key", "size")
    if steps:
        by_range: dict[int, list[tuple[int, int, int, int]]] = {}
        for at, *step in steps:
            by_range.setdefault(at, []).append(tuple(step))
        table = F.broadcast(spark.createDataFrame(list(by_range.items()), "range int, steps array<struct<lo:long,hi:long,there:int,top:long>>"))  # two steps a range at most, on average
        rest = rest.join(table, "range", "left").withColumn("step", F.expr("get(filter(steps, x -> x.lo <= rank and rank < x.hi), 0)"))
        target = rest.where("step is not null").select(F.col("step.there").alias("range"), (F.col("step.top") - F.col("rank") + F.col("step.lo")).alias("rank"), "key", F.col("size").alias("length"))
        free = swept.where(f"kind = {_GAP}").select("range", "rank", F.col("key").alias("seq"))
        placed = placed.unionByName(target.join(free, ["range", "rank"]).select("key", "length", "seq"))
        rest = rest.where("step is null")
        waiting -= sum(hi - lo for _, lo, hi, _, _ in steps)
    took = total - sum(p + g for p, g in left.values()) > 0 or bool(steps)
    if last and took and waiting:  # gaps may hold more of them
        return placed, False
    opened = _by_range(rest.select("range", "rank", "key", F.col("size").alias("length")), ["rank"], lambda at, rows: _opened(at, rows, capacity), "key long, length int, seq long")
    return placed.unionByName(opened), True


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with 1 <= length <= capacity -> the same with sequence_id and offset, gapless from 0.

    A column sequence_id or offset of pieces is replaced. Repeated rows are pieces of their own; null or other lengths are a ValueError; no rows give none.
    """
    pieces = pieces.drop("sequence_id", "offset")
    key = unused_name(pieces, "key")
    base = written(pieces.withColumn(key, F.monotonically_increasing_id()), "pieces")
    small = base.select(F.col(key).alias("key"), F.col("length").cast("int").alias("length"))
    cell = F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(-1)
    counts = {r["n"]: r["count"] for r in small.groupBy(cell.alias("n")).count().collect()}  # capacity rows at most
    if -1 in counts:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    high = capacity // 2
    placed = [small.where(F.col("length") > high).select("key", "length", F.col("key").alias("seq"))]
    while high:
        low = high // 2 if high > LEAST_CLASS else 0
        rows, own = small.where((F.col("length") > low) & (F.col("length") <= high)), {n: k for n, k in counts.items() if low < n <= high}
        whole = not own
        while not whole:
            gaps = reduce(DataFrame.unionByName, placed).groupBy("seq").agg((F.lit(capacity) - F.sum("length")).cast("int").alias("free"))
            gaps = written(gaps.where(F.col("free") > low), "gaps")
            done, whole = _round(rows, gaps, max(own), own, capacity, not low)
            done = written(done, "placed")
            placed.append(done)
            if not whole:
                rows = written(rows.join(done.select("key"), "key", "left_anti"), "unplaced")
                own = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # LEAST_CLASS rows at most
        high = low
    order = Window.partitionBy("seq").orderBy(F.desc("length"), "key")  # capacity rows a sequence at most
    offset = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    places = reduce(DataFrame.unionByName, placed).select(F.col("key").alias(key), F.col("seq").alias("sequence_id"), offset.alias("offset"))
    return base.join(places, key).drop(key)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places."""
    return pack(pieces_of(docs, tokenizer, capacity, keep_ids=keep_ids), capacity)
