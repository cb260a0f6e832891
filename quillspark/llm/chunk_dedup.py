"""Substring deduplication by content-defined chunking.

A gear rolling hash runs over the bytes of a text (words joined by single spaces); a chunk ends at a word's end where the hash's chosen bits
are 0. Cuts depend on the last few bytes only, so after an insertion the chunks fall into step again. Single chunks are a few words and
repeat by chance, each in another document, so what is compared by digest over all documents is windows: successive chunks of at least `min_words`
words together. The smallest doc_id owns a window, every other document's copy is a duplicate, and so is a later copy in one text that doesn't overlap the first. Each chunk begins the shortest window that it can and
ends the shortest that it can, so the windows that two documents share cover all of a run of chunks that they share, if it has
`min_words` words. Duplicate windows are removed, as spans of whole words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import in_arrow, texts_of
from quillspark.llm.word_arrays import BASE, INVERSE, Words, mix, parts, powers_of

#: Bytes that the rolling hash sees, words in a chunk on average (a power of two) and at most, and words of the shortest run removed.
GEAR_BYTES, MEAN_WORDS, MAX_WORDS, MIN_RUN_WORDS = 12, 4, 48, 24
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _gear() -> np.ndarray:
    """The gear table: 256 numbers from a hash of the byte, the same for all white space."""
    out = (mix(np.arange(1000, 1256, dtype=np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
    out[9:14] = out[32]
    return out


_GEAR = _gear()


def chunked(column: pa.Array, mean_words: int = MEAN_WORDS) -> Iterator[tuple[Words, int, np.ndarray, np.ndarray]]:
    """For each text: the words it is among, the index of its first, each chunk's end as a count of its words (the last is all of them) and 64-bit digest."""
    for row, to, words in parts(column, lower=False):
        n, first = len(words.hashes), words.first
        rolling = _GEAR[words.data]
        for k in range(1, min(GEAR_BYTES, len(rolling))):  # h[i] = sum of gear[i - k] << k, as h = (h << 1) + gear makes it in 16 bits
            rolling[k:] += _GEAR[words.data[:-k]] << np.uint16(k)
        full = first[:-1] < first[1:]
        begin, end = words.start[first[:-1][full]], words.end[first[1:][full] - 1]
        h = np.zeros(len(begin), np.uint16)
        for k in range(GEAR_BYTES - 1):  # a text's first bytes see nothing from before its first word
            begin, end, h = (x[begin + k < end] for x in (begin, end, h))
            h = (h << np.uint16(1)) + _GEAR[words.data[begin + k]]
            rolling[begin + k] = h
        low = GEAR_BYTES - mean_words.bit_length() + 1
        cut = (rolling[words.end - 1] >> np.uint16(low)) & np.uint16(mean_words - 1) == 0
        cut[first[1:][first[1:] > 0] - 1] = True  # texts end with a chunk
        ends = np.flatnonzero(cut) + 1
        sizes = np.diff(ends, prepend=0)
        if n and sizes.max() > MAX_WORDS:  # forced cuts, counted from the last true one
            long = np.flatnonzero(sizes > MAX_WORDS)
            more = [np.arange(ends[i] - sizes[i] + MAX_WORDS, ends[i], MAX_WORDS) for i in long]
            ends = np.sort(np.concatenate([ends, *more]))
            sizes = np.diff(ends, prepend=0)
        starts = ends - sizes
        place = (np.arange(n) - np.repeat(starts, sizes)).astype(np.uint64)
        digests = mix(np.add.reduceat(mix(words.hashes + place * _STEP), starts) + sizes.astype(np.uint64)) if n else words.hashes
        bounds = np.searchsorted(ends, first, "right")
        for i in range(to - row):
            a, e = bounds[i], bounds[i + 1]
            yield words, int(first[i]), ends[a:e] - first[i], digests[a:e]


def windows(ends: np.ndarray, digests: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First chunk, last chunk and 64-bit digest of a text's windows: for each chunk the shortest of at least min_words words that begins with it, and the shortest that ends with it."""
    if not len(ends) or ends[-1] < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n, starts = len(ends), np.concatenate([[0], ends[:-1]])
    last = np.searchsorted(ends, starts + min_words)
    first = np.searchsorted(starts, ends - min_words, "right") - 1
    begun = np.flatnonzero(last < n)
    ended = np.flatnonzero(first >= 0)
    ended = ended[last[first[ended]] != ended]  # the others are among the first kind
    first, last = np.concatenate([begun, first[ended]]), np.concatenate([last[begun], ended])
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(digests * powers_of(BASE, n), out=total[1:])
    return first, last, mix((total[last + 1] - total[first]) * powers_of(INVERSE, n)[first] + (last - first).astype(np.uint64))


def repeated(first: np.ndarray, last: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Which of a text's windows are later copies that don't overlap the first one."""
    out = np.zeros(len(digests), bool)
    order = np.lexsort((first, digests))
    new = np.concatenate([[True], digests[order][1:] != digests[order][:-1]]) if len(order) else out
    if not new.all():
        ends = last[order][new][np.cumsum(new) - 1]  # of each window's first copy
        out[order] = first[order] > ends
    return out


def _digest_rows(docs: DataFrame, min_words: int, mean_words: int) -> DataFrame:
    """(doc_id, digest, known) of each distinct window of each row. known isn't 0, but a number that spreads, where a smaller doc_id of the same batch has the window: such rows need no owner, so of a hot
    window one row a batch is looked at by the task that finds its owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = [], []
            for doc, (_, _, ends, digests) in zip(b["doc_id"].to_pylist(), chunked(b["text"], mean_words), strict=True):
                if doc is not None and len(own := windows(ends, digests, min_words)[2]):
                    found.append(np.unique(own).view(np.int64))
                    ids.append(np.full(len(found[-1]), doc, np.int64))
            if found:
                doc, digest = np.concatenate(ids), np.concatenate(found)
                order = np.lexsort((doc, digest))
                doc, digest = doc[order], digest[order]
                new = np.concatenate([[True], digest[1:] != digest[:-1]])
                known = np.where(doc > doc[new][np.cumsum(new) - 1], np.arange(1, len(doc) + 1), 0)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(digest), pa.array(known, pa.int32())], names=["doc_id", "digest", "known"])

    return in_arrow(texts_of(docs), run, "doc_id long, digest long, known int")


def _not_first(rows: DataFrame) -> DataFrame:
    """The rows (doc_id, digest) whose digest a smaller doc_id has too. Rows of a digest that aren't known to be such meet in one task, sorted, and pass through it in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, owner = None, 0  # the digest that the last batch ended with, and its least doc_id
        for b in batches:
            ids, digests = b["doc_id"].to_numpy(), b["digest"].to_numpy()
            if not len(ids):
                continue
            new = np.concatenate([[before is None or digests[0] != before], digests[1:] != digests[:-1]])
            group = np.cumsum(new)
            owners = np.concatenate([[owner], ids[new]])[group]
            before, owner = digests[-1], owners[-1]
            # the least doc_id of all is never known beforehand, so it is in the task of the others that aren't
            if (again := (ids > owners) | (b["known"].to_numpy() != 0)).any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[again]), pa.array(digests[again])], names=["doc_id", "digest"])

    return in_arrow(rows.repartition("digest", "known").sortWithinPartitions("digest", "doc_id"), run, "doc_id long, digest long", rows=10_000)


def duplicate_runs(ends: np.ndarray, again: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """(first, end) in words of the maximal runs of chunks marked again that have at least min_words words."""
    starts = np.concatenate([[0], ends[:-1]])
    edge = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
    runs = zip(starts[np.flatnonzero(edge == 1)].tolist(), ends[np.flatnonzero(edge == -1) - 1].tolist(), strict=True)
    return [(a, e) for a, e in runs if e - a >= min_words]


def dedup(docs: DataFrame, min_words: int = MIN_RUN_WORDS, mean_words: int = MEAN_WORDS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text without repeated passages, n_words, n_removed, spans (start, end in characters).

    One row for each row of docs, a null text stays null. A passage stays in the document with the least doc_id, at its first place in it; rows that
    share a doc_id are one document, so one's passages stay in the other. Of rows with a null doc_id only what they repeat themselves goes, and they own nothing. White space left at a cut is reduced to the one before it.

    One shuffle carries the windows' digests, another the duplicate ones to their documents. The rows of one digest, at most one for each batch of BATCH_ROWS documents, meet in one
    task, which reads them as a stream.
    """
    return _deduped(docs, min_words, mean_words, [])


def _deduped(docs: DataFrame, min_words: int, mean_words: int, more: list[str]) -> DataFrame:
    """dedup() and the columns `more` of docs as _m0, _m1 and so on, so that names can't clash."""
    again = _not_first(_digest_rows(docs, min_words, mean_words)).groupBy("doc_id").agg(F.collect_set("digest").alias("_again"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"_m{i}") for i, c in enumerate(more)])
    joined = base.join(again, "doc_id", "left")
    n_more = len(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, removed, spans = [], [], [], []
            for value, marks, (words, at, ends, digests) in zip(b["text"], b["_again"], chunked(b["text"], mean_words), strict=True):
                runs: list[tuple[int, int]] = []
                first, last, own = windows(ends, digests, min_words)
                found = repeated(first, last, own)
                if marks.is_valid:
                    found |= np.isin(own.view(np.int64), marks.values.to_numpy())
                if found.any():
                    edge = np.bincount(first[found], minlength=len(ends) + 1) - np.bincount(last[found] + 1, minlength=len(ends) + 1)
                    runs = duplicate_runs(ends, np.cumsum(edge)[:-1] > 0, min_words)
                counts.append(int(ends[-1]) if len(ends) else 0)
                removed.append(sum(e - a for a, e in runs))
                text = value.as_py()
                if not runs:
                    texts.append(text)
                    spans.append([])
                    continue
                raw = text.encode()
                shift = int(words.start[at]) - (len(raw) - len(raw.lstrip()))  # where the text begins in the words' bytes
                out, done, found, chars, passed = [], 0, [], 0, 0
                for a, e in runs:
                    a, e = int(words.start[at + a]) - shift, int(words.end[at + e - 1]) - shift
                    chars += len(raw[passed:a].decode())
                    found.append({"start": chars, "end": (chars := chars + len(raw[a:e].decode()))})
                    passed = e
                    out.append(raw[done:a])
                    done = e
                    while done < len(raw) and raw[done] in b" \t\n\r\x0b\x0c":
                        done += 1
                out.append(raw[done:])
                texts.append(b"".join(out).decode())
                spans.append(found)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), *(b[f"_m{i}"] for i in range(n_more))], names=["doc_id", "text", "n_words", "n_removed", "spans", *(f"_m{i}" for i in range(n_more))])

    kinds = "".join(f", _m{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(more))
    return in_arrow(joined, run, f"doc_id long, text string, n_words long, n_removed long, spans array<struct<start:long,end:long>>{kinds}")


def without_repeats(docs: DataFrame, min_words: int = MIN_RUN_WORDS) -> DataFrame:
    """docs with repeated passages removed from text, and n_chars (if there) brought up to date; all rows and columns stay."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    d = _deduped(docs, min_words, MEAN_WORDS, rest)
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text")}
    at = {c: F.col(f"_m{i}") for i, c in enumerate(rest)}
    return d.select(*[new.get(c, at.get(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
