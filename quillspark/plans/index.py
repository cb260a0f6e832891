"""The inverted index as tables: postings, dictionary, lengths and blocks, for one or more fields, in memory or as Parquet.

postings(term, doc_id, tf, positions, norm) has a row for each term of a document. A document is one row, so its tokens are grouped before anything is shuffled. Written postings are
range-sorted by (term, doc_id), so row groups carry narrow term ranges and a term, a prefix or an IN list reads few of them; a hot term spreads over several files.
"""

from __future__ import annotations

import enum
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.arrow import in_arrow
from quillspark.functions.analyzers import ANALYZERS
from quillspark.functions.scoring import encode_norm
from quillspark.operators import rank, statistics
from quillspark.operators.match import PostingsMatch
from quillspark.plans.work import Manifest, in_order, written


class Config(enum.Enum):
    """What an index stores: documents; also frequencies and positions (phrases); also norms (BM25)."""

    DOCS = "docs"
    POSITIONS = "positions"
    SCORING = "scoring"


@dataclass(frozen=True)
class Field:
    column: str
    analyzer: str = "english"
    config: Config = Config.SCORING
    index_id: int = 0
    suffix: str = ""


def tokens(docs: DataFrame, column: str = "text", analyzer: str = "english") -> DataFrame:
    """(doc_id, pos, term), positions from 0."""
    return docs.select("doc_id", F.posexplode(ANALYZERS[analyzer](F.col(column))).alias("pos", "term"))


_POSTINGS = "term string, doc_id long, tf int, positions array<int>, norm int"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, tokens) -> one row for each term of each row, by whole arrays: terms are numbered, (row, number) is sorted, runs of equal ones are postings."""
    for b in batches:
        lists = b["tokens"]
        lengths = np.diff(lists.offsets.to_numpy())
        named = lists.flatten().dictionary_encode()
        codes = named.indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        pos = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        key = row * max(1, len(named.dictionary)) + codes
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(key))
        first = order[starts]
        positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)).astype(np.int32)), pa.array(pos[order].astype(np.int32)))
        yield pa.RecordBatch.from_arrays([named.dictionary.take(pa.array(codes[first])), b["doc_id"].take(pa.array(row[first])), pa.array((ends - starts).astype(np.int32)), positions, pa.array(np.clip(lengths, 1, 255)[row[first]].astype(np.int32))], names=["term", "doc_id", "tf", "positions", "norm"])


def postings_of(docs: DataFrame, column: str = "text", analyzer: str = "english") -> DataFrame:
    """(term, doc_id, tf, positions ascending, norm), one row for each term of a document, without a shuffle and in no order."""
    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), ANALYZERS[analyzer](F.col(column)).alias("tokens")), _grouped, _POSTINGS)


def postings_where(docs: DataFrame, condition: Column, column: str = "text", analyzer: str = "english") -> DataFrame:
    """postings_of() for the terms that meet a condition on term: other tokens are dropped where they are made, so only asked ones are grouped."""
    rows = docs.select("doc_id", ANALYZERS[analyzer](F.col(column)).alias("t"))
    rows = rows.select("doc_id", encode_norm(F.size("t")).alias("norm"), F.posexplode("t").alias("pos", "term")).where(condition)
    return rows.groupBy("term", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"), F.first("norm").alias("norm"))


def dictionary_of(postings: DataFrame, *also: str) -> DataFrame:
    return postings.groupBy(*also, "term").agg(F.count(F.lit(1)).alias("df"), F.coalesce(F.sum("tf"), F.lit(0)).cast("long").alias("ttf"), F.coalesce(F.max("tf"), F.lit(0)).alias("max_tf"))


def lengths_of(docs: DataFrame, column: str = "text", analyzer: str = "english") -> DataFrame:
    """(doc_id, len, norm) of every document, empty and null ones too."""
    return docs.select("doc_id", F.size(ANALYZERS[analyzer](F.col(column))).cast("long").alias("len")).withColumn("norm", encode_norm(F.col("len")))


def _bounds(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("norm").alias("min_norm"))


def blocks_of(postings: DataFrame, block_docs: int = 4096, *also: str) -> DataFrame:
    """(term, block, first, last, n, max_tf, min_norm); a block is a range of doc_ids, so bounds of terms add up by block and no window is needed."""
    return _bounds(postings.select(*also, "term", "doc_id", "tf", "norm", F.floor(F.col("doc_id") / block_docs).alias("block")), *also, "term", "block")


def windows_of(postings: DataFrame, size: int = 256, large: int = 1024, large_from: int = 8192) -> DataFrame:
    """Blocks by rank within a term's list: `size` postings each, `large` ones for terms in at least large_from documents.

    A rank is that within a part of the range-sorted postings, plus the counts of the term in the parts before: no task holds a hot term's list.
    """
    parts = in_order(postings.select("term", "doc_id", "tf", "norm"), "term", "doc_id")
    counts = parts.groupBy("term", "part").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("term")
    counts = counts.select("term", "part", (F.sum("n").over(own.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(own).alias("df"))  # a row for each part of a term
    local = parts.withColumn("r", F.row_number().over(Window.partitionBy("term", "part").orderBy("doc_id")) - 1)
    ranked = local.join(counts, ["term", "part"]).withColumn("r", F.col("r") + F.col("before"))
    return _bounds(ranked.withColumn("block", F.floor(F.col("r") / F.when(F.col("df") >= large_from, large).otherwise(size))), "term", "block")


def faults(postings: DataFrame) -> DataFrame:
    """One row that counts postings whose tf isn't their number of positions, those whose positions don't ascend strictly from 0 on, and those beyond the first of a term and document (doc_ids
    of a term ascend strictly if each is there once). All must be 0."""
    after = F.zip_with("positions", F.slice("positions", F.lit(2), F.size("positions")), lambda a, b: b.isNull() | (a < b))
    ascending = ((F.size("positions") == 1) | F.forall(after, lambda x: x)) & (F.coalesce(F.get("positions", F.lit(0)), F.lit(0)) >= 0)
    own = Window.partitionBy("doc_id").orderBy("term")  # a document's terms are no more than its text, so no task holds a hot term's list
    each = postings.select("doc_id", "term", (F.size("positions") != F.col("tf")).alias("t"), (~ascending).alias("o")).select("t", "o", (F.row_number().over(own) > F.rank().over(own)).alias("d"))
    return each.agg(*(F.count_if(c).alias(name) for c, name in (("t", "bad_tf"), ("o", "bad_order"), ("d", "bad_doc"))))


class Index(PostingsMatch):
    """One logical index. everything() is all documents, also those without terms. where: postings of the terms that meet a condition, if that is cheaper than a filter."""

    def __init__(self, postings: DataFrame, dictionary: DataFrame, lengths: DataFrame, blocks: DataFrame | None, config: Config, block_docs: int = 4096, where=None):
        super().__init__(postings, config is not Config.DOCS, where)
        self.dictionary, self.lengths, self.blocks = dictionary, lengths, blocks
        self.config, self.block_docs = config, block_docs
        self.doc_stats = statistics.documents(lengths)
        self.stats = statistics.segment(lengths, dictionary)

    def everything(self) -> DataFrame:
        return self.lengths.select("doc_id")

    def need_norms(self) -> None:
        if self.config is not Config.SCORING:
            raise ValueError("the index has no norms")

    def top_k(self, terms: list[str], k: int = 10, params: rank.Bm25 = rank.Bm25()) -> DataFrame:
        return rank.top_k(self, terms, k, params)

    def top_k_block_max(self, terms: list[str], k: int = 10, params: rank.Bm25 = rank.Bm25()) -> DataFrame:
        return rank.top_k_block_max(self, terms, k, params)


def _check(docs: DataFrame, field: Field) -> None:
    if docs.schema[field.column].dataType.simpleString() != "string":
        raise TypeError(f"{field.column} is no string column")


def build(docs: DataFrame, field: Field | None = None, block_docs: int = 4096) -> Index:
    """docs (doc_id unique, the field's column); a column that isn't a string is a TypeError. Nothing is stored: queries read the texts and keep what they ask for."""
    field = field or Field("text")
    _check(docs, field)
    how = (field.column, field.analyzer)
    postings, lengths = postings_of(docs, *how), lengths_of(docs, *how)
    dictionary = dictionary_of(postings if field.config is not Config.DOCS else postings.withColumn("tf", F.lit(0)))
    if field.config is Config.DOCS:
        postings = postings.select("term", "doc_id")
    blocks = blocks_of(postings, block_docs) if field.config is Config.SCORING else None
    return Index(postings, dictionary, lengths, blocks, field.config, block_docs, lambda condition: postings_where(docs, condition, *how))


_KEYS = ("shard", "index_id", "suffix")
_STORED = {
    "postings": _POSTINGS,
    "lengths": "doc_id long, len long, norm int",
    "dictionary": "term string, df long, ttf long, max_tf int",
    "blocks": "term string, block long, first long, last long, n long, max_tf int, min_norm int",
}
#: Terms are distinct for the most part: a dictionary page is of no use, and without one Parquet writes the Bloom filter, which rejects absent terms.
_OPTIONS = {"compression": "zstd", "parquet.bloom.filter.enabled#term": "true", "parquet.enable.dictionary#term": "false"}


def _suffix(suffix: str) -> str:
    return suffix or "__none__"


def write(docs: DataFrame, root: str, fields: list[Field], shard: str | Column = "0", block_docs: int = 4096) -> None:
    """Writes the fields' tables under root as one shard, or as those that a column names; a shard that exists is a ValueError.

    All fields and shards go through the same few jobs: texts are analyzed once into a table in the work folder; from it come postings and lengths, and from the stored postings dictionary and blocks. What is written becomes
    visible at once, when the manifest that names it is published; a failed write is never seen.
    """
    spark = docs.sparkSession
    for f in fields:
        _check(docs, f)
    if len({(f.index_id, f.suffix) for f in fields}) < len(fields):
        raise ValueError("two fields of one index")
    docs = docs.withColumn("_shard", F.lit(shard) if isinstance(shard, str) else shard.cast("string"))
    names = [shard] if isinstance(shard, str) else [r[0] for r in docs.select("_shard").distinct().collect()]
    manifest = Manifest(spark, root)
    number, entries = manifest.last()
    if None in names or (there := {n for e in entries for n in e["shards"]} & set(names)):
        raise ValueError("a shard without a name" if None in names else f"shards {sorted(there)} exist")
    folder = f"data/{uuid.uuid4().hex}"

    def each(table) -> DataFrame:
        return reduce(DataFrame.unionByName, (table(f).withColumns({"index_id": F.lit(f.index_id).cast("long"), "suffix": F.lit(_suffix(f.suffix))}) for f in fields))

    def analyzed(f: Field) -> DataFrame:
        rows = docs.select("_shard", F.col("doc_id").cast("long").alias("doc_id"), ANALYZERS[f.analyzer](F.col(f.column)).alias("tokens"))
        out = in_arrow(rows, _grouped_in_shards, f"shard string, {_POSTINGS}")
        null = {Config.DOCS: ("tf", "positions", "norm"), Config.POSITIONS: ("norm",), Config.SCORING: ()}[f.config]
        return out.select(*[F.when(F.col("term").isNull(), F.col(c)).alias(c) if c in null else c for c in out.columns])

    def store(rows: DataFrame, table: str, *order: str) -> None:
        if order:
            rows = rows.repartitionByRange(*_KEYS, *order).sortWithinPartitions(*_KEYS, *order)
        rows.write.options(**_OPTIONS).partitionBy(*_KEYS).parquet(f"{root}/{folder}/{table}")

    scored = [f for f in fields if f.config is Config.SCORING]
    with ThreadPoolExecutor(2) as pool:  # jobs that don't wait for each other share the executors
        staged = written(each(analyzed), "analyzed")  # texts are analyzed once, though the range sort reads its input twice
        lengths = staged.where("term is null").select("doc_id", F.col("tf").cast("long").alias("len"), "norm", *_KEYS)
        list(pool.map(lambda job: store(*job), ((staged.where("term is not null"), "postings", "term", "doc_id"), (lengths, "lengths"))))
        stored = _stored(spark, [f"{root}/{folder}"], "postings")
        jobs = [(dictionary_of(stored, *_KEYS), "dictionary", "term")]
        if scored:
            of = reduce(lambda a, b: a | b, ((F.col("index_id") == f.index_id) & (F.col("suffix") == _suffix(f.suffix)) for f in scored))
            jobs.append((blocks_of(stored.where(of), block_docs, *_KEYS), "blocks", "term", "block"))
        list(pool.map(lambda job: store(*job), jobs))
    kinds = [[f.index_id, f.suffix, f.config.value, f.analyzer] for f in fields]
    manifest.publish(number, [*entries, {"shards": names, "folder": folder, "fields": kinds, "block_docs": block_docs}])


def _grouped_in_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_grouped() by shard, and a row without a term for each document: its length as tf, and its norm."""
    for b in batches:
        names = b["_shard"].dictionary_encode()
        for k, name in enumerate(names.dictionary.to_pylist()):
            own = b.filter(pa.array(names.indices.to_numpy() == k)).select(["doc_id", "tokens"])
            n = np.diff(own["tokens"].offsets.to_numpy()).astype(np.int32)
            every = [pa.nulls(len(own), pa.string()), own["doc_id"], pa.array(n), pa.nulls(len(own), pa.list_(pa.int32())), pa.array(np.clip(n, 1, 255).astype(np.int32))]
            for columns in (*(out.columns for out in _grouped([own])), every):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(columns[0]), pa.string()), *columns], names=["shard", "term", "doc_id", "tf", "positions", "norm"])


def _stored(spark: SparkSession, folders: list[str], table: str) -> DataFrame:
    schema = f"{_STORED[table]}, shard string, index_id long, suffix string"
    return reduce(DataFrame.unionByName, (spark.read.schema(schema).parquet(f"{folder}/{table}") for folder in folders))


def shards(spark: SparkSession, root: str) -> list[str]:
    """Names of the published shards."""
    return [n for e in Manifest(spark, root).last()[1] for n in e["shards"]]


def open_index(spark: SparkSession, root: str, index_id: int = 0, suffix: str = "") -> Index:
    """All published shards of a logical index as one, with global statistics; KeyError if there is none, ValueError if shards differ in what they store."""
    _, entries = Manifest(spark, root).last()
    found = [(e, kind, analyzer) for e in entries for i, s, kind, analyzer in e["fields"] if (i, s) == (index_id, suffix)]
    if not found:
        raise KeyError(f"no index ({index_id}, {suffix!r})")
    if len({(kind, analyzer, e["block_docs"]) for e, kind, analyzer in found}) > 1:
        raise ValueError("shards of different configurations")
    config, block_docs = Config(found[0][1]), found[0][0]["block_docs"]

    def read(table: str) -> DataFrame:
        rows = _stored(spark, [f"{root}/{e['folder']}" for e, *_ in found], table)
        return rows.where((F.col("index_id") == index_id) & (F.col("suffix") == _suffix(suffix))).drop(*_KEYS)

    dictionary = read("dictionary").groupBy("term").agg(F.sum("df").alias("df"), F.sum("ttf").alias("ttf"), F.max("max_tf").alias("max_tf"))
    blocks = None
    if config is Config.SCORING:
        blocks = read("blocks").groupBy("term", "block").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_norm").alias("min_norm"))
    postings = read("postings")
    return Index(postings if config is not Config.DOCS else postings.select("term", "doc_id"), dictionary, read("lengths"), blocks, config, block_docs)
