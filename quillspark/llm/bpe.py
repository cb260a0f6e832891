"""Byte-level BPE with the tiktoken library: encoding, decoding, and safe cuts for long texts.

Null and empty texts have no tokens. A long text is cut only before a single space between two characters that are not
white space: no match of the pattern spans such a place, so the pieces' ids joined are the whole text's ids, and no call
of the library holds more than about `piece_chars` characters (one longer run without such a place stays whole).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import in_arrow, texts_of, worker_cache

#: No match of a pattern of the usual kind (words and symbols with one leading space, runs of white space) crosses this.
_SAFE = re.compile(r"(?<=\S)(?= \S)")
PIECE_CHARS = 200_000


def load(path: str, pattern: str):
    """The tiktoken encoding of a local rank file, without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name=path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """text in parts that the pattern treats alike apart and together."""
    start = 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(encoding, text: str, size: int = PIECE_CHARS) -> list[int]:
    if len(text) <= size:
        return encoding.encode_ordinary(text)
    return [i for part in pieces(text, size) for i in encoding.encode_ordinary(part)]


def encode_documents(docs: DataFrame, ranks: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids also ids and decoded (raw bytes).

    One row for each row of docs, repeated ones too; a null text counts as empty. ids_sha256 is over the decimal ids
    joined by commas, decoded_sha256 over the bytes that the ids decode to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = worker_cache(f"tiktoken {ranks}", lambda: load(ranks, pattern))
        decimal = worker_cache(f"decimal {ranks}", lambda: [str(i) for i in range(encoding.n_vocab)])
        for b in batches:
            out = {"doc_id": b["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if keep_ids else {})
            for value in b["text"]:
                ids = encode(encoding, value.as_py())
                raw = encoding.decode_bytes(ids)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
                if keep_ids:
                    out["ids"].append(ids)
                    out["decoded"].append(raw)
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, _TYPES[k]) for k, v in out.items()], names=list(out))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * keep_ids
    return in_arrow(texts_of(docs), run, schema)


_TYPES = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32()), "decoded": pa.binary()}
