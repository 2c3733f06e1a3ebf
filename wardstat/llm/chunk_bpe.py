"""BPE encoding and decoding with content-defined chunk reuse.

1. Every text is cut where a rolling hash of its last 32 bytes has a fixed
   pattern, so a passage that documents share is cut alike in all of them.
2. Chunks are counted by their hash.  A chunk that occurs more than once is
   encoded once, from one of its places.
3. A document's ids are put together from the ids of its shared chunks and of
   the text between them.  A chunk's ids were made without its neighbours, so
   each join is repaired: the text before the chunk is encoded on into it
   until a boundary between pre-tokens falls on one of the chunk's own, and
   from there on both agree, up to the last two pre-tokens of the chunk,
   which the following text may change and which are encoded anew with it.
   A chunk without such a boundary is encoded from the text.

The text is shuffled once, by document and compressed: the same shuffle gives
the shared chunks their text and the documents theirs.  Only shared chunks' ids
are shuffled besides, two bytes each where the vocabulary allows.  The join on chunk hashes is one that Spark splits where a chunk
occurs in a large share of the documents.

Null texts are empty (no ids).  Rows with the same id and text get the same
ids; null ids are kept.  Texts that the fast encoder leaves to the tokenizers
library (see ``bpe``), or that hold special tokens, are encoded whole.  Very
long texts need memory in proportion to the longest one.  Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstat.llm.bpe import PRETOKENS, UNUSUAL, encoder
from wardstat.llm.common import cut, hash128, id_text

CHUNK_BYTES = 1024      # expected length of a chunk; a power of two
HEAD_CHARS = 256        # where a join looks for agreement with the chunk
YIELDED = 1000          # documents whose ids leave a task together
UNSTABLE = 2            # pre-tokens at the end of a piece that its successor can change
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(data: bytes, chunk_bytes: int = CHUNK_BYTES) -> np.ndarray:
    """Ends (byte offsets) of the chunks of UTF-8 bytes: h[i] is the sum of the
    last 32 bytes' gear values, each shifted by its distance, and a chunk ends
    after byte i if the top bits of h[i] are zero."""
    b = np.frombuffer(data, np.uint8)
    h = GEAR[b]
    for k in (1, 2, 4, 8, 16):  # sums over 2, 4, ... 32 bytes
        longer = h.copy()
        longer[k:] += h[:-k] << np.uint32(k)
        h = longer
    shift = np.uint32(32 - (chunk_bytes.bit_length() - 1))
    ends = np.flatnonzero((h >> shift) == 0) + 1
    ends = ends[ends < len(b)]
    ends = ends[(b[ends] & 0xC0) != 0x80]  # between code points
    return np.append(ends, len(b)) if len(b) else ends


def chunk_rows(text: str, chunk_bytes: int = CHUNK_BYTES):
    """(start, length, hash) of the chunks, in code points."""
    data = text.encode("utf-8", "replace")
    ends = cut_points(data, chunk_bytes)
    if len(data) == len(text):
        chars = ends
    else:
        chars = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[ends - 1]
    at = start = 0
    for end, stop in zip(ends.tolist(), chars.tolist()):
        yield start, stop - start, hashlib.blake2b(data[at:end], digest_size=16).digest()
        at, start = end, stop


def encode_chunk(enc, text: str) -> tuple[bytes, int, int]:
    """Ids of the stable part of a chunk taken by itself, the length of that part
    in code points (0: not to be reused) and of the ids in bytes."""
    if not enc.fast or UNUSUAL.search(text):
        return b"", 0, 0
    tokens = PRETOKENS.findall(text)[:-UNSTABLE]
    ids = b"".join(map(enc.words.__getitem__, tokens))
    return ids, sum(map(len, tokens)), len(ids)


def assemble(enc, text: str, shared) -> bytes:
    """Ids of a text; ``shared``: (start, ids, stable length) of its reusable
    chunks, in order of their start."""
    if not shared or not enc.fast or UNUSUAL.search(text) or (
            enc.at_special is not None and enc.at_special.search(text)):
        return enc.ids(text)
    words, out, at = enc.words, [], 0   # all of text[:at] is in ``out``
    for start, ids, stable in shared:
        if start + stable <= at:
            continue
        # the chunk's own boundaries near its start: code points and id bytes
        head = {0: 0} if start >= at else {}
        chars = size = 0
        for token in PRETOKENS.findall(text[start:start + HEAD_CHARS])[:-UNSTABLE]:
            chars += len(token)
            size += len(words[token])
            if start + chars >= at and chars <= stable:
                head[chars] = size
        # boundaries from the true one at ``at``, into the chunk
        window = text[at:start + HEAD_CHARS]
        tokens = PRETOKENS.findall(window)
        if at + len(window) < len(text):
            tokens = tokens[:-UNSTABLE]
        place, taken = at, 0
        for token in tokens:
            if place >= start and place - start in head:
                break
            place += len(token)
            taken += 1
        if place < start or place - start not in head:
            continue
        out += map(words.__getitem__, tokens[:taken])
        out.append(ids[head[place - start]:])
        at = start + stable
    out += map(words.__getitem__, PRETOKENS.findall(text[at:]))
    return b"".join(out)


def narrow(ids: bytes, enc) -> bytes:
    """Ids for a shuffle: two bytes each if the vocabulary allows, compressed."""
    if len(enc.bytes_of) <= 1 << 16:
        ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    return zstandard.compress(ids)


def widen(ids: bytes, enc) -> bytes:
    ids = zstandard.decompress(ids)
    if len(enc.bytes_of) <= 1 << 16:
        ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
    return ids


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                     text_col: str = "text", chunk_bytes: int = CHUNK_BYTES,
                     decode: bool = False) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers; with ``decode``
    also ``decoded``, the text that the ids decode to, made in the same tasks."""
    texts = id_text(docs, id_col, text_col)
    # rows with the same id and text are one document here
    texts = texts.withColumn("k", hash128(F.coalesce(F.col("doc_id").cast("string"),
                                                     F.lit("none")), F.col("text")))

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *c) for k, text in zip(pdf["k"], pdf["text"])
                    for c in chunk_rows(text, chunk_bytes)]
            yield pd.DataFrame(rows, columns=["k", "start", "length", "h"])

    table = cut(texts.select("k", "text").mapInPandas(
        chunks, "k binary, start int, length int, h binary"))
    shared = cut(table.groupBy("h").agg(F.count(F.lit(1)).alias("n"),
                                        F.min(F.struct("k", "start", "length")).alias("p"))
                 .where("n > 1").select("h", "p.*"))

    def compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(z=[zstandard.compress(x.encode("utf-8", "replace"))
                                for x in pdf["text"]])[["k", "doc_id", "z"]]

    # the filter, which drops nothing, makes both uses below one shuffle
    packed = texts.mapInPandas(compress, "k binary, doc_id long, z binary").where("k is not null")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path)
        for pdf in batches:
            out = []
            for z, parts in zip(pdf["z"], pdf["parts"]):
                text = zstandard.decompress(z).decode()
                for p in parts:
                    ids, stable, _ = encode_chunk(enc, text[p["start"]:p["start"] + p["length"]])
                    if stable:
                        out.append((p["h"], narrow(ids, enc), stable))
            yield pd.DataFrame(out, columns=["h", "ids", "stable"])

    # One place of each shared chunk gives its text.  Both joins with the texts are
    # merge joins at every size, so that they use one shuffle.
    wanted = shared.groupBy("k").agg(F.collect_list(F.struct("h", "start", "length"))
                                     .alias("parts"))
    encoded = (packed.join(wanted.hint("merge"), "k").select("doc_id", "z", "parts")
               .mapInPandas(encode, "h binary, ids binary, stable int"))
    reused = (table.join(encoded, "h")
              .groupBy("k").agg(F.collect_set(F.struct("start", "stable", "ids")).alias("reused")))

    def put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, len(batch), YIELDED):
                pdf, ids = batch.iloc[at:at + YIELDED], []
                for z, parts in zip(pdf["z"], pdf["reused"]):
                    parts = () if parts is None else sorted(
                        (p["start"], widen(p["ids"], enc), p["stable"]) for p in parts)
                    ids.append(assemble(enc, zstandard.decompress(z).decode(), parts))
                out = {"doc_id": pdf["doc_id"].to_numpy(), "ids": ids}
                yield pd.DataFrame(out | {"decoded": [enc.text(x) for x in ids]} if decode else out)

    return (packed.join(reused.hint("merge"), "k", "left").select("doc_id", "z", "reused")
            .mapInPandas(put_together, "doc_id long, ids binary" + ", decoded string" * decode))


def decoded(ids: Column, tokenizer_path: str) -> Column:
    """Text of a column of ids (special tokens written out)."""
    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        enc = encoder(tokenizer_path)
        return column.map(enc.text)

    return decode(ids)


def encoded_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids and of the text decoded from them."""
    ids = encode_documents(docs, tokenizer_path, decode=True)
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
