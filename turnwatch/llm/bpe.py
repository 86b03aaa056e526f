"""Byte-level BPE encoding and decoding with a local rank file (operator 7)."""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwatch.llm.rows import arrow_batch, arrow_schema

#: Texts longer than this are cut at safe boundaries, so that no call holds a whole long text.
PIECE_CHARS = 100_000
#: White-space runs longer than this are one match that the pattern engine cannot take.
SPACE_RUN = 10_000
# A match never crosses from other characters into white space, nor between letters and digits,
# and no match looks behind: text may be cut at these places without changing any match.
_SAFE = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
_RUN = regex.compile(r"\p{White_Space}{%d,}" % SPACE_RUN)


@cache
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS):
    """Cut a text at safe boundaries into pieces of about ``size`` characters. A stretch without
    one stays whole."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode(enc: tiktoken.Encoding, text: str, size: int = PIECE_CHARS) -> list[int]:
    """Token ids of a text, without special tokens."""
    if len(text) <= min(size, SPACE_RUN):
        return enc.encode_ordinary(text)
    ids: list[int] = []
    start = 0
    for run in _RUN.finditer(text):
        # All but the last character of the run is one match; all of it where the text ends.
        stop = run.end() if run.end() == len(text) else run.end() - 1
        for piece in pieces(text[start:run.start()], size):
            ids += enc.encode_ordinary(piece)
        ids += enc._encode_single_piece(text[run.start():stop])
        start = stop
    for piece in pieces(text[start:], size):
        ids += enc.encode_ordinary(piece)
    return ids


def encode_texts(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id",
                 text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, ``ids`` (token ids as little-endian unsigned 32-bit
    integers) and ``decoded`` (the bytes that the ids stand for).

    A null or empty text has no ids. Rows with a null or repeated id are rows like others; other
    columns of ``docs`` are not read. With ``digests`` the row carries ``n_tokens`` and the SHA-256
    of both byte strings in their place. ``rank_file`` is read on each worker."""
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"doc_id {kind}, n_tokens long, " + (
        "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded binary")
    schema = arrow_schema(ddl)

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            count, first, second = [], [], []
            for text in batch.column(1):
                ids = encode(enc, text.as_py() or "")
                raw, back = np.asarray(ids, "<u4").tobytes(), enc.decode_bytes(ids)
                count.append(len(ids))
                first.append(hashlib.sha256(raw).hexdigest() if digests else raw)
                second.append(hashlib.sha256(back).hexdigest() if digests else back)
            a, b = schema.names[2:]
            yield arrow_batch({"doc_id": batch.column(0), "n_tokens": count, a: first, b: second}, schema)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, ddl)


def token_ids(docs: DataFrame, rank_file: str, pattern: str, end: int, width: int = 2, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``, one row per row of ``docs``: token ids of ``width`` bytes each, little-endian, and ``end`` after the last.

    A null or empty text has the end alone. ``end`` is an id that no token has; ids that do not fit ``width`` are an error."""
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"doc_id {kind}, ids binary"
    schema = arrow_schema(ddl)

    def run(batches):
        enc = encoding(rank_file, pattern)
        if not enc.max_token_value < end < 1 << 8 * width:
            raise ValueError("the end must be above all ids and fit the width")
        for batch in batches:
            ids = [np.asarray([*encode(enc, text.as_py() or ""), end], f"<u{width}").tobytes() for text in batch.column(1)]
            yield arrow_batch({"doc_id": batch.column(0), "ids": ids}, schema)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, ddl)


def decode_ids(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``decoded`` bytes for rows of ``(doc_id, ids)``; null ids decode to nothing."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, decoded binary"
    schema = arrow_schema(ddl)

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            back = [enc.decode_bytes(np.frombuffer(x.as_py() or b"", "<u4").tolist()) for x in batch.column(1)]
            yield arrow_batch({"doc_id": batch.column(0), "decoded": back}, schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, ddl)
