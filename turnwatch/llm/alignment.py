"""Cross-tokenizer alignment with an identity map for tokens of the same bytes (operator 11)."""

from __future__ import annotations

import hashlib
import json
import math
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwatch.llm.bpe import encode
from turnwatch.llm.hashing import batches as ranges_of
from turnwatch.llm.rows import arrow_schema, written

PIECE_CHARS = 100_000
#: Bytes of text per part: the documents whose links are looked up in one task at a time.
PART_BYTES, BATCH_BYTES = 16_000_000, 1_000_000
#: A pair of ids as one number.
SHIFT = 16
DOC_DDL = ("part int, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, same binary, same_n binary, "
           "pairs binary, pairs_n binary")
OUT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others
    for 256 and up in their order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, the bytes of their tokens and the identity map: for each id of the first the id of
    the second with the same bytes, or -1 (of several, the smallest)."""

    def __init__(self, byte_file: str, piece_file: str, pattern: str):
        with open(byte_file, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items()}
        self.first = tiktoken.Encoding("first", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        sp = self.second
        self.bytes_b = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else
                        sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.vocab_size())]
        if len(self.bytes_b) > 1 << SHIFT:
            raise ValueError("the second vocabulary has more ids than a pair can hold")
        self.size_a, self.size_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))
        of_bytes: dict[bytes, int] = {}
        for i, token in enumerate(self.bytes_b):
            of_bytes.setdefault(token, i)
        self.identity = np.array([of_bytes.get(x, -1) for x in self.bytes_a], np.int64)
        # No piece has a space after another character, so a text may be cut where a space follows one.
        self.splits = not any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.vocab_size()))
        # A decimal id and what follows it: within its side, at the end of it.
        self.written = ([f"{i},".encode() for i in range(len(self.bytes_a))] + [f"{i}|".encode() for i in range(len(self.bytes_a))]
                        + [f"{i},".encode() for i in range(len(self.bytes_b))] + [f"{i};".encode() for i in range(len(self.bytes_b))])

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both for a space and the text; none where either does not give back its bytes."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        want = b" " + text.encode()
        a, b = encode(self.first, " " + text, PIECE_CHARS), self._pieces(text)
        if b"".join(map(self.bytes_a.__getitem__, a)) != want or b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return none, none
        return np.array(a, np.int64), np.array(b, np.int64)

    def _pieces(self, text: str) -> list[int]:
        """Ids of the second. A long text is cut at single spaces, each of which comes back as the space that
        the tokenizer adds by itself."""
        out: list[int] = []
        start = 0
        while self.splits and len(text) - start > PIECE_CHARS:
            cut = text.find(" ", start + PIECE_CHARS)
            while cut > 0 and (text[cut - 1] in " ▁" or text[cut + 1:cut + 2] in ("", " ", "▁")):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            out += self.second.encode(text[start:cut])
            start = cut + 1
        return out + self.second.encode(text[start:])

    def groups(self, a: np.ndarray, b: np.ndarray):
        """The last tokens of both sides of each group, which groups are one token to the same, and the digest of all."""
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        last_a, last_b = np.searchsorted(end_a, both), np.searchsorted(end_b, both)
        n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        same = (n_a == 1) & (n_b == 1) & (self.identity[a[last_a]] == b[last_b])
        # Each token's place in the written groups: after the tokens of its own side before it and those of the
        # other side in the groups before (for the second side, its own group as well).
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        token = np.zeros(len(a) + len(b), np.int64)
        at_a = np.arange(len(a)) + np.append(0, last_b + 1)[group_a]
        at_b = np.arange(len(b)) + (last_a + 1)[group_b]
        token[at_a], token[at_b] = a, b + 2 * len(self.bytes_a)
        token[at_a[last_a]] += len(self.bytes_a)
        token[at_b[last_b]] += len(self.bytes_b)
        text = b"".join(map(self.written.__getitem__, token.tolist()))[:-1]
        return a[last_a], b[last_b], same, hashlib.sha256(text).hexdigest()


@cache
def tokenizers(byte_file: str, piece_file: str, pattern: str) -> Pair:
    return Pair(byte_file, piece_file, pattern)


def _counted(values: np.ndarray, kind: str) -> tuple[bytes, bytes]:
    found, n = np.unique(values, return_counts=True)
    return found.astype(kind).tobytes(), n.astype("<u4").tobytes()


def tokenised(docs: DataFrame, files: tuple[str, str, str], id_col: str, text_col: str, parts: int) -> DataFrame:
    """A row per document: token counts, groups, and its links as distinct ids (``same``) or pairs with their numbers."""
    schema = arrow_schema(DOC_DDL)

    def run(frames):
        pair = tokenizers(*files)
        for batch in frames:
            texts = batch.column(2)
            for lo, hi in ranges_of(texts.to_pylist(), BATCH_BYTES):
                rows: list[tuple] = []
                for text in texts.slice(lo, hi - lo).to_pylist():
                    a, b = pair.tokens(text)
                    if not len(a):
                        rows.append((0, 0, 0, "", b"", b"", b"", b""))
                        continue
                    one, two, same, digest = pair.groups(a, b)
                    rows.append((len(a), len(b), len(one), digest, *_counted(one[same], "<u2"),
                                 *_counted(one[~same] << SHIFT | two[~same], "<u4")))
                columns = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                           *[pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[2:])]]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    part = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(parts)).cast("int")
    return docs.select(part, F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, DOC_DDL)


def identity_counts(rows: DataFrame, size: int) -> np.ndarray:
    """How often each id of the first tokenizer is linked one to one with its like: a vector as long as the
    vocabulary, added up per task and then by id."""
    schema = arrow_schema("a long, n long")

    def count(frames):
        total = np.zeros(size, np.int64)
        for batch in frames:
            for ids, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[np.frombuffer(ids, "<u2")] += np.frombuffer(n, "<u4")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], schema=schema)

    found = rows.select("same", "same_n").mapInArrow(count, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found["a"].to_numpy()] = found["n"].to_numpy()
    return out


def align(docs: DataFrame, byte_file: str, piece_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
          parts: int | None = None) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one row per row of ``docs``.

    A text is encoded by both tokenizers with a space before it; offsets at which a token of each ends cut it into groups, and
    the two tokens that end there are a link. ``count_sum`` adds up how often each linked pair of ids is linked in the corpus,
    ``n_best`` are the links whose pair is the most frequent one of its second id (ties included). ``groups_sha256`` is the digest
    of all groups as ``a1,a2|b1;a3|b2,b3``.

    Groups of one token and its like (``identity``) are counted in vectors as long as the vocabulary. Only other links are
    shuffled, as distinct pairs per part of the documents. A text that is null or empty, or that either side does not give back
    byte by byte, has no tokens: zeros and an empty digest. Rows that repeat an id and null ids are rows like others; other
    columns are not read. Long texts are cut where no token can cross; a stretch without such a place stays whole."""
    files = (byte_file, piece_file, pattern)
    if parts is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
        parts = max(8, math.ceil(size / PART_BYTES))
    pair = tokenizers(*files)
    rows = written(tokenised(docs, files, id_col, text_col, parts), "tokens")
    vector = identity_counts(rows, len(pair.bytes_a))
    best = np.zeros(len(pair.bytes_b), np.int64)
    known = np.flatnonzero(vector)
    np.maximum.at(best, pair.identity[known], vector[known])

    found_schema = arrow_schema("part int, pair long, n long")

    def of_part(key, table):
        pairs = np.frombuffer(b"".join(table["pairs"].to_pylist()), "<u4")
        n = np.frombuffer(b"".join(table["pairs_n"].to_pylist()), "<u4")
        ids, where = np.unique(pairs, return_inverse=True)
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, where, n)
        return pa.table({"part": np.full(len(ids), key[0].as_py(), np.int32), "pair": ids.astype(np.int64), "n": total}, schema=found_schema)

    slim = rows.select("part", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "same", "same_n", "pairs", "pairs_n")
    irregular = written(slim.select("part", "pairs", "pairs_n").groupBy("part").applyInArrow(of_part, "part int, pair long, n long"), "pairs")
    totals = irregular.groupBy("pair").agg(F.sum("n").alias("total"))
    # A number for each id of the second vocabulary.
    most = totals.groupBy(F.expr(f"pair & {(1 << SHIFT) - 1}").alias("b")).agg(F.max("total").alias("n")).toArrow()
    np.maximum.at(best, most["b"].to_numpy(), most["n"].to_numpy())
    back = irregular.select("part", "pair").join(totals, "pair").select("part", "pair", "total")
    shared = docs.sparkSession.sparkContext.broadcast((vector, best, pair.identity))
    out_schema = arrow_schema(OUT_DDL)

    def look_up(key, table, counts):
        vector, best, identity = shared.value
        pairs, total = counts["pair"].to_numpy(), counts["total"].to_numpy()
        order = np.argsort(pairs)
        pairs, total = pairs[order], total[order]
        links, top, sums = [], [], []
        for same, same_n, own, own_n in zip(*(table[c].to_pylist() for c in ("same", "same_n", "pairs", "pairs_n"))):
            same, same_n = np.frombuffer(same, "<u2"), np.frombuffer(same_n, "<u4").astype(np.int64)
            own, own_n = np.frombuffer(own, "<u4").astype(np.int64), np.frombuffer(own_n, "<u4").astype(np.int64)
            one, two = vector[same], total[np.searchsorted(pairs, own)] if len(own) else own
            links.append(int(same_n.sum() + own_n.sum()))
            sums.append(int((one * same_n).sum() + (two * own_n).sum()))
            top.append(int(same_n[one == best[identity[same]]].sum() + own_n[two == best[own & (1 << SHIFT) - 1]].sum()))
        return pa.table([table["doc_id"], table["n_a"], table["n_b"], table["n_groups"], pa.array(links, pa.int64()), pa.array(top, pa.int64()),
                         pa.array(sums, pa.int64()), table["groups_sha256"]], schema=out_schema)

    return slim.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(look_up, OUT_DDL)
