"""Best-fit packing by sum of squares: documents of tokens into sequences of fixed length.

A piece goes to the place where the sum over gaps g of N(g)^2 becomes smallest, N(g) being the
number of open sequences with g free tokens. Only N and a stack of sequence numbers per gap are kept,
so a packer's state is bounded by the sequence length and its own pieces.
Packers are independent: pieces are dealt to groups by hash, each group is packed by one task.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_splits, lean, need, prepare, stored

PIECES = "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Pieces per packer. A packer holds them as numbers (40 bytes each).
GROUP_PIECES = 60_000
#: Distinct chunks whose ids a worker keeps, and their bytes at most.
CACHE_CHUNKS, CACHE_BYTES = 1_000_000, 64
MARKS = frozenset(",.;:!?")
#: Code points below this are examined for plain letters: no two of them compose into one.
LETTERS = 0x0530

_coders: dict[str, ChunkCoder] = {}


class ChunkCoder:
    """Token ids of texts, by what lies between blanks, which no token crosses.

    A batch's chunks are numbered by Arrow; only its distinct chunks are looked up, and only those that no batch had before are encoded. A word of plain letters
    is encoded in lower case and without the mark behind it; plain are those letters of which this tokenizer proves, when it is loaded, that neither
    changes their ids. Known chunks and their ids are two Arrow arrays; what a batch uses stays when they grow too long.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[k for w, k in vocab.items() if w.endswith("</w>")]] = True
        self.plain = frozenset(filter(self._is_plain, map(chr, range(LETTERS))))
        self.marks = {m: self.encode(m) for m in MARKS}
        self.names, self.known = pa.array([""], pa.string()), pa.array([b""], pa.binary())

    def _is_plain(self, c: str) -> bool:
        """Whether words keep their ids if this letter is put in lower case, and if a mark behind it is encoded by itself. Capital sigma's lower case depends on its place in Python only."""
        if not c.isalpha() or len(c.lower()) > 1 or unicodedata.normalize("NFC", c) != c or c == "\u03a3":
            return False
        word = self.encode(f"a{c}")
        return word == self.encode(f"a{c.lower()}") and bool(
            self.ends_word[np.frombuffer(word, "<u4")[-1]]
        ) and self.encode(f"a{c}.") == word + self.encode(".")

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def lookup(self, chunks: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Of distinct chunks, their places in an array of ids, and that array."""
        at = pc.index_in(chunks, value_set=self.names)
        unknown = at.is_null()
        if not at.null_count:
            return at, self.known
        new = chunks.filter(unknown)
        table = pa.concat_arrays([self.known, pa.array(self.encoded(new.to_pylist()), pa.binary())])
        places = at.to_numpy(zero_copy_only=False).copy()
        places[unknown.to_numpy(zero_copy_only=False)] = np.arange(len(self.known), len(table))
        out = pa.array(places.astype(np.int64))
        names = pa.concat_arrays([self.names, new])
        if len(names) > CACHE_CHUNKS:
            used = pa.array(np.unique(places).astype(np.int64))
            names, self.known = names.take(used), table.take(used)
        else:
            self.known = table
        short = pc.less_equal(pc.binary_length(names), CACHE_BYTES)
        self.names, self.known = (names, self.known) if pc.all(short).as_py() else (names.filter(short), self.known.filter(short))
        return out, table

    def encoded(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks. Words of plain letters are encoded together: each ends in a token that ends a word."""
        out: list[bytes] = [b""] * len(chunks)
        words: dict[str, list[tuple[int, str]]] = {}
        for k, c in enumerate(chunks):
            w, mark = (c[:-1], c[-1]) if c[-1:] in MARKS else (c, "")
            if w and len(w) <= 64 and (w.isascii() and w.isalpha() or self.plain.issuperset(w)):
                words.setdefault(w.lower(), []).append((k, mark))
            else:
                out[k] = self.encode(c)
        for uses, ids in zip(words.values(), self.word_ids(list(words)), strict=True):
            for k, mark in uses:
                out[k] = ids + self.marks[mark] if mark else ids
        return out

    def word_ids(self, words: list[str]) -> list[bytes]:
        at = pc.index_in(pa.array(words, pa.string()), value_set=self.names)
        out: list = self.known.take(at).to_pylist()
        new = [k for k, x in enumerate(out) if x is None]
        parts = [new[i : i + 500] for i in range(0, len(new), 500)]
        found = self.tokenizer.encode_batch_fast([" ".join([words[k] for k in p]) for p in parts], add_special_tokens=False)
        for part, x in zip(parts, found, strict=True):
            ids = np.array(x.ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) * 4 + 4
            raw, begin = ids.tobytes(), 0
            for k, end in zip(part, ends.tolist() if len(ends) == len(part) else [None] * len(part), strict=True):
                out[k] = raw[begin:end] if end is not None else self.encode(words[k])
                begin = end
        return out

    def ids(self, texts: pa.Array) -> tuple[memoryview, np.ndarray]:
        """All texts' ids (little-endian 32-bit) one after another, and where each begins and the last ends, in bytes."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        if isinstance(split, pa.ChunkedArray):
            split = split.combine_chunks()
        numbered = split.flatten().dictionary_encode()
        places, table = self.lookup(numbered.dictionary)
        ids = table.take(places.take(numbered.indices))
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        of_chunk = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
        begin = split.offsets.to_numpy() - split.offsets[0].as_py()
        return memoryview(ids.buffers()[2] or b""), of_chunk[begin]


def _coder(path: str) -> ChunkCoder:
    if path not in _coders:
        _coders.clear()
        _coders[path] = ChunkCoder(path)
    return _coders[path]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 0) -> DataFrame:
    """Each document's token ids and end_id, cut into pieces of at most seq_len tokens.

    Null or empty text: the end id alone, one piece of length 1. Repeated rows are separate documents, told apart by row_key.
    """
    prepare(docs.sparkSession)
    end, width = np.array([end_id], "<u4").tobytes(), 4 * seq_len

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = _coder(tokenizer_path)
        key = TaskContext.get().partitionId() << 36
        for batch in _gathered(batches):
            rows: list[tuple] = []
            ids, begins = coder.ids(batch["text"])
            for doc_id, a, b in zip(batch["doc_id"].to_pylist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                for k, at in enumerate(range(a, b + 4, width)):
                    stop = min(at + width, b)
                    crc, n = zlib.crc32(ids[at:stop]), (stop - at) // 4
                    if stop == b and n < seq_len:
                        crc, n = zlib.crc32(end, crc), n + 1
                    rows.append((doc_id, key, k, (at - a) // 4, n, crc))
                key += 1
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "row_key", "piece", "start", "length", "ids_crc32"]
            )

    return need(docs, {"doc_id": "long", "text": "string"}).mapInArrow(lean(cut), PIECES)


def _gathered(batches: Iterator[pa.RecordBatch], chars: int = 4_000_000) -> Iterator[pa.Table]:
    """Batches put together until they hold about so many bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= chars:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def sum_of_squares(lengths: np.ndarray, seq_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, placed in the given order.

    Filling a gap g with s tokens changes the sum by 2(N(g-s) - N(g)) + 2, or 1 - 2N(g) if nothing is left;
    a new sequence by 2N(seq_len-s) + 1. Ties: the smallest gap.
    """
    n = np.zeros(seq_len + 1, np.int64)
    opened: list[list[int]] = [[] for _ in range(seq_len + 1)]
    seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        best, gap = (2 * n[seq_len - s] + 1 if s < seq_len else -(1 << 60)), 0
        if s < seq_len:
            at = n[s:seq_len]
            change = 2 * (n[: seq_len - s] - at) + 2
            change[0] = 1 - 2 * at[0]
            change[at == 0] = 1 << 60
            k = int(change.argmin())
            if change[k] <= best:
                gap = k + s
        if gap:
            q = opened[gap].pop()
            n[gap] -= 1
            off[i], left = seq_len - gap, gap - s
        else:
            q, made = made, made + 1
            off[i], left = 0, seq_len - s
        if left:
            opened[left].append(q)
            n[left] += 1
        seq[i] = q
    return seq, off


def pack_lengths(lengths: np.ndarray, seq_len: int) -> tuple[np.ndarray, np.ndarray]:
    """sum_of_squares in two orders: as given with the shortest tenth last, and longest first. The one with fewer sequences counts."""
    rank = np.argsort(-lengths, kind="stable")
    short = lengths < np.quantile(lengths, 0.1) if len(lengths) else lengths > 0
    late = np.concatenate([np.flatnonzero(~short), rank[short[rank]]])
    best = None
    for order in (late, rank):
        seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        seq[order], off[order] = sum_of_squares(lengths[order], seq_len)
        made = int(seq.max()) + 1 if len(seq) else 0
        if best is None or made < best[0]:
            best = made, seq, off
    return best[1], best[2]


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 0, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack documents into sequences of at most seq_len tokens; one row per piece.

    Nulls and empty texts are documents of one token; a null doc_id stays null; an empty table gives no rows;
    repeated rows are packed as often as they occur; other columns are ignored. Very long texts give as many full pieces as they need; of
    equal changes of the sum the smallest gap takes the piece.
    The token pass writes its short rows to the shared folder; only those are shuffled.
    """
    pieces = stored(in_splits(tokenized_pieces(docs, tokenizer_path, seq_len, end_id), docs), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))

    def fill(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("row_key", "ascending"), ("piece", "ascending")])
        seq, off = pack_lengths(t["length"].to_numpy(), seq_len)
        return pa.table(
            [t["doc_id"], t["piece"], t["start"], t["length"], t["ids_crc32"], pa.array(seq * groups + key[0].as_py()), pa.array(off)],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        )

    return pieces.withColumn("g", F.pmod(F.xxhash64("row_key", "piece"), F.lit(groups))).groupBy("g").applyInArrow(fill, PACKED)
