"""Token sequences of a fixed length: shortest-pack-first packing over the histogram of lengths."""

from __future__ import annotations

import base64
import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import Scratch, ranked

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_SPECIAL = "<|endoftext|>"
_loaded: dict = {}


def byte_bpe(json_file: str, ranks_file: str):
    """An encoder that gives the ids of `json_file`'s tokenizer.

    `ranks_file` holds the same merges for a faster library; a text with the special token's string goes to the tokenizer itself.
    """
    key = (json_file, ranks_file)
    if key not in _loaded:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        whole = Tokenizer.from_file(json_file)
        _loaded[key] = lambda t: whole.encode(t, add_special_tokens=False).ids if _SPECIAL in t else fast.encode_ordinary(t)
    return _loaded[key]


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """[(how many sequences, their lengths in order)]: longest lengths first, each into the emptiest pack with room.

    Its work depends on the number of different lengths, not on the number of pieces: packs of the
    same content are one pattern with a count, which splits when only part of them take a length.
    """
    by_room: dict[int, list[list]] = {}
    rooms: list[int] = []  # those that have patterns, ascending

    def put(room, n, lengths):
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append([n, lengths])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        grown = []
        while left:
            if not rooms or rooms[-1] < length:
                if not grown:
                    put(size, left, [])
                else:  # packs that took this length may take it once more before a new one is opened
                    for room, n, lengths in grown:
                        put(room, n, lengths)
                    grown = []
                    if rooms[-1] < length:
                        put(size, left, [])
            room = rooms[-1]
            n, lengths = by_room[room].pop()
            if n > left:
                by_room[room].append([n - left, lengths])
            if not by_room[room]:
                del by_room[room]
                rooms.pop()
            took = min(n, left)
            left -= took
            grown.append((room - length, took, [*lengths, length]))
        for room, n, lengths in grown:
            put(room, n, lengths)
    return [(n, lengths) for room in sorted(by_room) for n, lengths in by_room[room] if lengths]


def _places(patterns):
    """Sorted (length, first rank) keys and, for each, the sequence of that rank and the offset there."""
    rows, used, sequence = [], {}, 0
    for n, lengths in patterns:
        offset = 0
        for length in lengths:
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, offset))
            used[length] = rank + n
            offset += length
        sequence += n
    rows.sort()
    return [np.array(x, np.int64) for x in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 4


def pack_documents(documents: DataFrame, json_file: str, ranks_file: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """A row for each piece of a document: its tokens, and its place in a sequence of at most `size` tokens.

    A document is its ids and then `end_id`; a null text has only that. A document over `size` is cut
    into full sequences and a rest; rests and short documents are placed by the histogram of their lengths.
    Pieces of one length are ranked by (doc_id, start), and a pattern's slots take consecutive ranks, so only the
    histogram and the patterns (at most `size` lengths) reach the driver. Repeated rows and ids are packed each
    on its own, a null doc_id stays null, other columns are ignored, no documents give no rows.
    Sequences are numbered from 0 without gaps.
    """

    def cut(batches):
        encode = byte_bpe(json_file, ranks_file)
        for b in batches:
            out = [[] for _ in range(5)]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                for at in range(0, len(ids), size):
                    part = ids[at : at + size]
                    for column, v in zip(out, (doc, at, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[x.split()[0] for x in _PIECES.split(", ")])

    scratch = Scratch(documents.sparkSession)
    pieces = scratch.table(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECES))
    numbered, counts = ranked(scratch, pieces, "length", ["doc_id", "start"])
    length, first, sequence, offset = _places(pack_histogram(counts, size))
    wide = 1 << 48

    def place(batches):
        key = length * wide + first
        for b in batches:
            own, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(key, own * wide + rank, "right") - 1
            more = [pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *more], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return scratch.finish(numbered.mapInArrow(place, f"{_PIECES}, sequence_id long, offset long"))
