"""SentencePiece encoding and decoding: a relational lattice of the vocabulary's pieces over the distinct words."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .cluster import Scratch, lean, partitions, settings

SPACE = "▁"
KNOWN_WORDS = 400_000  # the most frequent words, at most, whose ids every task holds; the others are joined to their block of documents
WIDE = 61  # characters of a word whose borders fit the bits of a long; longer words are merged in Python
BLOCK_BYTES = 4 << 20
TASK_BYTES = 8 << 20  # of text, for each task of the lattice
_models: dict = {}


class PieceTable:
    """The pieces of a BPE model with byte fallback, by text, and which bytes stand side by side in them."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        plain = [i for i in range(model.get_piece_size()) if not any(f(i) for f in special)]
        self.text = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.ids = {self.text[i].replace(SPACE, " "): i for i in plain}
        score = {p: model.get_score(i) for p, i in self.ids.items()}
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in score.items()}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = model.unk_id()
        if self.byte_ids[0] == self.unknown:
            self.byte_ids = []
        self.longest = max(map(len, self.ids))
        body = [p.replace(SPACE, " ").encode() for p in self.text]
        for b, i in enumerate(self.byte_ids):
            body[i] = bytes([b])
        for i in range(len(body)):
            if model.is_control(i):
                body[i] = b""
        body[self.unknown] = " ⁇ ".encode()
        self.bytes_of = pa.array(body, pa.binary())
        together = np.zeros((256, 256), bool)
        for p in self.ids:
            x = np.frombuffer(p.encode(), np.uint8)
            together[x[1:], x[:-1]] = True
        # by two bytes as a little-endian number: whether a word ends between them, which is never inside a character
        self.ends = (~together & ((np.arange(256) & 0xC0) != 0x80)[:, None]).ravel()

    def merged(self, word: str) -> list[str]:
        """Pieces by repeated merging: always the best-scored adjacent pair that makes a piece, the first of equals."""
        import heapq

        n = len(word)
        before, after, ends = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
        heap: list = []

        def offer(a, b):
            r = self.rank.get(word[a : ends[b]]) if a >= 0 and b < n and ends[b] - a <= self.longest else None
            if r is not None:
                heapq.heappush(heap, (r, a, ends[a], ends[b]))

        for a in range(n - 1):
            offer(a, a + 1)
        while heap:
            _, a, middle, end = heapq.heappop(heap)
            if ends[a] != middle or middle >= n or ends[middle] != end:
                continue
            ends[middle], ends[a], after[a] = -1, end, after[middle]
            if after[a] < n:
                before[after[a]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
        out, a = [], 0
        while a < n:
            out.append(word[a : ends[a]])
            a = ends[a]
        return out

    def encode_word(self, word: str) -> list[int]:
        out = []
        for part in self.merged(word):
            i = self.ids.get(part)
            out += [i] if i is not None else [self.byte_ids[b] for b in part.encode()] if self.byte_ids else [self.unknown]
        return out

    def words(self, column):
        """(data, starts, offsets) of a text column: its bytes, where its words start in them, and where its texts do.

        U+2581 counts as a space, and a text that isn't empty gets one before it. A word ends where no piece holds the two bytes side by
        side, so no merge passes its ends, and words are encoded one by one.
        """
        column = column.cast(pa.large_string()).fill_null("")
        if pc.any(pc.match_substring(column, SPACE)).as_py():
            column = pc.replace_substring(column, SPACE, " ")
        body, own = wordhash.utf8(column)
        some = np.diff(own) > 0
        offsets = own + np.concatenate([[0], np.cumsum(some)])
        data = np.full(offsets[-1], 32, np.uint8)
        mine = np.ones(len(data), bool)
        mine[offsets[:-1][some]] = False
        data[mine] = body
        begin = np.ones(len(data), bool)
        for shift in (0, 1):
            pairs = data[shift : shift + (len(data) - shift) // 2 * 2].view("<u2")
            begin[shift + 1 : shift + 1 + 2 * len(pairs) : 2] = self.ends[pairs]
        begin[offsets[:-1][some]] = True
        return data, np.flatnonzero(begin), offsets

    def distinct(self, column):
        """(data, offsets, distinct words, which of them each word is, the words' bounds by text)."""
        data, starts, offsets = self.words(column)
        ends = np.append(starts, len(data)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        return data, offsets, words.dictionary, words.indices.to_numpy(), np.searchsorted(starts, offsets)


def piece_table(model_file: str) -> PieceTable:
    if model_file not in _models:
        _models[model_file] = PieceTable(model_file)
    return _models[model_file]


def _blocks(batches):
    """(doc_id, text) of at most about BLOCK_BYTES of text, or one longer text; the same for the same batches."""
    for b in batches:
        _, offsets = wordhash.utf8(b.column("text"))
        for lo, hi in wordhash.chunks(offsets, BLOCK_BYTES):
            yield b.slice(lo, hi - lo)


def _counted(model_file):
    """Texts to (word, n): each task's distinct words, of a bounded number of them at a time."""

    def rows(held):
        words = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
        n = np.bincount(words.indices.to_numpy(), np.concatenate([c for _, c in held]), len(words.dictionary)).astype(np.int64)
        return words.dictionary, n

    def run(batches):
        table, held = piece_table(model_file), []
        for b in _blocks(batches):
            _, _, words, which, _ = table.distinct(b.column("text"))
            held.append((words, np.bincount(which, minlength=len(words))))
            if sum(len(w) for w, _ in held) > KNOWN_WORDS:
                held = [rows(held)]
                if len(held[0][0]) > KNOWN_WORDS // 2:
                    yield _words_and_counts(*held.pop())
        if held:
            yield _words_and_counts(*rows(held))

    return run


def _words_and_counts(words, n):
    return pa.RecordBatch.from_arrays([words.cast(pa.large_string()).cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"])


#: An edge is a long: rank, start (6 bits), end (6 bits) and id (20 bits) of a piece of a word; _BYTES stands for a character that is no piece.
_START, _END, _BYTES = "cast(shiftright(e, 26) & 63 as int)", "cast(shiftright(e, 20) & 63 as int)", (1 << 20) - 1
_ON_BORDERS = f"(shiftright(m, {_START}) & 1) = 1 and (shiftright(m, {_END}) & 1) = 1"
_INSIDE = f"(m & (shiftleft(1L, {_END}) - shiftleft(1L, {_START} + 1)))"


def relational_lattice(words: DataFrame, model_file: str) -> DataFrame:
    """(word, n, ids) of distinct words of 1 to WIDE characters (a space in place of U+2581) with their counts n, by Spark tables.

    Substrings of at most the longest piece are exploded and equi-joined to the piece table (bounded by the vocabulary, so
    broadcast), both by their 64-bit hash, which is several times as fast as by the strings; what comes out is held against the words again
    where it is used. The edges are grouped by word, best score first, and folded by an `aggregate`. Its state is the word's borders as the bits of a
    long: each step takes, of the edges with both ends on borders and one border inside, the best-scored and first, and removes that
    border. (This is a BPE model: sums of scores don't rank its paths, so the fold merges where another model's would add up.) A character
    that is no piece becomes the ids of its bytes. If `words` is dealt by word, nothing is shuffled here.
    """
    table = piece_table(model_file)
    rows = [(p, (table.rank[p] << 32) + i) for p, i in table.ids.items()]
    vocabulary = F.broadcast(words.sparkSession.createDataFrame(rows, "piece string, code long").select(F.xxhash64("piece").alias("piece"), "code"))
    start = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("start"))
    spans = start.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(table.longest), F.length("word") - F.col("start")))).alias("size"))
    joined = spans.withColumn("piece", F.expr("xxhash64(substring(word, start + 1, size))")).join(vocabulary, "piece", "left").where("code is not null or size = 1")
    code = f"coalesce(code, {_BYTES}L) + shiftleft(cast(start as bigint), 26) + shiftleft(cast(start + size as bigint), 20)"
    edges = joined.select("word", "n", F.expr(code).alias("e")).groupBy("word", "n").agg(F.sort_array(F.collect_list("e")).alias("edges"))
    # a transform over an array of one gives its element a name: e the edge to take, m the borders left
    fold = f"""
      aggregate(sequence(1, length(word)),
        named_struct('m', shiftleft(1L, length(word) + 1) - 1, 'open', filter(edges, e -> {_END} - {_START} > 1)),
        (s, i) -> case when size(s.open) = 0 then s else transform(
          transform(array(try_element_at(filter(s.open, e -> bit_count({_INSIDE.replace("m &", "s.m &")}) = 1), 1)), e -> s.m ^ {_INSIDE.replace("m &", "s.m &")}),
          m -> named_struct('m', coalesce(m, s.m), 'open', filter(s.open, e -> m is not null and {_ON_BORDERS} and {_INSIDE} <> 0)))[0] end,
        s -> transform(array(s.m), m -> sort_array(transform(filter(edges, e -> {_ON_BORDERS} and {_INSIDE} = 0), e -> e & {(1 << 32) - 1}L)))[0])"""
    number = f"cast(e & {_BYTES} as int)"
    if table.byte_ids:
        known = f"array({', '.join(map(str, table.byte_ids))})"
        spelt = f"transform(array(hex(encode(substring(word, {_START} + 1, 1), 'utf-8'))), h -> transform(sequence(1, length(h), 2), k -> element_at({known}, cast(conv(substring(h, k, 2), 16, 10) as int) + 1)))[0]"
    else:
        spelt = f"array({table.unknown})"
    ids = f"""case when exists(path, e -> {number} = {_BYTES}) then flatten(transform(path, e -> case when {number} = {_BYTES} then {spelt} else array({number}) end))
      else transform(path, e -> {number}) end"""
    return edges.select("word", "n", F.expr(fold).alias("path")).select("word", "n", F.expr(ids).alias("ids"))


def _merged_words(model_file):
    """(word, n) to (word, n, ids), without a lattice."""

    def run(batches):
        table = piece_table(model_file)
        for b in batches:
            ids = [table.encode_word(w) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return run


def vocabulary(scratch: Scratch, documents: DataFrame, model_file: str, wide: int = WIDE) -> DataFrame:
    """(word, n, ids) of all distinct words of the documents."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = min(1 << 14, max(partitions(scratch.spark), -(-size // TASK_BYTES)))
    words = documents.select("text").mapInArrow(_counted(model_file), "word string, n long").repartition(tasks, "word").groupBy("word").agg(F.sum("n").alias("n"))
    short = relational_lattice(words.where(F.length("word") <= wide), model_file)
    long = words.where(F.length("word") > wide).mapInArrow(_merged_words(model_file), "word string, n long, ids array<int>")
    # the words of one task, with their edges, fit its memory
    with settings(scratch.spark, {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "200000"}):
        return scratch.table(short.unionByName(long))


class Words:
    """Words (a binary array) with the ids of each: ids[ends[k] : ends[k + 1]] of word k."""

    def __init__(self, words, ids: np.ndarray, ends: np.ndarray):
        self.words, self.ids, self.ends = words, ids, ends

    @classmethod
    def of(cls, words, lists):
        """From an array of strings and one of lists of ids."""
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]).astype(np.int64)
        return cls(words.cast(pa.large_string()).cast(pa.large_binary()), lists.flatten().to_numpy().astype("<i4"), ends)

    def find(self, words) -> np.ndarray:
        """The place of each word among these, or -1."""
        if not len(self.words):
            return np.full(len(words), -1)
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()

    def spelt(self, table: PieceTable) -> Words:
        """Those whose pieces make the word, as all do unless two substrings have one hash."""
        body = table.bytes_of.take(pa.array(self.ids))
        sizes = pc.binary_length(self.words).to_numpy()
        lengths = pc.binary_length(body).to_numpy()
        same = np.diff(np.concatenate([[0], np.cumsum(lengths)])[self.ends]) == sizes
        if same.all() and len(self.words):
            whole, back = (wordhash.utf8_bytes(x) for x in (self.words, body))
            same = ~np.logical_or.reduceat(whole != back, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            if same.all():
                return self
        keep = np.flatnonzero(same)
        at = np.concatenate([np.zeros(0, np.int64), *(np.arange(self.ends[k], self.ends[k + 1]) for k in keep)])
        return Words(self.words.take(pa.array(keep)), self.ids[at], np.concatenate([[0], np.cumsum(np.diff(self.ends)[keep])]))


def frequent(words: DataFrame, most: int = KNOWN_WORDS) -> tuple[Words, int]:
    """The words that are as frequent as some least count or more, at most `most` of them, and that count."""
    level = F.floor(F.log2("n") * 8)
    least, total = 1 << 62, 0
    for r in sorted(words.groupBy(level.alias("level")).agg(F.count("*").alias("c"), F.min("n").alias("n")).collect(), key=lambda r: -r.level):
        total += r.c
        if total > most:
            break
        least = r.n
    held = words.where(F.col("n") >= least).select("word", "ids").toArrow().combine_chunks()
    column = lambda c: held.column(c).combine_chunks()
    return Words.of(column("word"), column("ids")), least


def _key(block) -> bytes:
    data, offsets = wordhash.utf8(block.column("text"))
    return hashlib.blake2b(np.ascontiguousarray(data).data, digest_size=16, key=hashlib.blake2b(offsets.tobytes()).digest()).digest()


def _missing(model_file, known):
    """(block, word) of the words of each block of documents that not every task holds."""

    def run(batches):
        table = piece_table(model_file)
        for b in _blocks(batches):
            _, _, words, _, _ = table.distinct(b.column("text"))
            new = words.filter(pa.array(known.value.find(words) < 0))
            if len(new):
                yield pa.RecordBatch.from_arrays([pa.array([_key(b)] * len(new), pa.binary()), new.cast(pa.large_string()).cast(pa.string())], names=["block", "word"])

    return run


def _packed():
    """Each block of documents as one compressed value, with its key."""

    def run(batches):
        for b in _blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([_key(b)], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "body"])

    return run


def encode_block(table: PieceTable, known: list[Words], column):
    """(ids, bounds, data, offsets) of a text column: all ids, where each text's are, and its bytes as `PieceTable.words` gives them.

    Words that none of `known` has are merged here.
    """
    data, offsets, words, which, bounds = table.distinct(column)
    begin, sizes, bodies, held = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
    left = np.arange(len(words))
    for some in known:
        at = some.find(words.take(pa.array(left)))
        hit, at = left[at >= 0], at[at >= 0]
        begin[hit], sizes[hit] = held + some.ends[at], some.ends[at + 1] - some.ends[at]
        bodies.append(some.ids)
        held += len(some.ids)
        left = np.setdiff1d(left, hit, assume_unique=True)
    for k in left.tolist():
        bodies.append(np.array(table.encode_word(words[k].as_py().decode()), "<i4"))
        begin[k], sizes[k] = held, len(bodies[-1])
        held += len(bodies[-1])
    body = np.concatenate([np.zeros(0, "<i4"), *bodies])
    out = np.concatenate([[0], np.cumsum(sizes[which])])
    ids = body[np.repeat(begin[which] - out[:-1], sizes[which]) + np.arange(out[-1])]
    return ids, out[bounds], data, offsets


def _through(documents: DataFrame, model_file: str, result, schema: str, most: int, wide: int) -> DataFrame:
    """`result` of each block of documents and its ids, which come from the lattice of the vocabulary."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = vocabulary(scratch, docs, model_file, wide)
    held, least = frequent(words, most)
    known = spark.sparkContext.broadcast(held)
    needed = docs.mapInArrow(_missing(model_file, known), "block binary, word string").join(words.where(F.col("n") < least).select("word", "ids"), "word")
    # the words of a block are bounded by its size
    extra = scratch.table(needed.groupBy("block").agg(F.collect_list("word").alias("words"), F.collect_list("ids").alias("ids")))

    def run(batches):
        table = piece_table(model_file)
        frequent_words = known.value.spelt(table)
        for b in batches:
            for body, words, ids in zip(*(b.column(c) for c in ("body", "words", "ids")), strict=True):
                # a word that hasn't come, as after a change of the rows' order, is merged in place
                rest = [Words.of(words.values, ids.values).spelt(table)] if words.is_valid else []
                for part in pa.ipc.open_stream(body.as_py()):
                    yield result(table, part, *encode_block(table, [frequent_words, *rest], part.column("text")))

    lean(spark)
    packed = docs.mapInArrow(_packed(), "block binary, body binary")
    return scratch.finish(packed.join(extra, "block", "left").mapInArrow(run, schema))


def _arrays(table, part, ids, bounds, data, offsets):
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])


def _digest(table, part, ids, bounds, data, offsets):
    sizes = np.diff(bounds)
    body = table.bytes_of.take(pa.array(ids))
    ends = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1] if len(body) else np.zeros(1, np.int32)
    back = np.frombuffer(body.buffers()[2], np.uint8) if len(body) and body.buffers()[2] is not None else np.zeros(0, np.uint8)
    texts = pc.fill_null(part.column("text"), "")
    own = pc.match_substring(texts, SPACE).to_numpy(zero_copy_only=False)
    same, flat = [], memoryview(np.ascontiguousarray(ids, "<i4")).cast("B")
    crc = []
    for i in range(len(sizes)):
        lo, hi = bounds[i], bounds[i + 1]
        crc.append(zlib.crc32(flat[4 * lo : 4 * hi]))
        same.append(not own[i] and np.array_equal(back[ends[lo] : ends[hi]], data[offsets[i] : offsets[i + 1]]))
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids_crc32", "round_trip"])


def encode_documents(documents: DataFrame, model_file: str, most: int = KNOWN_WORDS, wide: int = WIDE) -> DataFrame:
    """(doc_id, ids): the ids that the model's own library gives each whole text, none for a null or empty one.

    All distinct words get their ids from the lattice once. The `most` most frequent ones are known to every task; the others, of which a
    block of documents has few, are joined to the blocks that hold them. Words of more than `wide` characters are merged
    pair by pair, outside the lattice, with the same ids. Repeated rows are encoded alike, other columns ignored, a null doc_id
    stays null, no documents give no rows.
    """
    return _through(documents, model_file, _arrays, "doc_id long, ids array<int>", most, wide)


def decode(ids, table: PieceTable) -> str:
    """The text of ids: the bytes of their pieces, each ▁ a space, without the first space."""
    whole = b"".join(table.bytes_of.take(pa.array(ids, pa.int32())).to_pylist()).decode("utf-8", "replace")
    return whole[1:] if whole.startswith(" ") else whole


def decode_documents(encoded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""

    def run(batches):
        table = piece_table(model_file)
        for b in batches:
            texts = [decode(ids or [], table) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(documents: DataFrame, model_file: str, most: int = KNOWN_WORDS, wide: int = WIDE) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, round_trip): a digest of the ids of `encode_documents`, and whether their pieces give the text again.

    A null text is empty. ids_crc32 is over the ids as little-endian 32-bit integers, unsigned. A text that holds U+2581 itself comes
    back with a space there, as from the model's own library.
    """
    return _through(documents, model_file, _digest, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean", most, wide)
