"""Token files: Simple-8b word-aligned coding of token ids.

A 64-bit word holds a selector in its top 4 bits and 60 bits of payload. Selectors 1 to 14 pack n ids of b bits
(``SELECTORS``), the first id lowest; the packer takes, at each id, the selector that holds most. Selector 0 is an
escape: its payload is a place in the block's list of raw 64-bit values. A block holds whole documents; its ids are
coded in chunks of ``CHUNK`` ids, and the word offset of every chunk is stored, so that chunks decode on their own, all
words of a selector at once.

A file is a Parquet table of blocks (``part``, ``block``, ``doc_ids``, ``doc_sizes``, ``n_ids``, ``offsets``, ``words``,
``escapes``): Spark's committed writes survive lost tasks and reach any store. Documents are in ascending id order
over parts and blocks. Ids come from the tokenizers library, run once for each distinct piece of a batch.

Null texts count as empty: a document of the end id alone. Rows with equal ids follow each other; null ids come first.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table_path

#: (ids a word, bits an id) of selectors 1 to 14.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
CHUNK = 65_536
#: Bytes of distinct pieces and their ids that a worker keeps between batches; all go when the task ends.
KEPT_BYTES = 24_000_000


_WIDTH16 = np.array([x.bit_length() for x in range(1 << 16)], np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bit length of each id, one byte each."""
    if not len(ids) or int(ids.max()) < 1 << 16:
        return _WIDTH16[ids.astype(np.uint16)]
    out = np.zeros(len(ids), np.uint8)
    for shift in (48, 32, 16, 0):
        part = (ids >> np.uint64(shift) & np.uint64(0xFFFF)).astype(np.uint16)
        out = np.where((out == 0) & (part > 0), _WIDTH16[part] + np.uint8(shift), out)
    return out


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escaped values) of one chunk of unsigned ids."""
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    width = _widths(ids)
    take, place = np.ones(n, np.uint8), np.zeros(n, np.uint8)
    for s in range(len(SELECTORS), 0, -1):  # from few wide ids to many narrow ones: the last that fits stays
        count, bits = SELECTORS[s - 1]
        wide = width > bits
        passed = np.zeros(n + count, np.int32)  # wide ids before each place; places after the end are narrow
        np.cumsum(wide, out=passed[1 : n + 1])
        passed[n + 1 :] = passed[n]
        fits = passed[count:] == passed[:n]
        if not fits.any():
            break
        np.copyto(take, count, where=fits)
        np.copyto(place, s, where=fits)
    step, starts, i = take.tolist(), [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    start = np.array(starts)
    chosen = place[start]
    words = np.zeros(len(start), np.uint64)
    padded = np.concatenate([ids.astype(np.uint64), np.zeros(60, np.uint64)])
    for s in np.unique(chosen).tolist():
        at = np.flatnonzero(chosen == s)
        if s == 0:
            words[at] = np.arange(len(at), dtype=np.uint64)
            continue
        count, bits = SELECTORS[s - 1]
        word, first = np.full(len(at), s << 60, np.uint64), start[at]
        for k in range(count):
            word |= padded[first + k] << np.uint64(bits * k)
        words[at] = word
    return words, padded[start[chosen == 0]]


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n ids of one chunk."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([1, *[c for c, _ in SELECTORS]], np.int64)[chosen]
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()) + 1, np.uint64)
    for s, (count, bits) in enumerate(SELECTORS, 1):
        own = np.flatnonzero(chosen == s)
        if len(own):
            payload, mask = words[own], np.uint64((1 << bits) - 1)
            for k in range(count):
                out[at[own] + k] = payload >> np.uint64(bits * k) & mask
    raw = np.flatnonzero(chosen == 0)
    out[at[raw]] = escapes[words[raw].astype(np.int64)]
    return out[:n]


def pack_block(ids: np.ndarray) -> tuple[list[int], bytes, bytes]:
    """(word offset of each chunk, words, escapes with a count before each chunk's) of a block."""
    offsets, words, escapes, at = [], [], [], 0
    for i in range(0, len(ids), CHUNK):
        w, e = pack(ids[i : i + CHUNK])
        offsets.append(at)
        at += len(w)
        words.append(w)
        escapes += [np.array([len(e)], np.uint64), e]
    joined = lambda x: np.concatenate([np.empty(0, np.uint64), *x]).astype("<u8").tobytes()
    return offsets, joined(words), joined(escapes)


def unpack_block(offsets: list[int], words: bytes, escapes: bytes, n: int) -> np.ndarray:
    w, e = np.frombuffer(words, "<u8"), np.frombuffer(escapes, "<u8")
    out, at = [np.empty(0, np.uint64)], 0
    if not offsets:
        return out[0]
    for i, (a, b) in enumerate(zip(offsets, [*offsets[1:], len(w)], strict=True)):
        k = int(e[at])
        out.append(unpack(w[a:b], e[at + 1 : at + 1 + k], min(CHUNK, n - i * CHUNK)))
        at += 1 + k
    return np.concatenate(out)


#: White space of which a text may hold more than single spaces between words and single line feeds before them.
_HARD = r"  | \n|\n |\n\n\n|\n\n\z|[\t\r\v\f\x00-\x08\x0e-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\A | \z"


_MARKS = ".,!?;:|*#$%&"
_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array that starts at its buffers' start."""
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int32)[: len(strings) + 1].astype(np.int64) if len(strings) else np.zeros(1, np.int64)
    return ends, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def _spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of runs laid one after the other: n[i] from starts[i] on."""
    ends = np.cumsum(n, dtype=np.int32)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(starts.astype(np.int32) - ends + n.astype(np.int32), n)


class ByteEncoder:
    """Ids of a byte-level BPE file. Distinct pieces are encoded by the library and gathered for all texts at once.

    The file's split keeps white space at the front of what follows it, so " word", "\\nword" and a first word can be
    encoded apart; texts with other white space, or with special tokens, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.hard = "|".join([_HARD, *[re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]])
        vocab = self.library.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)  # ids of tokens that start with a space or a line feed
        self.opens[[i for t, i in vocab.items() if t[0] in "\u0120\u010a"]] = True
        self.forget()

    def forget(self) -> None:
        self.keys = pa.array([], pa.string())
        self.flat, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def known(self, units: pa.Array) -> np.ndarray:
        """Place of each distinct piece among those encoded so far; new ones are encoded first."""
        place = pc.index_in(units, value_set=self.keys)
        missing = place.is_null().to_numpy(zero_copy_only=False)
        out = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if missing.any():
            new = units.filter(pa.array(missing))
            flat, (starts, sizes) = self.pieces(new)
            out[missing] = len(self.keys) + np.arange(len(new))
            self.starts = np.concatenate([self.starts, starts + len(self.flat)])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, flat])
            self.keys = pa.concat_arrays([self.keys, new])
        return out

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, and where each one's start. White space opens a piece and stands nowhere else in it,
        so many are encoded as one text and told apart by the tokens that open."""
        plain = pc.match_substring_regex(units, "^[ \n]").to_numpy(zero_copy_only=False)
        ids, starts = [np.empty(0, np.uint32)], np.zeros(len(units), np.int64)
        order, at = [], 0
        rows = np.flatnonzero(plain)
        groups = [rows[i : i + 5000] for i in range(0, len(rows), 5000)]
        joined = ["".join(units.take(pa.array(g)).to_pylist()) for g in groups]
        for g, own in zip(groups, self.whole(joined), strict=True):
            firsts = np.flatnonzero(self.opens[own])
            if len(firsts) != len(g):
                raise ValueError("pieces and their tokens do not agree")
            starts[g] = firsts + at
            at += len(own)
            ids.append(own)
            order.append(g)
        rows = np.flatnonzero(~plain)
        for r, own in zip(rows.tolist(), self.whole(units.take(pa.array(rows)).to_pylist()), strict=True):
            starts[r] = at
            at += len(own)
            ids.append(own)
        # lay the pieces out in their own order
        flat = np.concatenate(ids)
        order = np.concatenate([np.empty(0, np.int64), *order, rows]).astype(np.int64)
        sizes = np.zeros(len(units), np.int64)
        sizes[order] = np.diff(np.append(starts[order], at))
        return flat, np.stack([starts, sizes])

    def table(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct units of a batch, with each unit's start and size. Marks after a letter or number are a
        piece of their own in the file's split, so they are taken off and words kept without them."""
        bare = pc.utf8_rtrim(units, characters=_MARKS)
        (ends, data), (bare_ends, bare_data) = _bytes_of(units), _bytes_of(bare)
        size, bare_size = np.diff(ends), np.diff(bare_ends)
        last = bare_data[np.maximum(bare_ends[1:] - 1, 0)] if len(bare_data) else np.zeros(len(units), np.uint8)
        lead = bare_data[np.maximum(bare_ends[1:] - 2, 0)] if len(bare_data) else last
        letter = _ALNUM[last] | ((lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))
        two = (size > bare_size) & (bare_size > 1) & letter
        stems = pc.if_else(pa.array(two), bare, units).dictionary_encode()
        n = (size - bare_size)[two]
        cut = np.concatenate([[0], np.cumsum(n)])
        own = data[np.arange(cut[-1]) + np.repeat((ends[:-1] + bare_size)[two] - cut[:-1], n)]
        marks = pa.StringArray.from_buffers(len(n), pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(own)).dictionary_encode()
        first = np.arange(len(units)) + np.cumsum(two) - two
        order = np.empty(len(units) + int(two.sum()), np.int64)
        place = self.known(pa.concat_arrays([stems.dictionary, marks.dictionary]))
        order[first] = place[stems.indices.to_numpy(zero_copy_only=False)]
        order[first[two] + 1] = place[len(stems.dictionary) + marks.indices.to_numpy(zero_copy_only=False)]
        n = self.sizes[order]
        ends = np.cumsum(n)
        flat = self.flat[_spread(self.starts[order], n)]
        starts, sizes = (ends - n)[first], n[first]
        sizes[two] += n[first[two] + 1]
        return flat, starts, sizes

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's ids end, with 0 before."""
        if self.keys.nbytes + self.flat.nbytes + self.starts.nbytes + self.sizes.nbytes > KEPT_BYTES:
            self.forget()
        column = pa.concat_arrays([pc.fill_null(column, ""), pa.array([], column.type)])  # a copy of its own: if_else mistakes slices
        hard = pc.match_substring_regex(column, self.hard)
        easy = pc.if_else(hard, "", column)
        # a space before all but the first word, line feeds as part of the word after them
        lists = pc.split_pattern(pc.replace_substring(easy, "\n", " \n"), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        words = lists.flatten().dictionary_encode()
        index = words.indices.to_numpy(zero_copy_only=False)
        # two forms of each distinct word: after a space, and (first in a text, or after a line feed) as it stands
        distinct = words.dictionary
        lined = pc.starts_with(distinct, "\n").to_numpy(zero_copy_only=False)
        first = np.zeros(len(index), bool)
        first[offsets[:-1]] = True
        bare = first & ~lined[index]
        opening = np.unique(index[bare])
        spaced = pc.if_else(pa.array(lined), distinct, pc.binary_join_element_wise("", distinct, " "))
        spaced_used = np.zeros(len(distinct), bool)
        spaced_used[index[~bare]] = True
        used = np.flatnonzero(spaced_used)
        both = pa.concat_arrays([spaced.take(pa.array(used)), distinct.take(pa.array(opening))])
        table, starts, sizes = self.table(both)
        form = np.zeros(2 * len(distinct), np.int64)
        form[np.concatenate([used, len(distinct) + opening])] = np.arange(len(both))
        piece = form[index + bare * len(distinct)]
        n = sizes[piece]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = table[_spread(starts[piece], n)]
        cuts = ends[offsets]
        places = np.flatnonzero(hard.to_numpy(zero_copy_only=False))
        if not len(places):
            return ids, cuts
        each = np.split(ids, cuts[1:-1])
        for p, own in zip(places.tolist(), self.whole([column[p].as_py() for p in places.tolist()]), strict=True):
            each[p] = own
        return np.concatenate(each), np.cumsum([0, *map(len, each)])


_ENCODERS: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


_BLOCK = "part int, block int, doc_ids array<{0}>, doc_sizes array<long>, n_ids long, offsets array<int>, words binary, escapes binary"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write blocks in ascending id order.

    Texts are ranged by id (one shuffle), then encoded and packed where they are sorted.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    ordered = docs.select(id_col, text_col).repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        try:
            for block, batch in enumerate(small_batches(batches)):
                ids, ends = enc.encode_column(batch.column(1))
                whole = np.insert(ids, ends[1:], np.uint32(end_id))
                offsets, words, escapes = pack_block(whole)
                row = [[part], [block], [batch.column(0).to_pylist()], [(np.diff(ends) + 1).tolist()], [len(whole)], [offsets], [words], [escapes]]
                types = [pa.int32(), pa.int32(), pa.list_(batch.schema.field(0).type), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=["part", "block", "doc_ids", "doc_sizes", "n_ids", "offsets", "words", "escapes"])
        finally:  # a worker outlives its task
            enc.forget()
            pa.default_memory_pool().release_unused()

    ordered.mapInArrow(run, _BLOCK.format(kind)).write.parquet(path)


def read_tokens(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row a document: id, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    Parts are few (one a task of the writer): their totals give each its first number on the driver; blocks of a part
    are numbered by a window over the block heads, without the words.
    """
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts, at = [], 0
    for r in totals:
        starts.append((r["part"], at))
        at += r["n"]
    first = F.broadcast(spark.createDataFrame(starts, "part int, part_start long"))
    heads = blocks.select("part", "block", "n_ids").join(first, "part")
    from pyspark.sql.window import Window

    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.select(F.col("part").alias("_p"), F.col("block").alias("_b"), (F.col("part_start") + F.coalesce(before, F.lit(0))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack_block(r["offsets"], r["words"], r["escapes"], r["n_ids"]).astype("<u4")
                sizes = np.array(r["doc_sizes"], np.int64)
                ends = np.cumsum(sizes)
                crcs = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                n = len(sizes)
                columns = [pa.array([r["part"]] * n, pa.int32()), pa.array([r["block"]] * n, pa.int32()), pa.array(r["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array(ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "block", id_col, "at", "n_tokens", "ids_crc32"])

    documents = blocks.mapInArrow(run, f"part int, block int, `{id_col}` {kind}, at long, n_tokens long, ids_crc32 long")
    joined = documents.join(heads, (documents["part"] == heads["_p"]) & (documents["block"] == heads["_b"]))
    return joined.select(id_col, (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row a document: id and ``ids`` (array of long), read from the files."""
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack_block(r["offsets"], r["words"], r["escapes"], r["n_ids"]).astype(np.int64)
                ends = np.cumsum([0, *r["doc_sizes"]])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], batch.schema.field("doc_ids").type.value_type), lists], names=[id_col, "ids"])

    return blocks.mapInArrow(run, f"`{id_col}` {kind}, ids array<long>")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files to the shared folder and read them back."""
    spark = docs.sparkSession
    write_tokens(docs, path := table_path(spark, "tokens"), vocabulary, 2, id_col, text_col)
    return read_tokens(spark, path, id_col)
