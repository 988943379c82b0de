"""BPE encoding and decoding by a prefix-sharing trie.

A BPE encoding of a string ends, for every prefix of it, in one token that depends on the prefix alone; the rest
of the encoding is that of the prefix without this token. So the distinct words of a batch go into a trie over
their symbols, a depth-first walk computes each node's last token from those of its ancestors, and prefixes that
words share are encoded once. A word's ids are read by following last tokens from its end node upwards.

The last token of a node is the one vocabulary entry ``t`` that spells the end of its path, is itself encoded as
``[t]``, and forms with the last token of the node before it a pair that BPE leaves as it is.

Text is split as the tokenizer file says (NFC, white space, lower case, then the word pattern); chunks with
characters above U+024F, or with control characters, are split by the library's own normalizer and pre-tokenizer,
the rest by the same pattern here.

Memory is bounded by bytes: texts are encoded a portion of about ``PORTION`` bytes at a time (cut at white space), words
and chunks met are kept up to about ``KEPT_BYTES`` (those met lately outlive the others) and dropped when a task ends, pair
tests up to ``MAX_PAIRS``. A word of more
than ``LONG`` symbols is walked alone, with its last tokens held only as far back as later ones can reach, and not kept.

Null or empty texts give no ids and decode to an empty text. Rows repeat as they come.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches

PORTION = 2_000_000
KEPT_BYTES = 80_000_000
MAX_PAIRS = 200_000
LONG = 16_384
_SAFE_TOP = 0x250
_LETTERS = "".join(chr(c) for c in range(_SAFE_TOP) if unicodedata.category(chr(c))[0] == "L")
_NUMBERS = "".join(chr(c) for c in range(_SAFE_TOP) if unicodedata.category(chr(c))[0] == "N")
#: Contractions, letter runs, single numbers, runs of anything else: the split of the tokenizer file.
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
#: The same with the line feeds that end chunks.
_WORDS = re.compile(f"{_WORD.pattern}|\n")
_GAP = re.compile("[ \t\n\v\f\r]")
_UNSAFE = re.compile("[^\t\n\r\x20-\x7e\xa0-ɏ]")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return out


class TrieEncoder:
    """Encodes and decodes with the vocabulary and merges of a ``tokenizers`` BPE file with an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.pieces = {i: s for s, i in self.vocab.items()}
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pieces |= {i: s for s, i in self.special.items()}
        self.split_special = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True))) if self.special else None
        self.symbol = byte_symbols()
        self.byte = {c: b for b, c in enumerate(self.symbol)}
        self.longest = max(len(s.removesuffix(self.end)) for s in self.vocab)
        self.names = pa.array([self.pieces.get(i, "") for i in range(max(self.pieces) + 1)], pa.string())
        self.forget_pairs()
        self.alone: dict[str, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, bytes] = {}  # packed ids of a word in normal form
        self.chunks: dict[str, bytes] = {}  # the same of a run without white space
        self.kept = 0  # bytes held by both, about
        self.older_words: dict[str, bytes] = {}
        self.older_chunks: dict[str, bytes] = {}

    def age(self) -> None:
        """Words and chunks become the older ones; those not met since the last time are let go."""
        words, chunks = self.words, self.chunks
        self.forget()
        self.older_words, self.older_chunks = words, chunks

    def forget_pairs(self) -> None:
        #: A last token is (id, size, the last tokens that may follow it by their spelling, None for those that may not).
        self.root: tuple = (None, 0, {})
        self.last_tokens: dict[str, tuple] = {}
        self.pairs = 0

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a short symbol list, for the pair tests."""
        rank, symbols = self.rank.get, list(symbols)
        while True:
            best, at = 1 << 60, -1
            for i in range(len(symbols) - 1):
                r = rank((symbols[i], symbols[i + 1]))
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token.removesuffix(self.end)
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def is_token(self, token: str) -> bool:
        if token not in self.vocab:
            return False
        if (known := self.alone.get(token)) is None:
            known = self.alone[token] = self.merged(self.symbols(token)) == [token]
        return known

    def is_pair(self, left: str, right: str) -> bool:
        return self.merged(self.symbols(left) + self.symbols(right)) == [left, right]

    def follows(self, left: tuple, token: str) -> tuple | None:
        """``token`` as a last token after ``left``, or None if it may not follow."""
        after = left[2]
        if token in after:
            return after[token]
        found = None
        if self.is_token(token) and (left is self.root or self.is_pair(self.pieces[left[0]], token)):
            found = self.last_tokens.get(token)
            if found is None:
                found = self.last_tokens[token] = (self.vocab[token], len(token.removesuffix(self.end)) if self.end else len(token), {})
        after[token] = found
        self.pairs += 1
        return found

    def search(self, word: str, d: int, end: str, last: list[tuple], base: int = 0) -> tuple:
        """The last token of the path ``word[:d]``; ``last[b - base]`` is that at depth b."""
        for before in range(max(base, d - self.longest), d):
            token = word[before:d] + end
            if token in self.vocab and (this := self.follows(last[before - base], token)):
                return this
        raise ValueError(f"no token ends {word[max(0, d - 40) : d]!r}")

    def grow(self, words: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of distinct words (byte symbols, without end mark).

        In sorted order the words are a depth-first walk of their trie: the last tokens of the current path's nodes are
        kept from the root down, a word leaves those it shares with the one before, and only new nodes get one.
        """
        end, packed, search = self.end, {}, self.search
        last, path = [self.root], ""
        for word in sorted(words):
            if len(word) > LONG:
                packed[word] = self.walk(word)
                continue
            if self.pairs > MAX_PAIRS:
                self.forget_pairs()
                last, path = [self.root], ""
            depth, stop = 0, len(word)
            full = stop - 1 if end else stop
            for x, y in zip(path, word[:full], strict=False):
                if x != y:
                    break
                depth += 1
            del last[depth + 1 :]
            path, this = word[:full], last[depth]
            for d in range(depth + 1, full + 1):
                # the last token most often grows by the symbol, or the symbol stands alone; else any start may be right
                start = d - 1 - this[1]
                this = last[start][2].get(word[start:d]) or this[2].get(word[d - 1]) or search(word, d, "", last)
                last.append(this)
            if end:
                start = full - this[1]
                this = last[start][2].get(word[start:] + end) or search(word, stop, end, last)
            ids, d = [], stop
            while d:
                ids.append(this[0])
                d -= this[1]
                this = last[d]
            ids.reverse()
            packed[word] = array("I", ids).tobytes()
        return packed

    def walk(self, word: str) -> bytes:
        """Packed ids of one long word. Whenever ``LONG`` symbols are held, all last tokens that a later one can still build on
        are followed back to where they meet; what lies before that place is settled and let go."""
        out, base, last, held = array("I"), 0, [self.root], LONG
        full = len(word) - 1 if self.end else len(word)

        def settle(d: int) -> None:
            ids = []
            while d > base:
                ids.append(last[d - base][0])
                d -= last[d - base][1]
            out.extend(reversed(ids))

        for d in range(1, len(word) + 1):
            last.append(self.search(word, d, self.end if d > full else "", last, base))
            if d - base > held:
                open_ = set(range(max(base, d - self.longest), d + 1))
                while len(open_) > 1:
                    top = max(open_)
                    open_.remove(top)
                    open_.add(top - last[top - base][1])
                settle(meet := open_.pop())
                del last[: meet - base]
                base = meet
                held = d - base + LONG
        settle(len(word))
        return out.tobytes()

    def learn(self, chunks: set[str]) -> None:
        """Encode white-space-free chunks not met before. Normal form, lower case and split look at no more than a chunk.

        Chunks of safe characters are split in one pass over all of them, each ended by a line feed; the others one by one.
        """
        safe = list(chunks)
        if _UNSAFE.search(low := "\n".join([*safe, ""]).lower()) or not low.isascii() and _UNSAFE.search("\n".join(safe)):
            safe = [c for c in safe if not (_UNSAFE.search(c) or _UNSAFE.search(c.lower()))]
            low = "\n".join([*safe, ""]).lower()
        words = _WORDS.findall(low)
        rest = chunks.difference(safe)
        for c in rest:
            words += [*self.library_words(c), "\n"]
        new = set(words).difference(self.words, "\n")
        again = {w: self.older_words[w] for w in new if w in self.older_words}
        keys = {self.key(w): w for w in new if w not in again}
        again |= {keys[k]: ids for k, ids in self.grow(keys).items()}
        self.words |= again
        packed = [b"" if w == "\n" else self.words[w] for w in words]
        ends = np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)))
        ends = ends[np.fromiter((w == "\n" for w in words), bool, len(words))].tolist()
        flat = b"".join(packed)
        self.chunks |= zip([*safe, *rest], [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True)
        self.kept += sum(map(len, again)) + sum(map(len, again.values())) + 250 * len(again)
        self.kept += 2 * sum(map(len, chunks)) + len(flat) + 250 * len(chunks)

    def library_words(self, chunk: str) -> list[str]:
        """The normal form of a chunk, split by the library, whose byte symbols are turned back into characters."""
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        return [bytes(map(self.byte.__getitem__, p)).decode() for p, _ in found]

    def key(self, word: str) -> str:
        """A word's byte symbols."""
        if word.isascii() and word.isprintable() and " " not in word:
            return word
        return "".join(map(self.symbol.__getitem__, word.encode()))

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column, one after the other, and where each text's ids end, with 0 before.

        Texts are encoded as pieces between special tokens and of at most about ``PORTION`` bytes, and put together again.
        """
        column = pc.fill_null(column, "")
        size = pc.max(pc.binary_length(column)).as_py() or 0
        if size <= PORTION and not (self.special and pc.any(pc.match_substring_regex(column, self.split_special.pattern)).as_py()):
            return self.encode_portion(column)
        ids, ends = [np.empty(0, np.uint32)], [0]
        for text in column.to_pylist():
            n = 0
            for piece in self.pieces_of(text):
                own = self.encode_portion(pa.array([piece], pa.string()))[0] if isinstance(piece, str) else np.array([piece], np.uint32)
                ids.append(own)
                n += len(own)
            ends.append(ends[-1] + n)
        return np.concatenate(ids), np.array(ends)

    def encode_portion(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The new words of the column go into one trie; ids are then gathered for all white-space-free chunks at once."""
        if 2 * self.kept > KEPT_BYTES:
            self.age()
        lists = pc.ascii_split_whitespace(column)
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = set(distinct).difference(self.chunks)
        again = {c: self.older_chunks[c] for c in new if c in self.older_chunks}
        self.chunks |= again
        self.kept += 2 * sum(map(len, again)) + sum(map(len, again.values())) + 250 * len(again)
        self.learn(new.difference(again))
        packed = list(map(self.chunks.__getitem__, distinct))
        flat = np.frombuffer(b"".join(packed), np.uint32)
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        starts = np.cumsum(sizes) - sizes
        index = coded.indices.to_numpy(zero_copy_only=False)
        n = sizes[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(ends[-1]) + np.repeat(starts[index] - ends[:-1], n)]
        cuts = lists.offsets.to_numpy()
        return ids, ends[cuts - cuts[0]]

    def pieces_of(self, text: str) -> Iterator[str | int]:
        """A text cut at special tokens, which stand as their ids, and at white space where a piece passes ``PORTION``."""
        at = 0
        for m in [*(self.split_special.finditer(text) if self.special else ()), None]:
            stop = m.start() if m else len(text)
            while stop - at > PORTION and (gap := _GAP.search(text, at + PORTION, stop)):
                yield text[at : gap.start()]
                at = gap.start()
            yield text[at:stop]
            if m:
                yield self.special[m.group()]
                at = m.end()

    def encode(self, text: str | None) -> list[int]:
        return self.encode_column(pa.array([text], pa.string()))[0].tolist()

    def decode_column(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of ids laid one after the other. The tokenizer file names no decoder: tokens are joined by single spaces,
        special tokens kept."""
        pieces = self.names.take(pa.array(ids.view(np.int32)))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces), " ")

    def decode(self, ids: list[int]) -> str:
        return self.decode_column(np.array(ids, np.uint32), np.array([0, len(ids)]))[0].as_py()


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """One encoder for each vocabulary in a Python worker; its vocabulary is kept between tasks, what it has learnt is not."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode and decode every whole text.

    Returns the id column, ``n_tokens``, ``ids`` (array of int, unless ``keep_ids`` is false), ``ids_sha256`` and
    ``decoded_sha256``. No shuffle: each task reads its split in batches and holds one bounded trie.
    """
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        try:
            for batch in small_batches(batches, most_bytes=PORTION):
                ids, ends = enc.encode_column(batch.column(1))
                each = np.split(ids, ends[1:-1])
                columns = [batch.column(0), pa.array(np.diff(ends), pa.int64())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32))))
                columns.append(pa.array([hashlib.sha256(x.astype("<u4", copy=False)).hexdigest() for x in each]))
                texts = enc.decode_column(ids, ends).cast(pa.binary())
                columns.append(pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts]))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
        finally:  # a worker outlives its task: what the task has learnt goes with it
            enc.forget()
            pa.default_memory_pool().release_unused()

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))
