"""SimHash near-duplicates by anchor-point covering.

Fingerprint. A bit is set if it is set in over half of the XXH64 values (seed 42, UTF-8) of the text's word shingles,
repeats included; A-Z are lower-cased and words are runs of bytes other than 0x20 and 0x09-0x0D. A text with fewer
words than a shingle has one shingle of all its words; one without words (null, empty) has fingerprint zero, which
links like any other.

Links. Two fingerprints that differ in at most 3 of 64 bits differ in at most 1 bit of one of their 32-bit halves.
The anchors of a half are the words of the code "Hamming(31,26) times one free bit", whose covering radius is 1. A
fingerprint goes to every anchor within radius 1 plus threshold 1 of its half: at most 17 a half. Of two halves at
distance 1 or less, the nearest anchor of the first is within 2 of the second, so the two meet at an anchor and no
link is lost. Anchors compare exactly and give back links that span what they connect, never all pairs: a batch of
anchors joins what it links (union-find over the batch's fingerprints). An anchor of more than ``ANCHOR_ROWS`` fingerprints
is compared in pieces, one for each two blocks of its rows, so no task holds it whole.

Near copies of texts (:func:`near_texts`, five-word shingles, Jaccard similarity of the shingle sets) differ in up to a dozen
bits, more than anchors can cover: two texts at 0.8 differ in 10 bits of 64 on average. So the links of the anchors are
joined by those of another method: 25 band keys of 5 minima of the shingle hashes find candidates (two texts at 0.8 share
one with probability 0.99995), and the exact similarity of the sets decides.

Components of the links come from rounds of joins over stored tables. Exact copies share a fingerprint, so copies
cost one row however many there are. Repeated doc_ids are one document in two rows; null ids are compared last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, join_spread, materialize, small_batches, units

_WEIGHT = 256  # rows of one anchor compared at a time
ANCHOR_ROWS = 65_536
#: Bands of minima: keys a text, minima a key; and the most bytes of shingle sets compared at a time.
BANDS, BAND_ROWS = 25, 5
SET_BYTES = 32_000_000
_MULTIPLY = np.array([[xxhash.xxh32_intdigest(b"multiply", i) | 1] for i in range(BANDS * BAND_ROWS)], np.uint32)
_ADD = np.array([[xxhash.xxh32_intdigest(b"add", i)] for i in range(BANDS * BAND_ROWS)], np.uint32)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 values of all word shingles, repeats included; none for a text without words."""
    words = (text or "").encode().lower().split()
    grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)) if len(words) >= shingle else [b" ".join(words)] if words else []
    seed = xxhash.xxh64_intdigest
    return np.fromiter((seed(g, 42) for g in grams), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the values."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    return majority(shingle_hashes(text, shingle))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a shingle set: band number and hash of ``BAND_ROWS`` minima of the values under fixed mixings."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint32).max, np.uint32)
    half = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(half), 512):
        np.minimum(least, (_MULTIPLY * half[i : i + 512] + _ADD).min(1), out=least)
    least = least.astype(np.uint64)
    rows = least.reshape(BANDS, BAND_ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for c in range(BAND_ROWS):
        key = (key ^ rows[:, c]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id_col`` and ``fp`` (the 64 bits as a signed long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, position of the fingerprint) of every anchor within covering radius plus threshold; uint64 in."""
    out, rows = [], []
    places = np.arange(1, 32, dtype=np.uint32)
    for half in (0, 1):
        word = ((fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        code, free = word & np.uint32(0x7FFFFFFF), word >> np.uint32(31)
        # syndrome: XOR of the places (1 to 31) of the set bits; zero for a code word, else the place of the bit to flip
        bits = (code[:, None] >> (places - np.uint32(1))) & np.uint32(1)
        syndrome = np.bitwise_xor.reduce(bits * places, axis=1)
        flip = np.where(syndrome > 0, np.uint32(1) << (syndrome - np.uint32(1)) % np.uint32(32), np.uint32(0))
        nearest, at = code ^ flip, np.arange(len(fps))

        def add(anchor: np.ndarray, bit: np.ndarray, who: np.ndarray, half: int = half) -> None:
            out.append(anchor.astype(np.uint64) | bit.astype(np.uint64) << np.uint64(31) | np.uint64(half) << np.uint64(32))
            rows.append(who)

        add(nearest, free, at)
        add(nearest, free ^ np.uint32(1), at)
        # code words at distance 2: flip two places whose XOR is the syndrome
        for p in range(1, 32):
            q = syndrome ^ np.uint32(p)
            ok = (syndrome > 0) & (q > p)
            if ok.any():
                add(code[ok] ^ np.uint32(1 << (p - 1)) ^ (np.uint32(1) << (q[ok] - np.uint32(1))), free[ok], at[ok])
    return np.concatenate(out).view(np.int64), np.concatenate(rows)


class _Union:
    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent, path = self.parent, []
        while (p := parent.setdefault(x, x)) != x:
            path.append(x)
            x = p
        for y in path:
            parent[y] = x
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _links(anchor: np.ndarray, fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links at distance ``most`` or less inside each run of equal anchors that connect what is linked there."""
    union, out = _Union(), []
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[starts, len(anchor)])
    shift, longest = 1, int(sizes.max(initial=1))
    unsigned = fps.view(np.uint64)

    def take(a: np.ndarray, b: np.ndarray) -> None:
        for x, y in np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0).tolist() if len(a) else []:
            if x != y and union.join(x, y):
                out.append((x, y))

    small = np.repeat(sizes <= 32, sizes)
    while shift < min(longest, 32):
        near = small[shift:] & (anchor[shift:] == anchor[:-shift]) & (np.bitwise_count(unsigned[shift:] ^ unsigned[:-shift]) <= most)
        at = np.flatnonzero(near)
        take(fps[at], fps[at + shift])
        shift += 1
    for s, n in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
        own = unsigned[s : s + n]
        for i in range(0, n, _WEIGHT):
            block = own[i : i + _WEIGHT]
            near = np.bitwise_count(block[:, None] ^ own[None, i:]) <= most
            near &= np.arange(i, n)[None, :] > np.arange(i, i + len(block))[:, None]
            first = np.where(near.any(0), near.argmax(0), -1)  # one link for each later row that has any
            at = np.flatnonzero(first >= 0)
            take(block[first[at]].view(np.int64), own[i + at].view(np.int64))
            rest = near
            rest[first[at], at] = False  # others may join further parts: only those between different parts count
            a, b = np.nonzero(rest)
            if len(a):
                part = np.fromiter((union.root(x) for x in own[i:].view(np.int64).tolist()), np.int64, n - i)
                differ = part[a] != part[b]
                take(block[a[differ]].view(np.int64), own[i:][b[differ]].view(np.int64))
    return out


def linked(fps: DataFrame, most: int = 3, batch_rows: int = 400_000) -> DataFrame:
    """Links (a, b), a < b, between the distinct values of column ``fp``: enough of them to connect all that are linked."""
    if most != 3:
        raise ValueError("the anchors are chosen for a threshold of 3 bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 20_000):
                own = whole.column(0).slice(i, 20_000).to_numpy(zero_copy_only=False)
                anchor, row = anchors(own.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(own[row])], names=["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, count
            anchor, unit, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            starts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (unit[1:] != unit[:-1])) + 1
            end = len(anchor) if last else int(starts[-1]) if len(starts) else 0  # the last piece may go on
            piece = np.zeros(end, np.int64)
            piece[starts[starts < end]] = 1
            links = _links(np.cumsum(piece), fps[:end], most)
            held, count = [(anchor[end:], unit[end:], fps[end:])], len(anchor) - end
            a, b = zip(*links, strict=True) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            count += batch.num_rows
            if count > batch_rows:
                yield flush(last=False)
        if count:
            yield flush(last=True)

    dealt = units(fps.select("fp").distinct().mapInArrow(spread, "anchor long, fp long"), "anchor", "fp", ANCHOR_ROWS)
    met = dealt.select("anchor", "unit", "fp").repartition("anchor", "unit").sortWithinPartitions("anchor", "unit", "fp")
    return met.mapInArrow(compare, "a long, b long").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node connected with node; only nodes that have links.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest neighbour (large and
    small star). Rounds are joins and aggregates over stored tables; they end when a round changes nothing. A node with very
    many neighbours has one row on the other side of its join, which adaptive execution splits.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        after = materialize(small.distinct(), "edges")
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(edges)
        drop_table(large)
        edges = after
        if tuple(now) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = tuple(now)
    raise RuntimeError(f"components: not settled after {most_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id_col``, ``fp``, ``component_id``: the smallest id that links reach from the row's document."""
    own = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    roots = components(linked(own))
    least = own.groupBy("fp").agg(F.min(id_col).alias("_least"), F.count(F.lit(1)).alias("_rows"))
    grouped = least.join(roots, least["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("_root"), "_least", "_rows")
    grouped = materialize(grouped, "grouped")
    firsts = grouped.groupBy("_root").agg(F.min("_least").alias("component_id"), F.count(F.lit(1)).alias("_prints"))
    named = join_spread(grouped, firsts, "_root", "_prints", grouped.count()).select("fp", "component_id", "_rows")
    return join_spread(own, named, "fp", "_rows", own.count()).select(id_col, "fp", "component_id")


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similar: float = 0.8) -> DataFrame:
    """(``node``, ``component_id``) of each different text, by the smallest id that has it (a null id comes last).

    Texts are linked if their fingerprints differ in at most 3 bits or if their sets of word shingles have Jaccard similarity
    ``similar`` or more, and so on. Texts of equal words in equal case-folded form are one text.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts, prints, keys, counts = [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, shingle)
                texts.append(xxhash.xxh128_digest(b" ".join((text or "").encode().lower().split())))
                prints.append(majority(hashes))
                keys.append(band_keys(hashes).tobytes() if len(hashes) else b"")
                counts.append(len(np.unique(hashes)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], names=["id", "words", "fp", "keys", "n"])

    rows = docs.select(id_col, text_col).mapInArrow(read, f"id {kind}, words binary, fp long, keys binary, n long")
    # one row a text: its smallest id; keys and fingerprint depend on the words alone
    texts = rows.groupBy("words").agg(F.min("id").alias("id"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("n").alias("n"))
    texts = materialize(texts.withColumn("node", F.xxhash64("words")), "texts")

    prints = texts.groupBy("fp").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("m"))
    prints = materialize(prints, "prints")
    same = texts.select("fp", "node").join(prints.where("m > 1").select("fp", F.col("node").alias("first")), "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = linked(prints).join(prints.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    links = materialize(same.union(near).where("a <> b").distinct(), "links")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 5_000):
                part = batch.slice(i, 5_000)
                keys = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), BANDS))), pa.array(keys)], names=["node", "key"])

    members = texts.where("n > 0").select("node", "keys").mapInArrow(split, "node long, key long")
    first = members.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = materialize(members.join(first, "key"), "bands")
    sets = _sets(docs, texts.join(shared.select("node").distinct(), "node").select("id", "node"), id_col, text_col, shingle)
    # first every member of a key against the key's first; then what is still apart in a key of three or more
    pairs = materialize(shared.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    found = materialize(_similar(pairs, sets, similar), "links")
    more = _compared(_unsettled(shared.where("m > 2"), found), sets, similar)
    roots = components(links.union(found).union(more))
    placed = materialize(texts.join(roots, "node", "left").select("id", "words", F.coalesce("root", "node").alias("root")), "placed")
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("m"))
    return join_spread(placed, least, "root", "m", placed.count()).select(F.col("id").alias("node"), "component_id")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(``node``, ``n``, ``grams``): the shingle sets, as sorted arrays, of the texts ``wanted`` by ``id`` and ``node``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 0, 1_000_000):
            texts = batch.column(0).to_pylist()
            words = [xxhash.xxh128_digest(b" ".join((t or "").encode().lower().split())) for t in texts]
            grams = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in texts]
            ends = np.cumsum([0, *map(len, grams)])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(grams)))], names=["words", "n", "grams"])

    ids = wanted.select(F.col("id").alias("_sid")).distinct()
    chosen = docs.select(F.col(id_col).alias("_did"), F.col(text_col).alias("_dtext")).join(ids, F.col("_did").eqNullSafe(F.col("_sid")), "left_semi")
    own = chosen.select("_dtext").mapInArrow(read, "words binary, n long, grams array<long>").withColumn("node", F.xxhash64("words"))
    return materialize(own.join(wanted.select("node"), "node", "left_semi").select("node", "n", "grams").dropDuplicates(["node"]), "sets")


def _similar(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Those pairs (a, b) whose sets have the similarity. A first with very many others is dealt out over copies of its set."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 2_000).cast("int").alias("copies"))
    left = degree.join(sets, degree["a"] == sets["node"]).select("a", F.col("grams").alias("left"), F.col("n").alias("na"), "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    dealt = pairs.join(degree, "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int")).drop("copies")
    right = dealt.join(sets, dealt["b"] == sets["node"]).select("a", "b", "copy", F.col("grams").alias("right"), F.col("n").alias("nb"))
    both = right.join(left, ["a", "copy"]).where((F.least("na", "nb") >= similar * F.greatest("na", "nb")))
    common = F.size(F.array_intersect("left", "right"))
    return both.where(common >= similar * (F.col("na") + F.col("nb") - common)).select("a", "b")


def _unsettled(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the keys in which some are not linked with the key's first. ``part``: the first where they are, else themselves."""
    linked_ = found.select(F.col("a").alias("first"), F.col("b").alias("node"), F.lit(True).alias("with"))
    own = members.join(linked_, ["first", "node"], "left").select("key", "node", F.when(F.col("with"), F.col("first")).otherwise(F.col("node")).alias("part"), "first")
    own = materialize(own, "parts")
    return own.join(own.where("part <> first").select("key").distinct(), "key", "left_semi").select("key", "node", "part")


def _compared(members: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) between members of a key that belong to different components: enough to connect what is similar there.

    Each member comes with the ``part`` it is known to be linked with. Pieces of a key (:func:`~.common.units`) are compared one at a time, sets of like size only.
    """

    def links(part: np.ndarray, node: np.ndarray, grams: list[np.ndarray], out: list[tuple[int, int]]) -> None:
        union = _Union()
        for x, p in zip(node.tolist(), part.tolist(), strict=True):
            union.join(x, p)
        order = sorted(range(len(grams)), key=lambda i: len(grams[i]))
        for i, x in enumerate(order):
            for y in order[i + 1 :]:
                if len(grams[x]) < similar * len(grams[y]):
                    break
                if union.root(int(node[x])) != union.root(int(node[y])):
                    common = len(np.intersect1d(grams[x], grams[y], assume_unique=True))
                    if common >= similar * (len(grams[x]) + len(grams[y]) - common):
                        union.join(int(node[x]), int(node[y]))
                        out.append((int(node[x]), int(node[y])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        out: list[tuple[int, int]] = []

        def done() -> pa.RecordBatch:
            links(np.array([h[0] for h in held]), np.array([h[1] for h in held]), [h[2] for h in held], out)
            a, b = zip(*out, strict=True) if out else ((), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for i, key in enumerate(keys):
                if key != now and held:
                    yield done()
                    held = []
                now = key
                held.append((batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), batch.column(4)[i].values.to_numpy().copy()))
        if held:
            yield done()

    sized = materialize(members.join(sets, "node").select("key", "part", "node", "grams"), "sized")
    dealt = units(sized, "key", "node", SET_BYTES, F.size("grams") * 8 + 200).select("key", "unit", "part", "node", "grams")
    return dealt.repartition("key", "unit").sortWithinPartitions("key", "unit").mapInArrow(run, "a long, b long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each component the one with the smallest id. Columns stay as they are."""
    found = near_texts(docs, id_col, text_col)
    kept = found.where(F.col("node").eqNullSafe(F.col("component_id"))).select(F.col("component_id").alias("_kept")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept"]), "left_semi")
