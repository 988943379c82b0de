"""Personal data: patterns, and terms that reveal what the patterns found (information-theoretic sanitisation).

Base spans are e-mail addresses, IP addresses, card and phone numbers. Each different value is a protected entity. The corpus
tells which terms reveal an entity: over all documents, with occurrences of terms as the unit,

    disclosure(t, c) = PMI(t; c) / IC(c) = log(n(c, t) * N / (n(t) * n(c))) / log(N / n(c))

where N counts all terms of the corpus, n(t) those equal to t, n(c) those in the windows around c's occurrences, and n(c, t)
those equal to t in these windows. It is 1 where t never stands apart from c, 0 where t tells nothing of c. A term that reaches
``generalise_at`` is replaced by its kind, one that reaches ``remove_at`` is removed, in each text that holds c; texts without
personal data stay as they are. A term must have stood beside c in at least ``support`` different windows, so that copies of one
passage are no evidence.

A term is a run of letters (with their marks), lower-cased. The window is the ``window`` terms before and after an
occurrence; those between two neighbours of a kind are shared out between them. Windows of numbers are read
from the text without its addresses, so no part of an address is a term.

Everything is DataFrame functions. Nulls: a null text is empty, a null id stays. Equal rows give equal rows. An empty table gives an
empty one. A text of any length is read whole: patterns take each character once (possessive, entered only where a run begins), and
places add up in blocks. Other columns pass through :func:`sanitise`; columns made on the way get names that the table does not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, fresh, materialize

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Each pattern as stated by the contract; a run is entered at its beginning or where the match before ended, and never given back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_LETTERS = r"\p{L}[\p{L}\p{M}]*+"
#: Up to so many candidate terms are broadcast; more are joined after the corpus has been counted by term.
BROADCAST_TERMS = 200_000
_BLOCK = 4_096


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def share(d: Column, i: Column) -> Column:
        x = d.cast("int") * (1 + i % 2)
        return x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), share), F.lit(0), lambda a, x: a + x) % 10 == 0


#: What a match must meet.
VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: x.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$"),
    "card": lambda x: F.when(F.length(_digits(x)).between(14, 19), _luhn(_digits(x))).otherwise(False),
    "phone": lambda x: F.length(_digits(x)).between(10, 15),
}
#: A text without this character has no match.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}


def _let(x: Column, use) -> Column:
    """``use(x)`` with ``x`` computed once, however often ``use`` names it, also inside lambdas."""
    return F.get(F.transform(F.array(x), use), 0)


def running_sums(sizes: Column) -> Column:
    """Running sums of an array of whole numbers, in blocks of the root of its length."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)

    def blocks(x: Column, width: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / width).cast("int") - 1), lambda b: F.slice(x, b * width + 1, width))

    def inside(cut: Column, sums: Column) -> Column:
        upto = lambda x, s: _let(s, lambda base: F.transform(x, lambda _, j: base + total(F.slice(x, F.lit(1), j + 1))))
        return F.flatten(F.transform(cut, lambda x, b: upto(x, total(F.slice(sums, F.lit(1), b)))))

    whole = lambda x: _let(F.ceil(F.sqrt(F.size(x))).cast("int"), lambda width: _let(blocks(x, width), lambda cut: _let(F.transform(cut, total), lambda sums: inside(cut, sums))))
    return _let(sizes, lambda x: F.when(F.size(x) > 0, whole(x)).otherwise(F.array().cast("array<int>")))


def _ends(text: Column, pattern: Column, hits: Column) -> Column:
    """Where each of the matches ``hits`` of ``pattern`` ends, in code points."""
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    return running_sums(F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.length(h)))


def with_base_spans(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """``docs`` with array ``out`` of (start, kind's number, end) of the base spans, in order. No shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hit, place = {k: fresh(docs, f"_hits_{k}") for k in KINDS}, {k: fresh(docs, f"_ends_{k}") for k in KINDS}
    none = F.array().cast("array<string>")
    found = {hit[k]: F.when(text.contains(_NEEDS[k]) if k in _NEEDS else F.lit(True), F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) for k in KINDS}
    ends = {place[k]: F.when(F.size(hit[k]) > 0, _ends(text, F.lit(PATTERNS[k]), F.col(hit[k]))).otherwise(F.array().cast("array<int>")) for k in KINDS}

    def spans(k: str) -> Column:
        kept = lambda h, e: F.when(VALID[k](h), F.struct((e - F.length(h)).alias("start"), F.lit(KINDS.index(k)).alias("k"), e.alias("end")))
        return F.filter(F.zip_with(hit[k], place[k], kept), lambda s: s.isNotNull())

    return docs.withColumns(found).withColumns(ends).withColumn(out, F.array_sort(F.concat(*[spans(k) for k in KINDS]))).drop(*hit.values(), *place.values())


def _entities(text: Column, kind: str, window: int) -> Column:
    """Array of (entity, terms of its window) of a text's matches of ``kind``."""
    pattern = F.lit(PATTERNS[kind])
    value = F.lower if kind == "email" else (lambda x: x) if kind == "ip" else _digits
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.regexp_extract_all(g, F.lit(_LETTERS), F.lit(0)))
    pairs = F.zip_with(hits, F.sequence(F.lit(0), F.size(hits) - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def entity(p: Column, all_gaps: Column, n: Column) -> Column:
        left, right = F.get(all_gaps, p.i), F.get(all_gaps, p.i + 1)
        before = F.least(F.lit(window), F.when(p.i == 0, F.size(left)).otherwise(F.floor(F.size(left) / 2)).cast("int"))
        after = F.least(F.lit(window), F.when(p.i == n - 1, F.size(right)).otherwise(F.ceil(F.size(right) / 2)).cast("int"))
        terms = F.concat(F.slice(left, F.size(left) - before + 1, before), F.slice(right, F.lit(1), after))
        return F.when(VALID[kind](p.h), F.struct(F.concat(F.lit(kind + ":"), value(p.h)).alias("entity"), F.transform(terms, F.lower).alias("terms")))

    # the gaps are read once: they go into the lambda as an array of one
    made = F.transform(F.array(gaps), lambda g: F.filter(F.transform(pairs, lambda p: entity(p, g, F.size(g) - 1)), lambda e: e.isNotNull()))
    return F.when(F.size(hits) > 0, F.flatten(made)).otherwise(F.array().cast("array<struct<entity:string,terms:array<string>>>"))


def revealing_terms(scan: DataFrame, texts: DataFrame, generalise_at: float, remove_at: float, support: int) -> DataFrame | None:
    """(entity, term, disclosure, action) of the terms that reveal an entity; None if no term has the support.

    ``scan``: stored, column ``entities``; ``texts``: column ``text`` of all documents.
    """
    seen = scan.select(F.explode("entities").alias("e")).select("e.entity", F.xxhash64("e.terms").alias("at"), F.explode("e.terms").alias("term"))
    pairs = seen.groupBy("entity", "term", "at").agg(F.count(F.lit(1)).alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("windows"))
    pairs = materialize(pairs, "pii-pairs")
    candidates = pairs.where(F.col("windows") >= support)
    terms = candidates.select("term").distinct()
    few = terms.limit(BROADCAST_TERMS + 1).count()
    if not few:
        drop_table(pairs)
        return None
    words = texts.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_LETTERS), F.lit(0))).alias("w")).select(F.lower("w").alias("w"))
    if few <= BROADCAST_TERMS:
        # every word is counted, those that are no candidate under null
        counted = words.join(F.broadcast(terms), F.col("w") == F.col("term"), "left").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    else:
        counted = words.groupBy(F.col("w").alias("term")).agg(F.count(F.lit(1)).alias("n_term"))
    counted = materialize(counted, "pii-terms")
    total = counted.agg(F.sum("n_term")).first()[0]
    around = pairs.groupBy("entity").agg(F.sum("n_both").alias("n_entity"))
    n = F.lit(float(total))
    known = F.log(n / F.col("n_entity"))  # what the entity itself tells
    mutual = F.log(F.col("n_both") * n / (F.col("n_term") * F.col("n_entity")))
    scored = candidates.join(around, "entity").join(counted, "term").where("n_entity < {}".format(total)).withColumn("disclosure", F.round(mutual / known, 9))
    flagged = scored.where(F.col("disclosure") >= generalise_at).select("entity", "term", "disclosure", F.when(F.col("disclosure") >= remove_at, "remove").otherwise("generalise").alias("action"))
    flagged = materialize(flagged, "pii-flagged")
    drop_table(pairs)
    drop_table(counted)
    return flagged


def _term_places(rows: DataFrame) -> DataFrame:
    """(row, entity names, term, start, end) of every term of ``rows`` outside of addresses."""
    mail, letters = F.lit(PATTERNS["email"]), F.lit(_LETTERS)
    hits = rows.withColumn("_h", F.regexp_extract_all("text", mail, F.lit(0))).withColumn("_e", _ends(F.col("text"), mail, F.col("_h")))
    gaps = hits.select("row", "names", F.posexplode(F.split("text", mail, -1)).alias("i", "gap"), "_e")
    gaps = gaps.withColumn("at", F.when(F.col("i") == 0, 0).otherwise(F.get("_e", F.col("i") - 1))).withColumn("_w", F.regexp_extract_all("gap", letters, F.lit(0)))
    ends = gaps.select("row", "names", "at", "_w", _ends(F.col("gap"), letters, F.col("_w")).alias("_z"))
    flat = ends.select("row", "names", "at", F.explode(F.arrays_zip("_w", "_z")).alias("x"))
    return flat.select("row", "names", F.lower("x._w").alias("term"), (F.col("at") + F.col("x._z") - F.length("x._w")).alias("start"), (F.col("at") + F.col("x._z")).alias("end"))


def find(docs: DataFrame, text_col: str = "text", window: int = 8, support: int = 3, generalise_at: float = 0.9, remove_at: float = 0.97, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all, if None) of ``docs`` and ``pii``: array of (start, k, end, action), in order.

    ``k`` is the place in ``KINDS``, or 4 for a term; ``action``: mask, generalise or remove. A row that has personal data keeps its
    text in a stored table until the terms are known; other rows leave theirs behind.
    """
    keep = docs.columns if keep is None else keep
    own = {c: f"_own{i}" for i, c in enumerate(keep) if c != text_col}
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = with_base_spans(docs.select(text.alias("text"), *[F.col(c).alias(n) for c, n in own.items()]), "text", "base")
    base = base.withColumn("_bare", F.when(F.exists("base", lambda s: s.k == 0), F.regexp_replace("text", PATTERNS["email"], "@")).otherwise(F.col("text")))
    has = lambda k: F.exists("base", lambda s: s.k == KINDS.index(k))
    no_one = F.array().cast("array<struct<entity:string,terms:array<string>>>")
    entities = F.concat(*[F.when(has(k), _entities(F.col("text" if k == "email" else "_bare"), k, window)).otherwise(no_one) for k in KINDS])
    scan = base.select(*own.values(), "base", entities.alias("entities"), F.when(F.size("base") > 0, F.col("text")).alias("text"), F.monotonically_increasing_id().alias("row"))
    scan = materialize(scan, "pii-scan")  # the row numbers are fixed from here on

    flagged = revealing_terms(scan, docs.select(F.col(text_col).alias("text")), generalise_at, remove_at, support)
    mask = F.transform("base", lambda s: F.struct(s.start.alias("start"), s.k.alias("k"), s.end.alias("end"), F.lit("mask").alias("action")))
    if flagged is None:
        return scan.select(*[F.col(n).alias(c) for c, n in own.items()], mask.alias("pii"), *([F.col("text").alias(text_col)] if text_col in keep else []))

    concerned = flagged.select("entity").distinct()
    rows = scan.where(F.col("text").isNotNull()).select("row", "text", F.array_distinct(F.col("entities.entity")).alias("names"))
    near = rows.select("row", F.explode("names").alias("entity")).join(concerned, "entity", "left_semi").select("row").distinct()
    places = _term_places(rows.join(near, "row", "left_semi"))
    marks = places.join(flagged, "term").where(F.array_contains("names", F.col("entity")))
    marks = marks.groupBy("row", "start", "end").agg(F.max("action").alias("action"))  # remove is greater than generalise
    marks = marks.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("k"), "end", "action")).alias("terms"))
    joined = scan.join(marks, "row", "left")
    spans = F.array_sort(F.when(F.col("terms").isNull(), mask).otherwise(F.concat(mask, "terms")))
    return joined.select(*[F.col(n).alias(c) for c, n in own.items()], spans.alias("pii"), *([F.col("text").alias(text_col)] if text_col in keep else []))


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.k), s.start.cast("string"), s.end.cast("string"))))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of what :func:`find` found, one row a document."""
    of = lambda k: F.size(F.filter("pii", lambda s: s.k == KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = _named(F.filter("pii", lambda s: s.k < len(KINDS)))
    terms = F.size(F.filter("pii", lambda s: s.k == len(KINDS))).cast("long").alias("n_term")
    return found.select(id_col, *[of(k) for k in KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"), _named(F.col("pii")).alias("spans"), terms)


def sanitise(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` with personal data masked (``[EMAIL]`` and so on), revealing terms replaced by ``[NAME]`` (an upper-case
    initial) or ``[WORD]``, or removed. Columns, nulls and rows stay. Where spans overlap, the one that begins first stands."""
    kept = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = find(kept, "_text", **how)
    # rows without personal data left their text behind; it is their own column still
    own = f"_c{docs.columns.index(text_col)}"
    blocks = F.regexp_extract_all(F.col("_text"), F.lit(rf"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    ready = found.withColumn("_blocks", F.when(F.size("pii") > 0, blocks))

    def piece(start: Column, end: Column) -> Column:
        first = F.floor(start / _BLOCK).cast("int")
        last = F.floor(F.greatest(start, end - 1) / _BLOCK).cast("int")
        return F.substring(F.array_join(F.slice("_blocks", first + 1, last - first + 1), ""), start - first * _BLOCK + 1, end - start)

    def said(s: Column) -> Column:
        word = piece(s.start, s.end)
        masks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
        general = F.when(word.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
        return F.when(s.action == "mask", F.get(masks, s.k)).when(s.action == "generalise", general).otherwise("")

    def step(a: Column, s: Column) -> Column:
        done = F.struct(s.end.alias("at"), F.concat(a.out, F.array(F.when(s.start > a.at, piece(a.at, s.start)).otherwise(""), said(s))).alias("out"))
        return F.when(s.start < a.at, F.struct(F.greatest(a.at, s.end).alias("at"), a.out.alias("out"))).otherwise(done)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.length("_text")
    built = F.aggregate("pii", start, step, lambda a: F.concat(F.array_join(a.out, ""), F.when(whole > a.at, piece(a.at, whole)).otherwise("")))
    new = F.when(F.size("pii") > 0, built).otherwise(F.col(own))
    # named at the very end: in one select, a name inside a lambda could mean the new column
    return ready.select(*[new.alias("_new") if c == text_col else f"_c{i}" for i, c in enumerate(docs.columns)]).toDF(*docs.columns)
