"""Personal data, vector codes and repair of conversations: against brute force, and against their SQL on tables of odd rows."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from oddsloom.llm import pii, queries, turn_repair, vector_codes

WHITE = " \t\n\x0b\x0c\r"


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def from_sql(name, table, path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)


def through_query(spark, tmp_path, name, table, df):
    """The registered query over ``df``, and its SQL over the same file."""
    df.write.parquet(str(tmp_path / f"{table}.parquet"))
    return rows_of(queries.queries()[name](spark, str(tmp_path))), from_sql(name, table, tmp_path / f"{table}.parquet")


# personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, rule in BASE.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum((x := int(c) * (1 + i % 2)) - 9 * (x > 9) for i, c in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), list(BASE).index(kind), m.end()))
    return sorted(out)


ODD = [
    "a@b@c.d", "a@b.c_x@d.e", "été.bob@x.com", "Éabc@x.com 1.2.3.4.5.6.7.8", "1.2.3.256 000.1.2.3 1.2.3.0000255", "4465758382889437 4465758382889437", "4465-7583 8288-9437", "+1 (663) 555-6869 +1 (663) 555-686",
    "x" * 60_000, "1" * 60_000, ".a" * 20_000 + "@b" + ".c" * 20_000, "1.1.1.1 " * 2_000, "😀😀 a@b.cd 😀 10.0.0.1", "", None, "a@b.c.@d.e", "+" * 500 + "1" + " " * 50_000 + "2345678901", "1.2.3.4@x.com", "a@b.cd e@f.gh +1 663 555 6869"]


def test_base_spans_are_those_of_the_stated_patterns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    for r in pii.digest(pii.find(df)).collect():
        want = base_spans(ODD[r.doc_id] or "")
        named = ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in want)
        assert (r.base_sha256, r.spans) == (hashlib.sha256(named.encode()).hexdigest(), named)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in want) for k in range(4)]


def people(copies=1):
    rnd, rows = random.Random(3), []
    common = "the of and to in is that for it as was with be by on not he his but at".split()
    for i in range(60):
        words = [rnd.choice(common) for _ in range(30)]
        if i % 5 == 0:
            words[10:10] = ["Zorblat", "Ltd", "zoe@zorblat.com", "Quin", "😀", "10.0.0.1"]
        if i % 5 == 1:
            words[5:5] = ["Call", "+1 (663) 555-6869", "é"]
        rows.append((i, " ".join(words)))
    rows += [(100, "zorblat alone and Quin"), (None, None), (101, "")]
    return rows + [(200 + i, "Unusual Neighbour 9.9.9.9 Only Copies") for i in range(copies)]


def test_terms_that_reveal_an_entity_are_marked_where_it_stands(spark, tmp_path):
    df = spark.createDataFrame(people(20), "doc_id long, text string")
    got, want = through_query(spark, tmp_path, "op11_pii", "documents", df)
    assert got == want
    rows = {r.doc_id: r for r in pii.digest(pii.find(df)).collect()}
    assert rows[0].n_term == 2 and rows[1].n_term >= 1
    assert rows[100].n_term == 0  # no personal data there
    assert rows[200].n_term == 0  # copies of one passage are no evidence
    near = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "[EMAIL]" in near[0] and "Ltd" not in near[0] and "[NAME]" in near[0] and "[IP]" in near[0]
    assert near[100] == "zorblat alone and Quin" and near[None] is None and near[101] == ""


def test_rewriting_keeps_everything_else(spark):
    columns = "_text string, pii string, text string, row long, base string, doc_id long"
    rows = [("own", "p", "x" * 5_000 + " a@b.cd " + "é" * 9_000 + " 1.2.3.4", 1, "b", 7), (None, None, None, None, None, None), ("o", "q", "1.2.3.4@x.com!", 2, "c", 7)]
    got = pii.sanitise(spark.createDataFrame(rows, columns))
    assert got.columns == ["_text", "pii", "text", "row", "base", "doc_id"]
    texts = {r.pii: r for r in got.collect()}
    assert texts["p"].text == "x" * 5_000 + " [EMAIL] " + "é" * 9_000 + " [IP]" and texts["p"]._text == "own"
    assert texts["q"].text == "[EMAIL]!" and texts[None].text is None


def test_many_candidates_are_counted_without_a_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(people(), "doc_id long, text string")
    few = rows_of(pii.digest(pii.find(df)))
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 1)
    assert rows_of(pii.digest(pii.find(df))) == few


def test_pii_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digest(pii.find(df)).count() == 0 and pii.sanitise(df).count() == 0


# vector codes


def coded(rows, parts=8, most=16, rounds=6, scale=4096):
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [(i, [max(-(2**62), min(2**62, math.floor(scale * float(x)))) for x in v], label) for i, v, label in rows]
    if not whole:
        return []
    w = -(-max(len(v) for _, v, _ in whole) // parts)
    whole = [(i, v + [0] * (w * parts - len(v)), label) for i, v, label in whole]
    seeds = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:most]
    books = [[v[p * w : (p + 1) * w] for _, v, _ in seeds] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * w : (p + 1) * w], e, strict=True)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        moved = []
        for p in range(parts):
            mine = {}
            for _, v, _ in whole:
                mine.setdefault(nearest(v, p)[1], []).append(v[p * w : (p + 1) * w])
            moved.append([[sum(c) // len(mine[j]) for c in zip(*mine[j], strict=True)] if j in mine else e for j, e in enumerate(books[p])])
        books = moved
    name = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, total = [], {}
    for i, v, label in whole:
        found = [nearest(v, p) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), min(2**63 - 1, sum(d for d, _ in found)), label))
        total[label] = total.get(label, 0) + out[-1][2]
    return sorted(((code, name, error, min(2**63 - 1, total[label]), i) for i, code, error, label in out), key=repr)


def vectors():
    rng = np.random.default_rng(1)
    rows = [(int(i) // 2, list(map(float, np.round(rng.normal(size=19), 1))), int(i) % 3) for i in range(200)]  # ties, repeated ids, a length that 8 does not divide
    return rows + [(1000 + i, [0.1] * 19, None) for i in range(30)] + [(-5, [2e5] * 19, 1), (5000, [1.9e5] * 19, 1), (5001, [-3e6] + [0.1] * 18, 1), (6000, None, 1), (6001, [float("nan")] * 19, 1), (None, [0.2] * 5, None)]


@pytest.mark.parametrize("rows", [
    [], vectors(), [(1, [0.5] * 16, None), (2, None, 1), (3, [float("inf")] * 16, 1), (1, [0.25] * 16, None), (None, [0.1] * 5, 2), (7, [], 2), (8, [1e8] * 16, 2), (9, [1e300] + [0.0] * 15, 2)],
    [(i, [float(i % 3)] * 16, 0) for i in range(40)], [(1, [], None)]])
def test_codes_equal_those_of_every_entry_compared(spark, rows):
    df = spark.createDataFrame([(*r, "v") for r in rows], "vec_id long, embedding array<double>, label int, v string")
    assert rows_of(vector_codes.compress(df)) == coded(rows)


def test_codes_through_the_query(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=64).astype(np.float32)], None if i % 7 == 0 else i % 5) for i in range(300)]
    got, want = through_query(spark, tmp_path, "op12_vector_codes", "embeddings", spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert got == want


def test_the_annulus_leaves_entries_out():
    rng = np.random.default_rng(3)
    entries = (rng.normal(size=(16, 8)) * np.arange(1, 17)[:, None] * 4096).astype(np.int64)
    parts = (rng.normal(size=(2_000, 8)) * rng.uniform(1, 16, (2_000, 1)) * 4096).astype(np.int64)
    index, distance, work = vector_codes.Codebook(entries.tolist()).nearest(parts)
    every = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (index == every.argmin(1)).all() and (distance == every.min(1)).all() and work < 0.8 * every.size


# repair of conversations


def repaired(conv, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][0] + b[1][0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    then = lambda s: "a" if s == "u" else "u"

    def closed(best):
        for _ in range(4):
            best = {s: min(best[s], (5 + best[then(s)][0], "I" + best[then(s)][1])) for s in best}
        return best

    best = closed({"": (0, ""), "a": (0, ""), "s": (10**9, ""), "u": (10**9, "")})
    for (_, role, _), fault in zip(reversed(rows), reversed(faults), strict=True):
        now, more = {}, 5 * (fault == "truncated")
        for s in best:
            ways = [(2 + best[s][0], "D" + best[s][1])]
            if fault not in ("blank", "duplicate"):
                ways.append((1 + more + best[then(s)][0], "R" + best[then(s)][1]))
                if (role[0] == "s" and s == "") or role[0] == then(s):
                    ways.append((more + best[role[0]][0], "K" + best[role[0]][1]))
            now[s] = min(ways)
        best = closed(now)
    cost, audit = best[""]
    lines, state, left = [], "", iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)[1:]
        if letter in "IR":
            state = then(state)
            lines.append({"u": "user", "a": "assistant"}[state] + ":" + text)
        elif letter == "K":
            state = role[0]
            lines.append(role + ":" + text)
    return conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def all_repaired(rows):
    held = {}
    for conv, turn, role, text in rows:
        mine = held.setdefault(conv, [])
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        if what:
            mine += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    return sorted((repaired(c, r) for c, r in held.items()), key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def talks():
    rnd, rows = random.Random(1), []
    text = lambda: rnd.choice(["Hi.", "Yes!", "no", "", " ", "What?", "x " * 3, "end. \n", None, "é.", "long " * 5_000 + "."])
    role = lambda: rnd.choice(["system", "user", "assistant", "assistant", "user", "tool", "s", None, "umpire"])
    for c in range(200):
        rows += [(c, None if rnd.random() < 0.1 else i, role(), text()) for i in range(rnd.choice([1, 2, 3, 4, 5, 7, 9, 16, 17]))]
    rows += [(None, i, role(), text()) for i in range(12)]
    rows += [(1000, i, ["user", "assistant"][i % 2] if rnd.random() < 0.9 else "system", f"text {i}." if rnd.random() < 0.9 else "zz") for i in range(2_500)]
    rows += [(2000, rnd.choice([1, 2, 5, 5000, -7, None]), "user", "Same.") for _ in range(60)]
    return rows + rows[:30]


def test_repair_equals_brute_force(spark):
    rows = talks()
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, kind int")
    got = turn_repair.damage_and_repair(df)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == all_repaired(rows)


def test_repair_through_the_query(spark, tmp_path):
    rows = [(c, t, role, text) for c, t, role, text in talks() if c is not None and c < 300 and t is not None]
    got, want = through_query(spark, tmp_path, "op13_turn_repair", "conversations", spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got == want


def test_ids_may_be_words_and_tables_empty(spark):
    rows = [("b", 1, "user", "a."), ("b", 2, "assistant", "b."), ("", None, None, None), (None, 5, "assistant", "c.")]
    made = turn_repair.damage_and_repair(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in made.collect()), key=repr) == all_repaired(rows)
    assert turn_repair.damage_and_repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pieces_of_a_long_conversation_join_up():
    rng = np.random.default_rng(4)
    for n in (1, 5, 64, 65, 300):
        row = rng.integers(0, 16, n)
        assert turn_repair.repair_long(row, 16) == turn_repair.repair_bucket([row])[0]


# one large component, and ids of any whole kind, in the top-k search


def test_a_large_component_takes_part(spark):
    from oddsloom.llm import bitslice

    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.uniform(-1, 1, 4)]) for i in range(200)] + [(1_000, [1e8, 0.0, -1e8, 0.5])]
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = []
    for q in sorted(i for i in whole if i % 50 == 0):
        scores = sorted(((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q))
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:5], 1)]
    for kind in ("int", "long"):
        got = bitslice.top_k(spark.createDataFrame(rows, f"vec_id {kind}, embedding array<double>"))
        assert sorted(map(tuple, got.collect())) == want
    with pytest.raises(Exception, match="passes 64 bits"):
        bitslice.top_k(spark.createDataFrame([(0, [1e10]), (1, [1e10])], "vec_id long, embedding array<double>")).collect()
