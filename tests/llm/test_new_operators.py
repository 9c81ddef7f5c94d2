"""Hard negatives, personal data and conversation repair against brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from itertools import product
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import hard_negatives, pii, queries, repair

SF = "/root/testdata/sf0.001"


# hard negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_negatives(rows):
    used = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        used.append((i, [math.floor(256 * float(x)) for x in v], label))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = Counter()
    for n, (a, va, la) in enumerate(used):
        if a is None or a % 100:
            continue
        scored = [(sum(p * q for p, q in zip(va, v)), i, label) for m, (i, v, label) in enumerate(used) if m != n]
        for ps, p, _ in sorted((s for s in scored if s[2] == la), key=order)[:5]:
            fits = sorted((s for s in scored if s[2] != la and 30 * ps <= 100 * s[0] <= 90 * ps), key=order)[:10]
            for r, (ns, i, _) in enumerate(fits, 1):
                out[a, p, r, i, ps, ns] += 1
    return out


def mined(df):
    return Counter(tuple(r) for r in hard_negatives.mine(queries.relabelled(df)).collect())


def test_hard_negatives(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want = brute_negatives([(i, [np.float32(x) for x in v] if v else v, c) for i, v, c in rows])
    assert want and mined(df) == want
    assert mined(df.repartition(5).withColumn("row", F.lit("x")).withColumn("slice", F.lit(1))) == want


def test_hard_negatives_odd_rows(spark):
    random.seed(1)
    rows = [(i, [random.choice([-0.5, 0.25, 1.0]) for _ in range(6)], i % 3) for i in range(300)]
    rows += [(0, [1.0] * 6, 0), (100, [0.5] * 6, 1), (100, [0.5] * 6, 1), (None, [1.0] * 6, 0), (None, [0.7] * 6, 1), (400, None, 1), (500, [1.0] * 6, None),
             (600, [1.0, None], 1), (700, [float("nan")] * 6, 2), (800, [float("inf")] * 6, 2), (900, [], 2), (1000, [3.0, -1.0], 1), (1100, [0.0] * 6, 1), (-100, [2.0] * 6, 1)]
    rows += [(2000 + i, [1.0, 1.0, 0.5, 0.5, 0.25, -0.5], 7) for i in range(200)]  # one vector held by a third of all rows
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    assert mined(df) == brute_negatives(rows)
    assert mined(spark.createDataFrame([], VECTORS)) == Counter()
    assert mined(spark.createDataFrame([(100, [1.0], 1)], VECTORS)) == Counter()


@pytest.mark.parametrize("d", [1, 64, 70])
def test_intervals_hold(d):
    rng = np.random.default_rng(d)
    rows, anchors = rng.integers(-90, 90, (500, d)), rng.integers(-90, 90, (40, d))
    rows[:3] = 0
    turn = hard_negatives.rotation(d)
    assert np.allclose(turn @ turn.T, np.eye(d))
    norms, codes, alignments, rests = hard_negatives.encode(rows, turn)
    low, high = hard_negatives.Anchors(anchors, turn).intervals(slice(0, 40), codes, alignments, rests, norms)
    exact = anchors @ rows.T
    assert (low <= exact).all() and (exact <= high).all()
    # one code leaves about 0.6 of a vector's length, three about a third of it
    widths = [hard_negatives.encode(rows[3:], turn, n)[3].mean() for n in (1, 2, 3)]
    assert d == 1 or 0.65 > widths[0] > widths[1] > widths[2] and widths[2] < 0.4


# personal data

def luhn_holds(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_base(text):
    """The contract's patterns and checks, with Python's own matcher."""
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and luhn_holds(digits)
                    or kind == "phone" and 8 <= len(digits) <= 15):
                out.append((kind, *m.span()))
    return out


def searched(df):
    return [(r.doc_id, [(pii.KINDS[s.kind], s.start, s.end) for s in r.spans if s.base], [(pii.KINDS[s.kind], s.start, s.end) for s in r.spans])
            for r in pii.find_spans(df).collect()]


def with_text(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


CARD = "4111111111111111"


def test_base_spans(spark, odd, clashing, none):
    random.seed(2)
    pieces = [CARD, "4111 1111 1111 1111", "4111-1111-1111-1111-0000", "12345678901234567", "+1 (555) 123-4567", "+49.30 1234 5678", "+1 2", "+12345678901234567890", "1.2.3.4",
              "001.02.3.0255", "1.2.3.256", "1.2.3.4.5.6.7.8", "a@b.c", "a.b_c%+-@x-y.z1.de", "a@b.c_x@d.e", "@x.y", "a@b", "a@b.c..d@e.f", "é", "😀", " ", " ", "-", ".", "+", "9", "\n", ",", "word"]
    texts = ["".join(random.choices(pieces, k=random.randint(0, 12))) for _ in range(1500)] + ["", None, CARD * 2, "a" * 200_000, "1" * 200_000, "1 " * 100_000, "1." * 3000, "+1" + " 2" * 50_000,
             "a@" + "b." * 100_000 + "c", "a@b.c " * 3000 + CARD, ("12 " + CARD + ", ") * 3000, "-" * 200_000, "(" * 100_000 + "+" * 3000]
    got = {i: base for i, base, _ in searched(with_text(spark, texts))}
    for i, t in enumerate(texts):
        want = [] if t is None or len(t) == 200_000 and "a" in t or t in ("1" * 200_000, "-" * 200_000) else brute_base(t)
        assert got[i] == want, t[:200]
    for df in (odd, clashing):
        assert sorted(map(str, searched(df))) == sorted(str((r.doc_id, brute_base(r.text or ""), brute_base(r.text or ""))) for r in odd.collect())
    assert searched(none) == []


def test_added_spans(spark):
    cases = {
        f"12 {CARD} is a card": [("card", 3, 19)],                       # beside another number
        f"call +1 (366) 555-9807 {CARD}": [("card", 23, 39), ("phone", 5, 22)],
        "pay with amex 3782 822463 10005 now": [("card", 14, 31)],
        "IBAN DE89 3704 0044 0532 0130 00.": [("iban", 5, 32)],
        "IBAN DE88 3704 0044 0532 0130 00.": [],                          # the check digits are wrong
        "Her SSN is 123-45-6789.": [("ssn", 11, 22)],
        "part 123-45-6789 is sold": [], "SSN 000-45-6789": [],             # nothing near speaks of it; no such number
        "phone: (555) 123-4567": [("phone", 7, 21)], "number (555) 123-4567": [],
        "id 4111111111111112": [], "order 1234567890123 of 2020-01-02 10:00": [],
    }
    got = {i: spans for i, base, spans in searched(with_text(spark, list(cases)))}
    for i, (t, want) in enumerate(cases.items()):
        assert got[i] == want, t


def test_check_digits(spark):
    random.seed(4)
    numbers = ["".join(random.choices("0123456789", k=random.randint(1, 19))) for _ in range(300)]
    for r in spark.createDataFrame([(x,) for x in numbers], "x string").select("x", pii.luhn(F.col("x")).alias("ok")).collect():
        assert r.ok == luhn_holds(r.x)
    ibans = ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "FR1420041010050500013M02606", "FR1420041010050500013M02607", "NO9386011117947"]
    got = [r.ok for r in spark.createDataFrame([(x,) for x in ibans], "x string").select(pii.mod97(F.col("x")).alias("ok")).collect()]
    plain = [b.replace(" ", "") for b in ibans]
    assert got == [int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1 for x in plain] == [True, True, True, False, True]


def test_pii_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    df = queries.op12_pii(spark, SF)
    assert "Python" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan and "Exchange" not in plan
    got = df.collect()
    assert {r.doc_id for r in got} == set(docs)
    for r in got:
        base = brute_base(docs[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in base) for kind in pii.KINDS[:4]]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(",")) | {""}


# conversation repair

TALKS = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\f\r"


def plain_faults(rows):
    """(blank, duplicate, truncated) of each (role, text), with the first fault alone set."""
    seen, out = set(), []
    for role, text in rows:
        said = text.strip(BLANK)
        blank, twice = not said, (role, text) in seen
        seen.add((role, text))
        out.append((blank, not blank and twice, not blank and not twice and said[-1] not in ".!?"))
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired) by the plain shortest path over rows and states, all inserted turns tried at every place."""
    goes = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    name = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(4):
            for (p, (c, a, out)), r in product(list(best.items()), "ua"):
                if (p, r) in goes:
                    q, e = goes[p, r], (c + 5, a + "I", out + [(name[r], "")])
                    best[q] = min(best.get(q, e), e)
        return best

    best = inserted({0: (0, "", [])})
    for (role, text), (blank, twice, cut) in zip(rows, faults):
        after = {}

        def offer(q, e):
            after[q] = min(after.get(q, e), e)

        for p, (c, a, out) in best.items():
            offer(p, (c + 2, a + "D", out))
            if not blank and not twice:
                if (p, role[:1]) in goes:
                    offer(goes[p, role[:1]], (c + 5 * cut, a + "K", out + [(role, text)]))
                for r in "ua":
                    if (p, r) in goes:
                        offer(goes[p, r], (c + 1 + 5 * cut, a + "R", out + [(name[r], text)]))
        best = inserted(after)
    return min(best[q] for q in (0, 3) if q in best)


def plain_repair(rows):
    """The report and the repaired turns of one conversation's (turn, role, text)."""
    rows = sorted(((t, r or "", x or "") for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    said = [(r, x) for _, r, x in rows]
    faults = plain_faults(said)
    turns = {t for t, *_ in rows} - {None}
    initials = [r[:1] for r, _ in said]
    cost, audit, out = cheapest(said, faults)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[sum(f[i] for f in faults) for i in range(3)],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit), out


def by_conversation(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return out


def repaired(df):
    report, turns = repair.repair(df)
    said = by_conversation(sorted(((r.conv_id, r.pos, r.seq, r.role, r.text) for r in turns.collect()), key=lambda r: (r[0] is None, *r[1:3])))
    return {r.conv_id: ((r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit), [x[2:] for x in said.get(r.conv_id, [])]) for r in report.collect()}


def test_table_equals_all_splits_and_scripts():
    """The cells of one split of each span against those of all splits, and against every script of edits on short conversations."""
    random.seed(5)
    for n in (1, 2, 3, 4, 7, 12):
        for _ in range(12):
            cells = [repair.row_cell(chr(97 + random.randrange(12))) for _ in range(n)]
            full = {(i, i + 1): c for i, c in enumerate(cells)}
            for length in range(2, n + 1):
                for i in range(n - length + 1):
                    every = [repair.combine(full[i, k], full[k, i + length])[0] for k in range(i + 1, i + length)]
                    full[i, i + length] = {pq: min(c[pq] for c in every) for pq in every[0]}
                    assert all(c == full[i, i + length] for c in every)
            top, levels = repair.table(cells)
            assert top == full[0, n]
            for (p, q), (cost, audit) in top.items():
                spans = repair.derived(levels, p, q)
                assert "".join(c[s][1] for c, s in zip(cells, spans)) == audit and sum(c[s][0] for c, s in zip(cells, spans)) == cost
    for _ in range(60):  # every script with up to two insertions at each place
        rows = [(random.choice(["user", "assistant", "system", "tool"]), random.choice(["a.", "b", ""])) for _ in range(random.randint(1, 3))]
        faults = plain_faults(rows)
        found = []
        for edits in product("KRD", repeat=len(rows)):
            for gaps in product(["", "I", "II"], repeat=len(rows) + 1):
                audit = "".join(g + e for g, e in zip(gaps, [*edits, ""]))
                state, i, cost, ok = 0, 0, 0, True
                for letter in audit:
                    if letter == "I" or letter == "R":
                        initial, cost = "a" if state == 2 else "u", cost + (5 if letter == "I" else 1)
                    elif letter == "K":
                        initial = rows[i][0][:1]
                    if letter in "RK":
                        ok &= not faults[i][0] and not faults[i][1]
                        cost += 5 * faults[i][2]
                    if letter == "D":
                        cost += 2
                    else:
                        ok &= (state, initial) in repair.GOES
                        state = repair.GOES.get((state, initial), 0)
                    i += letter != "I"
                if ok and state in (0, 3):
                    found.append((cost, audit))
        assert min(found) == cheapest(rows, faults)[:2]


def test_repair(spark, monkeypatch):
    random.seed(6)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "u2"], ["Yes.", "No!", "what", "", None, " \t\n", "é…", "a. \n", "x" * 400, "x" * 400 + "."]
    rows = [(c, None if random.random() < 0.05 else random.randint(0, 9), random.choice(roles[:3 if c % 2 else 7]), random.choice(texts) if c % 3 else f"{random.random()}.")
            for c in range(120) for _ in range(random.randint(1, 9))]
    rows += [(None, i % 700, random.choice(["user", "assistant"]), f"t{i}" + random.choice(["", ".", "?"])) for i in range(900)]  # a long conversation without an id
    rows += [(500, None, None, None)] * 40 + [(501, 5, "user", "same.")] * 40 + [(502, 3, "system", "alone.")] + [(503, 1, "assistant", "y" * 300_000 + ".")]
    want = {c: plain_repair(x) for c, x in by_conversation(rows).items()}
    df = spark.createDataFrame(rows, TALKS).repartition(3)
    assert repaired(df) == want
    clashing = df.repartition(7).withColumns({n: F.lit("x") for n in ("pos", "seq", "key", "first", "chunk", "at", "n", "blank", "_start", "_spread", "new_role", "pieces")})
    monkeypatch.setattr(repair, "CHUNK", 16)  # many pieces for each conversation
    assert repaired(clashing) == want
    assert repaired(spark.createDataFrame([], TALKS)) == {}


def test_repair_query(spark, tmp_path):
    def damage(rows):
        for c, t, role, text in rows:
            key = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if key == 1 else re.sub("[.!?]", "", text) if key == 2 else text
            for _ in range(0 if key == 0 else 2 if key == 3 else 1):
                yield c, t, "user" if key == 4 else role, text

    random.seed(7)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(c, t, random.choice(["user", "assistant", None]), random.choice(["Ok.", None, f"n{t}."])) for c in (None, -5, 7000, 7001) for t in (None, 0, 1, 2, 2, 4)]
    rows += [(i, 0, "user", "Only.") for i in range(8000, 8060)]  # some lose all rows
    spark.createDataFrame(rows, TALKS).write.parquet(f"{tmp_path}/conversations.parquet")
    left = by_conversation(damage(rows))
    assert len(left) < len({r[0] for r in rows})
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    for c in got:
        report, turns = plain_repair(left[c]) if c in left else ((0, 0, 0, 0, 0, 0, ""), [])
        assert got[c] == (*report, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in turns).encode()).hexdigest())
