import hashlib
import itertools
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from rooftop.llm import repair as R
from rooftop.llm.common import table

from .conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
WS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired rows) over [(role, text, fault)], by trying every edit at every place."""
    @lru_cache(None)
    def go(i, state):
        best = (0, "", ()) if i == len(rows) and state in (0, 3) else None

        def offer(cost, edit, rest, out):
            nonlocal best
            if rest is not None:
                new = (cost + rest[0], edit + rest[1], out + rest[2])
                if best is None or new[:2] < best[:2]:
                    best = new

        def to(letter):
            return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((state, letter))

        if i < len(rows):
            role, text, fault = rows[i]
            offer(2, "D", go(i + 1, state), ())
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if to(role[:1]) is not None:
                    offer(more, "K", go(i + 1, to(role[:1])), (f"{role}:{text}",))
                for name in ("user", "assistant"):
                    if to(name[0]) is not None:
                        offer(1 + more, "R", go(i + 1, to(name[0])), (f"{name}:{text}",))
        if (i, state) not in inserting:
            inserting.add((i, state))
            for name in ("user", "assistant"):
                if to(name[0]) is not None and sum(1 for x in inserting if x[0] == i) < 4:
                    offer(5, "I", go.__wrapped__(i, to(name[0])), (f"{name}:",))
            inserting.discard((i, state))
        return best

    inserting = set()
    return go(0, 0)


def brute(rows):
    """Result rows for the original (conv_id, turn, role, text) rows."""
    convs = {}
    for conv, turn, role, text in rows:
        out = convs.setdefault(conv, [])
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        if k == 1:
            text = ""
        if k == 2:
            text = "".join(c for c in text if c not in ".!?")
        if k == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if k == 3 else 1)
    result = []
    for conv, hurt in convs.items():
        hurt.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, judged = set(), []
        for _, role, text in hurt:
            fault = "blank" if not text.strip(WS) else "duplicate" if (role, text) in seen else \
                "truncated" if text.strip(WS)[-1] not in ".!?" else None
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [t for t, _, _ in hurt if t is not None]
        count = [sum(f == x for _, _, f in judged) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, audit, fixed = cheapest(tuple(judged))
        result.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, cost, audit,
                       hashlib.sha256("\n".join(fixed).encode()).hexdigest()))
    return sorted(result, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def random_rows(seed, convs, most):
    rng, out = random.Random(seed), []
    for conv in range(convs):
        for turn in range(rng.randrange(most)):
            out.append((conv, rng.choice([turn, turn, turn, turn + 1, None]),
                        rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "upper"]),
                        rng.choice(["Yes.", "No?", "open end", "", None, " \t", "Same.", f"Text {rng.random()}!", "Line.\n \x1c"])))
    return out


# -- the grammar ------------------------------------------------------------------
def test_cells_against_all_edit_sequences():
    """Every symbol string of up to three rows, every edit string: membership, cost and least audit by enumeration."""
    import re
    good = re.compile(r"(s?(ua)+)?\Z")

    def by_hand(symbols):
        best = None
        for inserts in itertools.product(range(3), repeat=len(symbols) + 1):
            for ops in itertools.product("KRD", repeat=len(symbols)):
                audit, cost, shapes = "", 0, [""]
                for i in range(len(symbols) + 1):
                    audit += "I" * inserts[i]
                    cost += 5 * inserts[i]
                    shapes = [s + "".join(x) for s in shapes for x in itertools.product("ua", repeat=inserts[i])]
                    if i == len(symbols):
                        break
                    c, op = symbols[i], ops[i]
                    audit += op
                    if op != "D" and c == "d":
                        shapes = []
                    cost += {"K": 0, "R": 1, "D": 2}[op] + (5 if op != "D" and c.isupper() else 0)
                    new = [c.lower()] if op == "K" else ["u", "a"] if op == "R" else [""]
                    shapes = [s + x for s in shapes for x in new]
                if any(good.match(s) for s in shapes) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
        return best

    for n in range(3):
        for symbols in map("".join, itertools.product("dsuaxSUAX", repeat=n)):
            cell = R.parse(symbols)
            assert min(cell[i] for i in R.ACCEPT) == by_hand(symbols), symbols


def test_any_split_gives_the_same_cell():
    rng = random.Random(5)
    for _ in range(100):
        s = "".join(rng.choice("dsuuaaxUA") for _ in range(rng.randrange(1, 40)))
        whole = R.parse(s)
        for k in range(len(s) + 1):
            assert R.combine(R.parse(s[:k]), R.parse(s[k:])) == whole


def test_states_follow_the_least_audit():
    rng = random.Random(6)
    for _ in range(100):
        spans = ["".join(rng.choice("dsuuaaxUA") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 8))]
        whole, cells = R.parse("".join(spans)), [R.parse(s) for s in spans]
        for i, (p, q) in enumerate(R.PAIRS):
            if whole[i]:
                way = R.states(cells, p, q)
                steps = [c[R.PAIRS.index(x)] for c, x in zip(cells, zip(way, way[1:]))]
                assert (sum(x[0] for x in steps), "".join(x[1] for x in steps)) == whole[i]


# -- the operator -----------------------------------------------------------------
def test_table_against_brute_force(spark):
    df = table(spark, SF, "conversations")
    assert got(R.repair_damaged(df)) == brute([tuple(r) for r in df.collect()])


@pytest.mark.parametrize("span, rows_per_range", [(256, 200_000), (3, 40), (1, 10)])
def test_random_conversations_in_small_cells(spark, span, rows_per_range):
    rows = random_rows(span, 40, 14) + [(None, i, "user" if i % 2 else None, f"Null {i}.") for i in range(9)] \
        + [(900, i, ("assistant", "user")[i % 2], f"Long {i % 70}." if i % 7 else "cut") for i in range(120)] \
        + [(901, 5, "user", "Same.")] * 30
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(R.repair_damaged(df, span, rows_per_range)) == brute(rows)


def test_long_text_extra_columns_and_empty(spark):
    rows = [(1, 0, "user", "x" * 2_000_000 + "."), (1, 1, "assistant", "word. " * 200_000), (2, None, None, None),
            (3, 0, "user", "Ünï 😀?"), (3, 0, "user", "Ünï 😀?"), (3, 1, "assistant", "é.")]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.select("*", *[F.lit(1).alias(c) for c in ("key", "place", "kind", "col", "ord", "pair", "a.b")])
    assert got(R.repair_damaged(clash)) == brute(rows)
    assert got(R.repair_damaged(spark.createDataFrame([], SCHEMA))) == []


def test_repaired_rows_are_well_formed(spark):
    fixed = R.repair(spark.createDataFrame(random_rows(9, 30, 12), SCHEMA), span=4, rows_per_range=20)
    shapes = fixed.rows.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct("ord", "k", "role"))), lambda x: F.substring(x["role"], 1, 1)), "").alias("shape"))
    assert shapes.count() > 10 and shapes.filter(~F.col("shape").rlike(r"^(s?(ua)+)?$")).isEmpty()
