"""Exact top-k search, conversation repair and Merkle manifest against brute force, on tables full of odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlgauge.llm import merkle, repair, topk


def same(df, want):
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


# --- exact top-k search ----------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, r int, norm string"


def vectors():
    rng, g = random.Random(2), np.random.default_rng(3)
    base, rows = g.normal(size=(6, 5)), []
    for i in range(400):  # lengths that differ much, and close directions
        near = base[i % 6] * (1 + 0.02 * g.normal(size=5)) * g.lognormal(0, 1.0)
        rows.append((i, near.tolist() if i % 3 else g.normal(size=5).tolist()))
    rows += [(1000 + i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(60)]  # one vector many times
    rows += [(3000, [0.0] * 5), (3050, [0.0] * 5), (None, [9.0] * 5), (0, [9.0] * 5), (50, [-9.0] * 5), (51, None),
             (52, [1.0, None, 1.0, 1.0, 1.0]), (100, [math.nan] * 5), (100, [math.inf] * 5), (150, []), (151, []),
             (200, [1.0, 2.0]), (250, [3.0]), (7, [1e15, 0.0, 0.0, 0.0, 0.0]), (300, [1e15, 1.0, 0.0, 0.0, 0.0]),
             (301, [-1e15, -7.0, 0.0, 0.0, 0.0]), (350, [1e307] * 5)]
    rng.shuffle(rows)
    return [(*r, 1, "x") for r in rows]


def products(rows, k):
    usable = lambda e: e is not None and all(x is not None and math.isfinite(x * 256) for x in e)
    v = [(i, r[0], [math.floor(256 * x) for x in r[1]]) for i, r in enumerate(rows) if usable(r[1])]
    cut = lambda x: max(1 - 2**63, min(2**63 - 1, x))
    for i, a, x in v:
        if a is not None and a % 50 == 0:
            best = sorted((-cut(sum(map(lambda p, q: p * q, x, y))), b is None, b or 0, j) for j, b, y in v
                          if j != i and len(y) == len(x))[:k]
            yield from ((a, n + 1, None if t[1] else t[2], -t[0]) for n, t in enumerate(best))


@pytest.mark.parametrize("sizes", [{}, {"bucket": 16, "block": 4, "span": 64}])
def test_topk(spark, sizes):
    rows = vectors()
    for part in (rows, [r for r in rows if r[1] and len(r[1]) == 5 and r[0] and r[0] < 400], rows[:1], []):
        df = spark.createDataFrame(part, VECTORS).repartition(5)
        same(topk.top_products(df, F.col("vec_id") % 50 == 0, **sizes), list(products(part, 5)))


def test_coordinate_ranges_hold_all_near_vectors():
    g = np.random.default_rng(7)
    q, p = (x / np.linalg.norm(x, axis=1)[:, None] for x in g.normal(size=(2, 20_000, 3)))
    cosine = np.einsum("ij,ij->i", q, p)
    for t in (0.05, 0.5, 0.95):
        near = cosine >= t
        for f in range(3):
            least, most = topk._range(q[near, f], np.full(near.sum(), t))
            assert ((p[near, f] >= least) & (p[near, f] <= most)).all()


# --- conversation repair ---------------------------------------------------------------------

ROWS = "conv_id long, turn long, role string, text string, at int, conv string, n long"
INK = re.compile(r"[^\x20\x09-\x0D]")
NAMES = {"u": "user", "a": "assistant"}
AFTER = {"": "su", "s": "u", "u": "a", "a": "u"}


def damage(rows):
    found = {}
    for conv, turn, role, text in rows:
        mine = found.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        form = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(form, text)
        mine += [(turn, "user" if form == 4 else role, text)] * {0: 0, 3: 2}.get(form, 1)
    return found


def told(rows):
    def key(row):
        digest = hashlib.sha256(f"{len(row[1].encode())}:{row[1]}{row[2]}".encode()).hexdigest()
        return row[0] is not None, row[0] or 0, row[1].encode(), digest

    rows, seen, faults = sorted(rows, key=key), set(), []
    for _, role, text in rows:
        ink = INK.findall(text)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen
                      else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    return rows, faults


def with_inserts(layer):
    layer = dict(layer)
    for _ in range(3):
        for state in list(layer):
            cost, audit, lines = layer[state]
            for role in AFTER[state].replace("s", ""):
                new = (cost + 5, audit + "I", (*lines, NAMES[role] + ":"))
                if role not in layer or new[:2] < layer[role][:2]:
                    layer[role] = new
    return layer


def cheapest(rows, faults):
    layer = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        ways = []
        for state, (cost, audit, lines) in with_inserts(layer).items():
            ways.append((cost + 2, audit + "D", lines, state))
            if fault not in ("blank", "duplicate"):
                cost += 5 * (fault == "truncated")
                if role[:1] and role[:1] in AFTER[state]:
                    ways.append((cost, audit + "K", (*lines, role + ":" + text), role[:1]))
                ways += [(cost + 1, audit + "R", (*lines, NAMES[r] + ":" + text), r)
                         for r in AFTER[state].replace("s", "")]
        layer = {s: min((w[:3] for w in ways if w[3] == s), key=lambda w: w[:2]) for s in {w[3] for w in ways}}
    return min((v for s, v in with_inserts(layer).items() if s in ("", "a")), key=lambda v: v[:2])


def repaired(rows):
    for conv, mine in damage(rows).items():
        mine, faults = told(mine)
        turns = [t for t, _, _ in mine if t is not None]
        gaps = min(2**63 - 1, max(turns) - min(turns) + 1 - len(set(turns))) if turns else 0
        initials = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, lines = cheapest(mine, faults)
        yield (conv, gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit,
               hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations():
    rng, rows = random.Random(4), []
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "Assistant", "5x"]
    texts = ["Hi.", "Hello there", "What?", "no", "  ", "", None, "é!\n", "done.", "x" * 3000 + "."]
    for conv in range(120):
        for turn in range(rng.randint(1, 9)):
            text = rng.choice(texts)
            if text is not None and rng.random() < 0.3:
                text += str(rng.randint(0, 3))
            rows.append((conv, rng.choice([turn, turn, turn, None, turn - 1, 2**62 + turn]), rng.choice(roles), text))
    for turn in range(400):  # one conversation with many rows, two with one row many times, one without a name
        rows.append((5000, turn // 2, rng.choice(roles[:5]), f"{rng.choice(texts[:4])}{rng.randint(0, 150)}."))
    rows += [(5001, 7, "user", "same thing.")] * 300 + [(5002, t, "user", "same thing.") for t in range(100)]
    rows += [(None, rng.choice([None, t]), rng.choice(roles), f"{rng.choice('ab')}{t}.") for t in range(60)]
    rows += rows[:40]
    return rows + [(6000, -2**63, "user", "a."), (6000, 2**63 - 1, "assistant", "b."), (6000, 0, "system", "c.")]


@pytest.mark.parametrize("sizes", [{}, {"segment": 3, "fan_in": 2}])
def test_repair(spark, sizes):
    rows = conversations()
    for part in (rows, rows[:1], []):
        df = spark.createDataFrame([(*r, 1, "x", 5) for r in part], ROWS).repartition(6)
        same(repair.repair(repair.damaged(df), **sizes), list(repaired(part)))


def test_search_finds_the_least_of_all_edits():
    rng = random.Random(9)
    for _ in range(60):
        kinds = [(rng.choice("suax"), rng.random() < 0.85, rng.random() < 0.3, rng.choice([0, 0, 1])) for _ in range(5)]
        steps, found = [repair.row_moves(*k) for k in kinds], []
        for choice in itertools.product(range(6), repeat=5):
            cost, audit, state = 0, "", ""
            for step, c in zip(steps, choice):
                if c >= len(step[state]):
                    break
                more, letters, state = step[state][c]
                cost, audit = cost + more, audit + letters
            else:
                end = repair._ENDING[state]
                found.append((cost + end[0], audit + end[1]))
        assert repair.search(steps, "", repair._ENDING) == min(found)


# --- Merkle manifest -------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, seq string, at int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def runs(levels, i):
    for level in levels[:-1]:
        yield i % 2, level[i // 2 * 2:i // 2 * 2 + 2]
        i //= 2


def proved(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0], leaf(r[0], r[3], r[2], r[4], r[1]), r))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for mine in by.values():
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [tree([x[1] for x in by[n]]) for n in names]
    top = tree([t[-1][0] for t in trees])
    for j, n in enumerate(names):
        for i, (doc_id, own, r) in enumerate(by[n]):
            way = [*runs(trees[j], i), *runs(top, j)]
            tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and r[4] is not None
            now = leaf(r[0], r[3], r[2], r[4] + 1, r[1]) if tampered else own
            for side, run in way:
                now = h(*(now if k == side else x for k, x in enumerate(run)))
            siblings = h(*(x for side, run in way for k, x in enumerate(run) if k != side))
            yield doc_id, own, trees[j][-1][0], top[-1][0], siblings, now, now == top[-1][0]


def test_manifest(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, i, i, 2**60 + i]), rng.choice([None, "", "tést", "long " * 4000, str(i)]),
             rng.choice([None, "", "en", "en", "en", "é", "z"]), rng.choice([None, "a"]),
             rng.choice([None, i, 2**63 - 1]), "x", 1) for i in range(61)]
    rows += rows[:6]
    for part, sizes in ((rows, (12, 1, 2)), (rows[:1], (12, 1)), ([], (12,))):
        docs = spark.createDataFrame(part, DOCS).repartition(4)
        for levels in sizes:
            same(merkle.manifest(docs, levels=levels), list(proved(part)))
