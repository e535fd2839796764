import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from parley.llm import conversation_repair as cr

EMPTY = hashlib.sha256(b"").hexdigest()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        known = [" " if x is None else x for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{known[0]}:{known[1]}".encode()) % 20
        role, text = known[2], known[3]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def judged(rows):
    """Sorted turns of one conversation as (role, text, fault)."""
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest())
    seen, out = set(), []
    for _, _, role, text in sorted(rows, key=key):
        shown = re.sub(r"[\x20\x09-\x0D]+", "", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(turns, delete=2):
    """Least (cost, audit, repaired) by recursion over whole suffixes."""

    @cache
    def best(i, state, inserts):
        options = []
        if i == len(turns) and state in ("", "a"):
            options.append((0, "", ()))
        to = "a" if state == "u" else "u"
        name = {"a": "assistant", "u": "user"}[to]
        if inserts < 2:
            c, a, r = best(i, to, inserts + 1)
            options.append((5 + c, "I" + a, (f"{name}:", *r)))
        if i < len(turns):
            role, text, fault = turns[i]
            c, a, r = best(i + 1, state, 0)
            options.append((delete + c, "D" + a, r))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault else 0
                c, a, r = best(i + 1, to, 0)
                options.append((1 + extra + c, "R" + a, (f"{name}:{text}", *r)))
                if role[:1] and (state + role[:1]) in ("s", "u", "su", "ua", "au"):
                    c, a, r = best(i + 1, role[0], 0)
                    options.append((extra + c, "K" + a, (f"{role}:{text}", *r)))
        return min(options, default=(10**9, "", ()))

    return best(0, "", 0)


def cheapest_of_all(turns):
    """All edits of up to three turns, with up to two insertions at each place, against the grammar itself."""
    gaps = [x for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    edits = []
    for role, text, fault in turns:
        extra = 5 if fault else 0
        stay = [] if fault in ("blank", "duplicate") else [(extra, "K", role), (1 + extra, "R", "user"), (1 + extra, "R", "assistant")]
        edits.append([(2, "D", None), *stay])
    found = []
    for chosen in itertools.product(*edits):
        for ins in itertools.product(gaps, repeat=len(turns) + 1):
            roles, audit, cost = [], "", 5 * sum(map(len, ins))
            for i, g in enumerate(ins):
                roles += g
                audit += "I" * len(g)
                if i < len(turns):
                    cost += chosen[i][0]
                    audit += chosen[i][1]
                    roles += [chosen[i][2]] if chosen[i][2] is not None else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r in roles)):
                found.append((cost, audit))
    return min(found)


ROLES = ("user", "assistant", "system", "user", "assistant", "tool", "")
TEXTS = ("Hello.", "Yes!", "What now", " \t", "", "Fine?  \n", "cut off", "é.", "What now")


def random_turns(pick, n):
    return [(c, t, pick.choice(ROLES), pick.choice(TEXTS)) for c in [1] for t in range(n)]


def test_all_edits_of_short_conversations():
    pick = random.Random(1)
    for n in (0, 1, 1, 1, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2):
        turns = judged(random_turns(pick, n))
        assert cheapest(turns)[:2] == cheapest_of_all(turns)
    for roles in (("assistant", "system", "user"), ("tool", "user", "user"), ("system", "assistant", "system")):
        turns = [(r, f"{r}{i}.", "") for i, r in enumerate(roles)]
        assert cheapest(turns)[:2] == cheapest_of_all(turns)


def test_backward_costs_and_forward_walk():
    pick = random.Random(2)
    number = {"": cr.SOUND, "blank": cr.BLANK, "duplicate": cr.DUPLICATE, "truncated": cr.TRUNC}
    for n in [*range(12)] * 60:
        turns = judged(random_turns(pick, n))
        symbols = bytes(cr.symbol(cr.initial_of(role), number[fault]) for role, _, fault in turns)
        assert cr.cheapest_audit(symbols) == cheapest(turns)[:2]


def test_insertions_where_deleting_is_dear(monkeypatch):
    """With the costs as they are, deleting a neighbour is always cheaper than inserting a turn."""
    monkeypatch.setattr(cr, "DELETE", 7)
    cr.cost_before.cache_clear(), cr.choice.cache_clear()
    pick, inserted = random.Random(4), 0
    for n in [*range(9)] * 30:
        roles = [pick.choice(ROLES[:5]) for _ in range(n)]
        found = cr.cheapest_audit(bytes(cr.symbol(r[0], cr.SOUND) for r in roles))
        assert found == cheapest([(r, f"{i}.", "") for i, r in enumerate(roles)], 7)[:2]
        inserted += "I" in found[1]
    cr.cost_before.cache_clear(), cr.choice.cache_clear()
    assert inserted > 20


def test_one_byte_tells_the_costs():
    """However turns follow each other, only few vectors of differences occur."""
    todo, known = [cr.AT_END], {cr.AT_END}
    while todo:
        at = todo.pop()
        for initial in "sua?":
            for fault in (cr.SOUND, cr.BLANK, cr.DUPLICATE, cr.TRUNC):
                costs, _ = cr.cost_before(initial, fault, at)
                if costs not in known:
                    known.add(costs)
                    todo.append(costs)
    assert len(known) < 256
    assert cr.cheapest_audit(bytes([cr.symbol("u", 0), cr.symbol("a", 0)]) * 200_000) == (0, "KK" * 200_000)


def table():
    pick = random.Random(3)
    rows = [(c, t, pick.choice(ROLES), pick.choice(TEXTS) + pick.choice(("", f" {t}."))) for c in range(60) for t in range(pick.randrange(1, 9))]
    rows += [(None, t, pick.choice(ROLES), pick.choice(TEXTS)) for t in (None, 1, 1, 2, 7)]
    rows += [(70, None, None, None), (70, None, "user", None), (70, 3, None, "x."), (71, None, "user", "a."), (71, None, "assistant", "b."), (71, None, "user", "a.")]
    rows += [(72, t % 1_000, ("user", "assistant")[t % 2], "the same.") for t in range(3_000)]  # one conversation with most rows
    rows += [(73, t, ("user", "assistant")[t % 2], f"turn {t}" + "." * (t % 3)) for t in range(2_500)]
    rows += [(74, 0, "user", "long " * 300_000 + "?"), (74, 1, "assistant", "x" * 1_000_000)]
    gone = [(c, 0, "user", "only turn.") for c in range(100, 160)]
    return rows + gone


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(*r, "g", "a", 5) for r in table()], "conv_id long, turn long, role string, text string, gone string, audit string, cost long")


@pytest.fixture(scope="module")
def expected():
    out = {}
    rows = damaged(table())
    for conv in {r[0] for r in table()}:
        own = [r for r in rows if r[0] == conv]
        turns = judged(own)
        cost, audit, repaired = cheapest(turns) if len(turns) < 400 else (None, None, None)
        pairs = [(a[0][:1], b[0][:1]) for a, b in itertools.pairwise(turns)]
        numbers = {r[1] for r in own} - {None}
        out[conv] = [max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(sum(f == x for *_, f in turns) for x in ("blank", "duplicate", "truncated")),
                     sum(p not in (("s", "u"), ("u", "a"), ("a", "u")) for p in pairs), cost, audit, repaired]
    return out


def test_against_brute_force(frame, expected):
    found = {r.conv_id: r for r in cr.repairs(cr.damage(frame.repartition(5))).collect()}
    assert set(found) == set(expected)
    assert any(e[6] == "" for e in expected.values())
    for conv, e in expected.items():
        r = found[conv]
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal] == e[:5], conv
        if e[5] is not None:
            assert (r.cost, r.audit) == tuple(e[5:7])
            assert r.repaired_sha256 == hashlib.sha256("\n".join(e[7]).encode()).hexdigest()


def test_turns_give_the_hashes(frame):
    rows = cr.damage(frame)
    found = {}
    for r in cr.repaired_turns(rows).sort("conv_id", "turn").collect():
        found.setdefault(r.conv_id, []).append((r.turn, f"{r.role}:{r.text}"))
    for r in cr.repairs(rows).collect():
        turns = found.get(r.conv_id, [])
        assert [t for t, _ in turns] == list(range(len(turns)))
        assert hashlib.sha256("\n".join(x for _, x in turns).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for _, x in turns))


def test_empty_table_and_names_of_other_types(spark):
    none = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert cr.repairs(cr.damage(none)).collect() == []
    named = spark.createDataFrame([("x", 5, "system", "Be kind."), ("x", 9, "user", "Hi.")], "conv_id string, turn int, role string, text string")
    rows = cr.repairs(named.withColumn("gone", cr.F.lit(False))).collect()
    assert [(r.conv_id, r.gaps, r.cost, r.audit) for r in rows] == [("x", 3, 2, "RR")]
    assert rows[0].repaired_sha256 == hashlib.sha256(b"user:Be kind.\nassistant:Hi.").hexdigest()
    gone = cr.repairs(named.withColumn("gone", cr.F.lit(True))).collect()
    assert [tuple(r) for r in gone] == [("x", 0, 0, 0, 0, 0, 0, "", EMPTY)]
