import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

from tilework.llm import conversations as C

SAID = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string, grp int, chunk int"
LEGAL = re.compile(r"(s?(ua)+)?")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def marks(turns):
    """First fault of each turn."""
    seen, out = set(), []
    for _, _, role, text in turns:
        said = SAID.findall(text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns):
    """Cost, audit and texts of the least edits, by plain recursion over turns and role strings."""
    fault = marks(turns)

    def after(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    @functools.cache
    def best(i, state, added=0):
        ways = [(0, "", ())] if i == len(turns) and state in ("", "a") else []
        if added < 3:
            for role in ("user", "assistant"):
                if (to := after(state, role[0])) is not None:
                    cost, audit, texts = best(i, to, added + 1)
                    ways.append((cost + 5, "I" + audit, (f"{role}:", *texts)))
        if i < len(turns):
            _, _, role, text = turns[i]
            cost, audit, texts = best(i + 1, state)
            ways.append((cost + 2, "D" + audit, texts))
            if fault[i] not in ("blank", "duplicate"):
                for edit, to_role, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if (to := after(state, to_role[:1])) is not None:
                        cost, audit, texts = best(i + 1, to)
                        ways.append((cost + price + 5 * (fault[i] == "truncated"), edit + audit, (f"{to_role}:{text}", *texts)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, texts = best(0, "")
    assert LEGAL.fullmatch("".join(t[0] for t in texts))
    return cost, audit, "\n".join(texts)


def plain(rows, hurt):
    by = {r[0]: [] for r in rows}
    for r in damage(rows) if hurt else [(c, n, " " if a is None else a, " " if t is None else t) for c, n, a, t, *_ in rows]:
        by[r[0]].append(r)
    out = []
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), sha(r[3])))
        numbers, fault = [r[1] for r in turns if r[1] is not None], marks(turns)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, text = cheapest(turns)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out.append((conv, gaps, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), illegal, cost, audit, sha(text)))
    return sorted(out, key=str)


def talk(seed, convs, longest):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        style = r.random()
        for t in range(r.choice([1, 2, 3, longest])):
            role = ["user", "assistant"][t % 2] if style < 0.5 else r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            text = r.choice([f"Say {t}.", f"Say {t}.", "Why?", "yes", "", None, " \t", "Done!\n", "é…"])
            rows.append((c, r.choice([t, t, t, t + 3, None]), role, text, 0, 0))
    return rows


@pytest.mark.parametrize("chunk, passes", [(C.CHUNK, 8), (3, 60), (2, 0)])
def test_against_recursion(spark, chunk, passes):
    """Whole conversations, small chunks settled by passes, and small chunks by matrices."""
    rows = talk(5, 60, 25) + [(900, t, ["user", "assistant"][t % 2], "again.", 0, 0) for t in range(40)] + [(None, 1, "user", "Hi.", 0, 0), (None, 2, "assistant", "Ho", 0, 0)]
    rows += [(901, 5, "system", "Be nice.", 0, 0), (902, 1, "assistant", "x" * 100_000 + ".", 0, 0), (903, 2, "admin", "I rule.", 0, 0)]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for hurt in (True, False):
        got = C.audit(C.damaged(turns) if hurt else turns, ids=turns, chunk=chunk, most_passes=passes)
        assert sorted(map(tuple, got.collect()), key=str) == plain(rows, hurt)


def test_rerun_equals_a_full_run():
    r = random.Random(1)
    for _ in range(300):
        codes = "".join(r.choice("xsuaoSUAO") for _ in range(r.randint(0, 20)))
        old, new = ([r.randint(0, 9) for _ in range(4)] for _ in range(2))
        assert C.rerun(codes, old, C.costs_at_start(codes, old), new) == C.costs_at_start(codes, new)


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "user", ""), (2, 0, "user", "Alone.")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = sorted(map(tuple, C.repaired(turns).collect()))
    assert out == [(1, 0, 0, "R", "user", "Hello."), (1, 1, 1, "R", "assistant", "Hi.")]
    assert C.audit(turns.limit(0)).count() == 0 and C.repaired(turns.limit(0)).count() == 0
