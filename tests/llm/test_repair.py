import hashlib
import random
import re
from zlib import crc32

import pytest

from asofkit.llm import repair

END = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(c, t, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1)
    return out


def plain(rows):
    """Report of one conversation (rows after damage), by walking every state with the best (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = re.findall(r"[^\x20\x09-\x0d]", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

    def nexts(state, ch):
        """Roles so far are '', 's', '..u' or '..a'."""
        return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(ch)

    def grown(best):  # inserts, to a fixed point
        todo = list(best)
        while todo:
            s = todo.pop()
            cost, audit, lines = best[s]
            for ch, name in (("u", "user"), ("a", "assistant")):
                t = nexts(s, ch)
                if t and (t not in best or (cost + 5, audit + "I") < best[t][:2]):
                    best[t] = (cost + 5, audit + "I", [*lines, name + ":"])
                    todo.append(t)
        return best

    best = grown({"": (0, "", [])})
    for (_, _, role, text), fault in zip(rows, faults):
        new = {}

        def offer(t, cost, audit, lines):
            if t is not None and (t not in new or (cost, audit) < new[t][:2]):
                new[t] = (cost, audit, lines)

        late = 5 if fault == "truncated" else 0
        for s, (cost, audit, lines) in best.items():
            offer(s, cost + 2, audit + "D", lines)
            if fault in (None, "truncated"):
                if role[:1] in ("s", "u", "a"):
                    offer(nexts(s, role[:1]), cost + late, audit + "K", [*lines, f"{role}:{text}"])
                for ch, name in (("u", "user"), ("a", "assistant")):
                    offer(nexts(s, ch), cost + 1 + late, audit + "R", [*lines, f"{name}:{text}"])
        best = grown(new)
    cost, audit, lines = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
    assert END.match("".join(x[:1] for x in lines))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def run(spark, rows, bits, harm=True):
    df = repair.keyed(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = repair.repaired(repair.damaged(df) if harm else df, df.select("conv", "conv_id").distinct(), bits).collect()
    return {r[0]: tuple(r)[1:] for r in got}


def check(spark, rows, bits, harm=True):
    groups = {r[0]: [] for r in rows}
    for r in damage(rows) if harm else [(c, t, " " if a is None else a, " " if b is None else b) for c, t, a, b in rows]:
        groups[r[0]].append(r)
    got = run(spark, rows, bits, harm)
    want = {c: plain(g) for c, g in groups.items()}
    assert got == want, next((c, got.get(c), want[c]) for c in want if got.get(c) != want[c])


def made(r, convs, longest):
    roles = ["user", "assistant", "system", "u", "", "tool", None, "assistant", "user"]
    texts = ["Yes.", "no", "", None, " \t", "A? ", "long text! " * 50, "ü", "Yes."]
    rows = []
    for c in range(convs):
        n = r.randint(1, longest)
        if r.random() < 0.4:
            rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(n)]
        else:
            rows += [(c, r.choice([None, t, t + r.randint(0, 3)]), r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"t{r.randint(0, 999)}{r.choice(['.', ''])}") for t in range(n)]
    return rows


@pytest.mark.parametrize("bits", [1, 3, 13])
def test_against_plain_version(spark, bits):
    check(spark, made(random.Random(bits), 60, 9), bits)


def test_one_long_conversation_over_many_blocks(spark):
    r = random.Random(9)
    rows = [(1, t, r.choice(["user", "assistant", "system", "x"]), r.choice(["a.", "b", f"{t}.", f"{t}."])) for t in range(700)] + [(0, 0, "user", "x."), (2, 0, "user", "x.")]
    check(spark, rows, 3, harm=False)


def test_cases(spark):
    check(spark, [(None, None, None, None), (None, 3, "user", "Hi."), (4, 1, "assistant", "z" * 300000), (4, 1, "assistant", "z" * 300000), (4, 2, "user", "ok.")], 13, harm=False)
    gone = next(i for i in range(1000) if crc32(f"{i}:0".encode()) % 20 == 0)
    empty = hashlib.sha256().hexdigest()
    assert run(spark, [(gone, 0, "user", "x")], 13) == {gone: (0, 0, 0, 0, 0, 0, "", empty)}
    assert run(spark, [], 13) == {}


def test_query(spark):
    from asofkit.llm.queries import op11_least_audit_repair

    sf = "/root/testdata/sf0.001"
    groups = {}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    for r in rows:
        groups.setdefault(r[0], [])
    for r in damage(rows):
        groups[r[0]].append(r)
    got = {r[0]: tuple(r)[1:] for r in op11_least_audit_repair(spark, sf).collect()}
    assert got == {c: plain(g) for c, g in groups.items()}
