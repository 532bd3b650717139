import hashlib
import heapq
import re
import zlib
from array import array
from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thermaweave.llm import repair
from thermaweave.llm.queries import QUERIES


def cheapest(rows):
    """Least (cost, audit) and the repaired turns, by search over edits; rows are (role, text, fault)."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap = [(0, "", 0, ())]
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        last = out[-1][0][:1] if out else ""
        if at == len(rows) and last in ("", "a"):
            return cost, audit, out
        for role in ("user", "assistant"):
            if role[0] in after[last] and not audit.endswith("III"):
                heapq.heappush(heap, (cost + 3, audit + "I", at, out + ((role, ""),)))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, out))
            if fault in ("", "t"):
                stays = cost + 3 * (fault == "t")
                if role[:1] and role[:1] in after[last]:
                    heapq.heappush(heap, (stays, audit + "K", at + 1, out + ((role, text),)))
                for other in ("user", "assistant"):
                    if other[0] in after[last]:
                        heapq.heappush(heap, (stays + 3, audit + "R", at + 1, out + ((other, text),)))


def brute(rows):
    """conv_id to the query's other columns; rows are (conv_id, turn, role, text)."""
    talks: dict = {}
    for key, turn, role, text in rows:
        talk = talks.setdefault(key, [])
        role, text = role or " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        talk += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    out = {}
    for key, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faulty = set(), []
        for _, role, text in talk:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faulty.append((role, text, "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = {t for t, _, _ in talk if t is not None}
        roles = [r[:1] for r, _, _ in faulty]
        cost, audit, kept = cheapest(faulty)
        out[key] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[sum(f == x for _, _, f in faulty) for x in "bdt"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
        )
    return out


def solve(signature):
    automaton = repair.Automaton()
    path, costs = array("i", [automaton.end]), [0]
    for c in reversed(signature):
        made, more = automaton.before(c, path[-1])
        path.append(made)
        costs.append(costs[-1] + more)
    return costs[-1] + automaton.nodes[path[-1]][0][0], automaton.audit(signature, path)


def test_all_short_signatures_against_search():
    rows = {c: ({"s": "system", "u": "user", "a": "assistant", "x": "tool", "-": "user"}[c.lower()], c, "b" if c == "-" else "t" if c.isupper() else "") for c in repair.LETTERS}
    for n in range(4):
        for letters in product(repair.LETTERS, repeat=n):
            assert solve("".join(letters)) == cheapest([rows[c] for c in letters])[:2], letters


@given(st.text("suaxSUAX-", max_size=7))
@settings(max_examples=150, deadline=None)
def test_longer_signatures_against_search(signature):
    rows = {c: ({"s": "system", "u": "user", "a": "assistant", "x": "tool", "-": "user"}[c.lower()], c, "b" if c == "-" else "t" if c.isupper() else "") for c in repair.LETTERS}
    assert solve(signature) == cheapest([rows[c] for c in signature])[:2]


def test_the_automaton_stays_small():
    automaton = repair.Automaton()
    todo = [automaton.end]
    while todo:
        at = todo.pop()
        for letter in repair.LETTERS:
            known = len(automaton.nodes)
            made, _ = automaton.before(letter, at)
            if made == known:
                todo.append(made)
    assert len(automaton.nodes) < 200


def compare(got, rows):
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got.collect()}
    assert found == brute(rows)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compare(QUERIES["op13_conversation_repair"](spark, sf_dir), rows)


def test_edge_rows(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 2, "user", "Hi?"), (1, 3, "assistant", "No end"), (1, 5, "user", None), (2, None, "user", "a."), (2, 1, None, "b!"),
        (None, 1, "user", "x."), (None, None, "assistant", "y."), (3, 0, "", "empty role."), (4, 0, "tool", "\t\r\n"), (5, 7, "user", "q?" + " \n" * 50_000), (5, 7, "user", "q?" + " \n" * 50_000),
        (6, 3, "assistant", "only."), (7, 1, "ünknown", "é."), (8, 2, "user", "same."), (8, 9, "user", "same."), (8, 10, "assistant", "end.\x0b"),
    ] + [(100 + k, t, r, "Text." if t < 2 else "cut") for k in range(60) for t, r in enumerate(("user", "assistant", "user"))]
    talks = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, signature int")
    assert any(zlib.crc32(f"{k}:{t}".encode()) % 20 == 0 for k, t, *_ in rows)
    compare(repair.repair(repair.damage(talks.repartition(5))), rows)
    assert repair.repair(repair.damage(talks.limit(0))).count() == 0
    compare(repair.repair(repair.damage(talks), shared=1), rows)


def test_one_long_conversation_and_one_common_signature(spark):
    long = [(1, t, ("user", "assistant")[t % 2] if t % 11 else "system", "Text %d%s" % (t, "." if t % 5 else "")) for t in range(3000)]
    same = [(10 + k, t, ("user", "assistant")[t], f"Hello {k}.") for k in range(1500) for t in range(2)]
    talks = spark.createDataFrame(long + same, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in repair.repair(repair.intact(talks)).collect()}
    assert len(got) == 1501 and all(got[10 + k].audit == "KK" and got[10 + k].cost == 0 for k in range(1500))
    audit = got[1].audit
    assert len(audit.replace("I", "")) == 3000 and got[1].cost == 3 * (audit.count("I") + audit.count("R")) + 4 * audit.count("D") + 3 * sum(
        e != "D" and t % 5 == 0 for t, e in enumerate(audit.replace("I", "")))


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "One."), (1, 1, "user", "Two."), (1, 2, "assistant", "Three."), (2, 0, "tool", "a")]
    talks = repair.intact(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    plans = repair.plan_repairs(repair.faults(talks))
    got = sorted((r["_id"], r.position, r.role, r.text) for r in repair.repaired(talks, plans).collect())
    assert got == [(1, 0, "user", "One."), (1, 1, "assistant", ""), (1, 2, "user", "Two."), (1, 3, "assistant", "Three.")]
    assert {r["_id"]: (r.cost, r.audit) for r in plans.collect()} == {1: (3, "KIKK"), 2: (4, "D")}
    assert repair.faults(talks).select(F.count("*")).first()[0] == 4
