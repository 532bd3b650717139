"""Repair of conversation structure with an automaton that shares suffixes.

Every row of a conversation becomes one letter of a *signature*: the class of its role (``s``, ``u``, ``a``, or ``x`` for any other),
upper case when the row is truncated, ``-`` when it has to go (blank or duplicate). What the rest of a conversation costs
depends only on the letters still to come and on the state of the role grammar ``(s?(ua)+)?``. So the distinct signatures of all
conversations are dealt and sorted by their *reversed* letters: equal endings then stand next to each other, and the acyclic
word graph of all endings appears in order, one path at a time; signatures that share an ending read it from the path. The graph is minimised
from the end: endings whose costs to go differ by the same amount in all four grammar states, with the same first edits, are one registered node, and
costs and first edit (of the ASCII-least cheapest audit) are worked out once for each node and state. (Each task of the sort registers its own nodes.)
Following the first edits forward gives a signature's audit, and the audit alone determines the repaired roles.

Edits: keep (K, 0), rerole to user or assistant (R, 3), delete (D, 4), insert an empty user or assistant turn (I, 3); a
truncated row that stays adds 3. Two cheapest audits never are a prefix of one another, and from a grammar state a letter has one target, so
ties are settled letter by letter.

Rows of a conversation are streamed in the order (turn, NULLs first; then a digest of the row; then copies), by position alone in one
task: a digest of the repaired text is serial. A task keeps one letter a row, never texts. Signatures that a thousandth of the
conversations share are joined by broadcast (their letters are at most a thousand mean conversations), others by shuffle.

Defined cases: NULL role or text is one space, and so is a NULL in the key of :func:`damage`; NULL ids form one conversation; a conversation
without rows has zeros, an empty audit and the digest of nothing; repeated rows are duplicates; rows of one turn are taken
in the order of a digest of role and text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import map_batches, staged
from ..functions.lineage import cut

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Letter of a row to its role class, whether it is truncated, whether it must go.
LETTERS = {c: (c.lower(), c.isupper(), False) for c in "suaxSUAX"} | {"-": ("", False, True)}
#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a (0 and 3 may end). Next state by role class.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that an inserted or reroled row takes in a state.
FILL = ("user", "user", "assistant", "user")
BLANK = r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
#: Letters of a reversed signature that take part in dealing the signatures to tasks.
DEALT = 256
#: A signature of at least one conversation in so many is broadcast.
SHARED = 1000
INFINITE = 1 << 60



def _with_inserts(base: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Costs and first letters when turns may also be inserted before going on (two at most pay: more come back to a state)."""
    out = []
    for q in range(4):
        once = STEP[q][FILL[q][0]]
        twice = STEP[once][FILL[once][0]]
        out.append(min(base[q], (min(INSERT + base[once][0], 2 * INSERT + base[twice][0]), "I")))
    return out


class Automaton:
    """Minimal nodes of endings, registered from the end.

    A node holds, for each grammar state, the cost to go above the node's least and the first letter of the best audit. Endings
    whose nodes agree in both are one node; their least costs differ by what the edges add up to.
    """

    def __init__(self):
        self.nodes: list[tuple[tuple[int, str], ...]] = []
        self.register: dict[tuple, int] = {}
        self.edges: dict[tuple[str, int], tuple[int, int]] = {}
        self.end, _ = self._node([(0, ""), (INFINITE, ""), (INFINITE, ""), (0, "")])

    def _node(self, base: list[tuple[int, str]]) -> tuple[int, int]:
        """The registered node of these costs, and its least cost."""
        values = _with_inserts(base)
        least = min(cost for cost, _ in values)
        found = tuple((cost - least, edit) for cost, edit in values)
        if found not in self.register:
            self.register[found] = len(self.nodes)
            self.nodes.append(found)
        return self.register[found], least

    def before(self, letter: str, rest: int) -> tuple[int, int]:
        """The node for ``letter`` before the ending ``rest``, and what it adds to the least cost; worked out once."""
        edge = self.edges.get((letter, rest))
        if edge is None:
            role, truncated, must_go = LETTERS[letter]
            ending, stays, base = self.nodes[rest], TRUNCATED if truncated else 0, []
            for q in range(4):
                best = (DELETE + ending[q][0], "D")
                if not must_go:
                    best = min(best, (REROLE + stays + ending[STEP[q][FILL[q][0]]][0], "R"))
                    if role in STEP[q]:
                        best = min(best, (KEEP + stays + ending[STEP[q][role]][0], "K"))
                base.append(best)
            edge = self.edges[letter, rest] = self._node(base)
        return edge

    def audit(self, signature: str, path: array) -> str:
        """The best audit, read along the nodes of a signature (``path[k]`` stands for its last ``k`` letters)."""
        q, at, n, out = 0, 0, len(signature), []
        while edit := self.nodes[path[n - at]][q][1]:
            out.append(edit)
            if edit != "D":
                q = STEP[q][signature[at].lower() if edit == "K" else FILL[q][0]]
            at += edit != "I"
        return "".join(out)


def damage(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows after a fixed damage by crc32 of ``id:turn``; dropped rows stay as markers (``_gone``), so that no conversation is lost."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    rows = conversations.select(
        F.col(id_col).alias("_id"), F.col(turn_col).cast("bigint").alias("_turn"), F.coalesce(F.col(role_col), space).alias("_role"),
        F.coalesce(F.col(text_col), space).alias("_text"), (F.crc32(key) % 20).cast("int").alias("_kind"),
    )
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "_id", "_turn", F.xxhash64("_role", "_text").alias("_tie"), F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role")).alias("_role"), text.alias("_text"),
        (F.col("_kind") == 0).alias("_gone"), F.explode(copies).alias("_copy"),
    )


def intact(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows as they are, in the form of :func:`damage`."""
    space = F.lit(" ")
    role, text = F.coalesce(F.col(role_col), space), F.coalesce(F.col(text_col), space)
    return conversations.select(F.col(id_col).alias("_id"), F.col(turn_col).cast("bigint").alias("_turn"), F.xxhash64(role, text).alias("_tie"), role.alias("_role"), text.alias("_text"), F.lit(False).alias("_gone"), F.lit(0).alias("_copy"))


def faults(rows: DataFrame) -> DataFrame:
    """Each row's letter, role initial and first fault, without its text. Duplicates are found by digest in a shuffle of their own."""
    last = F.right(F.rtrim("_text", F.lit(SPACES)), F.lit(1))
    narrow = rows.select(
        "_id", "_turn", "_tie", "_copy", "_gone", F.md5(F.concat(F.length("_role").cast("string"), F.lit(":"), F.col("_role"), F.col("_text"))).alias("_d"),
        F.substring("_role", 1, 1).alias("_initial"), (~F.col("_text").rlike(BLANK)).alias("_blank"), (~last.isin(".", "!", "?")).alias("_cut"),
    )
    seen = Window.partitionBy("_id", "_d", "_gone").orderBy("_turn", "_tie", "_copy")
    fault = F.when(F.col("_blank"), "b").when(F.row_number().over(seen) > 1, "d").when(F.col("_cut"), "t").otherwise("")
    kind = F.when(F.col("_initial").isin("s", "u", "a"), F.col("_initial")).otherwise("x")
    letter = F.when(F.col("_fault").isin("b", "d"), "-").when(F.col("_fault") == "t", F.upper(kind)).otherwise(kind)
    return narrow.withColumn("_fault", fault).select("_id", "_turn", "_tie", "_copy", "_gone", "_initial", "_fault", letter.alias("_letter"))


def _ordered(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("_id").sortWithinPartitions("_id", *first, "_turn", "_tie", "_copy")


def signatures(faulty: DataFrame) -> DataFrame:
    """A row for each conversation: its signature and counts."""
    names = ("_id", "signature", "gaps", "blank", "duplicate", "truncated", "illegal")
    now: dict = {}

    def close(made):
        if now:
            low, high, turns = now["low"], now["high"], now["turns"]
            counts = now["faults"]
            values = (now["id"], now["letters"].decode("ascii"), high - low + 1 - turns if turns else 0, counts["b"], counts["d"], counts["t"], now["illegal"])
            for c, v in zip(names, values):
                made[c].append(v)

    def rows(batch):
        made: dict[str, list] = {c: [] for c in names}
        for key, turn, gone, initial, fault, letter in zip(*(batch[c] for c in ("_id", "_turn", "_gone", "_initial", "_fault", "_letter"))):
            if not now or key != now["id"]:
                close(made)
                now.update(id=key, letters=bytearray(), low=None, high=None, turns=0, faults={"b": 0, "d": 0, "t": 0, "": 0}, illegal=0, before=None)
            if gone:
                continue
            now["letters"].append(ord(letter))
            now["faults"][fault] += 1
            if now["before"] is not None and now["before"] + initial not in ("su", "ua", "au"):
                now["illegal"] += 1
            now["before"] = initial
            if turn is not None and turn != now["high"]:  # turns come in order
                now["low"] = turn if now["low"] is None else now["low"]
                now["high"], now["turns"] = turn, now["turns"] + 1
        return made

    def flush():
        made: dict[str, list] = {c: [] for c in names}
        close(made)
        return made

    kind = faulty.schema["_id"].dataType.simpleString()
    ordered = _ordered(faulty).select("_id", "_turn", "_gone", "_initial", "_fault", "_letter")
    return map_batches(ordered, rows, f"_id {kind}, signature string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint", flush)


def audits(distinct: DataFrame) -> DataFrame:
    """Cost, best audit and newly made automaton nodes of distinct signatures."""
    ending = F.reverse("signature")
    dealt = distinct.select("signature", ending.alias("_ending"), F.substring(ending, 1, DEALT).alias("_short"), F.xxhash64(ending).alias("_rest"))
    ordered = dealt.repartitionByRange("_short", "_rest").sortWithinPartitions("_ending").select("signature", "_ending")
    automaton = Automaton()
    before, path, costs = [""], array("i", [automaton.end]), array("q", [0])

    def rows(batch):
        made: dict[str, list] = {c: [] for c in ("signature", "cost", "audit", "nodes_made")}
        for signature, letters in zip(batch["signature"], batch["_ending"]):
            shared = _shared(before[0], letters)
            del path[shared + 1 :], costs[shared + 1 :]
            for c in letters[shared:]:
                made_node, more = automaton.before(c, path[-1])
                path.append(made_node)
                costs.append(costs[-1] + more)
            before[0] = letters
            cost = costs[-1] + automaton.nodes[path[-1]][0][0]
            for c, v in zip(made, (signature, cost, automaton.audit(signature, path), len(letters) - shared)):
                made[c].append(v)
        return made

    return map_batches(ordered, rows, "signature string, cost bigint, audit string, nodes_made bigint")


def _shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = (np.frombuffer(s[:n].encode("ascii"), np.uint8) for s in (a, b))
    return int(np.argmin(x == y))


def plan_repairs(faulty: DataFrame, shared: int = SHARED) -> DataFrame:
    """Each conversation's counts, cost and audit."""
    seen = Observation()
    talks = staged(signatures(faulty).observe(seen, F.count(F.lit(1)).alias("n")), "signatures")
    total = int(seen.get.get("n") or 0)
    counted = staged(talks.groupBy("signature").agg(F.count(F.lit(1)).alias("_n")), "distinct")
    solved = staged(audits(counted.select("signature")), "audits")
    often = counted.where(F.col("_n") * shared >= total).select("signature")  # ``shared`` rows at most
    common = F.broadcast(cut(solved.join(F.broadcast(often), "signature")))
    rare = talks.join(common, "signature", "left_anti").join(solved, "signature")
    return talks.join(common, "signature").unionByName(rare)


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Repaired turns in order, a row each: id, position, role, text. ``rows`` as from :func:`damage`."""
    return _stream(rows, plans, False)


def repair(rows: DataFrame, shared: int = SHARED, id_col: str = "conv_id") -> DataFrame:
    """What was found and mended in each conversation, with the digest of its repaired turns. ``rows`` as from :func:`damage`."""
    rows = staged(rows, "rows")
    plans = staged(plan_repairs(faults(rows), shared), "repairs")
    return _stream(rows, plans, True).withColumnRenamed("_id", id_col)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _stream(rows: DataFrame, plans: DataFrame, digests: bool) -> DataFrame:
    kind = rows.schema["_id"].dataType.simpleString()
    blank = {c: F.lit(None).cast("string" if c == "audit" else "bigint").alias(c) for c in _COUNTS}
    heads = plans.select("_id", F.lit(0).alias("_part"), *[F.lit(None).cast(t).alias(c) for c, t in (("_turn", "bigint"), ("_tie", "bigint"), ("_copy", "int"), ("_role", "string"), ("_text", "string"))], *_COUNTS)
    body = rows.where(~F.col("_gone")).select("_id", F.lit(1).alias("_part"), "_turn", "_tie", "_copy", "_role", "_text", *blank.values())
    ordered = _ordered(heads.unionByName(body), "_part")
    names = ("_id", *_COUNTS, "repaired_sha256") if digests else ("_id", "position", "role", "text")
    now: dict = {}

    def write(made, role, text):
        now["q"] = STEP[now["q"]][role[0]]
        if digests:
            now["sha"].update((("\n" if now["n"] else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        else:
            for c, v in zip(names, (now["id"], now["n"], role, text)):
                made[c].append(v)
        now["n"] += 1

    def inserts(made):
        audit = now["audit"]
        while now["at"] < len(audit) and audit[now["at"]] == "I":
            now["at"] += 1
            write(made, FILL[now["q"]], "")

    def close(made):
        if now:
            inserts(made)
            if digests:
                for c, v in zip(names, (now["id"], *now["counts"], now["sha"].hexdigest())):
                    made[c].append(v)

    def run(batch):
        made: dict[str, list] = {c: [] for c in names}
        for k, (key, part, role, text) in enumerate(zip(batch["_id"], batch["_part"], batch["_role"], batch["_text"])):
            if part == 0:
                close(made)
                now.update(id=key, q=0, at=0, n=0, audit=batch["audit"][k], counts=[batch[c][k] for c in _COUNTS], sha=hashlib.sha256())
                continue
            inserts(made)
            edit = now["audit"][now["at"]]
            now["at"] += 1
            if edit == "K":
                write(made, role, text)
            elif edit == "R":
                write(made, FILL[now["q"]], text)
        return made

    def flush():
        made: dict[str, list] = {c: [] for c in names}
        close(made)
        return made

    counts = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    return map_batches(ordered, run, f"_id {kind}, " + (counts if digests else "position bigint, role string, text string"), flush)
