"""Secret scans: three fixed patterns, and the guess cost of values in a credential context.

Fixed patterns: an assignment to a credential name, an access key id, a long run of hex digits.
The method looks at every value that stands after a credential name (``pwd: ...``, ``passphrase is ...``, also
with characters that the fixed patterns do not take) and finds, by dynamic programming, the cheapest way to guess it:
a segmentation into dictionary words, dates, repeats, keyboard or alphabet walks and brute-force
characters, each with its number of guesses. A brute-force character costs the size of its own class (26 letters of a case,
10 digits, 33 others). Costs are log10 of guesses; each segment also costs a factor
of two for its place. A value of ``least_cost`` or more is a secret, whatever its form; ``changeme2020``,
``qwertyuiop111`` or a word that the dictionary knows are not. The dictionary is the corpus's own: its ``DICTIONARY`` most frequent words, counted over all whole texts.

Spans are code points, end exclusive. A value inside a fixed pattern's span adds nothing.

Defined cases: a NULL text is empty and has no span; NULL and repeated ids are kept, one result row for
each input row; an empty table gives an empty result; other columns are ignored (:func:`scan`) or kept (:func:`redact`).
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, most_frequent, staged

KINDS = ("assign", "access", "hex", "guess")
LEAST_COST = 8.0
#: Ranked words that the guesser knows (a few hundred kilobytes on every task).
DICTIONARY = 30_000
#: Distinct words that a task counts before it passes its counts on.
COUNTED = 300_000
MARK = "[SECRET]"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The base patterns.
ASSIGN = re.compile("(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")  # AKIA[A-Z0-9]+ of 20 or more
HEX = re.compile("[0-9a-f]{24,}")  # [0-9a-f]+ of 24 or more
# The method's context: a credential name, a mark of assignment, a value up to white space or a quote.
NAMES = ("password", "passwd", "passphrase", "passcode", "pass", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "accesskey", "private_key", "credentials", "credential", "auth", "bearer")
CONTEXT = re.compile("(?:" + "|".join(map(_any_case, NAMES)) + r""")["']?[ \t]{0,8}(?::=|=>|[:=]|[iI][sS][ \t])[ \t]{0,8}["'`]?([^\s"'`]{6,})""")
TRAILING = ".,;:!?)]}>|*%&$#"

ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@48301!57$", "aabeoliszs"[:10])
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")
LONGEST_WORD = 24


def _steps() -> set[str]:
    """Pairs of characters next to each other on the keyboard, in the alphabet or in the digits, both ways."""
    pairs = set()
    for r, row in enumerate(ROWS):
        pairs.update(zip(row, row[1:]))
        if r + 1 < len(ROWS):
            below = ROWS[r + 1]
            pairs.update((c, below[k + d]) for k, c in enumerate(row) for d in (-1, 0) if 0 <= k + d < len(below))
    for run in ("abcdefghijklmnopqrstuvwxyz", "0123456789"):
        pairs.update(zip(run, run[1:]))
    return {a + b for a, b in pairs} | {b + a for a, b in pairs}


STEPS = _steps()
SEGMENT = math.log10(2)
LETTER, DIGIT, OTHER = math.log10(26), 1.0, math.log10(33)


def guess_cost(value: str, ranks: dict[str, int]) -> float:
    """log10 of the guesses for the cheapest segmentation of the whole value."""
    n, low = len(value), value.lower()
    if len(low) != n:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    leet = low.translate(LEET)
    ends: dict[int, list[tuple[int, float]]] = {}
    for at in range(n):  # dates that start here
        for m in (DATE.match(value, at),):
            if m:
                ends.setdefault(m.end(), []).append((at, math.log10(119) if m.end() - at == 4 else math.log10(365 * 119)))
    same = [[0] * (n + 1) for _ in range(5)]  # for each period, how long the text has repeated itself
    walk = [1] * (n + 1)
    best, brute = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
    for i in range(1, n + 1):
        c = low[i - 1]
        # A brute-force character goes on a brute-force segment or starts one.
        brute[i] = min(brute[i - 1], best[i - 1] + SEGMENT) + (LETTER if c.isalpha() else DIGIT if c.isdigit() else OTHER)
        found = brute[i]
        for length in range(3, min(i, LONGEST_WORD) + 1):
            j = i - length
            rank = ranks.get(low[j:i])
            cost = math.log10(rank) if rank else math.inf
            rank = ranks.get(leet[j:i])
            if rank:
                cost = min(cost, math.log10(rank) + (leet[j:i] != low[j:i]) * SEGMENT)
            if cost < math.inf:
                part = value[j:i]
                capitals = sum(x != y for x, y in zip(part, low[j:i]))
                cost += 0 if not capitals else SEGMENT if capitals in (length, 1) else capitals * SEGMENT
                found = min(found, best[j] + SEGMENT + cost)
        for j, cost in ends.get(i, ()):
            found = min(found, best[j] + SEGMENT + cost)
        for period in range(1, 5):
            if i > period and low[i - 1] == low[i - 1 - period]:
                same[period][i] = same[period][i - 1] + 1
                times = same[period][i] // period + 1
                if times >= (3 if period == 1 else 2):
                    found = min(found, best[i - times * period] + SEGMENT + period * 1.0 + math.log10(times))
        if i > 1 and low[i - 2] + c in STEPS:
            walk[i] = walk[i - 1] + 1
            if walk[i] >= 3:
                found = min(found, best[i - walk[i]] + SEGMENT + math.log10(47 * walk[i]))
        best[i] = found
    return best[n]


def spans(text: str | None, ranks: dict[str, int], least_cost: float = LEAST_COST) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value), in order of start, then of kind."""
    if not text:
        return []
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    base = sorted(found)
    for m in CONTEXT.finditer(text):
        start, value = m.start(1), m[1].rstrip(TRAILING)
        end = start + len(value)
        if len(value) < 6 or any(s <= start and end <= e for s, _, e, _ in base):
            continue
        if guess_cost(value, ranks) >= least_cost:
            found.append((start, 3, end, start))
    return sorted(found)


def ranked_words(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY) -> dict[str, int]:
    """The most frequent words of three or more letters over all whole texts, with their ranks (ties by the word)."""
    held: Counter = Counter()

    def take() -> dict[str, list]:
        kept = [(w, n) for w, n in held.items() if 3 <= len(w) <= LONGEST_WORD and w.isalpha()]
        held.clear()
        return {"word": [w for w, _ in kept], "n": [n for _, n in kept]}

    def rows(batch):
        for t in batch["_text"]:
            if t:
                held.update(t.lower().split())
        return take() if len(held) > COUNTED else {"word": [], "n": []}

    counted = map_batches(docs.select(F.col(text_col).alias("_text")), rows, "word string, n bigint", take)
    total = staged(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    top = most_frequent(total, "word", "n", most).collect()
    return {r.word: k for k, r in enumerate(top, 1)}


def scan(docs: DataFrame, ranks: dict[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text", least_cost: float = LEAST_COST) -> DataFrame:
    """id and spans (array of kind, start, end, in order) of each whole text."""
    ranks = ranked_words(docs, text_col) if ranks is None else ranks
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def rows(batch):
        found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e, _ in spans(t, sent.value, least_cost)] for t in batch["_text"]]
        return {"_id": batch["_id"], "spans": found}

    kind = docs.schema[id_col].dataType.simpleString()
    made = map_batches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), rows, f"_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")
    return made.withColumnRenamed("_id", id_col)


def hide(text: str, found: list[tuple[int, int, int, int]], mark: str = MARK) -> str:
    """The text with every secret's value replaced by ``mark``."""
    out, at = [], 0
    for start, end in sorted((v, e) for _, _, e, v in found):
        if end > at:
            if start >= at:
                out += [text[at:start], mark]
            at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, ranks: dict[str, int] | None = None, text_col: str = "text", least_cost: float = LEAST_COST) -> DataFrame:
    """``docs`` with the values of all secrets replaced in its texts; all rows and columns stay."""
    ranks = ranked_words(docs, text_col) if ranks is None else ranks
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def rows(batch):
        batch[text_col] = [t and hide(t, spans(t, sent.value, least_cost)) for t in batch[text_col]]
        return batch

    return map_batches(docs, rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the base spans' digest and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    text = lambda spans_: F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        id_col, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), count("guess").alias("n_guess"),
    )
