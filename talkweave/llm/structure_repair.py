"""Conversation structure repair: cheapest edits by a min-plus dynamic program over a Re-Pair grammar of role and fault symbols.

Every row is a symbol: the initial of its role where it can stand (s, u, a; o for others), in capitals if its text is
truncated, or D if it must go. A conversation's output has to read ``(s?(ua)+)?`` in initials, which four
states recognise. A symbol is a 4 x 4 matrix of the least costs between states; so is a rule of the grammar, the
product of its two symbols' matrices, with a rope of edits that points into theirs. Matrices are made once for the
grammar, bottom-up, and shared by all conversations.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.llm.common import discard, few_or_shuffled, saved

STATES = range(4)  # nothing yet, after s, after u, after a
_SPACES = " \t\n\x0b\x0c\r"
_KEEP, _REROLE, _DELETE, _INSERT, _TRUNCATED = 0, 2, 3, 2, 1
_FIRST_RULE = 0x100
_SHORT = 256
SYMBOLS = "suaoSUAOD"


def _put(state: int) -> int:
    """The state after the row that may follow: an assistant's after a user's, else a user's."""
    return 3 if state == 2 else 2


@dataclass
class Matrix:
    """cost[p][q]: least cost from state p to q, or None; rank[p][q]: place of its edits among those from p, in ASCII order.

    Edits from the same state to different ones always differ before either ends: a state follows from the edits, and each
    ends with a row's own edit. So ranks decide ties without looking at the edits. mid[p][q]: of a rule, the state
    between its halves; edits[p][q]: of a symbol, its edits.
    """

    cost: list = field(default_factory=lambda: [[None] * 4 for _ in STATES])
    rank: list = field(default_factory=lambda: [[0] * 4 for _ in STATES])
    mid: list = field(default_factory=lambda: [[0] * 4 for _ in STATES])
    edits: list | None = None


def symbol_matrix(symbol: str) -> Matrix:
    """The matrix of one row, with the insertions in front of it."""
    m = Matrix(edits=[[None] * 4 for _ in STATES])
    late = _TRUNCATED if symbol in "SUAO" else 0
    for p in STATES:
        best: dict[int, tuple[int, str]] = {}
        r, before = p, 0
        for _ in range(3):  # at most two insertions: a third one would only come back to a state
            options = [(_DELETE, "D", r)]
            if symbol != "D":
                options.append((_REROLE + late, "R", _put(r)))
                fits = {"s": r == 0, "u": r != 2, "a": r == 2}.get(symbol.lower(), False)
                if fits:
                    options.append((_KEEP + late, "K", 1 if symbol.lower() == "s" else _put(r)))
            for cost, edit, q in options:
                found = (before * _INSERT + cost, "I" * before + edit)
                best[q] = min(best.get(q, found), found)
            r, before = _put(r), before + 1
        order = sorted(best, key=lambda q: best[q][1])
        for q, (cost, edits) in best.items():
            m.cost[p][q], m.edits[p][q], m.rank[p][q] = cost, edits, order.index(q)
    return m


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product; ties go to the edits that are least in ASCII order."""
    m = Matrix()
    for p in STATES:
        key = {}
        for q in STATES:
            ways = [(a.cost[p][r] + b.cost[r][q], a.rank[p][r], r) for r in STATES if a.cost[p][r] is not None and b.cost[r][q] is not None]
            if ways:
                m.cost[p][q], first, m.mid[p][q] = min(ways)
                key[q] = (first, b.rank[m.mid[p][q]][q])
        for place, q in enumerate(sorted(key, key=key.get)):
            m.rank[p][q] = place
    return m


class Grammar:
    """Rules (pairs of symbols, in the order they were made) with their matrices and ropes."""

    def __init__(self, rules: list[str]):
        self.rules = rules
        self.matrices = {s: symbol_matrix(s) for s in SYMBOLS}
        self.halves = {chr(_FIRST_RULE + k): (pair[0], pair[1]) for k, pair in enumerate(rules)}
        for s, (a, b) in self.halves.items():
            self.matrices[s] = product(self.matrices[a], self.matrices[b])
        self._short: dict[tuple, str] = {}

    def compress(self, text: str) -> str:
        """Sequences, separated by line ends, with every rule's pair replaced in turn."""
        for s, (a, b) in self.halves.items():
            text = text.replace(a + b, s)
        return text

    def edits(self, symbol: str, p: int, q: int) -> str:
        """A rope written out: children are looked up, short ones are kept."""
        out, todo = [], [(symbol, p, q)]
        while todo:
            at = todo.pop()
            s, i, j = at
            m = self.matrices[s]
            if m.edits:
                out.append(m.edits[i][j])
            elif at in self._short:
                out.append(self._short[at])
            else:
                (a, b), r = self.halves[s], m.mid[i][j]
                todo += [(b, r, j), (a, i, r)]
        text = "".join(out)
        if len(text) <= _SHORT:
            self._short[symbol, p, q] = text
        return text

    def repair(self, compressed: str) -> tuple[int, str]:
        """(cost, edits) of a compressed sequence: one row vector goes through its matrices."""
        at, steps = {0: (0, 0)}, []
        for s in compressed:
            m, now, key = self.matrices[s], {}, {}
            for q in STATES:
                ways = [(cost + m.cost[r][q], rank, r) for r, (cost, rank) in at.items() if m.cost[r][q] is not None]
                if ways:
                    cost, rank, r = min(ways)
                    now[q], key[q] = (cost, r), (rank, m.rank[r][q])
            steps.append({q: r for q, (_, r) in now.items()})
            at = {q: (now[q][0], place) for place, q in enumerate(sorted(key, key=key.get))}
        ends = {0: 0, 1: 2, 2: 1, 3: 0}  # insertions that lead to an end
        cost, _, q = min((cost + _INSERT * ends[q], rank, q) for q, (cost, rank) in at.items())
        parts = ["I" * ends[q]]
        for s, back in zip(reversed(compressed), reversed(steps)):
            parts.append(self.edits(s, back[q], q))
            q = back[q]
        return cost, "".join(reversed(parts))


def _count_pairs(rules: list[str]):
    """(pair, n): pairs that follow each other in weighted sequences once the rules are applied; runs of one symbol count every second place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar, n = Grammar(rules), Counter()
        for b in batches:
            for seq, weight in zip(grammar.compress("\n".join(b["seq"])).split("\n"), b["weight"]):
                last = -2
                for k in range(len(seq) - 1):
                    if seq[k] == seq[k + 1] and last == k - 1 and seq[k - 1] == seq[k]:
                        continue
                    n[seq[k : k + 2]] += weight
                    last = k
        yield pd.DataFrame(list(n.items()), columns=["pair", "n"])

    return run


def _independent(pairs: list[str]) -> list[str]:
    """Of pairs by falling count, those that can be replaced at once: none begins with what another one ends with."""
    first, second, out = set(), set(), []
    for p in pairs:
        if p[0] in second or p[1] in first or (p[0] == p[1] and (p[0] in first or p[1] in second)):
            continue
        first.add(p[0])
        second.add(p[1])
        out.append(p)
    return out


def re_pair(sequences: DataFrame, most_rules: int = 1024, least: int = 2, at_once: int = 256) -> Grammar:
    """The grammar of (seq, weight): the most frequent pair of symbols becomes a rule, over and over.

    A round counts pairs in tasks and then by Spark and takes, by falling count, all that don't touch each other, so their
    counts hold when all are replaced. It ends when no pair comes ``least`` times or ``most_rules`` rules are made:
    that bounds what driver and tasks hold, whatever the data, and only leaves sequences longer.
    """
    rules: list[str] = []
    while len(rules) < most_rules:
        counts = sequences.mapInPandas(_count_pairs(rules), "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        top = [r.pair for r in counts.where(F.col("n") >= least).orderBy(F.desc("n"), "pair").limit(at_once).collect()]
        new = _independent(top)[: most_rules - len(rules)]
        if not new:
            break
        rules += new
    return Grammar(rules)


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turn, role, text, copies): rows damaged by crc32(``id:turn``) mod 20; nulls in these and in role and text are one space.

    0 drops a row (copies 0), 1 empties its text, 2 takes out its ``.!?``, 3 repeats it (copies 2), 4 makes it a user's.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(shown(id_col), F.lit(":"), shown(turn_col)).cast("binary")), F.lit(20))
    text = shown(text_col)
    return rows.select(
        F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.when(code == 4, "user").otherwise(shown(role_col)).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with k, a key that is never null, and 128 bits of the text."""
    k = F.when(F.col("id").isNull(), "").otherwise(F.concat(F.lit("+"), F.col("id").cast("string")))
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        k.alias("k"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"),
        "copies", text.alias("text"),
    )


_ORDER = ("turn", "role", "h1", "h2")


def _by_place() -> list[Column]:
    return ["k", F.asc_nulls_first("turn"), "role", "h1", "h2"]


def faults(rows: DataFrame) -> DataFrame:
    """(k, turn, role, h1, h2, n, blank, truncated, seen): a row for all equal rows of a turn, stored; seen: role and text came at an earlier turn.

    First places of texts are aggregated and joined, so a text that comes at very many turns is no task of its own.
    """
    bare = F.rtrim(F.col("text"), F.lit(_SPACES))
    facts = rows.select("k", *_ORDER, "copies", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    each = saved(facts.groupBy("k", *_ORDER).agg(F.sum("copies").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated")), "rows")
    turn = F.struct(F.col("turn").isNotNull(), "turn")
    first = each.where("n > 0").groupBy("k", "role", "h1", "h2").agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    marked = each.join(few_or_shuffled(first), ["k", "role", "h1", "h2"], "left").withColumn("seen", F.coalesce(turn > F.col("first"), F.lit(False)))
    out = saved(marked.select("k", *_ORDER, "n", "blank", "truncated", "seen"), "faults")
    discard(each)
    return out


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(k, part, symbols, illegal, first, last): what a task has of each conversation, from sorted rows."""
    part, key, held = TaskContext.get().partitionId(), None, None
    columns = ["k", "part", "symbols", "illegal", "first", "last"]

    def row():
        return key, part, "".join(held[0]), held[1], held[2], held[3]

    for b in batches:
        out = []
        for k, role, n, gone, late in zip(b["k"], b["role"], b["n"], b["gone"], b["truncated"]):
            initial = role[:1]
            if k != key:
                if held:
                    out.append(row())
                key, held = k, [[], 0, initial, initial]
            elif held[3] + initial not in ("su", "ua", "au"):
                held[1] += 1
            symbol = "D" if gone else initial if initial in ("s", "u", "a") else "o"
            held[0].append(symbol.upper() if late else symbol)
            if n > 1:
                held[0].append("D" * (n - 1))
                held[1] += n - 1
            held[3] = initial
        yield pd.DataFrame(out, columns=columns)
    if held:
        yield pd.DataFrame([row()], columns=columns)


def sequences(marked: DataFrame) -> DataFrame:
    """(k, seq, illegal): the symbols of each conversation's rows in order, and how many neighbours' initials don't fit.

    Rows are dealt by ranges of (conversation, place), so a conversation of very many rows is the work of several tasks.
    """
    rows = marked.where("n > 0").select("k", *_ORDER, "n", (F.col("blank") | F.col("seen")).alias("gone"), "truncated")
    pieces = rows.repartitionByRange(*_by_place()).sortWithinPartitions(*_by_place()).mapInPandas(_pieces, "k string, part int, symbols string, illegal long, first string, last string")
    whole = pieces.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("part", "symbols", "illegal", "first", "last"))).alias("p"))
    pairs = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p")), lambda a, b: F.concat(a["last"], b["first"]))
    wrong = F.size(F.filter(pairs, lambda x: ~x.isin("su", "ua", "au")))
    inside = F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["illegal"])
    return whole.select("k", F.array_join(F.transform("p", lambda x: x["symbols"]), "").alias("seq"), (inside + wrong).alias("illegal"))


def _repairs(rules: list[str], carried: list[str]):
    """Adds cost and audit to rows with seq; equal sequences of a batch are repaired once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(rules)
        for b in batches:
            different = list(dict.fromkeys(b["seq"]))
            known = dict(zip(different, map(grammar.repair, grammar.compress("\n".join(different)).split("\n"))))
            found = [known[s] for s in b["seq"]]
            yield b[carried].assign(cost=[f[0] for f in found], audit=[f[1] for f in found])

    return run


class _Writer:
    """The digest of a repaired conversation, from its edits and rows in order; nothing but the place among the edits is kept."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.some = audit, 0, 0, hashlib.sha256(), False

    def _line(self, role: str, text: str, state: int) -> None:
        self.sha.update(("\n" * self.some + role + ":" + text).encode())
        self.some, self.state = True, state

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._line("assistant" if self.state == 2 else "user", "", _put(self.state))
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self._line(role, text, 1 if role[0] == "s" else _put(self.state))
        elif edit == "R":
            self._line("assistant" if self.state == 2 else "user", text, _put(self.state))

    def end(self) -> str:
        self._inserted()
        return self.sha.hexdigest()


_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, numbers, audit, repaired_sha256) from sorted rows: a conversation's numbers and edits come first, then its rows."""
    names, writer, head = ["k", *_NUMBERS, "audit", "repaired_sha256"], None, None
    for b in batches:
        out = []
        for r in zip(*(b.column(c).to_pylist() for c in ("head", "k", "role", "text", "copies", "audit", *_NUMBERS))):
            if r[0]:
                if writer:
                    out.append((*head, writer.end()))
                head, writer = (r[1], *r[6:], r[5]), _Writer(r[5])
            else:
                for _ in range(r[4]):
                    writer.row(r[2], r[3])
        yield _digest_batch(out, names)
    yield _digest_batch([(*head, writer.end())] if writer else [], names)


def _digest_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.string(), *[pa.int64()] * len(_NUMBERS), pa.string(), pa.string()]
    columns = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def repair_conversations(rows: DataFrame, most_rules: int = 1024) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row for each id; rows: (id, turn, role, text, copies).

    Rows stand by turn (nulls first), then role and a hash of the text. copies: how many times a row stands there; 0 only
    names its conversation. A row's first fault counts: blank, duplicate (role and text came before), truncated (its last
    character other than spaces isn't one of ``.!?``). audit: the initials of the cheapest edits in order (Keep, Rerole, Delete, Insert),
    the least in ASCII order of equally cheap ones. Conversations without rows have zeros, an empty audit and the empty
    string's hash. Null ids are one conversation; null roles and texts are empty; turns are whole numbers. No rows give no rows.

    Symbols are gathered by ranges of places, and a grammar of all conversations' sequences gives matrices that
    every task shares. The last pass hands texts to the task of their conversation, which streams over them and
    their edits: a SHA-256 is made from front to back, so this pass isn't split within a conversation.
    """
    types = f"k string, {', '.join(f'{c} long' for c in _NUMBERS)}, audit string, repaired_sha256 string"
    keyed = _keyed(rows)
    marked = faults(keyed)
    there, late = F.col("n") > 0, F.col("truncated") & ~F.col("blank") & ~F.col("seen")
    twice = F.when(F.col("blank"), 0).when(F.col("seen"), F.col("n")).otherwise(F.col("n") - 1)
    zero = F.lit(0).cast("long")
    counts = marked.groupBy("k").agg(
        F.coalesce(F.sum(F.when(there & F.col("blank"), F.col("n"))), zero).alias("blank"), F.coalesce(F.sum(F.when(there, twice)), zero).alias("duplicate"),
        F.coalesce(F.sum(F.when(there & late, 1)), zero).alias("truncated"),
    )
    turns = marked.where(there & F.col("turn").isNotNull()).select("k", "turn").distinct().groupBy("k").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    seqs = counts.join(sequences(marked), "k", "left").join(turns, "k", "left")
    seqs = saved(seqs.select("k", F.coalesce("gaps", zero).alias("gaps"), "blank", "duplicate", "truncated", F.coalesce("illegal", zero).alias("illegal"), F.coalesce("seq", F.lit("")).alias("seq")), "sequences")
    different = saved(seqs.where("seq <> ''").groupBy("seq").agg(F.count(F.lit(1)).alias("weight")), "different")
    grammar = re_pair(different, most_rules)
    carried = ["k", *_NUMBERS[:-1]]
    edits = seqs.mapInPandas(_repairs(grammar.rules, carried), f"k string, {', '.join(f'{c} long' for c in _NUMBERS)}, audit string")
    heads = edits.withColumn("head", F.lit(True))
    both = heads.unionByName(keyed.where("copies > 0").withColumn("head", F.lit(False)), allowMissingColumns=True)
    out = both.repartition("k").sortWithinPartitions("k", F.desc("head"), *_by_place()[1:]).mapInArrow(_digests, types)
    out = saved(out.select(F.when(F.col("k") != "", F.substr("k", F.lit(2))).cast(rows.schema["id"].dataType).alias("id"), *_NUMBERS, "audit", "repaired_sha256"), "repaired")
    for t in (marked, seqs, different):
        discard(t)
    return out
