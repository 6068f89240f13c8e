"""Faults of conversations, and the cheapest edits that mend them.

A sound conversation is empty, or a system turn or none and then pairs of a user's and an assistant's turn. A dynamic program
over the turns keeps the cheapest edits for each of four states; among equally cheap ones the letters of the edits decide, the
least in ASCII. Prefixes of edits are linked nodes that later ones share, with ancestors at powers of two and a rolling hash:
two candidates are compared at the end of their longest common prefix, which a descent along the ancestors finds.

Two candidates for one state have taken the same turns at the same cost, and letters and turns say the cost. So neither is
a prefix of the other, and what follows can't change their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import WHITE, batched, rows_of

#: Costs of the edits; a turn that stays truncated adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after a system turn, after a user's, after an assistant's. The first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: States from which a turn of a role may follow, and the state after it.
_FROM = {"s": (START,), "u": (START, SYSTEM, ASSISTANT), "a": (USER,)}
_TO = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Turns, and characters of their texts, after which edits that all candidates share are handed on.
COMMIT_TURNS, COMMIT_CHARS = 512, 4 << 20
#: A prime and a base of rolling hashes.
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79


class Edits:
    """Prefixes of edits as linked nodes: letter, state after it, rolling hash, and the ancestors 1, 2, 4, ... edits before."""

    __slots__ = ("letter", "state", "hash", "depth", "up")

    def __init__(self, parent: Edits | None, letter: str, state: int):
        self.letter, self.state = letter, state
        if parent is None:
            self.hash, self.depth, self.up = 0, 0, ()
            return
        self.hash, self.depth = (parent.hash * _BASE + ord(letter)) % _PRIME, parent.depth + 1
        up, k = [parent], 0
        while k < len(up[k].up):
            up.append(up[k].up[k])
            k += 1
        self.up = tuple(up)

    def ancestor(self, depth: int) -> Edits:
        node, back = self, self.depth - depth
        while back:
            k = back.bit_length() - 1
            node, back = node.up[k], back - (1 << k)
        return node


def _first_unlike(a: Edits, b: Edits) -> tuple[Edits, Edits] | None:
    """The nodes of two prefixes of one length at the first place where their letters differ; None if they are equal."""
    if a.hash == b.hash and _same(a, b):
        return None
    while a.up[0].hash != b.up[0].hash:
        k = len(a.up) - 1
        while a.up[k].hash == b.up[k].hash:
            k -= 1
        a, b = a.up[k], b.up[k]
    if _same(a.up[0], b.up[0]):
        return a, b
    return _unlike_by_letters(a, b)  # two hashes collided


def _same(a: Edits, b: Edits) -> bool:
    """Whether two prefixes with one hash have the same letters: back to the node that they share."""
    while a is not b:
        if a.letter != b.letter:
            return False
        a, b = a.up[0], b.up[0]
    return True


def _unlike_by_letters(a: Edits, b: Edits) -> tuple[Edits, Edits] | None:
    found = None
    while a is not b:
        if a.letter != b.letter:
            found = a, b
        a, b = a.up[0], b.up[0]
    return found


def before(a: Edits, b: Edits) -> bool:
    """Whether a's letters come before b's in ASCII; a proper prefix comes first."""
    if a is b:
        return False
    depth = min(a.depth, b.depth)
    unlike = _first_unlike(a.ancestor(depth), b.ancestor(depth))
    return a.depth < b.depth if unlike is None else unlike[0].letter < unlike[1].letter


class Repair:
    """The cheapest edits of one conversation, whose turns come one by one."""

    def __init__(self):
        self.root = Edits(None, "", START)
        self.best: list[tuple[int, Edits] | None] = [(0, self.root), None, None, None]
        self._insert()

    def _offer(self, best: list, state: int, cost: int, parent: Edits, letter: str) -> None:
        now = best[state]
        if now is None or cost <= now[0]:
            node = Edits(parent, letter, state)
            if now is None or cost < now[0] or before(node, now[1]):
                best[state] = cost, node

    def _insert(self) -> None:
        """Between turns a user's and an assistant's may be inserted. More than these two never pay."""
        was = list(self.best)
        for state in _FROM["u"]:
            if was[state]:
                self._offer(self.best, USER, was[state][0] + INSERT, was[state][1], "I")
        self._offer(self.best, ASSISTANT, self.best[USER][0] + INSERT, self.best[USER][1], "I")
        done = self.best[ASSISTANT][0]
        # what could follow these two could follow an assistant's turn too, but for a system turn, which costs 2 to delete
        for state, more in ((START, DELETE), (SYSTEM, 0)):
            if self.best[state] and done + more < self.best[state][0]:
                self.best[state] = None

    def turn(self, role: str, fault: str | None) -> None:
        was, self.best = self.best, [None] * 4
        for state in range(4):
            if was[state]:
                self._offer(self.best, state, was[state][0] + DELETE, was[state][1], "D")
        if fault not in ("blank", "duplicate"):
            more, initial = TRUNCATED * (fault == "truncated"), role[:1]
            for state in _FROM.get(initial, ()):
                if was[state]:
                    self._offer(self.best, _TO[initial], was[state][0] + more, was[state][1], "K")
            for other in ("u", "a"):
                for state in _FROM[other] if other != initial else ():
                    if was[state]:
                        self._offer(self.best, _TO[other], was[state][0] + more + REROLE, was[state][1], "R")
        self._insert()

    def shared(self) -> list[Edits]:
        """Edits that all candidates share, but for the last of them; they are forgotten now, and later turns can't change them."""
        live = [b[1] for b in self.best if b]
        depth = min(x.depth for x in live)
        live = [x.ancestor(depth) for x in live]
        while any(x is not live[0] for x in live):
            live = [x.up[0] for x in live]
        return self._taken(live[0].up[0]) if live[0].up else []

    def end(self) -> tuple[int, list[Edits]]:
        """The cost of the whole, and its edits that weren't handed on before: one at least, if there was a turn."""
        cost, node = self.best[ASSISTANT]
        other = self.best[START]
        if other and (other[0] < cost or other[0] == cost and before(other[1], node)):
            cost, node = other
        return cost, self._taken(node, False)

    def _taken(self, last: Edits, again: bool = True) -> list[Edits]:
        path, node = [], last
        while node is not self.root:
            path.append(node)
            node = node.up[0]
        path.reverse()
        if again and path:
            self._rooted(last)
        return path

    def _rooted(self, last: Edits) -> None:
        """Let `last` be the root: the nodes after it lose the ancestors before it."""
        root = Edits(None, last.letter, last.state)
        made = {id(last): root}

        def copied(node: Edits) -> Edits:
            way = []
            while id(node) not in made:
                way.append(node)
                node = node.up[0]
            now = made[id(node)]
            for x in reversed(way):
                made[id(x)] = now = Edits(now, x.letter, x.state)
            return now

        self.best = [b and (b[0], copied(b[1])) for b in self.best]
        self.root = root


_EDITS = (
    ("conv_id", pa.int64(), "long"), ("edit_no", pa.int64(), "long"), ("edit", pa.string(), "string"), ("turn", pa.int64(), "long"), ("was_role", pa.string(), "string"), ("fault", pa.string(), "string"),
    ("role", pa.string(), "string"), ("text", pa.string(), "string"), ("cost", pa.int64(), "long"),
)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of turns that come by conversation, in order; holds the turns whose edit isn't settled yet."""
    schema = pa.schema([(name, kind) for name, kind, _ in _EDITS])

    def rows() -> Iterator[tuple]:
        key, repair, held, number, chars = None, None, [], 0, 0

        def handed(nodes: list[Edits], cost: int | None = None) -> Iterator[tuple]:
            nonlocal number, held
            at = 0
            for k, node in enumerate(nodes):
                number += 1
                whole = cost if k == len(nodes) - 1 else None
                if node.letter == "I":
                    yield key, number, "I", None, None, None, _NAMES[node.state], "", whole
                    continue
                turn, role, text, fault = held[at]
                at += 1
                now = {"D": None, "K": role, "R": _NAMES.get(node.state)}[node.letter]
                yield key, number, node.letter, turn, role, fault, now, None if now is None else text, whole
            held = held[at:]

        for conv, turn, role, text, fault in rows_of(batches, "conv_id", "turn", "role", "text", "fault"):
            if repair is None or conv != key:
                if repair is not None:
                    cost, nodes = repair.end()
                    yield from handed(nodes, cost)
                key, repair, held, number, chars = conv, Repair(), [], 0, 0
            repair.turn(role, fault)
            held.append((turn, role, text, fault))
            chars += len(text)
            if len(held) % COMMIT_TURNS == 0 or chars > COMMIT_CHARS:
                yield from handed(repair.shared())
                chars = 0
        if repair is not None:
            cost, nodes = repair.end()
            yield from handed(nodes, cost)

    yield from batched(rows(), schema, 256)


def with_faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copy (from 1 on, of equal roles and texts in a conversation) with `fault`: blank (white
    space only), duplicate (an earlier turn has the same role and text), truncated (the last character that isn't white isn't
    `.`, `!` or `?`), whichever comes first, or null. Copies meet by their whole text, apart from the rest of a conversation."""
    from pyspark.sql import Window

    copies = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    bare = F.expr(f"trim(BOTH '{''.join(f'{chr(92)}u{ord(c):04x}' for c in WHITE)}' FROM text)")
    fault = F.when(F.col("bare") == "", "blank").when(F.col("copy") > 1, "duplicate").when(~F.right("bare", F.lit(1)).isin(".", "!", "?"), "truncated")
    return turns.withColumn("copy", F.row_number().over(copies)).withColumn("bare", bare).withColumn("fault", fault).drop("bare")


def repair_edits(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The cheapest edits of each conversation, in order: conv_id, edit_no (from 1 on), edit, turn, was_role, fault, role, text, cost.

    edit is K (keep), R (give the role user or assistant), D (delete) or I (insert an empty turn). turn, was_role and fault are
    the turn's own, null for I; role and text are as repaired, null for D. cost, of all edits, stands at the last one. Blank
    and duplicate turns go; a truncated one goes or costs more.

    Turns go by number, nulls first, then role, then text. Null roles and texts are one space. Repeated rows are turns of their
    own, and so duplicates. Rows without a conversation form one, whose id is null. Other columns aren't read. An empty table
    gives an empty result. A conversation streams through one task, which holds the turns since the last edit that all
    candidates share, not the conversation: what its digest reads must come in order anyway.
    """
    space = F.lit(" ")
    turns = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text")
    )
    ordered = with_faults(turns).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy")
    return ordered.select("conv_id", "turn", "role", "text", "fault").mapInArrow(_edited, ", ".join(f"{name} {kind}" for name, _, kind in _EDITS))


_LEGAL = {"su", "ua", "au"}
_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in _REPORT), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def rows() -> Iterator[tuple]:
        key, none = None, True
        letters: list[str] = []

        def done() -> tuple:
            gaps = high - low + 1 - distinct if distinct else 0
            return key, gaps, found["blank"], found["duplicate"], found["truncated"], illegal, cost, "".join(letters), digest.hexdigest()

        for conv, edit, turn, was, fault, role, text, own_cost in rows_of(batches, "conv_id", "edit", "turn", "was_role", "fault", "role", "text", "cost"):
            if none or conv != key:
                if not none:
                    yield done()
                key, none = conv, False
                low = high = last = None
                distinct = illegal = cost = 0
                found, letters, digest, first = dict.fromkeys(("blank", "duplicate", "truncated"), 0), [], hashlib.sha256(), True
            letters.append(edit)
            cost = own_cost if own_cost is not None else cost
            if edit != "I":
                if turn is not None and turn != high:  # turns don't fall
                    low, high, distinct = turn if low is None else low, turn, distinct + 1
                if fault is not None:
                    found[fault] += 1
                illegal += last is not None and last + was[:1] not in _LEGAL
                last = was[:1]
            if role is not None:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                first = False
        if not none:
            yield done()

    yield from batched(rows(), schema, 1024)


def repair_report(edits: DataFrame) -> DataFrame:
    """Of each conversation of repair_edits, read in the order and the tasks in which that has them: conv_id, gaps (turn numbers
    missing between the least and the largest), blank, duplicate, truncated, illegal (neighbours whose roles' initials aren't su,
    ua or au), cost, audit (the edits' letters) and repaired_sha256 (of `role:text` as repaired, joined by newlines)."""
    return edits.mapInArrow(_reported, "conv_id long, " + ", ".join(f"{n} long" for n in _REPORT) + ", audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, of which a twentieth each is dropped, emptied, loses its ends of sentences, comes twice or gets the
    role user, as crc32(`conv_id:turn`) says. Nulls are one space there, and in role and text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("again"))
    return rows.drop("again")
