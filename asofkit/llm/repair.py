"""Conversation repair: the cheapest edits that give every conversation a legal order of roles, and the least audit of them.

A conversation is read as a path through layers (rows) and four states: nothing
yet, after ``s``, after ``u``, after ``a``. Keep, delete and rerole lead from layer
to layer, insert stays in its layer; the end is reached from nothing or after
``a``. A cost DP gives each node its cost to the end; arcs on cheapest paths stay.
Nodes are then ranked by the audit that follows them: first by one letter, then
by two, four, eight, ... through pointers that double with the length, until all
pointers end. The ranks select each node's least arc, and the doubled pointers
mark the nodes on the path from the start.

At scale: rows are sorted once by (conversation, turn, ...) and cut into blocks of
``1 << BITS`` places; a block holds many short conversations or a piece of a long
one. A piece that crosses a border is summed up by a 4 x 4 matrix of least costs,
and by the state in which it ends for each state in which it starts; both are
composed over the pieces by doubling joins, so no task sees more than one block.
Only the digest of a repaired conversation is sequential by definition: its rows
stream through one task in order, in bounded memory.

Cases: null roles and texts count as one space, a null conversation is one of its
own; null turns come first; rows with equal turn are ordered by role and text
digest, so repeated rows are adjacent; a conversation without rows gives zeros, an
empty audit and the digest of nothing; an empty table gives no rows; long texts
are only hashed and tested; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import written
from asofkit.llm.order import ranked

#: A block holds 1 << BITS rows.
BITS = 13
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0.0, 1.0, 2.0, 5.0, 5.0
#: Cost to the end in the last layer: nothing, after s, after u, after a.
FINAL = [0.0, 2 * INSERT, INSERT, 0.0]
#: State after an inserted or reroled turn, by state before it.
TURN = np.array([2, 2, 3, 2])
LETTERS = np.array(["", "D", "I", "K", "R"])
INF = np.inf
INK = r"[^\x20\x09-\x0D]"


def kept_to(code: np.ndarray) -> np.ndarray:
    """(rows, 4) state after keeping a row of initial ``code`` (0 other, 1 s, 2 u, 3 a), -1 where it may not follow."""
    table = np.array([[-1, -1, -1, -1], [1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1]])
    return table[code]


def step_matrices() -> np.ndarray:
    """Least cost from state to state over inserts and one row, by row type code + 4 * drop + 8 * cut."""
    closure = np.full((4, 4), INF)
    for s in range(4):
        cost, t = 0.0, s
        for _ in range(3):
            closure[s, t] = min(closure[s, t], cost)
            cost, t = cost + INSERT, TURN[t]
    out = np.empty((16, 4, 4))
    for kind in range(16):
        code, drop, cut = kind & 3, (kind >> 2) & 1, kind >> 3
        row = np.full((4, 4), INF)
        row[range(4), range(4)] = DELETE
        if not drop:
            for s in range(4):
                k = kept_to(np.array([code]))[0, s]
                row[s, TURN[s]] = min(row[s, TURN[s]], REROLE + TRUNCATED * cut)
                if k >= 0:
                    row[s, k] = min(row[s, k], KEEP + TRUNCATED * cut)
        out[kind] = (closure[:, :, None] + row[None]).min(axis=1)
    return out


STEP = step_matrices()


class Paths:
    """Cheapest paths of the pieces of one block; ``starts`` are their first rows, ``tails`` the costs behind each, ``final`` where they end."""

    def __init__(self, code: np.ndarray, drop: np.ndarray, cut: np.ndarray, starts: np.ndarray, tails: np.ndarray, final: np.ndarray):
        m, pieces = len(code), len(starts)
        ends = np.append(starts[1:], m)
        piece = np.repeat(np.arange(pieces), ends - starts)
        self.row_layer = np.arange(m) + piece
        self.first, self.last = starts + np.arange(pieces), ends + np.arange(pieces)
        cost = np.full((m + pieces, 4), INF)
        cost[self.last] = tails
        kind = code + 4 * drop + 8 * cut
        for back in range(1, int((ends - starts).max()) + 1):  # the cost DP, all pieces at once from their ends
            live = np.flatnonzero(ends - starts >= back)
            row = ends[live] - back
            cost[row + live] = (STEP[kind[row]] + cost[row + live + 1][:, None, :]).min(axis=2)
        self.cost = cost
        self._arcs(code, drop, cut, final)
        self._rank()

    def _arcs(self, code, drop, cut, final) -> None:
        """Arcs on cheapest paths: source, letter, target, as node numbers layer * 4 + state."""
        flat = self.cost.ravel()
        states = np.arange(4)
        here = self.row_layer[:, None] * 4 + states
        late = TRUNCATED * cut[:, None] + np.zeros(4)
        turn = (self.row_layer[:, None] + 1) * 4 + TURN
        keep = kept_to(code)
        may = ~drop.astype(bool)[:, None] & np.ones(4, bool)
        open_layers = np.concatenate([self.row_layer, self.last[final]])[:, None] * 4
        found = [
            (here, 1, here + 4, DELETE + np.zeros_like(late), np.ones_like(may)),
            (open_layers + states, 2, open_layers + TURN, INSERT + np.zeros((len(open_layers), 4)), np.ones((len(open_layers), 4), bool)),
            (here, 3, (self.row_layer[:, None] + 1) * 4 + np.maximum(keep, 0), KEEP + late, may & (keep >= 0)),
            (here, 4, turn, REROLE + late, may),
        ]
        src, let, dst = [], [], []
        for a, letter, b, c, ok in found:
            best = ok & (flat[a] == c + flat[b])
            src.append(a[best])
            dst.append(b[best])
            let.append(np.full(int(best.sum()), letter))
        self.arc = np.concatenate(src), np.concatenate(let), np.concatenate(dst)

    def _rank(self) -> None:
        n = self.cost.size
        src, let, dst = self.arc
        order = np.lexsort((let, src))
        one = order[np.unique(src[order], return_index=True)[1]]
        rank, jump = np.zeros(n, np.int64), np.arange(n)
        rank[src[one]], jump[src[one]] = let[one], dst[one]
        self.jumps = [jump]
        while True:
            both = rank * (rank.max() + 1) + rank[jump]
            rank = np.unique(both, return_inverse=True)[1]
            further = jump[jump]
            if (further == jump).all():
                break
            jump = further
            self.jumps.append(jump)
        order = np.lexsort((rank[dst], let, src))  # the least arc of each node: its letter, then the rank of what follows
        one = order[np.unique(src[order], return_index=True)[1]]
        self.letter, self.target = np.zeros(n, np.int64), np.arange(n)
        self.letter[src[one]], self.target[src[one]] = let[one], dst[one]
        self.end = jump

    def marked(self, entry: np.ndarray) -> np.ndarray:
        """Nodes on the least paths of all pieces from their entry states."""
        on = self.first * 4 + entry
        for jump in self.jumps:
            on = np.unique(np.concatenate([on, jump[on]]))
        return on


def opened(t: pa.Table) -> tuple[pa.Table, Paths, np.ndarray, np.ndarray]:
    """A block in order, its paths, the first rows of its pieces and their entry states."""
    t = t.sort_by("place")
    col = {c: t[c].to_numpy() for c in ("start", "rank", "n", "code", "drop", "cut", "entry")}
    starts = np.flatnonzero(np.append(True, col["start"][1:] != col["start"][:-1]))
    ends = np.append(starts[1:], t.num_rows) - 1
    final = col["rank"][ends] == col["n"][ends] - 1
    tails = np.tile(np.array(FINAL), (len(starts), 1))
    if not final[-1]:
        tails[-1] = t["tail"][0].as_py()
    entry = np.zeros(len(starts), np.int64)
    if col["rank"][0] > 0:
        entry[0] = col["entry"][0]
    return t, Paths(col["code"], col["drop"].astype(np.int64), col["cut"].astype(np.int64), starts, tails, final), starts, entry


def product(m: np.ndarray) -> np.ndarray:
    """Product over (rows, 4, 4) in (min, +)."""
    while len(m) > 1:
        odd = m[len(m) // 2 * 2 :]
        m = np.concatenate([(m[0:-1:2][: len(m) // 2, :, :, None] + m[1::2][:, None, :, :]).min(axis=2), odd])
    return m[0]


def sums(t: pa.Table) -> pa.Table:
    """One row per piece that crosses a border of its block: its matrix."""
    t = t.sort_by("place")
    col = {c: t[c].to_numpy() for c in ("start", "rank", "n", "code", "drop", "cut")}
    cuts = np.flatnonzero(np.append(True, col["start"][1:] != col["start"][:-1]))
    out = []
    for a, b in zip(cuts, np.append(cuts[1:], t.num_rows), strict=True):
        if col["n"][a] > b - a:
            kind = col["code"][a:b] + 4 * col["drop"][a:b].astype(np.int64) + 8 * col["cut"][a:b].astype(np.int64)
            out.append((int(col["start"][a]), product(STEP[kind]).ravel().tolist()))
    return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([t["block"][0].as_py()] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.float64()))], names=["start", "block", "m"])


def exits(t: pa.Table) -> pa.Table:
    """One row per piece that goes on behind its block or came from before it: the state it ends in, by the state it starts in."""
    t, paths, starts, _ = opened(t)
    start, n = t["start"].to_numpy()[starts], t["n"].to_numpy()[starts]
    cross = np.flatnonzero(n > np.append(starts[1:], t.num_rows) - starts)
    maps = [(paths.end[paths.first[p] * 4 + np.arange(4)] % 4).tolist() for p in cross]
    return pa.table([pa.array(start[cross], pa.int64()), pa.array([t["block"][0].as_py()] * len(cross), pa.int64()), pa.array(maps, pa.list_(pa.int32()))], names=["start", "block", "f"])


def edits(t: pa.Table) -> pa.Table:
    """One row per row: its letter, new role, turns inserted before and behind it, cost, and whether the pair with the row before is illegal."""
    t, paths, starts, entry = opened(t)
    m, on = t.num_rows, paths.marked(entry)
    layers, letter, target = paths.row_layer, paths.letter, paths.target
    inserts = on[letter[on] == 2]
    inserts = inserts[np.lexsort((-paths.cost.ravel()[inserts], inserts // 4))]
    put = {}
    for node in inserts.tolist():
        put[node // 4] = put.get(node // 4, "") + "  ua"[target[node] % 4]
    ops = on[letter[on] != 2]
    at = np.full(len(paths.cost), -1)
    at[ops // 4] = ops
    node = at[layers]
    before = [put.get(x, "") for x in layers.tolist()]
    behind = [""] * m
    for p, last in enumerate(paths.last.tolist()):
        behind[int(np.append(starts[1:], m)[p]) - 1] = put.get(last, "")
    letters = LETTERS[letter[node]]
    role = np.where(letters == "R", np.where(target[node] % 4 == 2, "user", "assistant"), "")
    cut, code = t["cut"].to_numpy().astype(bool), t["code"].to_numpy()
    cost = np.select([letters == "D", letters == "R"], [DELETE, REROLE], KEEP) + TRUNCATED * (cut & (letters != "D")) + INSERT * np.array([len(a) + len(b) for a, b in zip(before, behind, strict=True)])
    prev = np.append(t["prev"][0].as_py(), code[:-1])
    legal = np.isin(prev * 4 + code, [1 * 4 + 2, 2 * 4 + 3, 3 * 4 + 2])
    illegal = ~legal & (t["rank"].to_numpy() > 0)
    return pa.table([t["place"], t["start"], t["block"], pa.array(letters), pa.array(role), pa.array(before), pa.array(behind), pa.array(cost.astype(np.int64)), pa.array(illegal)], names=["place", "start", "block", "op", "new_role", "before", "behind", "cost", "illegal"])


def scanned(pieces: DataFrame, column: str, combine, ahead: int) -> DataFrame:
    """``pieces`` (start, block, column) with the composition over all blocks from here on (``ahead`` 1) or up to here (-1), by doubling joins."""
    pieces = written(pieces, "pieces")
    longest = pieces.groupBy("start").agg((F.max("block") - F.min("block")).alias("d")).agg(F.max("d")).first()[0] or 0
    reach = 1
    while reach <= longest:
        other = pieces.select("start", (F.col("block") - ahead * reach).alias("block"), F.col(column).alias("other"))
        joined = pieces.join(other, ["start", "block"], "left")
        pieces = written(joined.select("start", "block", F.coalesce(combine(F.col(column), F.col("other"), ahead), F.col(column)).alias(column)), "pieces")
        reach *= 2
    return pieces


def min_plus(a: Column, b: Column, _: int) -> Column:
    """Product of two 4 x 4 matrices stored by rows."""
    cell = lambda ij: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.get(a, F.floor(ij / 4).cast("int") * 4 + k) + F.get(b, k * 4 + ij % 4)))
    return F.when(b.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(15)), cell))


def after(f: Column, other: Column, _: int) -> Column:
    """``f`` of what the earlier piece ends in."""
    return F.when(other.isNotNull(), F.transform(other, lambda s: F.get(f, s)))


def flawed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv, turn, role, text; conv a text that is not null) in order, and their faults without the texts.

    Texts are sorted once; what follows reads digests, lengths and last letters. The first place of each (conversation, role, text) comes from an aggregation; a row is a repeat if its place is none of those.
    """
    digest = F.sha2("text", 256)
    bare = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    rows = rows.select(
        "conv", "turn", "role", "text", digest.alias("digest"), (F.length(bare) == 0).alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"),
        F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("s", 1, "u", 2, "a", 3)]), F.substring("role", 1, 1)), F.lit(0)).cast("long").alias("code"),
    )
    lined = written(ranked(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()], "rank", "n", "place").withColumn("start", F.col("place") - F.col("rank")), "turns")
    firsts = lined.groupBy("conv", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    seen = F.col("first").isNull()
    marked = lined.drop("role", "text", "digest").join(firsts, "place", "left").withColumn("fault", F.when(F.col("blank"), "blank").when(seen, "duplicate").when(F.col("open"), "truncated"))
    marked = marked.withColumn("drop", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))).withColumn("cut", F.coalesce(F.col("fault") == "truncated", F.lit(False)))
    return lined, written(marked.drop("blank", "open", "first"), "faults")


def edited(lined: DataFrame, bits: int = BITS) -> DataFrame:
    """The least cheapest edit of every row of ``flawed``: see ``edits``."""
    narrow = lined.select("place", "start", "rank", "n", "code", "drop", "cut", F.shiftright("place", bits).alias("block"))
    pieces = narrow.groupBy("block").applyInArrow(sums, "start long, block long, m array<double>")
    suffix = scanned(pieces, "m", min_plus, 1)
    tails = suffix.select((F.col("block") - 1).alias("block"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.get("m", i * 4 + j) + F.get(F.lit(FINAL), j)))).alias("tail"), F.col("start").alias("of"))
    # a block has one piece at most that goes on behind it: the one whose conversation the next block begins with
    begun = narrow.filter((F.col("place").bitwiseAND((1 << bits) - 1) == 0) & (F.col("rank") > 0)).select((F.col("block") - 1).alias("block"), F.col("start").alias("of"))
    tails = tails.join(begun, ["block", "of"]).select("block", "tail")
    prev = narrow.filter(F.col("place").bitwiseAND((1 << bits) - 1) == (1 << bits) - 1).select((F.col("block") + 1).alias("block"), F.col("code").alias("prev"))
    known = written(narrow.join(tails, "block", "left").join(prev, "block", "left").withColumn("prev", F.coalesce("prev", F.lit(0).cast("long"))), "blocks")
    ends = known.withColumn("entry", F.lit(0)).groupBy("block").applyInArrow(exits, "start long, block long, f array<int>")
    prefix = scanned(ends, "f", after, -1)
    entries = prefix.select((F.col("block") + 1).alias("block"), F.col("start").alias("of"), F.get("f", 0).alias("entry")).join(begun.select((F.col("block") + 1).alias("block"), "of"), ["block", "of"]).select("block", "entry")
    known = known.join(entries, "block", "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    return written(known.groupBy("block").applyInArrow(edits, "place long, start long, block long, op string, new_role string, before string, behind string, cost long, illegal boolean"), "edits")


def lines(lined: DataFrame, ops: DataFrame) -> DataFrame:
    """The repaired conversations: (conv, start, place, piece), a piece being the lines ``role:text`` that stand for a row; deleted rows have none."""
    put = lambda c: F.transform(F.split(F.regexp_replace(c, "(?!^)(?!$)", ","), ","), lambda x: F.when(x == "u", "user:").when(x == "a", "assistant:"))
    own = F.when(F.col("op") != "D", F.concat(F.when(F.col("op") == "R", F.col("new_role")).otherwise(F.col("role")), F.lit(":"), F.col("text")))
    both = lined.select("conv", "start", "place", "role", "text").join(ops.select("place", "op", "new_role", "before", "behind"), "place")
    parts = F.filter(F.concat(put(F.col("before")), F.array(own), put(F.col("behind"))), lambda x: x.isNotNull())
    return both.select("conv", "start", "place", parts.alias("parts")).filter(F.size("parts") > 0).select("conv", "start", "place", F.array_join("parts", "\n").alias("piece"))


def digests(pieces: DataFrame) -> DataFrame:
    """(start, sha256 of a conversation's pieces joined by line ends): rows stream in order, none is gathered."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, state = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([start], pa.int64()), pa.array([state.hexdigest()])], ["start", "repaired_sha256"])

        for batch in batches:
            done = []
            for s, piece in zip(batch["start"].to_pylist(), batch["piece"], strict=True):
                if s == start:
                    state.update(b"\n")
                else:
                    if state is not None:
                        done.append(row())
                    start, state = s, hashlib.sha256()
                state.update(piece.as_buffer())
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if state is not None:
            yield row()

    narrow = pieces.select("start", "place", "piece")
    return narrow.repartition("start").sortWithinPartitions("start", "place").mapInArrow(hashed, "start long, repaired_sha256 string")


def report(ids: DataFrame, lined: DataFrame, marked: DataFrame, ops: DataFrame) -> DataFrame:
    """One row per conversation of ``ids`` (conv and others): faults, gaps, cost, audit and digest."""
    facts = marked.groupBy("conv").agg(
        F.min("start").alias("start"), (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        *[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    word = F.concat(F.repeat(F.lit("I"), F.length("before")), F.col("op"), F.repeat(F.lit("I"), F.length("behind")))
    told = lambda at: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(at), F.col("audit")))), lambda x: x["audit"]), "")
    audit = ops.select("start", "block", "place", word.alias("audit"), "cost", F.col("illegal").cast("long").alias("illegal"))
    audit = audit.groupBy("start", "block").agg(told("place").alias("audit"), F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))  # a block's share at most
    audit = audit.groupBy("start").agg(told("block").alias("audit"), F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))
    out = ids.join(facts, "conv", "left").join(audit, "start", "left").join(digests(lines(lined, ops)), "start", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(*[c for c in ids.columns if c != "conv"], *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def keyed(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with a text key per conversation and without nulls in role and text."""
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    return rows.select(key.alias("conv"), "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with planted faults by crc32(``conv_id:turn``) % 20: 0 drops, 1 empties, 2 takes the sentence ends, 3 repeats, 4 makes the role user."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("how", F.crc32(name.cast("binary")) % 20).filter("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("how") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("how", "copy")


def repaired(rows: DataFrame, ids: DataFrame, bits: int = BITS) -> DataFrame:
    """Report over ``rows`` of ``keyed`` form, one row for every conversation of ``ids``."""
    lined, marked = flawed(rows)
    return report(ids, lined, marked, edited(marked, bits))
