"""Conversation structure repair with Hirschberg's divide and conquer.

The role initials of a whole conversation must read ``(s?(ua)+)?``: an optional
system row, then user and assistant in turns, or nothing at all. Edits, with
their costs: Keep a row 0, Rerole it to user or assistant 1, Delete it 2, Insert
an empty row of user or assistant 5. Blank rows and duplicates must be deleted;
a truncated row that is not deleted costs 5 more. Of the cheapest scripts the
one whose edits' initials come first in ASCII order is taken.

What is written so far leaves one of four states (nothing, s, u, a), so a row is
a 4 x 4 matrix of costs, a stretch of rows is a (min, +) product, and all that a
stretch knows of the rest is a vector of four costs. A stretch is rebuilt in
linear space: cost vectors from its entry forward and from its end backward meet
at the middle row; among the states where they sum to the least, the crossing of
the audit-least script is chosen, and both halves follow alone. Where several
states tie, the left half is swept backward once more, each state carrying the
crossing of its own first-in-order script; two scripts to one state are never
prefixes of each other, so halves can be chosen one by one.

The same is done over the cluster. Rows are range-partitioned by conversation
and order, so that one conversation may fill many tasks, and cut into blocks of
at most ``BLOCK`` rows and about ``BLOCK_BYTES`` of text. A block's matrix gives
the costs after each block; then each block maps its four entry states to exits,
and the maps give its own entry. Only these small summaries (16 numbers a block)
of conversations with several blocks meet by conversation; texts never do.

Order within a conversation: turn, nulls first, then role and text; equal rows
are counted before they are sorted, so one row repeated without end is one row.

Defined results: a null role or text is one space (a blank row); a role is known
by its first letter, and other letters can only be reroled or deleted; a null
conv_id is a conversation; an empty conversation, or one whose rows must all go,
is repaired to nothing. Columns other than conv_id, turn, role and text are not
read. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

#: Rows and bytes of text of a block.
BLOCK = 1024
BLOCK_BYTES = 256 << 10

# Costs, and letters of the edits in their order.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 40
#: States: nothing, s, u, a. What may be written next, besides s at first, and the state after it.
NEXT = (2, 2, 3, 2)
WRITTEN = {2: "user", 3: "assistant"}
#: Cost to the end of the conversation, by inserting alone.
END = (0, 2 * INSERT, INSERT, 0)

BLANK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
BLOCKS = ("conv_id bigint, pid int, seq int, kinds binary, copies array<int>, roles array<string>, texts array<string>, "
          "matrix array<bigint>")


# --- one stretch of rows ------------------------------------------------------

def kind_of(initial: str, must_go: bool, truncated: bool) -> int:
    """A row as a number under 16: the state its role leads to (0: none), whether it must go, whether it is truncated."""
    return "xsua".index(initial if initial in ("s", "u", "a") else "x") + 4 * must_go + 8 * (truncated and not must_go)


def _after_keep(state: int, kind: int) -> int:
    """The state after keeping the row, or 0 if its role does not fit."""
    role = kind % 4
    return role if role and (role == NEXT[state] or (role == 1 and state == 0)) else 0


def _row_matrix(kind: int) -> list[list[int]]:
    """Costs from state to state of inserting before a row, and then of the row."""
    extra, stays = TRUNCATED * (kind >= 8), kind % 8 < 4
    own = [[NEVER] * 4 for _ in range(4)]
    for q in range(4):
        own[q][q] = DELETE
        if stays:
            own[q][NEXT[q]] = min(own[q][NEXT[q]], REROLE + extra)
            kept = _after_keep(q, kind)
            if kept:
                own[q][kept] = min(own[q][kept], extra)
    return [[min(own[q][t], INSERT + own[NEXT[q]][t], 2 * INSERT + own[NEXT[NEXT[q]]][t]) for t in range(4)] for q in range(4)]


ROWS = [_row_matrix(kind) for kind in range(16)]


def product(a, b):
    """The (min, +) product of two 4 x 4 matrices."""
    return [[min(x + b[k][t] for k, x in enumerate(row)) for t in range(4)] for row in a]


def matrix_of(kinds) -> list[list[int]]:
    out = [[0 if q == t else NEVER for t in range(4)] for q in range(4)]
    for kind in kinds:
        out = product(out, ROWS[kind])
    return out


def before(matrix, after) -> list[int]:
    """Costs to the end from before a stretch, given those after it."""
    return [min(x + y for x, y in zip(row, after)) for row in matrix]


def _first_edits(kind: int, state: int, after) -> tuple[str, int]:
    """The letters of the audit-least cheapest way over one row, and the state after it."""
    costs, audit = before(ROWS[kind], after), ""
    extra, stays = TRUNCATED * (kind >= 8), kind % 8 < 4
    while True:
        kept = _after_keep(state, kind)
        if DELETE + after[state] == costs[state]:
            return audit + "D", state
        if INSERT + costs[NEXT[state]] == costs[state]:
            audit, state = audit + "I", NEXT[state]
        elif stays and kept and extra + after[kept] == costs[state]:
            return audit + "K", kept
        else:
            return audit + "R", NEXT[state]


def exits(kinds, after) -> list[int]:
    """For each entry state, the state at the end of the audit-least cheapest way, in one backward sweep."""
    ends, costs = [0, 1, 2, 3], list(after)
    for kind in reversed(kinds):
        ends = [ends[_first_edits(kind, q, costs)[1]] for q in range(4)]
        costs = before(ROWS[kind], costs)
    return ends


def rebuild(kinds, state: int, after) -> str:
    """The audit-least cheapest edits of a stretch entered in ``state``, with the costs ``after`` it."""
    if len(kinds) == 0:
        return ""
    if len(kinds) == 1:
        return _first_edits(kinds[0], state, after)[0]
    middle = len(kinds) // 2
    left, right = kinds[:middle], kinds[middle:]
    forward = [0 if q == state else NEVER for q in range(4)]
    for kind in left:
        forward = [min(forward[q] + ROWS[kind][q][t] for q in range(4)) for t in range(4)]
    backward = list(after)
    for kind in reversed(right):
        backward = before(ROWS[kind], backward)
    sums = [x + y for x, y in zip(forward, backward)]
    crossings = [q for q in range(4) if sums[q] == min(sums)]
    crossing = crossings[0] if len(crossings) == 1 else exits(left, backward)[state]
    return rebuild(left, state, backward) + rebuild(right, crossing, after)


def state_after(kinds, audit: str, state: int = 0) -> int:
    at = 0
    for edit in audit:
        if edit in "RI":
            state = NEXT[state]
        elif edit == "K":
            state = _after_keep(state, kinds[at])
        at += edit != "I"
    return state


# --- conversations as blocks --------------------------------------------------

def faults(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, must_go, is_blank, truncated: distinct rows and their faults.

    Of rows that are equal in all, the first has the faults given here and the others are its duplicates.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").cast("int").alias("copies"))
    rows = stored(rows.withColumn("said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    # The first turn of what is said; stored, so that a join on a frequent saying can be split.
    firsts = stored(rows.groupBy("conv_id", "said").agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("unplaced")))
    same = rows["conv_id"].eqNullSafe(firsts["conv_id"]) & (rows["said"] == firsts["said"])
    is_blank = ~F.col("text").rlike(BLANK)
    again = F.col("turn").isNotNull() & (F.col("unplaced") | (F.col("turn") > F.col("first")))
    return rows.join(firsts, same).select(
        rows["conv_id"], "turn", "role", "text", "copies", is_blank.alias("is_blank"), (is_blank | again).alias("must_go"),
        (~is_blank & ~again & ~F.col("text").rlike(ENDED)).alias("truncated"))


def blocks_of(rows: DataFrame) -> DataFrame:
    """The rows of :func:`faults` in order, as blocks; (pid, seq) orders them."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.spark_partition_id().alias("pid"), F.substring("role", 1, 1).alias("initial"), "role", "text", "copies",
        "must_go", "truncated")

    def cut(batches):
        import pyarrow as pa

        open_rows, size, key, seq = [], 0, None, 0
        kind = pa.schema([("conv_id", pa.int64()), ("pid", pa.int32()), ("seq", pa.int32()), ("kinds", pa.binary()),
                          ("copies", pa.list_(pa.int32())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
                          ("matrix", pa.list_(pa.int64()))])

        def block():
            kinds = bytes(r[0] for r in open_rows)
            # A copy after the first is a duplicate: deleting it costs the same in every state.
            more = DELETE * sum(r[1] - 1 for r in open_rows)
            matrix = [min(x + more, NEVER) for row in matrix_of(kinds) for x in row]
            return {"conv_id": key[0], "pid": key[1], "seq": seq, "kinds": kinds, "copies": [r[1] for r in open_rows],
                    "roles": [r[2] for r in open_rows], "texts": [r[3] for r in open_rows], "matrix": matrix}

        for batch in batches:
            made = []
            for conv, pid, initial, role, text, copies, must_go, truncated in zip(*[c.to_pylist() for c in batch.columns]):
                if open_rows and (key != (conv, pid) or len(open_rows) >= BLOCK or size >= BLOCK_BYTES):
                    made.append(block())
                    open_rows, size, seq = [], 0, seq + 1
                key = (conv, pid)
                open_rows.append((kind_of(initial, must_go, truncated), copies, role, text))
                size += len(text)
            if made:
                yield pa.RecordBatch.from_pylist(made, kind)
        if open_rows:
            yield pa.RecordBatch.from_pylist([block()], kind)

    return ranged.mapInArrow(cut, BLOCKS)


def _contexts(blocks: DataFrame) -> DataFrame:
    """pid, seq, after, entry of every block of the conversations that have several."""
    import pandas as pd

    many = blocks.groupBy("conv_id").count().where("count > 1")
    several = stored(blocks.join(many, blocks["conv_id"].eqNullSafe(many["conv_id"]), "left_semi").select(
        "conv_id", "pid", "seq", "kinds", "matrix"))

    def suffixes(group):
        group = group.sort_values(["pid", "seq"])
        after, out = list(END), []
        for flat in reversed(group["matrix"].tolist()):
            out.append(after)
            after = before([[int(x) for x in flat[i : i + 4]] for i in (0, 4, 8, 12)], after)
        return pd.DataFrame({"pid": group["pid"], "seq": group["seq"], "after": out[::-1]})

    def entries(group):
        group = group.sort_values(["pid", "seq"])
        state, out = 0, []
        for ends in group["ends"].tolist():
            out.append(state)
            state = int(ends[state])
        return group[["pid", "seq", "after"]].assign(entry=out)

    def ends_of(batches):
        for frame in batches:
            ends = [exits(kinds, [int(x) for x in after]) for kinds, after in zip(frame["kinds"], frame["after"])]
            yield frame[["conv_id", "pid", "seq", "after"]].assign(ends=ends)

    after = several.select("conv_id", "pid", "seq", "matrix").groupBy("conv_id").applyInPandas(suffixes, "pid int, seq int, after array<bigint>")
    known = several.join(after, ["pid", "seq"]).select("conv_id", "pid", "seq", "kinds", "after")
    mapped = known.mapInPandas(ends_of, "conv_id bigint, pid int, seq int, after array<bigint>, ends array<int>")
    return mapped.groupBy("conv_id").applyInPandas(entries, "pid int, seq int, after array<bigint>, entry int")


def edited(rows: DataFrame) -> DataFrame:
    """conv_id, pid, seq, initials, audit, cost, roles, texts of :func:`faults`: every block with its edits and repaired rows.

    The rows of a conversation follow each other by (pid, seq). ``initials`` are the role initials before the repair.
    """
    blocks = stored(blocks_of(rows))
    contexts = stored(_contexts(blocks))
    last = blocks.groupBy("conv_id").agg(F.max(F.struct("pid", "seq")).alias("_last")).select("_last.*").withColumn("is_last", F.lit(True))
    rows = blocks.drop("matrix").join(contexts, ["pid", "seq"], "left").join(last, ["pid", "seq"], "left")

    def apply(batches):
        import pyarrow as pa

        kind = pa.schema([("conv_id", pa.int64()), ("pid", pa.int32()), ("seq", pa.int32()), ("initials", pa.string()),
                          ("audit", pa.string()), ("cost", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
        price = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                state = r["entry"] or 0
                after = list(END) if r["after"] is None else r["after"]
                edits = rebuild(r["kinds"], state, after)
                audit, roles, texts, at, cost = [], [], [], 0, 0
                for edit in edits:
                    if edit == "I":
                        state = NEXT[state]
                        roles.append(WRITTEN[state])
                        texts.append("")
                        audit.append(edit)
                        continue
                    if edit != "D":
                        state = _after_keep(state, r["kinds"][at]) if edit == "K" else NEXT[state]
                        roles.append(r["roles"][at] if edit == "K" else WRITTEN[state])
                        texts.append(r["texts"][at])
                        cost += TRUNCATED * (r["kinds"][at] >= 8)
                    audit.append(edit + "D" * (r["copies"][at] - 1))
                    at += 1
                while r["is_last"] and END[state]:
                    state = NEXT[state]
                    audit.append("I")
                    roles.append(WRITTEN[state])
                    texts.append("")
                initials = "".join((role[:1] or " ") * copies for role, copies in zip(r["roles"], r["copies"]))
                audit = "".join(audit)
                made.append({"conv_id": r["conv_id"], "pid": r["pid"], "seq": r["seq"], "initials": initials, "audit": audit,
                             "cost": cost + sum(price[edit] * audit.count(edit) for edit in price), "roles": roles, "texts": texts})
            yield pa.RecordBatch.from_pylist(made, kind)

    return rows.select("conv_id", "pid", "seq", "kinds", "copies", "roles", "texts", "after", "entry", "is_last").mapInArrow(
        apply, "conv_id bigint, pid int, seq int, initials string, audit string, cost bigint, "
        "roles array<string>, texts array<string>")


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation with rows.

    A conversation's repaired rows are hashed as they stream by, block after block.
    """
    rows = stored(faults(conversations))
    lines = F.array_join(F.zip_with("roles", "texts", lambda role, text: F.concat(role, F.lit(":"), text)), "\n")
    ordered = edited(rows).select(
        "conv_id", "pid", "seq", "initials", "audit", "cost", F.when(F.size("roles") > 0, lines).alias("lines"),
    ).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "pid", "seq").drop("pid", "seq")

    def gathered(batches):
        import hashlib

        import pyarrow as pa

        names = ("conv_id", "illegal", "cost", "audit", "repaired_sha256")
        kind = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))))
        now, made = None, []

        def close():
            made.append(dict(zip(names, (now["conv_id"], now["illegal"], now["cost"], "".join(now["audit"]), now["sha"].hexdigest()))))

        for batch in batches:
            for conv, initials, audit, cost, lines in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or conv != now["conv_id"]:
                    if now is not None:
                        close()
                    now = {"conv_id": conv, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "last": "", "glue": ""}
                pairs = now["last"] + initials
                now["illegal"] += sum(pairs[i : i + 2] not in ("su", "ua", "au") for i in range(len(pairs) - 1))
                now["last"] = initials[-1]
                now["cost"] += cost
                now["audit"].append(audit)
                if lines is not None:
                    now["sha"].update((now["glue"] + lines).encode())
                    now["glue"] = "\n"
            yield pa.RecordBatch.from_pylist(made, kind)
            made.clear()
        if now is not None:
            close()
            yield pa.RecordBatch.from_pylist(made, kind)

    told = ordered.mapInArrow(gathered, "conv_id bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")
    counted = rows.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("is_blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("is_blank"), 0).otherwise(F.col("copies") - 1 + F.col("must_go").cast("int"))).alias("duplicate"),
        F.sum(F.col("truncated").cast("int")).alias("truncated"),
    ).groupBy("conv_id").agg(
        _gaps().alias("gaps"), *[F.sum(c).cast("bigint").alias(c) for c in ("blank", "duplicate", "truncated")])
    return counted.join(told, counted["conv_id"].eqNullSafe(told["conv_id"])).select(
        counted["conv_id"], "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _gaps() -> Column:
    """Turns missing between the least and the greatest, of rows that are one a turn."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.coalesce((wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count("turn")).try_cast("bigint"), F.lit(0).cast("bigint"))
