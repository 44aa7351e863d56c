"""Repair of conversations: the cheapest edits that leave ``(s?(ua)+)?`` by roles and no faulty turn.

Rows are dealt to tasks by conversation once and stay there; what follows are sorts inside the
partitions, which Spark spills, and streams over their Arrow batches that carry the state of one
conversation, never its rows.

1. By role and text: a row equal to an earlier one is a duplicate.
2. From the last turn to the first: a dynamic program over the four states of the roles so far gives
   the cost to go; each row gets the best edit of each state, two bits each, in one byte.  These back
   pointers stay beside their rows, so a giant conversation spills them with its rows.
3. From the first turn to the last: the edits are followed from the start.  Because the costs
   to go are known, the ASCII-least of the cheapest audits is the least edit at every step.
"""

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
DELETE, INSERT, KEEP, REROLE = range(4)  # in the order of their initials
INITIALS = "DIKR"
EMPTY, SYSTEM, USER, ASSISTANT = range(4)  # what the kept rows end with
FOLLOWS = (USER, USER, ASSISTANT, USER)  # the state after a row that is inserted or given a new role
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(EMPTY, "s"): SYSTEM} | {(s, "u"): USER for s in (EMPTY, SYSTEM, ASSISTANT)} | {(USER, "a"): ASSISTANT}
COSTS = {"delete": 4, "insert": 3, "rerole": 3, "truncated": 3}
FAR = 1 << 60


def marked_turns(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None
) -> DataFrame:
    """``key, turn_, role_, text_, gone_, fault`` dealt by conversation; identifiers and turns as text."""

    own = rows.select(
        F.col(conv).cast("string").alias("key"),
        F.col(turn).alias("turn_"),
        *[F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role, "role_"), (text, "text_"))],
        (F.col(gone) if gone else F.lit(False)).alias("gone_"),
    ).repartition("key")
    same = W.partitionBy("key", "gone_", "role_", "text_").orderBy(F.col("turn_").asc_nulls_first())
    body = F.rtrim("text_", F.lit(SPACES))
    fault = (
        F.when(body == "", BLANK)
        .when(F.row_number().over(same) > 1, DUPLICATE)
        .when(~F.substring(body, -1, 1).isin(".", "!", "?"), TRUNCATED)
        .otherwise(OK)
    )
    return own.withColumn("fault", fault)


def step(initial: str, fault: int, after: list[int], costs: dict[str, int]) -> tuple[list[int], int]:
    """Cost to go of every state before a row from that behind it, and the best edits, two bits a state."""

    ways: list[list[int]] = []
    undeleted = costs["truncated"] if fault == TRUNCATED else 0
    for s in range(4):
        way = [costs["delete"] + after[s], FAR, FAR, FAR]
        if fault in (OK, TRUNCATED):
            if (kept := KEPT.get((s, initial))) is not None:
                way[KEEP] = undeleted + after[kept]
            way[REROLE] = costs["rerole"] + undeleted + after[FOLLOWS[s]]
        ways.append(way)
    here = [min(way) for way in ways]
    pair = here[USER], here[ASSISTANT]  # an insertion before the row leads from one state to another
    ways[USER][INSERT], ways[ASSISTANT][INSERT] = costs["insert"] + pair[1], costs["insert"] + pair[0]
    here[USER], here[ASSISTANT] = min(ways[USER]), min(ways[ASSISTANT])
    for s in (EMPTY, SYSTEM):
        ways[s][INSERT] = costs["insert"] + here[USER]
        here[s] = min(ways[s])
    return here, sum(ways[s].index(here[s]) << 2 * s for s in range(4))


def pointers(costs: dict[str, int]) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Back pointers of rows that come by conversation, last turn first."""

    end = [0, 2 * costs["insert"], costs["insert"], 0]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: object = run  # no conversation yet
        after = end
        for frame in frames:
            best = []
            for key, role, fault, gone in zip(frame["key"], frame["role_"], frame["fault"], frame["gone_"], strict=True):
                if key != current:
                    current, after = key, end
                if gone:
                    best.append(0)
                    continue
                after, edits = step(role[:1], fault, after, costs)
                best.append(edits)
            yield frame.assign(best=pd.array(best, "int32"))

    return run


def follow(frames: Iterable[pd.DataFrame]) -> Iterator[tuple]:
    """Edits of rows that come by conversation, first turn first.

    Yields ``(key, turn, initial, fault, edit, role, text)``; a conversation begins with ``(key,)`` and
    absent rows yield nothing.
    """

    current: object = follow
    state = EMPTY

    def close() -> Iterator[tuple]:
        nonlocal state
        while state in (SYSTEM, USER):
            state = FOLLOWS[state]
            yield current, None, None, OK, INSERT, ROLE[state], ""

    for frame in frames:
        columns = (frame[c] for c in ("key", "turn_", "role_", "text_", "gone_", "fault", "best"))
        for key, turn, role, text, gone, fault, best in zip(*columns, strict=True):
            if key != current:
                if current is not follow:
                    yield from close()
                current, state = key, EMPTY
                yield (key,)
            if gone:
                continue
            while (edit := best >> 2 * state & 3) == INSERT:
                state = FOLLOWS[state]
                yield key, None, None, OK, INSERT, ROLE[state], ""
            if edit == KEEP:
                state = KEPT[state, role[:1]]
            elif edit == REROLE:
                state = FOLLOWS[state]
                yield key, turn, role[:1], fault, edit, ROLE[state], text
                continue
            yield key, turn, role[:1], fault, edit, role, text
    if current is not follow:
        yield from close()


def followed(marked: DataFrame, costs: dict[str, int] | None) -> DataFrame:
    """Rows with back pointers, in order inside partitions that hold whole conversations."""

    kind = marked.schema["turn_"].dataType
    order = [F.col("turn_").cast(kind), F.col("role_"), F.col("text_")]
    backward = marked.sortWithinPartitions(F.col("key").asc_nulls_first(), *[c.desc_nulls_last() for c in order])
    # a whole number that may be null would become a floating one in pandas
    named = backward.withColumn("turn_", F.col("turn_").cast("string"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema)
    pointed = named.mapInPandas(pointers(COSTS | (costs or {})), f"{schema}, best int")
    return pointed.sortWithinPartitions(F.col("key").asc_nulls_first(), *[c.asc_nulls_first() for c in order])


def repair_conversations(
    rows: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    gone: str | None = None,
    costs: dict[str, int] | None = None,
) -> DataFrame:
    """Every edit: ``conv, seq, turn, fault, edit, role, text``, with deleted rows and inserted ones.

    ``fault`` is blank, duplicate, truncated or null, ``edit`` Keep, Rerole, Delete or Insert, ``role`` the role
    after it, ``seq`` the order in the conversation.  Rows count by turn, nulls first, then by role
    and text.  Null roles and texts are one space; rows of a null identifier are one conversation.
    Rows whose ``gone`` is true are absent.  Blank and duplicate rows are always deleted.  Other columns are
    left out whatever their names; an empty table gives no rows.  Identifiers may have any type that
    survives a cast to text; turns are whole numbers.
    """

    marked = marked_turns(rows, conv, turn, role, text, gone)
    names = ["Delete", "Insert", "Keep", "Rerole"]
    faults = [None, "blank", "duplicate", "truncated"]

    def edits(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["key", "seq", "turn_", "fault", "edit", "role", "text"]
        seq, out = 0, []
        for item in follow(frames):
            if len(item) == 1:
                seq = 0
                continue
            key, at, _, fault, edit, new, body = item
            out.append((key, seq, at, faults[fault], names[edit], new, body))
            seq += 1
            if len(out) == 1000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)

    done = followed(marked, costs).mapInPandas(edits, "key string, seq long, turn_ string, fault string, edit string, role string, text string")
    types = {c: rows.schema[c].dataType for c in (conv, turn)}
    return done.select(F.col("key").cast(types[conv]).alias(conv), "seq", F.col("turn_").cast(types[turn]).alias(turn), "fault", "edit", "role", "text")


def repair_audits(
    rows: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    gone: str | None = None,
    costs: dict[str, int] | None = None,
) -> DataFrame:
    """One row per conversation with what ``repair_conversations`` found and did, in constant memory but the audit.

    ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``: missing turn numbers, rows by
    first fault, neighbouring rows that may not follow each other before the repair, the cost and the initials of the edits,
    and the digest of the repaired ``role:text`` lines.  A conversation whose rows are all ``gone`` has zeros, an
    empty audit and the digest of nothing.
    """

    marked = marked_turns(rows, conv, turn, role, text, gone)
    price = COSTS | (costs or {})
    prices = [price["delete"], price["insert"], 0, price["rerole"]]
    columns = ["key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def audit(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        key: object = None
        counts: list[int] = []

        def begin() -> None:
            nonlocal counts, edits, digest, lines, initial, first, last, turns, illegal, cost
            counts, edits, digest, lines = [0] * 4, bytearray(), hashlib.sha256(), 0
            initial, first, last, turns, illegal, cost = None, None, None, 0, 0, 0

        edits, digest, lines, initial, first, last, turns, illegal, cost = bytearray(), hashlib.sha256(), 0, None, None, None, 0, 0, 0

        def close() -> None:
            gaps = last - first + 1 - turns if turns else 0
            out.append((key, gaps, *counts[1:], illegal, cost, edits.decode(), digest.hexdigest()))

        for item in follow(frames):
            if len(item) == 1:
                if counts:
                    close()
                key = item[0]
                begin()
                if len(out) >= 1000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
                continue
            _, at, was, fault, edit, new, body = item
            edits += INITIALS[edit].encode()
            cost += prices[edit]
            if edit != DELETE:
                cost += price["truncated"] if fault == TRUNCATED else 0
                digest.update((("\n" if lines else "") + new + ":" + body).encode())
                lines += 1
            if edit == INSERT:
                continue
            counts[fault] += 1
            if initial is not None and initial + was not in ("su", "ua", "au"):
                illegal += 1
            initial = was
            if at is not None:
                number = int(at)
                turns += number != last
                first, last = (number if first is None else first), number
        if counts:
            close()
        yield pd.DataFrame(out, columns=columns)

    done = followed(marked, costs).mapInPandas(
        audit, "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    )
    return done.select(F.col("key").cast(rows.schema[conv].dataType).alias(conv), *columns[1:])


def damaged(rows: DataFrame, draw: Column, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows spoilt by ``draw``: 0 gone, 1 empty, 2 without full stops, 3 twice, 4 said by the user.

    ``conv, turn, role, text, gone``: a row that is gone stays as a mark of its conversation.
    """

    body = F.coalesce(F.col(text), F.lit(" "))
    spoilt = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(body, "[.!?]", "")).otherwise(body)
    spoken = F.when(draw == 4, "user").otherwise(F.coalesce(F.col(role), F.lit(" ")))
    copies = F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = rows.select(F.col(conv), F.col(turn), spoken.alias(role), spoilt.alias(text), (draw == 0).alias("gone"), copies.alias("copies"))
    return out.select(conv, turn, role, text, "gone", F.explode("copies").alias("copy")).drop("copy")
