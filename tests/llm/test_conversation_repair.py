import hashlib
import heapq
import re
import zlib

import pytest
from pyspark.sql import functions as F

from spanloom.llm.conversations import damaged, repair_audits, repair_conversations

ROWS = "conv_id long, turn long, role string, text string"
WHOLE = re.compile(r"(s?(ua)+)?")
BEGUN = re.compile(r"|s?(ua)*u?")


def cheapest(rows):
    """Cost, audit and repaired lines by best-first search over whole prefixes of the repaired roles."""

    heap, seen = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if i == len(rows) and WHOLE.fullmatch(roles):
            return cost, audit, out
        if (i, roles[-1:]) in seen:
            continue
        seen.add((i, roles[-1:]))
        new = [(x, {"u": "user", "a": "assistant"}[x]) for x in "ua" if BEGUN.fullmatch(roles + x)]
        for x, name in new:
            heapq.heappush(heap, (cost + 3, audit + "I", i, roles + x, (*out, name + ":")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, out))
            if fault in ("", "truncated"):
                extra = 3 if fault else 0
                if role[:1] in ("s", "u", "a") and BEGUN.fullmatch(roles + role[:1]):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, roles + role[:1], (*out, f"{role}:{text}")))
                for x, name in new:
                    heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, roles + x, (*out, f"{name}:{text}")))


def plain(rows):
    """What ``repair_audits`` should say of ``(turn, role, text)`` rows of one conversation."""

    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faulty, counts = set(), [], {"": 0, "blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not marks else "duplicate" if (role, text) in seen else "" if marks[-1] in ".!?" else "truncated"
        seen.add((role, text))
        counts[fault] += 1
        faulty.append((role, text, fault))
    cost, audit, lines = cheapest(faulty)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:], strict=False))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest


def conversations():
    import random

    rng = random.Random(11)
    rows = {}
    for c in [*range(60), None, 2**60 + 1]:
        n = rng.choice([0, 1, 2, 3, 5, 9])
        rows[c] = [
            (
                rng.choice([i, i, i, i + 2, None, 2**60 + i]),
                rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]),
                rng.choice(["Yes.", "No", "Why?", "", " \n\t", None, f"Text {i}.", f"Cut {i}", "é!", "Hm. "]),
            )
            for i in range(n)
        ]
        rows[c] += rows[c][:1] if rng.random() < 0.3 else []
    return rows


def flat(rows):
    return [(c, *r) for c, own in rows.items() for r in own]


def test_audits_equal_best_first_search(spark):
    rows = conversations()
    got = {r[0]: tuple(r)[1:] for r in repair_audits(spark.createDataFrame(flat(rows), ROWS)).collect()}
    assert got == {c: plain(own) for c, own in rows.items() if own}


def test_edits_give_the_audits_and_other_columns_do_no_harm(spark):
    df = spark.createDataFrame(flat(conversations()), ROWS).selectExpr("*", "1 as key", "2 as best", "'x' as fault", "0 as gone_", "7 as seq")
    edits = repair_conversations(df).orderBy("conv_id", "seq").collect()
    lines, audits = {}, {}
    for r in edits:
        audits[r.conv_id] = audits.get(r.conv_id, "") + r.edit[0]
        if r.edit != "Delete":
            lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in repair_audits(df).collect():
        assert r.audit == audits[r.conv_id]
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest()


def test_a_conversation_longer_than_a_batch_and_string_identifiers(spark):
    rows = [("long", i, ["user", "assistant"][i % 2], f"Turn {i}.") for i in range(25_000)] + [("other", 0, "user", "Hi.")]
    rows[12_345] = ("long", 12_345, "user", "Turn 12345")
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {r.conv_id: r for r in repair_audits(df).collect()}
    assert got["long"].audit == "K" * 12_345 + "R" + "K" * 12_654 and got["long"].cost == 6
    assert got["other"].audit == "KI" and got["long"].truncated == 1


def test_empty_table_and_a_conversation_that_is_gone(spark):
    empty = spark.createDataFrame([], ROWS)
    assert repair_audits(empty).count() == 0 and repair_conversations(empty).count() == 0
    gone = spark.createDataFrame([(1, 1, "user", "x", True)], ROWS + ", gone boolean")
    row = repair_audits(gone, gone="gone").first()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("draw,want", [(0, []), (1, [("user", "")]), (2, [("user", "No way")]), (3, [("user", "No. way!")] * 2), (4, [("user", "No. way!")]), (5, [("user", "No. way!")])])
def test_damage(spark, draw, want):
    df = spark.createDataFrame([(1, 1, "user", "No. way!")], ROWS)
    rows = damaged(df, F.lit(draw)).where("not gone").select("role", "text").collect()
    assert [tuple(r) for r in rows] == want


def test_damage_draws_by_checksum(spark):
    df = spark.createDataFrame([(None, None, "assistant", "a.")], ROWS)
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    assert df.select(F.crc32(name)).first()[0] == zlib.crc32(b" : ")
