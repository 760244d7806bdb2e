import hashlib
import heapq
import random
import zlib

import pytest

from martlib.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\f\r"
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        code = zlib.crc32(name.encode()) % 20
        if code == 0:
            yield conv, None
            continue
        if code == 1:
            text = ""
        if code == 2:
            text = "".join(c for c in text if c not in ".!?")
        for _ in range(2 if code == 3 else 1):
            yield conv, (turn, "user" if code == 4 else role, text)


def cheapest(turns):
    """Edits by a search that takes whole (cost, letters) strings in order."""
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, letters, i, state, made = heapq.heappop(heap)
        if (i, state, letters) in done:
            continue
        done.add((i, state, letters))
        if i == len(turns) and state in (0, 3):
            return cost, letters, made
        new = "a" if state == 2 else "u"
        name = {"u": "user", "a": "assistant"}[new]
        if letters[-2:] != "II":
            heapq.heappush(heap, (cost + 3, letters + "I", i, STEPS[state, new], (*made, name + ":")))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, state, made))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if (state, role[:1]) in STEPS:
                    after = STEPS[state, role[:1]]
                    heapq.heappush(heap, (cost + more, letters + "K", i + 1, after, (*made, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 3 + more, letters + "R", i + 1, STEPS[state, new], (*made, f"{name}:{text}")))


def by_hand(pairs):
    talks = {}
    for conv, turn in pairs:
        talks.setdefault(conv, [])
        if turn is not None:
            talks[conv].append(turn)
    out = {}
    for conv, rows in talks.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns, counts, illegal = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, None: 0}, 0
        for n, (_, role, text) in enumerate(rows):
            body = text.rstrip(SPACES)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else None
            if fault is None and body[-1] not in ".!?":
                fault = "truncated"
            counts[fault] += 1
            seen.add((role, text))
            if n and rows[n - 1][1][:1] + role[:1] not in ("su", "ua", "au"):
                illegal += 1
            turns.append((role, text, fault))
        numbers = {r[0] for r in rows if r[0] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        cost, letters, made = cheapest(turns)
        digest = hashlib.sha256("\n".join(made).encode()).hexdigest()
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, letters, digest)
    return out


def random_rows(n, seed, most=7):
    r, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(r.randint(1, most)):
            role = r.choice(["user", "assistant"] * 3 + ["system", "tool", "", None])
            text = r.choice(["Ja.", "Nein!", "so\nso?", "cut off", "", " \t", None, f"text {turn}.", "é. \n"])
            turn = r.choice([turn] * 8 + [turn // 2, None])
            rows.append((r.choice([conv, conv, conv, None]) if conv % 9 == 0 else conv, turn, role, text))
    return rows


def results(df):
    return {r["conv_id"]: tuple(r[c] for c in C.COLUMNS) for r in df.collect()}


@pytest.mark.parametrize("block_rows", [1, 3, 65_536])
def test_repairs_equal_a_plain_search(spark, block_rows):
    rows = random_rows(120, 5)
    turns = C.damaged(spark.createDataFrame(rows, SCHEMA)).repartition(3)
    assert results(C.repair(turns, block_rows)) == by_hand(list(damage(rows)))


def test_query_on_stored_rows_with_extra_columns(spark, tmp_path):
    rows = random_rows(60, 8)
    data = [(*r, "x", "y") for r in rows]
    spark.createDataFrame(data, SCHEMA + ", audit string, lost string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert results(C.op12_conversation_repair(spark, str(tmp_path))) == by_hand(list(damage(rows)))


def test_repaired_turns_give_the_reported_hash(spark):
    rows = random_rows(80, 11)
    turns = C.damaged(spark.createDataFrame(rows, SCHEMA))
    reports = C.repair(turns)
    made = {}
    for r in C.repaired_turns(turns, reports).orderBy("place").collect():
        made.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in reports.collect():
        whole = "\n".join(made.get(r.conv_id, []))
        assert hashlib.sha256(whole.encode()).hexdigest() == r.repaired_sha256
        assert len(made.get(r.conv_id, [])) == len(r.audit) - r.audit.count("D")


def test_one_giant_conversation(spark):
    """Rows of one conversation, many alike, cross many batches and blocks."""
    n = 30_000
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Text {i % 1000 if i >= 20_000 else i}.") for i in range(n)]
    made = C.repair(spark.createDataFrame(rows, SCHEMA), 1000).collect()
    assert len(made) == 1
    row = made[0]
    assert (row.gaps, row.blank, row.truncated, row.illegal) == (0, 0, 0, 0)
    repeats = n - len({r[2:] for r in rows})
    assert row.duplicate == repeats and row.audit == "K" * (n - repeats) + "D" * repeats
    whole = "\n".join(f"{r[2]}:{r[3]}" for r in rows[: n - repeats])
    assert row.repaired_sha256 == hashlib.sha256(whole.encode()).hexdigest() and row.cost == 4 * repeats


def test_empty_tables_and_long_texts(spark):
    assert C.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "wort " * 400_000 + "."
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "assistant", long)]
    row = C.repair(spark.createDataFrame(rows, SCHEMA)).first()
    assert (row.duplicate, row.illegal, row.audit, row.cost) == (1, 1, "KKD", 4)
    assert row.repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()
    lost = spark.createDataFrame([(7, None, None, None, True)], SCHEMA + ", lost boolean")
    assert results(C.repair(lost)) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
