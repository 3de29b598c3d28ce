"""Conversation repair against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from terrapanel.llm import conversations
from terrapanel.llm.queries import QUERIES
from terrapanel.llm.survivors import Search

SF = "/root/testdata/sf0.001"
NEXT = {("E", "s"): "S", ("E", "u"): "U", ("S", "u"): "U", ("A", "u"): "U", ("U", "a"): "A"}
SCHEMA = "conv_id long, turn long, role string, text string, rows string, cost long"


def cheapest(rows):
    """(cost, audit, repaired) over all edits, with whole audits in every state. rows: (role, text, fault)."""

    def inserted(best):
        best, moved = dict(best), True
        while moved:
            moved = False
            for state, (cost, audit, out) in list(best.items()):
                for role in ("user", "assistant"):
                    after = NEXT.get((state, role[0]))
                    new = (cost + 3, audit + "I", out + [role + ":"])
                    if after and (after not in best or new[:2] < best[after][:2]):
                        best[after], moved = new, True
        return best

    best = {"E": (0, "", [])}
    for role, text, fault in rows:
        found = {}

        def offer(state, new):
            if state and (state not in found or new[:2] < found[state][:2]):
                found[state] = new

        for state, (cost, audit, out) in inserted(best).items():
            offer(state, (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 if fault == "truncated" else 0
            offer(NEXT.get((state, role[:1])), (cost + extra, audit + "K", out + [f"{role}:{text}"]))
            for other in ("user", "assistant"):
                offer(NEXT.get((state, other[0])), (cost + extra + 3, audit + "R", out + [f"{other}:{text}"]))
        best = found
    ends = inserted(best)
    return min(ends[s] for s in "EA" if s in ends)


def plain(rows):
    """The query's rows from (conv_id, turn, role, text)."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        said = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        role, text = said[2:]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        groups[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    found = []
    for conv, taken in groups.items():
        taken.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged = set(), []
        for _, role, text in taken:
            inked = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not inked else "duplicate" if (role, text) in seen else "truncated" if inked[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        count = lambda f: sum(r[2] == f for r in judged)
        turns = {t for t, _, _ in taken if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, audit, out = cheapest(judged)
        digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
        found.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, digest))
    return sorted(found, key=str)


def as_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_whole_table_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_rows(QUERIES["op11_conversation_repair"](spark, SF)) == plain(rows)


def awkward_rows():
    rng = random.Random(11)
    texts = [None, "", " \n", "Yes.", "No!", "well", "Yes. \t", "Straße 漢字。", "ok?", "a\nb."]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "uther"]
    rows = [
        (conv if conv % 7 else None, rng.choice([None, 0, 1, 2, 5, 5, 9, i]), rng.choice(roles[: rng.choice([2, 3, 8])]), rng.choice(texts))
        for conv in range(1, 40)
        for i in range(rng.choice([1, 2, 5, 12]))
    ]
    rows += [(100, i, ("user", "assistant")[i % 2], f"Turn {i}{'.' if i % 5 else ''}") for i in range(600)]
    rows += [(101, i // 3, "user", "same") for i in range(90)]
    return rows + rows[:20]


def test_awkward_rows_over_many_ranges(spark, monkeypatch):
    rows = awkward_rows()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    want = plain(rows)
    for size in (conversations.RECORD_ROWS, 7):
        monkeypatch.setattr(conversations, "RECORD_ROWS", size)
        done = conversations.digest(conversations.repaired(conversations.damaged(docs.repartition(5))))
        assert as_rows(done) == want


def test_edits_build_the_repaired_conversation(spark):
    rows = awkward_rows()
    docs = conversations.damaged(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA))
    edits = defaultdict(list)
    for r in conversations.repaired_turns(docs).collect():
        edits[r.conv_id].append((r.place, r.edit, r.role, r.text))
    for conv, *_, audit, digest in plain(rows):
        own = sorted(edits[conv])
        assert "".join(e for _, e, _, _ in own) == audit
        kept = [f"{role}:{text}" for _, e, role, text in own if e != "D"]
        assert hashlib.sha256("\n".join(kept).encode()).hexdigest() == digest
        assert re.fullmatch("(s?(ua)+)?", "".join(k[0] for k in kept))


def test_no_rows_and_dropped_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repaired(conversations.damaged(empty)).count() == 0
    gone = next(i for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = conversations.repaired(conversations.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.", "", 1)], SCHEMA))).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_search_matches_whole_paths_and_stays_small():
    rng = random.Random(2)
    for _ in range(2000):
        roles = ["user", "assistant", "system", "tool", " ", "uther"][: rng.choice([2, 3, 6])]
        faults = ["", "truncated", "blank", "duplicate"][: rng.choice([1, 2, 4])]
        rows = [(rng.choice(roles), str(i), rng.choice(faults)) for i in range(rng.choice([0, 1, 2, 4, 9, 30]))]
        done = []
        search = Search(lambda *edit: done.append(edit), patience=rng.choice([1, 3, 32]))
        for role, text, fault in rows:
            if fault in ("blank", "duplicate"):
                search.delete(1)
            else:
                search.row(role, text, fault == "truncated")
        cost = search.finish()
        out = [f"{role}:{text}" for _, role, text in done if role is not None]
        assert (cost, "".join(e[0] for e in done), out) == cheapest(rows)
    search = Search(lambda *edit: None)
    for _ in range(20000):
        search.row(rng.choice(["user", "assistant", "tool"]), "x", rng.random() < 0.3)
    assert search.held < 200
