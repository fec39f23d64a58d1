import json
import random
import tracemalloc
from collections import Counter, deque
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import exprs as X
from palimpsest.operators import consolidate as C
from palimpsest.operators import graph as G
from palimpsest.operators import knowledge as K
from palimpsest.operators import record as R
from palimpsest.operators import working as W
from palimpsest.operators.numbering import numbered
from palimpsest.schema import Config
from palimpsest.sinks import store
from palimpsest.sinks.scratch import saved, temporary_tables
from palimpsest.sources import testdata as D
from palimpsest.sources.workspace import Paths, files_in_scope, read_events, read_knowledge
from palimpsest.streaming import pulse as P
from palimpsest.tools import MemoryWorkspace

NOW = datetime(2026, 3, 10, 12, 30, tzinfo=timezone.utc)


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_decay_golden(spark):
    ages = (0, 7, 30, 69, 70, 90)
    assert one(spark, *(X.apply_decay(F.lit(1.0), F.lit(a)).alias(str(a)) for a in ages)) == [1, 0.8507, 0.5, 0.2031, 0.1984, 0.125]


def test_score_golden(spark):
    cases = [(0.85, 2, 0.5725), (0.0, 0, 0.3), (1.0, 5, 0.7), (1.0, 9, 0.7), (1.7, 0, 0.55), (-1.0, 0, 0.3), (0.001, 4, 0.4203)]
    assert one(spark, *(X.compute_score(F.lit(i), F.lit(n)).alias(str(k)) for k, (i, n, _) in enumerate(cases))) == [e for *_, e in cases]


def test_confidence_and_ids(spark):
    cases = {"**Confidence**: 0.8": 0.8, "**confidence**: high": 0.9, "**Confidence**: High": 0.5, "**Confidence**: 0": 0.5, "**Confidence**: 1.2.3": 1.2, "nothing": 0.5, "**Confidence**: low": 0.3}
    assert one(spark, *(X.confidence(F.lit(c)).alias(str(i)) for i, c in enumerate(cases))) == list(cases.values())
    assert one(spark, X.event_id(F.lit(date(2026, 3, 4)), F.lit(3)), X.event_id(F.lit(date(2026, 3, 4)), F.lit(1000))) == ["evt_20260304_003", "evt_20260304_1000"]
    assert one(spark, X.associations(F.lit("**Associations**: ke_1, evt_2 [ke_3] ke_4;"))) == [["ke_1", "evt_2", "ke_4;"]]
    assert one(spark, X.trimmed(F.lit("　﻿ a b \t"))) == ["a b"]


def test_age_is_elapsed_days(spark):
    ts = F.lit("2024-01-30 23:00:00").cast("timestamp")
    assert one(spark, X.age_in_days(ts, F.lit("2024-02-01 22:59:59").cast("timestamp")), X.age_in_days(ts, F.lit("2024-01-01").cast("timestamp")))[:2] == [1, 0]


def test_view_limits(spark):
    for (p, q), e in {(5, 1): (5, 1), (2, 10): (2, 4), (0, 0): (0, 0), (3, 3): (3, 3), (9, 9): (3, 3)}.items():
        assert one(spark, *X.view_limits(F.lit(p), F.lit(q))) == list(e)


def events(spark, rows):
    return spark.createDataFrame(rows, "id string, ts timestamp, day date, consolidated boolean, decay_score double")


def test_classify_edges(spark):
    at = datetime(2026, 3, 10)
    rows = [("kept69", datetime(2025, 12, 31), None, True, 1.0), ("gone70", datetime(2025, 12, 30), None, True, 1.0), ("new", datetime(2025, 1, 1), None, False, 1.0), ("null", datetime(2025, 1, 1), None, None, 1.0)]
    rows += [("future", datetime(2027, 1, 1), None, True, 0.1), ("bad", None, None, True, 0.5), ("noscore", datetime(2025, 1, 1), None, True, None)]
    got = {r.id: r for r in C.classify(events(spark, rows), F.lit(at)).collect()}
    assert {k: r.action for k, r in got.items()} == {"kept69": "decayed", "gone70": "archived", "new": "unconsolidated", "null": "unconsolidated", "future": "kept", "bad": "kept", "noscore": "kept"}
    c = C.classify(events(spark, rows), F.lit(at))
    assert C.kept(c).count() + C.archived(c).count() == len(rows)
    assert C.archived(c).first().decay_score == 1.0
    once = C.kept(C.classify(events(spark, [("a", datetime(2026, 2, 8), None, True, 1.0)]), F.lit(at))).drop("age", "computed_score", "action")
    assert once.first().decay_score == 0.5 and C.kept(C.classify(once, F.lit(at))).first().decay_score == 0.25


def test_scope_is_pruned(spark):
    days = [date(2026, 3, d) for d in (2, 3, 10, 11)]
    df = spark.createDataFrame([(d,) for d in days], "day date")
    today = date(2026, 3, 10)
    assert [sorted(r.day.day for r in C.in_scope(df, s, today).collect()) for s in ("session", "day", "full")] == [[10], [3, 10, 11], [2, 3, 10, 11]]
    with pytest.raises(ValueError):
        C.in_scope(df, "week", today)


def bfs(nodes, evts, root, depth, direction):
    """The exploration in plain Python: nodes {id: links}, evts [(id, links)] in order; returns ordered nodes and all visited."""
    seen, out, queue = set(), [], deque([(root, 0)])
    while queue:
        x, d = queue.popleft()
        if x in seen or d > depth:
            continue
        seen.add(x)
        if x not in nodes:
            continue
        out.append((x, d))
        queue.extend((y, d + 1) for y in nodes[x])
        if direction != "forward":
            queue.extend((i, d + 1) for i, links in evts if x in links)
    return out, seen


@pytest.mark.parametrize("seed", [1, 2])
def test_explore_against_plain_bfs(spark, seed):
    rng = random.Random(seed)
    ids = [f"evt_{i}" for i in range(12)] + [f"ke_{i}" for i in range(4)]
    link = lambda: [rng.choice([*ids, "evt_gone", "ke_gone"]) for _ in range(rng.randint(0, 3))]
    evts = [(i, link()) for i in ids[:12]] + [("evt_3", link())]  # one id twice: the first counts
    kes = [(i, link()) for i in ids[12:]]
    nodes = {}
    for i, links in [*evts, *kes]:
        nodes.setdefault(i, links)
    schema = "id string, content string, importance double, associations array<string>, ord long"
    e = spark.createDataFrame([(i, "x", 0.5, a, n) for n, (i, a) in enumerate(evts)], schema)
    k = spark.createDataFrame([(i, "x", 0.5, a, 0) for i, a in kes], schema)
    roots = spark.createDataFrame([(i,) for i in [*ids, "evt_none"]], "root string")
    for direction in ("forward", "both", "backward"):
        n, g = G.nodes(e, k), G.edges(e, k, direction)
        got, loose = G.explore(roots, n, g, 2).collect(), G.explore(roots, n, g, 2, emit_dangling=True).collect()
        for root in [*ids, "evt_none"]:
            expect, seen = bfs(nodes, evts, root, 2, direction)
            mine = sorted((r for r in got if r.root == root), key=lambda r: (r.depth, r.at))
            assert [(r.id, r.depth) for r in mine] == expect, (direction, root)
            assert {r.id for r in mine} | {r.id for r in loose if r.root == root} == seen
    with pytest.raises(ValueError):
        G.edges(e, k, "up")
    both, back = (set(map(tuple, G.explore(roots, G.nodes(e, k), G.edges(e, k, d), 1).select("root", "id", "depth").collect())) for d in ("both", "backward"))
    assert both == back  # links are followed both ways by either
    places = G.ordered(G.explore(roots, G.nodes(e, k), G.edges(e, k, "both"), 2)).collect()
    assert all(sorted(r.ord for r in places if (r.root, r.depth) == key) == list(range(1, 1 + sum((r.root, r.depth) == key for r in places))) for key in {(r.root, r.depth) for r in places})


@pytest.mark.parametrize(("heavy", "few"), [(0, 256), (2, 5)])
def test_long_lists_against_plain_bfs(spark, monkeypatch, heavy, few):
    """Roots that share lists of links, several each: the same nodes, ways and places as pair by pair."""
    rng = random.Random(heavy)
    ids = [f"evt_{i}" for i in range(14)] + [f"ke_{i}" for i in range(3)]
    hub = lambda: rng.choice(["ke_0", "ke_1", "evt_1"])
    evts = [(i, [hub(), *(rng.choice([*ids, "evt_gone", "ke_gone"]) for _ in range(rng.randint(0, 2)))]) for i in ids[:14]] + [("evt_3", ["ke_0"])]
    kes = [(i, [rng.choice(ids), "ke_gone"]) for i in ids[14:]]
    nodes = {}
    for i, links in [*evts, *kes]:
        nodes.setdefault(i, links)
    schema = "id string, content string, importance double, associations array<string>, ord long"
    e = spark.createDataFrame([(i, "x", 0.5, a, n) for n, (i, a) in enumerate(evts)], schema)
    k = spark.createDataFrame([(i, "x", 0.5, a, 0) for i, a in kes], schema)
    roots, n, g = spark.createDataFrame([(i,) for i in [*ids, "evt_none"]], "root string"), saved(G.nodes(e, k), "n"), saved(G.edges(e, k), "g")
    monkeypatch.setattr(G, "BLOCK", 2)
    want = {r: bfs(nodes, evts, r, 2, "both") for r in [*ids, "evt_none"]}
    monkeypatch.setattr(G, "FEW", few)
    got = G.explore(roots, n, g, 2, places=True, about=G.about(n).select("id", F.size("associations").alias("links")), heavy=heavy).collect()
    loose = G.explore(roots, n, g, 2, emit_dangling=True, ways=False, heavy=heavy).collect()
    for root, (expect, seen) in want.items():
        mine = sorted((r for r in got if r.root == root), key=lambda r: (r.depth, r.at))
        assert [(r.id, r.depth, r.links) for r in mine] == [(i, d, len(nodes[i])) for i, d in expect]
        for d in range(3):
            assert [r.ord for r in mine if r.depth == d] == list(range(1, 1 + sum(x == d for _, x in expect)))
        assert sorted(r.id for r in loose if r.root == root) == sorted(seen - {i for i, _ in expect})
    assert {r.root: r.n_visited for r in G.visited(roots, n, g, 2, heavy=heavy).collect()} == {r: len(x) for r, (x, _) in want.items() if x}
    assert sorted(r.id for r in G.reached(roots.limit(3).withColumnRenamed("root", "id"), n, g, 2).collect()) == sorted(set().union(*(want[i][1] for i in ids[:3])))


def test_temporary_tables(spark):
    with temporary_tables(spark):
        gone = saved(spark.range(3), "gone")
        kept = saved(gone.selectExpr("id + 1 as id"), "kept", keep=True)
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="(?i)exist|not found|PATH_NOT_FOUND"):
        spark.read.parquet(gone.inputFiles()[0]).count()


def test_numbered(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, rng.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x long, y double").repartition(5)
    place: dict = {}
    for g, x, _ in sorted(rows, key=lambda r: r[1]):
        place[x] = 1 + sum(1 for h, z, _ in rows if h == g and z < x)
    assert {r.x: r.seq for r in numbered(df, ("g",), ("x",)).collect()} == place
    assert {r.x: r.n for r in numbered(df, (), ("x",), "n").collect()} == {i: i + 1 for i in range(500)} and numbered(df.limit(0), ("g",), ("x",)).count() == 0


def test_reinforce(spark):
    e = spark.createDataFrame([("a", 0.5), ("b", 1.0), ("c", 0.2), ("d", None)], "id string, decay_score double")
    v = spark.createDataFrame([("a",), ("b",), ("a",), ("d",)], "id string")
    assert {r.id: (r.decay_score, r.reinforced) for r in G.reinforce(e, v).collect()} == {"a": (1.0, True), "b": (1.0, False), "c": (0.2, False), "d": (None, False)}


def test_knowledge_blocks_and_index(spark):
    entry = lambda i, x, end=True: f"<!-- knowledge_entry: {i} -->\n## T\n{x}\n**Associations**: ke_9\n" + ("<!-- /knowledge_entry -->" if end else "")
    files = [("a.md", "# One\n> About things\n" + entry("ke_1", "late", False)), ("b.md", entry("ke_1", "first") + "\n" + entry("ke_1", "second") + "\n### sub\n  ## inner"), ("c.md", "abc\n" + "x" * 100), ("d.md", "")]
    df = spark.createDataFrame(files, "file string, content string")
    got = {r.id: r for r in K.entries(df).collect()}
    assert list(got) == ["ke_1"] and got["ke_1"].file == "b.md" and "first" in got["ke_1"].content and "second" not in got["ke_1"].content
    rows = {r.file: (r.n_entries, r.title, r.description) for r in K.index_rows(df).collect()}
    assert rows == {"a.md": (1, "One", "About things"), "b.md": (3, "b", "**Associations**: ke_9"), "c.md": (0, "c", "x" * 100 + "..."), "d.md": (0, "d", "")}
    text = K.render_index(K.index_rows(df))
    assert text.split("\n")[4] == "- `memory/knowledge/a.md` (1 entries) — **One**: About things" and len(text.split("\n")) == 8


def test_record_ids_and_log(spark):
    old = spark.createDataFrame([(date(2026, 3, 4),)] * 2, "day date")
    new = spark.createDataFrame([(datetime(2026, 3, 4, 9, 5), "insight", "hello"), (datetime(2026, 3, 4, 8), "error", "oh")], "ts timestamp, type string, content string")
    got = R.new_events(new, old).orderBy("id").collect()
    assert [(r.id, r.type, r.importance, r.tags, r.consolidated) for r in got] == [("evt_20260304_003", "error", 0.5, [], False), ("evt_20260304_004", "insight", 0.5, [], False)]
    log = R.new_events(new.withColumns({"tags": F.array(F.lit("t")), "associations": F.array(F.lit("ke_1"))}), old).orderBy("id").select(R.log_entry().alias("x")).collect()
    assert log[1].x == "### 09:05 — insight [importance: 0.5]\nhello\nTags: t | ID: evt_20260304_004 | Assoc: ke_1\n"


def test_auto_record(spark):
    rows = [("a", 1, "user", "I PREFER tabs"), ("a", 2, "assistant", "ok" * 400), ("b", 1, "user", "hello"), ("c", 1, "system", "remember"), ("d", 1, "user", "以后都这样")]
    t = spark.createDataFrame(rows, "session_id string, seq long, role string, text string")
    got = {r.session_id: r.content for r in R.auto_records(t).collect()}
    assert set(got) == {"a", "d"} and got["a"] == "User: I PREFER tabs\nAsst: " + ("ok" * 400)[:500]
    assert {r.session_id: r.new_session for r in R.last_turns(t).collect()} == {"a": False, "b": True, "c": True, "d": True}


def test_working_script():
    s = W.Focus()
    do = lambda action, **k: W.step(s, W.Action(action, **k))
    do("plan", goal="G", focus="F", path=("p1", "p2"))
    do("push", siblings=tuple(f"s{i}" for i in range(10)))
    assert do("complete", insight="learned") == ("Completed: F", "learned") and s.focus == "s0" and len(s.pending) == 9
    do("complete", next_focus="other")
    assert s.focus == "other" and s.pending[0] == "s1"
    assert "3 later steps" not in W.render_view(s) and "5 later steps" in W.render_view(s)
    do("overflow")
    assert not s.pending and len(s.scratchpad[W.OVERFLOW]) == 9
    do("scratchpad_refill")
    assert s.pending == ["s1", "s2", "s3", "s4"] and s.scratchpad[W.OVERFLOW] == [f"s{i}" for i in range(5, 10)]
    assert do("scratchpad_refill")[0].startswith("Focus stack is already")
    for bad in ({"action": "plan"}, {"action": "push"}, {"action": "scratchpad_append"}, {"action": "dance"}):
        with pytest.raises(ValueError):
            W.step(s, W.Action(**bad))
    e = W.Focus()
    assert W.step(e, W.Action("overflow"))[0] == "No pending siblings to overflow." and W.step(e, W.Action("complete"))[0] == "Completed: None" and e.focus == W.DONE


def test_working_fold_against_python(spark, sf):
    got = {r.workspace: r for r in W.fold(D.actions(spark, sf)).collect()}
    by: dict = {}
    for r in sorted(D.actions(spark, sf).collect(), key=lambda r: r.seq):
        W.step(by.setdefault(r.workspace, W.Focus()), W.Action(r.action, goal=r.goal, focus=r.focus, siblings=tuple(r.siblings)))
    assert set(got) == set(by)
    for k, s in by.items():
        assert (got[k].goal, got[k].focus, got[k].pending, got[k].overflow) == (s.goal, s.focus, s.pending, s.scratchpad.get(W.OVERFLOW, []))


def ticks(rows, limit=5):
    n, out = 0, []
    for seq, kind, new in rows:
        if kind == "mem":
            n = 0
        elif kind == "tool":
            n += 1
        elif not new and n >= limit:
            out.append((seq, n))
            n = 0
    return out


def trace_rows(seed=5):
    rng = random.Random(seed)
    return [(f"s{rng.randint(0, 3)}", i, rng.choice(["tool"] * 8 + ["mem", "prompt", "prompt"]), rng.random() < 0.2) for i in range(400)]


def test_pulse_batch(spark):
    rows = trace_rows() + [("t", i, k, False) for i, k in enumerate(["tool"] * 5 + ["prompt", "prompt", "tool", "mem"])]
    df = spark.createDataFrame(rows, "session_id string, seq long, kind string, new_session boolean")
    got = sorted((r.session_id, r.seq, r.ticks) for r in P.notices(df).collect())
    by: dict = {}
    for s, *r in rows:
        by.setdefault(s, []).append(r)
    assert got == sorted((s, *x) for s, rs in by.items() for x in ticks(rs)) and ("t", 5, 5) in got


def settle(q, rows):
    """Stop a stream that has read so many rows; state with a time to live keeps it from ending by itself."""
    for _ in range(240):
        if q.awaitTermination(0.5):
            return
        done = q.recentProgress
        if sum(p["numInputRows"] for p in done) >= rows and done[-1]["numInputRows"] == 0:
            break
    q.stop()


def test_pulse_stream_equals_batch(spark, tmp_path):
    rows = trace_rows(6)
    schema = "session_id string, seq long, kind string, new_session boolean"
    for k in range(2):
        spark.createDataFrame(rows[k * 200 : k * 200 + 200], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in/*"))
    q = P.stream_notices(stream).writeStream.format("memory").queryName("pulse").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    settle(q, len(rows))
    got = Counter(map(tuple, spark.table("pulse").collect()))
    assert got == Counter(map(tuple, P.notices(spark.createDataFrame(rows, schema)).collect())) and got


def test_context(spark):
    p = spark.createDataFrame([("a", 1, 1, True), ("b", 2, 2, False), ("c", 3, 3, False)], "session_id string, seq long, workspace long, new_session boolean")
    fired = spark.createDataFrame([("b", 2, 6)], "session_id string, seq long, ticks long")
    stacks = spark.createDataFrame([(1, "view", 3)], "workspace long, view string, used int")
    tele = spark.createDataFrame([(1, 4)], "workspace long, unconsolidated long")
    got = {r.session_id: r.context for r in P.context(p, fired, stacks, tele).collect()}
    assert "Active Focus\nview" in got["a"] and "Memory Index" in got["a"] and "Memory Index" in got["b"] and "New session" in got["a"] and "6 tool calls" in got["b"] and got["c"] is None


def write_day(ws, day, lines):
    path = ws.at.day_events(day)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")


def line(i, **more):
    return json.dumps({"id": i, "timestamp": "2026-01-01T00:00:00.000Z", "type": "insight", "content": i, "tags": [], "importance": 0.5, "associations": [], "consolidated": True, "decay_score": 1.0} | more)


def test_jsonl_strict_and_lenient(spark, tmp_path):
    ws = MemoryWorkspace(spark, tmp_path)
    assert read_events(spark, ws.at.events).count() == 0
    write_day(ws, "2026-01-01", [line("evt_a"), "", line("evt_b", importance="0.5", other=1)])
    write_day(ws, "2026-01-02", [line("evt_c", consolidated=False), "{bad"])
    assert sorted(r.id for r in read_events(spark, ws.at.events).collect()) == ["evt_a", "evt_b"]
    assert sorted(r.id for r in read_events(spark, ws.at.events, lenient=True).collect()) == ["evt_a", "evt_b", "evt_c"]
    assert ws.telemetry() == {"unconsolidated": 1, "used": 0}


def test_workspace_scenario(spark, tmp_path):
    ws = MemoryWorkspace(spark, tmp_path, Config())
    a = ws.record("first", "decision", NOW)
    b = ws.record("second", "insight", NOW, tags=["x"], importance=0.85, associations=[a["id"], "ke_1"])
    assert (a["id"], b["id"]) == ("evt_20260310_001", "evt_20260310_002")
    assert "Tags: x | ID: evt_20260310_002 | Assoc: evt_20260310_001, ke_1" in ws.at.day_log("2026-03-10").read_text()
    ws.at.knowledge.mkdir(parents=True)
    (ws.at.knowledge / "k.md").write_text("# K\n<!-- knowledge_entry: ke_1 -->\n**Confidence**: high\n**Associations**: evt_gone\n<!-- /knowledge_entry -->\n")
    rows, text = ws.explore(a["id"])
    assert [(r.id, r.depth) for r in rows] == [("evt_20260310_001", 0), ("evt_20260310_002", 1), ("ke_1", 2)] and "score: 0.5725" in text
    assert ws.explore("evt_none") == ([], "No entry found for ID: evt_none")
    write_day(ws, "2025-11-01", [line("evt_old", timestamp="2025-11-01T00:00:00.000Z", extra="kept")])
    write_day(ws, "2026-02-08", [line("evt_mid", timestamp="2026-02-08T12:30:00.000Z", extra="kept"), line("evt_loose", consolidated=False)])
    counts, _ = ws.consolidate(NOW, "full", dry_run=True)
    assert (counts["events_scanned"], counts["unconsolidated"], counts["decayed"], counts["archived"]) == (5, 3, 1, 1) and not ws.at.index.exists()
    counts, report = ws.consolidate(NOW, "full")
    assert "Archived (score < 0.2): 1" in report and ws.at.day_events("2025-11-01").read_text() == ""
    old = json.loads((ws.at.archive / "2025-11-01.jsonl").read_text())
    assert old["decay_score"] == 1.0 and old["extra"] == "kept"
    mid = json.loads(ws.at.day_events("2026-02-08").read_text().split("\n")[0])
    assert mid["decay_score"] == 0.5 and mid["extra"] == "kept"
    ws.explore("evt_mid")
    assert json.loads(ws.at.day_events("2026-02-08").read_text().split("\n")[0])["decay_score"] == 1.0
    assert "**K**" in ws.at.index.read_text()


def test_workspace_working(spark, tmp_path):
    ws = MemoryWorkspace(spark, tmp_path)
    ws.work("plan", NOW, goal="G", focus="F")
    ws.work("push", NOW, siblings=[f"s{i}" for i in range(9)])
    assert "Completed: F" in ws.work("complete", NOW, insight="learned") and read_events(spark, ws.at.events).first().content == "learned"
    ws.work("overflow", NOW)
    ws.work("scratchpad_append", NOW, section="Notes", content="n1")
    assert "Refilled 6 items" in ws.work("scratchpad_refill", NOW) and "## Notes" in ws.at.scratchpad.read_text()
    assert "7 items" in ws.work("status", NOW) and ws.telemetry()["used"] == 7
    with pytest.raises(ValueError):
        ws.work("push", NOW)
    said = ws.agent_end([{"role": "user", "content": [{"text": "please remember"}, {"text": "this"}]}, {"role": "assistant", "content": "ok"}], NOW)
    assert said["content"] == "User: please remember\nthis\nAsst: ok" and said["tags"] == ["auto-recorded"] and ws.agent_end([{"role": "user", "content": "hi"}], NOW) is None


def test_scratchpad_keeps_the_rest(spark, tmp_path):
    ws = MemoryWorkspace(spark, tmp_path)
    pad = "preamble\n\n# Scratchpad\nprose\n\n## Notes\n- [10:20] first\nsome *prose*\n### sub\n- x\n\n## Other\n* y\n"
    ws.at.active.mkdir(parents=True)
    ws.at.scratchpad.write_text(pad, encoding="utf-8")
    ws.at.focus_stack.write_text(json.dumps({"project_goal": "G", "current_path": ["p"], "current_focus": "F", "pending_siblings": [], "last_updated": "", "mine": {"a": 1}}))
    stamp = ws.at.scratchpad.stat().st_mtime_ns
    ws.work("push", NOW, siblings=[f"s{i}" for i in range(9)])
    assert ws.at.scratchpad.read_text() == pad and ws.at.scratchpad.stat().st_mtime_ns == stamp and json.loads(ws.at.focus_stack.read_text())["mine"] == {"a": 1}
    ws.work("scratchpad_append", NOW, section="Notes", content="second")
    with_note = pad.replace("## Notes\n", f"## Notes\n- [{NOW:%H:%M}] second\n")
    assert ws.at.scratchpad.read_text() == with_note
    ws.work("overflow", NOW)
    items = [f"- s{i}" for i in range(9)]
    assert ws.at.scratchpad.read_text() == with_note + f"\n## {W.OVERFLOW}\n- [{NOW:%H:%M}] \n" + "\n".join(items) + "\n"
    assert "Refilled 5 items" in ws.work("scratchpad_refill", NOW) and json.loads(ws.at.focus_stack.read_text())["pending_siblings"] == [f"s{i}" for i in range(5)]
    assert ws.at.scratchpad.read_text() == with_note + f"\n## {W.OVERFLOW}\n" + "\n".join(items[5:]) + "\n"
    ws.work("plan", NOW, goal="H", focus="F")
    assert "Refilled 4 items" in ws.work("scratchpad_refill", NOW) and ws.at.scratchpad.read_text() == with_note
    assert ws.work("scratchpad_refill", NOW) == "No overflow section found in scratchpad.md."
    assert W.with_note("", "A", "b", "01:02") == "# Scratchpad\n\n## A\n- [01:02] b\n" and W.without_items("## A\n", "B", 1) == "## A\n"


def test_calls_and_paths(spark, tmp_path, monkeypatch):
    ws = MemoryWorkspace(spark, tmp_path)
    text = lambda r: (r["content"][0]["type"], r["content"][0]["text"])
    assert text(ws.call("memory_record", NOW, content="c", type="insight")) == ("text", "Event recorded: evt_20260310_001\nType: insight | Importance: 0.5\nWritten to: .memory/events/2026-03-10.jsonl + memory/2026-03-10.md")
    assert text(ws.call("memory_working", NOW, action="push"))[1] == "Error: Action 'push' requires 'siblings' array."
    assert text(ws.call("memory_explore", NOW, entry_id="evt_x"))[1] == "No entry found for ID: evt_x" and text(ws.call("memory_consolidate", NOW, dry_run=True))[1].startswith("Consolidation (DRY RUN) complete:")
    assert text(ws.call("other", NOW))[1] == "Error: unknown tool: other" and text(ws.call("memory_record", NOW, content="c", type="x"))[1].startswith("Error")
    monkeypatch.chdir(tmp_path)
    assert Paths.of(None, "", "b", "c").workspace == "b" and Paths.of(None).workspace == str(tmp_path)


def test_archive_keeps_equal_lines_and_survives_a_break(tmp_path):
    day, archive = tmp_path / "d.jsonl", tmp_path / "a" / "d.jsonl"
    store.write_event_lines(day, ["x", "x", "y"])
    store.move_lines(day, ["y"], archive, ["x", "x"])
    assert archive.read_text() == "x\nx\n" and day.read_text() == "y\n"
    store.write_event_lines(day, ["x", "y"])
    store.write_json(archive.with_name(".d.jsonl.move"), {"lines": 2, "day": store._digest(day)})
    store.write_event_lines(archive, ["x", "x", "x"])  # a run that broke off before the day was written
    store.settle_moves(tmp_path, tmp_path / "a")
    assert archive.read_text() == "x\nx\n" and not list((tmp_path / "a").glob(".*"))
    store.write_json(archive.with_name(".d.jsonl.move"), {"lines": 2, "day": store._digest(day)})
    store.write_event_lines(archive, ["x", "x", "x"])
    store.write_event_lines(day, ["y"])  # and one that broke off after it
    store.settle_moves(tmp_path, tmp_path / "a")
    assert archive.read_text() == "x\nx\nx\n"


def test_rewriting_a_day_holds_no_day(tmp_path, monkeypatch):
    day, archive = tmp_path / "d.jsonl", tmp_path / "a" / "d.jsonl"
    n = 300_000
    store.write_event_lines(day, (f"{i:0100d}" for i in range(n)))
    tracemalloc.start()
    store.move_lines(day, (f"{i:0100d}" for i in range(0, n, 2)), archive, (f"{i:0100d}" for i in range(1, n, 2)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2_000_000  # the day has 30 MB
    assert day.stat().st_size == archive.stat().st_size == 101 * n // 2 and not list(tmp_path.glob("**/.*"))


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(600):
        (tmp_path / f"k{i}.md").write_bytes(b"# T\n\xc3\xa4" if i % 2 else b"")
    (tmp_path / ".hidden.md").write_text("x")
    (tmp_path / "other.txt").write_text("x")
    df = read_knowledge(spark, tmp_path)
    assert {r.file: r.content for r in df.collect()} == {f"k{i}.md": "# T\nä" if i % 2 else "" for i in range(600)}
    assert df.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism


def test_scope_of_files(tmp_path):
    for f in ("2026-03-02", "2026-03-03", "2026-03-10", "2026-03-11", "notes", "0"):
        (tmp_path / f"{f}.jsonl").write_text("")
    got = {s: [f.removesuffix(".jsonl") for f in files_in_scope(tmp_path, s, date(2026, 3, 10))] for s in ("session", "day", "full")}
    assert got == {"session": ["2026-03-10"], "day": ["2026-03-03", "2026-03-10", "2026-03-11", "notes"], "full": ["0", "2026-03-02", "2026-03-03", "2026-03-10", "2026-03-11", "notes"]}


def test_auto_record_stream(spark, tmp_path):
    schema = "session_id string, seq long, role string, text string"
    rows = [("a", 1, "user", "I PREFER tabs"), ("a", 2, "assistant", "ok"), ("a", 3, "end", None), ("b", 1, "user", "hello"), ("b", 2, "end", None), ("a", 4, "user", "fine"), ("a", 5, "end", None), ("c", 1, "end", None), ("b", 3, "assistant", "decided"), ("b", 4, "end", None)]
    for k in range(0, len(rows), 5):
        spark.createDataFrame(rows[k : k + 5], schema).write.parquet(str(tmp_path / f"in/{k:03d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in/*"))
    q = P.stream_auto_records(stream).writeStream.format("memory").queryName("exchanges").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    settle(q, len(rows))
    assert sorted(map(tuple, spark.table("exchanges").collect())) == [("a", 3, "User: I PREFER tabs\nAsst: ok"), ("b", 4, "User: hello\nAsst: decided")]


def test_day_tables(spark, tmp_path):
    table, archive = str(tmp_path / "t"), str(tmp_path / "a")
    df = spark.createDataFrame([(1, date(2026, 1, 1)), (2, date(2026, 1, 2)), (3, date(2026, 1, 3))], "x int, day date")
    store.write_days(df, table)
    now = spark.read.parquet(table)
    store.replace_days(now.where("x <> 1").withColumn("x", F.col("x") * 10), table, ["2026-01-01", "2026-01-02"])
    assert sorted(r.x for r in spark.read.parquet(table).collect()) == [3, 20]
    assert store.archive_days(df, archive, "r1") and not store.archive_days(df, archive, "r1")
    assert spark.read.parquet(archive).count() == 3


def test_sql_functions(spark):
    X.register(spark)
    r = spark.sql("select mem_decay(1D, 30L, 30D) d, mem_score(0.85D, 2L, 0.5D) s, mem_event_id(date'2026-03-04', 1000L) i, mem_round4(0.00005D) r").first()
    assert (r.d, r.s, r.i, r.r) == (0.5, 0.5725, "evt_20260304_1000", 0.0001)
