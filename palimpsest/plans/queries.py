"""The registered queries of the event memory: ``(spark, sf_dir) -> DataFrame``, each with the SQL that says the same."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import consolidate as C
from ..operators import graph as G
from ..operators import knowledge as K
from ..operators import record as R
from ..operators import working as W
from ..sinks.scratch import saved
from ..sinks.store import write_files, write_json
from ..sources import testdata as D
from ..sources.workspace import Paths, read_events
from ..streaming import pulse as P
from ..tools import MemoryWorkspace

TODAY = date.fromisoformat(D.TODAY)
#: The trigger words occur in no test conversation, so that one query adds two that do.
MORE_TRIGGERS = (*X.TRIGGERS, "the", "tion")


def joined(c: str) -> Column:
    return F.array_join(c, ",").alias(c)


def mem_events_scan(spark: SparkSession, sf: str) -> DataFrame:
    return D.mem(spark, sf).select("event_id", "id", "day", "type", "importance", joined("associations"), "consolidated", "decay_score")


def telemetry_unconsolidated(spark: SparkSession, sf: str) -> DataFrame:
    return D.mem_base(spark, sf).agg(F.count_if(X.is_unconsolidated()).alias("unconsolidated"), F.count("*").alias("events"))


def age_days(spark: SparkSession, sf: str) -> DataFrame:
    return D.mem_base(spark, sf).select("event_id", X.age_in_days("ts", D.reference()).alias("age"))


def decay_scores(spark: SparkSession, sf: str) -> DataFrame:
    aged = D.mem_base(spark, sf).withColumn("age", X.age_in_days("ts", D.reference()))
    return aged.select("event_id", X.apply_decay("decay_score", "age").alias("new_score"))


def decay_compounded_two_runs(spark: SparkSession, sf: str) -> DataFrame:
    """What a second run makes of the scores of the first: the whole age counts again."""
    once = C.kept(C.classify(D.mem_base(spark, sf), D.reference())).drop("age", "computed_score", "action")
    twice = C.classify(once, D.reference())
    return twice.select("event_id", "decay_score", "computed_score", "action")


def score_default_search(spark: SparkSession, sf: str) -> DataFrame:
    links = F.when(F.col("assoc_event_id").isNotNull(), 1).otherwise(0) + F.when(F.col("assoc_ke").isNotNull(), 1).otherwise(0)
    return D.mem_base(spark, sf).select("event_id", X.compute_score("importance", links).alias("score"))


def score_with_search(spark: SparkSession, sf: str) -> DataFrame:
    search = F.get_json_object("props", "$.k").cast("long") / F.lit(100.0)
    return D.mem_base(spark, sf).select("event_id", X.compute_score("importance", (F.col("event_id") % 8), search).alias("score"))


def rank_topk_per_type(spark: SparkSession, sf: str) -> DataFrame:
    scored = D.mem_base(spark, sf).select("event_id", "type", X.compute_score("importance", F.col("event_id") % 8).alias("score"))
    place = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("score"), "event_id"))
    return scored.withColumn("place", place.cast("long")).where("place <= 10")


def consolidate_classify(spark: SparkSession, sf: str) -> DataFrame:
    return C.classify(D.mem_base(spark, sf), D.reference()).select("event_id", "age", "computed_score", "action")


def consolidate_kept(spark: SparkSession, sf: str) -> DataFrame:
    return C.kept(C.classify(D.mem_base(spark, sf), D.reference())).select("event_id", "decay_score", "action")


def consolidate_archived(spark: SparkSession, sf: str) -> DataFrame:
    return C.archived(C.classify(D.mem_base(spark, sf), D.reference())).select("event_id", "decay_score", "computed_score")


def consolidate_report(spark: SparkSession, sf: str) -> DataFrame:
    return C.report(C.classify(D.mem_base(spark, sf), D.reference()))


def consolidate_report_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return C.report(C.classify(D.mem_base(spark, sf), D.reference()), "day")


def archive_union(spark: SparkSession, sf: str) -> DataFrame:
    """An archive of corrections that was there before, with what this run adds."""
    before = D.mem_base(spark, sf).where("type = 'correction'").select("event_id", "decay_score")
    return before.unionByName(consolidate_archived(spark, sf).select("event_id", "decay_score"))


def _scope(scope: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return C.report(C.classify(C.in_scope(D.mem_base(spark, sf), scope, TODAY), D.reference()), "day")

    return query


def edges_exploded(spark: SparkSession, sf: str) -> DataFrame:
    return G.edges(D.mem(spark, sf), direction="forward").select("src", "pos", "dst")


def assoc_degree(spark: SparkSession, sf: str) -> DataFrame:
    return G.edges(D.mem(spark, sf), direction="forward").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("links_in"))


def _graph(spark: SparkSession, sf: str, direction: str):
    """Roots, ids of nodes and links.  Events, entries and ids are written once, as a store would have them, without the contents;
    the links are by the exploration."""
    events = saved(D.mem(spark, sf).select("id", "associations", "ord"), "events")
    entries = saved(K.entries(D.know_files(spark, sf)).select("id", "associations", "ord"), "entries")
    ids, links = G.nodes(events, entries, fields=()), G.edges(events, entries, direction)
    return events.select(F.col("id").alias("root")), saved(ids, "ids"), links


def _explore(direction: str, depth: int, dangling: bool = False):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        heavy = None if direction == "forward" else G.HEAVY  # links out are few, and none are long lists
        return G.explore(*_graph(spark, sf, direction), depth, dangling, ways=False, heavy=heavy).select("root", "id", "depth")

    return query


def explore_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """With the place of each node in its level: by the parent's place, outgoing links first, then by position."""
    return G.explore(*_graph(spark, sf, "both"), 2, ways=False, places=True).select("root", "id", "depth", "ord")


def explore_scored_nodes(spark: SparkSession, sf: str) -> DataFrame:
    roots, ids, links = _graph(spark, sf, "both")
    nodes = G.nodes(D.mem(spark, sf), K.entries(D.know_files(spark, sf)))
    about = G.about(nodes).select("id", "kind", "importance", F.size("associations").cast("long").alias("n_links"), "score", F.length("content").cast("long").alias("n_chars"))
    return G.explore(roots, ids, links, 2, ways=False, about=about).select("root", "id", "depth", "kind", "importance", "n_links", "score", "n_chars")


def explore_visited(spark: SparkSession, sf: str) -> DataFrame:
    """How many nodes each exploration visits."""
    return G.visited(*_graph(spark, sf, "both"), 2)


def reinforced_events(spark: SparkSession, sf: str) -> DataFrame:
    """What explorations from every correction reinforce."""
    events = saved(D.mem(spark, sf).select("event_id", "id", "type", "associations", "decay_score", "ord"), "events")
    entries = saved(K.entries(D.know_files(spark, sf)).select("id", "associations", "ord"), "entries")
    ids, links = saved(G.nodes(events, entries, fields=()), "ids"), G.edges(events, entries, "both")
    met = G.reached(events.where("type = 'correction'").select("id"), ids, links, 2)
    return G.reinforce(events, met).where("reinforced").select("event_id", "decay_score")


def knowledge_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return K.entries(D.know_files(spark, sf)).select("file", "id", "content")


def knowledge_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return K.entries(D.know_files(spark, sf)).select("id", "importance")


def knowledge_assoc_parse(spark: SparkSession, sf: str) -> DataFrame:
    return K.entries(D.know_files(spark, sf)).select("id", joined("associations"))


def knowledge_index_rows(spark: SparkSession, sf: str) -> DataFrame:
    return K.index_rows(D.know_files(spark, sf)).withColumn("n_entries", F.col("n_entries").cast("long"))


def knowledge_index_render(spark: SparkSession, sf: str) -> DataFrame:
    return K.index_lines(K.index_rows(D.know_files(spark, sf)))


def daily_log_render(spark: SparkSession, sf: str) -> DataFrame:
    return D.mem(spark, sf).select("event_id", R.log_entry().alias("entry"))


def next_event_seq(spark: SparkSession, sf: str) -> DataFrame:
    return R.next_sequence(D.mem_base(spark, sf))


def last_turns(spark: SparkSession, sf: str) -> DataFrame:
    return R.last_turns(D.conversations(spark, sf)).select("session_id", "last_user", "last_assistant")


def new_session_flag(spark: SparkSession, sf: str) -> DataFrame:
    return R.last_turns(D.conversations(spark, sf)).select("session_id", "n_user", "n_assistant", "new_session")


def auto_record_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return R.auto_records(D.conversations(spark, sf)).select("session_id", "type", "content", "importance", joined("tags"))


def auto_record_more_words(spark: SparkSession, sf: str) -> DataFrame:
    return R.auto_records(D.conversations(spark, sf), MORE_TRIGGERS).select("session_id", "type", "content", "importance", joined("tags"))


def stack_usage(spark: SparkSession, sf: str) -> DataFrame:
    return D.stacks(spark, sf).select("workspace", X.stack_usage("current_path", "pending_siblings").cast("long").alias("used"))


def focus_view_7(spark: SparkSession, sf: str) -> DataFrame:
    v = W.focus_view(D.stacks(spark, sf))
    return v.select("workspace", joined("shown_path"), "current_focus", joined("shown_pending"), F.col("hidden_path").cast("long").alias("hidden_path"), F.col("hidden_pending").cast("long").alias("hidden_pending"))


def working_fold(spark: SparkSession, sf: str) -> DataFrame:
    return W.fold(D.actions(spark, sf)).select("workspace", "goal", joined("path"), "focus", joined("pending"), joined("overflow"), "n_done", "n_refused")


def pulse_ticks_batch(spark: SparkSession, sf: str) -> DataFrame:
    return P.notices(D.trace(spark, sf))


def _workspace(spark: SparkSession, sf: str, broken: bool = False) -> MemoryWorkspace:
    ws = MemoryWorkspace(spark, D.new_workspace(spark))
    D.event_files(spark, sf, ws.at.events, broken)
    return ws


def _scanned(lenient: bool):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        df = read_events(spark, _workspace(spark, sf, broken=True).at.events, lenient)
        return df.select("id", "day", "timestamp", "type", "content", "importance", joined("tags"), joined("associations"), "consolidated", "decay_score")

    return query


def workspace_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Unconsolidated events, line by line over files of which some hold lines that aren't JSON."""
    ws = _workspace(spark, sf, broken=True)
    return spark.createDataFrame([ws.telemetry()], "unconsolidated long, used long")


def workspace_next_seq(spark: SparkSession, sf: str) -> DataFrame:
    """The next number of each day's file: blank lines between its lines count, those at its end don't."""
    return R.next_in_files(spark, _workspace(spark, sf, broken=True).at.events).select("file", "next_seq")


def _consolidated(scope: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        """A whole run on files: what the days and the archive hold afterwards."""
        ws = _workspace(spark, sf)
        write_json(ws.at.focus_stack, {"last_updated": D.REFERENCE.replace(" ", "T") + "Z"})
        ws.consolidate(datetime.fromisoformat(D.TODAY + "T12:00:00+00:00"), scope)
        of = lambda folder, place: read_events(spark, folder).select(F.lit(place).alias("place"), "file", "id", "decay_score", F.get_json_object("_raw", "$.more").cast("long").alias("more"))
        return of(ws.at.events, "events").unionByName(of(ws.at.archive, "archive"))

    return query


def workspace_index_file(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of the index file that a consolidation writes, from knowledge files on disk."""
    ws = MemoryWorkspace(spark, D.new_workspace(spark))
    write_files(D.know_files(spark, sf).select("file", F.lit(0).alias("ord"), F.col("content").alias("line")), ws.at.knowledge)
    ws.consolidate(datetime.fromisoformat(D.TODAY + "T12:00:00+00:00"), "full")
    return spark.read.text(str(ws.at.index)).select(F.col("value").alias("line"))


def index_length(spark: SparkSession, sf: str) -> DataFrame:
    """How many characters the index has."""
    return K.index_lines(K.index_rows(D.know_files(spark, sf))).agg((F.sum(F.length("line")) + F.count("*") - 1).alias("index_chars"))


def path_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Every place of a workspace."""
    return spark.createDataFrame(Paths("ws").catalog("2024-01-05"), "name string, path string")


def tool_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Tool calls by whether they use memory."""
    name = F.concat(F.when(F.col("event_id") % 3 == 0, "memory_").when(F.col("event_id") % 3 == 1, "my_memory_").otherwise(""), F.col("event_type"))
    calls = D.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, name).alias("tool"))
    return calls.select("event_id", P.kind_of_tool(F.col("tool")).alias("kind"))


def age_of_text_times(spark: SparkSession, sf: str) -> DataFrame:
    """Ages of events whose times are text, some of which can't be read: those have none, and are kept."""
    text = F.when(F.col("event_id") % 10 == 0, "garbage").when(F.col("event_id") % 10 == 1, "").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    df = D.mem_base(spark, sf).withColumn("ts", F.try_to_timestamp(text))
    return C.classify(df, D.reference()).select("event_id", "age", "action")


def bullet_items(spark: SparkSession, sf: str) -> DataFrame:
    """Texts read as lists of items."""
    line = lambda k, c: F.concat(F.lit(k), F.col(c))
    pad = F.concat_ws("\n", line("- [10:20] ", "source"), line("* ", "lang"), F.lit("- [09:15]"), F.lit("-"), F.col("text"))
    return D.table(spark, sf, "documents").select("doc_id", F.array_join(W.items(pad), "|").alias("items"))


def scratchpad_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as scratchpads, each with a note in a section: the first that it has, or a new one."""
    docs = D.table(spark, sf, "documents")
    found = F.regexp_extract(F.concat(F.lit("\n"), F.col("text")), r"\n## ([^\n]*)", 1)
    section = F.when(F.trim(found) != "", F.trim(found)).otherwise("Notes")
    return W.noted(docs.select(F.col("doc_id").alias("key"), "text", section.alias("section"), F.concat(F.lit("seen "), F.col("doc_id").cast("string")).alias("content")), "10:20").select(F.col("key").alias("doc_id"), "text")


def record_bulk(spark: SparkSession, sf: str) -> DataFrame:
    """Events recorded at once: errors come after what their day already has; what isn't given has its default."""
    m = D.mem_base(spark, sf)
    new = m.where("type = 'error'").select("ts", "type", F.col("props").alias("content"), F.when(F.col("event_id") % 2 == 0, F.col("importance")).alias("importance"))
    done = R.new_events(new, m.where("type <> 'error'").select("day"))
    return done.select("id", "timestamp", "type", "content", "importance", joined("tags"), joined("associations"), "consolidated", "decay_score")


def prompt_context(spark: SparkSession, sf: str) -> DataFrame:
    """What each prompt of a trace is told; a session is new at its first event."""
    t = D.trace(spark, sf)
    t = t.join(t.groupBy("session_id").agg(F.min("seq").alias("first")), "session_id").select("session_id", "seq", "kind", (F.col("seq") == F.col("first")).alias("new_session"))
    t = saved(t, "trace")
    prompts = t.where("kind = 'prompt'").select("session_id", "seq", F.col("session_id").alias("workspace"), "new_session")
    stacks = D.stacks(spark, sf).select("workspace", F.concat(F.lit("Focus: "), F.col("current_focus")).alias("view"), X.stack_usage("current_path", "pending_siblings").alias("used"))
    e = D.table(spark, sf, "events").groupBy(F.col("user_id").alias("workspace")).agg(F.count_if(F.col("event_id") % 4 == 0).alias("unconsolidated"))
    return P.context(prompts, P.notices(t), stacks, e)


def session_state(spark: SparkSession, sf: str) -> DataFrame:
    return P.session_ticks(D.trace(spark, sf))


def focus_frontend(spark: SparkSession, sf: str) -> DataFrame:
    """The text that is shown of each focus queue."""
    return W.focus_frontends(D.stacks(spark, sf), "Goal", D.REFERENCE)


def derived_by_type_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """An extension: counts and mean scores by kind and day, with subtotals."""
    df = C.classify(D.mem_base(spark, sf), D.reference()).rollup("type", "day")
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("action") == "archived").alias("archived"), F.sum(F.floor(F.col("computed_score") * 10000 + 0.5).cast("long")).alias("score_sum"))


def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The scalar functions as SQL sees them."""
    X.register(spark)
    D.mem_base(spark, sf).createOrReplaceTempView("palimpsest_mem_base")
    return spark.sql(
        f"""select event_id, mem_decay(decay_score, mem_age_days(ts, timestamp'{D.REFERENCE}'), 30D) as new_score, mem_score(importance, event_id % 8, 0.5D) as score, mem_event_id(day, event_id) as id
        from palimpsest_mem_base"""
    )


def queries() -> dict:
    named = (
        mem_events_scan, telemetry_unconsolidated, age_days, decay_scores, decay_compounded_two_runs, score_default_search, score_with_search, rank_topk_per_type, consolidate_classify, consolidate_kept,
        consolidate_archived, consolidate_report, consolidate_report_by_day, archive_union, edges_exploded, assoc_degree, explore_ordered, explore_scored_nodes, explore_visited, reinforced_events,
        knowledge_resolve, knowledge_confidence, knowledge_assoc_parse, knowledge_index_rows, knowledge_index_render, daily_log_render, next_event_seq, last_turns, new_session_flag, auto_record_candidates,
        auto_record_more_words, stack_usage, focus_view_7, working_fold, pulse_ticks_batch, derived_by_type_rollup, sql_functions,
        workspace_telemetry, workspace_next_seq, workspace_index_file, index_length, path_catalog, tool_kinds, age_of_text_times, bullet_items, scratchpad_notes, record_bulk, prompt_context, session_state, focus_frontend,
    )
    out = {f.__name__: f for f in named}
    out |= {"jsonl_strict_scan": _scanned(False), "jsonl_lenient_scan": _scanned(True)} | {f"workspace_consolidate_{s}": _consolidated(s) for s in ("day", "full")}
    out |= {f"scope_{s}": _scope(s) for s in ("session", "day", "full")}
    out |= {f"explore_forward_d{d}": _explore("forward", d) for d in (1, 2, 3)} | {"explore_both_d2": _explore("both", 2), "explore_dangling": _explore("forward", 2, True)}
    return out
