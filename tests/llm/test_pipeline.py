"""The pipeline against plain Python, stage by stage and as a whole."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline as P
from palimpsest.llm import quality_ledger

from .test_operators import BENCH, LOWER, jaccard, measures, repeated


@pytest.fixture(scope="module")
def rows(sf):
    return duckdb.sql(f"select doc_id, text, lang, source, n_chars from '{sf}/documents.parquet' order by doc_id").fetchall()


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


def good(t):
    n, chars, symbols, dup, again = measures(t)
    lines = sum(bool(x.split()) for x in (t or "").split("\n"))
    abuse = sum(w.strip(".,;:!?()\"'|#*$%&<>").lower() in quality_ledger.ABUSE for w in (t or "").split())
    capitals = sum("A" <= c <= "Z" for c in t or "")
    return n >= 50 and 2 * again <= n and 10 * symbols <= n and 100 * dup <= 40 * lines and 2 * n <= chars <= 20 * n and 100 * capitals <= 35 * chars and not (abuse >= 2 and 500 * abuse > n)


def test_run(spark, sf, rows):
    kept = [r for r in rows if good(r[1])]
    assert Counter(r.doc_id for r in P.quality_rules(spark, frame(spark, rows), sf).collect()) == Counter(r[0] for r in kept)
    deduped = P.dedup_lines(spark, frame(spark, kept), sf).collect()
    lost = repeated([r[:2] for r in kept])
    texts = {r.doc_id: r.text for r in deduped}
    for i, t, *_ in kept:
        left = sum(bool(x.split()) for x in t.split("\n")) - lost[i]
        assert (i in texts) == (left > 0) and (not left or sum(bool(x.split()) for x in texts[i].split("\n")) == left)
    assert all(r.n_chars == len(r.text) for r in deduped)
    classes = jaccard([(r.doc_id, r.text) for r in deduped])
    heads = {i for i, c, _ in classes if i == c}
    once = [tuple(r) for r in deduped if r.doc_id in heads]
    assert Counter(r.doc_id for r in P.near_duplicates(spark, frame(spark, [tuple(r) for r in deduped]), sf).collect()) == Counter(heads)
    items = duckdb.sql(f"select text from '{sf}/benchmark.parquet'").fetchall()
    words = lambda t: BENCH.findall((t or "").translate(LOWER))
    windows = {tuple(w[k : k + 8]) for (t,) in items for w in [words(t)] for k in range(max(1, len(w) - 7) if w else 0)}
    lengths = {len(w) for w in windows}
    clean = [r for r in once if not any(tuple(w[k : k + n]) in windows for w in [words(r[1])] for n in lengths for k in range(len(w) - n + 1))]
    done = P.run(spark, sf).collect()
    assert Counter(r.doc_id for r in done) == Counter(r[0] for r in clean) and 0 < len(clean) < len(rows)
    from tokenizers import Tokenizer

    from palimpsest.llm.common import tokenizer_path

    library = Tokenizer.from_file(tokenizer_path())
    by = {r[0]: r[1] for r in clean}
    assert all(r.ids == library.encode(by[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in done)


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stages_take_anything(spark, sf, rows, name, stage):
    odd = [(None, None, None, None, None), (None, "null id " * 40, "en", "s", 0), (None, "other " + "null id text " * 40, "en", "s", 0), (1, "", "en", "s", 0), (1, None, "en", None, 0)] + [rows[0], rows[0], (rows[0][0], "same id, other text " * 20, "en", "s", 3)]
    got = stage(spark, frame(spark, odd), sf)
    assert stage(spark, frame(spark, odd).limit(0), sf).count() == 0
    if name != P.STAGES[-1][0]:
        assert tuple(got.columns) == P.COLUMNS
    found = Counter((r.doc_id, r.text) for r in got.collect()) if "text" in got.columns else None
    if name == "n-gram Jaccard join":
        assert found[rows[0][:2]] == 1 and sum(found.values()) == 7  # all but the repeated row
