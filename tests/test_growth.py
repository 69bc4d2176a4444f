"""Steps whose work or memory grew faster than their input."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.operators import analytics, evidence, files, fuzzy, search
from threadloom.sources.tables import FILE_EDITS, MESSAGES, shaped


def test_phrases_split_messages_once(spark):
    """What follows the repeated phrases reads them; before, plans with fewer columns split all messages again."""
    rows = [(i, f"s{i % 3}", i, "user", "silver lining of the cloud forest") for i in range(6)]
    m = shaped(spark.createDataFrame(rows, "id long, session_id string, seq long, role string, content string"), MESSAGES)
    found = analytics.repeated_phrases(m, least=2, most=4, max_examples=0)
    assert "content" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.phrase, r.matches, r.sessions) for r in found.collect()][0] == ("lining of the cloud", 6, 3)


def test_informative_ngrams_are_those_of_all(spark):
    r = random.Random(5)
    words = ["the", "of", "a", "cloud", "x1", "1234", "abc", "éa", "été", "forest", "and", "zz"]
    given = [[r.choice(words) for _ in range(r.randrange(9))] for _ in range(300)]
    w = spark.createDataFrame([(g,) for g in given], "w array<string>")
    made = w.select(text.informative_ngrams(F.col("w"), F.transform("w", text.word_mark), 2, 4).alias("got"), F.filter(text.ngrams(F.col("w"), 2, 4), text.informative).alias("want")).collect()
    assert all(x.got == x.want for x in made) and sum(len(x.got) for x in made) > 300


def plain_replay(rows):
    out, key, version, content = [], None, 0, None
    for session, path, seq, new, edits in rows:
        if (session, path) != key:
            key, version, content = (session, path), 0, None
        version += 1
        if new is not None:
            content = new
        elif content is None or not edits:
            content = None
        else:
            for e in edits:
                if not e["old"] or e["old"] not in content:
                    content = None
                    break
                content = content.replace(e["old"], e["new"], -1 if e["replace_all"] else 1)
        out.append((session, path, version, seq, content))
    return out


def test_replay_of_batches(monkeypatch):
    r = random.Random(3)
    one = lambda: {"old": r.choice(["a", "b", "zz", "", None]), "new": r.choice(["b", "aa", ""]), "replace_all": r.random() < 0.5}
    rows = []
    for session in (None, "s", "t"):
        for path in (None, "f", "g"):
            rows += [(session, path, i, r.choice(["ab", "aab", "", None, None, None, None]), r.choice([None, [], [one()], [one(), one()]])) for i in range(r.randrange(1, 60))]
    kinds = pa.schema([("session_id", pa.string()), ("file_path", pa.string()), ("seq", pa.int64()), ("new_content", pa.string()), ("edits", pa.list_(pa.struct([("old", pa.string()), ("new", pa.string()), ("replace_all", pa.bool_())]))), ("ts", pa.timestamp("us", tz="UTC"))])
    for size, whole, most in ((7, 0, 250), (100, 1 << 20, 1 << 20), (1000, 1 << 20, 1)):
        monkeypatch.setattr(files, "WHOLE_BATCH", whole)
        batches = [pa.RecordBatch.from_pylist([{**dict(zip(kinds.names, x)), "ts": None} for x in rows[i : i + size]], kinds) for i in range(0, len(rows), size)]
        got = [(x["session_id"], x["file_path"], x["version"], x["seq"], x["content"]) for b in files.replayed(iter(batches), most) for x in b.to_pylist()]
        assert got == plain_replay(rows)


def test_files_are_named_once_while_sorted(spark):
    edits = shaped(spark.createDataFrame([("s", 1, "p1", "claude"), ("s", 2, None, "codex"), ("s", 3, "p1", "claude")], "session_id string, seq long, file_path string, provider string"), FILE_EDITS)
    m = shaped(spark.createDataFrame([("s", 1, "user", "hello")], "session_id string, seq long, role string, content string"), MESSAGES)
    rows = evidence.candidates(m, edits, 220, False).filter("section = 3")
    assert rows.filter("name is not null or kind is not null").count() == 0
    shown = evidence.evidence(m, edits, limit=5).filter("section = 'changed_files'").select("name", "kind", "edits").collect()
    assert sorted(map(tuple, shown), key=str) == [("p1", "claude", 2), (None, "codex", 1)]


def test_fuzzy_page_scores_once(spark):
    """The filter and the columns of a page read one score; before, each ran the scorer over all rows in workers of its own."""
    m = shaped(spark.createDataFrame([("s", i, "user", "conversation", t) for i, t in enumerate(["enti on", "none", None, "e n t i o n"])], "session_id string, seq long, role string, kind string, content string"), MESSAGES)
    r = search.SearchRequest(query="enti on", mode="fuzzy", limit=3)
    found = search.page(search.matching(m, r), r).select("session_id", "seq", "fuzzy_score", "fuzzy_places")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(x.seq, (x.fuzzy_score, x.fuzzy_places)) for x in found.collect()] == [(i, fuzzy.match("enti on", t)) for i, t in ((3, "e n t i o n"), (0, "enti on"))]


def test_fuzzy_scores_hold_one_slice():
    """Besides the batch a scorer holds one slice of it; before, arrays over a million letters."""
    r = random.Random(8)
    given = [" ".join(r.choice(["then", "tion", "enter", "of", "Thion", "and"]) for _ in range(100)) for _ in range(6000)]
    want = [fuzzy.match("enti on", t) for t in given[:50]]
    tracemalloc.start()
    got = fuzzy.match_all("enti on", given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[:50] == want and len(got) == 6000 and sum(map(len, given)) > 2_000_000
    assert peak < 30e6


def test_slices_cover_all_texts(monkeypatch):
    monkeypatch.setattr(fuzzy, "SLICE", 10)
    r = random.Random(4)
    for sizes in [[], [0], [11], [0, 0, 10, 0, 1], *([r.choice([0, 1, 4, 10, 25]) for _ in range(40)] for _ in range(50))]:
        runs = list(fuzzy.sliced(np.array(sizes, dtype=np.int32)))
        assert [i for a, b in runs for i in range(a, b)] == list(range(len(sizes)))
        assert all(b - a == 1 or sum(sizes[a:b]) <= 10 for a, b in runs)
