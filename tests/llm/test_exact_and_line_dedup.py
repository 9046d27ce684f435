from __future__ import annotations

import hashlib
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import line_dedup, queries
from quern.llm.exact_dedup import drop_exact_copies, exact_groups, task_salt
from quern.llm.line_dedup import chunks, dedup_lines, dedup_passages
from quern.session import materialize
from tests.llm.conftest import awkward_rows, words


def test_groups_of_awkward_rows(awkward):
    got = exact_groups(awkward, salts=3).collect()
    groups = defaultdict(list)
    for i, t in awkward_rows():
        groups[t or ""].append(i)
    want = Counter()
    for i, t in awkward_rows():
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None) if len(ids) > 1 else i
        kept = len(ids) == 1 or (i is not None and i == keep)
        want[(i, keep, len(ids), kept, hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want


def test_weak_digest_is_still_exact(make):
    rows = [(i, f"t{i % 3}") for i in range(30)]
    got = exact_groups(make(rows), digest=lambda t: F.lit("same"), salts=4)
    assert sorted({(r.keep_id, r.group_size) for r in got.collect()}) == [(27, 10), (28, 10), (29, 10)]


def test_empty_tables(empty):
    assert exact_groups(empty).count() == 0
    assert drop_exact_copies(empty).columns == empty.columns
    assert dedup_lines(empty).count() == 0


def test_drop_keeps_columns_and_largest_id(make):
    kept = drop_exact_copies(make([(1, "x"), (2, "x"), (3, None), (4, ""), (5, "y")]))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5]
    assert kept.columns == make([]).columns


def _line_chunks(text, window=3, modulus=4):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, now = [], []
    for i, line in enumerate(lines):
        now.append(line)
        rolled = sum(31**b * h[i - b] for b in range(window) if i - b >= 0)
        if rolled % modulus == 0 or i == len(lines) - 1:
            out.append(now)
            now = []
    return out


def test_chunks_follow_the_rolling_hash(spark):
    text = "\n".join(words(k, 5) for k in range(60))
    df = spark.createDataFrame([(text,), ("",), ("\n\n",)], "t string")
    got = df.select(chunks(F.col("t")).alias("c")).collect()
    for row, t in zip(got, [text, "", "\n\n"]):
        assert [c.text.split("\n") for c in row.c] == _line_chunks(t)


def test_line_dedup_matches_brute_force(make):
    shared = "\n".join(words(100 + k, 6) for k in range(25))
    rows = [(k, "\n".join([words(k, 4), shared, words(k + 50, 4), shared if k % 3 == 0 else ""])) for k in range(12)]
    rows += [(20, None), (21, ""), (22, "one line")]
    seen, want = set(), {}
    for i, t in sorted(rows):
        kept, gone = [], 0
        for chunk in _line_chunks(t or ""):
            body = "\n".join(chunk)
            if len(chunk) >= 2 and body in seen:
                gone += 1
            else:
                kept.append(body)
            if len(chunk) >= 2:
                seen.add(body)
        want[i] = ("\n".join(kept), gone)
    got = {r.doc_id: (r.text, r.n_removed_chunks) for r in dedup_lines(make(rows)).collect()}
    assert got == want
    assert sum(g for _, g in want.values()) > 20  # a shifted passage is found again


def test_line_dedup_of_awkward_rows(awkward):
    rows = dedup_lines(awkward).collect()
    assert len(rows) == len(awkward_rows())
    assert all(r.kept_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in rows)


def _without_passages(rows, least=50):
    """What stays after every run of more than ``least`` words that an earlier place holds
    goes; ids are unique and every line has words."""
    lines = [t.split("\n") for _, t in sorted(rows)]
    out = {}
    for d, (i, _) in enumerate(sorted(rows)):
        now, gone = lines[d], set()
        for k in range(len(now)):
            for e in range(d + 1):
                for j in range(len(lines[e]) if e < d else k):
                    n = 0
                    while k + n < len(now) and j + n < len(lines[e]) and now[k + n] == lines[e][j + n]:
                        n += 1
                    if sum(len(x.split()) for x in now[k : k + n]) > least:
                        gone |= set(range(k, k + n))
        out[i] = ("\n".join(x for k, x in enumerate(now) if k not in gone), len(gone))
    return out


def test_passages_of_few_lines_are_all_found(make):
    rng = random.Random(5)
    rows, seed, planted = [], 0, 0
    for n in [1, *range(2, 9)] * 3:
        passage = "\n".join(words(5000 + 10 * seed + j, 51 if n == 1 else 60 // n + 1) for j in range(n))
        for _ in range(2):
            around = [[words(10_000 + 100 * seed + 10 * s + j, rng.randint(3, 30)) for j in range(rng.randint(0, 4))] for s in (0, 1)]
            rows.append((len(rows), "\n".join([*around[0], passage, *around[1]])))
            seed += 1
        planted += n
    # short passages stay, periods and repeats inside a text are reduced to one
    rows.append((900, "\n".join([words(1, 30), words(2, 30)] * 3)))
    rows += [(901, words(3, 20) + "\n" + words(4, 30)), (902, words(3, 20) + "\n" + words(4, 30) + "\nx")]
    want = _without_passages(rows)
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in dedup_passages(make(rows)).collect()}
    assert got == want
    both = {r.doc_id: set(r.text.split("\n")) for r in dedup_lines(make(rows), least_words=50).collect()}
    assert all(both[i] <= set(t.split("\n")) for i, (t, _) in want.items())
    assert set().union(*both.values()) | {""} == {x for _, t in rows for x in t.split("\n")} | {""}  # the first of every line stays
    assert sum(n for _, n in want.values()) == planted + 4
    by_chunks = dedup_lines(make(rows)).agg(F.sum("n_removed_lines")).first()[0]
    assert by_chunks < planted / 2  # disjoint chunks miss most of them


def test_passages_of_awkward_rows(awkward, empty, make):
    rows = dedup_passages(awkward).collect()
    assert len(rows) == len(awkward_rows()) and dedup_passages(empty).count() == 0
    assert all(r.kept_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in rows)
    a, b = words(1, 30), words(2, 30)
    texts = [(1, f"\n{a}\n\n{b}\n\nx"), (2, f"{a}\n{b}\n\ny"), (3, f"{a}\n{b}"), (3, f"z\n{a}\n{b}"), (None, f"{a}\n \n{b}")]
    got = sorted((r.text, r.n_removed_runs) for r in dedup_passages(make(texts)).collect())
    assert got == sorted([(texts[0][1], 0), ("y", 1), ("", 1), ("z", 1), ("", 1)])


def test_chunks_and_passages_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op1_line_dedup"]).df()
    got = queries.QUERIES["op1_line_dedup"](spark, folder).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and got["n_removed_runs"].sum() > 50 and got["n_removed_chunks"].sum() > 20
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


def test_drop_tells_texts_of_one_id_apart_and_keeps_one_row_of_each(make):
    rows = [(1, "x"), (2, "x"), (1, "only here"), (3, "y"), (3, "y"), (3, "y"), (None, "z"), (None, "z"), (None, "x"), (4, None), (4, "")]
    kept = drop_exact_copies(make(rows))
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter(
        [(2, "x"), (1, "only here"), (3, "y"), (None, "z"), (4, "")]
    )
    assert kept.columns == make([]).columns


def test_a_hot_text_leaves_each_task_once(spark, make):
    """One text holds a third of the rows: a task sends one row of it, whatever the salts."""
    rows = make([(k, "hot" if k % 3 == 0 else f"t{k}") for k in range(3000)]).repartition(4)
    salted = rows.select(F.col("text"), task_salt(200).alias("salt"), F.col("doc_id"))
    assert salted.filter("text = 'hot'").groupBy("text", "salt").count().count() == 4
    got = exact_groups(rows, salts=200)
    assert got.filter("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("group_size")).first()[:] == (1000, 2997, 1000)
    assert {r.doc_id for r in drop_exact_copies(rows, salts=200).collect()} == {2997, *(k for k in range(3000) if k % 3)}


def test_drop_takes_weak_digests_and_keeps_the_winners_columns(spark):
    rows = [(1, "x", None, "a"), (2, "x", 1, "b"), (3, "y", 2, None), (None, "y", 3, "d"), (None, None, 4, "e"), (5, "", 5, "f")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _row int, _text string")
    kept = drop_exact_copies(docs, digest=lambda t: F.lit("same"), salts=3)
    assert sorted(tuple(r) for r in kept.collect()) == [rows[1], rows[2], rows[5]]
    assert kept.schema == docs.schema


def test_chunks_of_one_digest_are_told_apart_and_stay(make):
    shared = "\n".join(words(100 + k, 6) for k in range(25))
    rows = make([(k, f"{words(k, 4)}\n{shared}") for k in range(6)])
    assert dedup_lines(rows, digest=lambda t: F.md5(t)).agg(F.sum("n_removed_chunks")).first()[0] > 5
    assert dedup_lines(rows, digest=lambda t: F.lit("same")).agg(F.sum("n_removed_chunks")).first()[0] == 0


def test_a_hot_chunk_is_grouped_after_its_join_is_written(make, monkeypatch):
    """A passage in a third of the rows: the grouped tables are read from files, so the skewed join can be split."""
    shared = "\n".join(words(100 + k, 6) for k in range(12))
    rows = make([(k, f"{words(k, 4)}\n{shared if k % 3 == 0 else words(k + 9999, 8)}") for k in range(300)])
    tables = []
    monkeypatch.setattr(line_dedup, "materialize", lambda df, tag="t": tables.append(df) or materialize(df, tag))
    assert dedup_lines(rows).agg(F.sum("n_removed_chunks")).first()[0] >= 99
    joins = [d._jdf.queryExecution().optimizedPlan().toString() for d in tables]
    assert any(p.lstrip().startswith("Project") and "Join Inner" in p and "Aggregate" not in p for p in joins)
