from __future__ import annotations

import random

import pytest

import corpus_pipeline
from quern.llm import queries
from quern.llm.exact_dedup import exact_groups
from quern.llm.queries import tokenizer_path
from tests.llm.conftest import words
from tests.llm.test_decontaminate_and_secrets import plain_words
from tests.llm.test_simhash import classes, plain_fingerprint
from tests.llm.test_tokens import WORDS, check_packing, library


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents (copies, near copies, contamination, junk), labels, benchmark."""
    root = tmp_path_factory.mktemp("corpus")
    rng = random.Random(4)
    bench = [(k, words(900 + k, 40)) for k in range(5)]
    rows = []
    for k in range(240):
        text = "\n".join(words(1000 * k + j, 12).capitalize() + "." for j in range(rng.randint(3, 20)))
        if k % 6 == 0:
            text = " ".join(w.upper() + "$$$" for w in text.split())
        elif k % 11 == 0:
            text += " " + bench[k % 5][1]
        rows.append((k, text))
    rows += [(300 + k, rows[k + 1][1]) for k in range(0, 60, 3)]
    rows += [(400 + k, rows[k + 1][1].replace(" ", "  ", 1)) for k in range(1, 60, 7)]
    rows += [(500, None), (501, "")]
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows]
    labels = [(k, int(k % 6 != 0), 0) for k in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), docs, bench


def test_stages_against_brute_force(spark, corpus):
    root, docs, bench = corpus
    now = spark.read.parquet(f"{root}/documents.parquet")
    columns = now.columns
    stages = dict(corpus_pipeline.STAGES)
    out = stages["quality"](spark, now, root)
    kept = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == columns
    junk = {i for i, t, *_ in docs if t and "$$$" in t}
    assert not junk & set(kept) and len(kept) >= len(docs) - len(junk) - 2

    out = stages["exact_copies"](spark, out, root)
    largest = {}
    for i, t in kept.items():
        largest[t or ""] = max(i, largest.get(t or "", i))
    kept = {i: t for i, t in kept.items() if largest[t or ""] == i}
    assert {r.doc_id for r in out.collect()} == set(kept) and out.columns == columns

    out = stages["near_copies"](spark, out, root)
    ids = sorted(kept)
    fps = [plain_fingerprint(kept[i]) for i in ids]
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    kept = {ids[k]: kept[ids[k]] for k, c in enumerate(classes(len(ids), pairs)) if c == k}
    assert {r.doc_id for r in out.collect()} == set(kept) and out.columns == columns

    out = stages["decontaminate"](spark, out, root)
    grams = {tuple(w[j : j + 13]) for _, t in bench for w in [plain_words(t)] for j in range(len(w) - 12)}

    def contaminated(text):
        w, hit = plain_words(text), set()
        for i in range(len(w) - 12):
            if tuple(w[i : i + 13]) in grams:
                hit |= set(range(i, i + 13))
        return bool(hit) and 20 * len(hit) >= len(w)

    kept = {i: t for i, t in kept.items() if not contaminated(t)}
    assert {r.doc_id for r in out.collect()} == set(kept) and out.columns == columns

    rows = stages["pack"](spark, out, root).collect()
    tokens = {i: len(x) + 1 for i, x in zip(kept, library(WORDS)([t or "" for t in kept.values()]))}
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == tokens
    assert check_packing(rows, 4096) <= -(-sum(tokens.values()) // 4096) + 1

    whole = corpus_pipeline.run(spark, root).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows)


def plain(v) -> str:
    """A value as text: one mark for null, numbers as numbers (120.0 is 120)."""
    import pandas as pd

    if pd.isna(v):
        return ""
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_copies", "near_copies", "decontaminate", "pack"]
    assert exact_groups and tokenizer_path(WORDS).endswith(WORDS)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_over_the_corpus(spark, corpus, name):
    root, docs, _ = corpus
    result = queries.QUERIES[name](spark, root)
    if "doc_id" in result.columns:
        assert result.select("doc_id").distinct().count() == len(docs)
    if name in queries.ORACLE_SQL:
        import duckdb

        con = duckdb.connect()
        for table in ("documents", "benchmark", "labels"):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{root}/{table}.parquet/*.parquet'")
        want = con.sql(queries.ORACLE_SQL[name]).df()
        got = result.toPandas()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        a, b = (sorted(tuple(map(plain, row)) for row in x[columns].astype(object).itertuples(index=False)) for x in (got, want))
        assert a == b
