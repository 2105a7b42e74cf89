import hashlib
import struct
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from graphloom.llm import jaccard, registry
from graphloom.llm.common import stored

from .test_jaccard import plain_groups
from .test_native import plain_targets

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        out.append((name, docs))
    return out


def rows(df):
    return df.select("doc_id", "text", "lang", "source", "n_chars").collect()


def test_stages_return_documents(stages):
    names = [n for n, _ in stages[1:]]
    assert names == ["language_id", "quality_classifier", "ngram_jaccard_join", "mixing", "sentencepiece"]
    for _, df in stages[1:-1]:
        assert df.columns == stages[0][1].columns
    counts = [df.count() for _, df in stages]
    assert counts[0] >= counts[1] > counts[2] > counts[3] and counts[4] == counts[5]


def test_filters_keep_clean_documents(spark, stages):
    kept = [{r["doc_id"] for r in rows(df)} for _, df in stages[:3]]
    assert len(kept[1]) >= 0.99 * len(kept[0])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {i for i, q in labels.items() if q == 1} & kept[1]
    poor = {i for i, q in labels.items() if q == 0} & kept[1]
    assert len(good & kept[2]) >= 0.98 * len(good) and len(poor & kept[2]) <= 0.2 * len(poor)


def test_one_document_of_each_group_stays(stages):
    before = [(r["doc_id"], r["text"]) for r in rows(stages[2][1])]
    expected = {i for i, (_, c) in plain_groups(before, 5, 80).items() if i == c}
    assert Counter(r["doc_id"] for r in rows(stages[3][1])) == Counter(expected)


def test_mixture_of_what_is_left(stages):
    before, after = rows(stages[3][1]), rows(stages[4][1])
    words = lambda r: len(r["text"].split())
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r["source"]] += words(r)
    for r in after:
        taken[r["source"]] += words(r)
    assert max(Counter(r["doc_id"] for r in after).values()) <= 2 and {tuple(r) for r in after} <= {tuple(r) for r in before}
    for s, t in plain_targets(sizes, [3, 1, 2]).items():
        assert abs(taken[s] - t) <= max(words(r) for r in before if r["source"] == s)


def test_tokens_of_the_mixture(stages):
    import sentencepiece

    from graphloom.llm.pieces import default_model

    library = sentencepiece.SentencePieceProcessor(model_proto=default_model())
    texts = {r["doc_id"]: r["text"] for r in rows(stages[4][1])}
    got = stages[5][1].collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows(stages[4][1]))
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_odd_documents_pass(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(None, "One text here.", "en", None, 3), (None, "One text here.", "en", None, 3), (1, None, None, "a", None), (2, "", "en", "a", 0), (3, "Two words.", "en", "a", 9), (3, "Two words.", "en", "a", 9)], schema)
    kept = corpus_pipeline.near_duplicates(spark, df, SMALL)
    assert Counter(r["doc_id"] for r in kept.collect()) == {None: 1, 1: 1, 2: 1, 3: 1}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), SMALL).count() == 0
        stage(spark, df, SMALL).collect()


def test_registry_against_sql(spark):
    """The operators' queries on the smallest tables against their SQL."""
    con = duckdb.connect()
    for name in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    for name, sql in registry.oracle_sql().items():
        got, expected = registry.queries()[name](spark, SMALL).toPandas(), con.execute(sql).df()
        columns = sorted(expected.columns)
        assert sorted(got.columns) == columns and len(got) == len(expected), name
        a, b = (df[columns].sort_values(columns).reset_index(drop=True).astype(object) for df in (got, expected))
        assert ((a == b) | (a.isna() & b.isna())).all().all(), name


def test_names_and_parameters():
    assert sorted(registry.queries()) == sorted(f"op{i}_{n}" for i, n in enumerate(("embedding_dedup", "ngram_jaccard", "sentencepiece", "token_counts", "topk", "language_id", "quality", "chat", "mixing", "sharding"), 1))
    assert jaccard.op2_ngram_jaccard.__module__.startswith("graphloom.llm")


def test_one_row_of_each_group_stays_without_ids_and_with_repeated_ids(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    rows = [
        (None, "One text here.", "en", None, 3), (None, "One text here.", "en", "a", 3),  # copies without an id
        (5, words, "en", "a", 1), (None, words, "en", "a", 1), (None, words + " more", "en", "a", 1),  # copies of a document with an id
        (7, words + " end", "en", "a", 1), (7, other, "en", "a", 1),  # one id; only one text is a copy
        (9, other + " end", "en", "b", 1), (3, "Two words.", "en", "a", 9), (3, "Two words.", "en", "a", 9),
        (None, None, "en", "a", 0), (None, None, "en", "a", 0), (4, "", "en", "a", 0), (4, "", "en", "a", 0),  # without words: no groups
    ]
    df = spark.createDataFrame(rows, schema).repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, df, SMALL)
    assert kept.columns == df.columns
    found = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert found == {(None, "One text here."): 1, (5, words): 1, (7, other): 1, (3, "Two words."): 1, (None, None): 2, (4, ""): 2}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), SMALL).count() == 0
        stage(spark, df, SMALL).collect()


def test_stages_keep_columns_of_clashing_names(spark):
    """Columns named like whatever a stage adds come back with their own values."""
    names = ["lang_pred", "score", "accepted", "predicted", "size", "src", "copies", "row", "shard", "order", "id", "doc", "print", "rank", "h", "group", "_maybe", "_at", "_row", "component_id", "n_shingles", "bits"]
    texts = [f"Some plain words number {i} are here, and {i * 7} more of them follow in this text." for i in range(6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    df = spark.createDataFrame([(i % 5, t, "en", "a" if i % 2 else None, 5, *(f"{n} {i}" for n in names)) for i, t in enumerate([*texts, texts[0]])], schema)
    every = {tuple(r) for r in df.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SMALL)
        assert out.columns == df.columns, name
        assert {tuple(r) for r in out.collect()} <= every, name
    assert {tuple(r) for r in corpus_pipeline.near_duplicates(spark, df, SMALL).collect()} == {tuple(r) for r in df.limit(6).collect()}
    assert corpus_pipeline.sentencepiece(spark, df, SMALL).count() == 7
