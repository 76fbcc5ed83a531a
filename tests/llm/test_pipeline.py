"""The pipeline's stages against plain versions, and on odd tables."""

import corpus_pipeline as C

from tallyloom.llm.queries import table
from tests.llm.conftest import SF
from tests.llm.test_duplicates import brute_matches, grouped, sets_of
from tests.llm.test_texts import PII_BASE, plain


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    one = C.language_id(spark, docs, SF)
    assert one.columns == columns and one.count() >= 0.98 * docs.count()

    two = C.near_dedup(spark, docs, SF).collect()
    rows = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: sets_of(t, 5) for i, t in rows.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {r.doc_id for r in two} == {i for i, r in grouped(sets, links).items() if i == r}

    three = {r.doc_id for r in C.decontaminated(spark, docs, SF).collect()}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert three == set(rows) - {d for d, _ in brute_matches(list(rows.items()), items)}

    for r in C.redact(spark, docs, SF).collect():
        assert plain(r.text, PII_BASE) == "" and r.n_chars == len(r.text) if plain(rows[r.doc_id], PII_BASE) else r.text == rows[r.doc_id]

    last = C.tokenize(spark, docs, SF).collect()
    assert len(last) == len(rows) and all(r.lossless and r.n_tokens == len(r.ids) for r in last)


def test_run(spark):
    rows = C.run(spark, SF).collect()
    assert 0 < len(rows) <= 200 and len({r.doc_id for r in rows}) == len(rows)
    assert C.ORACLE_SQL is None and [n for n, _ in C.STAGES] == ["language_id", "near_dedup", "decontaminate", "redact", "tokenize"]


def test_repeated_rows_and_empty_tables(spark, empty):
    text = "some words that make a document of more than five words"
    docs = spark.createDataFrame([(1, text, "en", "s", 10), (1, text, "en", "s", 10), (2, text, "en", "s", 10), (3, None, None, None, None), (None, "other words", "en", "s", 1)], empty.schema)
    assert sorted((r.doc_id or 0) for r in C.near_dedup(spark, docs, SF).collect()) == [0, 1, 3]
    for _, stage in C.STAGES:
        assert stage(spark, empty, SF).count() == 0
