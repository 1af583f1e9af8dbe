"""Each stage of the pipeline on odd rows: nulls in any column, empty, blank and long texts, repeated rows, shared ids, an empty table, clashing columns."""

from collections import Counter

import pytest

import corpus_pipeline

from ..conftest import SMALL

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, label int, rank double, line string, taken_before int"
OWN = lambda i: " ".join(f"word{i}x{k}" for k in range(70))
MAIL = "write to ann@example.org now "
ROWS = [
    (1, OWN(1), "en", "a", 1), (1, OWN(1), "en", "a", 1), (1, OWN(2), None, "a", 1), (2, None, "en", "a", None), (3, "", "en", "a", 0), (4, " \n\t ", "en", "a", 4), (None, OWN(3), "en", None, 9), (None, None, None, None, None),
    (5, OWN(4) + "\n" + OWN(4).upper(), "en", "b", 1), (6, "\n".join(OWN(100 + i) for i in range(400)), "en", "b", 1), (7, MAIL + OWN(5), "de", None, 1), (8, OWN(1), "en", "a", 1), (9, "short", "en", "b", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", 7, 0.5, "line", 3) for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def outs(spark, docs):
    return {name: stage(spark, docs, SMALL) for name, stage in corpus_pipeline.STAGES}


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_columns_stay_and_empty_tables_are_empty(spark, docs, outs, name):
    last = name == corpus_pipeline.STAGES[-1][0]
    assert outs[name].columns == [*docs.columns, *["taken"] * last] and outs[name].schema[: len(docs.columns)] == docs.schema[: len(docs.columns)]
    assert {tuple(r)[5:10] for r in outs[name].collect()} == {("clash", 7, 0.5, "line", 3)}
    assert dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), SMALL).count() == 0


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_quality_rejects_rows_without_words(outs):
    assert kept(outs["quality rules"]) == Counter([(1, OWN(1)), (1, OWN(1)), (1, OWN(2)), (None, OWN(3)), (5, OWN(4) + "\n" + OWN(4).upper()), (6, ROWS[9][1]), (7, MAIL + OWN(5)), (8, OWN(1))])


def test_one_of_near_duplicates_stays(outs):
    got = kept(outs["n-gram Jaccard join"])
    assert got == Counter([(1, OWN(1)), (1, OWN(2)), (2, None), (3, ""), (4, " \n\t "), (None, OWN(3)), (None, None), (5, ROWS[8][1]), (6, ROWS[9][1]), (7, MAIL + OWN(5)), (9, "short")])


def test_clean_rows_pass_decontamination(docs, outs):
    assert kept(outs["benchmark decontamination"]) == kept(docs)


def test_personal_data_is_replaced_and_nothing_else(docs, outs):
    want = Counter({(d, t if d != 7 else None): n for (d, t), n in kept(docs).items()})
    got = kept(outs["personal data"])
    mail = [t for d, t in got if d == 7]
    assert len(mail) == 1 and "ann@" not in mail[0] and mail[0].startswith("write to ") and mail[0].endswith(OWN(5))
    assert Counter({(d, t if d != 7 else None): n for (d, t), n in got.items()}) == want


def test_the_mix_takes_words_of_rows_that_have_some(outs):
    rows = outs["mixing"].collect()
    size = lambda t: len((t or "").split())
    assert rows and all(0 < r.taken <= 2 * size(r.text) for r in rows)
    takes = {}
    for r in rows:
        takes.setdefault((r.doc_id, r.text), set()).add(r.taken)
    assert sum(len(v) > 1 for v in takes.values()) <= 1
