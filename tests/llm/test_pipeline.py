"""Each stage against a brute-force version on the stage's own input."""

import re
from itertools import combinations

import pytest
from test_dedup import SPACE, brute_components, brute_suffix, jaccard, shingled
from test_others import packed_right

import corpus_pipeline
from tessera.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, sf), "stage")
        out[name] = (docs.collect(), after.collect(), after.columns)
        docs = after
    return out


def test_columns(stages):
    assert list(stages) == ["language ID", "exact dedup", "simhash near-dedup", "suffix-array dedup", "best-fit packing"]
    for name, (_, _, columns) in list(stages.items())[:-1]:
        assert columns == COLUMNS, name


def test_language_keeps_what_has_letters(stages):
    before, after, _ = stages["language ID"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if re.search(r"[^\W\d_]", r.text or "")}


def test_exact_keeps_the_first_of_each_text(stages):
    before, after, _ = stages["exact dedup"]
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        first.setdefault(SPACE.sub(" ", r.text or ""), r)
    assert sorted(after, key=lambda r: r.doc_id) == sorted(first.values(), key=lambda r: r.doc_id)


def test_near_keeps_one_of_each_group(stages):
    before, after, _ = stages["simhash near-dedup"]
    sets = {r.doc_id: shingled(r.text) for r in before}
    likeness = {(a, b): jaccard(sets[a], sets[b]) for a, b in combinations(sorted(sets), 2)}
    groups = lambda s: {i for i, c in brute_components(set(sets), [p for p, j in likeness.items() if j >= s]).items() if i == c}
    kept = {r.doc_id for r in after}
    assert groups(0.72) <= kept <= groups(0.88)  # the likeness is estimated
    assert set(after) <= set(before)


def test_repeats_are_cut(stages):
    before, after, _ = stages["suffix-array dedup"]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    wanted = {r[0]: r[2] for r in brute_suffix([(r.doc_id, r.text) for r in before])}
    old = {r.doc_id: r for r in before}
    for r in after:
        cut = len(old[r.doc_id].text.encode()) - len(r.text.encode())
        assert wanted[r.doc_id] <= cut <= wanted[r.doc_id] + 6 * (wanted[r.doc_id] > 0) + 3
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (old[r.doc_id].lang, old[r.doc_id].source)
        if not wanted[r.doc_id]:
            assert r.text == old[r.doc_id].text


def test_all_is_packed(stages):
    from tokenizers import Tokenizer

    from tessera.llm.encoding import vocabulary

    before, after, _ = stages["best-fit packing"]
    n, least = packed_right(after, [(r.doc_id, r.text) for r in before], Tokenizer.from_file(vocabulary()))
    assert n <= least + 1


def test_run_is_its_stages(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() == len(stages["best-fit packing"][1]) and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_pass_through(spark, odd, none, empty):
    docs = none if empty else odd
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stored(stage(spark, docs, "unused"), "odd")
        if name != "best-fit packing":
            assert docs.columns == columns
    assert bool(docs.count()) != empty
