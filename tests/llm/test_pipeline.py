from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm.common import written

from .helpers import ROWS, documents
from .test_jaccard import plain
from .test_packing import check as check_packing

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(written(f(spark, out[-1], SF)))
    return out


def test_stages_return_documents(steps):
    for a in steps[1:-1]:
        assert a.dtypes == steps[0].dtypes


def test_quality_and_language_keep_clean_documents(spark, steps):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for before, after in zip(steps[:2], steps[1:3]):
        a, b = ({r.doc_id: r.text for r in s.collect()} for s in (before, after))
        assert set(b) <= set(a) and all(a[i] == b[i] for i in b)
        good = [i for i in a if i in labels and labels[i].quality == 1 and not labels[i].toxic]
        assert np.mean([i in b for i in good]) > 0.95
    bad = [i for i, r in labels.items() if r.quality == 0]
    kept = {r.doc_id for r in steps[1].collect()}
    assert np.mean([i in kept for i in bad]) < 0.2


def test_one_of_each_near_duplicate_group_stays(steps):
    a, b = ({r.doc_id: plain(r.text) for r in s.collect()} for s in steps[2:4])
    near = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    ids = sorted(a)
    link = {i: [j for j in ids if j != i and a[i] and min(len(a[i]), len(a[j])) >= 0.8 * max(len(a[i]), len(a[j])) and near(a[i], a[j])] for i in ids}
    group = {}
    for i in ids:
        if i in group:
            continue
        todo, group[i] = [i], i
        while todo:
            for j in link[todo.pop()]:
                if j not in group:
                    group[j] = i
                    todo.append(j)
    assert set(b) == set(group.values()) and len(b) < len(a)


def test_mix_repeats_whole_documents(steps):
    a, b = ({r.doc_id: r for r in s.collect()} for s in steps[3:5])
    assert set(b) <= set(a) and all(a[i] == b[i] for i in b)
    times = Counter(r.doc_id for r in steps[4].collect())
    assert set(times.values()) <= {1, 2}
    size = lambda s: sum(len(r.text.split()) for r in s.collect())
    assert size(steps[4]) == pytest.approx(1.5 * size(steps[3]), rel=0.05)


def test_packing_of_what_is_left(spark, steps):
    rows = [(r.doc_id, r.text) for r in steps[4].collect()]
    check_packing(spark, steps[4], rows)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    mine = Counter(tuple(r[c] for c in cols) for r in steps[5].collect())
    run = Counter(tuple(r[c] for c in cols) for r in corpus_pipeline.run(spark, SF).collect())
    assert mine == run


@pytest.mark.parametrize("rows", [ROWS, [], ROWS[1:4], [(None, None, None, None)] * 2])
def test_every_stage_takes_awkward_and_empty_tables(spark, rows):
    docs = written(documents(spark, rows))
    for name, f in corpus_pipeline.STAGES:
        out = written(f(spark, docs, "/root/testdata/sf0.001"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        assert out.count() <= 2 * max(1, len(rows)) + 60


def test_stages_one_after_the_other_from_nothing(spark):
    docs = written(documents(spark, []))
    for _, f in corpus_pipeline.STAGES:
        docs = written(f(spark, docs, "/root/testdata/sf0.001"))
    assert docs.count() == 0


def test_release_spares_what_docs_reads(spark):
    with corpus_pipeline.common.owned() as folders:
        a, b = written(spark.range(3)), written(spark.range(4))
        corpus_pipeline.common.release(folders, b)
    assert len(folders) == 1 and b.count() == 4
    with pytest.raises(Exception):
        a.count()


def test_owned_blocks_hand_on_what_is_left(spark):
    common = corpus_pipeline.common
    with common.owned() as outer:
        with common.owned() as inner:
            a, b = written(spark.range(3)), written(spark.range(4))
            common.release(inner, b)
        assert outer == inner and len(outer) == 1
        c = written(b)
        common.release(outer, c)
        assert len(outer) == 1 and c.count() == 4


def test_a_stage_run_again_leaves_the_first_result(spark):
    docs = written(documents(spark))
    for _, f in corpus_pipeline.STAGES:
        a = f(spark, docs, SF)
        b = f(spark, docs, SF)
        n = b.count()
        assert a.count() == n


def test_two_runs_at_once(spark):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(2) as pool:
        runs = [pool.submit(lambda: corpus_pipeline.run(spark, SF).count()) for _ in range(2)]
        assert runs[0].result() == runs[1].result() > 0
