import random
import re
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest

from weir.llm import ngram_join


def brute(rows, threshold=0.8, leads=False):
    """For each row (doc_id, class id, copies, links, linked documents, group id); or how many groups have each id."""
    sets = []
    for _, text in rows:
        w = re.findall(r"\w+", (text or "").lower())
        sets.append(frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    classes = defaultdict(list)
    for i, s in enumerate(sets):
        classes[s].append(rows[i][0])
    keys = list(classes)
    lead = {s: min((d for d in classes[s] if d is not None), default=None) for s in keys}
    linked = {s: {t for t in keys if t != s and s and t and len(s & t) >= threshold * len(s | t) - 1e-9} for s in keys}
    out, found = {}, set()
    for s in keys:
        seen, todo = {s}, [s]
        while todo:
            for t in linked[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        group = min((lead[t] for t in seen if lead[t] is not None), default=None)
        found.add((frozenset(seen), group))
        n = len(classes[s])
        out[s] = (lead[s], n, len(linked[s]), sum(len(classes[t]) for t in linked[s]) + n - 1, group)
    if leads:
        return Counter(g for _, g in found)
    return [(d, *out[s]) for (d, _), s in zip(rows, sets)]


def corpus(seed):
    draw, rows = random.Random(seed), []
    for base in range(6):
        words = [f"w{draw.randint(0, 500)}" for _ in range(draw.randint(30, 120))]
        for _ in range(draw.randint(2, 25)):
            copy = list(words)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):
                copy[draw.randrange(len(copy))] = f"x{draw.randint(0, 9999)}"
            rows.append((len(rows) + 10, " ".join(copy)))
    return rows


EDGE = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One!"), (6, "a b c d e"), (6, "other text here with more words"), (None, "z y x w v u"), (None, "z y x w v u")]


@pytest.mark.parametrize("block, spread, most", [(150, 12, 1500), (4, 2, 6), (2, 50, 50)])
def test_against_brute_force(spark, docs, monkeypatch, block, spread, most):
    for name, value in (("BLOCK_ROWS", block), ("SPREAD", spread), ("MOST_ROWS", most)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = EDGE + corpus(block)
    got = ngram_join.ngram_join(docs(rows)).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute(rows))


def test_one_of_each(spark, docs):
    rows = EDGE + corpus(7)
    kept = ngram_join.one_of_each(docs(rows))
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert Counter(d for d, _ in got.elements()) == brute(rows, leads=True)
    assert not got - Counter(rows) and kept.columns == docs([]).columns


def test_one_of_each_goes_by_row(spark):
    a = " ".join(f"a{i}" for i in range(40))
    b = " ".join(f"b{i}" for i in range(40))
    rows = [(6, a, None), (7, a + " x", "y"), (6, b + " x", "z"), (1, b, "w"), (9, None, "n"), (9, "", "n"), (None, a, "v")]
    made = spark.createDataFrame(rows, "doc_id int, text string, row string")
    got = sorted((r.doc_id, r.text or "", r.row) for r in ngram_join.one_of_each(made).collect())
    assert [g[:2] for g in got] == [(1, b), (6, a), (9, "")] and got[0][2] == "w" and got[1][2] is None
    assert ngram_join.one_of_each(made).schema["doc_id"].dataType == made.schema["doc_id"].dataType
    assert ngram_join.one_of_each(made.where("false")).collect() == []


def test_empty(spark, docs):
    assert ngram_join.ngram_join(docs([])).collect() == []


def test_pruning_bound_is_the_posterior():
    needs = ngram_join.least_agreements(0.8, 1e-9)
    for k, m in needs.items():
        grid = np.linspace(0, 1, 20001)
        def tail(agree):
            density = grid**agree * (1 - grid) ** (k - agree)
            return density[grid >= 0.8].sum() / density.sum()

        assert tail(m) >= 1e-9 * 0.9 and (m == 0 or tail(m - 1) < 1e-9 * 1.1)
        assert comb(k, m) > 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 160)}}


def test_components_end_at_stars(spark, monkeypatch):
    names, write = [], ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name, **more: names.append(name) or write(df, name, **more))
    for edges, roots in (
        ([], {}),
        ([(3, 3)], {}),
        ([(i, 0) for i in range(1, 9)] + [(0, 5), (20, 21)], {**{i: 0 for i in range(9)}, 20: 20, 21: 20}),
    ):
        names.clear()
        got = ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r.node: r.root for r in got} == roots and len(got) == len(roots)
        assert names == ["edges"]
    for edges, rounds in (([(2, 1), (2, 0)], 1), ([(2, 1), (1, 0)], 1)):  # two edges up; a chain
        names.clear()
        got = ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r.node: r.root for r in got} == {0: 0, 1: 0, 2: 0} and names == ["edges"] + ["least", "large", "low", "edges"] * rounds


def test_few_files_where_partitions_are_not_merged(spark, docs, monkeypatch):
    """Every file costs its executor two processes, so their number must not follow that of shuffle partitions."""
    conf = {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was, counts, write = {k: spark.conf.get(k) for k in conf}, {}, ngram_join.materialize

    def counted(df, name, **more):
        out = write(df, name, **more)
        counts[name] = max(counts.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    rows = EDGE + corpus(11)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = ngram_join.ngram_join(docs(rows)).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert Counter(tuple(r) for r in got) == Counter(brute(rows))
    few = spark.sparkContext.defaultParallelism
    assert counts["links"] and all(n <= (4 * few if name == "sets" else few) for name, n in counts.items()), counts


def test_shingle_sets_take_a_file_for_each_core(spark, docs, monkeypatch):
    """However many partitions the join has that feeds them; files are written in a burst while the executor's heap is full."""
    conf = {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was, counts, write = {k: spark.conf.get(k) for k in conf}, {}, ngram_join.materialize

    def counted(df, name, **more):
        out = write(df, name, **more)
        counts[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = corpus(13)
        got = ngram_join.ngram_join(docs(rows)).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert Counter(tuple(r) for r in got) == Counter(brute(rows))
    assert 0 < counts["sets"] <= spark.sparkContext.defaultParallelism


def test_min_hash_agreement_estimates_jaccard():
    draw = np.random.default_rng(0)
    a = draw.integers(0, 2**63, 3000).astype(np.uint64)
    x, y = np.unique(a[:2000]), np.unique(a[500:2500])
    m = ngram_join.min_hashes([x, y])
    assert (m[0] == m[1]).mean() == pytest.approx(0.6, abs=0.12)
