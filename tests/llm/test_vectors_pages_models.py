"""Vectors, archives, classifiers and the pipeline: against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import io
import math
import random
import zipfile

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from floorlake.llm import archive, forest, queries
from floorlake.llm.common import components
from floorlake.llm.features import BUCKETS, Sparse, document_features, margins
from floorlake.llm.grades import fit_cumulative_link, quality_grades
from floorlake.llm.toxicity import fit_toxicity, label_model, toxicity_scores
from tools.check import compare, oracle_connection


def test_components_of_paths_stars_and_cycles(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(200, 201), (201, 202), (202, 200), (7, 7)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)]
    parent = {v: v for e in edges if e[0] != e[1] for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent}


def near_vectors(seed, n, size=32):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, size))
    return np.concatenate([base + rng.normal(0, s, base.shape) for s in (0.0, 0.1, 0.25, 0.5)]).astype(np.float32)


def test_forest_finds_nearly_all_links_and_no_others(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAF", 64)
    monkeypatch.setattr(forest, "BLOCK", 50)
    x = near_vectors(8, 1600)
    labels = [int(i % 2) for i in range(len(x))]
    rows = [(i, v.tolist(), labels[i % 400], "x") for i, v in enumerate(x)]
    got = {r.vec_id: r for r in forest.vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n string")).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    lab = np.array([labels[i % 400] for i in range(len(x))])
    links = (unit @ unit.T >= forest.THRESHOLD) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(links, False)
    assert all(got[i].n_links <= links[i].sum() for i in range(len(x)))
    assert sum(r.n_links for r in got.values()) >= 0.95 * links.sum() > 100
    for i in range(len(x)):  # every component found lies in one true component
        assert got[i].component_id <= i and got[i].kept == (got[i].component_id == i)


def test_vectors_without_direction_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [], 1), (10, [1.0, 0.0], 2), (None, [1.0, 0.0], 1),
            (11, [1.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in forest.vector_components(frame).collect())
    alone = {(i, 0, i, True): 1 for i in (3, 4, 5, 6, 7, 8, 9, 10, 12)}
    assert got == alone | {(1, 3, 1, True): 1, (2, 3, 1, False): 1, (11, 3, 1, False): 2, (None, 0, None, False): 1}
    assert forest.vector_components(frame.limit(0)).collect() == []


def test_vectors_of_any_length_link_by_direction(spark):
    rows = [(i, [3.0 * x, 4.0 * x, 0.0], 1) for i, x in enumerate([1e-150, 1.5e-150, 1e150, 0.2, 1e-310, 1e300])]
    rows += [(10, [0.0, 0.0, 5e-324], 1), (11, [0.0, 0.0, 1e308], 1)]
    got = {(r.vec_id, r.n_links, r.component_id) for r in forest.vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {(i, 5, 0) for i in range(6)} | {(10, 1, 10), (11, 1, 10)}


def test_recall_of_the_registered_parameters_on_a_large_label(spark):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((6000, 64))
    close = base[:4000] + rng.normal(0, 1, (4000, 64)) * rng.uniform(0.05, 0.45, (4000, 1))
    x = np.concatenate([base, close]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = sum(int((unit[k : k + 1000] @ unit.T >= forest.THRESHOLD).sum()) for k in range(0, len(x), 1000)) - len(x)
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    found = sum(r.n_links for r in forest.vector_components(frame).select("n_links").collect())
    assert 0.95 * links <= found <= links and links > 2000


def test_thick_nodes_stay_whole_and_deep_nodes_have_cuts():
    rng = np.random.default_rng(5)
    spread = forest.unit_rows(rng.standard_normal((4000, 16)))
    tree = forest.Tree(0, spread, 0.01)
    leaves = tree.route(spread, 14)
    assert max(len(i) for _, i in leaves) < 60 and set(np.concatenate([i for _, i in leaves])) == set(range(len(spread)))
    tight = forest.unit_rows(np.ones((4000, 16)) + 1e-4 * rng.standard_normal((4000, 16)))
    assert [len(i) for _, i in forest.Tree(0, tight, 0.01).route(tight, 14)] == [4000]


def reader(raw):
    return lambda place, length: raw[place : place + length]


def test_directories_of_zip_and_zip64(monkeypatch):
    for comment, limit in ((b"", None), (b"PK\x05\x06 no end", None), (b"", 10)):
        if limit:  # makes the writer use ZIP64 records for small files
            monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
            monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
        sink = io.BytesIO()
        with zipfile.ZipFile(sink, "w") as z:
            z.writestr("ä/one", b"abc" * 50)
            z.writestr("two", b"x" * 1000, zipfile.ZIP_DEFLATED)
            z.comment = comment
        raw = sink.getvalue()
        found = archive.members(reader(raw), len(raw))
        start = archive.data_start(reader(raw), found["ä/one"])
        assert raw[start : start + found["ä/one"].size] == b"abc" * 50
        with pytest.raises(ValueError, match="compressed"):
            archive.data_start(reader(raw), found["two"])
    with pytest.raises(ValueError, match="no ZIP"):
        archive.members(reader(b"nothing"), 7)


def test_archives_revisit_equal_payloads(spark, tmp_path):
    long, tie = "<p>é" + "x" * 120, "y" * 100
    rows = [(5, "http://a/ä b\nc", long), (3, None, long), (9, "u", long), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (2, "u", tie), (2, "v", tie), (1, "u", "z" * 99), (10, "u", "z" * 99), (None, "u", long), (11, "u", "é" * 49 + "ab"), (12, "u", "é" * 49 + "ab")]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    manifest = archive.write_archives(pages, str(tmp_path / "p"), package_bytes=700)
    assert manifest.count() > 1
    for r in manifest.collect():  # other programs can read them
        with zipfile.ZipFile(r.path) as z:
            assert z.testzip() is None and z.namelist() == [archive.DATA, archive.INDEX]
    got = archive.read_archives(manifest, with_payload=True).collect()
    first = {long: 3, tie: 2, "é" * 49 + "ab": 11}
    want = collections.Counter()
    for page, _, html in rows:
        raw = (html or "").encode()
        to = first.get(html) if first.get(html) != page else None
        want[page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if to else "response", to, None if to else raw] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want
    assert archive.archived_pages(pages.limit(0)).collect() == []


def test_damaged_records_are_told():
    raw = bytearray(archive.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None))
    raw[-6] ^= 1
    with pytest.raises(ValueError, match="digest"):
        archive.parse_record(bytes(raw))


def test_label_model_finds_the_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(6000) < 0.3
    rates = [0.9, 0.8, 0.7, 0.95]
    votes = []
    for rate in rates:
        right = rng.random(6000) < rate
        votes.append(np.where(rng.random(6000) < 0.6, np.where(truth == right, 1, -1), 0))
    votes += [votes[0]] * 3  # copies of one voter must not outvote the others
    given = np.where(rng.random(6000) < 0.5, np.where(truth, 1, -1), 0)
    q, accuracy, together = label_model(np.stack([*votes, given], axis=1).astype(np.int8), 0.3)
    assert np.abs(accuracy[:4] - rates).max() < 0.05
    assert together[0, 4] > 0.8 > 0.2 > abs(together[0, 1])
    assert ((q > 0.5) == truth).mean() > 0.95


def test_margins_are_sums_over_features():
    texts = pa.array(["", "Idiot! you IDIOT", "a b a b ***x***\nä 12", "one"] * 2, pa.large_string())
    weights = np.random.default_rng(4).normal(0, 1, BUCKETS) * (np.arange(BUCKETS) % 3 == 0)
    flat, at = document_features(texts)
    assert np.allclose(margins(texts, weights), [weights[flat[lo:hi]].sum() for lo, hi in zip(at[:-1], at[1:], strict=True)])


def tables(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.01")
    rows = toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hits = sum(r.predicted == r.toxic for r in rows)
    assert hits >= 0.93 * len(rows) > 50
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def test_toxicity_learns_only_from_training_folds_and_text(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.001")
    model = fit_toxicity(docs, labels)
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    assert np.array_equal(model.weights, fit_toxicity(docs, flipped).weights)


def test_scores_of_odd_rows(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.001")
    odd = spark.createDataFrame([(900001, None, 1), (900002, "", 1), (None, "some words", 1), (900003, "x" * 200000, 1), (900003, "x" * 200000, 1)], "doc_id long, text string, score int")
    more = docs.selectExpr("doc_id", "text", "1 as score").union(odd)
    got = [r for r in toxicity_scores(more, labels).collect() if r.doc_id is None or r.doc_id > 900000]
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    kept = [r for r in quality_grades(more, labels).collect() if r.doc_id is None or r.doc_id > 900000]
    assert len(kept) == 5 and all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in kept)
    nothing = labels.limit(0)
    assert toxicity_scores(more, nothing).where("predicted = 1").count() == 0
    assert quality_grades(more, nothing).where("not kept").count() == 0
    assert toxicity_scores(docs.limit(0), labels).collect() == [] and quality_grades(docs.limit(0), labels).collect() == []


def test_cumulative_link_orders_the_grades():
    rng = np.random.default_rng(5)
    grade = rng.integers(0, 3, 900)
    lists = [np.unique(np.concatenate([rng.integers(1, 40, 5), [100 + g] if rng.random() < 0.8 else [100 + rng.integers(0, 3)]])) for g in grade]
    rows = Sparse(np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])]), (grade >= 1).astype(float), apart=0.0)
    thresholds, weights = fit_cumulative_link(rows, grade)
    assert thresholds[0] < thresholds[1]
    w = rows.spread(weights)
    assert w[100] < w[101] < w[102]
    z = np.array([w[x].sum() for x in lists])
    expected = (1 / (1 + np.exp(-(z[:, None] - thresholds)))).sum(axis=1)
    assert np.corrcoef(expected, grade)[0, 1] > 0.7


def test_grades_on_held_out_rows(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.01")
    rows = quality_grades(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.93 * len(rows) > 50


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_their_oracle(name, spark, sf_dir):
    ok, count, note = compare(spark, oracle_connection(sf_dir), queries.QUERIES[name], queries.ORACLE_SQL[name], sf_dir)
    assert ok and count, note


def test_pipeline_is_its_stages(spark, sf_dir):
    docs, labels = tables(spark, sf_dir)
    texts = {r.doc_id: r for r in docs.collect()}
    score = {r.doc_id: r.score for r in toxicity_scores(docs, labels).collect()}
    from floorlake.llm.jaccard import jaccard_components
    from floorlake.llm.outliers import quality_rules

    left = docs.where(docs.doc_id.isin([i for i in texts if score[i] < 0.7]))
    good = {r.doc_id for r in quality_rules(left).where("kept").collect()}
    heads = {r.component_id for r in jaccard_components(left.where(left.doc_id.isin(list(good)))).collect()}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == heads and 0 < len(heads) < len(good) < len(texts)
    total = collections.Counter()
    for r in rows:
        total[r.doc_id] += r.length
    assert all(total[r.doc_id] == r.doc_tokens for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1 + math.ceil(sum(total.values()) / 2048 * 1.05)


def test_pipeline_stages_take_odd_rows(spark, sf_dir):
    docs, _ = tables(spark, sf_dir)
    odd = spark.createDataFrame([(None, None, None, None, None), (7, None, None, None, None), (700001, "", "en", None, 0), (700002, "a b", None, "s", None)], docs.schema)
    repeated = docs.limit(20).union(docs.limit(20)).union(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        repeated = stage(spark, repeated, sf_dir)
        assert repeated.columns == docs.columns
        rows = repeated.collect()
    texts = [r.text for r in rows if r.doc_id is not None]
    assert len(texts) == len(set(texts)) and texts
    assert corpus_pipeline.STAGES[-1][1](spark, repeated, sf_dir).count() >= len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
