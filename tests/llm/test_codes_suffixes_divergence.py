"""Vector codes, decontamination and the source divergence audit: against brute force, with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from floorlake.llm import codes, queries, suffixes
from floorlake.llm.codes import Gnat, codebooks_digest, quantised, vector_codes
from floorlake.llm.divergence import source_divergence
from floorlake.llm.suffixes import Shard, contamination_report, decontaminate, verbatim_matches
from tools.check import compare, oracle_connection

DOCS = "doc_id long, text string, lang string, source string, item string, n long, digest string, size int, words string"
ITEMS = "item_id long, text string, lang string, doc_id string"


def docs_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z") for r in rows], DOCS).repartition(3)


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_benchmark_decontamination", "op13_source_divergence"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    ok, _, note = compare(spark, oracle_connection(sf_dir), queries.QUERIES[name], queries.ORACLE_SQL[name], sf_dir)
    assert ok, note


# Decontamination


@pytest.mark.parametrize("alphabet", [2, 5, 3000])
def test_suffix_array_ranges_and_longest_matches(alphabet):
    rnd = random.Random(alphabet)
    texts = [[rnd.randrange(alphabet) for _ in range(rnd.choice([0, 1, 3, 9, 40]))] for _ in range(60)]
    texts += [texts[5] * 4, [0] * 50, [0] * 50, texts[7] + texts[8]]
    words = np.array([w for t in texts for w in t], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    shard = Shard(words, np.array([len(t) for t in texts]), 10)
    spots = [(d, i) for d, t in enumerate(texts) for i in range(len(t))]
    item = [rnd.randrange(alphabet) for _ in range(30)] + texts[6][:20] + [0] * 12 + [alphabet + 1]
    ranks = shard.ranks_of(np.array(item, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    known = [(s, k) for s in range(len(item)) for k in (1, 2, 4, 7, 10) if s + k <= len(item) and (ranks[s : s + k] > 0).all()]
    lo, hi = shard.find(ranks, np.array([s for s, _ in known]), np.array([k for _, k in known]))
    for (s, k), x, y in zip(known, lo, hi, strict=True):
        want = {p for p, (d, i) in enumerate(spots) if texts[d][i : i + k] == item[s : s + k]}
        assert set(shard.order[x:y].tolist()) == want
        for p in list(want)[:3]:
            d, i = spots[p]
            size = next((j for j in range(200) if texts[d][i + j : i + j + 1] != item[s + j : s + j + 1] or s + j >= len(item)), 0)
            got = shard.extended(ranks, np.array([s]), np.array([len(item)]), np.array([p]), np.array([k]))
            assert got[0] == size


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(text))


def brute_report(docs, items, window):
    out = []
    for doc_id, text in docs:
        w, hit, met = item_words(text), set(), set()
        for item_id, t in items:
            v = item_words(t)
            k = min(window, len(v))
            for s in range(max(len(v) - window, 0) + 1 if v else 0):
                for i in range(len(w) - k + 1):
                    if w[i : i + k] == v[s : s + k]:
                        hit |= set(range(i, i + k))
                        met |= {str(item_id)} if item_id is not None else set()
        out.append((doc_id, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def brute_matches(docs, items, window):
    out = collections.Counter()
    for doc_id, text in docs:
        w = item_words(text)
        for item_id, t in items:
            v = item_words(t)
            for i in range(len(w)):
                for s in range(len(v)):
                    n = 0
                    while i + n < len(w) and s + n < len(v) and w[i + n] == v[s + n]:
                        n += 1
                    if n >= min(window, len(v)) and not (i and s and w[i - 1] == v[s - 1]):
                        out[doc_id, i, None if item_id is None else str(item_id), s, n] += 1
    return out


def leaked_rows(seed=3):
    rnd = random.Random(seed)
    vocabulary = ["Ab", "cd", "éF", "Ж1", "x9", "Q", "ß"]

    def prose(n):
        return rnd.choice(["", "\x00"]) + "".join(rnd.choice(vocabulary) + rnd.choice([" ", "-", "\n", ". ", "_"]) for _ in range(n))

    items = [(i, prose(n)) for i, n in enumerate([12, 30, 6, 1, 0, 25, 25])]
    items += [(7, None), (1, items[1][1]), (8, items[1][1] + " tail"), (None, items[5][1])]
    docs = [(i, prose(rnd.choice([0, 3, 20, 60]))) for i in range(12)]
    docs += [(20 + i, prose(8) + " " + items[i % 7][1].upper().replace("É", "é").replace("SS", "ß") + " " + prose(8)) for i in range(9)]
    return docs + [(40, None), (41, ""), (42, items[1][1] * 40), (42, "clean words"), (None, items[0][1]), (None, "clean words"), docs[3], docs[13]], items


@pytest.mark.parametrize("window", [2, 4, 10])
def test_contamination_of_odd_rows(spark, window):
    docs, items = leaked_rows()
    frame = docs_frame(spark, [(i, t, "en", "s") for i, t in docs])
    tests = spark.createDataFrame([(i, t, "q", "r") for i, t in items], ITEMS).repartition(2)
    got = [tuple(r) for r in contamination_report(frame, tests, window).collect()]
    assert sorted(got, key=repr) == brute_report(docs, items, window)
    found = collections.Counter(tuple(r) for r in verbatim_matches(frame, tests, window).collect())
    assert found == brute_matches(docs, items, window)
    bad = {r[0] for r in got if r[5] and r[0] is not None}
    left = sorted((r.doc_id is None, r.doc_id, r.text) for r in decontaminate(frame, tests, window).collect())
    clean = {t for i, t in docs if i is None and not brute_report([(i, t)], items, window)[0][5]}
    assert left == sorted((i is None, i, t) for i, t in docs if (i not in bad if i is not None else t in clean))


def test_no_items_and_no_documents(spark):
    docs, items = leaked_rows()
    frame, tests = docs_frame(spark, [(i, t, "en", "s") for i, t in docs]), spark.createDataFrame([(i, t, "q", "r") for i, t in items], ITEMS)
    assert not contamination_report(frame, tests.limit(0)).where("contaminated or n_items > 0 or n_hit > 0").count()
    assert contamination_report(frame.limit(0), tests).count() == 0


def test_items_in_many_blocks(tmp_path):
    import pyarrow.parquet as pq

    docs, items = leaked_rows()
    texts = pa.array([t for _, t in items], pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array([None if i is None else str(i) for i, _ in items]), texts], ["item", "text"])
    table = pa.Table.from_batches(suffixes._item_words(iter([batch])))
    for k in range(0, len(items), 3):
        pq.write_table(table.slice(k, 3), f"{tmp_path}/part-{k}.parquet")
    one = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs])], ["doc_id", "text"])
    rows = [tuple(r.values()) for b in suffixes._reporter(f"file://{tmp_path}", 4)(iter([one])) for r in b.to_pylist()]
    assert sorted(rows, key=repr) == brute_report(docs, items, 4)


# Source divergence


def brute_divergence(rows, least, ranks):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded(text))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = collections.Counter(t for d in mine for t in set(d[2]))
        kept = [t for t in held if held[t] >= least]
        count = {s: collections.Counter(t for d in mine if d[1] == s for t in d[2] if held[t] >= least) for s in {d[1] for d in mine}}
        whole = sum(count.values(), collections.Counter())

        def shares(c, kept=kept):
            return {t: 1 + 1000000000 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in count.items()}, shares(whole)
        for s in count:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in count if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ordered)]
    return sorted(out)


def sourced_rows(seed=5):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "été", "Über", "x", "日本", "zz", "w1w", "q"] + [f"r{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(rnd.choices(words, [40 - j for j in range(len(words))], k=rnd.choice([0, 2, 30]))), rnd.choice(["en", "de", None, ""]), rnd.choice(["a", "b", "é", None])) for i in range(80)]
    return rows + [(90, None, "fr", "a"), (91, "", "fr", "b"), (92, "12 34", "fr", "c"), (93, "only here", "pt", "a"), (None, "x " * 500, "en", "b"), rows[0], rows[0], rows[1]]


@pytest.mark.parametrize(("digest", "ranks"), [(None, 200), (lambda t: F.pmod(F.xxhash64(t), F.lit(5)), 200), (lambda t: F.lit(7).cast("long"), 3)])
def test_divergence_with_collisions_of_digests(spark, digest, ranks):
    rows = sourced_rows()
    got = source_divergence(docs_frame(spark, rows), ranks=ranks, **({"digest": digest} if digest else {})).collect()
    assert sorted(tuple(r) for r in got) == brute_divergence(rows, 3, ranks)


def test_divergence_of_no_documents(spark):
    assert source_divergence(docs_frame(spark, sourced_rows()).limit(0)).count() == 0


# Vector codes


def brute_codes(rows, parts, entries, rounds):
    rows = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [([math.floor(x * 256) if abs(x) < 2**52 else int(x) * 256 for x in v]) for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0], rows[i][1]))
    size = len(whole[order[0]])
    used = [i for i in order if len(whole[i]) == size]
    cut = {i: [whole[i][k * size // parts : (k + 1) * size // parts] for k in range(parts)] for i in used}
    books = [[cut[i][k] for i in used[:entries]] for k in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            groups = collections.defaultdict(list)
            for i in used:
                groups[near(cut[i][k], books[k])[1]].append(cut[i][k])
            for e, xs in groups.items():
                books[k][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(v) for b in books for y in b for v in y).encode()).hexdigest()
    told = {i: [near(cut[i][k], books[k]) for k in range(parts)] for i in used}
    error = {i: sum(d for d, _ in told[i]) for i in used}
    error = {i: e if e < 2**63 else None for i, e in error.items()}
    of_label = collections.defaultdict(list)
    for i, (_, _, label) in enumerate(rows):
        of_label[label] += [error[i]] if error.get(i) is not None else []
    return sorted(((r[0], "".join(f"{e:02x}" for _, e in told[i]) if i in told else None, error.get(i), sum(of_label[r[2]]) if of_label[r[2]] else None, digest) for i, r in enumerate(rows)), key=repr)


def vector_rows(scale, seed=2):
    rnd = random.Random(seed)
    grid = [[float(rnd.choice([-1, 0, 0.25, 0.5, 1]) * scale) for _ in range(16)] for _ in range(9)]
    rows = [(i, rnd.choice(grid) if rnd.random() < 0.5 else [rnd.gauss(0, 1) * scale for _ in range(16)], rnd.choice([0, 1, None])) for i in range(60)]
    return rows + [(70, None, 0), (71, [1.0, None] * 8, 0), (72, [float("nan")] * 16, 1), (73, [float("-inf")] * 16, 1), (74, [1.0] * 5, 2), rows[3], rows[3], (5, [0.1] * 16, 1), (None, [0.2] * 16, None)]


@pytest.mark.parametrize("scale", [0.01, 1, 1e9, 1e30])
def test_codes_equal_brute_force(spark, scale):
    rows = vector_rows(scale)
    frame = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int, vector int").repartition(3)
    got = vector_codes(frame, parts=4, entries=12).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_codes(rows, 4, 12, codes.ROUNDS)


def test_codes_of_nothing_and_of_vectors_that_cannot_be_cut(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vector_codes(spark.createDataFrame([(1, None, 0)], kind)).count() == 0
    assert [(r.code, r.error, r.label_error) for r in vector_codes(spark.createDataFrame([(1, [1.0] * 17, 0)], kind)).collect()] == [(None, None, None)]
    assert [(r.code, r.error, r.label_error) for r in vector_codes(spark.createDataFrame([(1, [1.0] * 32, 0)], kind)).collect()] == [("00" * 16, 0, 0)]


@pytest.mark.parametrize("spread", [1, 40, 3000, 1 << 60])
def test_tree_finds_the_lowest_of_the_nearest(spread):
    rnd = np.random.default_rng(spread % 97)
    kind = object if spread > 1 << 30 else np.int64
    entries = rnd.integers(-spread, spread + 1, (64, 3)).astype(kind)
    entries[40:] = entries[:24]
    queries_ = np.concatenate([rnd.integers(-spread, spread + 1, (500, 3)).astype(kind), entries])
    tree = Gnat(entries)
    number, best = tree.nearest(queries_)
    for q, e, d in zip(queries_.tolist(), number, best, strict=True):
        assert (d, e) == min((sum((a - b) ** 2 for a, b in zip(q, y, strict=True)), i) for i, y in enumerate(entries.tolist()))
    assert tree.measured < 0.9 * 64 * len(queries_)


def test_whole_components_round_down():
    assert quantised(np.array([-0.001, 0.001, 1 / 256, -1 / 256])).tolist() == [-1, 0, 1, -1]
    assert quantised(np.array([1e30, -2.5])).tolist() == [int(1e30) * 256, -640]
    assert codebooks_digest([np.array([[1, -2]]), np.array([[3, 4]])]) == hashlib.sha256(b"1,-2,3,4").hexdigest()
