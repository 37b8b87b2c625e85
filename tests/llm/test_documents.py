"""License scans, near duplicates, quality rules: against brute force, with nulls, ties, repeats and clashing columns."""

import collections
import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from floorlake.llm import outliers
from floorlake.llm.jaccard import jaccard_components, sketch
from floorlake.llm.licenses import TEMPLATES, license_scans, signs_suffice
from floorlake.llm.outliers import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, ck string, comp int, kept string, key double"


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, source, None, 1, "x", 2, None, 0.5) for i, t, lang, source in rows], DOCS)


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def components(sets):
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def noisy_texts(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 5, 9, 40, 150]))]
        texts.append(base)
        for _ in range(rnd.randrange(6)):
            copy = list(base)
            for _ in range(rnd.randrange(1 + len(copy) // 25)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(copy)
        texts.append(base[:10] + passage + base[10:20])
    return [rnd.choice([" ", "\t", "\n", "  "]).join(t) for t in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_are_those_of_all_pairs(spark, seed):
    texts = {i + 10: t for i, t in enumerate(noisy_texts(seed))}
    texts |= {1: None, 2: "", 3: " \t\n ", 4: "one two", 5: "One TWO", 6: "one two three", 7: "É é x\u0085y a b", 8: "é é x\u0085y a b"}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, [(i, t, "en", None) for i, t in texts.items()])).collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    want = components(sets)
    assert got == {i: (len(sets[i]), want[i]) for i in texts}


def test_jaccard_keeps_repeats_and_rows_without_id(spark):
    rows = [(5, "a b c d e f", None, None)] * 3 + [(9, "a b c d e f", None, None), (None, "a b c d e f", None, None), (None, None, None, None), (7, None, None, None)]
    got = collections.Counter(tuple(r) for r in jaccard_components(frame(spark, rows)).collect())
    assert got == {(5, 2, 5): 3, (9, 2, 5): 1, (None, 2, None): 1, (None, 0, None): 1, (7, 0, 7): 1}
    assert jaccard_components(frame(spark, [])).collect() == []


def test_bitmaps_bound_the_overlap():
    import numpy as np

    rnd = np.random.default_rng(5)
    for _ in range(50):
        x, y = (np.unique(rnd.integers(0, 2**63, rnd.integers(1, 400), dtype=np.uint64)) for _ in range(2))
        y = np.union1d(y, x[: len(x) // 2])
        a, b = (np.frombuffer(sketch(s), np.uint64) for s in (x, y))
        n = min(len(a), len(b))
        apart = np.bitwise_count(np.bitwise_xor.reduce(a.reshape(-1, n), axis=0) ^ np.bitwise_xor.reduce(b.reshape(-1, n), axis=0)).sum()
        assert apart <= len(np.setxor1d(x, y))


def statistics(text):
    words = WORD.findall(text or "")
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rule_statistics_and_verdicts(spark):
    rnd = random.Random(4)
    texts = [None, "", " \n ", "a b c d e f g h i", "x " * 5000, "a b c d e\n" * 3, "ä*# <b> | a\r\na\x0bb\n\na\n", "one\ntwo\none\n one", "😀 wörd " * 4]
    normal = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(rnd.randrange(60, 400))) for _ in range(150)]
    odd = ["### " + " *** ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(120)) for _ in range(6)]
    rows = [(i, t, None if i % 5 == 0 else "en", None) for i, t in enumerate(texts)] + [(100 + i, t, "en", "s") for i, t in enumerate(normal)] + [(900 + i, t, "en", "s") for i, t in enumerate(odd)] + [(None, normal[0], "en", "s")]
    got = quality_rules(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {i: t for i, t, _, _ in rows}
    for r in got:
        n, chars, symbols, lines, repeats = statistics(by_id[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats), r
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[100 + i] for i in range(150)) and not any(kept[900 + i] for i in range(6)) and kept[None]
    assert not any(kept[i] for i in range(6))
    assert quality_rules(frame(spark, [])).collect() == []


def test_small_groups_are_measured_against_all_rows_of_their_language_or_of_the_table(spark):
    rnd = random.Random(6)

    def plain():
        return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(rnd.randrange(60, 400)))

    def odd():
        return "### " + " *** ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(120))

    places = [("en", "s", 150, 3), ("en", None, 12, 2), ("en", "t", 1, 1), ("fr", "s", 8, 2), (None, None, 5, 1), (None, "s", 0, 1)]
    rows, want = [], {}
    for lang, source, normal, strange in places:
        for text, kept in [(plain(), True) for _ in range(normal)] + [(odd(), False) for _ in range(strange)] + [("too short", False)]:
            rows.append((len(rows), text, lang, source))
            want[len(rows) - 1] = kept
    got = quality_rules(frame(spark, rows)).collect()
    assert {r.doc_id: r.kept for r in got} == want and len(got) == len(rows)
    assert all(r.distance is not None for r in got if not r.base_failed)
    few = quality_rules(frame(spark, rows[:20])).collect()
    assert len(few) == 20 and all(r.distance is not None and r.kept for r in few)


def test_concentration_steps_are_those_of_numpy(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    x = np.concatenate([rnd.normal(0, 1, (400, 5)) @ rnd.normal(0, 1, (5, 5)), rnd.normal(30, 1, (60, 5))])
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], "grp string, " + ", ".join(f"{c} double" for c in outliers.STATISTICS))
    got = outliers._distance(rows, outliers.minimum_covariance(rows)).select("x1", (F.col("d") / F.col("scale")).alias("d")).collect()
    floor = np.diag(np.square(list(outliers.STATISTICS.values())))
    centre = np.sort(x, axis=0)[(len(x) + 1) // 2 - 1]
    away = np.sort(np.abs(x - centre), axis=0)[(len(x) + 1) // 2 - 1]
    cov = np.diag((1.4826 * away) ** 2) + floor

    def distances():
        return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)

    for _ in range(outliers.STEPS):
        d = distances()
        near = x[d <= np.sort(d)[int(np.ceil(outliers.SHARE * len(d))) - 1]]
        centre, cov = near.mean(axis=0), np.cov(near.T, bias=True) + floor
    d = distances()
    d /= max(1.0, np.sort(d)[(len(d) + 1) // 2 - 1] / outliers._MEDIAN)
    want = dict(zip(x[:, 0], d, strict=True))
    worst = max(abs(r.d - want[r.x1]) / want[r.x1] for r in got)
    assert worst < 0.05 and min(want[v] for v in x[400:, 0]) > outliers.CUT


def scans(text):
    def bigrams(unit):
        words = unit.split()
        return set(zip(words, words[1:], strict=False))

    def normal(t):
        return re.sub(r"[^\w\n]+|_+", " ", t.lower())

    lines = normal(text).split("\n")
    units = ([(0, " ".join(lines))] if len(lines) > 1 else []) + list(enumerate(lines, 1))
    for at, unit in units:
        for name, template in TEMPLATES.items():
            a, b = bigrams(unit), bigrams(normal(template))
            if a and 2 * len(a & b) / (len(a) + len(b)) >= 0.8 - 1e-12:
                yield at, name, len(a & b), round(2 * len(a & b) / (len(a) + len(b)), 12)


def test_license_scans(spark):
    full = TEMPLATES["mit"]
    texts = ["", "no license", full, full.upper() + " some more words", "intro\n" + full.replace("Software", "work") + "\nend", "\n".join(full.split(", ")), "Released under the MIT License.\nReleased under the MIT license!",
             "Licensed under the Apache License Version 2.0", "x" * 50000 + " released under the mit license", full + " " + full, "released released under the mit license"]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(None, texts[6], None, None), (50, None, None, None), (6, texts[6], None, None)]
    got = collections.Counter((r.doc_id, r.line, r.license_id, r.overlap, round(r.dice, 12)) for r in license_scans(frame(spark, rows)).collect())
    assert got == collections.Counter((i, *s) for i, t, _, _ in rows if t for s in scans(t))
    assert license_scans(frame(spark, [])).collect() == []


def test_license_passages_over_line_ends_and_inside_lines(spark):
    def wrapped(name, before=""):
        return "\n".join(before + x for x in textwrap.wrap(TEMPLATES[name], 72))

    prose = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(40))
    line = " ".join(f"v{i}" for i in range(60))
    texts = {
        1: f"{prose}\n\n{wrapped('mit')}\n\n{prose}",
        2: f"{wrapped('header-apache-2.0', '# ')}\n\n{prose}",
        3: f"{line} {TEMPLATES['notice-mit']} {line}",
        4: f"{prose}\n{wrapped('isc')}\n{prose}\n{wrapped('isc')}\n{TEMPLATES['notice-bsd']}",
        5: f"{prose}\n{line}",
    }
    got = {(r.doc_id, r.line, r.license_id, round(r.dice, 12)) for r in license_scans(frame(spark, [(i, t, None, None) for i, t in texts.items()])).collect()}
    height = len(wrapped("isc").split("\n"))
    want = {(1, 42, "mit", 1.0), (2, 1, "header-apache-2.0", 1.0), (2, 1, "notice-apache-2.0", 1.0), (3, 1, "notice-mit", 1.0)}
    assert got == want | {(4, 41, "isc", 1.0), (4, 81 + height, "isc", 1.0), (4, 81 + 2 * height, "notice-bsd", 1.0)}


@pytest.mark.parametrize("copies", [2, 60, 1000])
def test_every_copy_of_a_wrapped_license_is_reported(spark, copies):
    rnd = random.Random(copies)
    own = textwrap.wrap(TEMPLATES["mit"], 72)
    lines, starts = [], []
    for k in range(copies):
        lines += [" ".join(f"p{rnd.randrange(10**6)}" for _ in range(8)) for _ in range(rnd.randrange(3))]
        starts.append(len(lines) + 1)
        # A copy now and then has a word changed or left out.
        words = TEMPLATES["mit"].split(" ")
        if k % 3 == 1:
            words[rnd.randrange(5, 150)] = "changed"
        if k % 5 == 2:
            del words[rnd.randrange(20, 140)]
        lines += textwrap.wrap(" ".join(words), 72) if k else own
    got = [r for r in license_scans(frame(spark, [(1, "\n".join(lines), None, None)])).collect() if r.license_id == "mit"]
    assert sorted(r.line for r in got if r.line) == starts
    assert all(r.dice > 0.9 for r in got if r.line)


def test_every_template_needs_a_sign():
    assert signs_suffice() and not signs_suffice(0.3)
