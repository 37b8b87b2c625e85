"""Source divergence audit: how the term shares of each source differ from those of its language and of the other sources.

Strings stay behind. Tasks count the terms of their documents exactly and write (group, digest, term, count,
documents) once. Everything that is shuffled for the counts is of fixed width: numbers of groups, 64-bit term digests and
sums. The least and the greatest term of every digest, one row a digest and task before the shuffle, show
collisions; only terms of a digest with more than one term carry their text as a further key, so they are
counted apart. Text is joined back for the terms that can be in an output.

Sums over all kept terms of two sources are not made term by term: terms in neither source all give one value,
terms in one source are grouped by their count, and only terms in both meet in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, text_slices, written

LEAST_DOCS = 3
RANKS = 200
#: Counts that a task holds before it adds up equal ones and hands them on.
HELD_ROWS = 1 << 20
UNIT = 1_000_000_000

#: The byte that stands for each byte of a term (A-Z folded), 0 for bytes that part terms.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 0
_FOLD[ord("a") : ord("z") + 1] = _FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)

_FACTS = "lang string, source string, term string, n long, docs long"


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of all texts (large_string without nulls), one after the other, and their number in each text."""
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    lo, hi = int(ends[0]), int(ends[-1])
    if n == 0 or hi == lo:
        return pa.array([], pa.large_string()), np.zeros(n, np.int64)
    data, ends = _FOLD[np.frombuffer(texts.buffers()[2], np.uint8, hi - lo, lo)], ends - lo
    inside = data > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = ends[1:-1]
    cut = cut[cut < len(data)]
    first[cut] |= inside[cut]  # a term never runs on into the next text
    starts = np.flatnonzero(first)
    offsets = np.concatenate([np.cumsum(inside)[starts] - 1, [np.count_nonzero(inside)]]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes())), np.diff(np.searchsorted(starts, ends))


def _slice_counts(texts: pa.Array, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """-> group, term, occurrences and documents of every pair of them in some texts."""
    found, counts = terms(texts)
    coded = found.dictionary_encode()
    size = max(len(coded.dictionary), 1)
    per_doc, uses = np.unique(np.repeat(np.arange(len(counts)), counts) * size + coded.indices.to_numpy(), return_counts=True)
    keys, place = np.unique(group[per_doc // size] * size + per_doc % size, return_inverse=True)
    return keys // size, coded.dictionary.take(pa.array(keys % size)), np.bincount(place, uses, len(keys)).astype(np.int64), np.bincount(place, minlength=len(keys))


def _merged(parts: list[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """The counts of several slices added up."""
    coded = pa.concat_arrays([p[1] for p in parts]).dictionary_encode()
    group, n, docs = (np.concatenate([p[k] for p in parts]) for k in (0, 2, 3))
    size = max(len(coded.dictionary), 1)
    keys, place = np.unique(group * size + coded.indices.to_numpy(), return_inverse=True)
    return keys // size, coded.dictionary.take(pa.array(keys % size)), np.bincount(place, n, len(keys)).astype(np.int64), np.bincount(place, docs, len(keys)).astype(np.int64)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> per group and term: occurrences, and documents that hold it; a row without a term for each group."""
    names: dict[tuple[str, str], int] = {}
    held, rows = [], 0

    def batch_of(group: np.ndarray, term: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        known = list(names)
        langs, sources = (pa.array([g[k] for g in known], pa.string()).take(pa.array(group)) for k in (0, 1))
        return pa.RecordBatch.from_arrays([langs, sources, term.cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    for whole in batches:
        for batch, texts in text_slices(whole, "text"):
            pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            held.append(_slice_counts(texts, np.array([names.setdefault(g, len(names)) for g in pairs], np.int64)))
            rows += len(held[-1][0])
            if rows >= HELD_ROWS:
                yield batch_of(*_merged(held))
                held, rows = [], 0
    if held:
        yield batch_of(*_merged(held))
    if names:
        none = np.zeros(len(names), np.int64)
        yield batch_of(np.arange(len(names)), pa.nulls(len(names), pa.string()), none, none)


def term_digest(term: Column) -> Column:
    return F.xxhash64(term)


def _share(count: str, total: str, kinds: str) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + kinds)), exactly."""
    return F.expr(f"1 + ((cast({count} as decimal(20,0)) + 1) * {UNIT} div (cast({total} as decimal(20,0)) + {kinds}))")


def _apart(p: str, q: str) -> str:
    """floor((p - q)^2 / q): p and q are at most UNIT + 1, so the square fits a long."""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS, digest=term_digest, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """-> lang, source, part, item, value, rank.

    A language keeps the terms (runs of letters and of characters beyond ASCII, A-Z folded) that at least ``least_docs`` of its
    documents hold. Part ``pair``: every other source of the language with the summed divergence of its shares from the
    group's, all ranks. Part ``term``: terms of the group whose share is above the language's, the first
    ``ranks``. Ranks go by value descending, then item in UTF-8 order. Null texts, languages and sources are
    read as ''. Every row is a document of its own, also one that repeats another. A group without terms has pairs
    only; a language of one source has no pairs; an empty table gives no rows. Other columns are not read.
    ``digest`` maps a term to its 64-bit digest.
    """
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    facts = written(texts.mapInArrow(_counter, _FACTS).withColumn("digest", F.when(F.col("term").isNotNull(), digest(F.col("term")))), "facts")
    # Small numbers instead of names: of a group, and for a language that of one of its groups.
    named = written(facts.where("term is null").select("lang", "source").distinct().withColumn("gid", F.monotonically_increasing_id()), "groups")
    groups = sized(written(named.join(named.groupBy("lang").agg(F.min("gid").alias("lid")), "lang"), "groups"))
    told = facts.where("term is not null").join(groups, ["lang", "source"])

    # The least and the greatest text of each digest: where they differ, the digest is split by text.
    texts_of = facts.where("term is not null").groupBy("digest").agg(F.min("term").alias("least"), F.max("term").alias("greatest"))
    texts_of = written(texts_of.select("digest", "least", (F.col("least") != F.col("greatest")).alias("shared")), "texts")
    shared = texts_of.where("shared").select("digest", "shared")
    if shared.isEmpty():
        told = told.select("lid", "gid", "digest", F.lit(None).cast("string").alias("split"), "n", "docs")
    else:
        told = told.join(shared, "digest", "left").select("lid", "gid", "digest", F.when(F.col("shared"), F.col("term")).alias("split"), "n", "docs")
    counts = written(told.groupBy("lid", "gid", "digest", "split").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.groupBy("lid", "digest", "split").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("_docs")).where(F.col("_docs") >= least_docs).drop("_docs")
    kept = kept.withColumnsRenamed({"lid": "_l", "digest": "_d", "split": "_s"})
    here = F.col("lid").eqNullSafe(F.col("_l")) & (F.col("digest") == F.col("_d")) & F.col("split").eqNullSafe(F.col("_s"))
    used = written(counts.join(kept, here).select("lid", "gid", "digest", "split", "n", "lang_n"), "used")

    # Per language: kept terms and their occurrences; per group: its own occurrences, and the share of a term that it lacks.
    once = used.groupBy("lid", "digest", "split").agg(F.first("lang_n").alias("lang_n")).groupBy("lid").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    sums = used.groupBy("gid").agg(F.sum("n").alias("total"))
    sources = groups.join(once, "lid", "left").join(sums, "gid", "left").select("lang", "source", "lid", "gid", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("v", "lang_total", "total")])
    sources = sized(written(sources.withColumn("p0", F.when(F.col("v") > 0, _share("0", "total", "v"))), "sources"))

    facts_of = used.join(sources.select("gid", "total", "v", "lang_total", "p0"), "gid").withColumn("p", _share("n", "total", "v"))
    above = facts_of.withColumn("q", _share("lang_n", "lang_total", "v")).where("p > q").select("gid", "digest", "split", F.expr(_apart("p", "q")).alias("value"))
    # Ties at the last rank stay until their texts are known.
    near = above.withColumn("_r", F.rank().over(Window.partitionBy("gid").orderBy(F.desc("value")))).where(F.col("_r") <= ranks).drop("_r")
    items = near.join(texts_of.select("digest", "least"), "digest").select("gid", F.coalesce("split", "least").alias("item"), "value")
    term = items.withColumn("rank", F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= ranks)
    term = term.join(sources.select("gid", "lang", "source"), "gid").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    # Source against source: mine is the group, theirs the item.
    one = sources.select("lid", "lang", "v", *[F.col(c).alias(f"{c}_a") for c in ("gid", "source", "total", "p0")])
    two = sources.select("lid", *[F.col(c).alias(f"{c}_b") for c in ("gid", "source", "total", "p0")])
    pairs = one.join(two, "lid").where("gid_a <> gid_b")
    exact = "decimal(38,0)"
    alike = used.groupBy("lid", "gid", "n").agg(F.count("*").alias("kinds"))

    def single(side: str, value: str) -> DataFrame:
        """What the terms of one side add to the value of terms in neither, if the other side had none of them."""
        own = alike.select(F.col("gid").alias(f"gid_{side}"), "n", "kinds").join(pairs, f"gid_{side}").withColumn("p", _share("n", f"total_{side}", "v"))
        return own.groupBy("gid_a", "gid_b").agg(F.sum(F.expr(f"cast({value} - {_apart('p0_a', 'p0_b')} as {exact}) * kinds")).alias(f"only_{side}"))

    only_a, only_b = single("a", _apart("p", "p0_b")), single("b", _apart("p0_a", "p"))
    met = facts_of.select("lid", "digest", "split", "gid", "p", "p0")
    left = met.select("lid", "digest", "split", *[F.col(c).alias(f"{c}_a") for c in ("gid", "p", "p0")])
    right = met.select(F.col("lid").alias("_l"), F.col("digest").alias("_d"), F.col("split").alias("_s"), *[F.col(c).alias(f"{c}_b") for c in ("gid", "p", "p0")])
    both = left.join(right, here).where("gid_a <> gid_b").groupBy("gid_a", "gid_b")
    both = both.agg(F.sum(F.expr(f"cast({_apart('p_a', 'p_b')} - {_apart('p_a', 'p0_b')} - {_apart('p0_a', 'p_b')} + {_apart('p0_a', 'p0_b')} as {exact})")).alias("both"))
    summed = pairs.join(only_a, ["gid_a", "gid_b"], "left").join(only_b, ["gid_a", "gid_b"], "left").join(both, ["gid_a", "gid_b"], "left")
    total = F.expr(f"cast(coalesce({_apart('p0_a', 'p0_b')}, 0) as {exact}) * v + coalesce(only_a, 0) + coalesce(only_b, 0) + coalesce(both, 0)").cast("long")
    pair = summed.select("lang", F.col("source_a").alias("source"), "gid_a", F.lit("pair").alias("part"), F.col("source_b").alias("item"), total.alias("value"))
    pair = pair.withColumn("rank", F.row_number().over(Window.partitionBy("gid_a").orderBy(F.desc("value"), "item"))).drop("gid_a")
    return pair.select("lang", "source", "part", "item", "value", "rank").union(term)
