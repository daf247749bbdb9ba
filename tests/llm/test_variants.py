"""Spelling variants against all pairs of words, on small tables with awkward rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from pageloom.llm import variants

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, n string, key string, run string, id string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def counted(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain(counts):
    near = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, None, None, *["clash"] * 5) for d, t in rows], SCHEMA).repartition(4)


def result(found):
    return sorted((tuple(r) for r in found.collect()), key=lambda r: r[0])


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    stems = ["".join(rng.choice(list("abeèÿ"), rng.integers(6, 11)).tolist()) for _ in range(60)]
    words = [*stems, *[s + "a" for s in stems[:20]], *["b" + s for s in stems[:20]], "aaaaaaaa", "aaaaaaaaa", "bbbbbbb", "straßen", "ÀBCDEFG", "àbcdefg",
             "abc×÷def", "mississippi", "misssissippi", "misissippi"]
    weight = 1.0 / np.arange(1, len(words) + 1) ** 1.2
    texts = [" ".join(rng.choice(words, 120, p=weight / weight.sum()).tolist()) for _ in range(60)]
    out = [(k, t) for k, t in enumerate(texts)]
    return [*out, (7, out[7][1]), (7, out[9][1]), (None, out[3][1]), (100, None), (101, ""), (102, "Mississippi MISSISSIPPI. 12mississippi_x")]


@pytest.mark.parametrize("group", [2000, 3, 1])
def test_variants_are_those_of_all_pairs(spark, rows, group):
    assert result(variants.spelling_variants(frame(spark, rows), group=group)) == plain(counted(rows))


def test_chains_of_forms_lead_to_their_root(spark):
    words = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000}
    rows = [(k, f"{w} " * n) for k, (w, n) in enumerate(words.items())]
    assert counted(rows) == words
    found = {r[0]: r[1:3] for r in result(variants.spelling_variants(frame(spark, rows)))}
    assert found == {"abcdefg": ("abcdefgh", "abcdefghij"), "abcdefgh": ("abcdefghi", "abcdefghij"),
                     "abcdefghi": ("abcdefghij", "abcdefghij"), "abcdefghij": (None, "abcdefghij")}


def test_very_long_words_and_ties(spark):
    long = "ab" * 40_000
    words = [long, long[:500] + "z" + long[500:], long[:-1], "tiedtie", "tiedtix", "tiedtia"]
    rows = [(k, f"{w} {w}") for k, w in enumerate(words)]
    counts = counted(rows)
    assert len(counts) >= 5
    assert result(variants.spelling_variants(frame(spark, rows))) == plain(counts)


def test_acceptor_is_minimal_and_accepts_its_words_only():
    words = sorted({"tap", "taps", "top", "tops", "", "a"})
    start, states = variants.minimal_acceptor(words)

    def spelled(state, front=""):
        final, arcs = states[state]
        return ([front] if final else []) + [w for c, s in arcs.items() for w in spelled(s, front + c)]

    assert sorted(spelled(start)) == words and len(states) == 5
    assert variants.minimal_acceptor([])[1] == [(False, {})]


def test_composition_gives_each_pair_once():
    rng = np.random.default_rng(6)
    words = sorted({"".join(rng.choice(list("ab"), rng.integers(1, 8)).tolist()) for _ in range(150)})
    found = [tuple(sorted(p)) for p in variants.OneEdit(words).pairs(99)]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a, b in combinations(words, 2) if one_edit(a, b)}


def test_empty_tables(spark):
    for rows in ([], [(1, None), (2, "short words only")]):
        found = variants.spelling_variants(frame(spark, rows))
        assert found.count() == 0 and found.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_query_over_a_given_table(spark, small):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert result(variants.vocabulary_variants(spark, small)) == plain(counted(rows))
