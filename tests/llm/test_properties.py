"""Properties that hold for any input."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from barline.llm import near_duplicates, packing, pii, quality, substrings, token_counts
from tests.llm.test_pii import plain as plain_spans
from tests.llm.test_quality import plain as plain_figures

RUNS = settings(max_examples=150, deadline=None)
TEXT = st.text(alphabet=st.sampled_from(list("ab1 0.@+-()\n\t$|<é🙂９")), max_size=80)


@RUNS
@given(TEXT)
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


@RUNS
@given(TEXT)
def test_figures(text):
    assert quality.base_stats(text.encode()) == plain_figures(text)


@RUNS
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit(lengths):
    bins, offsets, used = packing.best_fit(sorted(lengths, reverse=True), 64)
    assert sum(used) == sum(lengths) and all(0 < u <= 64 for u in used)
    ends = {}
    for n, k, at in zip(sorted(lengths, reverse=True), bins, offsets):
        assert at == ends.get(k, 0)
        ends[k] = at + n
    assert all(a + b > 64 for k, a in enumerate(used) for b in used[:k])  # no two bins could be one


@RUNS
@given(st.binary(max_size=3000))
def test_chunks_tile(data):
    ends = substrings.boundaries(data, 32, 16, 64).tolist()
    assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == len(data)
    assert all(16 <= b - a <= 64 for a, b in zip([0, *ends[:-2]], ends[:-1]))


@RUNS
@given(st.text(max_size=60).map(lambda t: re.sub("[\ud800-\udfff]", "", t)))
def test_tokens_add_up(text):
    data = text.encode()
    encoder = token_counts._encoder(token_counts.vocabulary_file(), token_counts.split_pattern())
    ends = encoder.ends(data)
    assert (ends[-1] if len(ends) else 0) == len(data)
    if data:
        chars = token_counts.character_starts(data)
        sections = token_counts.line_sections(data, chars)
        for rule in token_counts.RULES:
            counts, _ = token_counts.attribute(ends, chars, sections, rule)
            assert abs(counts.sum() - len(ends)) < 1e-6


@RUNS
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=1, max_size=12))
def test_spanning_links_connect_what_is_linked(sets):
    arrays = [np.array(sorted(s), dtype=np.uint64) for s in sets]

    def classes(links):
        parent = list(range(len(sets)))

        def root(k):
            return k if parent[k] == k else root(parent[k])

        for a, b in links:
            parent[root(a)] = root(b)
        return [[root(a) == root(b) for b in range(len(sets))] for a in range(len(sets))]

    every = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert classes(near_duplicates.spanning_links(list(range(len(sets))), arrays, 80)) == classes(every)
