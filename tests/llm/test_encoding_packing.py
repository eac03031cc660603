import base64
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from braidwork.llm import bpe, packing

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(bpe.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library(reference):
    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text("ab <|endoftext|>'s\n", max_size=80)), max_size=8))
    def check(texts):
        assert bpe.encoder(bpe.vocabulary_path()).encode_batch(texts) == [reference.encode_ordinary(t) if t else [] for t in texts]

    check()


def test_table(spark, reference):
    long = "abcdefghij" * 7000 + " " + "日本語テキスト" * 2000 + " aaaaaaa" * 500
    rows = [(1, None, "x"), (2, "", "x"), (3, long, "x"), (4, "Hello <|endoftext|> world", "x"), (4, "Hello <|endoftext|> world", "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = bpe.encode(df, "doc_id", "text").collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(reference.encode_ordinary(t)) if t else ()) for i, t, _ in rows)
    assert {r.doc_id: r.n_tokens for r in bpe.encode(df, "doc_id", "text", counts_only=True).collect()}[1] == 0
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0


def brute(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits)[1]] -= s
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.data())
def test_runs_equal_the_sequential_algorithm(capacity, data):
    sizes = data.draw(st.lists(st.integers(1, capacity), max_size=150))
    runs, n = packing.best_fit_runs(dict(Counter(sizes)), capacity)
    used = [0] * n
    for size, _, items, first, each in runs:
        for k in range(items):
            used[first + k // each] += size
    assert sum(r[2] for r in runs) == len(sizes) and sorted(capacity - u for u in used) == brute(sizes, capacity)


@pytest.mark.parametrize("together", [10, 250_000])
def test_pack_table(spark, monkeypatch, together):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", together)
    rng = random.Random(1)
    rows = [(i, 30 if rng.random() < 0.4 else rng.randint(0, 260), "clash") for i in range(400)] + [(900, None, "c"), (901, 0, "c"), (902, -5, "c"), (903, 100, "c"), (904, 1000, "c")]
    df = spark.createDataFrame(rows + rows[:9], "doc_id bigint, n int, container string")
    got = packing.pack(df, "doc_id", "n", 100).collect()
    by, pieces = defaultdict(int), defaultdict(list)
    for r in got:
        by[r.container] += r.n_tokens
        pieces[r.doc_id].append((r.piece, r.start, r.n_tokens))
    assert max(by.values()) <= 100
    for i, n, _ in rows:
        ps, n = sorted(pieces[i]), max(n or 0, 0)
        assert sum(p[2] for p in ps) == n and [p[0] for p in ps] == list(range(max(1, -(-n // 100)))) and all(p[1] == 100 * p[0] for p in ps)
    sizes = [p[2] for ps in pieces.values() for p in ps if p[2]]
    assert sorted(100 - v for v in by.values()) == brute(sizes, 100)
    assert packing.pack(df.limit(0), "doc_id", "n", 100).count() == 0
