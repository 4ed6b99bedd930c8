import random
from collections import Counter, defaultdict

import pytest

from siftwell.llm import packing
from siftwell.llm.packing import BestFit, pack, token_counter

public = pytest.importorskip("public_tokenizers")
VOCABULARY = public.path("byte_bpe_50k.tiktoken")


def plain_best_fit(sizes, capacity, places):
    """The same rule with a list; the containers of all items, and which are open at the end."""
    bins, out, n = [], [], 0
    for s in sizes:
        if not s:
            out.append(0)
            continue
        fit = [b for b in bins if b[0] >= s]
        if fit:
            free = min(b[0] for b in fit)
            b = [b for b in bins if b[0] == free][-1]
            bins.remove(b)
        else:
            if len(bins) == places:
                free = min(b[0] for b in bins)
                bins.remove([b for b in bins if b[0] == free][-1])
            b, n = (capacity, n), n + 1
        out.append(b[1])
        if b[0] > s:
            bins.append((b[0] - s, b[1]))
    return out, {b[1] for b in bins}


@pytest.mark.parametrize("places", [1, 3, 64])
def test_best_fit(places):
    r = random.Random(places)
    sizes = [r.randrange(0, 101) for _ in range(3000)]
    packer = BestFit(100, places)
    got = {}
    for i, s in enumerate(sizes):
        got |= dict(packer.put(s, i))
        assert packer.open <= places
    want, still_open = plain_best_fit(sizes, 100, places)
    assert got == {i: b for i, b in enumerate(want) if b not in still_open or not sizes[i]}
    got |= dict(packer.finish())
    filled = Counter()
    for i, s in enumerate(sizes):
        filled[got[i]] += s
    assert len(got) == len(sizes) and max(filled.values()) <= 100 and len(filled) <= max(want) + 1
    if places == 64:
        assert sum(sizes) / (100 * len(filled)) > 0.96


def test_bad_parameters():
    with pytest.raises(ValueError):
        BestFit(0)


@pytest.mark.parametrize("capacity", [16, 512])
def test_documents(spark, capacity):
    r = random.Random(7)
    texts = [None, "", "word " * 5000, "один два три " * 20, "<|endoftext|>"] + [" ".join(r.choices(["ferry", "Brücke", "12.5", "canal"], k=r.randrange(1, 200))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, -1, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, tokens int, container string").repartition(3)
    got = pack(df, capacity, VOCABULARY, public.PATTERN).collect()
    count = token_counter(VOCABULARY, public.PATTERN)
    pieces, filled = defaultdict(list), Counter()
    for g in got:
        pieces[g.doc_id].append(g)
        filled[g.container] += g.tokens
    assert set(pieces) == set(range(len(texts))) and max(filled.values()) <= capacity
    for i, t in enumerate(texts):
        mine, n = sorted(pieces[i], key=lambda p: p.piece), count(t) if t else 0
        assert sum(p.tokens for p in mine) == n and len(mine) == max(1, -(-n // capacity))
        assert [p.start for p in mine] == [k * capacity for k in range(len(mine))] and all(p.tokens == capacity for p in mine[:-1])
    if capacity == 512:
        assert sum(filled.values()) / (capacity * len(filled)) > 0.9


def test_long_texts(monkeypatch):
    count = token_counter(VOCABULARY, public.PATTERN)
    text = "ferry Brücke  don't 12.5 \n\n жук ... " * 50
    short = count(text)
    monkeypatch.setattr(packing, "LONG_TEXT", 10)
    assert count(text) == short
    assert count("x" * 1_500_000) == 1_500_000 // 8 and count(" " * 600_000 + "x") > 0


def test_repeated_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id bigint, text string")
    assert pack(df, 64, VOCABULARY, public.PATTERN).count() == 3
    assert pack(df.limit(0), 64, VOCABULARY, public.PATTERN).count() == 0
