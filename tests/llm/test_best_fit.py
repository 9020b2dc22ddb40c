"""Bin completion against the best of all packings, and packed documents against the tokenizer itself."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from swipeline.llm.best_fit import best_fit_pack
from swipeline.llm.bin_completion import best_fit, bin_completion, least_bins, undominated
from swipeline.llm.tokens import word_encoder

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), len(items)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= items[k]:
                left = list(rooms)
                left[left.index(room)] -= items[k]
                go(k + 1, left)
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best


def bins_of(patterns, counts, capacity):
    got = Counter()
    for times, filling in patterns:
        assert times > 0 and sum(x * k for x, k in filling) <= capacity
        for x, k in filling:
            got[x] += times * k
    assert got == Counter(counts)
    return sum(times for times, _ in patterns)


def test_as_few_bins_as_can_be():
    draw, better = random.Random(1), 0
    for _ in range(300):
        capacity = draw.choice([20, 50, 100])
        items = [draw.randint(max(1, capacity // draw.choice([10, 5, 4])), int(capacity * draw.choice([0.5, 0.7, 1]))) for _ in range(draw.randint(1, 11))]
        counts = Counter(items)
        patterns, least = bin_completion(counts, capacity)
        first = bins_of(best_fit(counts, capacity), counts, capacity)
        assert least <= bins_of(patterns, counts, capacity) == fewest(items, capacity) <= first
        better += first > fewest(items, capacity)
    assert better > 0  # the search has found what best fit misses


def test_best_fit_is_best_fit():
    draw = random.Random(2)
    for _ in range(100):
        items, rooms = [draw.randint(1, 60) for _ in range(draw.randint(1, 200))], []
        for x in sorted(items, reverse=True):
            fit = [k for k, room in enumerate(rooms) if room >= x]
            if fit:
                rooms[min(fit, key=lambda k: rooms[k])] -= x
            else:
                rooms.append(100 - x)
        assert bins_of(best_fit(Counter(items), 100), Counter(items), 100) == len(rooms)


def test_fillings_are_undominated():
    assert undominated({7: 1, 4: 1, 3: 1}, 7, 7, 9) == [(0, ((7, 1),))]  # one item that fills the room dominates the two
    assert undominated({6: 1, 5: 1, 4: 1, 2: 1}, 10, 3, 9) == [(0, ((6, 1), (4, 1)))]  # not 5 + 4, as 6 could take the place of 5
    assert undominated({9: 2}, 5, 5, 9) == [(5, ())] and undominated({9: 2}, 5, 4, 9) == []
    assert least_bins({6: 3, 5: 2, 4: 3}, 10) == 4 and bin_completion({}, 10) == ([], 0)


def test_millions_of_items_of_few_lengths():
    counts = {1500: 3_000_000, 1300: 3_000_000, 1296: 3_000_000, 4096: 10}
    patterns, least = bin_completion(counts, 4096)
    assert bins_of(patterns, counts, 4096) == least == 3_000_010


def test_word_ids_are_the_tokenizers():
    exact, draw = Tokenizer.from_file(WORDS), random.Random(3)
    letters = [chr(c) for c in range(0x20, 0x7F)] + [chr(c) for c in range(0xA1, 0x100)] + list("eaionst' \n\t") * 9
    odd = ["中", "\x01", "\x02", "\xa0", "İ", "ſ", "́", "<|endoftext|>", "\x85", "\x1c"]
    texts = ["".join(draw.choices(letters + odd * (k % 3 == 0), k=draw.randint(0, 60))) for k in range(6000)] + ["", " ", None, "x" * 30000]
    for text, ids in zip(texts, word_encoder(WORDS)(pa.array(texts)), strict=True):
        assert ids.tolist() == exact.encode(text or "", add_special_tokens=False).ids, text
    assert word_encoder(WORDS)(pa.array([], pa.string())) == []


def check_pack(df, rows, window):
    exact = Tokenizer.from_file(WORDS)
    want = Counter((i, tuple([*exact.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    got = best_fit_pack(df, window=window).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and r.start == r.piece * window
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append((r.start, tuple(np.frombuffer(r.ids, "<u4"))))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    ids = Counter(i for i, _ in rows)
    for (i, whole), n in want.items():
        if ids[i] == 1:
            assert tuple(x for _, part in sorted(documents[i]) for x in part) == whole
    pieces = Counter((i, s, w[s : s + window]) for (i, w), n in want.items() for s in range(0, len(w), window) for _ in range(n))
    assert pieces == Counter((i, s, p) for i, parts in documents.items() for s, p in parts)
    lengths = Counter(len(p) for _, _, p in pieces.elements())
    patterns, least = bin_completion(lengths, window, 1000)
    assert len(sequences) == sum(n for n, _ in patterns)
    return len(sequences), least


def test_pack_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    used, least = check_pack(df, rows, 4096)
    assert used <= least + 1
    check_pack(df.repartition(7), rows, 100)


def test_pack_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b c"), (None, "a b c"), (3, "word " * 40000), (4, "x " * 63), (5, "x " * 127), (-(2**63), "low"), (2**63 - 1, "high")]
    clash = df = spark.createDataFrame([(*r, 1, "y", 3, 4, 5) for r in rows], "doc_id long, text string, length int, part string, rank int, `_first` int, `a.b` int").repartition(3)
    check_pack(clash, rows, 64)
    assert best_fit_pack(df.limit(0)).count() == 0
    assert best_fit_pack(df.filter(F.col("doc_id") == 2).limit(1)).count() == 1
