import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spoorless.llm import alignment


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*alignment.default_tokenizers())


def whole(pair, text):
    """Tokens and byte ranges by the tokenizers on whole texts; None if there are none."""
    if not text:
        return None
    a, b = pair.a.encode(f" {text}", add_special_tokens=False).ids, pair.b.encode(text)
    sides = []
    for ids, table in ((a, pair.a_bytes), (b, pair.b_bytes)):
        if b"".join(table[i] for i in ids) != f" {text}".encode():
            return None
        at, spans = 0, []
        for i in ids:
            spans.append((i, at, at + len(table[i])))
            at += len(table[i])
        sides.append(spans)
    return sides


def brute(pair, rows):
    told, held = [], Counter()
    for i, text in rows:
        if (sides := whole(pair, text)) is None:
            told.append((i, 0, 0, 0, [], ""))
            continue
        a, b = sides
        links = [(x, y) for x, s, e in a for y, t, f in b if max(s, t) < min(e, f)]
        both = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for high in both:
            groups.append("|".join(",".join(str(x) for x, s, e in side if low <= s and e <= high) for side in (a, b)))
            low = high
        held.update(set(links))
        told.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return sorted(((i, n, m, g, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), h) for i, n, m, g, links, h in told), key=str)


TEXTS = [
    "A plain text, with words and 12345 numbers.\nNew line\n\n  indented\tand\r\nso on  ", "Élève naïve, façade — 日本語 текст 🙂👍🏽 ﬁn", "<|endoftext|> and <s> </s> <unk> <0x0A>", "", None, " ", "\n", "  two  spaces  ", "a▁b", "nul\x00 and\x1cseparators\x85x y",
    "x" * 3000, "word " * 1500, "A plain text, with words and 12345 numbers.", "A plain text, with words and 12345 numbers.", "))\r\n;;\r x\r\ry\n\rz", "\ttab", "nbsp nbsp   x", "'s 'll don't I'VE", "�​﻿",
]


@pytest.mark.parametrize("piece,chars", [(128, 4_000_000), (3, 50)])
def test_against_brute_force(spark, pair, piece, chars):
    rows = [*enumerate(TEXTS), (None, "no id, plain text"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, BLOCK int, keys string").repartition(3)
    assert sorted(map(tuple, alignment.aligned(df, piece=piece, chars=chars).collect()), key=str) == brute(pair, rows)


def test_empty_table(spark):
    assert alignment.aligned(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab .,\n\r\t'▁é日🙂 ;)1"), max_size=40))
def test_chunks_give_the_tokens_of_whole_texts(pair, text):
    a, b, n_a, n_b = pair.encode([text])
    sides = whole(pair, text)
    assert (a.tolist(), b.tolist()) == (tuple([i for i, *_ in s] for s in sides) if sides else ([], []))
    assert (n_a.tolist(), n_b.tolist()) == ([len(a)], [len(b)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.booleans()), max_size=60), st.integers(1, 9))
def test_merge_path(marks, piece):
    a = np.array([k + 1 for k, (x, _) in enumerate(marks) if x] + [len(marks) + 1])
    b = np.array([k + 1 for k, (_, y) in enumerate(marks) if y] + [len(marks) + 1])
    of_a, of_b, tie = alignment.overlaps(a, b, piece)
    spans = lambda ends: list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
    want = [(i, j, e == f) for i, (s, e) in enumerate(spans(a)) for j, (t, f) in enumerate(spans(b)) if max(s, t) < min(e, f)]
    assert list(zip(of_a.tolist(), of_b.tolist(), tie.tolist(), strict=True)) == want
    i, j = alignment.cuts(a, b, piece)
    merged = sorted([(v, 0) for v in a.tolist()] + [(v, 1) for v in b.tolist()])
    assert [(sum(k == 0 for _, k in merged[:d]), sum(k == 1 for _, k in merged[:d])) for d in range(0, len(merged), piece)] == list(zip(i.tolist(), j.tolist(), strict=True))
