import random

import numpy as np
import xxhash

from mulberry.llm import substring_dedup as d


def slow_cuts(raw):
    """Byte by byte: the window's gear sum, the least and the most."""
    n, last, out = len(raw), 0, []
    if n <= d.LEAST:
        return [n] if n else []
    gear = [int(x) for x in d.GEAR]

    def whole(i):  # whether a cut after byte i parts no character
        return i + 1 >= n or raw[i + 1] & 0xC0 != 0x80

    def force(until):
        nonlocal last
        while until - last > d.MOST:
            at = last + d.MOST
            while not whole(at - 1):
                at -= 1
            out.append(at)
            last = at

    for i in range(n):
        h = sum(gear[raw[i - j]] << j for j in range(min(d.WINDOW, i + 1))) & (1 << 64) - 1
        h = (h * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 32
        if h < (1 << 32) // d.MEAN and whole(i) and i + 1 - last >= d.LEAST:
            force(i + 1)
            if i + 1 - last >= d.LEAST:
                out.append(i + 1)
                last = i + 1
    force(n)
    return [*out, n] if last < n else out


def test_cuts_are_those_of_the_plain_loop():
    rng = random.Random(1)
    for text in ["", "short", "a" * 3000, "é漢😀" * 500, *["".join(rng.choices("abcde é漢\n", k=rng.randint(1, 3000))) for _ in range(20)]]:
        raw = text.encode()
        ends = d.cuts(np.frombuffer(raw, np.uint8))
        assert ends == slow_cuts(raw)
        assert (ends[-1] if ends else 0) == len(raw)
        for a, b in zip([0, *ends], ends, strict=False):
            raw[a:b].decode()


def test_insertions_shift_nothing():
    rng = random.Random(2)
    a = "".join(rng.choices("abcdefgh ", k=5000)).encode()
    b = b"something put in front " + a

    def parts(x):
        e = d.cuts(np.frombuffer(x, np.uint8))
        return {xxhash.xxh3_128_digest(x[i:j]) for i, j in zip([0, *e], e, strict=False)}

    assert len(parts(a) & parts(b)) >= 0.95 * len(parts(a))


def brute(rows, least=d.PASSAGE):
    chunks, owner = {}, {}
    for i, t in dict(rows).items():
        raw = (t or "").encode()
        e = slow_cuts(raw)
        chunks[i] = [(a, b, raw[a:b]) for a, b in zip([0, *e], e, strict=False)]
        for *_, c in chunks[i]:
            owner[c] = min(owner.get(c, i), i)
    out = []
    for i, cs in chunks.items():
        run = []
        for a, b, c in [*cs, (None, None, None)]:
            if c is not None and owner[c] < i:
                run.append((a, b, owner[c]))
            elif run:
                if run[-1][1] - run[0][0] >= least:
                    out.append((i, min(o for *_, o in run), run[0][0], run[-1][1], len(run), run[-1][1] - run[0][0]))
                run = []
    return sorted(out)


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(2, 9))) for _ in range(3000)]

    def text(n):
        return " ".join(rng.choices(words, k=n))

    passages = [text(60) for _ in range(4)]
    rows = [(i, text(120)) for i in range(20)]
    rows += [(20 + i, f"{text(40)} {passages[i % 4]} {text(30)}") for i in range(12)]
    rows += [(40, rows[3][1]), (41, None), (42, ""), (43, text(30_000)), (44, "same line again and again\n" * 50)]
    return rows, passages


def test_against_the_plain_version(docs_of):
    rows, passages = corpus()
    docs = docs_of([*rows, rows[0], (None, rows[1][1])])
    found = d.repeated_passages(docs)
    got = sorted((r.doc_id, r.first_doc_id, r.start, r.stop, r.n_chunks, r.n_bytes) for r in found.collect())
    assert got == brute(rows)
    # every later document with a passage is found, and no document without
    assert {r[0] for r in got} == {*range(24, 32), 40}
    assert all(r.n_words >= 15 for r in found.collect())
    texts = {r.doc_id: r.text for r in d.without_repeats(docs, found).collect()}
    assert texts[40] == "" or len(texts[40]) < 60
    assert texts[43] == dict(rows)[43] and texts[41] is None and texts[20] == dict(rows)[20]
    for r in got:
        assert len(texts[r[0]].encode()) == len(dict(rows)[r[0]].encode()) - sum(x[5] for x in got if x[0] == r[0])


def test_empty(docs_of):
    assert d.repeated_passages(docs_of([])).count() == 0
