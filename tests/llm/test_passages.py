import random

import numpy as np

from mulberry.llm import substring_dedup as d


def test_chunks_are_short_and_cut_alike_wherever_they_stand():
    rng = random.Random(5)
    for raw in [b"a" * 3000, b"ab" * 900, "é漢😀".encode() * 300, b"x" * 78, b"x" * 79, *[bytes(rng.choices(b"abcdefgh ", k=rng.randint(130, 4000))) for _ in range(20)]]:
        at = d.bounds(np.frombuffer(raw, np.uint8)).tolist()
        assert bool(at) == (len(raw) >= d.BOUND + d.SPREAD - 1)
        if at:
            places = [-1, *at, len(raw) - d.BOUND + 1]
            assert max(b - a for a, b in zip(places, places[1:], strict=False)) <= d.SPREAD
            assert len(at) <= 3 * len(raw) / d.SPREAD + 2
    least = d.BOUND + 2 * d.SPREAD - 1
    for _ in range(300):
        passage = bytes(rng.choices(b"abcdefgh ", k=least))
        cut = []
        for _ in range(2):
            raw = bytes(rng.choices(b"abcdefgh ", k=rng.randint(0, 200))) + passage + bytes(rng.choices(b"abcdefgh ", k=rng.randint(0, 200)))
            at = d.bounds(np.frombuffer(raw, np.uint8)).tolist()
            cut.append({raw[a : b + d.BOUND] for a, b in zip(at, at[1:], strict=False)})
        assert any(c in passage for c in cut[0] & cut[1])  # a whole chunk of the passage, in both


def test_short_passages_are_found_to_their_ends(docs_of):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé漢", k=rng.randint(1, 7))) for _ in range(4000)]

    def text(n):
        return " ".join(rng.choices(words, k=n))

    rows, want = [], {}
    for i in range(300):
        passage = text(51 + i % 5) if i % 2 else text(200).encode()[: 128 + i % 40].decode(errors="ignore") + "ab"
        rows += [(i, f"{text(rng.randint(0, 90))}<{passage}>{text(rng.randint(0, 90))}")]
        front = f"{text(rng.randint(0, 90))}[".encode()
        rows += [(1000 + i, f"{front.decode()}{passage}]{text(rng.randint(0, 90))}")]
        want[1000 + i] = (i, len(front), len(front) + len(passage.encode()), passage)
    docs = docs_of([*rows, rows[1], (None, rows[1][1]), (5000, None), (5001, "")])
    found = d.passages(docs)
    got = {r.doc_id: (r.first_doc_id, r.start, r.stop) for r in found.collect()}
    assert got == {i: w[:3] for i, w in want.items()}
    held = dict(rows)
    for r in found.collect():
        raw = held[r.doc_id].encode()
        assert r.n_bytes == r.stop - r.start and r.n_words == len(raw[: r.stop].split()) - len(raw[: r.start].split())
    left = {r.doc_id: r.text for r in d.without_repeats(docs, found).collect()}
    assert all(left[i] == held[i].replace(w[3], "") for i, w in want.items())
    assert left[3] == held[3]


def test_whole_copies_and_nothing(docs_of):
    rng = random.Random(7)
    a = "".join(rng.choices("abcdefg h", k=5000))
    got = d.passages(docs_of([(1, a), (2, a), (3, a[:2500] + "!" + a[2500:])])).collect()
    assert {(r.doc_id, r.first_doc_id, r.start, r.stop) for r in got} == {(2, 1, 0, 5000), (3, 1, 0, 2500), (3, 1, 2501, 5001)}
    assert d.passages(docs_of([])).count() == 0


def test_recall_by_length(docs_of):
    """Every passage of the least length is found, to all its bytes, whatever surrounds it."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(3000)]
    for n in (30, 51, 60):
        rows, want = [], {}
        for i in range(120):
            passage = " ".join(rng.choices(words, k=n))
            for j in (0, 1):
                front = " ".join(rng.choices(words, k=rng.randint(0, 60))) + "([" [j]
                rows.append((1000 * j + i, front + passage + ")]"[j] + " ".join(rng.choices(words, k=rng.randint(0, 60)))))
                if j:
                    want[1000 + i] = (i, len(front), len(front) + len(passage))
        got = {r.doc_id: (r.first_doc_id, r.start, r.stop) for r in d.passages(docs_of(rows)).collect()}
        assert got == {k: v for k, v in want.items() if v[2] - v[1] >= d.PASSAGE}
