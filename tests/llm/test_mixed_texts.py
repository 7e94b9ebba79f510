import hashlib

import corpus_pipeline


def test_texts_of_one_identifier_and_length_all_stay(spark, docs_of):
    rows = [(None, f"{a} two three four", "s") for a in ("one", "eins", "un")] + [(7, "a b c", "s"), (7, "d e f", "s"), (8, "x y z", "t")]
    docs = docs_of([*rows, (None, None, "s")])
    plan = {r.digest: r for r in corpus_pipeline.mix(docs, digest=True).collect()}
    got = sorted(r.text for r in corpus_pipeline.mix_sources(spark, docs, "").collect() if r.text)
    want = []
    for _, text, _ in rows:
        r, words = plan[hashlib.md5(text.encode()).hexdigest()], text.split()
        want += [text] * r.copies
        for a, b in ((r.from1, r.to1), (r.from2, r.to2)):
            if b > a:
                want.append((" " if a else "") + " ".join(words[a:b]))
    assert got == sorted(want) and len(plan) == 7
