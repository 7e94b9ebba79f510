import hashlib
import random

import pytest
from tokenizers import Tokenizer

from mulberry.llm import bpe


@pytest.fixture(scope="module")
def tools():
    path = bpe.tokenizer_path()
    with open(path, encoding="utf-8") as f:
        v = bpe.Vocabulary(f.read())
    return v, Tokenizer.from_file(path)


def same(v, t, text):
    ids = list(bpe.Encoder(v).encode(text))
    plain = bpe.Decoder(v, plain=True)
    assert ids == t.encode(text, add_special_tokens=False).ids, text[:80]
    assert "".join(map(plain.feed, ids)) == t.decode(ids, skip_special_tokens=False)


def test_words_and_oddities(tools):
    for s in ["Hello's World <|endoftext|> I'll go İ ΣΑΣ ß é 한글 １２３ ½ ²", "😀😀 ok'S", "", "  \n", "<|startoftext|><|endoftext|>x", "áb Å", "it's 'tis ''s", "a\x1cb \x85 c​d　e"]:
        same(*tools, s)


def test_long_words_stream(tools):
    v, t = tools
    rng = random.Random(4)
    words = [w.removesuffix("</w>") for w in list(v.ids)[512:]]
    for k in (700, 1000, 5000, 20_000):
        for letters in ("a", "ab", "haha", "thenandigreso", "=-*", "漢字한글é"):
            same(v, t, "".join(rng.choice(letters) for _ in range(k)))
        same(v, t, "".join(rng.choice(words) for _ in range(k // 5)))


def test_memory_is_bounded(tools):
    v, _ = tools
    seen = []
    real = bpe.merge

    def spy(symbols, ranks, made):
        seen.append(sum(map(len, symbols)))
        return real(symbols, ranks, made)

    bpe.merge = spy
    try:
        n = sum(1 for _ in bpe.Encoder(v).word("ab" * 30_000))
    finally:
        bpe.merge = real
    assert n and max(seen) <= v.lookahead + bpe.STRIDE + len("</w>")


def test_lookahead_of_a_small_list():
    # b c reaches back over b, then a b would have reached over a
    assert bpe.sufficient_lookahead([("b", "c"), ("a", "b")], "") == 2
    assert bpe.sufficient_lookahead([("a", "b")], "") == 1
    with pytest.raises(ValueError):
        bpe.sufficient_lookahead([("ab", "c"), ("a", "b")], "")


def test_text_decoder(tools):
    v, _ = tools
    d = bpe.Decoder(v)
    ids = list(bpe.Encoder(v).encode("the 漢字 😀 café"))
    assert "".join(map(d.feed, ids)) + d.end() == "the 漢字 😀 café "


def test_digests(docs_of, tools):
    v, t = tools
    rows = [(1, "The quick <|endoftext|> brown"), (2, None), (3, ""), (4, "word " * 50_000), (5, "q" * 9000), (1, "The quick <|endoftext|> brown")]
    got = sorted(map(tuple, bpe.encode_decode(docs_of(rows), bpe.tokenizer_path()).collect()))
    want = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_decode(docs_of([]), bpe.tokenizer_path()).count() == 0
    assert bpe.encoded(docs_of(rows[:1]), bpe.tokenizer_path()).first().ids == t.encode(rows[0][1], add_special_tokens=False).ids


def test_every_character_between_letters(tools):
    v, t = tools
    e = bpe.Encoder(v)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(every), 4096):
        text = " ".join(f"a{c}b" for c in every[k : k + 4096])
        got = list(e.encode(text))
        if got != t.encode(text, add_special_tokens=False).ids:
            for c in every[k : k + 4096]:
                same(v, t, f"a{c}b")
            raise AssertionError(hex(ord(every[k])))


def test_marks_are_ordered_and_joined(tools):
    import unicodedata

    marks = [chr(c) for c in range(0x300, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) in ("Mn", "Mc")]
    rng = random.Random(9)
    for _ in range(200):
        same(*tools, "".join(rng.choice(["a", "e", "ᄀ", "ᅡ", "ᆨ", "க", "ो", "\u1100", "\U00011382", "\U000113c9", *rng.sample(marks, 5)]) for _ in range(40)))


def test_windows_do_not_show(tools, monkeypatch):
    v, t = tools
    rng = random.Random(7)
    texts = ["".join(rng.choice(["word ", "é", "Ʃ", "'s", "''", "l", "'", "12", "漢字", "\n", "ab", "<|endoftext|>", "—", "e\u0301", "\u1c89"]) for _ in range(400)) for _ in range(30)]
    texts += ["a" * 9000 + "é" * 3000 + "1" * 300 + "-" * 5000 + " b", "漢" * 4000, "=" * 7000 + "'s" * 900, "x" * 64 + "y " * 100]
    for window, long in ((64, 16), (100, 4), (1 << 16, 1024)):
        monkeypatch.setattr(bpe, "WINDOW", window)
        monkeypatch.setattr(bpe, "LONG", long)
        for text in texts:
            same(v, t, text)


def test_a_word_of_many_windows_is_never_held(tools):
    v, t = tools
    e = bpe.Encoder(v)
    text = "ab" * 200_000
    [(word, special)] = list(e.pieces(text[: bpe.LONG]))
    assert word == text[: bpe.LONG] and not special
    sizes = []
    for w, _ in e.pieces(text):
        for part in w:
            sizes.append(len(part))
    assert sum(sizes) == len(text) and max(sizes) <= bpe.WINDOW
    assert list(e.encode(text)) == t.encode(text, add_special_tokens=False).ids
