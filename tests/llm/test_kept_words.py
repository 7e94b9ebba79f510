"""What an encoding task keeps is bounded, and changes no result."""

from mulberry.llm import bpe


def test_few_kept_words_give_the_same(spark, docs_of, monkeypatch):
    docs = docs_of([(i, " ".join(f"word{(i * k) % 97} Ünïcode{k}" for k in range(30)), "a") for i in range(40)])
    one = sorted(map(tuple, bpe.encode_decode(docs, bpe.tokenizer_path()).collect()))
    assert bpe.KEPT_WORDS <= 100_000  # a task keeps twice as many at most, some 500 bytes each
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    assert sorted(map(tuple, bpe.encode_decode(docs, bpe.tokenizer_path()).collect())) == one


def test_the_library_holds_no_second_vocabulary():
    """It is asked for its normaliser only, which is the file's own; the pipeline's tasks keep fewer words."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    with open(bpe.tokenizer_path(), encoding="utf-8") as f:
        spec = f.read()
    light, whole = Tokenizer.from_str(bpe.Vocabulary(spec).spec), Tokenizer.from_str(spec)
    assert light.get_vocab_size() == 0
    for text in ("ÀÉ  ﬁ̖́ Σς\n\tİ", "q̖́ͅ ㍿ Ǆ", ""):
        assert light.normalizer.normalize_str(text) == whole.normalizer.normalize_str(text)
    assert 2 * corpus_pipeline.KEPT_WORDS <= 50_000
