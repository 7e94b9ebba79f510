"""BPE encoding as a streaming transducer of bounded lookahead, and its incremental decoder.

What follows a point in a word can change the tokens before it only through a
chain of merges: a merge (u, v) whose v begins at the point moves the point
left by u, and the next merge of the chain, of a later rank, needs a right part
whose leftmost derivation goes through u.  The heaviest such chain is computed
from the merge list; it is a lookahead that suffices for every text.  So tokens
that end that far before the end of what has been read are final, are emitted
and forgotten.  Texts are normalised and split in windows, and a word of many
windows is read as it comes, so besides the row itself memory grows with
neither the word nor the text.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mulberry.llm.common import table

#: Words whose tokens a task keeps, letters of the longest of those, and bytes beyond the lookahead that are merged at once.
KEPT_WORDS, KEPT_LETTERS, STRIDE = 75_000, 40, 256
#: Characters of a text that are normalised and split at once, and letters from which a word at the end of a window is read piecemeal.
WINDOW, LONG = 1 << 16, 1024
#: What a window may begin with: no such character joins with those before it.
_BREAK = re.compile("[\x00-\x7f\u3001\u3002\u4e00-\u9fff]")
_SPACE = r"\t-\r \x85\xa0  -     　"
_LOWER_ALONE = {0x3A3: "σ"}  # str.lower() looks at a sigma's neighbours; the normaliser doesn't


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself where printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class Vocabulary:
    """The model file of a word-based byte-level BPE: merges, ids, suffix of word ends, pattern of words."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        # all that the library is asked is its normaliser, so it gets no vocabulary to hold beside this one
        self.spec = json.dumps(d | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None})
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {a["content"]: a["id"] for a in d["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: r for r, m in enumerate(merges)}
        self.made = [u + v for u, v in merges]
        self.letters = byte_letters()
        steps = d["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in d["normalizer"]["normalizers"]]
        if [s["type"] for s in steps] != ["Split", "ByteLevel"] or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("this transducer knows word-based byte-level models with NFC, spaces and lower case only")
        self.words = regex.compile(steps[0]["pattern"]["Regex"].replace(r"\s", _SPACE))
        self.breaks = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.letter_run, self.other_run = regex.compile(r"\p{L}+"), regex.compile(rf"[^{_SPACE}\p{{L}}\p{{N}}]+")
        self.characters: Characters | None = None
        self.lookahead = sufficient_lookahead(merges, self.suffix)


def sufficient_lookahead(merges: list[tuple[str, str]], suffix: str) -> int:
    """Bytes after a token's end that settle it: the heaviest chain of merges by which later text reaches back.

    Chains go up in rank, so one pass from the last merge to the first finds
    the heaviest.  Merge lists must be proper: the parts of a merge come from
    merges before it.
    """
    spines: dict[str, frozenset[str]] = {}
    made: set[str] = set()
    for u, v in merges:
        for part in (u, v):
            if part not in made and len(part.removesuffix(suffix) if suffix else part) > 1:
                raise ValueError(f"{part!r} is merged before it is made")
        made.add(u + v)
        spines[u + v] = spines.get(u + v, frozenset({u + v})) | spines.get(u, frozenset({u}))
    best: dict[str, int] = {}
    most = 0
    for u, v in reversed(merges):
        weight = len(u) + best.get(u, 0)
        most = max(most, weight)
        for t in spines.get(v, (v,)):
            best[t] = max(best.get(t, 0), weight)
    return most


def merge(symbols: list[str], ranks: dict[tuple[str, str], int], made: list[str]) -> list[str]:
    """All merges of a short sequence, lowest rank first, leftmost first; changes the list it is given."""
    get, none = ranks.get, len(made)
    found = [get(p, none) for p in zip(symbols, symbols[1:])]  # noqa: B905
    while found:
        rank = min(found)
        if rank == none:
            break
        i = found.index(rank)
        symbols[i] = made[rank]
        del symbols[i + 1], found[i]
        if i < len(found):
            found[i] = get((symbols[i], symbols[i + 1]), none)
        if i:
            found[i - 1] = get((symbols[i - 1], symbols[i]), none)
    return symbols


class Characters:
    """Characters that the tokenizer's library knows otherwise than Python and the pattern engine do.

    Their Unicode tables are of other versions.  The library is asked once for
    each character met; for texts with others than all agree on, its own
    normaliser is taken, and a stand-in of the library's class is split.
    """

    def __init__(self, spec: str):
        from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

        self.normalizer = Tokenizer.from_str(spec).normalizer
        self.nfc, self.nfd = normalizers.NFC(), normalizers.NFD()
        self.kinds = {stand_in: pre_tokenizers.Split(Regex(pattern), "removed") for stand_in, pattern in (("x", r"\p{L}"), ("0", r"\p{N}"), (" ", r"\s"))}
        self.own = {"x": regex.compile(r"\p{L}"), "0": regex.compile(r"\p{N}"), " ": regex.compile(f"[{_SPACE}]")}
        self.agreed: set[str] = set(map(chr, range(128)))
        self.stand_ins: dict[int, str] = {}

    def _meet(self, ch: str) -> None:
        if "\ud800" <= ch <= "\udfff":
            self.agreed.add(ch)
            return
        kind = next((k for k, split in self.kinds.items() if not split.pre_tokenize_str(ch)), "#")
        own = next((k for k, pattern in self.own.items() if pattern.match(ch)), "#")
        after = "q\u0301" + ch + "\u0316"
        same = kind == own and (kind == " " or self.normalizer.normalize_str(ch) == unicodedata.normalize("NFC", ch).translate(_LOWER_ALONE).lower())
        if same and self.nfd.normalize_str(ch) == unicodedata.normalize("NFD", ch) and self.nfc.normalize_str(after) == unicodedata.normalize("NFC", after):
            self.agreed.add(ch)
        else:
            self.stand_ins[ord(ch)] = kind

    def odd(self, text: str) -> bool:
        """Whether a text has characters that not all agree on."""
        met = set(text) - self.agreed
        for ch in met:
            if ord(ch) not in self.stand_ins:
                self._meet(ch)
        return any(ord(ch) in self.stand_ins for ch in met)

    def normalized(self, text: str) -> tuple[str, str]:
        """A text as the library normalises it, and with stand-ins for what is split otherwise."""
        low = self.normalizer.normalize_str(text)
        self.odd(low)
        return low, low.translate(self.stand_ins)


class Encoder:
    """Encodes texts; holds of a word no more than lookahead and stride, and of a text's copies no more than a window."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    def word(self, word: str | Iterable[str]) -> Iterator[str]:
        """The tokens of one word, given whole or in parts, as they become final."""
        v, letters = self.v, self.v.letters
        if isinstance(word, str):
            data = word.encode("utf-8", "surrogatepass")
            if len(data) <= STRIDE:  # the end is in sight
                symbols = [letters[b] for b in data]
                symbols[-1] += v.suffix
                yield from merge(symbols, v.ranks, v.made)
                return
            word = (word,)
        parts = (part[i : i + 1024].encode("utf-8", "surrogatepass") for part in word for i in range(0, len(part), 1024))
        held: list[str] = []  # tokens after the last final one, merged anew as more is read
        room, unread = v.lookahead + STRIDE, b""
        while True:
            have = sum(map(len, held))
            while have + len(unread) <= room and (more := next(parts, None)) is not None:
                unread += more
            if have + len(unread) <= room:
                break
            symbols = list("".join(held)) + [letters[b] for b in unread[: room - have]]
            unread = unread[room - have :]
            held = merge(symbols, v.ranks, v.made)
            final, at = 0, 0
            for t in held:
                at += len(t)
                if at > room - v.lookahead:
                    break
                final += 1
            yield from held[:final]
            held = held[final:]
        symbols = list("".join(held)) + [letters[b] for b in unread]
        symbols[-1] += v.suffix
        yield from merge(symbols, v.ranks, v.made)

    def _normalized(self, text: str) -> tuple[str, str]:
        """A window in normal form and what is split in its place, mostly the same."""
        if text.isascii():
            low = text.lower()
            return low, low
        v = self.v
        if v.characters is None:
            v.characters = Characters(v.spec)
        if v.characters.odd(text):
            return v.characters.normalized(text)
        text = unicodedata.normalize("NFC", text)
        low = (text.translate(_LOWER_ALONE) if "Σ" in text else text).lower()
        return low, low

    def _windows(self, text: str, lo: int, hi: int) -> Iterator[tuple[str, str]]:
        while lo < hi:
            end = hi
            if hi - lo > WINDOW:
                m = _BREAK.search(text, lo + WINDOW, hi)
                end = m.start() if m else hi
            yield self._normalized(text[lo:end])
            lo = end

    def _words(self, text: str, lo: int, hi: int) -> Iterator[str | Iterator[str]]:
        """The words of a part of a text; those of many windows as an iterator of their parts, to be read before the next word is."""
        words = self.v.words
        if hi - lo <= WINDOW:
            low, shown = self._normalized(text[lo:hi])
            if low is shown:
                yield from words.findall(low)
            else:
                yield from (low[m.start() : m.end()] for m in words.finditer(shown))
            return
        windows = self._windows(text, lo, hi)
        low = shown = ""  # what may go on in the next window

        def going_on() -> Iterator[str]:
            nonlocal low, shown
            run = self.v.letter_run if self.v.letter_run.match(shown) else self.v.other_run
            yield low
            low = shown = ""
            for more, dim in windows:
                m = run.match(dim)
                at = m.end() if m else 0
                yield more[:at]
                if at < len(more):
                    low, shown = more[at:], dim[at:]
                    return

        while True:
            more, dim = next(windows, (None, ""))
            if more is not None:
                low, shown = low + more, shown + dim
            last = None
            for m in words.finditer(shown):
                if last:
                    yield low[last[0] : last[1]]
                last = m.span()
            if last and (more is None or last[1] < len(low)):
                yield low[last[0] : last[1]]
                last = None
            if more is None:
                return
            low, shown = (low[last[0] :], shown[last[0] :]) if last else ("", "")
            if len(low) > LONG:
                yield going_on()

    def pieces(self, text: str) -> Iterator[tuple[str | Iterator[str], bool]]:
        """Words of a text, and whether they are special tokens."""
        if len(text) <= WINDOW and not (self.v.breaks and self.v.breaks.search(text)):
            low, shown = self._normalized(text)
            if low is shown:
                for w in self.v.words.findall(low):
                    yield w, False
                return
        at = 0
        for m in self.v.breaks.finditer(text) if self.v.breaks else ():
            for w in self._words(text, at, m.start()):
                yield w, False
            yield m[0], True
            at = m.end()
        for w in self._words(text, at, len(text)):
            yield w, False

    def encode(self, text: str | None) -> Iterator[int]:
        """The ids of a text as they become final."""
        for w, special in self.pieces(text or ""):
            if special:
                yield self.v.special[w]
            else:
                for t in self.word(w):
                    yield self.v.ids[t]


class Decoder:
    """Decodes ids one by one.

    ``plain`` gives what a tokenizer file without a decoder gives: the tokens
    parted by spaces.  Otherwise bytes are gathered into characters, a word end
    becomes a space, and bytes that form no character become U+FFFD.
    """

    def __init__(self, vocabulary: Vocabulary, plain: bool = False):
        self.v, self.plain, self.started = vocabulary, plain, False
        self.bytes = {c: b for b, c in enumerate(vocabulary.letters)}
        self.specials = set(vocabulary.special.values())
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token: int) -> str:
        t = self.v.tokens[token]
        if self.plain:
            out = f" {t}" if self.started else t
            self.started = True
            return out
        if token in self.specials:
            return self.utf8.decode(b"", True) + t
        last = bool(self.v.suffix) and t.endswith(self.v.suffix)
        data = bytes(self.bytes[c] for c in (t.removesuffix(self.v.suffix) if last else t))
        return self.utf8.decode(data, last) + " " * last

    def end(self) -> str:
        return self.utf8.decode(b"", True)


def _read_spec(spark: SparkSession, path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", kept_words: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Whole texts are encoded; null is the empty text, which has no tokens, and
    the digests of nothing.  Digests are built up piece by piece, so a text's
    ids are never held together.  Repeated rows give repeated rows; other
    columns are not read.  A task keeps the tokens of twice ``kept_words``
    words at most, which is a matter of time and memory only.
    """
    most = kept_words or KEPT_WORDS
    held = docs.sparkSession.sparkContext.broadcast(_read_spec(docs.sparkSession, tokenizer_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(Vocabulary(held.value))
        v = encoder.v
        plain = Decoder(v, plain=True)
        # words met since the last turn and before it: what is still met stays
        known: dict[str, tuple[int, str, str]] = {}
        older: dict[str, tuple[int, str, str]] = {}

        def digest_piece(ids: list[int]) -> tuple[int, str, str]:
            plain.started = False
            return len(ids), " ".join(map(str, ids)), "".join(map(plain.feed, ids))

        def of_text(text: str | None) -> tuple[int, str, str]:
            n, one, two = 0, hashlib.sha256(), hashlib.sha256()
            nonlocal known, older
            ids_out: list[str] = []
            text_out: list[str] = []
            gap = False

            def flush() -> None:
                nonlocal gap
                if ids_out:
                    one.update((" " * gap + " ".join(ids_out)).encode())
                    two.update((" " * gap + " ".join(text_out)).encode())
                    gap = True
                    ids_out.clear()
                    text_out.clear()

            for w, special in encoder.pieces(text or ""):
                whole = isinstance(w, str)
                got = known.get(w) if whole else None
                if got is None:
                    if special:
                        got = digest_piece([v.special[w]])
                    elif whole and len(w) <= KEPT_LETTERS:
                        if len(known) >= most:
                            known, older = {}, known
                        got = known[w] = older.get(w) or digest_piece([v.ids[t] for t in encoder.word(w)])
                    else:
                        part: list[int] = []
                        for t in encoder.word(w):
                            part.append(v.ids[t])
                            if len(part) == 4096:
                                k, a, b = digest_piece(part)
                                n += k
                                ids_out.append(a)
                                text_out.append(b)
                                flush()
                                part = []
                        got = digest_piece(part) if part else None
                if got:
                    n += got[0]
                    ids_out.append(got[1])
                    text_out.append(got[2])
                    if len(ids_out) >= 20_000:
                        flush()
            flush()
            return n, one.hexdigest(), two.hexdigest()

        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"]}).join(pd.DataFrame([of_text(t) for t in pdf["text"]], columns=["n_tokens", "ids_sha256", "decoded_sha256"], index=pdf.index))

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids): the ids themselves."""
    held = docs.sparkSession.sparkContext.broadcast(_read_spec(docs.sparkSession, tokenizer_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(Vocabulary(held.value))
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [list(encoder.encode(t)) for t in pdf["text"]]})

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, ids array<int>")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
