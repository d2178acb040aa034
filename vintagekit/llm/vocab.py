"""The public tokenizers that the token operators call: where their files are, their versions, and where a text may be
cut so that its parts give the tokens of the whole."""

from __future__ import annotations

import hashlib
import os
import re

import pyarrow as pa
import pyarrow.compute as pc

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: One space between two other characters: no token of either kind of vocabulary goes on across it.
SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Before a space between two other characters, and between a letter or digit and a mark: where byte-level merges never go
#: on. The letters are of ranges that every Unicode version knows as such.
_LETTER = "0-9A-Za-zÀ-ÖØ-öø-ɏ"
WORD = re.compile(rf"(?<=\S)(?= \S)|(?<=[{_LETTER}])(?=[.,])")
_RUN = re.compile(rf"( ?[{_LETTER[3:]}]+)([.,;:!?]+)?")
#: Spaces and marks that stand elsewhere.
_ODD_SPACE, _ODD_MARK = re.compile(r" (?:(?=\s)|(?<=\s ))"), re.compile(rf"[.,](?<![{_LETTER}].)")


def vocabulary(name: str) -> str:
    """The path of a file of the installed vocabulary package."""
    import public_tokenizers
    return public_tokenizers.path(name)


_DIGESTS: dict[str, str] = {}


def version(path: str, options: str) -> str:
    """Digest of what decides the tokens of a text: the file's bytes, the library's version, the options."""
    if path not in _DIGESTS:
        with open(path, "rb") as f:
            _DIGESTS[path] = hashlib.sha256(f.read()).hexdigest()
    import sentencepiece
    import tokenizers
    library = sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__
    return hashlib.sha256(f"{_DIGESTS[path]} {library} {options}".encode()).hexdigest()


_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level vocabularies write printable Latin-1 bytes as themselves, the others as the characters from 256 on.
_LETTERS = dict(zip(_PLAIN + [b for b in range(256) if b not in _PLAIN], [*_PLAIN, *range(256, 256 + 256 - len(_PLAIN))]))


class ByteBpe:
    """A tokenizers file. ``separable``: tokens never depend on text beyond a cut, which holds for byte-level merges
    behind the usual splitting rule, without a normalizer, and added tokens that take no spaces with them."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers
        t = self.tokenizer = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        t.encode_special_tokens = special_as_text
        rule = t.pre_tokenizer
        added = t.get_added_tokens_decoder().values()
        self.separable = (t.normalizer is None and isinstance(rule, pre_tokenizers.ByteLevel) and rule.use_regex
                          and not rule.add_prefix_space
                          and not any(a.lstrip or a.rstrip or a.single_word or " " in a.content for a in added))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, texts: list[str]) -> list[list[int]]:
        """The same for short parts of texts: a run of letters is one word of the splitting rule and so are marks after
        it, so the merges alone give their tokens."""
        out: list = [None] * len(texts)
        other = []
        merge, words = self.tokenizer.model.tokenize, _RUN.fullmatch
        marks: dict = {None: []}
        for i, t in enumerate(texts):
            if not (m := words(t)):
                other.append(i)
                continue
            run, mark = m.groups()
            if mark not in marks:
                marks[mark] = [x.id for x in merge(mark)]
            out[i] = [x.id for x in merge(run.encode().decode("latin-1").translate(_LETTERS))] + marks[mark]
        for i, ids in zip(other, self.encode([texts[i] for i in other])):
            out[i] = ids
        return out

    def token_bytes(self) -> list[bytes]:
        """Bytes of each id: its letters read as byte letters; an added token's content."""
        byte = {chr(c): b for b, c in _LETTERS.items()}
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        out = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            out[i] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
        return out


class PieceBpe:
    """A sentencepiece model. ``separable``: no piece goes on after a character into a space."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.separable = not any(re.search("[^▁]▁", p) for p in pieces)
        probe = "a  ﬁ  b "
        self.separable &= self.model.normalize(probe) == "▁" + probe.replace(" ", "▁")  # keeps every character

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def token_bytes(self) -> list[bytes]:
        """Bytes of each id: its piece with U+2581 as a space, <0xHH> as a byte."""
        return [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in enumerate(self.model.id_to_piece(i) for i in range(self.model.vocab_size()))]


def words(text: str) -> list[str]:
    """The text cut by ``WORD``, each part in a short form: one that begins with a space goes without it, others begin
    with a zero character."""
    if not text:
        return []
    if text[0] not in " .," and text[-1] != " " and "\0" not in text and not _ODD_SPACE.search(text) and not _ODD_MARK.search(text):
        # the same cuts without a match for each
        return ("\0" + text.replace(",", " \0,").replace(".", " \0.")).split(" ")
    return ["\0" + p if p[0] != " " or "\0" in p else p[1:] for p in WORD.split(text)]


def pieces(text: str) -> list[str]:
    """The text cut by ``SPACE``."""
    if not text[0].isspace() and not text[-1].isspace() and not _ODD_SPACE.search(text):
        return text.split(" ")
    return SPACE.split(text)


def spelled(word: str) -> str:
    return word[1:] if word[:1] == "\0" else " " + word


def slices(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    """(first, length) of runs of rows with about ``most`` bytes of text, at least a row each."""
    sizes = [0 if n is None else n for n in pc.binary_length(texts).to_pylist()]
    out, at, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            out.append((at, i - at))
            at, total = i, 0
        total += n
    if at < len(sizes):
        out.append((at, len(sizes) - at))
    return out
