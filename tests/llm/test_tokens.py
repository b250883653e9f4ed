"""Token files and byte-level BPE against the libraries."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from helpers import awkward_rows, sha
from tokenizers import Tokenizer

from lineward.llm import byte_bpe, token_files
from lineward.llm.queries import BYTE_RANKS, WORD_TOKENIZER

PIECES = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "a", "b", "é", "1", "２", " ", "  ", "\n", "\t", " ", "　", "!", "?",
          "漢", "\U0001F600", "\x1c", "​", "it", "'S", " '", "''", "́", "\x01", "\0"]


def random_texts(n: int) -> list[str]:
    rng = random.Random(1)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(n)] + ["x" * 5000, "ab" * 3000 + " " * 100, ""]


def test_byte_bpe_equals_library():
    with open(BYTE_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = byte_bpe.vocabulary(BYTE_RANKS)
    texts = random_texts(5000) + [t or "" for _, t, *_ in awkward_rows()]
    for text, raw in zip(texts, words.encode(texts)):
        ids = np.frombuffer(raw, "<u4")
        assert ids.tolist() == library.encode_ordinary(text), text
        assert words.decode(ids, words.offsets(ids)) == text.encode()


def test_byte_bpe_rows(docs, no_docs):
    rows = byte_bpe.round_trip(docs, BYTE_RANKS).collect()
    assert sorted((r["doc_id"] or -1, r["decoded_sha256"]) for r in rows) == sorted((i or -1, sha((t or "").encode())) for i, t, *_ in awkward_rows())
    encoded = byte_bpe.encode(docs, BYTE_RANKS)
    back = byte_bpe.decode(encoded, BYTE_RANKS).collect()
    assert sorted((r["doc_id"] or -1, bytes(r["content"])) for r in back) == sorted((i or -1, (t or "").encode()) for i, t, *_ in awkward_rows())
    assert byte_bpe.round_trip(no_docs, BYTE_RANKS).count() == 0


def test_word_encoder_equals_library():
    library = Tokenizer.from_file(WORD_TOKENIZER)
    encoder = token_files.WordEncoder(WORD_TOKENIZER)
    texts = random_texts(3000) + [t or "" for _, t, *_ in awkward_rows()]
    for text, raw in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(raw, encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_words_of_small_letters_go_to_the_merges_alone(monkeypatch):
    library = Tokenizer.from_file(WORD_TOKENIZER)
    encoder = token_files.WordEncoder(WORD_TOKENIZER)
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöüßéñÿ", k=rng.randint(1, 30))) for _ in range(3000)]
    asked = []
    monkeypatch.setattr(encoder, "tokenizer", type("Whole", (), {
        "encode_batch_fast": lambda self, texts, **more: asked.extend(texts) or library.encode_batch_fast(texts, **more)})())
    for text in (" ".join(words), " ".join(w + "." for w in words if w[-1].isascii())):
        (raw,) = encoder.encode([text])
        assert np.frombuffer(raw, encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
    assert "".join(asked) in ("", ".")


def test_token_files(docs, no_docs):
    library = Tokenizer.from_file(WORD_TOKENIZER)
    rows = token_files.token_table(docs, WORD_TOKENIZER).collect()
    expected, start = [], 0
    for key, text, *_ in sorted(awkward_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == expected
    assert token_files.token_table(no_docs, WORD_TOKENIZER).count() == 0
