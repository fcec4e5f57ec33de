"""The remembered words give the library's own ids."""

import random

import pyarrow.parquet as pq

from seqslice.llm import token_output as m


def test_encoder_equals_library():
    e = m.Encoder(m.tokenizer_file(), most=5000)
    x = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    r = random.Random(1)
    letters = [chr(c) for c in [9, 10, 11, 12, 13, *range(28, 127), 0x85, *range(0xA0, 0x250), 0x3A3, 0x301, 0x2028, 0x65E5]] + ["'s", "'re", " ", "<|endoftext|>", "<|startoftext|>"]
    x += ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(5000)]
    x += ["".join(r.choice(letters[: 90 + 400]) for _ in range(r.randint(0, 30))) for _ in range(5000)]
    assert e.words and e.encode(x) == e.whole(x)


def test_unknown_kinds_of_tokenizers_go_to_the_library():
    e = m.Encoder(m.tokenizer_file("byte_bpe_50k.json"))
    assert not e.words and e.encode(["a b"]) == e.whole(["a b"])
