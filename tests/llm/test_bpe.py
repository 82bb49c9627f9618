import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prismal.llm import bpe

NAMES = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}
ENCODERS = {k: bpe.Encoder(bpe.vocabulary(v), k, cached=200) for k, v in NAMES.items()}
SIGNS = st.sampled_from([*"abcXYZéßçñ 0123.,!?$#'\n\t\r", "  ", " \n", "\x85", "\xa0", " ", "　", "\x1c", "'s", "don't", "é", "Σ", "İ", "中文", "²", "_", "-", "<|endoftext|>", "क़", "​", "﻿", "𝒳", "×", "÷"])


def whole(kind, text):
    e = ENCODERS[kind]
    return e.pack(e.tok.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("kind", NAMES)
@settings(max_examples=400, deadline=None)
@given(texts=st.lists(st.lists(SIGNS, max_size=30).map("".join), max_size=12))
def test_chunks_give_the_ids_of_the_whole_text(kind, texts):
    assert ENCODERS[kind].encode(texts) == [whole(kind, t) for t in texts]


@pytest.mark.parametrize("kind", NAMES)
@settings(max_examples=100, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text(kind, text):
    text = text.encode("utf-8", "ignore").decode()
    assert ENCODERS[kind].encode([text, "", text + " and more"]) == [whole(kind, text), b"", whole(kind, text + " and more")]
