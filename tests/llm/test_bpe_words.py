"""Chunks are encoded as they are asked for, words by the model itself; ids are those of the whole tokenizer."""

import random

from tokenizers import Tokenizer

from prismal.llm import bpe

FILES = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}


def test_words_skip_the_splitter_and_keep_their_ids():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABE", k=rng.randint(1, 60))) for _ in range(300)]
    words += ["über", "École", "naïve", "日本", "<|endoftext|>", "endoftext", "Ġthe", "don't", "x²", "a\xa0b", "\tpad", "  two", "the"] * 3
    for kind, name in FILES.items():
        enc, whole = bpe.Encoder(bpe.vocabulary(name), kind, cached=64), Tokenizer.from_file(bpe.vocabulary(name))
        whole.encode_special_tokens = True
        texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(60)]
        asked: list[str] = []
        real = enc.one
        enc.one = lambda x: asked.append(x) or real(x)
        assert [list(memoryview(x).cast(enc.code)) for x in enc.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(enc.cache) <= 64 and max(map(len, enc.cache)) <= bpe.LONGEST
        few, asked[:] = enc.encode(["the cat"] * 500), []
        assert few == enc.encode(["the cat"] * 500) and not asked and (kind == "word" or enc.direct)
