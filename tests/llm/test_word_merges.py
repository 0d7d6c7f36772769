"""ASCII words get their ids from the merges alone, the same as from the whole tokenizer."""

import random
from string import ascii_letters
from types import SimpleNamespace

from hearthline.llm.packing import ChunkIds
from hearthline.llm.queries import tokenizer_path


def test_ascii_words_need_no_encoding():
    draw = random.Random(7)
    words = {"".join(draw.choices(ascii_letters, k=draw.randint(1, 30))) for _ in range(3000)} | {"s", "ll", "don", "Straight", "THE"}
    ids = ChunkIds(tokenizer_path())
    whole = {word: ids.encoded(word) for word in words}
    encode, seen = ids.tokenizer.encode, []
    ids.tokenizer = SimpleNamespace(encode=lambda text, **more: seen.append(text) or encode(text, **more))
    ids.learn(set(words) | {"\u00fcber", "na\u00efve"})
    assert {word: ids.known[word] for word in words} == whole
    assert sorted(" ".join(seen).split()) == ["na\u00efve", "\u00fcber"]


def test_texts_have_the_ids_of_the_whole_tokenizer():
    ids = ChunkIds(tokenizer_path())
    for text in ("Plain words, and MORE. It's 12 o'clock", "\u0416ID Word \u0130stanbul it's", "", " a  b\tc\nd "):
        assert ids.of(text) == ids.encoded(text)
