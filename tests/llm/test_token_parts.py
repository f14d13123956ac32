"""Counts by remembered parts of texts against the library's counts of whole texts."""

import random

import public_tokenizers

from pulsemill.llm import token_counts

ITEMS = ["a", "B", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "'s", " 're", "'", "1", "٣", "é", "́", "中", "😀", "<|endoftext|>", ".", " -"]


def test_parts_add_up_to_whole_texts(monkeypatch):
    draw = random.Random(7)
    texts = ["".join(draw.choices(ITEMS, k=draw.randrange(40))) for _ in range(5000)]
    texts += ["", "a " * 300_000, "x" * 5000, " ".join(str(k) for k in range(3000))]
    for parts in (token_counts.PARTS, 50):
        monkeypatch.setattr(token_counts, "PARTS", parts)
        encoder = token_counts.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
        assert encoder.parts
        whole = [len(x.ids) for x in encoder.model.encode_batch(texts, add_special_tokens=False)]
        got = [n for at in range(0, len(texts), 700) for n in encoder.count(texts[at : at + 700])]
        assert got == whole
        assert len(encoder.known) <= parts + 50_000 and all(len(p) <= token_counts.PART for p in encoder.known)


def test_tokenizers_that_look_past_blanks_take_whole_texts():
    assert not token_counts.Encoder(public_tokenizers.path("word_bpe_49k.json")).parts
