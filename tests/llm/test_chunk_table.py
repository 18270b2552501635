"""The chunk look-up that packing reads texts by."""

import random

from loomdown.llm import bpe


def test_texts_cut_at_every_space_need_no_pattern(monkeypatch):
    """Texts without odd spaces are cut by one split; any text's chunks join to the text, and are those of ``chunks``."""
    rnd = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "\t", "　", "x" * 300, "y" * 255, "z" * 256, "don't", "\U0001F600", " \n ", ""]
    table = bpe.ChunkTable(lambda c: c, 50)
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        got = table.values(text)
        assert got == [c for c in bpe.chunks(text) if c] and "".join(got) == text
    assert max(map(len, table.whole)) <= bpe.LONGEST and max(map(len, table.tail)) < bpe.LONGEST
    monkeypatch.setattr(bpe, "chunks", None)
    assert table.values("one two, three") == ["one", " two,", " three"]
    assert table.values(" one two") == [" one", " two"]
