"""What workers remember is bounded, and an operator's memory is given up when another one starts."""

from tidewake.llm.common import Memory
from tidewake.llm.encode import WORD, encoder


def test_words_of_the_packer_are_bounded():
    enc, most = encoder(WORD), 0
    for k in range(9):
        enc.ids(" ".join(f"w{k}x{i}" for i in range(50_000)))
        most = max(most, len(enc.plain) + len(enc.plain.old))
    assert most <= 300_000
    want = enc.tok.encode("w0x7 w8x9", add_special_tokens=False).ids
    assert enc.ids("w0x7 w8x9") == b"".join(i.to_bytes(4, "little") for i in want)


def test_memory_is_forgotten_once():
    gone = []
    Memory.use("first", lambda: gone.append("first"))
    Memory.use("second", lambda: gone.append("second"))
    Memory.use("second", lambda: gone.append("second"))
    assert gone == ["first"] and list(Memory.forget) == ["second"]
    Memory.use("third", lambda: None)
    assert gone == ["first", "second"]
