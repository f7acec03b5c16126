"""Rows that every operator has to bear."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, kind string, word string, u long, h long"
LONG = "Lorem ipsum dolor sit amet, consectetur adipiscing elit number {}. "


def odd_rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, odd characters; columns whose names operators use inside."""
    long_text = "".join(LONG.format(i) for i in range(6000))
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, "one two three"), (5, "one two three"), (None, "a text without an id but with words in it"), (None, None),
        (6, long_text), (7, long_text), (8, "x" * 50_000), (9, "é" * 3000), (10, "日本語のテキスト、です。 ＡＢＣ \x00 \x1f   end"), (11, "<|endoftext|> and <|startoftext|>"),
        (12, "The quick brown fox jumps over the lazy dog while nine zebras watch in silence."), (13, "The quick brown fox jumps over the lazy dog while nine zebras watch in silence."),
    ]
    return [(i, t, None, "s", None if t is None else len(t), "k", "v", "w", 1, 2) for i, t in texts]
