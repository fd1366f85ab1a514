"""Rows of odd shapes for the operators of the subpackage."""

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, copy int, n string, h double, kept string, tokens array<string>, component_id string, u int, set binary"
LONG = " ".join(f"Wort{i % 977} wörd{i % 13}" for i in range(6000))
BASE = " ".join(f"alpha{i} beta{i % 7} gamma{i}." for i in range(60))


def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows, other columns with clashing names."""
    texts = [
        (1, BASE),
        (2, BASE),
        (3, BASE.replace("gamma30.", "delta")),
        (4, None),
        (5, ""),
        (6, " \t\n"),
        (7, "One two"),
        (8, "ONE  two\n"),
        (9, "\x1cfoo\x1dbar é é ΑΣ <|endoftext|> it's 10 000 😀!!  x y"),
        (10, LONG),
        (11, LONG + " end"),
        (12, LONG),
        (None, BASE),
        (None, None),
        (13, "a" * 1500),
        (14, "ab " * 400),
        (15, "#*$%&|<> line\nline\nline\n\nline"),
        (16, "x " + BASE[300:900]),
        (16, "x " + BASE[300:900]),
        (17, "Ünïcode " + BASE[310:905] + " tail"),
        (18, "0 00 a0 0b"),
    ]
    return [(i, t, None if k % 5 == 4 else "en", None if k % 3 == 2 else f"s{k % 4}", None, "k", k, None, 1.5, "x", None, None, 3, None) for k, (i, t) in enumerate(texts)]
