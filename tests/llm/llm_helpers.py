"""Plain-Python words and shingles, and texts at the edges."""

import re


def word_list(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x20\x09-\x0D]+", lowered)


def shingle_list(words, width=5):
    return [tuple(words[j : j + width]) for j in range(len(words) - width + 1)] or ([tuple(words)] if words else [])


#: Null, empty and blank texts, few words, ties, repeated rows, null ids and a very long text.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (6, "a b c d"), (7, "A  b\tc d"), (None, "one"), (None, None),
    (8, " ".join(f"w{i % 977}" for i in range(300_000))), (9, "é ü  ß　x"), (10, "x" * 3000), (10, "other text under the same number here"),
]
