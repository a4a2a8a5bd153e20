"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random
import re

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def prose(rng, n, stems=("ba", "ke", "li", "mo", "nu", "ra", "se", "ti", "vo", "zu")):
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n))


def alnum(text):
    return WORD.findall((text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))


def documents(seed=1, n=60):
    """(doc_id, text, lang, source, n_chars, row, size): a third of the rows copies of one text, others near copies."""
    rng = random.Random(seed)
    shared, hot = prose(rng, 40), prose(rng, 80)
    rows = []
    for i in range(n):
        text = hot if i % 3 == 0 else prose(rng, rng.randint(1, 120))
        if i % 7 == 1:
            words = hot.split()
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        if i % 5 == 2:
            text = f"{prose(rng, 5)} {shared} {prose(rng, 3)}"
        rows.append((i, text, "xx", f"s{i % 4}" if i % 11 else None, len(text), "row", -1))
    long = prose(rng, 4000)
    rows += [
        (n, None, None, None, None, None, None), (n + 1, "", "xx", "s0", 0, "", 0), (None, f"{shared} tail", "xx", "s1", 9, "r", 1),
        (n + 2, long, "xx", "s9", len(long), "r", 1), (n + 2, long, "xx", "s9", len(long), "r", 1), (n + 3, "... !!!", "xx", "s9", 7, "r", 1),
        (n + 4, "a" * 400, "xx", "s9", 400, "r", 1), (n + 5, "äöü " * 120, "xx", "s9", 480, "r", 1), (n + 6, "äöü " * 120 + "x", "xx", "s9", 481, "r", 1),
        (n + 7, "one", "xx", "s9", 3, "r", 1), (n + 8, "One.", "xx", "s9", 4, "r", 1),
    ]
    return rows


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, row string, size long"
