"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string, row string, node string, hash string"
WORDS = "the river ran under old stone while seven quiet boats moved past green fields toward morning light again".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def rows(seed: int = 1) -> list[tuple]:
    """(doc_id, text, lang, source)"""
    rng = random.Random(seed)
    base = [sentence(rng, n) for n in (5, 30, 60, 120, 300)]
    out = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    words = base[3].split()
    for k in range(6):  # near copies
        near = list(words)
        near[10 + 15 * k] = "changed"
        out.append((10 + k, " ".join(near), "en", "s0"))
    out += [(20, base[2], None, "s1"), (21, base[2].upper(), "de", "s1"), (22, base[2], "en", None), (22, base[2], "en", None)]
    out += [(30, None, "en", "s2"), (31, "", "en", "s2"), (32, "", None, None), (None, base[1], "en", "s0"), (None, None, None, None)]
    out += [(33, "\n \t\r\x0b\x0c ", "fr", "s1"), (34, "one two", "en", "s1"), (35, "ONE two", "en", "s1"), (36, "123 4, 5!", "en", "é")]
    out += [(40, " ".join(sentence(rng, 400) for _ in range(40)), "en", "s0"), (41, "x" * 30_000, "en", "s0"), (42, "日本語 ▁ 🙂\n\nÀ  b", "ja", "s2")]
    return out


def documents(spark, data=None):
    data = rows() if data is None else data
    # The last columns clash with names that the operators use or return.
    full = [(i, t, lang, s, len(t or ""), True, "x", "y", "z", "h") for i, t, lang, s in data]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text) -> list[bytes]:
    return lower(text or "").encode().split()
